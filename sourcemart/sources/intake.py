"""Registration of sources by content, refresh, and writes that happen once or conflict."""

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sourcemart.functions.prices import resolve_price
from sourcemart.functions.text import blank
from sourcemart.operators.ranking import numbered
from sourcemart.sources.cells import product_id

# Fixed values of the intake rules.
IGNORED_FOLDERS = [".git", "node_modules", "outputs"]
ALLOWED_SUFFIXES = [".xlsx", ".xls", ".pdf", ".pptx", ".docx", ".csv", ".txt", ".md", ".json", ".png", ".jpg", ".jpeg", ".webp"]
REQUIRED_PART = {".xlsx": "xl/workbook.xml", ".pptx": "ppt/presentation.xml", ".docx": "word/document.xml"}
RESERVED_NAME = "(?i)^(CON|PRN|AUX|NUL|COM\\d|LPT\\d)(\\.|$)"
MAX_BYTES, MAX_ENTRIES, MAX_EXPANDED = 64 * 1024 * 1024, 10000, 256 * 1024 * 1024


# -- files ---------------------------------------------------------------------------------------------------------

def discover(spark: SparkSession, folder: str, suffix: str, with_content: bool = True) -> DataFrame:
    """Files of one suffix below a folder, without tool folders, catalogue folders and lock files."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", f"*{suffix}").load(folder))
    return ignore_paths(files if with_content else files.drop("content"))


def discover_sources(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, name, files, length): what ``discover`` finds, once per source. A folder with the suffix is one source, like the
    file it stands for: engines write a table as a folder of part files. The outermost such folder below ``folder`` counts."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/") + "/"
    below = F.split(F.substr("path", F.lit(len(root) + 1)), "/")
    named = F.array_position(F.transform(below, lambda p: p.endswith(suffix)), F.lit(True))
    source = F.concat(F.lit(root), F.array_join(F.slice(below, F.lit(1), named.cast("int")), "/"))
    return (discover(spark, folder, suffix, with_content=False).groupBy(source.alias("path"))
            .agg(F.count("*").alias("files"), F.sum("length").alias("length"))
            .select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "files", "length"))


def ignore_paths(files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    hidden = F.exists(parts, lambda p: p.isin(*IGNORED_FOLDERS) | p.startswith(".catalog"))
    return files.filter(~hidden & ~name.startswith("~$"))


def read_new_files(spark: SparkSession, folder: str, schema, pattern="*.parquet", files_per_batch=256) -> DataFrame:
    """Stream over the files, or the folders of part files, that ``pattern`` names below ``folder``: the checkpoint of the
    stream is the list of files already processed.

    The number of files per micro-batch bounds what a stateful step holds of one key at a time.
    """
    return (spark.readStream.format("parquet").schema(schema)
            .option("maxFilesPerTrigger", files_per_batch).load(f"{folder}/{pattern}"))


def validate_files(files: DataFrame) -> DataFrame:
    """files(path, content, length) -> ok, reason: name rules, size, first bytes against the suffix, zip budget.

    Only archives are opened, and one at a time, inside the tasks.
    """
    def zip_reason(content: pd.Series, suffix: pd.Series) -> pd.Series:
        def check(data, kind):
            if kind not in REQUIRED_PART or data is None:
                return None
            try:
                entries = zipfile.ZipFile(io.BytesIO(data)).infolist()
            except zipfile.BadZipFile:
                return "not_a_zip"
            if (len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_EXPANDED
                    or any(e.flag_bits & 1 for e in entries)):
                return "too_large_or_encrypted"
            return None if REQUIRED_PART[kind] in {e.filename for e in entries} else "missing_part"
        return pd.Series([check(d, k) for d, k in zip(content, suffix)], dtype="object")

    archive = F.pandas_udf(zip_reason, "string")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, "(\\.[^.]+)$", 1))
    head = F.hex(F.substring("content", 1, 16))
    bad_name = ((F.length(name) > 180) | name.rlike("[\\\\:\\x00]") | name.rlike("[. ]$") | name.rlike(RESERVED_NAME))
    named = files.withColumn("name", name).withColumn("suffix", suffix)
    reason = F.coalesce(
        F.when(bad_name, "bad_name"),
        F.when(~F.col("suffix").isin(*ALLOWED_SUFFIXES), "unsupported_suffix"),
        F.when(F.col("length") == 0, "empty"),
        F.when(F.col("length") > MAX_BYTES, "too_large"),
        F.when((F.col("suffix") == ".pdf") & ~head.startswith("255044462D"), "not_a_pdf"),
        F.when((F.col("suffix") == ".xls") & ~head.startswith("D0CF11E0A1B11AE1"), "not_ole"),
        archive(F.when((F.col("length") <= MAX_BYTES) & F.col("suffix").isin(*REQUIRED_PART), F.col("content")), F.col("suffix")))
    return named.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def verify_sources(selection: DataFrame, files: DataFrame) -> DataFrame:
    """selection(path, hash) against files(path, content_hash): the rows that fail. Empty: the selection holds."""
    return (selection.join(files.select("path", "content_hash"), "path", "left")
            .withColumn("problem", F.when(F.col("content_hash").isNull(), "missing")
                        .when(F.col("content_hash") != F.col("hash"), "changed"))
            .filter("problem IS NOT NULL"))


# -- registration ----------------------------------------------------------------------------------------------------

def intake(files: DataFrame, registered: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files(path, name, content_hash, recognized), registered(doc_id, status) -> (documents, aliases, outcome).

    Same bytes are one document whatever the name; the first path by order names it. A third of all files may be
    copies of one text: the hash group is only ever reduced (min), never collected.
    """
    named = files.withColumn("doc_id", F.concat(F.lit("d_"), F.col("content_hash")))
    first = named.groupBy("doc_id").agg(F.min(F.struct("path", "name", "recognized")).alias("first"))
    known = first.join(registered.select("doc_id", "status"), "doc_id", "left")
    documents = known.filter("status IS NULL").select(
        "doc_id", F.col("first.name").alias("name"),
        F.when(F.col("first.recognized"), "ready").otherwise("pending").alias("status"))
    outcome = named.join(known.select("doc_id", "status", "first"), "doc_id").select(
        "path", "doc_id",
        F.when(F.col("status") == "pending", "needs_mapping").when(F.col("status").isNotNull(), "duplicate")
        .when(~F.col("first.recognized"), "needs_mapping")
        .when(F.col("path") == F.col("first.path"), "ready").otherwise("duplicate").alias("outcome"))
    return documents, named.select("doc_id", "path").distinct(), outcome


def manifest_diff(old: DataFrame, new: DataFrame, verify_hash=False, rebuild=False) -> DataFrame:
    """old(path,size,mtime,hash,config_hash), new(path,size,mtime,config_hash,content) -> path, action, hash.

    Size and time decide first; bytes are hashed only where these do not settle it.
    """
    n = new.select("path", *[F.col(c).alias(f"new_{c}") for c in ("size", "mtime", "config_hash", "content")])
    both = old.withColumn("was", F.lit(True)).join(n.withColumn("now", F.lit(True)), "path", "full")
    same_config = F.lit(not rebuild) & F.col("config_hash").eqNullSafe(F.col("new_config_hash"))
    same_stat = F.col("size").eqNullSafe(F.col("new_size")) & F.col("mtime").eqNullSafe(F.col("new_mtime"))
    settled = F.col("now").isNull() | (F.col("was").isNotNull() & same_config & same_stat & F.lit(not verify_hash))
    hashed = both.withColumn("settled", settled).withColumn(
        "new_hash", F.when(~F.col("settled"), F.sha2(F.col("new_content"), 256)))
    action = (F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("settled"), "skip")
              .when(same_config & (F.col("new_hash") == F.col("hash")), "touch").otherwise("reindex"))
    return hashed.select("path", action.alias("action"), F.coalesce("new_hash", "hash").alias("hash"))


def stale_sources(registry: DataFrame, current: DataFrame) -> DataFrame:
    """registry and current (path, size, mtime, config_hash) -> paths that are missing or no longer as registered."""
    now = current.select("path", *[F.col(c).alias(f"now_{c}") for c in ("size", "mtime", "config_hash")])
    same = [F.col(c).eqNullSafe(F.col(f"now_{c}")) for c in ("size", "mtime", "config_hash")]
    return registry.join(now, "path", "left").filter(~(same[0] & same[1] & same[2])).select("path")


def relocate(registry: DataFrame, files: DataFrame, old_root: str, new_root: str) -> tuple[DataFrame, DataFrame]:
    """registry(path, hash, config_hash), files(path, content_hash, config_hash) -> (moves, rejects).

    Every source below the old root must exist below the new one with the same hash and configuration, and the
    new path must be free. Callers apply the moves only if nothing is rejected.
    """
    old_root, new_root = old_root.rstrip("/") + "/", new_root.rstrip("/") + "/"
    moves = registry.filter(F.col("path").startswith(old_root)).withColumn(
        "target", F.concat(F.lit(new_root), F.substr("path", F.lit(len(old_root) + 1))))
    found = files.select(F.col("path").alias("target"), "content_hash", F.col("config_hash").alias("target_config"))
    taken = registry.select(F.col("path").alias("target"), F.lit(True).alias("taken"))
    problem = F.coalesce(
        F.when(F.col("taken"), "destination_registered"),
        F.when(F.col("content_hash").isNull() | (F.col("content_hash") != F.col("hash")), "missing_or_changed"),
        F.when(~F.col("config_hash").eqNullSafe(F.col("target_config")), "config_changed"),
        F.when(F.col("target").contains("/../"), "escapes_root"))
    checked = moves.join(found, "target", "left").join(taken, "target", "left").withColumn("problem", problem)
    kept = ["path", "target", "hash"]
    return checked.filter("problem IS NULL").select(*kept), checked.filter("problem IS NOT NULL").select(*kept, "problem")


def relocated(products: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """products(path, sheet, identity, occurrence, id, ...), moves(path, target) -> (products, translation(id, new_id)).

    A product's id holds its source's path, so products of moved sources get the id that reading the source at its new place
    would give. Nothing else of a product changes, and no source is read again.
    """
    target = moves.select("path", F.col("target").alias("_target"))
    moved = products.join(target, "path", "left")
    new_id = product_id(F.col("_target"), F.col("sheet"), F.col("identity"), F.col("occurrence"))
    changed = moved.withColumns({"_new": F.when(F.col("_target").isNotNull(), new_id), "path": F.coalesce("_target", "path")})
    translation = changed.filter("_new IS NOT NULL").select("id", F.col("_new").alias("new_id"))
    return changed.withColumn("id", F.coalesce("_new", "id")).select(*products.columns), translation


def translate_ids(tables: dict[str, DataFrame], translation: DataFrame, key="id") -> dict[str, DataFrame]:
    """Every dependent table with the new ids of moved products, for one version in which all of them change together."""
    new = translation.select(F.col("id").alias("_old"), "new_id")
    found = {}
    for name, frame in tables.items():
        joined = frame.join(new, F.col(key) == F.col("_old"), "left").withColumn(key, F.coalesce("new_id", key))
        found[name] = joined.select(*frame.columns)
    return found


def remove_source(tables: dict[str, DataFrame], gone: DataFrame, key="doc_id") -> dict[str, DataFrame]:
    """Every dependent table without the rows of the removed sources."""
    ids = gone.select(key).distinct()
    return {name: frame.join(ids, key, "left_anti") for name, frame in tables.items()}


def source_listing(sources: DataFrame, products: DataFrame, stale: DataFrame, key="doc_id") -> DataFrame:
    """Every source with its number of products, zero included, and whether it is stale."""
    counts = products.groupBy(key).agg(F.count("*").alias("n"))
    marked = stale.select(key).distinct().withColumn("is_stale", F.lit(True))
    return (sources.join(counts, key, "left").join(marked, key, "left")
            .withColumn("products", F.coalesce("n", F.lit(0)).cast("long"))
            .withColumn("stale", F.coalesce("is_stale", F.lit(False))).drop("n", "is_stale"))


# -- once or conflict --------------------------------------------------------------------------------------------

def first_wins(existing: DataFrame, incoming: DataFrame, key: list[str], signature: str, order: list[str],
               words=("added", "skipped", "conflict")) -> DataFrame:
    """Incoming rows with ``outcome``: the first of a key is added, an equal repeat skipped, a different one conflicts.

    The holder of each key is found by a reduction, so a key repeated millions of times costs one row per task.
    """
    stored = existing.select(*key, F.col(signature).alias("_stored"))
    position = F.struct(*order)
    first = incoming.groupBy(*key).agg(F.min(F.struct(position.alias("at"), F.col(signature).alias("sig"))).alias("_first"))
    holder = first.join(stored, key, "left").select(
        *key, F.coalesce("_stored", F.col("_first.sig")).alias("_holder"),
        F.when(F.col("_stored").isNull(), F.col("_first.at")).alias("_at"))
    return incoming.join(holder, key).withColumn(
        "outcome", F.when(~F.col(signature).eqNullSafe(F.col("_holder")), words[2])
        .when(position.eqNullSafe(F.col("_at")), words[0]).otherwise(words[1])).drop("_holder", "_at")


def commit(members: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """members and incoming (doc_id, record_key, payload_hash): added / skipped / conflict per incoming row."""
    return first_wins(members, incoming, ["doc_id", "record_key"], "payload_hash", order)


def receipt_once(receipts: DataFrame, operations: DataFrame, order: list[str]) -> DataFrame:
    """Operations by id: completed the first time, replayed with the same payload, conflict with another one."""
    return first_wins(receipts, operations, ["operation_id"], "payload_hash", order, ("completed", "replayed", "conflict"))


# -- export --------------------------------------------------------------------------------------------------------

def stage(items: DataFrame, chosen: DataFrame, price_fields: list[str]) -> DataFrame:
    """items(id, prices map, ...), chosen(position, id) -> chosen rows with one or two display prices and ``problem``.

    Written out only if no row has a problem; to keep the given order, write sorted by position.
    """
    if not 1 <= len(price_fields) <= 2 or len(set(price_fields)) != len(price_fields):
        raise ValueError("Choose one or two distinct display prices")
    shown = F.array(*[resolve_price(F.col("prices"), f) for f in price_fields]).alias("display_prices")
    rows = chosen.join(items.select(*[c for c in items.columns if c != "prices"], shown), "id", "left")
    problem = (F.when(F.col("display_prices").isNull(), "unknown_id")
               .when(F.exists("display_prices", lambda p: p.isNull()), "price_absent_or_ambiguous")
               .when(F.exists("display_prices", lambda p: p["error"].isNotNull()), "price_error"))
    return rows.withColumn("problem", problem)


def source_rows(items: DataFrame, source) -> DataFrame:
    """Every product of one source, numbered in sheet and row order, ready to be staged."""
    return numbered(items.filter(F.col("doc_id") == source).select("id", "sheet", "row"), [], ["sheet", "row", "id"], "position")


def import_summary(observations: DataFrame) -> DataFrame:
    """One row: records without price, detail and image."""
    def none(condition):
        return F.count_if(condition).cast("long")

    return observations.agg(
        F.count("*").alias("products"),
        none(F.forall(F.map_values("prices"), lambda p: p["value"].isNull())).alias("missing_prices"),
        none(blank("features")).alias("missing_details"),
        none(~F.col("has_image")).alias("missing_images"))


def issue_counts(observations: DataFrame) -> DataFrame:
    """Number of issues by what stands before the colon."""
    return (observations.select(F.explode("issues").alias("issue"))
            .groupBy(F.substring_index("issue", ":", 1).alias("kind")).agg(F.count("*").alias("n")))
