"""Binding of the star-schema tables to the catalogue model.

``Tables`` reads the parquet files; every method returns a lazily planned frame of the model, so a query pays
only for the columns it uses.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from sourcemart.functions.text import joined_text, normalize
from sourcemart.operators.textindex import StoredIndex, with_gram_count
from sourcemart.session import scratch_path

STATE = {"O": "active", "F": "superseded", "P": "withdrawn"}
PRICE_FIELD = {"A": "agent_price", "N": "retail_price", "R": "reference_price_b"}
LIST_FIELD, LIST_LABEL = "supply_price", "供货价"


def cents(amount):
    """Amount rounded half up to cents, the same in every engine (``round`` on doubles is not)."""
    return F.floor(amount * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def two_decimals(amount):
    """Amount as text with two decimals; through decimal, which is much cheaper than a formatter."""
    return amount.cast("decimal(18,2)").cast("string")


LIBRARIES: dict[tuple, str] = {}  # text indexes of this process's sessions: where each state of a table was indexed


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- sources -------------------------------------------------------------------------------------------------

    def sources(self) -> DataFrame:
        """One row per order: a quote source with series, date, state and import status."""
        o = self.orders
        state = F.coalesce(*[F.when(F.col("o_orderstatus") == k, F.lit(v)) for k, v in STATE.items()])
        status = (F.when(F.col("o_orderpriority") == "1-URGENT", "partial")
                  .when(F.col("o_orderpriority") == "5-LOW", "pending").otherwise("ready"))
        return o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("series"),
                        F.col("o_orderdate").cast("date").alias("issued_on"), state.alias("state"),
                        status.alias("import_status"))

    # -- products ------------------------------------------------------------------------------------------------

    def items(self) -> DataFrame:
        """One row per part: the product as a catalogue item, with search columns made here, once per item."""
        p = self.part
        second = F.element_at(F.split("p_name", " "), 2)
        base = p.select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
            F.concat(F.lit("M-"), F.col("p_size")).alias("model"), F.col("p_brand").alias("brand"),
            F.concat("p_type", F.lit("/"), second).alias("category"), F.col("p_size").alias("size"),
            F.concat(F.lit("容量："), F.col("p_size"), F.lit("ml\n材质："), F.col("p_type")).alias("features"),
            cents(F.col("p_retailprice")).alias("list_price"))
        return with_gram_count(base.select(
            "*", normalize("category").alias("category_norm"), normalize("brand").alias("brand_norm"),
            normalize(joined_text("name", "model")).alias("name_norm"),
            normalize(joined_text("name", "model", "features", "category", "brand")).alias("all_norm")))

    def observations(self, lines: DataFrame | None = None) -> DataFrame:
        """One row per line item (of ``lines``, all by default) and part: what one source says about one product.

        Part columns stay below the join as plain columns, so filters on them reach the part scan.
        """
        return self.identified(self.unnamed(lines))

    def unnamed(self, lines: DataFrame | None = None, *carried: str) -> DataFrame:
        """Observations without their id, with ``shipped`` and the ``carried`` columns of ``lines``, for joins that come first.

        An id is 64 characters that don't compress, more than all that it is made from; so it is made after the shuffles.
        """
        li = self.lineitem if lines is None else lines
        items = self.items().withColumnRenamed("id", "group_id")
        amount = F.when(F.col("l_discount") != 0.10, cents(F.col("l_extendedprice") / F.col("l_quantity")))
        raw = li.select(
            F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("record_key"),
            F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("group_id"),
            F.coalesce(*[F.when(F.col("l_returnflag") == k, F.lit(v)) for k, v in PRICE_FIELD.items()]).alias("field"),
            F.col("l_linestatus").alias("label"), amount.alias("amount"),
            (F.col("l_linestatus") == "F").alias("has_image"), F.col("l_shipdate").alias("shipped"), *carried)
        return raw.join(items, "group_id")

    @staticmethod
    def identified(rows: DataFrame) -> DataFrame:
        """The rows of ``unnamed`` with their id."""
        # coalesce marks the id as never null; else joins on it add a null test that hashes every row once more.
        number = F.concat_ws("-", "doc_id", "record_key", "group_id", "supplier", F.date_format("shipped", "yyyy-MM-dd"))
        return rows.withColumn("id", F.coalesce(F.sha2(number, 256), F.lit(""))).drop("shipped")

    def priced(self) -> DataFrame:
        """Observations with the price map: the offered price and the list price of the part."""
        return self.with_prices(self.observations())

    def offers(self, field: str) -> DataFrame | None:
        """The observations that offer a price of that role, with it as ``price`` and ``amount``; None for other roles.

        The role is a flag of the line, so other lines are left out where they are read, and bounds on the amount are, too.
        """
        flag = {role: flag for flag, role in PRICE_FIELD.items()}.get(field)
        if flag is None:
            return None
        found = self.observations(self.lineitem.filter(F.col("l_returnflag") == flag))
        return self.with_prices(found).withColumn("price", self._price(F.col("label"), F.col("amount")))

    @staticmethod
    def _price(label, amount):
        return F.struct(label.alias("label"), F.coalesce(two_decimals(amount), F.lit("更新中")).alias("value"),
                        amount.alias("amount"), F.lit(None).cast("string").alias("error"))

    def with_prices(self, obs: DataFrame) -> DataFrame:
        return obs.withColumn("prices", F.create_map(
            F.col("field"), self._price(F.col("label"), F.col("amount")),
            F.lit(LIST_FIELD), self._price(F.lit(LIST_LABEL), F.col("list_price"))))

    def prices(self) -> DataFrame:
        """Long price table of the observations' own offers."""
        return self.observations().select("id", "doc_id", "field", "label", "amount")

    # -- judgements ----------------------------------------------------------------------------------------------

    def tags(self) -> DataFrame:
        """Tags of items, one row per (product, kind, value); a source-made tag wins over an inferred one."""
        e = self.events
        return (e.select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"),
                         F.get_json_object("props", "$.k").alias("value"),
                         F.when(F.col("event_id") % 2 == 0, "source").otherwise("inferred").alias("origin"))
                .groupBy("id", "kind", "value").agg(F.max("origin").alias("origin")))

    def facts(self) -> DataFrame:
        """Overlay facts on items, from the labels: a reviewed category, and the label numbers as measured attributes."""
        lab = self.labels
        return lab.select(F.col("doc_id").alias("id"), F.explode(F.array(
            F.struct(F.lit("category").alias("field"), F.concat(F.lit("reviewed/q"), F.col("quality")).alias("value"),
                     F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("unit"),
                     F.lit("inferred").alias("origin")),
            F.struct(F.lit("attr.capacity").alias("field"), F.col("quality").cast("string").alias("value"),
                     (F.col("quality") * F.lit(1000.0)).alias("number"), F.lit("ml").alias("unit"),
                     F.lit("source").alias("origin")),
            F.struct(F.lit("attr.material").alias("field"), F.when(F.col("toxic") == 1, "lead").otherwise("steel").alias("value"),
                     F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("unit"),
                     F.lit("source").alias("origin")))).alias("f")).select("id", "f.*")

    # -- texts and streams ---------------------------------------------------------------------------------------

    def library(self) -> StoredIndex:
        """Documents as a text index: the first line is the name, the whole text the body.

        Built when a session first asks for it, and again only when the table's files have changed since.
        """
        jvm, context = self.spark.sparkContext._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/documents.parquet")
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        held = files.getContentSummary(path)
        state = (context.applicationId, self.folder, files.getFileStatus(path).getModificationTime(), held.getLength(), held.getFileCount())
        if state not in LIBRARIES:
            docs = self.documents.select(F.col("doc_id").alias("id"), "lang", "source", "n_chars", F.substring_index("text", "\n", 1).alias("name"), "text")
            where = scratch_path(self.spark, "library")
            StoredIndex.build(docs, where)
            LIBRARIES[state] = where
        return StoredIndex.open(self.spark, LIBRARIES[state])

    def evidence(self) -> DataFrame:
        from sourcemart.sources.evidence import text_evidence
        return text_evidence(self.documents.select(F.col("doc_id").alias("doc"), "text"))

    def task_events(self) -> DataFrame:
        """Events as task events; the event number is the sequence, props.k the request."""
        return task_events(self.events)


# Fixed values of this binding: which task event each event type stands for.
TASK_KIND = {"signup": "turn_started", "view": "question", "click": "answered", "purchase": "turn_ended", "error": "error"}


def task_events(events: DataFrame) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in TASK_KIND.items()])
    return events.select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"),
                         F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"),
                         F.get_json_object("props", "$.k").alias("request"), F.col("value"))
