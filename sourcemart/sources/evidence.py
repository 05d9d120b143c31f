"""Source texts as evidence entries, and imports whose every value quotes an entry."""

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sourcemart.functions.text import VISIBLE, lines


def text_evidence(docs: DataFrame) -> DataFrame:
    """docs(doc, text) -> one entry per non-blank line; blank lines keep their number."""
    numbered = docs.select("doc", F.posexplode(lines(F.regexp_replace("text", "^﻿", ""))).alias("at", "text"))
    n = (F.col("at") + 1).cast("string")
    return (numbered.filter(F.col("text").rlike(VISIBLE))
            .select("doc", F.concat(F.lit("line:"), n).alias("ref"), F.lit("text").alias("kind"), "text",
                    F.concat(F.lit("line "), n).alias("locator"), F.lit(1).alias("page")))


def csv_evidence(docs: DataFrame) -> DataFrame:
    """docs(doc, text) -> one entry per non-blank CSV cell; quoted line breaks stay inside their cell."""
    def cells(batches):
        for batch in batches:
            found = [(doc, r, c, value)
                     for doc, text in zip(batch["doc"], batch["text"])
                     for r, row in enumerate(csv.reader(io.StringIO((text or "").removeprefix("\ufeff"), newline="")), 1)
                     for c, value in enumerate(row, 1) if value.strip()]
            yield pd.DataFrame(found, columns=["doc", "r", "c", "text"])

    kind = docs.schema["doc"].dataType.simpleString()
    split = docs.select("doc", "text").mapInPandas(cells, f"doc {kind}, r int, c int, text string")
    return split.select("doc", F.format_string("r%dc%d", "r", "c").alias("ref"), F.lit("text").alias("kind"), "text",
                        F.format_string("row %d, column %d", "r", "c").alias("locator"), F.lit(1).alias("page"))


def column_letters(col):
    """1 -> A, 27 -> AA; three letters at most, as in spreadsheets."""
    n = col.cast("int")

    def letter(index):
        return F.char((index + 65).cast("int"))

    one = letter(n - 1)
    two = F.concat(letter(((n - 27) / 26).cast("int") % 26), letter((n - 1) % 26))
    rest = n - 703
    three = F.concat(letter((rest / 676).cast("int")), letter((rest / 26).cast("int") % 26), letter(rest % 26))
    return F.when(n <= 26, one).when(n <= 702, two).otherwise(three)


def cell_name(row, col):
    return F.concat(column_letters(col), row.cast("string"))


def cell_evidence(cells: DataFrame) -> DataFrame:
    """cells(doc, sheet, sheet_no, row, col, value) -> entries; the page is the sheet's number."""
    name = cell_name(F.col("row"), F.col("col"))
    return (cells.filter(F.col("value").rlike(VISIBLE))
            .select("doc", F.concat(F.lit("sheet"), F.col("sheet_no"), F.lit(":"), name).alias("ref"),
                    F.lit("text").alias("kind"), F.col("value").alias("text"),
                    F.concat(F.col("sheet"), F.lit("!"), name).alias("locator"), F.col("sheet_no").cast("int").alias("page")))


def transcribe(evidence: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests(doc, image_ref, text, reviewer) -> (transcriptions, rejects): only of images that are evidence."""
    images = evidence.filter("kind = 'image'").select("doc", F.col("ref").alias("image_ref"), F.lit(True).alias("known"))
    checked = requests.join(images, ["doc", "image_ref"], "left")
    good = (F.coalesce("known", F.lit(False)) & F.col("text").rlike(VISIBLE) & (F.length("text") <= 20000)
            & F.col("reviewer").rlike(VISIBLE))
    ref = F.concat(F.lit("visual-"), F.substring(F.sha2(F.to_json(F.array("image_ref", "text")), 256), 1, 20))
    kept = checked.filter(good).select("doc", ref.alias("ref"), "image_ref", "text", "reviewer")
    once = kept.groupBy("doc", "ref").agg(F.min(F.struct("reviewer", "image_ref", "text")).alias("one"))  # the first reviewer by name
    return once.select("doc", "ref", "one.image_ref", "one.text", "one.reviewer"), checked.filter(~good).drop("known")


def evidence_union(native: DataFrame, transcriptions: DataFrame) -> DataFrame:
    """Native entries plus transcriptions; these take the page of their image and are marked visual."""
    images = native.filter("kind = 'image'").select("doc", F.col("ref").alias("image_ref"), "page")
    visual = (transcriptions.join(images, ["doc", "image_ref"])
              .select("doc", "ref", F.lit("text").alias("kind"), "text",
                      F.concat(F.lit("visual observation of "), F.col("image_ref")).alias("locator"), "page",
                      F.lit("visual").alias("verification")))
    return native.withColumn("verification", F.lit(None).cast("string")).unionByName(visual, allowMissingColumns=True)


def evidence_page(evidence: DataFrame, order, page=None, offset=0, limit=20, max_chars=240) -> DataFrame:
    """One page of entries; long texts are cut, with their full length and a flag."""
    chosen = evidence if page is None else evidence.filter(F.col("page") == page)
    total = F.length("text")
    return (chosen.orderBy(*order).offset(offset).limit(limit)
            .withColumn("text_length", F.when(total > max_chars, total.cast("long")))
            .withColumn("truncated", total > max_chars)
            .withColumn("text", F.substring("text", 1, max_chars)))


def import_records(records: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records(doc, key, facts array<struct<field,part,ref,quote>>) -> (items, rejects).

    A fact's value is its quote, or the whole entry; the quote must occur verbatim in that entry of the same
    document. Callers write nothing of a batch that has rejects. One document may be cited by very many facts:
    the join is on (doc, ref), so its entries spread over the shuffle instead of meeting in one task.
    """
    repeated = records.groupBy("doc", "key").count().filter("count > 1").select("doc", "key")
    single = records.join(repeated, ["doc", "key"], "left_anti")
    facts = single.select("doc", "key", F.posexplode("facts").alias("at", "fact")).select("doc", "key", "at", "fact.*")
    twice = facts.groupBy("doc", "key", F.concat_ws(".", "field", "part").alias("field")).count().filter("count > 1").drop("count")
    facts = facts.join(twice.select("doc", "key").distinct(), ["doc", "key"], "left_anti")
    entries = evidence.select("doc", "ref", F.col("kind").alias("entry_kind"), F.col("text").alias("entry_text"),
                              "locator", "verification")
    value = F.coalesce("quote", "entry_text")
    checked = (facts.join(entries, ["doc", "ref"], "left").withColumn("value", value)
               .withColumn("ok", F.coalesce((F.col("entry_kind") == "text") & F.col("value").rlike(VISIBLE)
                                            & F.contains("entry_text", "value"), F.lit(False))))
    field = F.concat_ws(".", "field", "part")
    items = checked.groupBy("doc", "key").agg(
        F.bool_and("ok").alias("ok"),
        F.max(F.when((F.col("field") == "name") & F.col("part").isNull(), F.col("value"))).alias("name"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(field.alias("k"), F.col("value").alias("v"))))).alias("raw_fields"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(field.alias("k"), F.col("locator").alias("v"))))).alias("source_cells"),
        F.when(F.bool_or(F.coalesce(F.col("verification") == "visual", F.lit(False))),
               F.array(F.lit("视觉转录:未经原生文本校验"))).otherwise(F.array().cast("array<string>")).alias("issues"))
    rejects = (checked.filter("NOT ok").select("doc", "key", "field", "ref", F.lit("quote not in cited evidence").alias("reason"))
               .unionByName(items.filter("ok AND name IS NULL").select("doc", "key", F.lit("name").alias("field"),
                            F.lit(None).cast("string").alias("ref"), F.lit("record needs a sourced name").alias("reason")))
               .unionByName(repeated.select("doc", "key", F.lit(None).cast("string").alias("field"),
                            F.lit(None).cast("string").alias("ref"), F.lit("record key repeated in batch").alias("reason")))
               .unionByName(twice.select("doc", "key", "field", F.lit(None).cast("string").alias("ref"), F.lit("field given twice").alias("reason"))))
    return items.filter("ok AND name IS NOT NULL").drop("ok"), rejects
