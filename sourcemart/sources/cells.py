"""From grid cells to product records, for many workbooks at once.

Input: ``cells(doc, sheet, row, col, value, dtype)`` and ``merges(doc, sheet, top, left, bottom, right)``; dtype ``e``
marks an error cell, ``f`` a formula without a cached value. Work is keyed by (doc, sheet, row) or finer, so one very
long sheet spreads over all tasks; whole sheets meet only in reductions. Joins of all cells carry a hint for a sort-merge
join: made cells look as few as the rows they were made of, and would be broadcast whole.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from sourcemart.functions.prices import HEADER_ALIASES, PRICE_ROLES
from sourcemart.functions.text import as_column, blank, glob_match, norm_header, normalize_literal
from sourcemart.operators.ranking import numbered
from sourcemart.sources.evidence import cell_name

SHEET = ["doc", "sheet"]
HEADER_ROWS = 20
SLICE = 4096  # rows of a sheet that are scanned together
BAND = 64  # rows of a band in which a merged rectangle or a region is looked up
SCALARS = ["name", "model", "serial", "category", "brand", "supplier"]


def alias_table(spark, aliases: dict | None = None) -> DataFrame:
    """(label, role) rows: the fixed labels, replaced per role by the given ones.

    A label given explicitly for one price role is taken from all other price roles; two price roles that claim one
    label are a mistake of the configuration.
    """
    given = aliases or {}
    plain = lambda label: "".join(label.split()).casefold()
    claims = sorted({(plain(label), role) for role in PRICE_ROLES for label in given.get(role, [])})
    owner = dict(claims)
    if len(owner) < len(claims):
        raise ValueError("Two price roles claim one label; use a coordinate mapping")
    rows = sorted({(plain(label), role) for role, labels in {**HEADER_ALIASES, **given}.items() for label in labels
                   if role not in PRICE_ROLES or owner.get(plain(label), role) == role})
    return spark.createDataFrame(rows, "label string, role string")


def detect_headers(cells: DataFrame, aliases: DataFrame, rows: int = HEADER_ROWS) -> DataFrame:
    """(doc, sheet, header_row, verdict): ok, ambiguous, duplicate_labels, several_columns or skipped."""
    top = cells.filter((F.col("row") <= rows) & F.col("value").isNotNull()).withColumn("label", norm_header("value"))
    roles = top.join(F.broadcast(aliases), "label", "left")  # the alias table has fixed size
    # Counted per role first: any number of cells per row reduce before rows meet.
    per_role = roles.groupBy(*SHEET, "row", "role").agg(F.count_distinct("col").alias("n"))
    heads = per_role.groupBy(*SHEET, "row").agg(
        F.bool_or(F.col("role").eqNullSafe("name")).alias("has_name"),
        F.bool_or(F.coalesce((F.col("n") > 1) & (F.col("role") != "features"), F.lit(False))).alias("several"))
    labels = top.groupBy(*SHEET, "row").agg((F.count_distinct("label") < F.count_distinct("col")).alias("repeated"))
    found = (heads.filter("has_name").join(labels, [*SHEET, "row"])
             .groupBy(*SHEET).agg(F.count("*").alias("n"), F.min("row").alias("header_row"),
                                  F.bool_or("several").alias("several"), F.bool_or("repeated").alias("repeated")))
    verdict = (F.when(F.col("n").isNull(), "skipped").when(F.col("n") > 1, "ambiguous").when(F.col("repeated"), "duplicate_labels")
               .when(F.col("several"), "several_columns").otherwise("ok"))
    return (cells.select(*SHEET).distinct().join(found, SHEET, "left")
            .select(*SHEET, F.when(F.col("n") == 1, F.col("header_row")).alias("header_row"), verdict.alias("verdict")))


def map_columns(cells: DataFrame, headers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc, sheet, col, label, role): role of every header cell; an unmapped label ending in 价 or 价格 stays a price of
    its own name; other labels have no role."""
    head = (cells.hint("merge").join(headers.filter("verdict = 'ok'").select(*SHEET, F.col("header_row").alias("row")), [*SHEET, "row"])
            .filter(F.col("value").isNotNull())
            .select(*SHEET, "col", F.trim("value").alias("header"), norm_header("value").alias("label")))
    mapped = head.join(F.broadcast(aliases), "label", "left")
    own_price = F.col("header").endswith("价") | F.col("header").endswith("价格")
    return mapped.select(*SHEET, "col", F.col("header").alias("label"),
                         F.when(F.col("role").isNull() & own_price, F.col("header")).otherwise(F.col("role")).alias("role"),
                         (F.col("role").isin(*PRICE_ROLES) | (F.col("role").isNull() & own_price)).alias("is_price"))


def _bands(merges: DataFrame) -> DataFrame:
    return merges.withColumn("band", F.explode(F.sequence((F.col("top") / BAND).cast("int"), (F.col("bottom") / BAND).cast("int"))))


def resolve_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Every cell with ``origin_row``/``origin_col``, and the value of the top-left cell inside a merged rectangle.

    Rectangles are spread over bands of rows, so a cell meets only those near it, not all of its sheet.
    """
    spans = _bands(merges).select(*SHEET, "band", "top", "left", "bottom", "right")
    placed = cells.withColumn("band", (F.col("row") / BAND).cast("int"))
    inside = (F.col("row").between(F.col("top"), F.col("bottom")) & F.col("col").between(F.col("left"), F.col("right")))
    c, m = placed.alias("c"), spans.alias("m")
    same = (F.col("c.doc") == F.col("m.doc")) & (F.col("c.sheet") == F.col("m.sheet")) & (F.col("c.band") == F.col("m.band"))
    located = c.join(m, same & inside, "left").select(
        "c.doc", "c.sheet", "c.row", "c.col", "c.value", "c.dtype",
        F.coalesce("m.top", "c.row").alias("origin_row"), F.coalesce("m.left", "c.col").alias("origin_col"))
    origins = cells.select(*SHEET, F.col("row").alias("origin_row"), F.col("col").alias("origin_col"),
                           F.col("value").alias("_value"), F.col("dtype").alias("_dtype"))
    moved = (F.col("origin_row") != F.col("row")) | (F.col("origin_col") != F.col("col"))
    return (located.join(origins, [*SHEET, "origin_row", "origin_col"], "left")
            .withColumn("value", F.when(moved, F.col("_value")).otherwise(F.col("value")))
            .withColumn("dtype", F.when(moved, F.col("_dtype")).otherwise(F.col("dtype"))).drop("_value", "_dtype"))


def table_records(cells: DataFrame, plans: DataFrame, name_spans: DataFrame | None = None) -> DataFrame:
    """Cells of the declared ranges with the first row of their record (``record``).

    plans(doc, sheet, header_row, first_row, last_row, first_col, last_col). A record is a row, or with
    ``name_spans(doc, sheet, top, bottom)`` the rows of a merged name.
    """
    p = plans.select(*SHEET, "header_row", "first_row", "last_row", "first_col", "last_col")
    rows = (cells.hint("merge").join(p, SHEET).filter(F.col("row").between(F.col("first_row"), F.col("last_row"))
                                        & F.col("col").between(F.col("first_col"), F.col("last_col"))))
    if name_spans is None:
        return rows.withColumn("record", F.col("row"))
    owner = name_spans.select(*SHEET, F.explode(F.sequence("top", "bottom")).alias("row"), F.col("top").alias("_top"))
    return (rows.join(owner, [*SHEET, "row"], "left").withColumn("record", F.coalesce("_top", "row")).drop("_top"))


def carried_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows(doc, sheet, row) with ``record``: the top of the span (doc, sheet, top, bottom) that holds the row, else the row.

    Spans of a sheet don't overlap, so a row can only lie in the last one that begins at or before it. Sheets are read in
    slices of SLICE rows: the last span of each slice is carried to the slices behind it through a table of slice ends, so
    neither a tall span nor a long sheet makes more rows or one long group.
    """
    slot = lambda c: F.floor(F.col(c) / SLICE)
    begin = spans.select(*SHEET, F.col("top").cast("long").alias("row"), F.struct(F.col("top").cast("long").alias("top"), F.col("bottom").cast("long").alias("bottom")).alias("_span"))
    both = (rows.select(*SHEET, F.col("row").cast("long").alias("row")).distinct().withColumns({"_span": F.lit(None).cast("struct<top:bigint,bottom:bigint>"), "_asked": F.lit(True)})
            .unionByName(begin.withColumn("_asked", F.lit(False))).withColumn("_slice", slot("row")))
    upto = Window.partitionBy(*SHEET, "_slice").orderBy("row", "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_near", F.last("_span", ignorenulls=True).over(upto)).filter("_asked")
    ends = begin.groupBy(*SHEET, slot("row").alias("_slice")).agg(F.max("_span").alias("_end"))
    slices = near.select(*SHEET, "_slice").distinct().join(ends, [*SHEET, "_slice"], "full")
    before = Window.partitionBy(*SHEET).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    carried = slices.withColumn("_far", F.last("_end", ignorenulls=True).over(before)).select(*SHEET, "_slice", "_far")
    found = near.join(carried, [*SHEET, "_slice"], "left").withColumn("_span", F.coalesce("_near", "_far"))
    return found.select(*SHEET, "row", F.when(F.col("_span.bottom") >= F.col("row"), F.col("_span.top")).otherwise(F.col("row")).alias("record"))


def planned_records(cells: DataFrame, plans: DataFrame, merges: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, problems) of tables with all their options.

    plans(doc, sheet, first_row, last_row, first_col, last_col, name_col, group_by_name, extend_rows, exclude_rows array<int>,
    skip_repeated_headers, expected_last_row); merges(doc, sheet, top, left, bottom, right); expected(doc, sheet, col, value)
    are the header cells. A sheet is refused whole when its extent isn't the expected one (unless rows are extended) or when
    its range cuts a merged name. A record whose first row is excluded, or repeats all expected header cells, is none.
    """
    known = extended(plans.filter("extend_rows"), cells).unionByName(plans.filter("NOT extend_rows"))
    moved = check_extent(cells, plans.filter("NOT extend_rows").select(*SHEET, "expected_last_row")).select(*SHEET, F.lit("extent").alias("problem"))
    names = merges.join(known.filter("group_by_name").select(*SHEET, "first_row", "last_row", "name_col"), SHEET).filter(
        F.col("name_col").between(F.col("left"), F.col("right")))
    cut = cut_spans(known, names.select(*SHEET, "top", "bottom")).select(*SHEET, F.lit("cut").alias("problem"))
    problems = moved.unionByName(cut).distinct()
    sound = known.join(problems.select(*SHEET).distinct(), SHEET, "left_anti")
    ranges = sound.select(*SHEET, "first_row", "last_row", "first_col", "last_col")
    body = cells.join(ranges, SHEET).filter(F.col("row").between(F.col("first_row"), F.col("last_row")) & F.col("col").between(F.col("first_col"), F.col("last_col")))
    body = body.drop("first_row", "last_row", "first_col", "last_col").withColumn("row", F.col("row").cast("long"))
    spans = names.select(*SHEET, "top", "bottom").join(sound.select(*SHEET), SHEET, "left_semi")
    owned = body.join(carried_spans(body, spans), [*SHEET, "row"])
    wanted = expected.join(sound.filter("skip_repeated_headers").select(*SHEET), SHEET, "left_semi")
    matched = (body.select(*SHEET, "row", "col", "value").join(wanted.select(*SHEET, "col", F.col("value").alias("_v")), [*SHEET, "col"])
               .filter(F.col("value") == F.col("_v")).groupBy(*SHEET, "row").agg(F.count("*").alias("_same")))
    repeated = matched.join(wanted.groupBy(*SHEET).agg(F.count("*").alias("_all")), SHEET).filter("_same = _all").select(*SHEET, F.col("row").alias("record"))
    excluded = sound.select(*SHEET, F.explode("exclude_rows").alias("record"))
    return owned.join(repeated.unionByName(excluded.withColumn("record", F.col("record").cast("long"))), [*SHEET, "record"], "left_anti"), problems


def cut_spans(plans: DataFrame, spans: DataFrame) -> DataFrame:
    """Merged names that reach over the end of their declared range: the mapping is wrong there."""
    both = spans.join(plans, SHEET)
    return both.filter(F.col("top").between(F.col("first_row"), F.col("last_row")) & (F.col("bottom") > F.col("last_row"))
                       | (F.col("top") < F.col("first_row")) & (F.col("bottom") >= F.col("first_row"))).select(*SHEET, "top", "bottom")


def extended(plans: DataFrame, cells: DataFrame) -> DataFrame:
    """``extend_rows``: the range grows to the last row with a value in its columns."""
    used = (cells.filter(~blank("value")).join(plans.select(*SHEET, "first_col", "last_col"), SHEET)
            .filter(F.col("col").between(F.col("first_col"), F.col("last_col"))).groupBy(*SHEET).agg(F.max("row").alias("_last")))
    return plans.join(used, SHEET, "left").withColumn("last_row", F.greatest("last_row", F.coalesce("_last", "last_row"))).drop("_last")


def drop_repeated_headers(records: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows in which every expected header cell stands again. expected(doc, sheet, col, value)."""
    wanted = expected.groupBy(*SHEET).agg(F.count("*").alias("_wanted"))
    same = (records.join(expected.select(*SHEET, "col", F.col("value").alias("_v")), [*SHEET, "col"])
            .filter(F.col("value") == F.col("_v")).groupBy(*SHEET, "row").agg(F.count("*").alias("_same")))
    repeated = same.join(wanted, SHEET).filter("_same = _wanted").select(*SHEET, "row")
    return records.join(repeated, [*SHEET, "row"], "left_anti")


def block_records(cells: DataFrame, plans: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """Cells of repeated cards: block place and place within the block; blocks without any value are dropped.

    plans(doc, sheet, top, left, bottom, right, height, width); ranges that their blocks don't divide give nothing, see
    ``uneven_blocks``. With ``mapped(doc, sheet, rel_row, rel_col)`` only these cells of a block say whether it is blank.
    """
    even = plans.join(uneven_blocks(plans).select(*SHEET), SHEET, "left_anti")
    rows = cells.join(even, SHEET).filter(F.col("row").between(F.col("top"), F.col("bottom"))
                                          & F.col("col").between(F.col("left"), F.col("right")))
    down, across = F.col("row") - F.col("top"), F.col("col") - F.col("left")
    placed = rows.select(*SHEET, (down / F.col("height")).cast("int").alias("block_row"), (across / F.col("width")).cast("int").alias("block_col"),
                         (down % F.col("height") + 1).alias("rel_row"), (across % F.col("width") + 1).alias("rel_col"),
                         "row", "col", "value", "dtype")
    block = [*SHEET, "block_row", "block_col"]
    filled = placed.filter(~blank("value"))
    if mapped is not None:
        filled = filled.join(mapped.select(*SHEET, "rel_row", "rel_col"), [*SHEET, "rel_row", "rel_col"], "left_semi")
    return placed.join(filled.select(*block).distinct(), block, "left_semi")


def uneven_blocks(plans: DataFrame) -> DataFrame:
    """Plans whose range is not a whole number of blocks."""
    whole = (F.col("height") > 0) & (F.col("width") > 0)
    even = ((F.col("bottom") - F.col("top") + 1) % F.when(whole, F.col("height")) == 0) & ((F.col("right") - F.col("left") + 1) % F.when(whole, F.col("width")) == 0)
    return plans.filter(~F.coalesce(even, F.lit(False)))


def check_blocks(blocks: DataFrame, expected: DataFrame) -> DataFrame:
    """expected(doc, sheet, rel_row, rel_col, value): labels that a block with values doesn't have where they should be."""
    places = blocks.select(*SHEET, "block_row", "block_col").distinct().join(expected, SHEET)
    now = blocks.select(*SHEET, "block_row", "block_col", "rel_row", "rel_col", F.col("value").alias("found"))
    return places.join(now, [*SHEET, "block_row", "block_col", "rel_row", "rel_col"], "left").filter(~F.col("found").eqNullSafe(F.col("value")))


def check_expectations(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """expected(doc, sheet, row, col, value): cells that no longer hold what the mapping was made for."""
    now = cells.select(*SHEET, "row", "col", F.col("value").alias("found"))
    return expected.join(now, [*SHEET, "row", "col"], "left").filter(~F.col("found").eqNullSafe(F.col("value")))


def check_extent(cells: DataFrame, plans: DataFrame) -> DataFrame:
    """plans(doc, sheet, expected_last_row): sheets that ended elsewhere when they were mapped."""
    return (plans.join(sheet_extent(cells).select(*SHEET, "last_row"), SHEET, "left")
            .filter(~F.coalesce("last_row", F.lit(0)).eqNullSafe(F.col("expected_last_row"))))


def _cover(low: str, high: str, levels: str) -> str:
    """SQL for the nodes (k, i), each the numbers from i * 2^k on below (i + 1) * 2^k, that make up ``low`` to ``high``
    exactly, without overlap: at most two of a size, so their number grows with the logarithm of the length alone."""
    first = lambda k: f"(({low}) + shiftleft(1L, {k}) - 1) div shiftleft(1L, {k})"
    end = lambda k: f"(({high}) + 1) div shiftleft(1L, {k})"
    inside = lambda k, i: f"({i} >= {first(k)} AND {i} < {end(k)})"
    nodes = f"filter(array_distinct(array({first('k')}, {end('k')} - 1)), i -> {inside('k', 'i')} AND NOT {inside('(k + 1)', '(i div 2)')})"
    return f"flatten(transform(sequence(0, {levels}), k -> transform({nodes}, i -> struct(k, i))))"


def _path(point: str, levels: str) -> str:
    """SQL for all nodes that hold a number, one of each size."""
    return f"transform(sequence(0, {levels}), k -> struct(k, ({point}) div shiftleft(1L, k) AS i))"


def check_overlaps(regions: DataFrame) -> DataFrame:
    """regions(doc, sheet, region, top, left, bottom, right): every pair of regions that share a cell, once: (region, other).

    Two regions meet where the later one begins: its first row lies in the other's rows, and the first column of either in
    the columns of the other. Row and column ranges are split into nodes of doubling size, and a number lies in exactly one
    node of each size, so a pair meets at one common node of rows and columns and nowhere else. What is made beside the pairs
    themselves grows with the logarithm of the regions' height and width, not with these. The nodes are joined by a shuffle:
    Catalyst takes a region's nodes to be as few as the regions and would send them all through the driver.
    """
    spread = regions.groupBy(*SHEET).agg(
        F.floor(F.log2(F.max(F.col("bottom") - F.col("top") + 1))).cast("int").alias("_rows"),
        F.floor(F.log2(F.max(F.col("right") - F.col("left") + 1))).cast("int").alias("_cols"))
    own = regions.select(*SHEET, "region", *[F.col(c).cast("long").alias(c) for c in ("top", "left", "bottom", "right")]).join(spread, SHEET)

    def at(rows: str, cols: str) -> DataFrame:
        places = own.withColumn("_r", F.explode(F.expr(rows))).withColumn("_c", F.explode(F.expr(cols)))
        return places.select(*SHEET, "_r", "_c", "region", "top", "left")

    covered, begun = _cover("top", "bottom", "_rows"), _path("top", "_rows")
    # The later region (by top, then name) begins within the columns of the earlier one, or that one within its own.
    earlier_first = F.struct("x.top", "x.region") < F.struct("y.top", "y.region")
    node = [*SHEET, "_r", "_c"]
    pairs = []
    for x, y, order in ((at(covered, _cover("left", "right", "_cols")), at(begun, _path("left", "_cols")), F.col("x.left") <= F.col("y.left")),
                        (at(covered, _path("left", "_cols")), at(begun, _cover("left", "right", "_cols")), F.col("x.left") > F.col("y.left"))):
        x, y = x.alias("x"), y.alias("y")
        same = F.lit(True)
        for c in node:
            same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
        pairs.append(x.hint("merge").join(y.hint("merge"), same & earlier_first & order).select(
            *[F.col(f"x.{c}").alias(c) for c in SHEET], F.least("x.region", "y.region").alias("region"), F.greatest("x.region", "y.region").alias("other")))
    return pairs[0].unionByName(pairs[1])


def unpivot_prices(records: DataFrame, columns: DataFrame) -> DataFrame:
    """Long prices of record cells: role, source label, value as written. columns as from ``map_columns``.

    Several cells of a record under one label must agree: where they don't, there is no value but a ``conflict``.
    """
    prices = columns.filter("is_price").select(*SHEET, "col", "label", F.col("role").alias("field"))
    return (records.hint("merge").join(prices, [*SHEET, "col"])
            .groupBy(*SHEET, "record", "field", "label").agg(
                F.when(F.min("value") == F.max("value"), F.min("value")).alias("value"),
                F.coalesce(F.min("value") < F.max("value"), F.lit(False)).alias("conflict"), F.bool_or(F.col("dtype") == "e").alias("is_error")))


def scalar_conflicts(values: DataFrame, key: list[str], value="value") -> DataFrame:
    """Keys for which more than one value is given; the smallest and largest show the conflict."""
    return (values.filter(~blank(value)).groupBy(*key).agg(F.min(value).alias("low"), F.max(value).alias("high"))
            .filter(F.col("low") < F.col("high")))


def cell_issues(records: DataFrame) -> DataFrame:
    """(doc, sheet, record, issue): error cells and formulas without a value, each once."""
    name = cell_name(F.col("row"), F.col("col"))
    issue = (F.when(F.col("dtype") == "e", F.concat(F.lit("单元格错误:"), name))
             .when((F.col("dtype") == "f") & F.col("value").isNull(), F.concat(F.lit("公式无缓存值:"), name)))
    return records.select(*SHEET, "record", issue.alias("issue")).filter("issue IS NOT NULL").distinct()


def flag_price_errors(prices: DataFrame) -> DataFrame:
    return prices.withColumn("error", F.when(F.col("is_error"), F.lit("spreadsheet_error"))
                             .when(F.col("conflict"), F.lit("conflicting_values"))).drop("is_error", "conflict")


def features(records: DataFrame, columns: DataFrame) -> DataFrame:
    """One text per record from its detail columns, in column order: the values of a column once each, under the label,
    without it where the record's table has a single detail column."""
    details = columns.filter("role = 'features'").select(*SHEET, "col", "label")
    alone = details.groupBy(*SHEET).agg(F.count("*").alias("_details"))
    cells = (records.filter(~blank("value")).hint("merge").join(details, [*SHEET, "col"])
             .groupBy(*SHEET, "record", "col", "label", "value").agg(F.min("row").alias("row")))
    column = cells.groupBy(*SHEET, "record", "col", "label").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("row", "value"))), lambda c: c["value"]), "\n").alias("text"))
    text = F.when(F.col("_details") == 1, F.col("text")).otherwise(F.concat("label", F.lit("：\n"), "text"))
    return (column.join(alone, SHEET).withColumn("text", text).groupBy(*SHEET, "record")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]), "\n").alias("features")))


def raw_fields(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Every source column of a record under its label; a label that comes again gets its cell in brackets.

    labels(doc, sheet, col, label). A record is one table row wide, so its map is bounded by the sheet's columns.
    """
    first = labels.groupBy(*SHEET, "label").agg(F.min("col").alias("_first"))
    named = labels.join(first, [*SHEET, "label"]).select(*SHEET, "col", "label", (F.col("col") != F.col("_first")).alias("_again"))
    cells = records.filter(F.col("value").isNotNull()).hint("merge").join(named, [*SHEET, "col"])
    per_column = cells.groupBy(*SHEET, "record", "col", "label", "_again").agg(
        F.min("row").alias("_row"), F.array_join(F.array_distinct(F.transform(
            F.sort_array(F.collect_list(F.struct("row", "value"))), lambda c: c["value"])), "\n").alias("value"))
    key = F.when(F.col("_again"), F.concat("label", F.lit(" ["), cell_name(F.col("_row"), F.col("col")), F.lit("]"))).otherwise(F.col("label"))
    return per_column.groupBy(*SHEET, "record").agg(F.map_from_entries(
        F.sort_array(F.collect_list(F.struct(key.alias("k"), F.col("value").alias("v"))))).alias("raw_fields"))


def unmapped_columns(records: DataFrame, columns: DataFrame) -> DataFrame:
    """Labels with values that no role uses, per sheet."""
    free = columns.filter("role IS NULL").select(*SHEET, "col", "label")
    return records.filter(F.col("value").isNotNull()).hint("merge").join(free, [*SHEET, "col"]).select(*SHEET, "label").distinct()


def assign_ids(records: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Adds ``occurrence`` and ``id``. Identity is the model, else the name, with the variant; equal identities are
    counted in source order, so reordering different rows keeps every id. One identity may repeat without bound."""
    base = F.when(~blank("model"), F.col("model")).otherwise(F.col("name"))
    identity = F.when(~blank("variant"), F.to_json(F.array(base, F.col("variant")))).otherwise(base)
    counted = numbered(records.withColumn("identity", identity), [source, "sheet", "identity"], order, "_n")
    counted = counted.withColumn("occurrence", F.col("_n") - 1).drop("_n")
    return counted.withColumn("id", product_id(F.col(source), F.col("sheet"), F.col("identity"), F.col("occurrence")))


def product_id(source: Column, sheet: Column, identity: Column, occurrence: Column) -> Column:
    """The id of a product, from where it stands. As a JSON array: joined by a plain sign, the parts of different products
    could spell the same key."""
    key = F.to_json(F.array(F.lower(source.cast("string")), sheet.cast("string"), identity, occurrence.cast("string")))
    return F.concat(F.lit("p_"), F.substring(F.sha2(key, 256), 1, 16))


def assets(refs: DataFrame) -> DataFrame:
    """refs(doc, sheet, record, role, row, col, sha256): per record and role the main image, the number of distinct ones and
    an issue when there is more than one."""
    once = refs.groupBy("doc", "sheet", "record", "role", "sha256").agg(F.min(F.struct("row", "col")).alias("at"))
    found = once.groupBy("doc", "sheet", "record", "role").agg(F.min_by("sha256", "at").alias("main"), F.count("*").alias("images"))
    note = F.concat(F.lit("同记录多图:"), F.col("role"), F.lit(":"), F.col("images"), F.lit(";首张用于主图,其余保留"))
    return found.withColumn("issue", F.when(F.col("images") > 1, note))


def decorate(obs: DataFrame, defaults: list[dict], rules: list[dict], file="source_file", name_norm="name_norm") -> DataFrame:
    """Brand and supplier from the first matching file default where the source has none; category from the source,
    else from the first rule with a word in the name, else 未分类. Configuration is a short list: it becomes expressions."""
    columns = {}
    for field in ("brand", "supplier"):
        own = F.nullif(F.coalesce(F.col(field).cast("string"), F.lit("")), F.lit(""))
        given = F.coalesce(*[F.when(glob_match(file, d["match"]), F.lit(d[field])) for d in defaults if d.get(field)],
                           F.lit(None).cast("string"))
        columns[field] = F.coalesce(own, given, F.lit(""))
        columns[f"{field}_origin"] = F.when(own.isNull() & given.isNotNull(), "config").otherwise("source")
    own = F.nullif(F.coalesce(F.col("category").cast("string"), F.lit("")), F.lit(""))

    def hit(rule):
        found = F.lit(False)
        for word in rule["keywords"]:
            found = found | F.contains(as_column(name_norm), F.lit(normalize_literal(word)))
        return found

    ruled = F.coalesce(*[F.when(hit(r), F.lit(r["category"])) for r in rules], F.lit(None).cast("string"))
    columns["category"] = F.coalesce(own, ruled, F.lit("未分类"))
    columns["category_origin"] = F.when(own.isNotNull(), "source").when(ruled.isNotNull(), "rule").otherwise("missing")
    return obs.withColumns(columns)


def schema_for_source(files: DataFrame, rules: list[dict], keys: list[str], name="name") -> DataFrame:
    """Per file the value of each configuration key from the last rule whose pattern matches."""
    chosen = {}
    for key in keys:
        given = [F.when(glob_match(name, r["match"]), F.lit(r[key])) for r in reversed(rules) if key in r]
        chosen[key] = F.coalesce(*given, F.lit(None).cast("string"))
    return files.withColumns(chosen)


def sheet_extent(cells: DataFrame) -> DataFrame:
    """Per sheet: last row with a value, and the range that values span."""
    return cells.filter(~blank("value")).groupBy(*SHEET).agg(
        F.max("row").alias("last_row"), F.min("row").alias("first_row"), F.min("col").alias("first_col"), F.max("col").alias("last_col"))


def cell_window(cells: DataFrame, sheet: str, top: int, left: int, bottom: int, right: int) -> DataFrame:
    return cells.filter((F.col("sheet") == sheet) & F.col("row").between(top, bottom) & F.col("col").between(left, right))


def merges_touching(merges: DataFrame, sheet: str, top: int, left: int, bottom: int, right: int) -> DataFrame:
    return merges.filter((F.col("sheet") == sheet) & (F.col("top") <= bottom) & (F.col("bottom") >= top)
                         & (F.col("left") <= right) & (F.col("right") >= left))
