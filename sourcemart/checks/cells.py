"""Table recognition over grids made from the part table: 25 rows per sheet, headers in row 1 or 2."""

from pyspark.sql import functions as F

from sourcemart.checks.base import check, sql
from sourcemart.checks.joins import GRID, grid, regions
from sourcemart.functions.text import normalize
from sourcemart.sources import cells

# Column labels of a sheet; sheets of every third book name their second price 渠道价, which is no known label.
LABELS = [(1, "产品名称"), (2, "货 号"), (3, "零售价"), (4, "供货价"), (5, "卖点"), (6, "参数"), (7, "备注")]


def book_number():
    return F.substring_index("doc", "-", -1).cast("int")


def sheet_cells(t):
    """Header cells and value cells. Books 4, 14, 24 .. have a second header row, books 5, 15, .. no name column,
    books 6, 16, .. a repeated label."""
    g = grid(t)
    sheets = g.select("doc", "sheet").distinct().withColumn("n", book_number())
    head = sheets.select("doc", "sheet", "n", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(l).alias("value")) for c, l in LABELS])).alias("h"))
    label = (F.when((F.col("n") % 10 == 5) & (F.col("h.col") == 1), "代码").when((F.col("n") % 10 == 6) & (F.col("h.col") == 7), "零售价")
             .when((F.col("n") % 3 == 0) & (F.col("h.col") == 4), "渠道价").otherwise(F.col("h.value")))
    heads = head.select("doc", "sheet", F.lit(1).alias("row"), F.col("h.col").alias("col"), label.alias("value"), F.lit("s").alias("dtype"))
    second = head.filter("n % 10 = 4 AND h.col = 1").select("doc", "sheet", F.lit(2).alias("row"), F.lit(8).alias("col"), F.lit("名称").alias("value"), F.lit("s").alias("dtype"))
    wrong = F.col("p_size") % 10 == 0
    values = [("s", F.col("p_name")), ("s", F.concat(F.lit("M-"), "p_size")),
              (F.when(wrong, "e").otherwise("n"), F.when(wrong, "#REF!").otherwise(F.format_string("%.2f", "p_retailprice"))),
              (F.when(F.col("p_size") % 10 == 1, "f").otherwise("n"), F.when(F.col("p_size") % 10 != 1, F.format_string("%.1f", "p_retailprice"))),
              ("s", F.when(F.col("p_size") % 2 == 0, F.col("p_type"))), ("s", F.col("p_brand")), ("s", F.when(F.col("p_size") % 7 == 0, F.lit("看样")))]
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), v.alias("value"), (F.lit(d) if isinstance(d, str) else d).alias("dtype"))
                               for i, (d, v) in enumerate(values, 1)]))
    body = g.select("doc", "sheet", "row", cell.alias("c")).select("doc", "sheet", "row", "c.*").filter("value IS NOT NULL OR dtype = 'f'")
    return heads.unionByName(second).unionByName(body)


def recognized(t):
    made = sheet_cells(t)
    aliases = cells.alias_table(t.spark)
    headers = cells.detect_headers(made, aliases)
    return made, headers, cells.map_columns(made, headers, aliases)


def records(t):
    """Cells of the recognized tables below their header, with the record they belong to."""
    made, headers, columns = recognized(t)
    extent = cells.sheet_extent(made).select("doc", "sheet", "last_row")
    plans = headers.filter("verdict = 'ok'").join(extent, ["doc", "sheet"]).select(
        "doc", "sheet", "header_row", (F.col("header_row") + 1).alias("first_row"), "last_row", F.lit(1).alias("first_col"), F.lit(7).alias("last_col"))
    return cells.table_records(made, plans), columns


SHEETS = GRID + """, sheets AS (SELECT DISTINCT doc, sheet, cast(split_part(doc, '-', 2) AS INT) AS n FROM grid),
    good AS (SELECT * FROM sheets WHERE n % 10 NOT IN (4, 5, 6)),
    rec AS (SELECT g.*, cast("row" AS BIGINT) AS record FROM grid g JOIN good USING (doc, sheet))"""


@check("detect_header", f"""WITH {SHEETS} SELECT doc, sheet, cast(CASE WHEN n % 10 NOT IN (4, 5) THEN 1 END AS BIGINT) AS header_row,
    CASE n % 10 WHEN 4 THEN 'ambiguous' WHEN 5 THEN 'skipped' WHEN 6 THEN 'duplicate_labels' ELSE 'ok' END AS verdict FROM sheets""")
def _(t):
    made = sheet_cells(t)
    return cells.detect_headers(made, cells.alias_table(t.spark)).withColumn("header_row", F.col("header_row").cast("long"))


@check("map_roles", f"""WITH {SHEETS} SELECT doc, sheet, cast(c AS BIGINT) AS col, CASE c WHEN 1 THEN 'name' WHEN 2 THEN 'model' WHEN 3 THEN 'retail_price'
    WHEN 4 THEN CASE WHEN n % 3 = 0 THEN '渠道价' ELSE 'supply_price' END WHEN 5 THEN 'features' WHEN 6 THEN 'features' END AS role FROM good, range(1, 8) AS r(c)""")
def _(t):
    return recognized(t)[2].select("doc", "sheet", F.col("col").cast("long").alias("col"), "role")


@check("extra_price_columns", f"WITH {SHEETS} SELECT doc, sheet, '渠道价' AS label FROM good WHERE n % 3 = 0")
def _(t):
    return recognized(t)[2].filter("is_price AND role = label").select("doc", "sheet", "label")


@check("merged_fill", f"""WITH {GRID}, merges AS (SELECT doc, sheet, "row" AS top, "row" + 3 AS bottom, p_brand FROM grid WHERE p_partkey % 6 = 2)
    SELECT g.doc, g.sheet, cast(g."row" AS BIGINT) AS "row", c AS col, CASE WHEN c = 2 THEN g.p_type ELSE coalesce(m.p_brand, g.p_brand) END AS value
    FROM grid g CROSS JOIN (SELECT unnest([cast(1 AS BIGINT), 2]) AS c) LEFT JOIN merges m ON m.doc = g.doc AND m.sheet = g.sheet AND g."row" BETWEEN m.top AND m.bottom""")
def _(t):
    g = grid(t)
    one = F.explode(F.array(F.struct(F.lit(1).alias("col"), F.col("p_brand").alias("value")), F.struct(F.lit(2).alias("col"), F.col("p_type").alias("value"))))
    made = g.select("doc", "sheet", "row", one.alias("c")).select("doc", "sheet", "row", "c.*", F.lit("s").alias("dtype"))
    merges = g.filter("p_partkey % 6 = 2").select("doc", "sheet", F.col("row").alias("top"), F.lit(1).alias("left"), (F.col("row") + 3).alias("bottom"), F.lit(1).alias("right"))
    return cells.resolve_merges(made, merges).select("doc", "sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")


@check("table_records", f"""WITH {SHEETS} SELECT doc, sheet, record, CASE WHEN p_partkey % 2 = 1 AND record > 2 AND p_partkey % 50 <> 25 THEN record - 1 ELSE record END AS owner, p_name AS value FROM rec""")
def _(t):
    rows, _ = records(t)
    g = grid(t)
    pairs = g.filter("p_partkey % 2 = 1 AND row > 2 AND p_partkey % 50 <> 25").select("doc", "sheet", (F.col("row") - 1).alias("top"), F.col("row").alias("bottom"))
    owned = cells.table_records(rows.drop("record", "header_row", "first_row", "last_row", "first_col", "last_col"),
                                rows.select("doc", "sheet", "header_row", "first_row", "last_row", "first_col", "last_col").distinct(), pairs)
    return owned.filter("col = 1").select("doc", "sheet", F.col("row").cast("long").alias("record"), F.col("record").cast("long").alias("owner"), "value")


@check("block_records", f"""WITH {GRID}, placed AS (SELECT doc, sheet, "row" - 2 AS down, p_partkey % 4 AS across, p_name, p_size FROM grid)
    SELECT doc, sheet, cast(down // 5 AS BIGINT) AS block_row, cast(across // 2 AS BIGINT) AS block_col, cast(down % 5 + 1 AS BIGINT) AS rel_row, cast(across % 2 + 1 AS BIGINT) AS rel_col,
    CASE WHEN p_size > 10 THEN p_name ELSE ' ' END AS value FROM placed p
    WHERE EXISTS (SELECT 1 FROM placed q WHERE q.doc = p.doc AND q.sheet = p.sheet AND q.down // 5 = p.down // 5 AND q.across // 2 = p.across // 2 AND q.p_size > 10)""")
def _(t):
    g = grid(t)
    made = g.select("doc", "sheet", "row", (F.col("p_partkey") % 4 + 1).cast("int").alias("col"), F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(" ").alias("value"), F.lit("s").alias("dtype"))
    plans = g.select("doc", "sheet").distinct().select("*", F.lit(2).alias("top"), F.lit(1).alias("left"), F.lit(26).alias("bottom"), F.lit(4).alias("right"), F.lit(5).alias("height"), F.lit(2).alias("width"))
    found = cells.block_records(made, plans)
    return found.select("doc", "sheet", *[F.col(c).cast("long").alias(c) for c in ("block_row", "block_col", "rel_row", "rel_col")], "value")


@check("expect_check", f"""WITH {SHEETS} SELECT doc, sheet, '供货价' AS expected, '渠道价' AS found FROM sheets WHERE n % 3 = 0 UNION ALL SELECT doc, sheet, '产品名称', '代码' FROM sheets WHERE n % 10 = 5""")
def _(t):
    made = sheet_cells(t)
    wanted = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(l).alias("value")) for c, l in LABELS if c in (1, 4)]))
    expected = made.select("doc", "sheet").distinct().select("doc", "sheet", F.lit(1).alias("row"), wanted.alias("w")).select("doc", "sheet", "row", "w.*")
    return cells.check_expectations(made, expected).select("doc", "sheet", F.col("value").alias("expected"), "found")


@check("overlap_check", f"""WITH {GRID}, r AS (SELECT doc, sheet, p_partkey AS region, "row" AS top, "row" + p_size % 3 AS bottom, p_size % 7 * 4 AS lft, p_size % 7 * 4 + 5 AS rgt FROM grid)
    SELECT doc, sheet, count(*) AS regions, sum(CASE WHEN EXISTS (SELECT 1 FROM r b WHERE a.doc = b.doc AND a.sheet = b.sheet AND a.region <> b.region
    AND a.top <= b.bottom AND a.bottom >= b.top AND a.lft <= b.rgt AND a.rgt >= b.lft) THEN 1 ELSE 0 END) > 0 AS overlap FROM r a GROUP BY 1, 2""")
def _(t):
    r = regions(t)
    bad = cells.check_overlaps(r).select("doc", "sheet").distinct().withColumn("overlap", F.lit(True))
    return (r.groupBy("doc", "sheet").agg(F.count("*").alias("regions")).join(bad, ["doc", "sheet"], "left")
            .withColumn("overlap", F.coalesce("overlap", F.lit(False))))


PRICES = """prices AS (SELECT doc, sheet, record, 'retail_price' AS field, '零售价' AS label, CASE WHEN p_size % 10 = 0 THEN '#REF!' ELSE printf('%.2f', p_retailprice) END AS value, p_size % 10 = 0 AS bad FROM rec
    UNION ALL SELECT doc, sheet, record, CASE WHEN n % 3 = 0 THEN '渠道价' ELSE 'supply_price' END, CASE WHEN n % 3 = 0 THEN '渠道价' ELSE '供货价' END,
      CASE WHEN p_size % 10 <> 1 THEN printf('%.1f', p_retailprice) END, false FROM rec JOIN good USING (doc, sheet))"""


@check("unpivot_prices", f"WITH {SHEETS}, {PRICES} SELECT doc, sheet, record, field, label, value FROM prices")
def _(t):
    rows, columns = records(t)
    return cells.unpivot_prices(rows, columns).select("doc", "sheet", F.col("record").cast("long").alias("record"), "field", "label", "value")


@check("price_error_flag", f"WITH {SHEETS}, {PRICES} SELECT doc, sheet, record, field, CASE WHEN bad THEN 'spreadsheet_error' END AS error FROM prices")
def _(t):
    rows, columns = records(t)
    flagged = cells.flag_price_errors(cells.unpivot_prices(rows, columns))
    return flagged.select("doc", "sheet", F.col("record").cast("long").alias("record"), "field", "error")


@check("cell_issues", f"""WITH {SHEETS} SELECT doc, sheet, record, '单元格错误:C' || "row" AS issue FROM rec WHERE p_size % 10 = 0 UNION ALL SELECT doc, sheet, record, '公式无缓存值:D' || "row" FROM rec WHERE p_size % 10 = 1""")
def _(t):
    return cells.cell_issues(records(t)[0]).select("doc", "sheet", F.col("record").cast("long").alias("record"), "issue")


@check("scalar_conflict", sql("SELECT doc_id, category, min(name) AS low, max(name) AS high FROM obs GROUP BY 1, 2 HAVING min(name) < max(name)", "obs"))
def _(t):
    return cells.scalar_conflicts(t.observations(), ["doc_id", "category"], "name")


@check("concat_details", f"""WITH {SHEETS} SELECT doc, sheet, record, CASE WHEN p_size % 2 = 0 THEN '卖点：' || chr(10) || p_type || chr(10) ELSE '' END || '参数：' || chr(10) || p_brand AS features FROM rec""")
def _(t):
    rows, columns = records(t)
    return cells.features(rows, columns).select("doc", "sheet", F.col("record").cast("long").alias("record"), "features")


@check("raw_fields_map", f"""WITH {SHEETS} SELECT doc, sheet, record, '产品名称=' || p_name || ';价格=' || CASE WHEN p_size % 10 = 0 THEN '#REF!' ELSE printf('%.2f', p_retailprice) END
    || CASE WHEN p_size % 10 <> 1 THEN ';价格 [D' || "row" || ']=' || printf('%.1f', p_retailprice) ELSE '' END AS raw FROM rec""")
def _(t):
    rows, columns = records(t)
    labels = columns.filter("col IN (1, 3, 4)").withColumn("label", F.when(F.col("col") == 1, F.col("label")).otherwise("价格"))
    shown = F.transform(F.sort_array(F.map_entries("raw_fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return cells.raw_fields(rows, labels).select("doc", "sheet", F.col("record").cast("long").alias("record"), F.array_join(shown, ";").alias("raw"))


@check("unmapped_columns", f"WITH {SHEETS} SELECT DISTINCT doc, sheet, '备注' AS label FROM rec WHERE p_size % 7 = 0")
def _(t):
    return cells.unmapped_columns(*records(t))


@check("asset_membership", f"""WITH {GRID} SELECT doc, sheet, cast("row" // 4 AS BIGINT) AS record, arg_min(sha256(p_type), "row") AS main, count(DISTINCT p_type) AS images,
    CASE WHEN count(DISTINCT p_type) > 1 THEN '同记录多图:product_image:' || count(DISTINCT p_type) || ';首张用于主图,其余保留' END AS issue FROM grid GROUP BY 1, 2, 3""")
def _(t):
    refs = grid(t).select("doc", "sheet", F.floor(F.col("row") / 4).alias("record"), F.lit("product_image").alias("role"), "row", F.lit(1).alias("col"), F.sha2("p_type", 256).alias("sha256"))
    return cells.assets(refs).select("doc", "sheet", "record", "main", "images", "issue")


@check("decorate", """SELECT p_partkey AS id, CASE WHEN p_size > 10 THEN p_brand WHEN p_partkey % 3 = 0 THEN 'House' WHEN p_partkey % 3 = 1 THEN 'Guest' ELSE '' END AS brand,
    CASE WHEN p_size <= 10 AND p_partkey % 3 < 2 THEN 'config' ELSE 'source' END AS brand_origin,
    CASE WHEN p_size % 2 = 0 THEN p_type WHEN p_name LIKE '%red%' OR p_name LIKE '%blue%' THEN 'colour/warm' WHEN p_name LIKE '%bolt%' THEN 'parts/bolt' ELSE '未分类' END AS category,
    CASE WHEN p_size % 2 = 0 THEN 'source' WHEN p_name LIKE '%red%' OR p_name LIKE '%blue%' OR p_name LIKE '%bolt%' THEN 'rule' ELSE 'missing' END AS category_origin FROM part""")
def _(t):
    raw = t.part.select(
        F.col("p_partkey").alias("id"), "p_name", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand"), F.lit(None).cast("string").alias("supplier"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("category"),
        F.concat(F.get(F.array(F.lit("house"), F.lit("guest"), F.lit("other")), (F.col("p_partkey") % 3).cast("int")), F.lit("-2026.xlsx")).alias("source_file"))
    made = cells.decorate(raw.withColumn("name_norm", normalize("p_name")), [{"match": "house-*.xlsx", "brand": "House"}, {"match": "[gh]*-????.xlsx", "brand": "Guest"}],
                          [{"keywords": ["RED", "blue"], "category": "colour/warm"}, {"keywords": ["Bolt"], "category": "parts/bolt"}])
    return made.select("id", "brand", "brand_origin", "category", "category_origin")


@check("schema_for_source", """SELECT doc_id, CASE WHEN lang = 'fr' THEN 'C' WHEN source LIKE 'src1%' THEN 'B' ELSE 'A' END AS layout, CASE WHEN source LIKE 'src1%' THEN 'yes' END AS detail FROM documents""")
def _(t):
    named = t.documents.select("doc_id", F.concat_ws("-", "source", F.concat("lang", F.lit(".txt"))).alias("name"))
    rules = [{"match": "*", "layout": "A"}, {"match": "src1*-*.txt", "layout": "B", "detail": "yes"}, {"match": "*-fr.txt", "layout": "C"}]
    return cells.schema_for_source(named, rules, ["layout", "detail"]).select("doc_id", "layout", "detail")


@check("sheet_window", f"""WITH {SHEETS} SELECT doc, sheet, cast(max("row") AS BIGINT) AS last_row, cast(1 AS BIGINT) AS first_row, cast(1 AS BIGINT) AS first_col,
    cast(CASE WHEN any_value(n) % 10 = 4 THEN 8 ELSE 7 END AS BIGINT) AS last_col, count(*) FILTER (WHERE "row" BETWEEN 5 AND 9) AS names_in_window FROM grid JOIN sheets USING (doc, sheet) GROUP BY 1, 2""")
def _(t):
    made = sheet_cells(t)
    window = None
    for sheet in ("s0", "s1"):
        part = cells.cell_window(made, sheet, 5, 1, 9, 1)
        window = part if window is None else window.unionByName(part)
    inside = window.groupBy("doc", "sheet").agg(F.count("*").alias("names_in_window"))
    return cells.sheet_extent(made).join(inside, ["doc", "sheet"], "left").select(
        "doc", "sheet", *[F.col(c).cast("long").alias(c) for c in ("last_row", "first_row", "first_col", "last_col")], F.coalesce("names_in_window", F.lit(0)).alias("names_in_window"))


@check("cell_evidence", f"""WITH {GRID} SELECT doc, 'sheet' || (CASE sheet WHEN 's0' THEN 1 ELSE 2 END) || ':' || k.letters || "row" AS ref, sheet || '!' || k.letters || "row" AS locator, p_name AS text FROM grid
    JOIN (SELECT * FROM (VALUES (0, 'B'), (1, 'Z'), (2, 'AA'), (3, 'ZZ'), (4, 'AAA'), (5, 'XFD')) AS v(i, letters)) k ON p_partkey % 6 = k.i""")
def _(t):
    from sourcemart.sources.evidence import cell_evidence
    col = F.get(F.array(*[F.lit(c) for c in (2, 26, 27, 702, 703, 16384)]), (F.col("p_partkey") % 6).cast("int"))
    made = grid(t).select("doc", "sheet", F.when(F.col("sheet") == "s0", 1).otherwise(2).alias("sheet_no"), "row", col.alias("col"), F.col("p_name").alias("value"))
    return cell_evidence(made).select("doc", "ref", "locator", "text")


# Long sheets: every order is a row of the sheet of its priority, at the row of its key. Some rows repeat the header, some
# hold half of it; names span up to 30 rows.
PLANNED = """WITH rows AS (SELECT o_orderstatus AS doc, o_orderpriority AS sheet, cast(o_orderkey AS BIGINT) AS "row", o_custkey % 97 = 0 AS header,
      CASE WHEN o_custkey % 97 = 0 OR o_custkey % 89 = 0 THEN '名称' ELSE 'C' || o_custkey END AS name, CASE WHEN o_custkey % 97 = 0 THEN '价格' ELSE cast(o_custkey AS VARCHAR) END AS price FROM orders),
    extent AS (SELECT doc, sheet, max("row") AS last FROM rows GROUP BY ALL),
    plans AS (SELECT doc, sheet, last AS extent, CASE WHEN doc = 'P' THEN last WHEN sheet = '5-LOW' THEN last - 3 ELSE last END AS last_row, doc <> 'P' AND sheet <> '5-LOW' AS by_name, doc = 'F' AS skip FROM extent),
    spans AS (SELECT doc, sheet, "row" AS top, "row" + try_cast(price AS BIGINT) % 30 AS bottom FROM rows WHERE "row" % 50 = 1 AND price <> '价格'),
    cut AS (SELECT DISTINCT p.doc, p.sheet FROM plans p JOIN spans s ON s.doc = p.doc AND s.sheet = p.sheet WHERE by_name AND ((top BETWEEN 2 AND last_row AND bottom > last_row) OR (top < 2 AND bottom >= 2))),
    owned AS (SELECT r.*, p.skip, coalesce(s.top, r."row") AS record FROM rows r JOIN plans p ON p.doc = r.doc AND p.sheet = r.sheet AND r."row" BETWEEN 2 AND last_row
      LEFT JOIN spans s ON s.doc = r.doc AND s.sheet = r.sheet AND p.by_name AND r."row" BETWEEN s.top AND s.bottom ANTI JOIN cut c ON c.doc = r.doc AND c.sheet = r.sheet WHERE p.sheet <> '5-LOW'),
    repeats AS (SELECT doc, sheet, "row" AS record FROM rows WHERE header AND doc = 'F')
    SELECT doc, sheet, record, count(*) AS rows, max(CASE WHEN "row" = record THEN name END) AS name, NULL AS problem FROM owned o WHERE record NOT IN (33, 34, 97, 161)
      AND (doc, sheet, record) NOT IN (SELECT (doc, sheet, record) FROM repeats) GROUP BY 1, 2, 3
    UNION ALL SELECT doc, sheet, NULL, NULL, NULL, 'cut' FROM cut UNION ALL SELECT doc, sheet, NULL, NULL, NULL, 'extent' FROM plans WHERE sheet = '5-LOW'"""


@check("table_plan", PLANNED)
def _(t):
    o = t.orders.select(F.col("o_orderstatus").alias("doc"), F.col("o_orderpriority").alias("sheet"), F.col("o_orderkey").alias("row"), "o_custkey")
    header = F.col("o_custkey") % 97 == 0
    name = F.when(header | (F.col("o_custkey") % 89 == 0), F.lit("名称")).otherwise(F.concat(F.lit("C"), "o_custkey"))
    price = F.when(header, F.lit("价格")).otherwise(F.col("o_custkey").cast("string"))
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), v.alias("value"), F.lit("s").alias("dtype")) for c, v in ((1, name), (2, price))]))
    made = o.select("doc", "sheet", "row", cell.alias("c")).select("doc", "sheet", "row", "c.*")
    late = F.col("sheet") == "5-LOW"
    plans = o.groupBy("doc", "sheet").agg(F.max("row").alias("last")).select(
        "doc", "sheet", F.lit(2).cast("long").alias("first_row"), (F.col("last") - F.when(late, 3).when(F.col("doc") == "F", 40).otherwise(0)).alias("last_row"),
        F.lit(1).alias("first_col"), F.lit(2).alias("last_col"), F.lit(1).alias("name_col"), ((F.col("doc") != "P") & ~late).alias("group_by_name"),
        ((F.col("doc") == "F") & ~late).alias("extend_rows"), F.array(*map(F.lit, (33, 34, 97, 161))).alias("exclude_rows"),
        (F.col("doc") == "F").alias("skip_repeated_headers"), (F.col("last") - F.when(late, 3).otherwise(0)).alias("expected_last_row"))
    merges = o.filter("row % 50 = 1 AND o_custkey % 97 <> 0").select("doc", "sheet", F.col("row").alias("top"), F.lit(1).alias("left"), (F.col("row") + F.col("o_custkey") % 30).alias("bottom"), F.lit(1).alias("right"))
    expected = o.select("doc", "sheet").distinct().select("doc", "sheet", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(v).alias("value")) for c, v in ((1, "名称"), (2, "价格"))])).alias("e")).select("doc", "sheet", "e.*")
    found, problems = cells.planned_records(made, plans, merges, expected)
    kept = found.filter("col = 1").groupBy("doc", "sheet", "record").agg(F.count("*").alias("rows"), F.max(F.when(F.col("row") == F.col("record"), F.col("value"))).alias("name"))
    return kept.withColumn("problem", F.lit(None).cast("string")).unionByName(problems, allowMissingColumns=True)


@check("block_checks", f"""WITH {GRID}, placed AS (SELECT doc, sheet, "row" - 2 AS down, p_partkey % 4 AS across, p_name, p_size, cast(split_part(doc, '-', 2) AS INT) % 4 = 3 AS uneven FROM grid),
    blocks AS (SELECT DISTINCT doc, sheet, down // 5 AS down, across // 2 AS across FROM placed WHERE NOT uneven AND p_size > 10 AND down % 5 = 0 AND across % 2 = 0),
    labels AS (SELECT doc, sheet, down // 5 AS down, across // 2 AS across, max(CASE WHEN p_size > 10 THEN p_name ELSE ' ' END) AS found FROM placed WHERE down % 5 = 1 AND across % 2 = 1 GROUP BY ALL)
    SELECT doc, sheet, cast(down AS BIGINT) AS block_row, cast(across AS BIGINT) AS block_col, found FROM blocks LEFT JOIN labels USING (doc, sheet, down, across) WHERE found IS DISTINCT FROM ' '
    UNION ALL SELECT DISTINCT doc, sheet, NULL, NULL, 'uneven' FROM placed WHERE uneven""")
def _(t):
    # A block counts by its first cell alone, and a label is expected in its second row and column; every fourth book's range is a row too long.
    g = grid(t)
    made = g.select("doc", "sheet", "row", (F.col("p_partkey") % 4 + 1).cast("int").alias("col"), F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(" ").alias("value"), F.lit("s").alias("dtype"))
    sheets = g.select("doc", "sheet").distinct()
    plans = sheets.select("*", F.lit(2).alias("top"), F.lit(1).alias("left"), F.when(book_number() % 4 == 3, 27).otherwise(26).alias("bottom"), F.lit(4).alias("right"), F.lit(5).alias("height"), F.lit(2).alias("width"))
    blocks = cells.block_records(made, plans, sheets.select("*", F.lit(1).alias("rel_row"), F.lit(1).alias("rel_col")))
    wrong = cells.check_blocks(blocks, sheets.select("*", F.lit(2).alias("rel_row"), F.lit(2).alias("rel_col"), F.lit(" ").alias("value")))
    uneven = cells.uneven_blocks(plans).select("doc", "sheet", F.lit("uneven").alias("found"))
    return wrong.select("doc", "sheet", *[F.col(c).cast("long").alias(c) for c in ("block_row", "block_col")], "found").unionByName(uneven, allowMissingColumns=True)
