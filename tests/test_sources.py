import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sourcemart.sources import cells, evidence, intake


def test_same_bytes_are_one_document(spark, rows):
    files = spark.createDataFrame([("/a/x.xlsx", "x", "h1", True), ("/a/y.xlsx", "y", "h1", True), ("/b/x.xlsx", "x", "h2", True), ("/b/z.pdf", "z", "h3", False)],
                                  "path string, name string, content_hash string, recognized boolean")
    registered = spark.createDataFrame([("d_h9", "ready")], "doc_id string, status string")
    documents, aliases, outcome = intake.intake(files, registered)
    assert rows(documents) == [("d_h1", "x", "ready"), ("d_h2", "x", "ready"), ("d_h3", "z", "pending")]
    assert rows(outcome, "path", "outcome") == [("/a/x.xlsx", "ready"), ("/a/y.xlsx", "duplicate"), ("/b/x.xlsx", "ready"), ("/b/z.pdf", "needs_mapping")]
    assert aliases.count() == 4
    again = intake.intake(files, documents.select("doc_id", "status"))
    assert again[0].isEmpty()
    assert {r["outcome"] for r in again[2].collect()} == {"duplicate", "needs_mapping"}


MANIFEST = "path string, size long, mtime long, hash string, config_hash string"


def test_manifest_diff_reads_bytes_only_when_needed(spark, rows):
    sha = __import__("hashlib").sha256
    old = spark.createDataFrame([("same", 1, 1, "h", "c"), ("touched", 1, 1, sha(b"t").hexdigest(), "c"), ("changed", 1, 1, "h", "c"), ("config", 1, 1, "h", "old"), ("gone", 1, 1, "h", "c")], MANIFEST)
    new = spark.createDataFrame([("same", 1, 1, "c", "zzz"), ("touched", 1, 2, "c", "t"), ("changed", 2, 1, "c", "n"), ("config", 1, 1, "c", "x"), ("fresh", 1, 1, "c", "f")],
                                "path string, size long, mtime long, config_hash string, content string")
    expected = [("changed", "reindex"), ("config", "reindex"), ("fresh", "new"), ("gone", "missing"), ("same", "skip"), ("touched", "touch")]
    assert rows(intake.manifest_diff(old, new), "path", "action") == expected
    # Same size and time, other bytes: only a check of the bytes finds it.
    assert ("same", "reindex") in rows(intake.manifest_diff(old, new, verify_hash=True), "path", "action")
    assert ("touched", "reindex") in rows(intake.manifest_diff(old, new, rebuild=True), "path", "action")


def test_commit_is_idempotent_and_conflicts(spark, rows):
    schema = "doc_id string, record_key string, payload_hash string, at int"
    incoming = spark.createDataFrame([("d", "cup", "h1", 1), ("d", "cup", "h1", 2), ("d", "cup", "h2", 3), ("d", "tea", "h3", 4)], schema)
    empty = incoming.filter("false")
    first = intake.commit(empty, incoming, ["at"])
    assert rows(first, "at", "outcome") == [(1, "added"), (2, "skipped"), (3, "conflict"), (4, "added")]
    stored = first.filter("outcome = 'added'").select("doc_id", "record_key", "payload_hash")
    assert rows(intake.commit(stored, incoming, ["at"]), "at", "outcome") == [(1, "skipped"), (2, "skipped"), (3, "conflict"), (4, "skipped")]


def test_relocate_rejects_changed_taken_and_escaping(spark, rows):
    registry = spark.createDataFrame([("/old/a", "h1", "c"), ("/old/b", "h2", "c"), ("/old/c", "h3", "c"), ("/new/c", "h3", "c"), ("/other/x", "h", "c"), ("/old/../k", "h4", "c")], "path string, hash string, config_hash string")
    files = spark.createDataFrame([("/new/a", "h1", "c"), ("/new/b", "zz", "c"), ("/new/c", "h3", "c"), ("/new/../k", "h4", "c")], "path string, content_hash string, config_hash string")
    moves, rejects = intake.relocate(registry, files, "/old", "/new")
    assert rows(moves, "path", "target") == [("/old/a", "/new/a")]
    assert rows(rejects, "path", "problem") == [("/old/../k", "escapes_root"), ("/old/b", "missing_or_changed"), ("/old/c", "destination_registered")]


def zipped(*names):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name in names:
            archive.writestr(name, "x")
    return buffer.getvalue()


@pytest.mark.parametrize("name, content, reason", [
    ("a.xlsx", zipped("xl/workbook.xml"), None), ("a.xlsx", zipped("word/document.xml"), "missing_part"), ("a.docx", b"plain", "not_a_zip"), ("a.pdf", b"%PDF-1.7", None),
    ("a.pdf", b"PDF", "not_a_pdf"), ("a.xls", bytes.fromhex("D0CF11E0A1B11AE100"), None), ("a.xls", b"x", "not_ole"), ("CON.txt", b"x", "bad_name"), ("a. ", b"x", "bad_name"),
    ("a.exe", b"x", "unsupported_suffix"), ("a.txt", b"", "empty")])
def test_validate_files(spark, name, content, reason):
    frame = spark.createDataFrame([("/in/" + name, bytearray(content), len(content))], "path string, content binary, length long")
    assert intake.validate_files(frame).first()["reason"] == reason


def test_discover_skips_tool_folders_and_locks(spark, tmp_path):
    for place in ("a.txt", "deep/er/b.txt", ".git/c.txt", "outputs/d.txt", "node_modules/e.txt", ".catalog-x/f.txt", "~$g.txt", "h.md"):
        target = tmp_path / place
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("x")
    found = intake.discover(spark, str(tmp_path), ".txt", with_content=False)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.txt", "b.txt"]


def test_a_folder_of_part_files_is_one_source(spark, rows, tmp_path):
    root = tmp_path / "in.txt"  # named like a source itself, but the place that is searched
    for place in ("a.txt", "b.txt/part-0.txt", "b.txt/part-1.txt", "b.txt/_SUCCESS", "deep/c.txt/day=1/part-0.txt", "deep/d.txt", ".git/e.txt/part-0.txt", "h.md/part-0.md"):
        (root / place).parent.mkdir(parents=True, exist_ok=True)
        (root / place).write_text("x")
    found = intake.discover_sources(spark, str(root), ".txt")
    assert rows(found, "name", "files", "length") == [("a.txt", 1, 1), ("b.txt", 2, 2), ("c.txt", 1, 1), ("d.txt", 1, 1)]


def test_text_and_csv_evidence(spark, rows):
    docs = spark.createDataFrame([("d", "﻿便携水杯\r\n\n　\n零售价 120元 重量轻")], "doc string, text string")
    assert rows(evidence.text_evidence(docs), "ref", "text") == [("line:1", "便携水杯"), ("line:4", "零售价 120元"), ("line:5", "重量轻")]
    table = spark.createDataFrame([("d", 'a,"b\nc", \n,"d ""e"""')], "doc string, text string")
    assert rows(evidence.csv_evidence(table), "ref", "text") == [("r1c1", "a"), ("r1c2", "b\nc"), ("r2c2", 'd "e"')]


EVIDENCE = "doc string, ref string, kind string, text string, locator string, page int, verification string"
RECORD = "doc string, key string, facts array<struct<field:string,part:string,ref:string,quote:string>>"


def test_import_needs_verbatim_quotes(spark, rows):
    entries = spark.createDataFrame([("d", "line:1", "text", "便携水杯", "line 1", 1, None), ("d", "line:2", "text", "零售价 120元", "line 2", 1, None),
                                     ("d", "visual-1", "text", "红色", "visual observation of image:1", 3, "visual"), ("e", "line:1", "text", "别的", "line 1", 1, None)], EVIDENCE)
    good = [("name", None, "line:1", None), ("retail_price", "label", "line:2", "零售价"), ("retail_price", None, "line:2", "120"), ("variant", None, "visual-1", None)]
    items, rejects = evidence.import_records(spark.createDataFrame([("d", "cup", good)], RECORD), entries)
    assert rejects.isEmpty()
    item = items.first()
    assert item["name"] == "便携水杯" and item["raw_fields"]["retail_price"] == "120" and item["raw_fields"]["retail_price.label"] == "零售价"
    assert item["issues"] == ["视觉转录:未经原生文本校验"]
    bad = [("d", "cup", good), ("d", "x", [("name", None, "line:1", "保温")]), ("d", "y", [("name", None, "line:9", None)]), ("d", "z", [("model", None, "line:1", None)])]
    _, rejects = evidence.import_records(spark.createDataFrame(bad, RECORD), entries)
    assert {r["key"] for r in rejects.collect()} == {"x", "y", "z"}
    # A key or a field given twice goes to the rejects; the rest of the batch is still read.
    again = [("d", "cup", good), ("d", "p", [("name", None, "line:1", None)]), ("d", "p", [("name", None, "line:1", None)]),
             ("d", "q", [("name", None, "line:1", None), ("name", None, "line:1", "便携")])]
    items, rejects = evidence.import_records(spark.createDataFrame(again, RECORD), entries)
    assert [r["key"] for r in items.collect()] == ["cup"] and rows(rejects, "key", "reason") == [("p", "record key repeated in batch"), ("q", "field given twice")]


def test_transcriptions_need_an_image(spark, rows):
    native = spark.createDataFrame([("d", "image:1", "image", None, "original image", 4), ("d", "line:1", "text", "x", "line 1", 1)], "doc string, ref string, kind string, text string, locator string, page int")
    asked = spark.createDataFrame([("d", "image:1", "红色", "me"), ("d", "line:1", "t", "me"), ("d", "image:1", " ", "me")], "doc string, image_ref string, text string, reviewer string")
    kept, rejects = evidence.transcribe(native, asked)
    assert rejects.count() == 2
    assert rows(evidence.evidence_union(native, kept).filter("verification = 'visual'"), "text", "page") == [("红色", 4)]


# -- grids -----------------------------------------------------------------------------------------------------------

def grid(spark, table, sheet="s", doc="d", top=1):
    made = [(doc, sheet, r, c, None if v is None else str(v), "e" if v == "#REF!" else "s") for r, line in enumerate(table, top) for c, v in enumerate(line, 1) if v is not None]
    return spark.createDataFrame(made, "doc string, sheet string, row int, col int, value string, dtype string")


MERGES = "doc string, sheet string, top int, left int, bottom int, right int"


def read(spark, made, aliases=None):
    headers = cells.detect_headers(made, cells.alias_table(spark, aliases))
    columns = cells.map_columns(made, headers, cells.alias_table(spark, aliases))
    plans = headers.filter("verdict = 'ok'").select("doc", "sheet", "header_row", (F.col("header_row") + 1).alias("first_row"), F.lit(99).alias("last_row"), F.lit(1).alias("first_col"), F.lit(20).alias("last_col"))
    return cells.table_records(made, plans), columns


def test_price_columns(spark, rows):
    made = grid(spark, [["名称", "零售价", "参考价B", "代理价", "供货价", "成本价"], ["同一款水杯", 150, 120, 90, 85, 80]])
    long = cells.unpivot_prices(*read(spark, made))
    assert rows(long, "field", "value") == [("agent_price", "90"), ("cost_price", "80"), ("reference_price_b", "120"), ("retail_price", "150"), ("supply_price", "85")]


def test_an_explicit_alias_moves_a_label_to_one_role(spark):
    made = grid(spark, [["名称", "供货价"], ["a", 1]])
    _, columns = read(spark, made, {"agent_price": ["供货价"]})
    assert [r["role"] for r in columns.orderBy("col").collect()] == ["name", "agent_price"]
    with pytest.raises(ValueError):
        cells.alias_table(spark, {"agent_price": ["价"], "cost_price": [" 价 "]})


@pytest.mark.parametrize("table, verdict", [
    ([["标题"], ["名称", "零售价"], ["a", 1]], "ok"), ([["名称"], ["品名"]], "ambiguous"), ([["名称", "备注", "备 注"]], "duplicate_labels"),
    ([["名称", "零售价", "建议零售价"]], "several_columns"), ([["名称", "卖点", "参数"]], "ok"), ([["别的"]], "skipped")])
def test_header_verdicts(spark, table, verdict):
    made = grid(spark, table)
    assert cells.detect_headers(made, cells.alias_table(spark)).first()["verdict"] == verdict


def test_merged_name_makes_one_record_and_unmerged_values_conflict(spark, rows):
    made = grid(spark, [["序号", "品牌", "名称", "颜色", "成本价"], [1, "甲", "杯", "红", 12], [None, None, None, "蓝", None]])
    merges = spark.createDataFrame([("d", "s", 2, c, 3, c) for c in (1, 2, 3, 5)], MERGES)
    blanks = spark.createDataFrame([("d", "s", 3, c, None, "s") for c in (1, 2, 3, 5)], made.schema)
    filled = cells.resolve_merges(made.unionByName(blanks), merges)
    plans = spark.createDataFrame([("d", "s", 1, 2, 3, 1, 5)], "doc string, sheet string, header_row int, first_row int, last_row int, first_col int, last_col int")
    spans = spark.createDataFrame([("d", "s", 2, 3)], "doc string, sheet string, top int, bottom int")
    records = cells.table_records(filled, plans, spans)
    assert rows(records.filter("col = 4"), "record", "value") == [(2, "红"), (2, "蓝")]
    assert rows(records.filter("col = 3"), "record", "value", "origin_row") == [(2, "杯", 2), (2, "杯", 2)]
    assert cells.scalar_conflicts(records.filter("col = 5"), ["doc", "sheet", "record"]).isEmpty()
    other = made.unionByName(spark.createDataFrame([("d", "s", 3, 5, "15", "s")], made.schema))
    assert rows(cells.scalar_conflicts(cells.table_records(other, plans, spans).filter("col = 5"), ["doc", "sheet", "record"]), "low", "high") == [("12", "15")]
    assert cells.cut_spans(plans.withColumn("last_row", F.lit(2)), spans).count() == 1 and cells.cut_spans(plans, spans).isEmpty()


def test_blocks(spark, rows):
    made = grid(spark, [["样品甲", None, None, "样品乙", None, None], [None] * 6, [None, None, 88, None, None, 99]], top=2)
    plans = spark.createDataFrame([("d", "s", 2, 1, 7, 6, 3, 3)], "doc string, sheet string, top int, left int, bottom int, right int, height int, width int")
    found = cells.block_records(made, plans)
    assert rows(found.filter("rel_row = 3 AND rel_col = 3"), "block_row", "block_col", "value", "row", "col") == [(0, 0, "88", 4, 3), (0, 1, "99", 4, 6)]


def test_drift_and_extent(spark):
    made = grid(spark, [["项目", "成交额"], ["样品", 88]])
    expected = spark.createDataFrame([("d", "s", 1, 1, "项目"), ("d", "s", 1, 2, "成交额")], "doc string, sheet string, row int, col int, value string")
    assert cells.check_expectations(made, expected).isEmpty()
    changed = grid(spark, [["项目", "金额"], ["样品", 88], ["more", 1]])
    assert [r["found"] for r in cells.check_expectations(changed, expected).collect()] == ["金额"]
    plans = spark.createDataFrame([("d", "s", 2, 1, 2, 2)], "doc string, sheet string, expected_last_row int, first_col int, last_col int, last_row int")
    assert cells.check_extent(made, plans.drop("last_row")).isEmpty() and cells.check_extent(changed, plans.drop("last_row")).count() == 1
    assert cells.extended(plans, changed).first()["last_row"] == 3


def test_repeated_headers_are_no_records(spark, rows):
    made = grid(spark, [["名称", "零售价"], ["a", 1], ["名称", "零售价"], ["b", 2]])
    plans = spark.createDataFrame([("d", "s", 1, 2, 9, 1, 2)], "doc string, sheet string, header_row int, first_row int, last_row int, first_col int, last_col int")
    records = cells.table_records(made, plans)
    expected = spark.createDataFrame([("d", "s", 1, "名称"), ("d", "s", 2, "零售价")], "doc string, sheet string, col int, value string")
    assert rows(cells.drop_repeated_headers(records, expected).filter("col = 1"), "value") == [("a",), ("b",)]


def test_overlaps(spark, rows):
    schema = "doc string, sheet string, region int, top int, left int, bottom int, right int"
    apart = [("d", "s", 1, 1, 1, 5, 3), ("d", "s", 2, 1, 4, 5, 6), ("d", "s", 3, 6, 1, 200, 6), ("d", "t", 4, 1, 1, 9, 9)]
    assert cells.check_overlaps(spark.createDataFrame(apart, schema)).isEmpty()
    assert rows(cells.check_overlaps(spark.createDataFrame(apart + [("d", "s", 5, 5, 3, 5, 3)], schema)), "region", "other") == [(1, 5)]
    wide = [("d", "s", 1, 1, 1, 3, 10), ("d", "s", 2, 1, 2, 3, 3), ("d", "s", 3, 1, 5, 3, 6)]
    assert rows(cells.check_overlaps(spark.createDataFrame(wide, schema)), "region", "other") == [(1, 2), (1, 3)]


def test_price_error_and_issues(spark, rows):
    records, columns = read(spark, grid(spark, [["名称", "零售价"], ["a", "#REF!"], ["b", 3]]))
    assert rows(cells.flag_price_errors(cells.unpivot_prices(records, columns)), "record", "error") == [(2, "spreadsheet_error"), (3, None)]
    assert rows(cells.cell_issues(records), "record", "issue") == [(2, "单元格错误:B2")]


def test_ids_survive_reordering_and_count_repeats(spark, rows):
    schema = "doc string, sheet string, row int, name string, model string, variant string"
    first = spark.createDataFrame([("d", "s", 2, "杯", None, None), ("d", "s", 3, "壶", None, "红"), ("d", "s", 4, "杯", None, None)], schema)
    other = spark.createDataFrame([("d", "s", 2, "壶", None, "红"), ("d", "s", 3, "杯", None, None), ("d", "s", 4, "杯", None, None)], schema)
    a, b = (cells.assign_ids(f, "doc", ["row"]) for f in (first, other))
    assert rows(a, "name", "occurrence", "id") == rows(b, "name", "occurrence", "id")
    assert len({r["id"] for r in a.collect()}) == 3


def test_staging_rejects_ambiguous_and_error_prices(spark, rows):
    kind = "id string, prices map<string,struct<label:string,value:string,error:string>>"
    items = spark.createDataFrame([("a", {"retail_price": ("价格", "2", None), "sale_price": ("价格", "3", None)}), ("b", {"retail_price": ("零售价", "#REF!", "spreadsheet_error")}),
                                   ("c", {"retail_price": ("零售价", "5", None)})], kind)
    chosen = spark.createDataFrame([(1, "c"), (2, "b"), (3, "a"), (4, "zz")], "position int, id string")
    assert rows(intake.stage(items, chosen, ["retail_price"]), "position", "problem") == [(1, None), (2, "price_error"), (3, None), (4, "unknown_id")]
    assert dict(rows(intake.stage(items, chosen, ["价格"]), "position", "problem"))[3] == "price_absent_or_ambiguous"
    with pytest.raises(ValueError):
        intake.stage(items, chosen, ["a", "b", "c"])


def test_every_overlapping_pair_once_whatever_the_height(spark, rows):
    """Random, tall, nested and touching regions against all pairs; what is made before the join grows with the logarithm."""
    import random
    rng = random.Random(9)
    schema = "doc string, sheet string, region int, top int, left int, bottom int, right int"
    made = []
    for n in range(120):
        top, left = rng.choice([0, 1, rng.randint(0, 60), 999_990]), rng.choice([0, 1, rng.randint(0, 30)])
        made.append((rng.choice("de"), "s", n, top, left, top + rng.choice([0, 0, 1, 5, 40, 1_000_000]), left + rng.choice([0, 0, 2, 9, 16_000])))
    want = sorted((a[0], a[1], a[2], b[2]) for a in made for b in made if a[0] == b[0] and a[2] < b[2]
                  and a[3] <= b[5] and b[3] <= a[5] and a[4] <= b[6] and b[4] <= a[6])
    found = [tuple(r) for r in cells.check_overlaps(spark.createDataFrame(made, schema)).select("doc", "sheet", "region", "other").collect()]
    assert sorted(found) == want
    sizes = spark.createDataFrame([(3, 3 + n, 40) for n in (0, 6, 1_000_000)], "low long, high long, levels int")
    nodes = [r[0] for r in sizes.selectExpr(cells._cover("low", "high", "levels")).collect()]
    assert len(nodes[2]) <= 42
    for held, n in zip(nodes, (0, 6, 1_000_000)):
        spans = sorted((i << k, (i + 1) << k) for k, i in held)
        assert spans[0][0] == 3 and spans[-1][1] == 4 + n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert cells.check_overlaps(spark.createDataFrame([], schema)).isEmpty()


def test_overlap_nodes_are_joined_by_shuffle(spark):
    """However small the regions look, their nodes are not sent through the driver."""
    made = spark.sql("SELECT * FROM VALUES ('d', 's', 1, 1, 1, 5, 3), ('d', 's', 2, 2, 2, 5, 6) AS r(doc, sheet, region, top, left, bottom, right)")
    found = cells.check_overlaps(made)
    plan = found._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert any("SortMergeJoin" in line and "_r#" in line for line in plan)
    assert not any("Broadcast" in line and "_r#" in line for line in plan)


def test_parts_are_dealt_out_before_they_become_cells(spark, monkeypatch):
    """The number of tasks follows the number of parts, not the few bytes they take in a file."""
    from sourcemart.checks import joins
    from sourcemart.model import Tables
    monkeypatch.setattr(joins, "PARTS_PER_TASK", 10)
    t = Tables(spark, "/root/testdata/sf0.001")
    assert joins.grid(t).rdd.getNumPartitions() == -(-t.part.count() // 10)


def test_cells_are_not_broadcast_however_small_they_look(spark):
    made = spark.sql("SELECT * FROM VALUES ('d', 's', 2, 1, 'a', 's', 2) AS c(doc, sheet, row, col, value, dtype, record)")
    columns = spark.sql("SELECT * FROM VALUES ('d', 's', 1, 'x', 'retail_price', true), ('d', 's', 1, 'y', 'features', false), ('d', 's', 1, 'z', NULL, false) AS c(doc, sheet, col, label, role, is_price)")
    headers = spark.sql("SELECT * FROM VALUES ('d', 's', 2, 'ok') AS h(doc, sheet, header_row, verdict)")
    plans = spark.sql("SELECT * FROM VALUES ('d', 's', 1, 2, 9, 1, 2) AS p(doc, sheet, header_row, first_row, last_row, first_col, last_col)")
    for found in (cells.unpivot_prices(made, columns), cells.map_columns(made, headers, cells.alias_table(spark)), cells.table_records(made.drop("record"), plans),
                  cells.features(made, columns), cells.raw_fields(made, columns), cells.unmapped_columns(made, columns)):
        assert "SortMergeJoin [doc" in found._jdf.queryExecution().sparkPlan().toString()
