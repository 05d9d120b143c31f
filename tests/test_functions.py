import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sourcemart.functions import paging, prices, text, units
from sourcemart.functions.grams import index_grams, query_grams
from sourcemart.operators.overlay import term_established
from sourcemart.sources.evidence import cell_name


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression.alias("r")).first()["r"]


@pytest.mark.parametrize("given, expected", [
    ("  ＡＢＣ　x \n y ", "abc x y"), ("Straße", "strasse"), (None, ""), ("①", "1"), ("İ", unicodedata.normalize("NFKC", "İ").casefold())])
def test_normalize(spark, given, expected):
    assert one(spark, given, text.normalize("v")) == expected
    assert text.normalize_literal(given) == expected


@pytest.mark.parametrize("given, expected", [
    ("￥1,200.50元", 1200.5), ("80-150", None), ("更新中", None), ("¥ 88", 88.0), ("1,20", None), ("-3.5", -3.5), ("＋７", 7.0), ("", None), (None, None),
    ("1" * 400, None), ("12 元", 12.0), ("80/100", None)])
def test_parse_price(spark, given, expected):
    assert one(spark, given, prices.parse_price("v")) == expected


@pytest.mark.parametrize("label, role", [("零售价", "retail_price"), (" 参考价 b", "reference_price_b"), ("出货价", "supply_price"), ("价格", None), (None, None)])
def test_price_basis(spark, label, role):
    assert one(spark, label, prices.price_basis("v")) == role


def test_resolve_price_by_role_label_and_ambiguous(spark):
    frame = spark.sql("""SELECT map('retail_price', named_struct('label', '价格', 'value', '2'), 'sale_price', named_struct('label', '价格', 'value', '3'),
                                    'cost_price', named_struct('label', '成本价', 'value', '1')) AS prices""")
    got = frame.select(*[prices.resolve_price("prices", f)["value"].alias(f"x{i}") for i, f in enumerate(["retail_price", "成本价", "价格", "none"])]).first()
    assert tuple(got) == ("2", "1", None, None)


@pytest.mark.parametrize("given, expected", [
    ("容量500ml 重1.5kg", [(500.0, "ml"), (1500.0, "g")]), ("0.5l", [(500.0, "ml")]), ("10000mah", [(10000.0, "mAh")]), ("5mx", []), ("30分钟", [(0.5, "h")]), ("6 w", [(6.0, "W")])])
def test_quantities(spark, given, expected):
    assert [tuple(q) for q in one(spark, given, units.quantities("v"))] == expected


def test_quantities_apart(spark):
    """The end of a mention is no start of the next, as in the SQL twin of extract_quantities."""
    found = lambda given: [tuple(q) for q in one(spark, given, units.quantities("v", units.MENTION_APART))]
    assert found("wfuq5m2m6p") == [(5000.0, "mm")]
    assert found("5m 2m,5mx 6w") == [(5000.0, "mm"), (2000.0, "mm"), (6.0, "W")]


def test_unknown_or_negative_quantity_is_null(spark):
    assert one(spark, -1.0, units.to_canonical("v", F.lit("ml")), "double") is None
    assert one(spark, 1.0, units.to_canonical("v", F.lit("斗")), "double") is None


def test_grams(spark):
    assert one(spark, "耳机a", index_grams("v")) == sorted({"耳", "机", "a", "耳机", "机a"})
    assert query_grams("耳") == ["耳"] and query_grams("蓝牙耳机") == sorted(["蓝牙", "牙耳", "耳机"])


@pytest.mark.parametrize("quote, found", [
    ("2026-08-01 报价", True), ("2026年8月1日", True), ("2026/08/1", True), ("2026.8.01", True), ("2026-08-011", False), ("12026-08-01", False), ("2026-08-02", False)])
def test_date_in_quote(spark, quote, found):
    assert one(spark, quote, text.date_in_quote(F.lit("2026-08-01").cast("date"), "v")) is found


@pytest.mark.parametrize("key, value, quote, holds", [
    ("currency", "CNY", "人民币报价", True), ("currency", "USD", "人民币报价", False), ("tax", "included", "含税", True), ("tax", "included", "不含税", False),
    ("shipping", "excluded", "未含运", True), ("shipping", "included", "含税不含运", False), ("moq", "12", "起订量：12只", True), ("moq", "12", "容量12只装", False),
    ("moq", "12", "MOQ 120", False), ("moq", "12", "12件起订", True), ("unit", "只", "单位：只", True)])
def test_offer_terms_need_their_wording(spark, key, value, quote, holds):
    assert one(spark, quote, term_established(F.lit(key), F.lit(value), "v", F.lower("v"))) is holds


@pytest.mark.parametrize("pattern, name, match", [("*.xlsx", "a.xlsx", True), ("src?-*.txt", "src12-a.txt", False), ("[ab]*", "bcd", True), ("[!a]*", "abc", False), ("a.b", "aXb", False)])
def test_glob(spark, pattern, name, match):
    assert one(spark, name, text.glob_match("v", pattern)) is match


def test_title_adds_model_and_variant_once(spark):
    frame = spark.createDataFrame([("杯子\n A1", "A1", "红 色"), ("杯子", None, " ")], "n string, m string, v string")
    assert [r[0] for r in frame.select(text.title("n", "m", "v")).collect()] == ["杯子 A1 / 红 色", "杯子"]


def test_cell_names(spark):
    frame = spark.createDataFrame([(c,) for c in (1, 26, 27, 52, 53, 702, 703, 728, 729, 16384)], "c int")
    assert [r[0] for r in frame.select(cell_name(F.lit(3), F.col("c"))).collect()] == ["A3", "Z3", "AA3", "AZ3", "BA3", "ZZ3", "AAA3", "AAZ3", "ABA3", "XFD3"]


def slow_pages(value, capacity):
    """The wrapping rule, word for word: add characters while the line fits, then start a new one."""
    def width(line):
        total = 0.0
        for c in line:
            total += 1.0 if paging.WIDE.match(c) else 0.67 if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" else 0.55
        return total

    done = []
    for source in value.split("\n"):
        line = ""
        for c in source:
            if line and width(line + c) > capacity:
                done.append(line)
                line = ""
            line += c
        done.append(line)
    return ["\n".join(done[i:i + 15]) for i in range(0, len(done), 15)]


@pytest.mark.parametrize("capacity", [31.5, 54, 2])
def test_paginate_against_the_rule(spark, capacity):
    rng = random.Random(7)
    texts = ["x" + "".join(rng.choice("aB3，耳机 é\n") for _ in range(rng.randint(0, 900))) + "y" for _ in range(40)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, v string")
    got = {r["i"]: r["p"] for r in frame.select("i", paging.paginate("v", capacity).alias("p")).collect()}
    assert all(got[i] == slow_pages(v, capacity) for i, v in enumerate(texts))


def test_empty_text_has_a_placeholder_page(spark):
    assert one(spark, " \n ", paging.paginate("v")) == [paging.NO_TEXT]


def test_own_text_leaves_out_derived_values(spark):
    frame = spark.sql("SELECT '杯' AS name, 'B' AS brand, 'config' AS brand_origin, 'c/d' AS category, 'source' AS category_origin, map('k', 'raw') AS raw_fields")
    assert frame.select(text.own_text(set(frame.columns))).first()[0] == "杯\n\n\n\n\nc/d\nraw"
