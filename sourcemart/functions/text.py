"""Text functions. ``normalize`` and ``fold`` need Python (Spark has no NFKC); everything else stays in the JVM."""

import fnmatch
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Line boundaries as Python's str.splitlines sees them.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
# Fixed value: one character that is not white space.
VISIBLE = "(?U)[^\\s\\x1c-\\x1f]"


def _clean(value):
    if not value:
        return ""
    if not value.isascii():
        value = unicodedata.normalize("NFKC", value)
    return " ".join(value.casefold().split())


@F.pandas_udf(StringType())
def normalize(text: pd.Series) -> pd.Series:
    """NFKC, casefold, runs of white space to one space, trimmed; null becomes the empty string."""
    return text.map(_clean)


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """NFKC only."""
    return text.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def normalize_literal(value: str) -> str:
    """The same normalization for a search argument on the driver."""
    return _clean(value)


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def norm_header(label) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(as_column(label).cast("string"), F.lit("")), "(?U)\\s+", ""))


def blank(value) -> Column:
    text = as_column(value)
    return text.isNull() | ~text.rlike(VISIBLE)


def lines(text) -> Column:
    return F.split(as_column(text), LINE_BREAK)


def all_terms(text, terms) -> Column:
    """Every term is a substring. No terms: true."""
    condition = F.lit(True)
    for term in terms:
        condition = condition & F.contains(as_column(text), F.lit(term))
    return condition


def no_terms(text, terms) -> Column:
    condition = F.lit(True)
    for term in terms:
        condition = condition & ~F.contains(as_column(text), F.lit(term))
    return condition


def joined_text(*parts) -> Column:
    """Parts with a space between them; an absent part leaves its space, as search columns expect."""
    return F.concat_ws(" ", *[F.coalesce(as_column(p).cast("string"), F.lit("")) for p in parts])


def own_text(obs_has: set[str]) -> Column:
    """A product's own text: name, model, variant, features, source-made brand/supplier/category, raw values."""
    def value(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in obs_has else F.lit("")

    parts = [value(name) for name in ("name", "model", "variant", "features")]
    for name in ("brand", "supplier", "category"):
        text = value(name)
        origin = f"{name}_origin"
        if origin in obs_has:
            # A derived value is no evidence: null drops out of concat_ws together with its line break.
            text = F.when(F.coalesce(F.col(origin), F.lit("source")).isin("source", "sheet"), text)
        parts.append(text)
    if "raw_fields" in obs_has:
        parts.append(F.when(F.size("raw_fields") > 0, F.array_join(F.map_values("raw_fields"), "\n")))
    return F.concat_ws("\n", *parts)


def text_window(text, offset: int, size: int) -> Column:
    text = as_column(text)
    total = F.length(text)
    return F.struct(F.substring(text, offset + 1, size).alias("text"), total.cast("long").alias("total_chars"),
                    F.lit(offset).cast("long").alias("offset"), (total > offset + size).alias("more"))


def snippet(name_norm, all_norm, terms) -> Column:
    """100 characters starting 15 before the first term that the name does not hold; null if the name holds all."""
    name, text = as_column(name_norm), as_column(all_norm)
    first = F.coalesce(*[F.when(~F.contains(name, F.lit(t)), F.lit(t)) for t in terms], F.lit(None).cast("string"))
    start = F.greatest(F.lit(1), F.instr(text, first) - 15)
    return F.when(first.isNotNull(), F.substr(text, start, F.lit(100)))


def facts_excerpt(text, size: int = 240) -> Column:
    """Distinct visible lines, first ``size`` characters and the full length."""
    kept = F.array_join(F.array_distinct(F.filter(lines(text), lambda line: line.rlike(VISIBLE))), "\n")
    return F.struct(F.substring(kept, 1, size).alias("excerpt"), F.length(kept).cast("long").alias("facts_length"))


def glob_match(name, pattern: str) -> Column:
    """File name against a shell pattern, the whole name, case kept."""
    body = fnmatch.translate(pattern).removesuffix("\\z").removesuffix("\\Z")
    return as_column(name).rlike("^" + body.replace("(?>", "(?:") + "\\z")


def literal_in(text, query: str) -> Column:
    """Case-insensitive literal substring; wildcards have no meaning."""
    return F.contains(F.lower(as_column(text)), F.lower(F.lit(query)))


def path_prefix(value, root: str) -> Column:
    """Equal to a category or below it. Not LIKE: names may hold its wildcards."""
    value = as_column(value)
    return (value == F.lit(root)) | value.startswith(root + "/")


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of compact JSON with sorted keys; nulls are written, so that absent and null differ from ''."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def utc_iso(epoch_seconds) -> Column:
    return F.date_format(F.timestamp_seconds(as_column(epoch_seconds)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def near_equal(a, b, tolerance: float = 1e-9) -> Column:
    a, b = as_column(a), as_column(b)
    return F.abs(a - b) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def title(name, model, variant) -> Column:
    """Name, then model and variant where the title so far does not hold them."""
    def tidy(value):
        return F.trim(F.regexp_replace(value, "(?U)\\s+", " "))

    result = tidy(as_column(name))
    for part in (as_column(model), as_column(variant)):
        result = F.when(~blank(part) & ~F.contains(result, part),
                        F.concat(result, F.lit(" / "), tidy(part))).otherwise(result)
    return result


def compact(value) -> Column:
    return F.regexp_replace(as_column(value), "(?U)\\s+", "")


def date_in_quote(day, quote_norm) -> Column:
    """The date stands in the quote as y-m-d, y/m/d, y.m.d or 年月日, optionally zero padded, no digit beside it."""
    day = as_column(day)
    pattern = F.concat(F.lit("(?<!\\d)"), F.year(day).cast("string"), F.lit("[-/.年]0?"), F.month(day).cast("string"),
                       F.lit("[-/.月]0?"), F.day(day).cast("string"), F.lit("日?(?!\\d)"))
    return F.regexp_like(as_column(quote_norm), pattern)
