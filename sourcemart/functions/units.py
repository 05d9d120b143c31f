"""Measured quantities in canonical units."""

from itertools import chain

from pyspark.sql import Column, functions as F

from sourcemart.functions.text import as_column

# Unit spelling -> canonical unit and factor.
UNITS = {
    "ml": ("ml", 1.0), "毫升": ("ml", 1.0), "l": ("ml", 1000.0), "升": ("ml", 1000.0),
    "g": ("g", 1.0), "克": ("g", 1.0), "kg": ("g", 1000.0), "千克": ("g", 1000.0),
    "mm": ("mm", 1.0), "毫米": ("mm", 1.0), "cm": ("mm", 10.0), "厘米": ("mm", 10.0), "m": ("mm", 1000.0), "米": ("mm", 1000.0),
    "w": ("W", 1.0), "瓦": ("W", 1.0), "kw": ("W", 1000.0), "千瓦": ("W", 1000.0),
    "mah": ("mAh", 1.0), "毫安时": ("mAh", 1.0), "ah": ("mAh", 1000.0), "安时": ("mAh", 1000.0),
    "db": ("dB", 1.0), "分贝": ("dB", 1.0), "h": ("h", 1.0), "小时": ("h", 1.0), "min": ("h", 1 / 60), "分钟": ("h", 1 / 60),
}
# Longest spelling first, so that "mah" is not read as "m".
SPELLINGS = "|".join(sorted(UNITS, key=len, reverse=True))
MENTION = f"(?i)(\\d+(?:\\.\\d+)?)\\s*({SPELLINGS})(?![a-z])"
# The character that ends a mention belongs to it: of "5m2m" only "5m2" is one.
MENTION_APART = MENTION.replace("(?![a-z])", "(?:[^a-z]|$)")


def _units() -> Column:
    pairs = [(F.lit(k), F.struct(F.lit(u).alias("unit"), F.lit(f).alias("factor"))) for k, (u, f) in UNITS.items()]
    return F.create_map(*chain.from_iterable(pairs))


def to_canonical(value, unit_norm) -> Column:
    """struct(number, unit) in the canonical unit; null for unknown units, negative or infinite numbers."""
    value = as_column(value)
    known = F.try_element_at(_units(), as_column(unit_norm))
    number = value * known["factor"]
    usable = known.isNotNull() & (value >= 0) & ~F.isnan(value) & (F.abs(number) < F.lit(float("inf")))
    return F.when(usable, F.struct(number.alias("number"), known["unit"].alias("unit")))


def canonical_literal(value: float, unit: str) -> tuple[float, str]:
    """The same conversion for a search bound on the driver."""
    canonical, factor = UNITS[unit.casefold().strip()]
    if not 0 <= value < float("inf"):
        raise ValueError("A quantity bound must be finite and not negative")
    return value * factor, canonical


def quantities(text_norm, mention: str = MENTION) -> Column:
    """All mentions of a number with a unit, in order, as array<struct<number,unit>>."""
    text = as_column(text_norm)
    numbers = F.regexp_extract_all(text, F.lit(mention), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(mention), F.lit(2))
    return F.transform(F.arrays_zip(numbers.alias("n"), units.alias("u")),
                       lambda m: to_canonical(m["n"].cast("double"), F.lower(m["u"])))


def whole_quantity(text_norm) -> Column:
    """struct(number, unit) when the whole text is one quantity."""
    pattern = f"(?i)^(\\d+(?:\\.\\d+)?)\\s*({SPELLINGS})$"
    text = as_column(text_norm)
    number = F.regexp_extract(text, pattern, 1).try_cast("double")
    return F.when(text.rlike(pattern), to_canonical(number, F.lower(F.regexp_extract(text, pattern, 2))))
