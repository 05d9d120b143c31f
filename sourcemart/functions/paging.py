"""Wrapping of long texts into pages by visual width."""

import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, functions as F

from sourcemart.functions.text import as_column, blank

# Widths per character class, lines per page, placeholder for an empty text.
WIDE = re.compile("[⺀-⺙⺛-⻳⼀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿"
                  "豈-舘並-龎\U00020000-\U000323af　-〿＀-￯]")
WIDE_WIDTH, CAPITAL_WIDTH, OTHER_WIDTH = 1.0, 0.67, 0.55
PAGE_LINES = 15
NO_TEXT = "表格未提供功能特点"


class _Widths(dict):
    """Width per character, worked out at its first use."""

    def __missing__(self, char):
        capital = char.isascii() and (char.isupper() or char.isdigit())
        self[char] = WIDE_WIDTH if WIDE.match(char) else CAPITAL_WIDTH if capital else OTHER_WIDTH
        return self[char]


def _wrap(line, capacity, widths):
    """Pieces of a line, each as long as fits; widths are added from the start of each piece."""
    sizes = list(map(widths.__getitem__, line))
    most = int(capacity / OTHER_WIDTH) + 2
    start = 0
    while True:
        fits = bisect_right(list(accumulate(sizes[start:start + most])), capacity)
        end = start + max(fits, 1)
        yield line[start:end]
        if end >= len(line):
            return
        start = end


def paginate(text, capacity: float = 31.5) -> Column:
    """array<string> of pages; every character of the text is kept, in order."""
    @F.pandas_udf("array<string>")
    def pages(texts: pd.Series) -> pd.Series:
        widths = _Widths()

        def split(value):
            rows = [part for line in value.split("\n") for part in _wrap(line, capacity, widths)]
            return ["\n".join(rows[i:i + PAGE_LINES]) for i in range(0, len(rows), PAGE_LINES)]
        return texts.map(split)

    text = as_column(text)
    tidy = F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), "(?U)^\\s+|\\s+$", "")
    return pages(F.when(blank(text), F.lit(NO_TEXT)).otherwise(tidy))
