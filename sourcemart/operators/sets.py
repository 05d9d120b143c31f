"""Set relations between frames of the same columns."""

from pyspark.sql import DataFrame


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def offenders(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that are not in ``b``; none: ``a`` is a subset."""
    return a.join(b.distinct(), a.columns, "left_anti")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*b.columns).subtract(b)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*b.columns).intersect(b)
