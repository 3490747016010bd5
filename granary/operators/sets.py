"""Set algebra over ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def difference(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def intersection(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def union(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def venn(named: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """Sizes of all regions: one union and two aggregations, whatever the number of sets."""
    rows = None
    for name, frame in named.items():
        part = frame.select(key, F.lit(name).alias("_set"))
        rows = part if rows is None else rows.unionByName(part)
    per = rows.groupBy(key).agg(*(F.bool_or(F.col("_set") == n).alias(n) for n in named))
    return per.groupBy(*named).agg(F.count("*").alias("n"))
