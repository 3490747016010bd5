"""Sets of dense ids as bitmaps: all regions of several sets from one scan and one small aggregation.

A bucket holds 32,768 ids, and a bitmap of it 4 KB, whatever the number of rows; so what is shuffled is a bitmap a bucket, set and
task instead of a row an id. The sizes of the unions of all combinations of sets come from merging bitmaps, and those of the
regions (ids in exactly these sets) from the unions by inclusion and exclusion; every metric over sets is a sum of regions.

For ids without gaps, such as running numbers; scattered ones make a bitmap each.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_bitmaps(rows: DataFrame, of: Column, key: str = "id") -> DataFrame:
    """(bucket, of, bits): the distinct ids of each set; rows with a null id or set are in none."""
    placed = rows.select(F.bitmap_bucket_number(key).alias("bucket"), F.bitmap_bit_position(key).alias("bit"), of.alias("of"))
    return placed.filter("bucket is not null and of is not null").groupBy("bucket", "of").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _subsets(names: list[str]) -> list[tuple[str, ...]]:
    return [c for n in range(1, len(names) + 1) for c in combinations(names, n)]


def regions(bitmaps: DataFrame, names: list[str]) -> DataFrame:
    """(a boolean column a set, n): how many ids are in exactly these sets, of all combinations but that of none; for a few sets.

    bitmaps: as of id_bitmaps(); names: up to six sets, others don't count.
    """
    if not 0 < len(names) <= 6:
        raise ValueError("from one to six sets")
    kept = bitmaps.filter(F.col("of").isin(names))
    union = lambda sets: F.bitmap_count(F.bitmap_or_agg(F.when(F.col("of").isin(*sets), F.col("bits"))))
    subsets = _subsets(names)
    buckets = kept.groupBy("bucket").agg(*(union(s).alias(f"u{k}") for k, s in enumerate(subsets)))
    totals = buckets.agg(*(F.coalesce(F.sum(f"u{k}"), F.lit(0)).alias(f"u{k}") for k in range(len(subsets))))
    place = {frozenset(s): f"u{k}" for k, s in enumerate(subsets)}

    def exactly(inside: frozenset) -> Column:
        # ids in none of the others but in every one of `inside`: over the parts taken away from `inside`, signs alternate
        outside = frozenset(names) - inside
        total = F.lit(0)
        for n in range(len(inside) + 1):
            for part in combinations(sorted(inside), n):
                sets = outside | frozenset(part)
                size = F.col(place[sets]) if sets else F.lit(0)
                total = total - size if n % 2 == 0 else total + size
        return total

    rows = [F.struct(*(F.lit(x in s).alias(x) for x in names), exactly(frozenset(s)).alias("n")) for s in subsets]
    return totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("n > 0")


def set_metrics(rows: DataFrame, members: list[str], key: str = "id") -> DataFrame:
    """(metric, member, n) over the ids that members have right: any, all, each member's own, those that only it has, and the total.

    rows: id (dense), member, correct. One scan of rows and one aggregation of bitmaps, for every metric at once.
    """
    every = F.lit("*")
    right = F.when(F.col("correct"), F.col("member"))
    named = id_bitmaps(rows.select(key, F.explode(F.array(every, right)).alias("_of")), F.col("_of"), key)
    found = regions(named, ["*", *members])
    ones = [F.when(F.col(m), 1).otherwise(0) for m in members]
    inside = sum(ones[1:], ones[0])
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    parts = [("total", None, F.lit(True)), ("any", None, inside > 0), ("all", None, inside == len(members))]
    parts += [("right", m, F.col(m)) for m in members] + [("only", m, F.col(m) & (inside == 1)) for m in members]
    summed = found.agg(F.array(*(F.struct(F.lit(a).alias("metric"), F.lit(m).cast("string").alias("member"), n(test).alias("n")) for a, m, test in parts)).alias("r"))
    return summed.select(F.explode("r").alias("r")).select("r.*")
