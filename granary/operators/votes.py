"""Votes, unanimity and order-dependent picks, as aggregates rather than windows where possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.storage import stored


def majority(votes: DataFrame) -> DataFrame:
    """(id, answer, n): the most frequent answer; of equal ones the first in member order. votes: id, ord, answer."""
    counted = votes.groupBy("id", "answer").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counted.groupBy("id").agg(F.max_by("answer", F.struct("n", -F.col("first"))).alias("answer"), F.max("n").alias("n"))


def majority_of(answers: Column) -> Column:
    """The answer of majority() among a row's own answers, which are in member order."""
    counted = F.transform(answers, lambda x, i: F.struct(F.size(F.filter(answers, lambda y: y.eqNullSafe(x))).alias("n"), (-i).alias("first"), x.alias("answer")))
    return F.array_max(counted)["answer"]


def unanimous(votes: DataFrame) -> DataFrame:
    """(id, agreed): whether all trimmed answers are the same."""
    return votes.groupBy("id").agg((F.count_distinct(F.trim("answer")) == 1).alias("agreed"))


def last_message(history: Column, back: int = 1) -> Column:
    return F.try_element_at(history, F.lit(-back))["content"]


def top_k(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows a task and group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def running_index(rows: DataFrame, order: str, name: str = "idx") -> DataFrame:
    """0, 1, ... in an order, without a single-task window: ranges are sorted apart and offset by their sizes.

    Ranges come from a sample, which another run of the same plan would draw anew; so they are stored before their sizes
    are counted.
    """
    ranged = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    tagged = stored(ranged.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    sizes = tagged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_p", before.alias("_before")))
    local = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)
    return tagged.join(offsets, "_p").withColumn(name, F.col("_before") + local).drop("_p", "_m", "_n", "_before")


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """A reproducible order by a keyed hash."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def chunked(rows: DataFrame, index: str, total: int, parts: int) -> DataFrame:
    """Chunk numbers of size total // parts + 1."""
    return rows.withColumn("chunk", F.floor(F.col(index) / (total // parts + 1)))


def group_size(rows: DataFrame, group: str) -> DataFrame:
    """Rows with their group's size, by an aggregate and a join that splits skewed groups."""
    return rows.join(rows.groupBy(group).agg(F.count("*").alias("group_size")), group)
