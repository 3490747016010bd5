"""Supplied tables in the roles of record sets, for Spark and, as text, for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import table

KINDS = ("click", "error", "purchase", "signup", "view")
MEMBERS = ("a", "b", "c")

#: votes: three events in a row are one question, the event's type is the member's answer.
VOTES = (
    "votes AS (SELECT event_id // 3 AS id, event_id % 3 AS ord, ['a','b','c'][event_id % 3 + 1] AS member, event_type AS answer, "
    "['click','error','purchase','signup','view'][(event_id // 3) % 5 + 1] AS expected, value, user_id FROM events), "
    "judged AS (SELECT *, answer = expected AS correct, CASE WHEN expected IN ('click','view') THEN 'Boolean' WHEN expected = 'error' THEN 'NullValues' ELSE 'Equals' END AS kind FROM votes)"
)


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 3).cast("long").alias("id"), (F.col("event_id") % 3).alias("ord"), F.col("event_type").alias("answer"), "value", "user_id",
    )
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    named = rows.withColumns({"member": pick(MEMBERS, F.col("ord")), "expected": pick(KINDS, F.col("id") % 5)})
    kind = F.when(F.col("expected").isin("click", "view"), "Boolean").when(F.col("expected") == "error", "NullValues").otherwise("Equals")
    return named.withColumns({"correct": F.col("answer") == F.col("expected"), "kind": kind})


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, history) with the messages in order."""
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("h"))
    return turns.select("id", F.transform("h", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history"))


#: parts: two words, a size, and the number of assertions of the test that is made of a part.
PARTS = (
    "p AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size AS z, "
    "CASE WHEN p_partkey % 5 = 4 THEN 0 ELSE (p_partkey % 4)::INT END AS n FROM part)"
)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    return table(spark, sf_dir, "part").select(k.alias("id"), word(1).alias("a"), word(2).alias("b"), F.col("p_size").alias("z"), F.when(k % 5 == 4, 0).otherwise((k % 4).cast("int")).alias("n"))


def dealt(rows: DataFrame) -> DataFrame:
    """Short rows dealt to all cores, for costly functions of a row: a file of few row groups is read by as few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def joined(*pieces: str | Column) -> Column:
    """A text of pieces: literals, columns, and names of columns after a dollar sign."""
    return F.concat(*(x if isinstance(x, Column) else F.col(x[1:]).cast("string") if x.startswith("$") else F.lit(x) for x in pieces))
