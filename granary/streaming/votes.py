"""Continuous forms of the batch operators, for answers that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_jsonl(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON Lines files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_answers(answers: DataFrame, late: str = "1 hour") -> DataFrame:
    """One answer a (id, member): repeated deliveries within the watermark are dropped. answers: id, member, answer, ts."""
    return answers.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id", "member"])


def running_votes(answers: DataFrame) -> DataFrame:
    """Counts of each (id, answer) so far; operators.votes.majority over a snapshot gives the winners."""
    return answers.groupBy("id", "answer").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


def windowed_accuracy(answers: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Accuracy by member and window of event time; a window is final once the watermark has passed it. answers: ts, member, correct."""
    return answers.withWatermark("ts", late).groupBy(F.window("ts", width), "member").agg(F.count("*").alias("total"), F.avg(F.col("correct").cast("int")).alias("accuracy"))
