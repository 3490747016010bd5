"""Answers that are remembered: a table of them by digest of what was asked, in versions.

Only questions that the table doesn't know go to the model, each once however many rows ask it; what it answers is
added to the table before rows get their answers, so a later run, or one after a lost driver, asks the rest only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.agents.client import ModelClient, speak
from granary.sources.snapshots import read_snapshot, write_snapshot
from granary.storage import stored_table

SCHEMA = "digest string, answer string"


def remembered(rows: DataFrame, factory: Callable[[], ModelClient], path: str, asked: tuple[str, ...] = ("member", "history")) -> DataFrame:
    """Appends the answer to `history` of each row, and adds err_msg and known (whether the answer was in the table at `path`).

    rows: member, history, and others. The columns in `asked` are the question, and all that the client sees. An answer with an
    error isn't remembered; it is asked again by the next run.
    """
    spark = rows.sparkSession
    question = stored_table(rows.withColumn("_digest", F.sha2(F.to_json(F.struct(*asked), {"ignoreNullFields": "false"}), 256)))
    known = read_snapshot(spark, path, SCHEMA).dropDuplicates(["digest"])
    new = question.select("_digest", *asked).join(known.select(F.col("digest").alias("_digest")), "_digest", "left_anti")
    once = new.groupBy("_digest").agg(F.first(F.struct(*asked)).alias("_q")).select("_digest", "_q.*")
    fresh = stored_table(speak(once, factory).select(F.col("_digest").alias("digest"), F.element_at("history", -1)["content"].alias("answer"), "err_msg"))
    good = fresh.filter("err_msg is null").select("digest", "answer")
    before = known.withColumns({"err_msg": F.lit(None).cast("string"), "known": F.lit(True)})
    answers = stored_table(before.unionByName(fresh.withColumn("known", F.lit(False))).join(question.select(F.col("_digest").alias("digest")), "digest", "left_semi"))
    if not good.isEmpty():
        write_snapshot(good, path, append=True)
    said = F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))
    joined = question.join(answers, F.col("_digest") == F.col("digest"))
    return joined.withColumn("history", F.array_append("history", said)).select(*rows.columns, "err_msg", "known")
