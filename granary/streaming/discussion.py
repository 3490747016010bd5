"""Discussions whose answers arrive over time: a keyed state a question, settled by event time.

A question's state holds the first answer of each member. It is settled when the watermark has passed the
question's deadline, `wait` after its first answer; so the result is that of the batch form over all rows,
in whatever order files or shards arrive, as long as none is later than the watermark allows. Needs the state store of RocksDB:
spark.sql.streaming.stateStore.providerClass = PROVIDER.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "id string, response string, votes long, members long, whole boolean, settled timestamp"


def settled(answers: DataFrame, members: int, wait: timedelta) -> DataFrame:
    """(id, response, votes, members, whole, settled): of each question the most frequent answer by its deadline; the batch form.

    answers: id, member, ord (the member's place), answer, ts; rows with a null but in answer don't count, a null answer is an empty one. Of a
    member's answers the first by ts counts, then the first by text. Answers after the deadline don't count. Of equally
    frequent answers that of the first member wins. whole: all members answered.
    """
    limit = F.col("first") + F.expr(f"INTERVAL {int(wait.total_seconds() * 1_000_000)} MICROSECOND")
    rows = _solid(answers)
    start = rows.groupBy("id").agg(F.min("ts").alias("first")).withColumn("settled", limit).drop("first")
    own = rows.join(start, "id").filter("ts <= settled").groupBy("id", "settled", "member").agg(F.min(F.struct("ts", "answer", "ord")).alias("a"))
    counted = own.groupBy("id", "settled", "a.answer").agg(F.count("*").alias("votes"), F.min("a.ord").alias("ord"))
    best = counted.groupBy("id", "settled").agg(F.min_by(F.struct("answer", "votes"), F.struct(-F.col("votes"), F.col("ord"), F.col("answer"))).alias("b"), F.sum("votes").alias("members"))
    return best.select("id", F.col("b.answer").alias("response"), "b.votes", "members", (F.col("members") >= members).alias("whole"), "settled")


def _solid(answers: DataFrame) -> DataFrame:
    kept = answers.filter("id is not null and member is not null and ord is not null and ts is not null")
    return kept.select(F.col("id").cast("string").alias("id"), F.col("member").cast("string").alias("member"), F.col("ord").cast("long").alias("ord"), F.coalesce("answer", F.lit("")).alias("answer"), "ts")


class _Question(StatefulProcessor):
    def __init__(self, members: int, wait: timedelta, forget: timedelta) -> None:
        self.members, self.wait, self.forget = members, wait, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answers = handle.getMapState("answers", "member string", "ts long, answer string, ord long")
        self.deadline = handle.getValueState("deadline", "ms long, us long")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in () if self.done.exists() else rows:
            for member, at, answer, order in zip(batch["member"], batch["ts"].astype("datetime64[us]").astype("int64"), batch["answer"], batch["ord"], strict=True):
                new = (int(at), answer, int(order))
                if not self.answers.containsKey((member,)) or new < tuple(self.answers.getValue((member,))):
                    self.answers.updateValue((member,), new)
                first = int(at) if first is None else min(first, int(at))
        if first is not None:
            us = first + int(self.wait.total_seconds() * 1_000_000)
            old = self.deadline.get() if self.deadline.exists() else None
            if old is None or us < old[1]:
                if old is not None:
                    self.handle.deleteTimer(old[0])
                self.deadline.update((us // 1000, us))
                self.handle.registerTimer(us // 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        us = self.deadline.get()[1]
        if self.done.exists():
            self.done.clear()
            self.deadline.clear()
            yield pd.DataFrame()
            return
        votes: dict[str, tuple[int, int]] = {}
        for _, (at, answer, order) in self.answers.iterator():
            if at <= us:
                n, least = votes.get(answer, (0, order))
                votes[answer] = (n + 1, min(least, order))
        answer, (n, _) = min(votes.items(), key=lambda x: (-x[1][0], x[1][1], x[0]))
        given = sum(n for n, _ in votes.values())
        self.answers.clear()
        self.done.update((True,))
        self.handle.registerTimer((us + int(self.forget.total_seconds() * 1_000_000)) // 1000 + 1)
        yield pd.DataFrame({"id": [key[0]], "response": [answer], "votes": [n], "members": [given], "whole": [given >= self.members], "settled": [pd.Timestamp(us, unit="us")]})

    def close(self) -> None:
        pass


def settling(answers: DataFrame, members: int, wait: timedelta, late: str = "1 hour", forget: timedelta = timedelta(days=30)) -> DataFrame:
    """The continuous form of settled(): a row a question once its deadline has passed; answers: a stream.

    State is a row a member of open questions, and a mark a settled one, by which answers after its deadline are known; the mark goes after
    `forget`, and an answer that comes still later begins the question anew. Rows more than `late` behind the latest one may be dropped.
    """
    marked = _solid(answers).withWatermark("ts", late)
    return marked.groupBy("id").transformWithStateInPandas(_Question(members, wait, forget), RESULT, outputMode="Append", timeMode="EventTime")
