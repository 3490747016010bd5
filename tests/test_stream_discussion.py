"""Discussions over time: shards in any order give the batch result."""

import datetime
import random

import pytest
from granary.streaming import discussion

SCHEMA = "id string, member string, ord long, answer string, ts timestamp"
START = datetime.datetime(2024, 1, 1)


def answers(seed, n=120):
    rng = random.Random(seed)
    rows = [(f"q{rng.randint(0, 14)}", m, "abc".index(m), rng.choice(["x", "y", "z", None]), START + datetime.timedelta(seconds=rng.randint(0, 1500))) for m in rng.choices("abc", k=n)]
    return [*rows, rows[0], (None, "a", 0, "x", START), ("q1", None, 0, "x", START), ("q1", "a", 0, "x", None)]


def plain(rows):
    return sorted((r.id, r.response, r.votes, r.members, r.whole, r.settled) for r in rows)


def brute(rows, members, wait):
    out = []
    rows = [(i, m, o, a or "", t) for i, m, o, a, t in rows if None not in (i, m, o, t)]
    for q in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == q]
        end = min(r[4] for r in own) + wait
        first = {}
        for _, m, o, a, t in sorted(own, key=lambda r: (r[4], r[3], r[2])):
            if t <= end:
                first.setdefault(m, (a, o))
        votes = {}
        for a, o in first.values():
            votes.setdefault(a, []).append(o)
        best = min(votes, key=lambda a: (-len(votes[a]), min(votes[a]), a))
        out.append((q, best, len(votes[best]), len(first), len(first) >= members, end))
    return sorted(out)


WAIT = datetime.timedelta(seconds=400)


def test_the_batch_form_counts_first_answers_until_the_deadline(spark):
    rows = answers(1)
    assert plain(discussion.settled(spark.createDataFrame(rows, SCHEMA), 3, WAIT).collect()) == brute(rows, 3, WAIT)
    assert discussion.settled(spark.createDataFrame([], SCHEMA), 3, WAIT).count() == 0


@pytest.mark.parametrize(("seed", "late"), [(1, "1 hour"), (2, "1 hour"), (None, "1 second")])
def test_shards_in_any_order_give_the_batch_result(spark, tmp_path, seed, late):
    """Shards arrive one a batch, out of order, or in order and with questions settled long before their last answer; a last row
    moves the watermark past all deadlines."""
    rows = answers(1)
    want = brute(rows, 3, WAIT)
    if seed is None:
        rows = sorted(rows, key=lambda r: (r[4] is not None, r[4] or START))
        shards = [rows[k : k + 25] for k in range(0, len(rows), 25)]
    else:
        shards = [rows[k::6] for k in range(6)]
        random.Random(seed).shuffle(shards)
    folder = tmp_path / "in"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", discussion.PROVIDER)
    try:
        folder.mkdir()
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
        end = [("end", "a", 0, "x", START + datetime.timedelta(days=k)) for k in (1, 2)]
        query = None
        for number, shard in enumerate([*shards, end[:1], end[1:]]):
            spark.createDataFrame(shard, SCHEMA).coalesce(1).write.mode("append").json(str(folder))
            query = (
                discussion.settling(stream, 3, WAIT, late=late).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
                .outputMode("append").trigger(availableNow=True).start()
            )
            query.awaitTermination()  # a restart a shard: the state comes from its checkpoint
            assert query.exception() is None, number
        got = plain(spark.read.parquet(str(tmp_path / "out")).collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert [r for r in got if r[0] != "end"] == want
