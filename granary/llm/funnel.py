"""Ordered funnels over events: how far each attempt gets, and how long its steps take.

Funnels are rows (funnel, step, kind, excluded kinds), and one loop serves all of them: a round joins the active attempts of
every funnel with the rows of its step, looks up their next events, and keeps the attempts that reach them. The
survivors are written to the shared folder, which cuts the lineage, and are the next round's frontier.

An attempt always stands at an event, so its successors are looked up once an event instead of once an attempt and round. Distinct
events are cut into buckets of equal size by ranges of client and time; a client of any size is spread over many of
them. Each bucket is read once from its end, with the earliest later event of each kind at hand. A client that goes on in
later buckets gets the rest from the first events of each kind there: a row a bucket, reduced by min_by. So a dense
stretch of one client makes neither pairs nor a large group.

Order statistics of a client's step times are found digit by digit, from histograms of at most 2,048 counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import sized, stored_table


@dataclass(frozen=True)
class Funnel:
    name: str
    steps: tuple[str, ...]
    excluded: tuple[str, ...] = ()


#: Fixed values.
FUNNELS = [Funnel("A", ("view", "click", "view", "purchase"), ("error",)), Funnel("B", ("signup", "view", "click", "purchase"), ("error",)), Funnel("C", ("click", "click", "purchase", "view"), ("signup",))]
WITHIN = 30 * 60 * 1_000_000
#: Bits of a step time that each round of the order statistics settles.
DIGIT = 11


def microseconds(at: Column, kind: str) -> Column:
    """A time as a whole number; a timestamp without a zone keeps its own clock, whatever the session's zone."""
    if kind == "timestamp_ntz":
        day, time = F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long"), F.hour(at) * 3600 + F.minute(at) * 60
        return (day * 86_400 + time) * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")
    return F.unix_micros(at) if kind == "timestamp" else at.cast("long")


def definitions(spark: SparkSession, funnels: list[Funnel]) -> tuple[DataFrame, list[str]]:
    """(rows of funnel, step, kind, excluded: kinds as places in the list; the kinds)."""
    kinds = sorted({k for f in funnels for k in (*f.steps, *f.excluded)})
    rows = [(f.name, s, kinds.index(k), sorted(map(kinds.index, f.excluded))) for f in funnels for s, k in enumerate(f.steps, 1)]
    return spark.createDataFrame(rows, "funnel string, step int, kind int, excluded array<int>"), kinds


def _successor_rows(n_kinds: int):
    """Scans a bucket sorted by client and falling time: each event with the earliest later event of each kind.

    Rows without a time come last: the bucket's first client and its last, with the first event of each kind that they have in it.
    """
    none = np.iinfo(np.int64).max
    names = ["bucket", "client", "kind", "at", "next"]

    def firsts(kind: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The earliest time of each kind; times fall."""
        out = np.full(n_kinds, none)
        out[kind] = at  # of equal places the last value stays
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TaskContext.get().partitionId()
        client, head, of = None, None, None
        # events of the client so far that later rows can need: of each kind the earliest before the last moment, and that moment
        old_kind, old_at = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            clients = batch.column("client")
            of = clients.type
            if client is not None and clients[0].as_py() != client:
                head = head or (client, firsts(old_kind, old_at))
                old_kind, old_at = old_kind[:0], old_at[:0]
            known = len(old_kind)
            kind = np.r_[old_kind, batch.column("kind").to_numpy(zero_copy_only=False)]
            at = np.r_[old_at, batch.column("at").to_numpy(zero_copy_only=False)]
            codes = clients.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            other = np.r_[np.zeros(known, bool), True, codes[1:] != codes[:-1]]
            other[0], other[known] = True, not known
            n = len(kind)
            place = np.arange(n)
            opened = np.maximum.accumulate(np.where(other, place, 0))  # first row of the client
            moment = np.maximum.accumulate(np.where(other | np.r_[True, at[1:] != at[:-1]], place, 0))  # first row of the client's moment
            nexts = np.full((n, n_kinds), none)
            for k in range(n_kinds):
                seen = np.r_[-1, np.maximum.accumulate(np.where(kind == k, place, -1))]  # last place of the kind before a row
                found = seen[moment]
                ok = found >= opened
                nexts[ok, k] = at[found[ok]]
            if head is None and opened[-1] > 0:
                stop = int(np.flatnonzero(other)[1])
                head = (clients[0].as_py(), firsts(kind[:stop], at[:stop]))
            client = clients[-1].as_py()
            lo, mid = int(opened[-1]), int(moment[-1])
            past = firsts(kind[lo:mid], at[lo:mid])
            order = np.argsort(-past, kind="stable")
            order = order[past[order] != none]
            old_kind, old_at = np.r_[order, kind[mid:]].astype(np.int64), np.r_[past[order], at[mid:]]
            own = nexts[known:]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * n_kinds), pa.array(own.ravel(), mask=(own == none).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), bucket, np.int32)), clients, batch.column("kind"), batch.column("at"), lists], names)
        if client is not None:
            tail = (client, firsts(old_kind, old_at))
            ends = [tail] if head is None or head[0] == client else [head, tail]
            lists = pa.array([[None if x == none else int(x) for x in first] for _, first in ends], pa.list_(pa.int64()))
            empty = [pa.array([None] * len(ends), t) for t in (pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(ends), pa.int32()), pa.array([c for c, _ in ends], of), *empty, lists], names)

    return run


def successors(events: DataFrame, n_kinds: int, within: int) -> DataFrame:
    """(client, kind, at, next): each event and, by kind, its client's earliest later event at most `within` after it.

    events: client, kind (a place in the list of kinds), at (microseconds); distinct and without nulls. Stored.
    """
    kind = events.schema["client"].dataType.simpleString()
    ranged = events.repartitionByRange("client", F.desc("at"), "kind").sortWithinPartitions("client", F.desc("at"), "kind")
    scanned = stored_table(ranged.mapInArrow(_successor_rows(n_kinds), f"bucket int, client {kind}, kind int, at long, next array<long>"))
    # a client that spans buckets has its late events in the lower ones
    heads = scanned.filter("at is null")
    earlier = Window.partitionBy("client").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    near = [F.min_by(F.col("next")[k], F.when(F.col("next")[k].isNotNull(), -F.col("bucket"))).over(earlier) for k in range(n_kinds)]
    rest = heads.select("bucket", "client", F.array(*near).alias("rest")).filter("exists(rest, x -> x is not null)")
    joined = scanned.filter("at is not null").join(sized(stored_table(rest)), ["bucket", "client"], "left")
    soon = lambda x: F.when(x <= F.col("at") + within, x)
    nexts = F.array(*(soon(F.coalesce(F.col("next")[k], F.col("rest")[k])) for k in range(n_kinds)))
    return joined.select("client", "kind", "at", nexts.alias("next"))


def nth_smallest(times: DataFrame, keys: list[str], per_cent: int, most: int) -> DataFrame:
    """(keys, value): the ceil(per_cent * n / 100)-th smallest of the n values of each group, the values counted with `n`.

    times: keys, value (0 to most), n. Each round counts the next digit of the values that are left and keeps the one
    digit that holds the place sought; a group's histogram has at most 2 ** DIGIT rows, whatever its size.
    """
    left, place = times.withColumn("rest", F.col("value")), None
    for shift in range((max(1, most.bit_length() - 1) // DIGIT) * DIGIT, -1, -DIGIT):
        digit = F.shiftright("rest", shift)
        counts = left.groupBy(*keys, digit.alias("digit")).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        summed = counts.withColumn("upto", upto)
        if place is None:
            sought = F.floor((F.max("upto") * per_cent + 99) / 100).cast("long")
            total = summed.groupBy(*keys).agg(sought.alias("place"))
        else:
            total = place
        held = summed.join(total, keys).filter("upto >= place").groupBy(*keys).agg(F.min(F.struct("digit", "upto", "n", "place")).alias("h"))
        place = held.select(*keys, (F.col("h.place") - F.col("h.upto") + F.col("h.n")).alias("place"), F.col("h.digit").alias("digit"))
        place = stored_table(place)
        left = left.withColumn("digit", digit).join(place.select(*keys, "digit"), [*keys, "digit"])
        left = left.withColumn("rest", F.col("rest") - F.shiftleft("digit", shift)).drop("digit")
        place = place.drop("digit")
    return left.groupBy(*keys).agg(F.first("value").alias("value"))


def count_funnels(clicks: DataFrame, funnels: list[Funnel] | None = None, within: int = WITHIN, per_cent: int = 90, client_col: str = "client_id", kind_col: str = "kind", time_col: str = "arrived_at") -> DataFrame:
    """(funnel, client_id, n1 ... nL, deepest, t2 ... tL, same_depth) of every funnel and client with attempts; L: the most steps.

    Events are the distinct rows of client, kind and time without a null. Each event of a funnel's first kind starts an
    attempt. Its next step is the client's earliest event of that kind later than the step before; it is reached unless it comes more than `within`
    microseconds after the first step, or an event of an excluded kind lies after the step before and not after it; else the attempt
    ends. nK counts attempts that reach step K, deepest is the last step that any reached, tK the ceil(per_cent * n / 100)-th smallest time
    from step K - 1 to K, null if none; same_depth counts the clients of that funnel with equal deepest. Steps that a shorter
    funnel doesn't have are 0 and null. No events, no rows; extra columns don't matter.
    """
    funnels = FUNNELS if funnels is None else funnels
    spark = clicks.sparkSession
    defined, kinds = definitions(spark, funnels)
    steps = max((len(f.steps) for f in funnels), default=0)
    place = F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))))
    at = microseconds(F.col(time_col), clicks.schema[time_col].dataType.simpleString())
    events = clicks.filter(F.col(kind_col).isin(kinds)).select(F.col(client_col).alias("client"), place[F.col(kind_col)].alias("kind"), at.alias("at"))
    events = stored_table(events.filter("client is not null and at is not null").distinct())
    table = stored_table(successors(events, len(kinds), within))
    rows = lambda step: F.broadcast(defined.filter(F.col("step") == step))  # noqa: E731  # a row a funnel
    begun = table.join(rows(1).select("funnel", "kind"), "kind")
    reached = [begun.groupBy("funnel", "client").agg(F.count("*").alias("n")).withColumn("step", F.lit(1))]
    frontier = begun.select("funnel", "client", F.col("at").alias("start"), "at", "next")
    times = []
    for step in range(2, steps + 1):
        moved = frontier.join(rows(step).select("funnel", "kind", "excluded"), "funnel").withColumn("to", F.get("next", F.col("kind")))
        barred = F.array_min(F.transform("excluded", lambda k: F.get("next", k)))
        arrived = moved.filter(F.col("to").isNotNull() & (F.col("to") - F.col("start") <= within) & (barred.isNull() | (barred > F.col("to"))))
        survivors = stored_table(arrived.select("funnel", "client", "start", F.col("to").alias("at"), "kind", (F.col("to") - F.col("at")).alias("took")))
        counted = survivors.groupBy("funnel", "client", "took").agg(F.count("*").alias("n")).withColumn("step", F.lit(step))
        times.append(counted)
        if step < steps:
            frontier = survivors.drop("took").join(table, ["client", "kind", "at"]).select("funnel", "client", "start", "at", "next")
    keys = ["funnel", "client", "step"]
    if times:
        took = times[0]
        for more in times[1:]:
            took = took.unionByName(more)
        took = stored_table(took.select(*keys, F.col("took").alias("value"), "n"))
        late = nth_smallest(took, keys, per_cent, within)
        later = took.groupBy(*keys).agg(F.sum("n").alias("n")).join(late, keys, "left")
        counts = reached[0].select(*keys, "n", F.lit(None).cast("long").alias("value")).unionByName(later)
    else:
        counts = reached[0].select(*keys, "n", F.lit(None).cast("long").alias("value"))
    wide = counts.groupBy("funnel", "client").agg(
        *(F.coalesce(F.max(F.when(F.col("step") == s, F.col("n"))), F.lit(0)).alias(f"n{s}") for s in range(1, steps + 1)), F.max("step").alias("deepest"),
        *(F.max(F.when(F.col("step") == s, F.col("value"))).alias(f"t{s}") for s in range(2, steps + 1)),
    )
    wide = stored_table(wide)
    # a row a funnel and step
    alike = F.broadcast(wide.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth")))
    return wide.join(alike, ["funnel", "deepest"]).select("funnel", F.col("client").alias(client_col), *(f"n{s}" for s in range(1, steps + 1)), "deepest", *(f"t{s}" for s in range(2, steps + 1)), "same_depth")
