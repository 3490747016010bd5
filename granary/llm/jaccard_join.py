"""Exact Jaccard join of word n-gram sets by signature trees, and its connected components.

A text's set is its distinct n-word shingles (64-bit hashes). Texts with equal sets are one representative.
The join then goes in two steps over *groups* that hold every pair it can link:

1. Groups by small shingles. Two sets with similarity t or more share one of the k smallest hashes of either,
   k being the prefix length n - ceil(t n) + 1, or less: a hash among the smallest of the union is in both with
   probability t, so k stops where (1 - t) ** k is below 1e-12, beyond the chance of a hash collision. Only
   bitmaps travel. Each group is a signature tree: nodes hold OR- and AND-combined bitmaps and a range of sizes, up to
   one root. Batches of rows, as trees of their own, are matched with it by dual traversal; a pair of nodes goes when even its
   largest possible overlap is too small. What stays are candidate links, kept as connected stars.
2. Groups by candidate component. Here the full sets travel, once each; the same traversal verifies links
   exactly. Rows already in one component aren't compared again, so a group of m near copies costs about m
   comparisons, not m * m, and no pair is emitted but stars.

Groups above `most` (rows, or shingles in step 2) are dealt as tiles of bounded size: by size band, whose
neighbours alone can match, and by hash within a band; every pair of compatible parts meets in one tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import LOWER, byte_prefix, checkpointed, mix, segment_hash, sized, text_rows, tiles, with_ids, words_of

WIDEST = 1 << 14
FANOUT = 16
WALK = 1 << 21  # bytes of bitmaps that a level of a traversal compares at once


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row of a tile."""
    start, end, row = words_of(data, offsets)
    h = segment_hash(byte_prefix(LOWER[data]), start, end)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    n = max(0, len(h) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= words:
            yield np.unique(rolled[lo : hi - words + 1])
        elif hi > lo:
            x = np.full(1, hi - lo, np.uint64)
            for k in range(lo, hi):
                x = mix(x * np.uint64(0xC2B2AE3D27D4EB4F) + h[k])
            yield x
        else:
            yield np.zeros(0, np.uint64)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bit for each token: 2 to 4 bits of room a token, a power of two; halves fold onto each other by their low bits."""
    width = min(WIDEST, max(64, 1 << (2 * len(tokens) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[((tokens >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def prefix_length(n: int, percent: int, miss: float = 1e-12) -> int:
    """How many of a set's smallest hashes meet those of any set that it links to, but for a chance of `miss`; 0 for no miss."""
    sure = n - -(-percent * n // 100) + 1
    return min(sure, math.ceil(math.log(miss) / math.log(1 - percent / 100))) if percent < 100 and miss > 0 else sure


def _summary_rows(words: int, percent: int, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in tiles(batch.column("text")):
                n, s1, s2, tokens, bits = [], [], [], [], []
                for tokens_of in shingle_sets(data, offsets, words):
                    n.append(len(tokens_of))
                    digest = np.frombuffer(xxhash.xxh3_128_digest(tokens_of.tobytes()), np.int64)
                    s1.append(digest[0])
                    s2.append(digest[1])
                    tokens.append(tokens_of[: prefix_length(len(tokens_of), percent, miss)].view(np.int64) if len(tokens_of) else [])
                    bits.append(bitmap(tokens_of).tobytes() if len(tokens_of) else b"")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("uid").slice(i, j - i), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    ["uid", "n", "s1", "s2", "tokens", "bits"],
                )

    return run


def levels(size: np.ndarray, bits: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """A signature tree from its leaves up to one root: (first, last size, OR bitmap, AND bitmap) of the nodes of each level.

    Rows come sorted by size; a node stands for FANOUT neighbours of the level below.
    """
    out = [(size, size, bits, bits)]
    while len(out[-1][0]) > 1:
        first, last, any_of, all_of = out[-1]
        at = np.arange(0, len(first), FANOUT)
        out.append((first[at], last[np.minimum(at + FANOUT, len(first)) - 1], np.bitwise_or.reduceat(any_of, at, axis=0), np.bitwise_and.reduceat(all_of, at, axis=0)))
    return out


class Tree:
    """The signature tree of a group's rows that can be compared in bitmaps of one width."""

    def __init__(self, rows: np.ndarray, size: np.ndarray, bits: np.ndarray, least: float) -> None:
        """rows: their numbers, sorted by size; size of all rows; bits: a bitmap of 64-bit words for each of `rows`."""
        self.rows, self.bits, self.least = rows, bits, least
        self.size = size[rows]
        self.levels = levels(self.size, bits)

    def _fits(self, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
        """Whether pairs of nodes can hold a link, by the largest overlap that their sizes and bitmaps allow."""
        (least_a, most_a, any_a, all_a), (least_b, most_b, any_b, all_b) = a, b
        share = self.least / (1 + self.least)
        only_a = np.bitwise_count(all_a & ~any_b).sum(1, dtype=np.int64)
        only_b = np.bitwise_count(all_b & ~any_a).sum(1, dtype=np.int64)
        return np.minimum(most_a - only_a, most_b - only_b) >= share * (least_a + least_b) - 1e-9

    def candidates(self, chosen: np.ndarray, rest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a chosen row and one of the rest that can be links (both are flags of all rows), by dual traversal.

        Pairs of nodes are walked from the two roots down; a pair goes with all below it when its sizes are too far
        apart, no row of the rest is in it or its largest overlap is too small. The walk holds some 2 MB of bitmaps a level.
        """
        own = np.flatnonzero(chosen[self.rows])
        alive = [rest[self.rows]]
        if not len(own) or not alive[0].any():
            return
        left, right = levels(self.size[own], self.bits[own]), list(self.levels)
        for level in right[:-1]:
            alive.append(np.logical_or.reduceat(alive[-1], np.arange(0, len(level[0]), FANOUT)))
        height = max(len(left), len(right))
        left += [left[-1]] * (height - len(left))
        alive += [alive[-1]] * (height - len(right))
        right += [right[-1]] * (height - len(right))
        step = max(1, WALK // (8 * self.bits.shape[1] * FANOUT * FANOUT))
        fan = np.arange(FANOUT)

        def walk(at: int, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            a, b = left[at], right[at]
            near = alive[at][y] & (b[1][y] >= self.least * a[0][x] - 1e-9) & (a[1][x] >= self.least * b[0][y] - 1e-9)
            x, y = x[near], y[near]
            fit = self._fits(tuple(v[x] for v in a), tuple(v[y] for v in b))
            x, y = x[fit], y[fit]
            if not at:
                if len(x):
                    yield self.rows[own[x]], self.rows[y]
                return
            n, m = len(left[at - 1][0]), len(right[at - 1][0])
            for k in range(0, len(x), step):
                p = np.repeat(x[k : k + step, None] * FANOUT + fan, FANOUT, axis=1).ravel()
                q = np.tile(y[k : k + step, None] * FANOUT + fan, (1, FANOUT)).ravel()
                inside = (p < n) & (q < m)
                yield from walk(at - 1, p[inside], q[inside])

        yield from walk(height - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps narrowed to a number of 64-bit words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def components(size: np.ndarray, maps: list[bytes], percent: int, sets: list[np.ndarray] | None = None, seeds: int = 128) -> np.ndarray:
    """Component of each row (its smallest row number) under candidate links, or under true ones if sets are given.

    Rows are matched in batches with all rows that had no turn yet: first those that a link has reached, one
    component at a time and only with rows outside it, so that rows of a component are hardly compared with one another;
    when none is left, a batch of rows that nothing has reached. Every pair of rows of different components is
    decided once.
    """
    n = len(size)
    order = np.argsort(size, kind="stable")
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    size, maps = size[order], [maps[i] for i in order]
    sets = [sets[i] for i in order] if sets is not None else None
    widths = np.array([len(m) for m in maps])
    # a tree for each width: rows of that width and, folded, of the wider ones that sizes allow for
    reach = 2 ** math.ceil(math.log2(100 / percent))
    trees: list[tuple[Tree, np.ndarray, np.ndarray]] = []
    for w in np.unique(widths):
        members = (widths >= w) & (widths <= reach * w)
        rows = np.flatnonzero(members)
        bits = np.zeros((len(rows), w // 8), np.uint64)
        for wide in np.unique(widths[rows]):
            at = np.flatnonzero(widths[rows] == wide)
            bits[at] = fold(np.frombuffer(b"".join(maps[i] for i in rows[at]), np.uint64).reshape(len(at), -1), w // 8)
        trees.append((Tree(rows, size, bits, percent / 100), widths == w, members))
    label = np.arange(n)
    done, reached = np.zeros(n, bool), np.zeros(n, bool)
    while not done.all():
        waiting = np.flatnonzero(reached & ~done)
        if len(waiting):
            one = label[waiting[0]]
            batch = waiting[label[waiting] == one][:seeds]
            rest = ~done & (label != one)
        else:
            batch = np.flatnonzero(~done)[:seeds]
            rest = ~done
        chosen = np.zeros(n, bool)
        chosen[batch] = True
        for tree, own, members in trees:
            # pairs of one width belong to its own tree, pairs of two to that of the smaller
            for side, other in ((own, members), (members & ~own, own)):
                for a, b in tree.candidates(chosen & side, rest & other):
                    _link(a, b, label, reached, sets, percent)
        done |= chosen
    least = np.full(n, n)
    np.minimum.at(least, label, order)
    return least[label][back]


def _link(a: np.ndarray, b: np.ndarray, label: np.ndarray, reached: np.ndarray, sets: list[np.ndarray] | None, percent: int) -> None:
    """Merges the components of linked pairs; a pair within one component is passed over undecided."""
    while True:
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return
        # one pair a row at a time: what it merges decides many of the others
        first = np.unique(b, return_index=True)[1]
        x, y = a[first], b[first]
        a, b = np.delete(a, first), np.delete(b, first)
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            if label[p] != label[q] and (sets is None or linked(sets[p], sets[q], percent)):
                lo, hi = sorted((label[p], label[q]))
                label[label == hi] = lo
                reached[p] = reached[q] = True


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    common = int((q[at] == p).sum())
    return 100 * common >= percent * (len(p) + len(q) - common)


def _group_rows(percent: int, exact: bool):
    """Stars (member, smallest member) of the components of each group; rows come sorted by group."""

    def settle(uid: list, n: list, bits: list, sets: list) -> tuple[np.ndarray, np.ndarray] | None:
        ids = np.array(uid, np.int64)
        first = np.unique(ids, return_index=True)[1]  # a row can reach a tile twice
        if len(first) < 2:
            return None
        order = first[np.argsort(ids[first])]
        ids = ids[order]
        label = components(np.array(n, np.int64)[order], [bits[i] for i in order], percent, [sets[i] for i in order] if exact else None)
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return ids[moved], ids[label[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, ([], [], [], [])
        out: tuple[list, list] = ([], [])

        def close() -> None:
            if len(held[0]) > 1 and (found := settle(*held)) is not None:
                out[0].append(found[0])
                out[1].append(found[1])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("group", "uid", "n")] + [batch.column("bits").to_pylist()]
            tokens = batch.column("tokens").to_pylist() if exact else [None] * batch.num_rows
            for g, uid, n, bits, blob in zip(*columns, tokens, strict=True):
                if g != group:
                    close()
                    group, held = g, ([], [], [], [])
                held[0].append(uid)
                held[1].append(n)
                held[2].append(bits)
                held[3].append(np.frombuffer(blob, np.uint64) if exact else None)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b"])
                out = ([], [])
        close()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b"])

    return run


def dealt(rows: DataFrame, weight: str, most: int, percent: int) -> DataFrame:
    """Rows with their group, groups above `most` dealt as tiles.

    rows: group, uid, n, and others. A row of a large group goes to the tiles of its part with every part of its own
    size band and of the two next to it; sizes two bands apart differ by more than the similarity allows.
    """
    totals = rows.groupBy("group").agg(F.sum(weight).alias("weight_of_group"), F.count("*").alias("rows_of_group"))
    totals = checkpointed(totals.filter("rows_of_group > 1"))
    small = rows.join(totals.filter(F.col("weight_of_group") <= most).select("group"), "group")
    large = totals.filter(F.col("weight_of_group") > most).select("group")
    if large.isEmpty():
        return small
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(min(percent, 99) / 100)).cast("long")
    banded = rows.join(large, "group").withColumn("band", band)
    parts = checkpointed(banded.groupBy("group", "band").agg(F.greatest(F.lit(1), F.ceil(F.sum(weight) * 2 / most)).cast("long").alias("parts")))
    for step, name in ((0, "own"), (1, "above"), (-1, "below")):
        banded = banded.join(parts.select("group", (F.col("band") - step).alias("band"), F.col("parts").alias(name)), ["group", "band"], "left")
    part = F.pmod(F.xxhash64("uid"), F.col("own"))
    spread = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)).otherwise(F.array().cast("array<bigint>"))
    banded = banded.withColumn("part", part)
    one = lambda b1, p1, b2, p2: F.xxhash64("group", b1, p1, b2, p2)
    b, p = F.col("band"), F.col("part")
    tiles_of = F.concat(
        spread(F.col("own"), lambda j: one(b, F.least(p, j), b, F.greatest(p, j))),
        spread(F.coalesce("above", F.lit(0)), lambda j: one(b, p, b + 1, j)),
        spread(F.coalesce("below", F.lit(0)), lambda j: one(b - 1, j, b, p)),
    )
    return small.unionByName(banded.withColumn("group", F.explode(tiles_of)).select(*small.columns))


def connected(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(uid, root) of every vertex but the roots: the smallest vertex that edges (a, b) reach.

    Alternates large-star and small-star steps; each halves the distance to the smallest vertex. Minima are stored
    before they are joined, so that AQE can split the edges of a vertex with very many. The loop ends when the
    edges no longer change.
    """
    edges = checkpointed(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = checkpointed(large)
        least = checkpointed(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        edges = checkpointed(small)
        # edges are distinct, so the exclusive or of 128 bits an edge tells whether any has changed
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())
        if now == state:
            return edges.select(F.col("a").alias("uid"), F.col("b").alias("root"))
        state = now
    raise RuntimeError("components did not settle")


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in tiles(batch.column("text")):
                found = list(shingle_sets(data, offsets, words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("group").slice(i, j - i), batch.column("uid").slice(i, j - i), pa.array([len(x) for x in found], pa.int64()), pa.array([bitmap(x).tobytes() for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())],
                    ["group", "uid", "n", "bits", "tokens"],
                )

    return run


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, most_rows: int = 4096, most_shingles: int = 2_000_000, miss: float = 1e-12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (smallest id reachable by links) of every row of docs.

    Two texts link when 100 * |A and B| >= percent * |A or B| for their sets of `words`-word shingles, words being
    runs of other characters than ASCII white space with A-Z lower-cased; a text with fewer words has its whole sequence as its
    one shingle. Null, empty and wordless texts have an empty set and link with nothing. Rows with
    repeated or null ids are vertices of their own; component_id is then the smallest id among the
    component's rows. Other columns are ignored. miss is the chance that the grouping by small hashes overlooks a
    pair (its order of magnitude is that of a hash collision); 0 takes whole prefixes, at several times the shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = text_rows(docs, id_col, text_col)
    own_ids = "id" not in rows.columns
    summary = checkpointed(rows.select("uid", "text").mapInArrow(_summary_rows(words, percent, miss), "uid long, n long, s1 long, s2 long, tokens array<long>, bits binary"))
    full = summary.filter("n > 0")
    # stored, as a join with a stored side is a plain shuffle on both sides, which AQE splits where a set has many copies
    reps = checkpointed(full.groupBy("s1", "s2").agg(F.min("uid").alias("rep")))
    heads = full.join(reps.select(F.col("rep").alias("uid")), "uid")

    by_token = heads.select("uid", "n", F.explode("tokens").alias("group"), "bits")
    stars = dealt(by_token.withColumn("one", F.lit(1)), "one", most_rows, percent).select("group", "uid", "n", "bits")
    candidates = stars.repartition("group").sortWithinPartitions("group").mapInArrow(_group_rows(percent, False), "a long, b long")
    blocks = connected(candidates)
    blocks = blocks.select("uid", F.col("root").alias("group")).unionAll(blocks.select(F.col("root").alias("uid"), F.col("root").alias("group")).distinct())
    blocks = checkpointed(blocks)
    sets = rows.select("uid", "text").join(sized(blocks), "uid").select("group", "uid", "text").mapInArrow(_set_rows(words), "group long, uid long, n long, bits binary, tokens binary")
    weighed = checkpointed(blocks.join(summary.select("uid", "n"), "uid"))
    large = not weighed.groupBy("group").agg(F.sum("n").alias("w")).filter(F.col("w") > most_shingles).isEmpty()
    tiled = dealt(checkpointed(sets), "n", most_shingles, percent).select("group", "uid", "n", "bits", "tokens") if large else sets
    links = tiled.repartition("group").sortWithinPartitions("group").mapInArrow(_group_rows(percent, True), "a long, b long")
    roots = connected(links) if large else links.select(F.col("a").alias("uid"), F.col("b").alias("root"))

    found = summary.join(reps, ["s1", "s2"], "left").select("uid", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("uid")).alias("rep"))
    found = found.join(roots.select(F.col("uid").alias("rep"), "root"), "rep", "left").select("uid", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("root"))
    if own_ids:
        return found.select(F.col("uid").cast(kind).alias(id_col), "n_shingles", F.col("root").cast(kind).alias("component_id"))
    named = found.join(with_ids(rows, kind).select("uid", "id"), "uid")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return named.join(least, "root").select(F.col("id").alias(id_col), "n_shingles", "component_id")
