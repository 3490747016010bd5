"""Exact substring dedup over suffixes, distributed by content-defined anchors.

A repeated string of `length` bytes is a pair of suffixes with a common prefix of that length, which
is what a longest-previous-factor (LPF) array of at least `length` says. One suffix array over
the whole corpus can't be sharded, so suffixes are first brought to where their equals are:

1. Every window of `length` bytes picks one anchor, the position of the smallest hash among its
   grams (a minimizer). Equal windows pick the same anchor at the same offset. About 1.5 % of
   positions are anchors. Each carries a hash of its gram and of its *context*, the union of the
   windows that can pick it.
2. Anchors are counted by gram with map-side combining. A gram seen once has no repeated window. A
   gram with a single context, seen more than once, has all its windows repeated: the inside of
   copies is settled without moving text.
3. What is left are edges of copies: a gram with several contexts. One context of each kind goes to
   blocks of whole gram groups; each block builds the suffix order of its positions, truncated at
   `length`, by prefix doubling, and the common prefixes of neighbours in it. The previous and the next smaller position in
   suffix order, with the least common prefix on the way to them, give the LPF array; the same of the places read backwards says
   what starts later. Where a factor reaches `length`, an equal window starts elsewhere.
   In a task, a gram with over CONTEXTS contexts (1 MB) is first cut: an equal window also shares the half of it that lies before the
   gram, or the half after it, so contexts are dealt by either half, and again, until groups are small or their windows are all equal.
4. A gram with more than `hot` different contexts (about 7 MB of them) is cut like that by a shuffle, once. A half that still has
   more than `crowded` contexts (about 5 MB) isn't collected: its windows are hashed and counted by a shuffle with map-side combining.

Nothing is capped; the union of the spans is exact up to 64-bit (in blocks: no) hash equality.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import byte_prefix, checkpointed, mix, powers, rolling_hash, segment_hash, sliding_minimum, stored_table, text_rows, tiles, with_ids

_PLACE = np.uint64((1 << 24) - 1)
CONTEXTS = 3_000
SPANS = "array<struct<start:int,end:int>>"


def _geometry(length: int) -> tuple[int, int]:
    """Bytes of a gram, and how far a context reaches to either side of it."""
    gram = max(1, length // 3)
    return gram, length - gram


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, position in the row, gram hash, context hash) of the anchors of a tile."""
    gram, side = _geometry(length)
    none = np.zeros(0, np.int64)
    if not (np.diff(offsets) >= length).any():
        return none, none, none, none
    prefix = byte_prefix(data)
    grams = rolling_hash(prefix, gram) * np.uint64(0x9FB21C651E98DF25)
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0x9FB21C651E98DF25)
    picked = np.zeros(len(data), bool)
    step = int(_PLACE)
    # positions fit 24 bits: longer rows are walked in overlapping pieces
    for lo in range(0, len(grams), step - side):
        part = grams[lo : lo + step]
        if len(part) <= side:
            continue
        packed = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        least = sliding_minimum(packed, side + 1) & _PLACE
        valid = np.zeros(len(least) + 1, np.int32)
        first = np.maximum(offsets[:-1] - lo, 0)
        last = np.minimum(offsets[1:] - length + 1 - lo, len(least))
        ok = last > first
        np.add.at(valid, first[ok], 1)
        np.add.at(valid, last[ok], -1)
        picked[lo + least[np.cumsum(valid[:-1]) > 0].astype(np.int64)] = True
    at = np.flatnonzero(picked)
    row = np.searchsorted(offsets, at, "right") - 1
    start = np.maximum(offsets[row], at - side)
    end = np.minimum(offsets[row + 1], at + gram + side)
    context = segment_hash(prefix, start, end) ^ mix((at - start).astype(np.uint64) + np.uint64(1))
    return row, at - offsets[row], mix(grams[at]), context


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column("uid").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in tiles(batch.column("text")):
                row, pos, gram, context = find_anchors(data, offsets, length)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(uids[i:j][row]), pa.array(pos.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], ["uid", "pos", "gram", "context"])

    return run


def _context_rows(length: int):
    """Contexts of the flagged anchors: (gram, uid, start in the row, own, place of the gram in it, bytes)."""
    gram, side = _geometry(length)
    names = ["gram", "uid", "start", "own", "at", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column("uid").to_pylist()
            texts = batch.column("text")
            out: list[list] = [[] for _ in names]
            for k, flags in enumerate(batch.column("flags").to_pylist()):
                text = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
                for x in flags:
                    start = max(0, x["pos"] - side)
                    for o, v in zip(out, (x["gram"], uids[k], start, x["own"], x["pos"] - start, text[start : x["pos"] + gram + side]), strict=True):
                        o.append(v)
                if len(out[0]) >= 4096:
                    yield _batch(out)
                    out = [[] for _ in names]
            if out[0]:
                yield _batch(out)

    def _batch(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)

    return run


def _half_rows(length: int):
    """Contexts of a crowded gram under new grams: the bytes before it, and those after it, that half of the windows share.

    A window that holds the gram has `side` bytes beside it, so at least half of them on one side.
    """
    gram, side = _geometry(length)
    half = -(-side // 2)
    names = ["gram", "uid", "start", "own", "at", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for g, uid, start, own, at, text in zip(*(batch.column(c).to_pylist() for c in ("gram", "uid", "start", "own", "at", "bytes")), strict=True):
                end = at + gram
                for which, shared, lo, hi in ((b"<", text[max(0, at - half) : at], 0, at - half + length), (b">", text[end : end + half], max(0, at - (side - half)), len(text))):
                    cut = text[lo:hi]
                    if len(shared) == half and len(cut) >= length:
                        key = hashlib.blake2b(which + g.to_bytes(8, "little", signed=True) + shared, digest_size=8).digest()
                        for o, v in zip(out, (int.from_bytes(key, "little", signed=True), uid, start + lo, own, at - lo, cut), strict=True):
                            o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)

    return run


def truncated_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(rank of data[s : s + length] in suffix order for each start, ranks of all places by shorter spans); equal strings have equal ranks.

    Prefix multiplying: ranks of a span give those of three spans in a row, or of two where three don't fit 63 bits.
    """
    n = len(data)
    span = min(8, 1 << (length.bit_length() - 1))
    padded = np.concatenate([data, np.zeros(span, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(span):
        key = (key << np.uint64(8)) | padded[j : j + n]
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    levels = [(1, data), (span, rank.astype(np.uint32))] if span > 1 else [(1, data)]
    base = np.uint64(n + 1)
    times = 3 if (n + 1) ** 3 < 1 << 63 else 2
    while span * times <= length:
        key = rank.copy()
        for k in range(1, times):
            key *= base
            key[: max(0, n - k * span)] += rank[k * span :]
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        span *= times
        levels.append((span, rank.astype(np.uint32)))
    # the last step covers the rest with spans that may overlap
    key = rank[starts]
    for shift in [min(span, length - span), length - span][3 - times :]:
        key = key * base + rank[starts + shift]
    return np.unique(key, return_inverse=True)[1], levels


def common_prefixes(starts: np.ndarray, same: np.ndarray, levels: list[tuple[int, np.ndarray]], length: int) -> np.ndarray:
    """The common prefix, up to length, of each place in suffix order with the one before it; same: their truncated ranks are equal."""
    out = np.where(same, length, 0)
    i = np.flatnonzero(~same)
    i = i[i > 0]
    a, b = starts[i - 1].copy(), starts[i].copy()
    n = len(levels[0][1])
    found = np.zeros(len(i), np.int64)
    step = length
    for span, rank in reversed(levels):
        for _ in range(-(-step // span)):
            inside = np.maximum(a, b) + span <= n
            equal = np.zeros(len(i), bool)
            equal[inside] = rank[a[inside]] == rank[b[inside]]
            if not equal.any():
                break
            found += span * equal
            a += span * equal
            b += span * equal
        step = span
    out[i] = np.minimum(found, length)
    return out


def _towards(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The common prefix with the nearest suffix before each, in suffix order, that has a smaller place; 0 without one.

    Links lead to the suffix before; those that end at no smaller place take over the links of where they end, and
    with them the least common prefix on the way.
    """
    link, least = np.arange(len(place)) - 1, lcp.copy()
    open_ = np.flatnonzero((link >= 0) & (place[link] >= place))
    while len(open_):
        via = link[open_]
        least[open_] = np.minimum(least[open_], least[via])
        link[open_] = link[via]
        to = link[open_]
        open_ = open_[(to >= 0) & (least[open_] > 0) & (place[to] >= place[open_])]
    return np.where((link >= 0) & (place[link] < place), least, 0)


def previous_factors(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix in suffix order: its longest common prefix with one at a smaller place.

    That is the one of the previous or of the next smaller place in suffix order. lcp: common prefixes with the suffix before.
    A place that is given twice is no match for itself.
    """
    before = _towards(place, lcp)
    after = _towards(place[::-1], np.r_[lcp[1:], 0][::-1])[::-1]
    return np.maximum(before, after)


def factors(rank: np.ndarray, uid: np.ndarray, pos: np.ndarray, starts: np.ndarray, levels: list[tuple[int, np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Per suffix, the longest previous and the longest later factor, truncated at length."""
    order = np.lexsort((pos, uid, rank))
    r, u, p = rank[order], uid[order], pos[order]
    in_text = np.lexsort((p, u))
    moved = np.r_[True, (u[in_text][1:] != u[in_text][:-1]) | (p[in_text][1:] != p[in_text][:-1])]
    place = np.empty(len(r), np.int64)
    place[in_text] = np.cumsum(moved)
    lcp = common_prefixes(starts[order], np.r_[False, r[1:] == r[:-1]], levels, length)
    previous, later = np.empty(len(r), np.int64), np.empty(len(r), np.int64)
    previous[order] = previous_factors(place, lcp)
    later[order] = previous_factors(-place, lcp)
    return previous, later


def small_groups(parts: list[tuple], low: int, high: int, length: int, most: int) -> Iterator[list[tuple]]:
    """Contexts of one gram, cut into groups of at most `most` that together hold every pair of equal windows.

    parts: (uid, start, own, place of the gram, bytes). Their windows have `low` to `high` bytes before the gram. Those with
    at least the middle of that share so many bytes before it, the others so many after it. At the end a group's windows are all equal;
    the first of them goes with each part of the others.
    """
    gram, side = _geometry(length)
    if len(parts) <= most:
        yield parts
    elif low == high:
        ordered = sorted(parts)
        for i in range(1, len(ordered), most):
            yield [ordered[0], *ordered[i : i + most]]
    else:
        middle = (low + high + 1) // 2
        after = side - middle + 1
        for first, last, before in ((middle, high, True), (low, middle - 1, False)):
            groups: dict[bytes, list[tuple]] = {}
            for uid, start, own, at, text in parts:
                shared = text[max(0, at - middle) : at] if before else text[at + gram : at + gram + after]
                lo = max(0, at - last)
                cut = text[lo : at - first + length] if at >= first else b""
                if len(shared) == (middle if before else after) and len(cut) >= length:
                    groups.setdefault(shared, []).append((uid, start + lo, own, at - lo, cut))
            for group in groups.values():
                if len(group) > 1:
                    yield from small_groups(group, first, last, length, most)


def merged_spans(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(uid, start, end) of several batches with overlapping and touching spans of a row joined."""
    uid, start, end = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("uid", "start", "end"))
    order = np.lexsort((start, uid))
    uid, start, end = uid[order], start[order].astype(np.int64), end[order].astype(np.int64)
    row = np.cumsum(np.r_[0, uid[1:] != uid[:-1]])
    # rows are 2**32 apart, so the furthest end so far is one of the own row, or before it
    reach = np.maximum.accumulate(end + (row << 32))
    first = np.flatnonzero(np.r_[True, (start + (row << 32))[1:] > reach[:-1]])
    last = np.r_[first[1:], len(uid)] - 1
    return pa.RecordBatch.from_arrays([pa.array(uid[first]), pa.array(start[first].astype(np.int32)), pa.array((reach - (row << 32))[last].astype(np.int32))], ["uid", "start", "end"])


def _block_rows(length: int, keep_first: bool, block: int = 1 << 16, most: int = CONTEXTS):
    _, side = _geometry(length)

    def settle(parts: list[tuple]) -> pa.RecordBatch | None:
        data = np.frombuffer(b"".join(x[4] for x in parts), np.uint8)
        sizes = np.array([len(x[4]) for x in parts])
        base = np.r_[0, np.cumsum(sizes)[:-1]]
        counts = sizes - length + 1
        which = np.repeat(np.arange(len(parts)), counts)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        uid = np.array([x[0] for x in parts])[which]
        pos = np.array([x[1] for x in parts])[which] + inner
        starts = base[which] + inner
        rank, levels = truncated_ranks(data, starts, length)
        previous, later = factors(rank, uid, pos, starts, levels, length)
        hit = ((previous if keep_first else np.maximum(previous, later)) >= length) & np.array([x[2] for x in parts])[which]
        at = np.flatnonzero(hit)
        if not len(at):
            return None
        new = np.r_[True, (np.diff(at) > 1) | (which[at][1:] != which[at][:-1])]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(at)] - 1
        return pa.RecordBatch.from_arrays([pa.array(uid[at[first]]), pa.array(pos[at[first]].astype(np.int32)), pa.array((pos[at[last]] + length).astype(np.int32))], ["uid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        own: list[tuple] = []  # of the present gram
        held, gram = 0, None

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal parts, held
            if parts and (out := settle(parts)):
                yield out
            parts, held = [], 0

        def added(groups: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal parts, held
            for group in groups:
                parts += group
                held += sum(len(x[4]) for x in group)
                if held >= block:
                    yield from flushed()

        def closed() -> Iterator[pa.RecordBatch]:
            if len(own) <= most:
                yield from added(iter([own]))
                return
            # pieces of a crowded gram give spans in pieces, which are joined before they leave the task
            yield from flushed()
            found = [*added(small_groups(own, 0, side, length, most)), *flushed()]
            if found:
                yield merged_spans(found)

        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("gram", "uid", "start", "own", "at", "bytes")), strict=True):
                if g != gram:
                    yield from closed()
                    own.clear()
                gram = g
                own.append(tuple(row))
        yield from closed()
        yield from flushed()

    return run


def _window_rows(length: int):
    """Windows of contexts of hot grams: (two hashes, uid, pos, own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in tiles(batch.column("bytes")):
                sizes = np.diff(offsets) - length + 1
                which = np.repeat(np.arange(j - i), sizes)
                inner = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                start = offsets[:-1][which] + inner
                hashes = [pa.array(segment_hash(byte_prefix(data, k), start, start + length).view(np.int64)) for k in (0, 1)]
                uid, pos, own = (batch.column(c).to_numpy(zero_copy_only=False)[i:j][which] for c in ("uid", "start", "own"))
                yield pa.RecordBatch.from_arrays([*hashes, pa.array(uid), pa.array((pos + inner).astype(np.int32)), pa.array(own)], ["h1", "h2", "uid", "pos", "own"])

    return run


def repeated_spans(rows: DataFrame, length: int = 200, keep_first: bool = False, hot: int = 20_000, crowded: int = 20_000) -> DataFrame:
    """(uid, start, end): bytes of a row covered by strings of `length` bytes that also start elsewhere.

    With keep_first only the later copies: those for which an equal string starts at a smaller (uid,
    position). rows has uid (unique, not null) and text. Spans may touch or overlap.
    """
    gram, side = _geometry(length)
    # stored, as they are counted and then joined with the counts
    anchors = stored_table(rows.select("uid", "text").mapInArrow(_anchor_rows(length), "uid long, pos int, gram long, context long"))
    place = F.struct("uid", "pos")
    kinds = anchors.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1"), *([F.min(place).alias("first")] if keep_first else []))
    # stored, both sides of the joins below are plain shuffles, which AQE splits where a gram is hot
    kinds = checkpointed(kinds.filter("n > 1").select("gram", (F.col("c0") != F.col("c1")).alias("mixed"), *(["first"] if keep_first else [])))
    repeated = stored_table(anchors.join(kinds, "gram").select("uid", "pos", "mixed", *(F.when(F.col("mixed"), F.col(c)).alias(c) for c in ("gram", "context")), *(["first"] if keep_first else [])))
    inner = repeated.filter("not mixed")
    if keep_first:
        inner = inner.filter(place != F.col("first"))
    mixed = repeated.filter("mixed").select("uid", "pos", "gram", "context")
    groups = stored_table(mixed.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(place).alias("first")))
    many = stored_table(groups.groupBy("gram").agg((F.count("*") > hot).alias("hot")))
    marked = stored_table(mixed.join(stored_table(groups.join(many, "gram")), ["gram", "context"]))
    is_first = place == F.col("first")
    settled = marked.filter(F.col("n") > 1)
    if keep_first:
        settled = settled.filter(~is_first)
    sure = inner.select("uid", "pos").unionAll(settled.select("uid", "pos")).select("uid", (F.col("pos") - side).alias("start"), (F.col("pos") + gram + side).alias("end"))
    own = (F.lit(True) if keep_first else F.col("n") == 1)
    flags = marked.filter(is_first).select("uid", "hot", F.struct("pos", "gram", own.alias("own")).alias("flag"))

    def contexts(of: DataFrame) -> DataFrame:
        wanted = of.groupBy("uid").agg(F.collect_list("flag").alias("flags"))
        return rows.select("uid", "text").join(wanted, "uid").mapInArrow(_context_rows(length), "gram long, uid long, start int, own boolean, at int, bytes binary")

    def in_blocks(of: DataFrame) -> DataFrame:
        return of.select("gram", "uid", "start", "own", "at", "bytes").repartition("gram").sortWithinPartitions("gram").mapInArrow(_block_rows(length, keep_first), "uid long, start int, end int")

    spans = sure.unionAll(in_blocks(contexts(flags.filter("not hot"))))
    if flags.filter("hot").isEmpty():
        return spans
    halves = stored_table(contexts(flags.filter("hot")).mapInArrow(_half_rows(length), "gram long, uid long, start int, own boolean, at int, bytes binary"))
    sizes = stored_table(halves.groupBy("gram").agg((F.count("*") > crowded).alias("crowded")))
    halves = stored_table(halves.join(sizes, "gram"))
    spans = spans.unionAll(in_blocks(halves.filter("not crowded")))
    if not sizes.filter("crowded").isEmpty():
        windows = halves.filter("crowded").mapInArrow(_window_rows(length), "h1 long, h2 long, uid long, pos int, own boolean")
        # stored for the same reason: one window can be in very many contexts
        ends = checkpointed(windows.groupBy("h1", "h2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo != hi"))
        found = windows.filter("own").join(ends, ["h1", "h2"])
        if keep_first:
            found = found.filter(place != F.col("lo"))
        spans = spans.unionAll(found.select("uid", F.col("pos").alias("start"), (F.col("pos") + length).alias("end")))
    return spans


def _cut_rows(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column("id"), batch.column("spans")
            flat = spans.flatten()
            size = np.asarray(pc.list_value_length(spans).fill_null(0))
            ends = np.cumsum(size)
            lo_all, hi_all = (flat.field(k).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int32) for k in (0, 1))
            n_bytes, n_removed, n_spans, digests, kept_texts = [], [], [], [], []
            for i, j, data, offsets in tiles(batch.column("text")):
                for k in range(i, j):
                    text = data[offsets[k - i] : offsets[k - i + 1]]
                    n, removed, runs = len(text), 0, 0
                    if size[k]:
                        lo = np.maximum(lo_all[ends[k] - size[k] : ends[k]], 0)
                        hi = np.minimum(hi_all[ends[k] - size[k] : ends[k]], n)
                        delta = np.bincount(lo, minlength=n + 1).astype(np.int64) - np.bincount(hi, minlength=n + 1)
                        gone = np.cumsum(delta)[:n] > 0
                        removed = int(gone.sum())
                        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        text = text[~gone]
                    n_bytes.append(n)
                    n_removed.append(removed)
                    n_spans.append(runs)
                    kept = text.tobytes()
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if keep_text:
                        kept_texts.append(kept.decode("utf-8", "ignore"))
            more = [pa.array(kept_texts, pa.string())] if keep_text else []
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), *more], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if keep_text else [])])

    return run


def dedup_substrings(docs: DataFrame, length: int = 200, keep_first: bool = False, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes repeated strings of `length` UTF-8 bytes: every copy, or with keep_first the later ones.

    Returns id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with keep_text,
    kept_text (broken characters at cuts are dropped from that text; the digest is of the bytes).
    Null and empty texts have no bytes; texts shorter than `length` are kept whole. Repeated rows
    and null ids stay documents of their own. Other columns are ignored. An empty table gives no rows.
    """
    rows = text_rows(docs, id_col, text_col)
    spans = repeated_spans(rows, length, keep_first).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    return with_ids(rows.join(spans, "uid", "left"), kind).select("id", "text", "spans").mapInArrow(_cut_rows(keep_text), schema).withColumnRenamed("id", id_col)
