"""Benchmark decontamination by template canonicalisation.

Words become literals or typed placeholders: numbers, numbers with a unit, and names (capitalised words).
Windows of `width` canonical words are hashed, those of the benchmark into a stored table (hash, item, place), and the
documents' windows are joined with it by hash. Every hit votes for a diagonal, an alignment of a document with an item;
votes come together by document, item and diagonal, and on each diagonal the slots are
compared: a value must always be replaced by the same value (a function from item values to document
values, one to one), so that re-parameterised questions are caught and texts that merely have numbers in
similar places are not. An item is in a document if its consistent windows cover enough of it.

Whether a word looks like a name depends on its case, so a window with names is hashed a second time with its names as
literals: a copy in another case is found by that, a copy with other names by the first. Windows of hardly any literals
are hashed by all their words, so that their slots must hold equal values. Items shorter than a window are one window.

Documents are scanned once. Windows whose hash begins like none of the benchmark's don't leave the scan (a bitmap of at
most 2 MB says so; it lets all through that can match). The table of a small benchmark is broadcast, that of a large one
is joined by a shuffle; a window carries its words' values, so that no text has to be read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import LOWER, byte_prefix, checkpointed, mix, segment_hash, sized, text_rows, tiles, words_of

# Units of measurement and money.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years % percent usd eur gbp dollar dollars euro euros cent cents c f k v w kw mb gb tb hz khz mhz ghz mph kmh".split())

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True
BREAKS = ~WORD
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3


def _folds(size: int) -> np.ndarray:
    """The bytes of each character of `size` UTF-8 bytes without its case, as far as they are as many; sharp s is ss."""
    table = np.zeros((1 << 16 if size == 3 else 1 << 11, size), np.uint8)
    for point in range(0x800 if size == 3 else 0x80, len(table)):
        own = chr(point).encode("utf-8", "surrogatepass")
        folded = chr(point).casefold().encode("utf-8", "surrogatepass")
        table[point] = list(folded if len(folded) == size else own)
    return table


_FOLDS = {2: _folds(2), 3: _folds(3)}
_MARKS = mix(np.arange(1, 5, dtype=np.uint64))


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 without case, byte for byte."""
    low = LOWER[data]
    two = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    low[two[:, None] + np.arange(2)] = _FOLDS[2][(data[two] & 31).astype(np.int64) << 6 | data[two + 1] & 63]
    three = np.flatnonzero((data >= 0xE0) & (data < 0xF0))
    low[three[:, None] + np.arange(3)] = _FOLDS[3][(data[three] & 15).astype(np.int64) << 12 | (data[three + 1] & 63).astype(np.int64) << 6 | data[three + 2] & 63]
    return low


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, row, kind, key, value) of the words of a tile; key is what windows compare, value what slots do.

    A word with a digit is a number (or, ending in a unit's letters, a measure); a word that begins with a capital
    A-Z and goes on in lower case is a name; a unit after a number is a unit. Others are literals, compared without case.
    """
    start, end, row = words_of(data, offsets, BREAKS)
    low = folded(data)
    prefix = byte_prefix(low)
    value = segment_hash(prefix, start, end)
    digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
    uppers = np.concatenate([[0], np.cumsum(UPPER[data])])
    kind = np.zeros(len(start), np.int8)
    kind[(end - start > 1) & UPPER[data[start]] & (uppers[end] - uppers[start] == 1)] = NAME
    kind[digits[end] > digits[start]] = NUMBER
    after = np.flatnonzero((kind[:-1] == NUMBER) & (kind[1:] != NUMBER) & (row[1:] == row[:-1])) + 1
    if len(after):
        short = after[(end - start)[after] <= 8]
        raw = low.tobytes()
        kind[[i for i in short if raw[start[i] : end[i]].decode("utf-8", "replace") in UNITS]] = UNIT
    key = np.where(kind == LITERAL, value, _MARKS[kind])
    return start, end, row, kind, key, value


def windows(key: np.ndarray, kind: np.ndarray, row: np.ndarray, value: np.ndarray, width: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows within a row, by their words' keys if they hold at least `literals` literal words.

    A window with names comes twice if both hold enough: with placeholders for its names, and with them as literals.
    One that has too few words of both kinds comes with the values of all its words.
    """
    n = len(key) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = row[width - 1 :] == row[:n]
    plain, named = (np.concatenate([[0], np.cumsum(kind == k)]) for k in (LITERAL, NAME))
    plain, named = plain[width:] - plain[:n], named[width:] - named[:n]
    found = []
    few = plain + named < literals
    for words, ok in ((key, plain >= literals), (np.where(kind == NAME, value, key), (named > 0) & ~few), (value, few)):
        at = np.flatnonzero(inside & ok)
        h = np.full(len(at), width, np.uint64)
        for k in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[at + k]
        found.append((at, mix(h)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _rows_of(arrays: dict[str, np.ndarray], values: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A batch of plain columns and of columns of equally long lists."""
    lists = {}
    for name, x in values.items():
        offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
        lists[name] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.view(np.int64).ravel()))
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in arrays.values()), *lists.values()], [*arrays, *lists])


ITEM_ROWS = "hash long, item long, place int, size int, slots long, own array<long>"


def _item_rows(width: int, literals: int):
    """The windows of items: hash, item, place, words of the item, slots (a bit for each word that is none) and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in tiles(batch.column("text")):
                _, _, row, kind, key, value = canonical(data, offsets)
                first = np.searchsorted(row, np.arange(j - i + 1))
                size = np.diff(first)
                for w in [width, *np.unique(size[(size > 0) & (size < width)]).tolist()]:
                    at, h = windows(key, kind, row, value, w, literals)
                    if w < width:
                        whole = size[row[at]] == w
                        at, h = at[whole], h[whole]
                    if not len(at):
                        continue
                    words = at[:, None] + np.arange(w)
                    slots = ((kind[words] != LITERAL).astype(np.int64) << np.arange(w)).sum(1)
                    of = row[at]
                    yield _rows_of({"hash": h.view(np.int64), "item": ids[i:j][of], "place": (at - first[of]).astype(np.int32), "size": size[of].astype(np.int32), "slots": slots}, {"own": value[words]})

    return run


def _window_rows(widths: list[int], width: int, literals: int, marks: np.ndarray, bits: int):
    """The windows of documents that the bitmap lets through: hash, uid, first word and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column("uid").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in tiles(batch.column("text")):
                _, _, row, kind, key, value = canonical(data, offsets)
                first = np.searchsorted(row, np.arange(j - i + 1))
                for w in widths:
                    at, h = windows(key, kind, row, value, w, literals)
                    m = h >> np.uint64(64 - bits)
                    ok = (marks[(m >> np.uint64(6)).astype(np.int64)] >> (m & np.uint64(63))) & np.uint64(1) == 1
                    at, h = at[ok], h[ok]
                    words = at[:, None] + np.arange(w)
                    if w < width:
                        # a short item is found or not; the same words of a text again add nothing
                        same = np.stack([row[at].astype(np.uint64), h, *value[words].T])
                        once = np.unique(same, axis=1, return_index=True)[1]
                        at, h, words = at[once], h[once], words[once]
                    if len(at):
                        yield _rows_of({"hash": h.view(np.int64), "uid": uids[i:j][row[at]], "at": (at - first[row[at]]).astype(np.int32)}, {"values": value[words]})

    return run


def consistent(places: list[int], width: int, own: dict[int, int], other: dict[int, int], slots: set[int]) -> list[int]:
    """The windows (by their places, in order) without a slot that breaks a one-to-one map of item values to document values."""
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    bad = set()
    for k in sorted({k for p in places for k in range(p, p + width)} & slots):
        if there.setdefault(own[k], other[k]) != other[k] or back.setdefault(other[k], own[k]) != own[k]:
            bad.add(k)
    return [p for p in places if bad.isdisjoint(range(p, p + width))]


def shared_words(diagonals: list[list[tuple]]) -> tuple[set[int], int]:
    """Places of an item's words that consistent windows cover on any diagonal, and the longest run of such words on one.

    diagonals: rows (place, slots, own values, values of the document) in order of place for each diagonal. A run is words
    in a row that are consistent among themselves, whatever the rest of the diagonal is.
    """
    covered: set[int] = set()
    longest = 0
    for rows in diagonals:
        width = len(rows[0][2])
        own: dict[int, int] = {}
        other: dict[int, int] = {}
        slots: set[int] = set()
        for place, bits, mine, theirs in rows:
            own.update(zip(range(place, place + width), mine, strict=True))
            other.update(zip(range(place, place + width), theirs, strict=True))
            slots.update(place + k for k in range(width) if bits >> k & 1)
        places = sorted({r[0] for r in rows})
        for p in consistent(places, width, own, other, slots):
            covered.update(range(p, p + width))
        group: list[int] = []
        for p in [*places, None]:
            if group and (p is None or p > group[-1] + width):
                begin = end = -1
                for q in consistent(group, width, own, other, slots):
                    begin = q if q > end else begin
                    end = q + width
                    longest = max(longest, end - begin)
                group = []
            group.append(p)
    return covered, longest


def _judge_rows(least_words: int, least_share: float):
    """(uid, item, shared) of the items that are in a text; hits come sorted by uid, item, diagonal and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = []
        who = diagonal = None
        size = 0
        found: list[tuple] = []

        def close() -> None:
            if held:
                words, longest = shared_words(held)
                if longest >= min(size, least_words) or len(words) >= min(size, max(least_words, least_share * size)):
                    found.append((*who, max(len(words), longest)))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["uid", "item", "shared"])

        for batch in batches:
            for uid, item, d, n, place, slots, own, values in zip(*(batch.column(c).to_pylist() for c in ("uid", "item", "diagonal", "size", "place", "slots", "own", "values")), strict=True):
                if who != (uid, item):
                    close()
                    held, who, size, diagonal = [], (uid, item), n, None
                if d != diagonal:
                    held.append([])
                    diagonal = d
                held[-1].append((place, slots, own, values))
            if found:
                yield out()
                found = []
        close()
        if found:
            yield out()

    return run


def _marks(of_items: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the first bits of the benchmark's hashes, by 64-bit words, and how many bits of a hash it reads.

    Some 32 bits of room a window; at most 2**24 of them, so at most 2 MB come to the driver and go to executors.
    """
    bits = min(24, max(16, (32 * of_items.count()).bit_length()))
    m = F.shiftrightunsigned("hash", 64 - bits)
    words = of_items.select(F.shiftright(m, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))").alias("bit"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("set")).collect():
        out[r.word] = r["set"]
    return out.view(np.uint64), bits


def find_contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = 8, literals: int = 4, least_words: int = 13, least_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", keep: list[str] | None = None, names: tuple[str, str] = ("items", "n_shared_words")
) -> DataFrame:
    """id (or the columns `keep`), items (sorted ids of the benchmark items in the text) and n_shared_words (most words of one item), under `names`, per row of docs.

    An item is in a text if aligned windows with consistent slots cover at least least_words of its words and
    least_share of them, or least_words of its words in a row, or all of a shorter item. An item of fewer than `width`
    words is found by all its words in a row, as a template if it holds `literals` literals and else by equal values; so
    a one-word item is in every text with that word. Items without any word are never
    found. Null and empty texts contain nothing; items without an id or a text are left out, ids may be of any type; repeated rows and
    null ids of documents are kept; other columns are ignored. width is at most 63.
    """
    if not 1 <= width <= 63:
        raise ValueError("width must be 1 to 63")
    keep = keep or [id_col]
    held = [f"x{i}" for i in range(len(keep))]
    listed = checkpointed(benchmark.select(F.col(item_col).alias("id"), F.col("text").cast("string").alias("text")).filter("id is not null and text is not null").distinct().withColumn("item", F.monotonically_increasing_id()))
    of_items = checkpointed(listed.select("item", "text").mapInArrow(_item_rows(width, literals), ITEM_ROWS))
    widths = sorted({width, *(r["size"] for r in of_items.filter(F.col("size") < width).select("size").distinct().collect())})
    rows = text_rows(docs, id_col, text_col, {n: F.col(f"`{c}`") for n, c in zip(held, keep, strict=True)})
    own = rows.select("uid", "text").mapInArrow(_window_rows(widths, width, literals, *_marks(of_items)), "hash long, uid long, at int, values array<long>")
    # a row of the benchmark's table is some 150 bytes
    hits = own.join(sized(of_items, 200_000), "hash").select("uid", "item", (F.col("at") - F.col("place")).alias("diagonal"), "size", "place", "slots", "own", "values")
    votes = hits.repartition("uid").sortWithinPartitions("uid", "item", "diagonal", "place")
    found = votes.mapInArrow(_judge_rows(least_words, least_share), "uid long, item long, shared long")
    named = checkpointed(found.join(listed.select("item", "id"), "item").groupBy("uid").agg(F.sort_array(F.collect_set("id")).alias("items"), F.max("shared").alias("shared")))
    none = F.array().cast(f"array<{benchmark.schema[item_col].dataType.simpleString()}>")
    return rows.join(sized(named), "uid", "left").select(*(F.col(n).alias(c) for n, c in zip(held, keep, strict=True)), F.coalesce("items", none).alias(names[0]), F.coalesce("shared", F.lit(0)).cast("long").alias(names[1]))
