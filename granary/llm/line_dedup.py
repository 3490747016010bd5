"""Line dedup: lines whose key occurs in many documents go everywhere, or everywhere but in the first of them.

1. One map pass turns every non-empty line into (key hash of 128 bits, document, line number); texts
   stay where they are.
2. The rows are range-partitioned by hash and document and sorted by (hash, document, position).
   The ranges split a hash that many documents hold over several tasks, and a document's lines of one
   hash always meet. Tasks stream through: the first occurrence in a document opens a run, so a run's number of
   documents is a count of firsts. Per task only the runs at its two ends are open: those leave as partial counts.
3. Runs split by a range border are summed over tasks (at most two rows a task) and their rows
   settled by that sum.
4. The settled lines come back per document as a compressed keep bitmap, which is joined to the
   documents to cut them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import LOWER, SPACE, byte_prefix, checkpointed, segment_hash, stored_table, text_rows, tiles, with_ids

def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number in the row, start, end) of every line of a tile, split at line feeds."""
    n = len(offsets) - 1
    cuts = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], cuts + 1]))
    per_row = np.searchsorted(cuts, offsets[1:]) - np.searchsorted(cuts, offsets[:-1]) + 1
    row = np.repeat(np.arange(n), per_row)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    end = np.concatenate([start[1:] - 1, [len(data)]])
    last = np.cumsum(per_row) - 1
    end[last] = offsets[1:]
    return row, number, start, end


def stripped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds without ASCII white space at both ends; empty where nothing is left."""
    solid = ~SPACE[data]
    at = np.concatenate([np.flatnonzero(solid), [len(data)]])
    first = at[np.searchsorted(at, start)] if len(at) else start
    before = np.concatenate([[-1], np.flatnonzero(solid)])
    last = before[np.searchsorted(before, end) - 1] + 1
    empty = first >= end
    return np.where(empty, start, first), np.where(empty, start, last)


def _line_rows(min_chars: int, copies_once: bool):
    """(key hash, doc, uid, line) of the lines; doc is what counts as one document, the row or its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column("uid").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in tiles(batch.column("text")):
                row, number, start, end = line_bounds(data, offsets)
                start, end = stripped(data, start, end)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                long = points[end] - points[start] >= max(1, min_chars)
                row, number, start, end = row[long], number[long], start[long], end[long]
                doc = segment_hash(byte_prefix(data), offsets[:-1], offsets[1:]).view(np.int64) if copies_once else uids[i:j]
                data = LOWER[data]
                hashes = [pa.array(segment_hash(byte_prefix(data, k), start, end).view(np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*hashes, pa.array(doc[row]), pa.array(uids[i:j][row]), pa.array(number.astype(np.int32))], ["h1", "h2", "doc", "uid", "line"])

    return run


def _stream_runs(min_docs: int):
    """Sorted lines of one range: the lines of runs in `min_docs` documents or more, and those of open runs.

    A run is held only while it has fewer than `min_docs` documents; from then on its lines pass
    straight through, so a key that fills the range costs no memory. The runs at the two ends of the range may go on
    in its neighbours: if they stay below `min_docs` here, they leave as open.
    """

    def out(piece: tuple, is_open: bool) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(piece, kinds, strict=True)), pa.array(np.full(len(piece[0]), is_open))], ["h1", "h2", "doc", "uid", "line", "first", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last_doc, docs, held, end_of_range = None, None, 0, [], True
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, uid, line = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc", "uid", "line"))
            new = np.concatenate([[key != (h1[0], h2[0])], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            first = np.concatenate([[new[0] or doc[0] != last_doc], new[1:] | (doc[1:] != doc[:-1])])
            bounds = np.concatenate([[0], np.flatnonzero(new[1:]) + 1, [len(uid)]])
            counts = np.add.reduceat(first.astype(np.int64), bounds[:-1])
            columns = (h1, h2, doc, uid, line, first)
            runs = len(counts)
            for b in sorted({0, runs - 1}):
                if (b or new[0]) and key is not None:  # the run before has ended
                    if held and end_of_range:
                        yield from (out(x, True) for x in held)
                    docs, held, end_of_range = 0, [], False
                if b and runs > 2:
                    hot = np.zeros(runs, bool)
                    hot[1:-1] = counts[1:-1] >= min_docs
                    taken = np.repeat(hot, np.diff(bounds))
                    if taken.any():
                        yield out(tuple(x[taken] for x in columns), False)
                docs += int(counts[b])
                held.append(tuple(x[bounds[b] : bounds[b + 1]] for x in columns))
                if docs >= min_docs:
                    yield from (out(x, False) for x in held)
                    held = []
                key = (h1[bounds[b]], h2[bounds[b]])
            last_doc = doc[-1]
        yield from (out(x, True) for x in held)

    return run


def pack(dropped: np.ndarray) -> bytes:
    """A compressed keep bitmap: bit i is 0 if line i goes; lines beyond its end stay."""
    keep = np.ones((int(dropped.max()) // 8 + 1) * 8, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack(bitmap: bytes | None, n: int) -> np.ndarray:
    """The keep flags of n lines."""
    keep = np.ones(n, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n].astype(bool)
        keep[: len(bits)] = bits
    return keep


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = batch.column("lines")
        maps = [pack(np.asarray(x.values)) for x in lines]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(maps, pa.binary())], ["uid", "bitmap"])


def drop_bitmaps(rows: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, copies_once: bool = False) -> DataFrame:
    """(uid, bitmap) of the rows that lose lines; rows has uid (unique, not null) and text."""
    # stored, as finding the ranges and dealing the rows would read the texts twice
    lines = stored_table(rows.select("uid", "text").mapInArrow(_line_rows(min_chars, copies_once), "h1 long, h2 long, doc long, uid long, line int"))
    ranged = lines.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "uid", "line")
    found = checkpointed(ranged.mapInArrow(_stream_runs(min_docs), "h1 long, h2 long, doc long, uid long, line int, first boolean, open boolean"))
    # at most two keys a range are open, each in fewer than min_docs documents there
    ends = found.filter("open").select("h1", "h2").distinct()
    split = found.join(F.broadcast(ends), ["h1", "h2"]).groupBy("h1", "h2").agg(F.sum(F.col("first").cast("long")).alias("docs")).filter(F.col("docs") >= min_docs)
    kept = ["h1", "h2", "doc", "uid", "line"]
    settled = found.filter("not open").select(kept).unionAll(found.filter("open").join(F.broadcast(split), ["h1", "h2"]).select(kept))
    if keep_first:
        # the first document of a key keeps the first of its lines, as does every copy of it where copies count once
        settled = checkpointed(settled)
        firsts = checkpointed(settled.groupBy("h1", "h2").agg(F.min("doc").alias("doc")))
        saved = checkpointed(settled.join(firsts, ["h1", "h2", "doc"]).groupBy("h1", "h2", "uid").agg(F.min("line").alias("line")))
        settled = settled.join(saved, ["h1", "h2", "uid", "line"], "left_anti")
    return settled.groupBy("uid").agg(F.collect_list("line").alias("lines")).mapInArrow(_pack_rows, "uid long, bitmap binary")


def _cut_rows(keep_text: bool, digest: bool, extra: list[str]):
    names = ["uid", "id", *extra, "n_lines", "n_dropped", *["kept_sha256"] * digest, *["kept_text"] * keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = batch.column("bitmap")
            for i, j, data, offsets in tiles(batch.column("text")):
                raw = data.tobytes()
                totals, gone, kept_texts = [], [], []
                for k in range(i, j):
                    text = raw[offsets[k - i] : offsets[k - i + 1]]
                    dropped = 0
                    if maps[k].is_valid:
                        parts = text.split(b"\n")
                        keep = unpack(maps[k].as_py(), len(parts))
                        dropped = len(parts) - int(keep.sum())
                        totals.append(len(parts))
                        text = b"\n".join(x for x, stays in zip(parts, keep, strict=True) if stays)
                    else:
                        totals.append(text.count(b"\n") + 1)
                    gone.append(dropped)
                    kept_texts.append(text)
                out = [batch.column(c).slice(i, j - i) for c in ("uid", "id", *extra)] + [pa.array(totals, pa.int64()), pa.array(gone, pa.int64())]
                if digest:
                    out.append(pa.array([hashlib.sha256(x).hexdigest() for x in kept_texts], pa.string()))
                if keep_text:
                    out.append(pa.array([x.decode("utf-8", "replace") for x in kept_texts], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_text: bool = True, digest: bool = True, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None, keep_first: bool = False, copies_once: bool = False) -> DataFrame:
    """Drops every line whose key (stripped, A-Z lower-cased, of min_chars code points or more) is in min_docs documents.

    Returns id, the columns `extra`, n_lines (before dropping), n_dropped, and kept_sha256 or kept_text if asked for, one row per row
    of docs. A null or empty text is one empty line, which always stays. Repeated rows and null ids count as
    documents of their own. Other columns are ignored; an empty table gives no rows. With keep_first one document keeps
    the line (the one with the smallest id, or text hash with copies_once), once. With copies_once texts that are equal
    byte by byte count as one document and keep the same lines, so that whole copies are left to a later stage.
    """
    extra = extra or []
    names = [f"x{i}" for i in range(len(extra))]
    rows = text_rows(docs, id_col, text_col, {n: F.col(c) for n, c in zip(names, extra, strict=True)})
    kind = docs.schema[id_col].dataType.simpleString()
    kinds = [f"uid long, id {kind}", *(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, extra, strict=True)), "n_lines long, n_dropped long"]
    schema = ", ".join(kinds + ["kept_sha256 string"] * digest + ["kept_text string"] * keep_text)
    maps = drop_bitmaps(rows, min_docs, min_chars, keep_first, copies_once)
    cut = with_ids(rows.join(maps, "uid", "left"), kind).select("uid", "id", *names, "text", "bitmap").mapInArrow(_cut_rows(keep_text, digest, names), schema)
    return cut.drop("uid").withColumnsRenamed({"id": id_col} | dict(zip(names, extra, strict=True)))
