"""Product quantisation of vectors in whole numbers, with lower bounds that spare most exact distances.

A vector's components become integers and are cut into equal parts; each part has a codebook of integer entries,
refined by rounds of assignment and averaging. To find a part's nearest entry, part and entries are summed up from
coarse to fine: one block, then two, four ... each with its mean and the norm of what the mean leaves (the residual). For a
block of m components, m (mean - mean')^2 + (norm - norm')^2 is at most the block's squared distance, so an entry whose
bound exceeds a distance already found can't be nearest. Bounds are lowered by more than rounding can add, and ties are
never dropped; the entries that survive all levels get exact integer distances.

A round is one map over the vectors, in which every task sums its own rows into a row a component of the codebooks, and one
small aggregation: what is shuffled and what the driver holds follow the codebooks, not the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import sized, stored_table

#: Components of a tile of vectors that a worker holds at a time, as eight-byte numbers.
TILE = 1 << 17


def usable(vector: Column) -> Column:
    """Whether a vector is there, with finite components only."""
    x = vector.cast("array<double>")
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return F.coalesce(F.forall(x, finite), F.lit(False))


def limit_of(dimensions: int) -> int:
    """The largest size of a component with which a squared distance of whole vectors fits into 62 bits."""
    return 1 << (60 - max(dimensions - 1, 1).bit_length()) // 2


def blocks(width: int) -> list[np.ndarray]:
    """Starts of the blocks of each level: one block, two, four ... down to blocks of two or three components."""
    levels, n = [], 1
    while n == 1 or width // n >= 2:
        levels.append(np.unique(np.arange(n) * width // n))
        n *= 2
    return levels


@dataclass
class Summary:
    """Means, scaled by the root of their block's length, and residual norms of vectors at each level."""

    means: list[np.ndarray]
    norms: list[np.ndarray]
    size: np.ndarray  # squared length, the scale of rounding


def summarised(x: np.ndarray, levels: list[np.ndarray]) -> Summary:
    """x: vectors of integers as rows."""
    f = x.astype(np.float64)
    squares = f * f
    means, norms = [], []
    for starts in levels:
        lengths = np.diff(np.r_[starts, x.shape[1]])
        mean = np.add.reduceat(f, starts, axis=1) / np.sqrt(lengths)
        means.append(mean)
        norms.append(np.sqrt(np.maximum(np.add.reduceat(squares, starts, axis=1) - mean * mean, 0)))
    return Summary(means, norms, squares.sum(1))


def lowest(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The place of the first lowest value of each row; rows stand together."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(value, starts), np.diff(np.r_[starts, len(row)])) if len(row) else value
    at = np.flatnonzero(value == least)
    return at[np.r_[True, row[at][1:] != row[at][:-1]]] if len(at) else at


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, squared distance, exact distances taken) of each row of x; ties to the lower index."""
    levels = blocks(x.shape[1])
    a, b = summarised(x, levels), summarised(entries, levels)
    row = np.repeat(np.arange(len(x)), len(entries))
    entry = np.tile(np.arange(len(entries)), len(x))
    best = np.full(len(x), np.iinfo(np.int64).max)
    taken = 0
    for mean_a, norm_a, mean_b, norm_b in zip(a.means, a.norms, b.means, b.norms, strict=True):
        bound = ((mean_a[row] - mean_b[entry]) ** 2 + (norm_a[row] - norm_b[entry]) ** 2).sum(1)
        # residual norms come from differences of squares; a millionth of the squares covers their rounding
        bound -= 1e-6 * (a.size[row] + b.size[entry]) + 1
        # the exact distance of the entry with the lowest bound is what the others have to stay under
        first = lowest(row, bound)
        found = ((x[row[first]] - entries[entry[first]]) ** 2).sum(1)
        best[row[first]] = np.minimum(best[row[first]], found)
        taken += len(first)
        stays = bound <= best[row]
        row, entry = row[stays], entry[stays]
    distance = ((x[row] - entries[entry]) ** 2).sum(1)
    first = lowest(row, distance)
    return entry[first], distance[first], taken + len(row)


def integers(batch: pa.RecordBatch, dimensions: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * component), cut off at limit_of(dimensions)."""
    column = batch.column("vector")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dimensions)
    most = limit_of(dimensions)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * scale), -most, most).astype(np.int64)


def _tiles(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, TILE // dimensions)
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _sum_rows(books: list[np.ndarray], scale: int):
    """(slot, total) of a task's rows: the sums of each entry's parts by component, then their number."""
    parts, (_, width) = len(books), books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, max(map(len, books)), width + 1), np.int64)
        for tile in _tiles(batches, parts * width):
            x = integers(tile, parts * width, scale)
            for p, book in enumerate(books):
                part = x[:, p * width : (p + 1) * width]
                index, _, _ = nearest(part, book)
                np.add.at(totals[p], index, np.c_[part, np.ones(len(part), np.int64)])
        used = np.flatnonzero(totals[:, :, width].ravel())
        slots = (used[:, None] * (width + 1) + np.arange(width + 1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(totals.ravel()[slots])], ["slot", "total"])

    return run


def _code_rows(books: list[np.ndarray], scale: int):
    """Codes as two hexadecimal digits a part, and the squared distances summed over parts."""
    parts, width = len(books), books[0].shape[1]
    digits = -(-max(1, (max(map(len, books)) - 1).bit_length()) // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches, parts * width):
            x = integers(tile, parts * width, scale)
            error = np.zeros(len(x), np.int64)
            code = np.zeros((len(x), parts), f">u{digits if digits in (1, 2) else 4}")
            exact = 0
            for p, book in enumerate(books):
                code[:, p], distance, taken = nearest(x[:, p * width : (p + 1) * width], book)
                error += distance
                exact += taken
            whole = code.tobytes().hex()
            step = len(whole) // max(1, len(x))
            texts = [whole[i * step : (i + 1) * step] for i in range(len(x))]
            share = np.full(len(x), exact / (len(x) * sum(map(len, books))) if len(x) else 0.0)
            yield pa.RecordBatch.from_arrays([tile.column("id"), tile.column("label"), pa.array(texts, pa.string()), pa.array(error), pa.array(share)], ["id", "label", "code", "error", "exact_share"])

    return run


def train_books(rows: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    """The codebooks, an array of entries a part; none without usable rows.

    rows: id, vector (array<double>, usable). Entries start as the parts of the rows with the smallest ids, which also set the
    dimensions; rows without an id start none. Of equal ids the smaller vector comes first.
    """
    known = rows.filter("id is not null")
    first = known.orderBy("id", "vector").limit(entries).collect()
    if not first:
        return []
    dimensions = len(first[0].vector)
    if any(len(r.vector) != dimensions for r in first):
        first = known.filter(F.size("vector") == dimensions).orderBy("id", "vector").limit(entries).collect()
    start = integers(pa.RecordBatch.from_arrays([pa.array([list(r.vector) for r in first], pa.list_(pa.float64()))], ["vector"]), dimensions, scale)
    width = dimensions // parts
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    same = rows.filter(F.size("vector") == dimensions).select("vector")
    for _ in range(rounds):
        sums = same.mapInArrow(_sum_rows(books, scale), "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).toArrow()
        totals = np.zeros((parts, len(start), width + 1), np.int64)
        totals.ravel()[sums.column("slot").to_numpy()] = sums.column("total").to_numpy()
        for p in range(parts):
            n = totals[p, :, width]
            books[p][n > 0] = totals[p, n > 0, :width] // n[n > 0, None]
    return books


def spelled(books: list[np.ndarray]) -> str:
    """All components as decimal integers by part, entry and position, joined by commas."""
    return ",".join(str(x) for book in books for x in book.ravel().tolist())


def compress_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256, exact_share) of every row with a usable vector.

    code: the index of each part's nearest entry, two hexadecimal digits each (four beyond 256 entries). error: the squared
    distances to them, summed over parts. label_error: the errors of all rows with that label, rows without one together.
    exact_share: of all distances in the row's tile, the share that bounds did not spare.

    Dropped are vectors that are null or hold null, NaN or infinite components, empty ones, and those whose length can't be cut
    into equal parts or isn't that of the usable row with the smallest id. Rows of equal ids are all kept, as are rows without an
    id; without any row with an id there are no codebooks and no result. With fewer rows than entries the codebooks have
    an entry a row. Components are cut off where a squared distance would leave 62 bits (at 64 dimensions beyond
    2**27 / scale = 32,768), and a label_error at 2**63 - 1. Other columns don't matter.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(usable(F.col("vector")) & (F.size("vector") > 0) & (F.size("vector") % parts == 0))
    books = train_books(rows, parts, entries, rounds, scale)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error long, exact_share double"
    if not books:
        coded = rows.limit(0).selectExpr("id", "label", "'' AS code", "0L AS error", "0D AS exact_share")
    else:
        coded = rows.filter(F.size("vector") == parts * books[0].shape[1]).mapInArrow(_code_rows(books, scale), schema)
    coded = stored_table(coded)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"))
    digest = hashlib.sha256(spelled(books).encode()).hexdigest()
    joined = coded.join(sized(totals), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "exact_share")
