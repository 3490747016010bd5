"""Shared kernels: byte-level views of Arrow strings, rolling hashes, shared storage, row keys.

The kernels work on *tiles*: runs of whole documents of about a megabyte, so that the memory of a
worker follows the tile (or the longest single document), not the Arrow batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 1 << 20

#: ASCII white space of the contracts: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64; kept between tiles."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            grown = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            grown[0] = 1
            _powers[i] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(values: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Prefix sums of value * base**position, of bytes through a table or of 64-bit values."""
    terms = values.astype(np.uint64, copy=False) if table is None else table[values]
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(terms * powers(len(values) + 1)[0][:-1], out=out[1:])
    return out


def byte_prefix(data: np.ndarray, which: int = 0) -> np.ndarray:
    return prefix_hash(data, _BYTES[which])


def segment_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each [start, end), whatever its place: equal content and length give equal values."""
    inverse = powers(len(prefix))[1]
    raw = (prefix[end] - prefix[start]) * inverse[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rolling_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Unmixed hash of every window of one width."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return (prefix[width:] - prefix[:-width]) * powers(len(prefix))[1][:n]


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def tiles(column: pa.Array, limit: int = TILE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows of about `limit` bytes."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words_of(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that are no break; none crosses a row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~breaks[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    last = np.zeros(n + 1, bool)
    last[offsets[1:]] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | last[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def checkpoint_dir(df: DataFrame) -> None:
    """Uses the folder in spark.checkpoint.dir; sets one of its own only where none is named.

    That is a temporary folder where all of Spark runs in one process (tests), and one in the warehouse on a cluster.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="granary-checkpoint-")
        context.setCheckpointDir(named or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/granary-checkpoint")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder, so a lost executor costs no recomputation."""
    checkpoint_dir(df)
    return df.checkpoint()


def stored_table(df: DataFrame) -> DataFrame:
    """As checkpointed(), but as a Parquet table of its own in that folder: columnar, compressed and with known size."""
    checkpoint_dir(df)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of shared storage, by the file system that Spark uses for it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(uid, text, extra columns) of every row, null texts as empty, and id where it differs from uid.

    uid is the id where ids are whole numbers, unique and not null. Otherwise rows are numbered once and the
    numbered rows are checkpointed, so that every later pass sees the same number; each row stays a
    document of its own. with_ids() brings the ids back.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(c.alias(n) for n, c in (extra or {}).items()))
    if docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") and rows.groupBy("id").count().filter("count > 1 or id is null").isEmpty():
        # the filter drops nothing; with it, inner and outer joins on uid share one exchange of the texts
        return rows.select(F.col("id").cast("long").alias("uid"), "text", *(extra or {})).filter("uid is not null")
    return checkpointed(rows.select(F.monotonically_increasing_id().alias("uid"), "text", "id", *(extra or {}))).filter("uid is not null")


def with_ids(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of text_rows(), or joined to them, with their id."""
    return rows if "id" in rows.columns else rows.withColumn("id", F.col("uid").cast(kind))


def sized(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A narrow, already stored side of a join: broadcast if it has at most most_rows rows, else joined by a shuffle.

    At two or three numbers a row the bound is some 30 MB. It saves moving texts while the side is small.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def packed(columns: list[str]) -> Column:
    """Columns as one struct of numbered fields, so that no name can clash; unpacked() names them again."""
    return F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)), F.lit(0).alias("none"))


def unpacked(column: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{column}.k{i}").alias(c) for i, c in enumerate(columns)]

