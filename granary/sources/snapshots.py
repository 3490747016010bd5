"""Tables in versions: rows are staged by Spark's own writers, and a small manifest makes them the next version.

A version is a manifest file that names the folders of its rows. A lost task or driver leaves the version before as it
was: rows without a manifest, or a manifest without its last line, don't exist for readers. Two writers can't make the
same version, as a manifest is created only where none of that number is there.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_versions"
END = "end"


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _manifests(spark: SparkSession, path: str) -> dict[int, list[str] | None]:
    """The folders of each version by number; None for a manifest that its writer didn't finish."""
    files, folder = _files(spark, f"{path}/{MANIFESTS}")
    if not files.exists(folder):
        return {}
    out: dict[int, list[str] | None] = {}
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.isdigit():
            stream = files.open(status.getPath())
            try:
                lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
            finally:
                stream.close()
            out[int(name)] = lines[:-1] if lines[-1] == END else None
    return out


def current(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """(number, folders) of the latest version; 0 and none before the first."""
    whole = {n: folders for n, folders in _manifests(spark, path).items() if folders is not None}
    return max(whole.items()) if whole else (0, [])


def _commit(spark: SparkSession, path: str, number: int, folders: list[str]) -> None:
    files, target = _files(spark, f"{path}/{MANIFESTS}/{number:010d}")
    try:
        stream = files.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
            raise Conflict(f"version {number} of {path} is there already") from error
        raise
    stream.write(bytearray("\n".join([*folders, END]).encode()))
    stream.close()


def write_snapshot(rows: DataFrame, path: str, append: bool = False, file_format: str = "parquet", keep: int = 2) -> int:
    """Makes rows the next version, or adds them to the current one; returns its number.

    rows may stem from the table itself. Of two writers that replace the same version one raises Conflict and leaves nothing; those
    that append come one after the other. The last `keep` versions stay readable, so a reader that has begun can end.
    """
    spark = rows.sparkSession
    before, folders = current(spark, path)
    folder = f"rows-{uuid.uuid4().hex}"
    rows.write.format(file_format).save(f"{path}/{folder}")
    while True:
        number = max([0, *_manifests(spark, path)]) + 1
        base, old = current(spark, path)
        if not append and base != before:
            _drop(spark, f"{path}/{folder}")
            raise Conflict(f"version {base} of {path} was made meanwhile")
        try:
            _commit(spark, path, number, [*(old if append else []), folder])
            break
        except Conflict:
            if not append:
                _drop(spark, f"{path}/{folder}")
                raise
    _forget(spark, path, keep)
    return number


def _drop(spark: SparkSession, path: str) -> None:
    files, target = _files(spark, path)
    files.delete(target, True)


def _forget(spark: SparkSession, path: str, keep: int) -> None:
    """Deletes what only versions before the last `keep` name."""
    found = _manifests(spark, path)
    whole = sorted(n for n, folders in found.items() if folders is not None)
    old = [n for n in found if whole and n < whole[-keep:][0]]
    held = {x for n in whole if n not in old for x in found[n]}
    for n in old:
        for folder in set(found[n] or []) - held:
            _drop(spark, f"{path}/{folder}")
        _drop(spark, f"{path}/{MANIFESTS}/{n:010d}")


def read_snapshot(spark: SparkSession, path: str, schema: str, file_format: str = "parquet") -> DataFrame:
    """The rows of the latest version; none before the first."""
    _, folders = current(spark, path)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.format(file_format).schema(schema).load([f"{path}/{x}" for x in folders])
