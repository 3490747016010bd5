"""Writers. A stage writes one table partitioned by member; merge_shards() is for shards that other programs left."""

from __future__ import annotations

import io
import tarfile
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.records import exists
from granary.sources.snapshots import write_snapshot


def write_by_member(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines in a folder a member."""
    rows.write.mode(mode).partitionBy("member").json(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def union_shards(shards: list[DataFrame]) -> DataFrame:
    """All rows of the shards, in any order; columns go by name, missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def merge_shards(spark: SparkSession, shards: list[str], path: str, schema: str) -> None:
    """One JSON Lines table of the shards that are there, in their order; they are deleted once it is written.

    A union keeps the order of its sides' partitions, so nothing is moved or sorted.
    """
    there = [x for x in shards if exists(spark, x)]
    union_shards([spark.read.schema(schema).json(x) for x in there] or [spark.createDataFrame([], schema)]).write.mode("overwrite").json(path)
    for x in there:
        folder = spark._jvm.org.apache.hadoop.fs.Path(x)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def split_errors(rows: DataFrame, status: str = "err_msg") -> tuple[DataFrame, DataFrame]:
    """(good rows, error rows) of one plan with a status column."""
    return rows.filter(F.col(status).isNull()), rows.filter(F.col(status).isNotNull())


def write_result(summary: DataFrame, input_path: str) -> str:
    """An evaluation's result beside its input."""
    path = input_path.removesuffix(".jsonl") + "-res.json"
    summary.write.mode("overwrite").json(path)
    return path


def joined_ids(rows: DataFrame, column: str) -> DataFrame:
    """One comma list of the distinct values in order; for small id sets."""
    return rows.agg(F.array_join(F.sort_array(F.collect_set(column)), ",").alias("ids"))


def tool_input(rows: DataFrame) -> DataFrame:
    """(idx, focal_method, test_prefix) for an external tool, the assertion replaced by its placeholder."""
    return rows.select(F.col("id").alias("idx"), "focal_method", F.replace("test_case", F.col("assertion"), F.lit('"<AssertPlaceHolder>"')).alias("test_prefix"))


def write_texts(rows: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """A text folder a name, written by executors through Spark's own writer."""
    rows.select(F.col(name).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def write_state(rows: DataFrame, path: str) -> None:
    """State as JSON Lines for records.read_state(): the next version of a table in versions, so that a lost driver leaves the
    old state or the new one. Rows may stem from the old state; of two writers of the same state one fails."""
    write_snapshot(rows, path, file_format="json")


def archives(files: DataFrame, group: str = "group", name: str = "name", content: str = "content") -> DataFrame:
    """(archive, content): a tar.bz2 of the files of each group, in the order of their names, without times and owners.

    An archive is one value made in one task, so the files of a group have to fit a worker; groups are spread
    over the cluster. Files without a name or group are left out, null contents are empty.
    """

    def pack(found: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:bz2") as tar:
            for n, c in sorted(zip(found["name"], found["content"], strict=True)):
                entry = tarfile.TarInfo(n)
                entry.size = len(c)
                tar.addfile(entry, io.BytesIO(c))
        return pd.DataFrame({"archive": [f"{found['group'].iloc[0]}.tar.bz2"], "content": [out.getvalue()]})

    rows = files.select(F.col(group).cast("string").alias("group"), F.col(name).alias("name"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content"))
    return rows.filter("`group` is not null and name is not null").groupBy("group").applyInPandas(pack, "archive string, content binary")
