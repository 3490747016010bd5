"""Storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is named: a temporary one if all of Spark runs in one process, as in
    tests, else one in the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="granary-")
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/granary-checkpoint")
    return context.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder and goes on from there.

    Later uses see the same rows in the same partitions, and a lost executor costs no recomputation of what came
    before.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored_table(df: DataFrame) -> DataFrame:
    """As stored(), but as a Parquet table of its own: columnar, compressed, written in one pass and of known size."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
