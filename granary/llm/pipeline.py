"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir) and work on all rows that the stage before kept. All but the last return the
columns of documents; the last adds what it decides about each document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import checkpoint_dir, checkpointed, delete, packed, sized, stored_table, unpacked
from granary.llm.decontamination import find_contaminated
from granary.llm.jaccard_join import jaccard_components
from granary.llm.line_dedup import dedup_lines
from granary.llm.source_mixing import mix_sources
from granary.llm.toxicity import score_texts, train


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; the machine is trained on labelled documents."""
    model = train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return score_texts(docs, model, docs.columns, name="_toxicity").filter("_toxicity < 0.5").drop("_toxicity")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in one of them; n_chars follows the text.

    Whole copies of a text count as one document and keep the same lines: they are left to the next stage, which keeps
    one of them, instead of losing all their text here. A document that consists of such lines only keeps its row,
    with an empty text, as a null text does.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    # the other columns travel with the id, so that cutting needs the one join that brings the bitmaps
    cut = dedup_lines(docs.select("doc_id", "text", packed(others).alias("rest")), min_docs=10, digest=False, extra=["rest"], keep_first=True, copies_once=True)
    return cut.select("doc_id", F.col("kept_text").alias("text"), F.length("kept_text").cast("long").alias("n_chars"), *unpacked("rest", others)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays.

    Of rows with the same doc_id that belong together one stays, and rows without a doc_id all stay. Where a doc_id is
    repeated, rows are numbered once in a stored copy, and each row is judged by its own component.
    """
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        found = checkpointed(jaccard_components(docs, words=5, percent=80))
        gone = checkpointed(found.filter("doc_id != component_id").select("doc_id"))
        return docs.join(sized(gone), "doc_id", "left_anti").select(*docs.columns)
    row = f"row_{uuid.uuid4().hex}"
    numbered = stored_table(docs.withColumn(row, F.monotonically_increasing_id()))
    found = jaccard_components(numbered.select(row, "text"), words=5, percent=80, id_col=row).select(row, "component_id")
    named = checkpointed(found.join(numbered.filter("doc_id is not null").select(row, "doc_id"), row))
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", row))[row].alias("first"))
    gone = checkpointed(named.join(first, "component_id").filter(F.col(row) != F.col("first")).select(row))
    return numbered.join(sized(gone), row, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = find_contaminated(docs, _table(spark, sf_dir, "benchmark"), keep=docs.columns, names=("_items", "_shared"))
    return found.filter(F.size("_items") == 0).drop("_items", "_shared")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its source's weight and its copies in the mix; no document is left out.

    Columns of documents named like one of the added ones are replaced by it.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "source", "n_tokens", "weight", "copies")]
    return mix_sources(docs, entropy_share=0.99, max_repeats=4.0, keep=others)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix),
]

#: Learned, hashed and iterative stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what lies between them is Parquet in the shared checkpoint folder.

    A stage's result is deleted once the next one's is written.
    """
    docs = _table(spark, sf_dir, "documents")
    checkpoint_dir(docs)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            delete(spark, before)
        before = path
    return docs
