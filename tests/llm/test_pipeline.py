import os

import corpus_pipeline
import duckdb
import pytest
from granary.llm import pipeline, queries
from pyspark.sql import functions as F

TABLES = "documents pages benchmark labels embeddings clicks".split()


def same(values):
    return sorted(str([None if v is None else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in r]) for r in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_its_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    frame = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    found = c.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert same([r[x] for x in columns] for r in frame.collect()) == same([r[names.index(x)] for x in columns] for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_has_a_row_for_each_input(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir)
    table = "pages" if name.startswith("op2") else "documents"
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert (0 < rows.count() <= n) if name == "pipeline" else rows.count() == n


def test_stages_chain_and_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() <= before
        if name != "source_mixing":
            assert docs.columns == columns
    assert set(columns) < set(docs.columns) and docs.agg(F.min("copies")).first()[0] >= 1


def test_stages_survive_odd_rows(spark, sf_dir):
    """Nulls in every column, repeated rows, clashing names and an empty table."""
    rows = [(None, None, None, None, None), (1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "", "en", None, 0), (3, "x y", None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("score", "items", "copies", "uid", "rest", "kept_text")})
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            assert out.count() <= frame.count()
    assert pipeline.drop_near_duplicates(spark, docs, sf_dir).filter("doc_id = 1").count() == 1


def test_rows_of_a_repeated_id_are_judged_one_by_one(spark, sf_dir):
    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(1, text("a")), (1, text("b")), (5, text("c")), (5, text("a")), (5, text("d")), (5, text("d")), (6, text("d")), (None, text("a")), (None, text("e")), (7, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in pipeline.drop_near_duplicates(spark, docs, sf_dir).collect())
    assert kept == sorted([(1, text("a")), (1, text("b")), (5, text("c")), (5, text("d")), (0, text("a")), (0, text("e")), (7, ""), (7, "")])
