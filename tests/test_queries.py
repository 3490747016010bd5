"""Every registered query of the core library against its SQL, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from granary.operators.retrieval import bm25_top1
from granary.plans import registry
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime | str | bool) or v is None:
        return str(v)
    return float(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_its_sql(spark, sf_dir, sql, name):
    frame = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in frame.collect())
    if name not in registry.ORACLES:
        assert got
        return
    found = sql.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())


def test_queries_over_all_rows_agree_with_brute_force(spark, sf_dir, tmp_path):
    """Small tables with ids far apart."""
    docs, items = {7: "a b b c", 99: "c d", 100: "a a e", 5000: "b f"}, {1: "a b", 2: "c f f", 3: "z"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {}
    for i, x in items.items():
        for d, y in docs.items():
            a, b = x.split(), y.split()
            part = lambda f, n: 2.5 * f / (f + 1.5 * (0.25 + 0.75 * n / ((len(a) + len(b)) / 2)))  # noqa: B023, E731
            both = set(a) & set(b)
            if both:
                want[i, d] = sum(a.count(t) * part(b.count(t), len(b)) + b.count(t) * part(a.count(t), len(a)) for t in both) * math.log(1.2) / 2
    got = {(r.tgt, r.src): r.sim for r in registry.QUERIES["similarity_bm25_pairs"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    best = {i: max((d for t, d in want if t == i), key=lambda d: (round(want[i, d], 9), -d)) for i, _ in want} | {3: min(docs)}
    sides = [spark.createDataFrame(list(x.items()), "id long, text string").select("id", F.split("text", " ").alias("terms")) for x in (items, docs)]
    for first in (16, 1):
        assert {r.tgt: r.src for r in bm25_top1(*sides, nearest=first).collect()} == best
    events = [(n, n % 7) for n in [*range(2900, 3100), *range(9000, 9050)]]
    orders = [(n, 3 * n % 11) for n in [*range(2950, 3060), *range(9000, 9040)]]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    hits = sorted((u % 50, e, o) for e, u in events for o, c in orders if u % 50 == c % 50 and o <= e <= o + c % 30)
    assert any(o >= 3000 for _, _, o in hits)
    assert sorted((r.key, r["at"], r.rid) for r in registry.QUERIES["join_line_in_range"](spark, str(tmp_path)).collect()) == hits
