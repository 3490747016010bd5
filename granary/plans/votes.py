"""Votes, order and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import sets
from granary.operators import votes as v
from granary.plans import views
from granary.plans.registry import query
from granary.session import table


@query(f"WITH {views.VOTES}, n AS (SELECT id, answer, count(*) AS n, min(ord) AS first FROM votes GROUP BY ALL) SELECT id, answer, n FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, first) = 1")
def vote_majority(spark, sf_dir):
    return v.majority(views.votes(spark, sf_dir))


@query(f"WITH {views.VOTES} SELECT id, count(DISTINCT trim(answer)) = 1 AS agreed FROM votes GROUP BY id")
def vote_unanimous(spark, sf_dir):
    return v.unanimous(views.votes(spark, sf_dir))


@query("SELECT conv_id AS id, last(text ORDER BY turn) AS last, CASE WHEN count(*) >= 3 THEN list(text ORDER BY turn)[-3] END AS third_last FROM conversations GROUP BY 1")
def history_last_message(spark, sf_dir):
    return views.histories(spark, sf_dir).select("id", v.last_message(F.col("history")).alias("last"), v.last_message(F.col("history"), 3).alias("third_last"))


@query("SELECT l_orderkey, l_partkey, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_suppkey) AS rank FROM lineitem) WHERE rank <= 2")
def top_k_per_group(spark, sf_dir):
    top = v.top_k(table(spark, sf_dir, "lineitem"), "l_orderkey", [F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")], 2)
    return top.select("l_orderkey", "l_partkey", "l_extendedprice", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders")
def running_index(spark, sf_dir):
    return v.running_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS total FROM orders) SELECT o_orderkey, idx // (total // 10 + 1) AS chunk FROM n")
def fixed_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return v.chunked(v.running_index(rows, "o_orderkey"), "idx", rows.count(), 10).select("o_orderkey", "chunk")


@query("SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS group_size FROM documents")
def group_size_dispatch(spark, sf_dir):
    return v.group_size(table(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", "source", "group_size")


@query()
def seeded_shuffle(spark, sf_dir):
    return v.shuffled(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 888)


@query(f"WITH {views.VOTES} SELECT answer, count(*) AS n FROM votes GROUP BY answer ORDER BY n DESC, min(id * 10 + ord), answer LIMIT 3")
def most_common_values(spark, sf_dir):
    from granary.operators.metrics import most_common

    return most_common(views.votes(spark, sf_dir), "answer", 3, F.struct("id", "ord"))


def _right(spark, sf_dir, member):
    return views.votes(spark, sf_dir).filter((F.col("member") == member) & F.col("correct"))


@query(f"WITH {views.VOTES} SELECT DISTINCT id FROM judged WHERE correct AND member = 'a' EXCEPT SELECT id FROM judged WHERE correct AND member = 'b'")
def set_difference(spark, sf_dir):
    return sets.difference(_right(spark, sf_dir, "a"), _right(spark, sf_dir, "b"))


@query(f"WITH {views.VOTES} SELECT id FROM judged WHERE correct AND member = 'a' INTERSECT SELECT id FROM judged WHERE correct AND member = 'b'")
def set_intersection(spark, sf_dir):
    return sets.intersection(_right(spark, sf_dir, "a"), _right(spark, sf_dir, "b"))


@query(f"WITH {views.VOTES} SELECT id FROM judged WHERE correct AND member = 'a' UNION SELECT id FROM judged WHERE correct AND member = 'b'")
def set_union(spark, sf_dir):
    return sets.union(_right(spark, sf_dir, "a"), _right(spark, sf_dir, "b"))


@query(f"WITH {views.VOTES}, p AS (SELECT id, bool_or(member = 'a') AS a, bool_or(member = 'b') AS b, bool_or(member = 'c') AS c FROM judged WHERE correct GROUP BY id) SELECT a, b, c, count(*) AS n FROM p GROUP BY ALL")
def set_venn_regions(spark, sf_dir):
    return sets.venn({m: _right(spark, sf_dir, m) for m in views.MEMBERS})


@query("SELECT 'a' AS member, event_id FROM events WHERE event_type = 'view' UNION ALL SELECT 'b', event_id FROM events WHERE value > 100")
def union_of_shards(spark, sf_dir):
    from granary.sources.sinks import union_shards

    events = table(spark, sf_dir, "events")
    return union_shards([events.filter("event_type = 'view'").select(F.lit("a").alias("member"), "event_id"), events.filter("value > 100").select("event_id", F.lit("b").alias("member"))])


@query("SELECT DISTINCT user_id FROM events")
def dedupe_into_set(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id").distinct()


@query("SELECT conv_id, turn, text || '!' AS answer, text IN (SELECT text FROM conversations WHERE turn < 2) AS known FROM conversations")
def agents_remembered(spark, sf_dir):
    """What the first two turns of conversations asked isn't asked again when all turns do, nor is a repeated question."""
    from granary.agents import client, memo
    from granary.storage import scratch

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("m").alias("member"), F.array(client.user(F.col("text"))).alias("history"))
    model = client.scripted(_exclaim)
    path = scratch(spark)
    memo.remembered(rows.filter("turn < 2"), model, path)
    found = memo.remembered(rows, model, path)
    return found.select("conv_id", "turn", F.element_at("history", -1)["content"].alias("answer"), "known")


def _exclaim(member: str, history: list[dict], row: dict) -> str:
    return history[-1]["content"] + "!"
