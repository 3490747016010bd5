"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import joins
from granary.plans import views
from granary.plans.registry import query
from granary.session import table


def _sides(spark, sf_dir):
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    mapping = table(spark, sf_dir, "orders").filter("o_custkey % 3 <> 0").select(F.col("o_orderkey").alias("tgt"), F.col("o_custkey").alias("src"), F.col("o_totalprice").alias("sim"))
    return targets, mapping, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")


@query("SELECT o_orderkey AS id, o_custkey AS src, o_totalprice AS sim, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 3 <> 0")
def join_lookup(spark, sf_dir):
    return joins.lookup(*_sides(spark, sf_dir)).select("id", "src", "sim", F.col("retrieved.c_name").alias("name"))


@query("SELECT count(*) AS total, count(*) FILTER (o_custkey % 3 = 0) AS missing FROM orders")
def join_lookup_counting_missing(spark, sf_dir):
    return joins.lookup(*_sides(spark, sf_dir), outer=True).agg(F.count("*").alias("total"), F.count_if(F.col("retrieved").isNull()).alias("missing"))


@query("SELECT o_orderkey AS id, NULL::VARCHAR AS name FROM orders")
def join_without_retrieval(spark, sf_dir):
    targets, _, sources = _sides(spark, sf_dir)
    return joins.without_retrieval(targets, sources).select("id", F.col("retrieved.c_name").alias("name"))


@query("SELECT doc_id AS id, coalesce(q.v, t.v) AS v FROM documents LEFT JOIN (SELECT doc_id, quality AS v FROM labels WHERE quality = 1) q USING (doc_id) LEFT JOIN (SELECT doc_id, toxic AS v FROM labels) t USING (doc_id)")
def join_point_with_fallback(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return joins.point(ids, labels.filter("quality = 1").select(F.col("doc_id").alias("id"), F.col("quality").alias("v")), labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("v")), "v")


@query(f"WITH {views.VOTES} SELECT id, max(answer) FILTER (member = 'a') AS a, max(answer) FILTER (member = 'b') AS b, max(answer) FILTER (member = 'c') AS c, min(expected) AS expected FROM votes GROUP BY id HAVING count(DISTINCT member) = 3")
def join_members_side_by_side(spark, sf_dir):
    return joins.members_side_by_side(views.votes(spark, sf_dir), list(views.MEMBERS), "answer", "expected")


@query("SELECT doc_id AS id, quality FROM documents LEFT JOIN labels USING (doc_id)")
def join_enrich(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return joins.enrich(ids, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality"), "quality")


@query("SELECT a.s_nationkey, a.s_suppkey AS tgt, b.s_suppkey AS src FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def join_siblings(spark, sf_dir):
    return joins.siblings(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey")


@query("SELECT c_mktsegment || '-' || n_name AS test, min(r_name) AS source FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON contains(c_mktsegment || '-' || n_name, substr(r_name, 1, 1)) GROUP BY 1")
def join_stem_in_name(spark, sf_dir):
    tests = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("-", "c_mktsegment", "n_name").alias("test")).distinct()
    return joins.stem_match(tests, table(spark, sf_dir, "region").select(F.substring("r_name", 1, 1).alias("stem"), F.col("r_name").alias("source")))


@query(
    "WITH w AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS c FROM documents), i AS (SELECT doc_id, list_intersect(c, ['heand','reea','the','thea','shly']) AS b FROM w) SELECT doc_id, CASE WHEN len(b) = 1 THEN b[1] END AS called FROM i"
)
def join_resolved_call(spark, sf_dir):
    declared = F.array(*map(F.lit, ("heand", "reea", "the", "thea", "shly")))
    return table(spark, sf_dir, "documents").select("doc_id", joins.resolved_call(F.array_distinct(F.split("text", " ")), declared).alias("called"))


@query(
    "WITH p AS (SELECT p_partkey AS id, ['x.' || replace(p_name, ' ', '.'), 'y.' || split_part(p_name, ' ', 1) || '.*'] AS imports FROM part), t AS (SELECT DISTINCT unnest(['x.' || replace(p_name, ' ', '.'), 'y.' || replace(p_name, ' ', '.')]) AS type FROM part), "
    "e AS (SELECT id, unnest(imports) AS i FROM p) SELECT DISTINCT id, type FROM e JOIN t ON i = type OR i = regexp_replace(type, '\\.[^.]*$', '') || '.*'"
)
def join_import_types(spark, sf_dir):
    name = F.replace("p_name", F.lit(" "), F.lit("."))
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.array(F.concat(F.lit("x."), name), F.concat(F.lit("y."), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(".*"))).alias("imports"))
    types = part.select(F.explode(F.array(F.concat(F.lit("x."), name), F.concat(F.lit("y."), name))).alias("type")).distinct()
    return joins.import_types(rows, types)


@query(
    "WITH p AS (SELECT user_id % 50 AS key, event_id AS at_ FROM events), r AS (SELECT o_custkey % 50 AS key, o_orderkey AS rid, o_orderkey AS lo, o_orderkey + o_custkey % 30 AS hi FROM orders) "
    'SELECT key, at_ AS "at", rid FROM p JOIN r USING (key) WHERE at_ BETWEEN lo AND hi'
)
def join_line_in_range(spark, sf_dir):
    points = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("key"), F.col("event_id").alias("at"))
    ranges = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("key"), F.col("o_orderkey").alias("rid"), F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + F.col("o_custkey") % 30).alias("hi"))
    return joins.range_hits(points, ranges).select("key", "at", "rid")


@query(
    "SELECT n_name AS method, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey WHEN n_nationkey % 3 = 1 THEN 100 + n_nationkey ELSE 200 + n_nationkey END AS d FROM nation WHERE n_nationkey % 5 <> 4 OR n_nationkey % 3 <> 2"
)
def join_signature_match(spark, sf_dir):
    """One overload; two of which one has the arity; two of which one has the types, or none for every fifth."""
    k = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation")
    names = [F.lit("p").alias("package"), F.lit("C").alias("class"), F.col("n_name").alias("method")]
    types = lambda *x: F.array(*map(F.lit, x))
    wanted = nation.select(*names, F.when(k % 5 == 4, types("Set", "int")).otherwise(types("List<A>", "int")).alias("params"))
    one = nation.filter(k % 3 == 0).select(*names, types("java.lang.long").alias("types"), k.alias("d"))
    by_arity = nation.filter(k % 3 == 1).select(*names, F.explode(F.array(F.struct(types().cast("array<string>").alias("types"), k.alias("d")), F.struct(types("x", "y").alias("types"), (k + 100).alias("d")))).alias("o")).select("package", "class", "method", "o.types", "o.d")
    by_type = nation.filter(k % 3 == 2).select(*names, F.explode(F.array(F.struct(types("java.util.map", "java.lang.integer").alias("types"), k.alias("d")), F.struct(types("java.util.list", "java.lang.integer").alias("types"), (k + 200).alias("d")))).alias("o")).select("package", "class", "method", "o.types", "o.d")
    return joins.signature_match(wanted, one.unionByName(by_arity).unionByName(by_type)).select("method", "d")


_METHODS = (
    "p AS (SELECT user_id % 50 AS key, event_id AS at_ FROM events), r AS (SELECT o_custkey % 50 AS key, o_orderkey AS rid, o_orderkey AS lo, CASE WHEN o_orderkey % 1000 = 1 THEN o_orderkey + 1000000000 ELSE o_orderkey + o_custkey % 5 - 1 END AS hi FROM orders) "
    "SELECT key, rid FROM r WHERE {0} EXISTS (SELECT 1 FROM p WHERE p.key = r.key AND at_ BETWEEN lo AND hi)"
)


def _methods(spark, sf_dir):
    """Error lines, and methods as ranges of lines: some empty, some of 10 ** 9 lines."""
    lines = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("key"), F.col("event_id").alias("at"))
    key = F.col("o_orderkey")
    hi = F.when(key % 1000 == 1, key + 1_000_000_000).otherwise(key + F.col("o_custkey") % 5 - 1)
    return lines, table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("key"), key.alias("rid"), key.alias("lo"), hi.alias("hi"))


@query("WITH " + _METHODS.format(""))
def join_methods_with_errors(spark, sf_dir):
    lines, methods = _methods(spark, sf_dir)
    return joins.ranges_hit(methods, lines, "rid").select("key", "rid")


@query("WITH " + _METHODS.format("NOT"))
def join_methods_without_errors(spark, sf_dir):
    lines, methods = _methods(spark, sf_dir)
    return joins.ranges_hit(methods, lines, "rid", hit=False).select("key", "rid")


@query("SELECT p_name || '_' || p_partkey AS test, min(n_name) AS source FROM part JOIN (SELECT substr(n_name, 2, 2 + n_nationkey % 4) AS stem, n_name FROM nation) ON contains(upper(p_name || '_' || p_partkey), stem) GROUP BY 1")
def join_longer_stem_in_name(spark, sf_dir):
    """Stems of two to five letters in longer names."""
    name = F.concat_ws("_", "p_name", "p_partkey")
    names = table(spark, sf_dir, "part").select(name.alias("name"), F.upper(name).alias("test"))
    stems = table(spark, sf_dir, "nation").select(F.expr("substr(n_name, 2, 2 + n_nationkey % 4)").alias("stem"), F.col("n_name").alias("source"))
    return joins.stem_match(names.select("test"), stems).join(names, "test").select(F.col("name").alias("test"), "source")
