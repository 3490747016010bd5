"""Scan, projection and filter queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import filters
from granary.plans.registry import query
from granary.session import table
from granary.sources import records


@query("SELECT conv_id AS id, last(role ORDER BY turn) AS role, last(text ORDER BY turn) AS text, max(turn) AS turn FROM conversations GROUP BY conv_id")
def scan_last_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "role", "text", "turn")
    return records.last_per_key(rows.withColumn("line_no", F.col("turn")), "id", "line_no").drop("line_no")


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def scan_nested_record(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k long").alias("record"))
    return records.nested(rows)


@query("SELECT split_part(p_name, ' ', 1) AS project, count(*) AS n FROM part GROUP BY 1")
def scan_by_prefix(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("project")).agg(F.count("*").alias("n"))


@query(
    "WITH u AS (SELECT text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_no FROM conversations WHERE role = 'user' AND turn < 4), a AS (SELECT text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_no FROM conversations WHERE role = 'assistant') "
    "SELECT line_no, u.text AS assertion, a.text AS test_method FROM u JOIN a USING (line_no)"
)
def scan_paired_lines(spark, sf_dir):
    from granary.operators.votes import running_index

    rows = table(spark, sf_dir, "conversations").withColumn("place", F.col("conv_id") * 1000 + F.col("turn"))
    side = lambda test, name: running_index(rows.filter(test), "place", "line_no").select("line_no", F.col("text").alias(name))
    return side("role = 'user' and turn < 4", "assertion").join(side("role = 'assistant'", "test_method"), "line_no")


@query("WITH d AS (SELECT doc_id AS id, text, strpos(text, 'Licensed') AS at_ FROM documents) SELECT id, trim(substr(text, 1, at_ - 1)) AS test_case, trim(substr(text, at_ + 8)) AS focal_method FROM d WHERE at_ > 0 AND trim(substr(text, at_ + 8)) <> ''")
def scan_split_at_marker(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), F.lit("x").alias("assertion"), F.col("text").alias("test_method"))
    return records.split_methods(pairs, marker="Licensed", hole="<none>").select(F.col("line_no").alias("id"), "test_case", "focal_method")


@query("SELECT DISTINCT trim(unnest(string_split(text, ','))) AS item FROM benchmark EXCEPT SELECT ''")
def scan_exploded_list(spark, sf_dir):
    return records.exploded_list(table(spark, sf_dir, "benchmark").select(F.col("text").alias("value"))).distinct()


@query("SELECT item_id, word, count(*) AS n FROM (SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark) GROUP BY ALL")
def scan_exploded_map(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("word"))
    maps = words.groupBy("item_id", "word").agg(F.count("*").alias("n")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("uts"))
    return records.exploded_map(maps, "uts", "word", "n")


_TOP = "WITH f AS (SELECT o_custkey AS tgt, o_orderkey AS src, o_totalprice AS sim, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) "


def _found(spark, sf_dir):
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("x"), "o_orderkey")))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("tgt")).agg(ranked.alias("f"))
    return rows.select("tgt", F.transform("f", lambda r: F.struct(r["o_orderkey"].alias("id"), F.lit(None).cast("long").alias("key"), (-r["x"]).alias("sim"))).alias("found"))


@query(_TOP + "SELECT tgt, rank, src, sim FROM f WHERE rank <= 3")
def retrieval_map_top_k(spark, sf_dir):
    found = records.retrieval_map(_found(spark, sf_dir), 3)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(
    _TOP + ", m AS (SELECT tgt, src, sim FROM f WHERE rank = 1 AND tgt % 2 = 0), c AS (SELECT tgt, src, sim FROM f WHERE rank = 2 AND tgt % 3 = 0) "
    "SELECT c_custkey AS tgt, coalesce(m.src, c.src, c_custkey) AS src, coalesce(m.sim, c.sim, 1.0::DOUBLE) AS sim FROM customer LEFT JOIN m ON m.tgt = c_custkey LEFT JOIN c ON c.tgt = c_custkey"
)
def retrieval_map_fallback(spark, sf_dir):
    top = records.retrieval_map(_found(spark, sf_dir), 2)
    main = top.filter("rank = 1 and tgt % 2 = 0").select("tgt", "src", "sim")
    control = top.filter("rank = 2 and tgt % 3 = 0").select("tgt", "src", "sim")
    return records.with_fallback(main, control, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tgt")))


@query("WITH g AS (SELECT user_id, event_id // 100 AS part, list(event_type) AS names FROM events GROUP BY ALL) SELECT user_id, part FROM g WHERE len(list_filter(names, lambda x: x IN ('error', 'view'))) = 1")
def filter_exactly_one(spark, sf_dir):
    groups = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 100).cast("long").alias("part")).agg(F.collect_list("event_type").alias("names"))
    return groups.filter(filters.exactly_one(F.col("names"), ("error", "view"))).select("user_id", "part")


_STATUS = (
    "WITH r AS (SELECT event_id, event_id % 4 AS n, CASE event_type WHEN 'view' THEN 'assertTrue' WHEN 'click' THEN 'assertNull' WHEN 'error' THEN 'assertEquals' WHEN 'signup' THEN 'assertThat' ELSE 'fail' END AS name, "
    "CASE WHEN event_id % 3 = 0 THEN 'assertThat(x)' WHEN event_id % 5 = 0 THEN 'assertTrue(true)' WHEN event_id % 7 = 0 THEN 'assertNull(null)' ELSE 'f(x)' END AS t, value > 20 AS ok FROM events), "
    "s AS (SELECT event_id, CASE WHEN n <> 1 AND contains(t, 'assertThat') THEN 'assertThat' WHEN n <> 1 THEN 'assertion_count_mismatch' "
    "WHEN name = 'assertTrue' THEN CASE WHEN contains(t, 'true') OR contains(t, 'false') THEN 'trivial_boolean' END WHEN name = 'assertNull' THEN CASE WHEN contains(t, 'null') THEN 'trivial_null' END "
    "WHEN name = 'assertEquals' THEN CASE WHEN NOT ok THEN 'equals_parse_failure' END ELSE 'assertion_type_not_equals' END AS reason FROM r) "
)


def _judged(spark, sf_dir):
    i = F.col("event_id")
    name = F.when(F.col("event_type") == "view", "assertTrue").when(F.col("event_type") == "click", "assertNull").when(F.col("event_type") == "error", "assertEquals").when(F.col("event_type") == "signup", "assertThat").otherwise("fail")
    text = F.when(i % 3 == 0, "assertThat(x)").when(i % 5 == 0, "assertTrue(true)").when(i % 7 == 0, "assertNull(null)").otherwise("f(x)")
    return filters.kept_and_counts(table(spark, sf_dir, "events"), filters.status(i % 4, text, name, F.col("value") > 20))


@query(_STATUS + "SELECT reason, count(*) AS n FROM s WHERE reason IS NOT NULL GROUP BY reason")
def filter_exclusion_counts(spark, sf_dir):
    return _judged(spark, sf_dir)[1]


@query(_STATUS + "SELECT event_id FROM s WHERE reason IS NULL")
def filter_kept_rows(spark, sf_dir):
    return _judged(spark, sf_dir)[0].select("event_id")


@query("SELECT doc_id, contains(text, 'on') AND doc_id % 2 = 0 OR contains(text, 'ly') AND doc_id % 2 = 1 AS trivial FROM documents")
def filter_trivial(spark, sf_dir):
    text = F.replace(F.replace(F.replace("text", F.lit("on"), F.lit("true")), F.lit("ly"), F.lit("null")), F.lit("false"), F.lit("true"))
    return table(spark, sf_dir, "documents").select("doc_id", filters.trivial(text, F.when(F.col("doc_id") % 2 == 0, "Boolean").otherwise("NullValues")).alias("trivial"))


@query("SELECT doc_id, list_filter(string_split(text, ' '), lambda x: contains(x, 'ing')) AS kept FROM documents")
def filter_items_containing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", filters.containing(F.split("text", " "), "ing").alias("kept"))


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1','Brand#2','Brand#3') AND p_brand NOT IN ('Brand#2')")
def filter_allow_deny(spark, sf_dir):
    return filters.allow_deny(table(spark, sf_dir, "part"), "p_brand", ["Brand#1", "Brand#2", "Brand#3"], ["Brand#2"]).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def filter_by_id_set(spark, sf_dir):
    return filters.in_ids(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id")


@query("SELECT doc_id, md5(text) AS digest, md5(text) = md5(trim(text)) AS same FROM documents")
def filter_digest_check(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), filters.same_digest(F.col("text"), F.md5(F.trim("text"))).alias("same"))


@query("SELECT user_id, event_id // 100 AS part FROM events GROUP BY ALL HAVING bool_or(event_type IN ('error', 'signup'))")
def filter_calls_any(spark, sf_dir):
    groups = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 100).cast("long").alias("part")).agg(F.collect_set("event_type").alias("names"))
    return groups.filter(filters.calls_any(F.col("names"), ("error", "signup"))).select("user_id", "part")


@query("SELECT doc_id, CASE WHEN contains(text, 'est') THEN 'void' ELSE 'value' END AS kind FROM documents WHERE contains(text, 'tion') OR contains(text, 'ment')")
def filter_tagged(spark, sf_dir):
    kept = table(spark, sf_dir, "documents").filter(filters.mentions_any(F.col("text"), ("tion", "ment")))
    return kept.select("doc_id", filters.return_kind(F.when(F.contains("text", F.lit("est")), " void ").otherwise("int")).alias("kind"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def filter_without_id_set(spark, sf_dir):
    return filters.in_ids(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", keep=False)


@query("SELECT event_id, event_type FROM events WHERE user_id % 3 <> 0 AND (contains(event_type, 'urch') OR contains(event_type, 'lick'))")
def filter_asserts_bug(spark, sf_dir):
    """Flagged rows whose label has one of the wanted names."""
    events = table(spark, sf_dir, "events")
    return events.filter(filters.asserts_bug((F.col("user_id") % 3).cast("string"), F.col("event_type"), ("urch", "lick"))).select("event_id", "event_type")


@query("SELECT p_partkey, CASE WHEN contains(p_type, 'SMALL') THEN starts_with(p_name, 'red') ELSE contains(p_brand, '#1') END AS is_test FROM part")
def filter_is_test(spark, sf_dir):
    kind = F.replace("p_type", F.lit("SMALL"), F.lit("TestCase"))
    name = F.regexp_replace("p_name", "^red", "test")
    return table(spark, sf_dir, "part").select("p_partkey", filters.is_test(kind, name, F.array(F.replace("p_brand", F.lit("#1"), F.lit("@Test")))).alias("is_test"))


@query("SELECT doc_id, list_filter([{'ok': length(text) % 3 = 0, 'v': 'x'}, {'ok': length(text) % 2 = 0, 'v': 'y'}], lambda a: a.ok)[1].v AS v FROM documents")
def filter_first_parsable(spark, sf_dir):
    n = F.length("text")
    items = F.array(F.struct((n % 3 == 0).alias("ok"), F.lit("x").alias("v")), F.struct((n % 2 == 0).alias("ok"), F.lit("y").alias("v")))
    return table(spark, sf_dir, "documents").select("doc_id", filters.first_parsable(items)["v"].alias("v"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE starts_with(l_returnflag, 'A') AND l_quantity = 1 OR l_linenumber < 2")
def filter_short_or_getter(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter(filters.short_or_getter(F.when(F.col("l_returnflag") == "A", "getX").otherwise("x"), F.col("l_quantity") == 1, F.col("l_linenumber"), 2)).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id AS idx, source AS focal_method, replace(text, 'the', '\"<AssertPlaceHolder>\"') AS test_prefix FROM documents")
def sink_tool_input(spark, sf_dir):
    from granary.sources.sinks import tool_input

    return tool_input(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("focal_method"), F.col("text").alias("test_case"), F.lit("the").alias("assertion")))


@query("SELECT string_agg(source, ',' ORDER BY source) AS ids FROM (SELECT DISTINCT source FROM documents)")
def sink_joined_ids(spark, sf_dir):
    from granary.sources.sinks import joined_ids

    return joined_ids(table(spark, sf_dir, "documents"), "source")


@query("SELECT event_id, 'bad value' AS err_msg FROM events WHERE value < 1")
def sink_error_rows(spark, sf_dir):
    from granary.sources.sinks import split_errors

    return split_errors(table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") < 1, "bad value").alias("err_msg")))[1]
