"""Readers and writers in round trips: columns of a table are written as files in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.plans import views
from granary.plans.registry import query
from granary.session import table
from granary.sources import named_files, records, sinks
from granary.storage import scratch

TURNS = "conv_id long, turn long, role string, text string"


def _written_lines(rows, order: list[str], path: str) -> str:
    """Texts of the column `value` in files whose names follow the order."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)
    return path


@query("SELECT conv_id, turn, role, text FROM conversations")
def scan_json_lines(spark, sf_dir):
    path = scratch(spark)
    sinks.write_jsonl(table(spark, sf_dir, "conversations"), path)
    return records.read_jsonl(spark, path, TURNS).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id AS id, last(role ORDER BY turn) AS role, last(turn ORDER BY turn) AS turn FROM conversations GROUP BY conv_id")
def scan_keyed_file(spark, sf_dir):
    """The last line of each id wins; its nested record is laid open. Blank lines don't count."""
    line = F.to_json(F.struct(F.col("conv_id").alias("id"), F.struct("role", "turn").alias("record")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array(F.lit(""), line)).alias("value"))
    path = _written_lines(rows, ["conv_id", "turn"], scratch(spark))
    return records.nested(records.read_keyed(spark, path, "id long, record struct<role:string,turn:long>"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS line_no, 'C' || p_partkey || ' ' || p_name AS value FROM part")
def scan_numbered_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.concat(F.lit("C"), "p_partkey"), "p_name").alias("value"))
    return records.read_lines(spark, _written_lines(rows, ["p_partkey"], scratch(spark)))


@query(
    f"WITH {views.PARTS}, l AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS line_no FROM p) "
    "SELECT line_no, 'assertEquals(' || z || ', x)' AS assertion, 'void test' || id || '() { assertEquals(' || z || ', x); }' AS test_case, 'int ' || a || '() {}' AS focal_method FROM l WHERE id % 7 <> 0"
)
def scan_paired_files(spark, sf_dir):
    """Line i of one file belongs to line i of the other, blank lines apart; methods without a focal method go."""
    rows = views.parts(spark, sf_dir)
    focal = F.when(F.col("id") % 7 != 0, views.joined(' "<FocalMethod>" int ', "$a", "() {}")).otherwise("")
    left = rows.select("id", F.explode(F.array(views.joined("assertEquals(", "$z", ", x)"), F.lit("  "))).alias("value"))
    right = rows.select("id", views.joined("void test", "$id", '() { "<AssertPlaceHolder>"; }', focal).alias("value"))
    found = records.open_dataset("PAIRED", spark, _written_lines(left, ["id"], scratch(spark)), _written_lines(right, ["id"], scratch(spark)))
    return found.select("line_no", "assertion", "test_case", "focal_method")


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END AS s_nationkey FROM supplier")
def scan_csv_file(spark, sf_dir):
    path = scratch(spark)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("s_nationkey"))
    rows.write.option("header", "true").option("nullValue", "-").csv(path)
    return records.read_csv(spark, path, "s_suppkey long, s_name string, s_nationkey int")


@query("SELECT r_name AS package, n_name AS class, 'm' || n_nationkey AS method, '()V' AS descriptor FROM nation JOIN region ON n_regionkey = r_regionkey")
def scan_coverage_file(spark, sf_dir):
    method = views.joined('<class name="', "$n_name", '"><method name="m', "$n_nationkey", '" desc="()V"/><method name="n" desc="(I)V"/></class>')
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    value = F.concat(F.lit('<package name="'), "r_name", F.lit('">'), F.array_join(F.collect_list(method), ""), F.lit("</package>"))
    report = F.concat(F.lit("<report>"), F.array_join(F.collect_list("value"), ""), F.lit("</report>"))
    path = scratch(spark)
    rows.groupBy("r_name").agg(value.alias("value")).agg(report.alias("value")).write.text(path)  # a file is one report
    return records.read_coverage(spark, path).filter("method <> 'n'")


@query("SELECT n_name AS stem, 'class ' || n_name AS text FROM nation")
def scan_source_tree(spark, sf_dir):
    """Files of a tree by their suffix, in folders below it."""
    path = scratch(spark)
    sinks.write_texts(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("class "), "n_name").alias("text")), path)
    found = records.read_files(spark, path, ".txt")
    return found.select(F.url_decode(F.regexp_extract("path", "name=([^/]+)/", 1)).alias("stem"), F.trim(F.regexp_replace("text", "\n", "")).alias("text"))


@query(f"WITH {views.VOTES} SELECT id, member, answer FROM votes")
def sink_by_member(spark, sf_dir):
    path = scratch(spark)
    sinks.write_by_member(views.votes(spark, sf_dir).select("id", "member", "answer"), path)
    return spark.read.schema("id long, answer string, member string").json(path)


@query(f"WITH {views.VOTES} SELECT id, member, answer FROM votes WHERE member <> 'b'")
def sink_merged_shards(spark, sf_dir):
    """A shard a member, of which one is missing; merged, then gone."""
    folder, schema = scratch(spark), "id long, member string, answer string"
    rows = views.votes(spark, sf_dir).select("id", "member", "answer")
    for member in "ac":
        sinks.write_jsonl(rows.filter(F.col("member") == member), f"{folder}_{member}")
    sinks.merge_shards(spark, [f"{folder}_{member}" for member in "abc"], folder, schema)
    if any(records.exists(spark, f"{folder}_{member}") for member in "abc"):
        raise RuntimeError("a merged shard is still there")
    return records.read_jsonl(spark, folder, schema).select("id", "member", "answer")


@query(f"WITH {views.VOTES}, j AS (SELECT * FROM judged) SELECT member, count(*) FILTER (correct) AS n FROM j GROUP BY member")
def sink_result_file(spark, sf_dir):
    summary = views.votes(spark, sf_dir).groupBy("member").agg(F.count_if("correct").alias("n"))
    return spark.read.schema("member string, n long").json(sinks.write_result(summary, scratch(spark) + ".jsonl"))


@query("SELECT e.vec_id::VARCHAR AS key, e.embedding[1]::DOUBLE AS first FROM embeddings e")
def scan_embedding_file(spark, sf_dir):
    path = scratch(spark)
    sinks.write_jsonl(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("key"), "embedding"), path)
    return records.open_dataset("Embeddings", spark, path).select("key", F.col("embedding")[0].cast("double").alias("first"))


@query("SELECT 'bug-' || p_partkey % 200 || '.tar.bz2' AS archive, 'T' || p_partkey || '.java' AS name, p_name AS text FROM part")
def sink_archives(spark, sf_dir):
    """A table's texts as files in archives, stored and unpacked again."""
    part = table(spark, sf_dir, "part")
    files = part.select(views.joined("bug-", (F.col("p_partkey") % 200).cast("string")).alias("group"), F.concat(F.lit("T"), "p_partkey", F.lit(".java")).alias("name"), F.col("p_name").alias("content"))
    path = scratch(spark)
    sinks.archives(files).write.parquet(path)
    return records.read_archives(spark.read.parquet(path)).select("archive", "name", F.col("content").cast("string").alias("text"))


@query("SELECT o_custkey AS id, CAST(count(*) + 1 AS BIGINT) AS n FROM orders GROUP BY o_custkey")
def scan_saved_state(spark, sf_dir):
    """State that isn't there is empty; it is saved, read, changed and saved in its place again."""
    path, schema = scratch(spark), "id long, n long"
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    sinks.write_state(records.read_state(spark, path, schema).unionByName(counts), path)
    sinks.write_state(records.read_state(spark, path, schema).withColumn("n", F.col("n") + 1), path)
    return records.read_state(spark, path, schema)


@query(
    f"WITH {views.PARTS}, l AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS line_no FROM p) "
    "SELECT line_no AS id, 'assertEquals(' || z || ', x)' AS assertion, a AS focal_method_name FROM l WHERE id % 7 <> 0"
)
def scan_numbered_sources(spark, sf_dir):
    """Numbers count every pair of lines, also those that are left out for want of a name."""
    rows = views.parts(spark, sf_dir)
    focal = F.when(F.col("id") % 7 != 0, views.joined(' "<FocalMethod>" int ', "$a", "() {}")).otherwise(' "<FocalMethod>" int x;')
    left = rows.select("id", F.explode(F.array(views.joined("assertEquals(", "$z", ", x)"), F.lit("  "))).alias("value"))
    right = rows.select("id", views.joined("void test", "$id", '() { "<AssertPlaceHolder>"; }', focal).alias("value"))
    found = records.read_paired_sources(spark, _written_lines(left, ["id"], scratch(spark)), _written_lines(right, ["id"], scratch(spark)))
    return found.select("id", "assertion", "focal_method_name")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS tgt, o_custkey::VARCHAR AS src FROM orders")
def scan_positional_map(spark, sf_dir):
    """A retrieval map by position: line numbers are targets, blank lines don't count."""
    line = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("id"), F.lit(0.5).alias("sim")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(F.lit(" "), line)).alias("value"))
    return records.read_positional(spark, _written_lines(rows, ["o_orderkey"], scratch(spark)))


@query("WITH n AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS id, item_id, text FROM benchmark) SELECT id, item_id AS target_bug, item_id AS retrieved_bug, text AS target_test, 'r ' || text AS retrieved_test FROM n")
def scan_target_pairs(spark, sf_dir):
    """Each line is a target and what was retrieved for it, under one number."""
    record = F.struct(F.col("item_id").alias("bug_id"), F.col("text").alias("test_case"), F.concat(F.lit("r "), "text").alias("retrieved_test_case"))
    path = _written_lines(table(spark, sf_dir, "benchmark").select("item_id", F.to_json(record).alias("value")), ["item_id"], scratch(spark))
    pairs = records.read_target_pairs(spark, path, "bug_id long, test_case string, retrieved_test_case string")
    return pairs.select("id", *(F.col(f"{side}.{f}").alias(f"{side}_{n}") for side in ("target", "retrieved") for f, n in (("bug_id", "bug"), ("test_case", "test"))))


@query("SELECT 'p' || s_nationkey || '_' || s_suppkey AS id, 'p' || s_nationkey AS project, s_name AS body FROM supplier")
def scan_record_files(spark, sf_dir):
    """A JSON document a file in folders of a tree, each under its own name."""
    path = scratch(spark)
    supplier = table(spark, sf_dir, "supplier")
    stem = F.concat(F.lit("p"), "s_nationkey", F.lit("_"), "s_suppkey")
    text = F.to_json(F.struct(F.struct(F.col("s_name").alias("body")).alias("test_case")), {"pretty": "true"})
    named_files.write_files(supplier, path, F.concat(F.lit("d"), F.col("s_suppkey") % 5, F.lit("/"), stem, F.lit(".json")), text)
    return records.read_record_files(spark, path, "test_case struct<body:string>").select("id", "project", F.col("test_case.body").alias("body"))


@query("SELECT 'Bug_' || n_nationkey AS bug, v AS version, 'class ' || n_name || chr(10) || '}' AS text FROM nation, (VALUES ('buggy'), ('fixed')) AS t(v)")
def sink_named_files(spark, sf_dir):
    """Generated test classes under their own path, byte for byte."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "nation").withColumn("version", F.explode(F.array(F.lit("buggy"), F.lit("fixed"))))
    bug = F.concat(F.lit("Bug_"), "n_nationkey")
    named_files.write_files(rows, path, named_files.class_path(bug, F.col("version"), F.lit("/src/test/java")), F.concat(F.lit("class "), "n_name", F.lit("\n}")))
    found = records.read_files(spark, path, ".java")
    place = lambda k: F.regexp_extract("path", r"(Bug_\d+)/(buggy|fixed)/src/test/java/org/llm/LLMTests\.java$", k)
    return found.select(place(1).alias("bug"), place(2).alias("version"), "text")
