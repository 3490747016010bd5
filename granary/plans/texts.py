"""Text function queries over the supplied tables; source text and logs are made from their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import logs
from granary.functions import text as t
from granary.plans import views
from granary.plans.registry import query
from granary.session import table


@query("SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS tokens FROM documents")
def text_space_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.space_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS packed, contains(regexp_replace(text, '\\s+', '', 'g'), 'thea') AS found FROM documents")
def text_without_space(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.without_space(F.col("text")).alias("packed"), t.contains_without_space(F.col("text"), F.lit("the a")).alias("found"))


@query("SELECT doc_id, CASE WHEN instr(text, 'the') > 0 THEN left(text, instr(text, 'the') - 1) || '<x>' || substr(text, instr(text, 'the') + 3) ELSE text END AS once, replace(text, 'the', '<x>') AS every FROM documents")
def text_replace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.replace_first(F.col("text"), F.lit("the"), F.lit("<x>")).alias("once"), F.replace("text", F.lit("the"), F.lit("<x>")).alias("every"))




@query("SELECT o_orderkey, regexp_full_match(v, '-?\\d+(\\.\\d+)?') AS is_number FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice::VARCHAR WHEN 1 THEN '-' || o_custkey::VARCHAR WHEN 2 THEN o_orderstatus ELSE o_custkey::VARCHAR || '.' END AS v FROM orders)")
def text_is_number(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    v = F.when(k == 0, F.col("o_totalprice").cast("string")).when(k == 1, F.concat(F.lit("-"), F.col("o_custkey").cast("string"))).when(k == 2, F.col("o_orderstatus")).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".")))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.is_number(v).alias("is_number"))


@query("SELECT doc_id, length(w) - length(replace(w, chr(10), '')) - 1 AS newlines FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS w FROM documents)")
def text_newline_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.newline_count(F.col("text")).cast("long").alias("newlines"))


@query("SELECT page_id, split_part(url, '/', 1) AS prefix, regexp_extract(url, '^(.*)\\.[^.]*$', 1) AS before, split_part(url, '.', -1) AS after FROM pages")
def text_split_parts(spark, sf_dir):
    before, after = t.split_at_last(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", t.prefix_of(F.col("url"), "/").alias("prefix"), before.alias("before"), after.alias("after"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'Boolean' WHEN 'click' THEN 'Boolean' WHEN 'error' THEN 'NullValues' ELSE 'Equals' END AS kind, event_type IN ('view', 'click') AS same FROM events")
def text_expected_kind(spark, sf_dir):
    e = F.col("event_type")
    expected = F.when(e == "view", "assertTrue").when(e == "click", "assertFalse").when(e == "error", "assertNull").otherwise(e)
    truth = F.when(e == "view", "true").when(e == "click", "false").otherwise(e)
    answer = F.when(e == "view", "assertTrue(x)").when(e == "click", "assertFalse(x)").otherwise("y")
    return table(spark, sf_dir, "events").select("event_id", t.expected_kind(expected).alias("kind"), t.boolean_equivalent(truth, answer).alias("same"))


@query("SELECT event_id, json_extract_string(to_json({'k': CAST(json_extract_string(props, '$.k') AS BIGINT), 't': event_type}), '$.t') AS t FROM events")
def text_json_round_trip(spark, sf_dir):
    encoded = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("t")))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(encoded, "k long, t string")["t"].alias("t"))


@query("SELECT s_suppkey AS m FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier, nation WHERE s_nationkey % 5 = n_nationkey % 5 AND n_nationkey * 3 BETWEEN s_suppkey AND s_suppkey + 4)")
def log_methods_without_error(spark, sf_dir):
    errors = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).alias("file"), (F.col("n_nationkey") * 3).alias("line"))
    methods = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("file"), F.col("s_suppkey").alias("m"), F.col("s_suppkey").alias("start_line"), (F.col("s_suppkey") + 4).alias("end_line"))
    return logs.methods_hit(errors, methods, keep=True).select("m")


_P = f"WITH {views.PARTS} "
_camel = "upper(left(b, 1)) || substr(b, 2)"


def _of(spark, sf_dir, *parts):
    """id and a text of literals and columns of each part."""
    return views.parts(spark, sf_dir).select("id", "z", "a", "b", views.joined(*parts).alias("x"))


@query(_P + f"SELECT id, CASE id % 3 WHEN 0 THEN [a, {_camel} || z] WHEN 1 THEN [upper(a), {_camel}] ELSE ['\"' || a || {_camel} || '\"'] END AS parts FROM p")
def text_camel_parts(spark, sf_dir):
    camel = F.initcap("b")
    token = F.when(F.col("id") % 3 == 0, F.concat("a", camel, "z")).when(F.col("id") % 3 == 1, F.concat(F.upper("a"), camel)).otherwise(F.concat(F.lit('"'), "a", camel, F.lit('"')))
    return views.parts(spark, sf_dir).select("id", t.camel_parts(token).alias("parts"))


@query(_P + "SELECT id, ['assert', 'equals', '\"' || a || ' // ' || b || '\"', a, 'get', b, z::VARCHAR] AS tokens FROM p")
def text_code_tokens(spark, sf_dir):
    rows = views.parts(spark, sf_dir).select("id", views.joined('assertEquals("', F.initcap("a"), " // ", "$b", '", ', "$a", ".get", F.initcap("b"), "(), /* no */ ", "$z", "); // none").alias("x"))
    return rows.select("id", t.code_tokens(F.col("x")).alias("tokens"))


@query(_P + "SELECT id, 'f(\"' || a || '  ' || b || '\",x' || z || ')+' || chr(39) || left(a, 1) || ' ' || chr(39) || ';' AS code FROM p")
def text_strip_outside_literals(spark, sf_dir):
    rows = views.parts(spark, sf_dir).select("id", views.joined(' f( "', "$a", "  ", "$b", '", x', "$z", " )\n + '", F.left("a", F.lit(1)), " ' ;\n").alias("x"))
    return rows.select("id", t.strip_outside_literals(F.col("x")).alias("code"))


@query(_P + "SELECT id, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Assert.' || a || chr(10) || ' ' || b || chr(10) || z ELSE ' ' || a END AS joined, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN a || chr(10) || b ELSE a END AS first_stripped, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Assert.' || a || chr(10) || ' ' || b ELSE ' ' || a END AS first FROM p")
def text_fenced_blocks(spark, sf_dir):
    two = views.joined("say\n```java\nAssert.", "$a", "\n ", "$b", "\n```\nmid\n```\n", "$z", "\n```\nend")
    answer = F.when(F.col("id") % 3 == 0, views.joined("no fence ", "$a")).when(F.col("id") % 3 == 1, two).otherwise(views.joined("```\n ", "$a"))
    return views.parts(spark, sf_dir).select("id", t.fenced_joined(answer).alias("joined"), t.fenced_first_stripped(answer).alias("first_stripped"), t.fenced_first(answer).alias("first"))


@query(_P + "SELECT id, 'import ' || a || '.' || b || '.*;' || chr(10) || 'import java.' || b || '.C' || z || ';' AS imports FROM p")
def text_import_lines(spark, sf_dir):
    rows = _of(spark, sf_dir, "package ", "$a", ".", "$b", ";\nimport java.", "$b", ".C", "$z", ";\n import static x.", "$a", ";\nclass D {}")
    return rows.select("id", t.import_lines(F.col("x")).alias("imports"))


@query(_P + "SELECT id, a || chr(10) || chr(10) || b || chr(10) || ' ' || chr(10) || z AS text FROM p")
def text_blank_lines(spark, sf_dir):
    return _of(spark, sf_dir, "\n\n", "$a", "\n\n\n", "$b", "\n \n\n", "$z").select("id", t.collapse_blank_lines(F.col("x")).alias("text"))


@query(_P + "SELECT id, a || '/' || b || '/C' || z || '.java' AS path FROM p")
def text_signature_path(spark, sf_dir):
    return _of(spark, sf_dir, "$a", ".", "$b", ".C", "$z", "::run").select("id", t.signature_path(F.col("x")).alias("path"))


@query(_P + "SELECT id, CASE WHEN id % 4 = 0 THEN [] ELSE ['java.lang.integer', 'java.lang.long[][]', a || '.' || b || z, 'java.lang.boolean[]'] END AS types FROM p")
def text_descriptor_types(spark, sf_dir):
    rows = views.parts(spark, sf_dir).select("id", F.when(F.col("id") % 4 == 0, "()V").otherwise(views.joined("(I[[JL", "$a", "/", F.initcap("b"), "$z", ";[Z)I")).alias("x"))
    return rows.select("id", t.descriptor_types(F.col("x")).alias("types"))


@query(_P + "SELECT id, CASE id % 3 WHEN 0 THEN 'true, false' WHEN 1 THEN '0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 200, 404, 500' END AS answers FROM p")
def text_candidate_values(spark, sf_dir):
    kind = F.when(F.col("id") % 3 == 0, "boolean").when(F.col("id") % 3 == 1, "number").otherwise(F.col("a"))
    return views.parts(spark, sf_dir).select("id", t.candidate_values(kind).alias("answers"))


@query(_P + "SELECT id, CASE id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN a = b WHEN 3 THEN true WHEN 4 THEN z = 5 ELSE false END AS ok FROM p")
def text_parameter_matches(spark, sf_dir):
    k = F.col("id") % 6
    declared = F.when(k == 0, F.concat(F.initcap("a"), F.lit("<B>"))).when(k == 1, F.initcap("b")).when(k == 2, F.col("a")).when(k == 3, "char").when(k == 4, F.concat(F.lit("C"), "z")).otherwise("int")
    found = F.when(k == 0, F.concat(F.lit("java."), "a")).when(k == 1, F.concat(F.lit("Lx."), "b", F.lit(";"))).when(k == 2, F.concat(F.lit("x."), "b")).when(k == 3, "java.lang.character").when(k == 4, "x.c5").otherwise("java.lang.long")
    return views.parts(spark, sf_dir).select("id", t.parameter_matches(declared, found).alias("ok"))


@query(_P + "SELECT id, z AS line, 'missing ' || a AS message FROM p UNION ALL SELECT id, id::INT, 'cannot find ' || b FROM p WHERE id % 2 = 0")
def log_compile_errors(spark, sf_dir):
    second = F.when(F.col("id") % 2 == 0, views.joined("\n  [exec] B.java:", "$id", ": error: cannot find ", "$b")).otherwise("")
    rows = views.parts(spark, sf_dir).select("id", views.joined("start\n[javac] X.java:1: error: in\n  [javac] A.java:", "$z", ": error: missing ", "$a", ": x\n  [javac] A.java:7: warning: error: x", second, "\n  [javac] Note: error: y").alias("x"))
    return rows.select("id", F.explode(logs.compile_errors(F.col("x"))).alias("e")).select("id", "e.line", "e.message")


@query(_P + "SELECT id, a || '.B::test' || z AS name, 'junit.Error: ' || b AS reason FROM p UNION ALL SELECT id, b || '::t', '' FROM p WHERE id % 2 = 0")
def log_failing_tests(spark, sf_dir):
    second = F.when(F.col("id") % 2 == 0, views.joined("\n--- ", "$b", "::t")).otherwise("")
    rows = views.parts(spark, sf_dir).select("id", views.joined("--- ", "$a", ".B::test", "$z", "\njunit.Error: ", "$b", "\n\tat ", "$a", second).alias("x"))
    return rows.select("id", F.explode(logs.failing_tests(F.col("x"))).alias("f")).select("id", "f.name", "f.reason")


@query(_P + "SELECT id, CASE WHEN id % 3 <> 2 THEN z END AS n, CASE id % 3 WHEN 0 THEN 'assertion_error' WHEN 1 THEN 'other' ELSE 'no_failing_test_file' END AS failure, CASE WHEN id % 4 = 0 THEN 'compilation failure' ELSE 'success' END AS compiled, CASE id % 4 WHEN 1 THEN 'Passed' WHEN 2 THEN CASE WHEN id % 3 = 0 THEN 'Failed Execution' ELSE 'Failed Compilation' END END AS tested FROM p")
def log_status(spark, sf_dir):
    k, m = F.col("id") % 3, F.col("id") % 4
    listing = F.when(k == 0, views.joined("--- ", "$a", "\njunit.AssertionError: ", "$b")).when(k == 1, views.joined("java.lang.", "$a", "\n  AssertionError"))
    count = F.when(k != 2, views.joined("x\nFailing tests: ", "$z", "\n - ", "$a")).otherwise("none")
    build = F.when(m == 0, "[ERROR] COMPILATION ERROR : x").when(m == 1, views.joined("$a", "\nBUILD SUCCESS")).when(m == 2, views.joined("Tests run: ", "$z", ", Failures: 1")).otherwise("")
    rows = views.parts(spark, sf_dir)
    return rows.select("id", logs.failing_count(count).alias("n"), logs.failure_class(listing).alias("failure"), logs.compile_result(build).alias("compiled"), logs.test_result(build, k == 0).alias("tested"))


@query(
    "WITH p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'private' END AS modifier, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_size::varchar END AS v, replace(p_name, ' ', '') AS n, replace(p_type, ' ', '') AS t FROM part) "
    "SELECT p_partkey, CASE WHEN modifier IS NULL THEN '' ELSE modifier || ' ' END || t || ' ' || n || CASE WHEN v = '' THEN '' ELSE ' = ' || v END AS field, t || '#' || n AS field_sign, "
    "'public ' || t || ' ' || n || '(int a,' || t || ' b);' AS method, t || ' C' || p_partkey || '#' || n || '(int#a,' || t || '#b)' AS method_sign, 'a.b.C' || p_partkey AS class_sign FROM p"
)
def text_entity_strings(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "private").alias("modifier"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_size").cast("string")).alias("v"), F.replace("p_name", F.lit(" "), F.lit("")).alias("n"), F.replace("p_type", F.lit(" "), F.lit("")).alias("t"))
    kind, name, owner, none = F.col("t"), F.col("n"), F.concat(F.lit("C"), F.col("p_partkey").cast("string")), F.lit(None).cast("string")
    ab = [(F.lit("int"), F.lit("a")), (kind, F.lit("b"))]
    return rows.select(
        "p_partkey", t.field_definition(F.col("modifier"), kind, name, F.col("v")).alias("field"), t.field_signature(kind, name).alias("field_sign"),
        t.method_definition(F.lit("public"), kind, name, F.array(*(t.field_definition(none, *x, none) for x in ab))).alias("method"),
        t.method_signature(kind, owner, name, F.array(*(t.field_signature(*x) for x in ab))).alias("method_sign"), t.class_signature(F.lit("a.b"), owner).alias("class_sign"),
    )
