"""Code structure and model-call queries over source text that is made from the columns of every row of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.agents import client, discussion, prompts
from granary.functions import java
from granary.operators import projects
from granary.plans import views
from granary.plans.registry import query
from granary.session import table

_P = f"WITH {views.PARTS}"
#: The statements of the test made of a part, as SQL lists.
_S = (
    _P + ", s AS (SELECT *, list_transform(range(1, n + 1), lambda i: 'assertEquals(' || CASE WHEN id % 2 = 1 THEN '\"' || a || '\", ' ELSE '' END || z || ', x.get' || i || '());') AS asserted, "
    "'Foo x = new Foo(f(\"' || a || ', ' || b || '\"));' AS declared, id % 5 = 4 AS getter FROM p) "
)


def _tests(spark, sf_dir):
    """A test of n assertions for each part, or a getter."""
    line = lambda i: F.concat(F.lit("  assertEquals("), F.when(F.col("id") % 2 == 1, views.joined('"', "$a", '", ')).otherwise(""), F.col("z").cast("string"), F.lit(", x.get"), i, F.lit("());\n"))
    lines = F.array_join(F.transform(F.slice(F.array(*map(F.lit, "123")), F.lit(1), F.col("n")), line), "")
    test = views.joined("public void test", "$id", '() {\n  Foo x = new Foo(f("', "$a", ", ", "$b", '"));\n', lines, "}")
    getter = views.joined("public int get", "$id", "() { return ", "$z", "; }")
    return views.dealt(views.parts(spark, sf_dir)).select("id", F.when(F.col("id") % 5 == 4, getter).otherwise(test).alias("code"))


@query(_S + "SELECT id, (i - 1)::INT AS ord, 'assertEquals' AS name, (2 + id % 2)::INT AS n_args, CASE WHEN id % 2 = 1 THEN '\"' || a || '\"' ELSE z::VARCHAR END AS first FROM s, unnest(range(1, n + 1)) AS u(i)")
def code_assertions(spark, sf_dir):
    found = _tests(spark, sf_dir).select("id", F.explode(java.assertions_of("code")).alias("a"))
    return found.select("id", "a.ord", "a.name", F.size("a.args").alias("n_args"), F.element_at("a.args", 1).alias("first"))


@query(_P + "SELECT id, CASE id % 8 WHEN 2 THEN z || '.25' WHEN 4 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN a ELSE z::VARCHAR END AS expected, CASE id % 8 WHEN 4 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN b ELSE b || '()' END AS actual FROM p")
def code_expected_actual(spark, sf_dir):
    """Two arguments; a message first; a float first; a message put together; a sum; a message and a delta; one; a delta."""
    k, z, call = F.col("id") % 8, F.col("z").cast("string"), views.joined("$b", "()")
    args = F.when(k == 0, F.array(z, call)).when(k == 1, F.array(views.joined('"', "$a", '"'), z, call)).when(k == 2, F.array(views.joined("$z", ".25"), call, F.lit("0.1"))).when(k == 3, F.array(views.joined('"', "$a", '" + ', "$b"), z, call))
    args = args.when(k == 4, F.array(views.joined("$a", " + ", "$z"), z, call)).when(k == 5, F.array(views.joined('"', "$a", '"'), z, call, F.lit("0.1"))).when(k == 6, F.array(call)).otherwise(F.array("a", "b", views.joined("$z", ".5f")))
    rows = views.dealt(views.parts(spark, sf_dir)).select("id", args.alias("args"))
    return rows.select("id", java.expected_of("args").alias("e")).select("id", "e.expected", "e.actual")


@query(_P + "SELECT id, ['string', 'number', 'float', 'concat', 'arithmetic', 'boolean', 'null', 'other', 'number'][id % 9 + 1] AS kind FROM p")
def code_argument_kinds(spark, sf_dir):
    args = [views.joined('"', "$a", '"'), F.col("z").cast("string"), views.joined("$z", ".5"), views.joined('"', "$a", '" + ', "$b"), views.joined("$a", " * ", "$z"), F.when(F.col("z") > 20, "true").otherwise("false"), F.lit("null"), views.joined("$a", "(", "$z", " + 2)"), views.joined("-", "$z")]
    rows = views.dealt(views.parts(spark, sf_dir)).select("id", F.element_at(F.array(*args), (F.col("id") % 9 + 1).cast("int")).alias("arg"))
    return rows.select("id", java.kind_of("arg").alias("kind"))


@query(_S + "SELECT id, CASE WHEN getter THEN 'get' ELSE 'test' END || id AS name, (1 + n)::INT AS n, CASE WHEN getter THEN [] ELSE list_concat(['f'], flatten(list_transform(range(1, n + 1), lambda i: ['assertEquals', 'get' || i]))) END AS called, getter AS single FROM s")
def code_method_facts(spark, sf_dir):
    return _tests(spark, sf_dir).select("id", java.facts_of("code").alias("f")).select("id", "f.*")


@query(_S + "SELECT id, declared AS variable FROM s WHERE NOT getter")
def code_local_variables(spark, sf_dir):
    return _tests(spark, sf_dir).select("id", F.explode(java.variables_of("code")).alias("variable"))


@query(_S + "SELECT id, CASE WHEN n > 1 THEN 1 + n ELSE 1 END::INT AS variants, n::INT AS prefixes FROM s")
def code_split_by_assertion(spark, sf_dir):
    return _tests(spark, sf_dir).select("id", F.size(java.variants_of("code")).alias("variants"), F.size(java.prefixes_of("code")).alias("prefixes"))


@query(_S + "SELECT id, unnest(list_transform(asserted, lambda x: CASE WHEN x = asserted[1] THEN replace(x, x, 'assertEquals(7, y);') ELSE x END)) AS statement FROM s")
def code_replace_assertion(spark, sf_dir):
    """The assertions of each test after its first one was replaced."""
    replaced = java.each(lambda s: java.replace_assertion(s, "assertEquals(7, y)"), "string")(F.col("code"))
    found = _tests(spark, sf_dir).select("id", replaced.alias("code")).select("id", F.explode(java.assertions_of("code")).alias("a"))
    return found.select("id", "a.statement")


def _class_sources(spark, sf_dir):
    """A class for each part, with a constructor, a nested and an anonymous class, whose methods are not its own."""
    source = views.joined(
        "package p.", "$a", ";\nimport java.util.List;\nimport q.", "$b", ".*;\n/** class { */\nabstract class Other {}\npublic class C", "$id", " extends Base", "$z", " implements Runnable {\n  private int x = ", "$z",
        ";\n  List<String> names;\n  public C", "$id", "() { init(); }\n  public int getX() { return x; }\n  Runnable r = new Runnable() { public void inner() { go(); } };\n  static class Nested { void deep() {} }\n  void run", "$id",
        '() {\n    if (x > ', "$z", ') { x--; }\n    helper("}");\n  }\n  @Test\n  protected static void ', "$a", "(String s) {}\n}\n",
    )
    return views.dealt(views.parts(spark, sf_dir)).select("id", source.alias("source"))


@query(_P + "SELECT id, 'C' || id AS name, 'p.' || a AS package, 'Base' || z AS superclass, 'Runnable' AS interface, ['import java.util.List;', 'import q.' || b || '.*;'] AS imports, 3 AS n_fields, ['getX', 'run' || id, a] AS methods FROM p")
def code_class_facts(spark, sf_dir):
    facts = _class_sources(spark, sf_dir).select("id", java.class_of("source").alias("c"))
    return facts.select("id", "c.name", "c.package", "c.superclass", "c.interface", "c.imports", F.size("c.fields").alias("n_fields"), F.transform("c.methods", lambda m: m["name"]).alias("methods"))


@query(_P + "SELECT id, unnest(['getX', 'run' || id, a]) AS name, unnest([10, 13, 17]) AS start_line, unnest([10, 16, 18]) AS end_line, unnest([true, false, false]) AS is_getter, unnest([false, false, true]) AS is_static_test FROM p")
def code_methods(spark, sf_dir):
    found = _class_sources(spark, sf_dir).select("id", java.methods_of("source").alias("m"))
    names = F.transform(java.getters(F.col("m")), lambda x: x["name"])
    rows = found.select("id", F.explode("m").alias("x"), names.alias("getters"))
    has = lambda w: F.array_contains("x.modifiers", w)
    return rows.select("id", "x.name", "x.start_line", "x.end_line", F.array_contains("getters", F.col("x.name")).alias("is_getter"), (has("static") & has("@Test")).alias("is_static_test"))


@query(_S + "SELECT id, coalesce(asserted[1], '') AS first FROM s")
def code_first_assertion(spark, sf_dir):
    return _tests(spark, sf_dir).select("id", java.first_assertion(F.col("code")).alias("first"))


@query(_P + "SELECT id, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'assertTrue(x' || z || ');' WHEN 2 THEN 'assertEquals(\"' || a || ' ' || b || '\",y);' ELSE 'x=' || z || ';' END AS found FROM p")
def code_answered_assertion(spark, sf_dir):
    k = F.col("id") % 4
    answer = F.when(k == 0, views.joined("assertTrue(", "$a", ")")).when(k == 1, views.joined("$a", "\n```java\nassertTrue( x", "$z", " );\n```")).when(k == 2, views.joined('```\nint y;\nassertEquals("', "$a", " ", "$b", '", y);\n```\n```\nassertNull(z);\n```')).otherwise(views.joined("```\nx = ", "$z", ";"))
    return views.dealt(views.parts(spark, sf_dir)).select("id", answer.alias("answer")).select("id", java.answered_assertion(F.col("answer")).alias("found"))


def _questions(spark, sf_dir):
    return views.dealt(views.votes(spark, sf_dir).filter("ord = 0").select("id", "expected", "kind", "user_id")).select(F.col("id").cast("string").alias("id"), F.col("expected").alias("expected_value"), "kind", views.joined("int f", "$id", "() { return ", "$user_id", "; }").alias("focal_method"), views.joined("assertEquals(<expected_value>, f", "$id", "());").alias("test_prefix"))


@query(f"WITH {views.VOTES}, m AS (SELECT unnest(['a', 'b', 'c']) AS member) SELECT id::VARCHAR AS id, m.member, 'answer ' || CASE WHEN m.member = 'c' AND id % 2 = 1 THEN 'no' ELSE expected END AS response, 2::BIGINT AS messages FROM votes, m WHERE ord = 0")
def agents_first_round(spark, sf_dir):
    rows = discussion.first_round(_questions(spark, sf_dir), ["a", "b", "c"], client.scripted(_speak))
    return rows.select("id", "member", discussion.last(F.col("history")).alias("response"), F.size("history").cast("long").alias("messages"))


def _speak(member: str, history: list[dict], row: dict) -> str:
    """A model that needs no network: c differs on odd ids in the first round and then yields."""
    if member == "c" and int(row["id"]) % 2 and len(history) < 3:
        return "answer no"
    return f"answer {row['expected_value']}"


@query(f"WITH {views.VOTES} SELECT id::VARCHAR AS id, 'answer ' || expected AS response, id % 2 AS rounds FROM votes WHERE ord = 0")
def agents_consensus(spark, sf_dir):
    found = discussion.consensus(_questions(spark, sf_dir), ["a", "b", "c"], client.scripted(_speak), most_rounds=3)
    return found.select("id", "response", F.col("rounds").cast("long").alias("rounds"))


@query(f"WITH {views.VOTES} SELECT id::VARCHAR AS id, CASE WHEN id % 3 = 0 THEN 'YES' ELSE 'NO' END AS verdict FROM votes WHERE ord = 0")
def agents_judge(spark, sf_dir):
    first = discussion.first_round(_questions(spark, sf_dir), ["a", "b"], client.scripted(_speak))
    judge = client.scripted(lambda member, history, row: "**YES** fine" if int(row["id"]) % 3 == 0 else "**NO** wrong")
    return discussion.judged(first, judge).select("id", "verdict")


@query(f"WITH {views.VOTES}, d AS (SELECT id FROM votes GROUP BY id HAVING count(DISTINCT answer) > 1) SELECT id::VARCHAR AS id FROM d")
def agents_debate_selection(spark, sf_dir):
    answers = views.votes(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "member", "answer", "correct")
    return discussion.to_debate(answers)


_Q = f"WITH {views.VOTES}, q AS (SELECT id, expected, kind, 'int f' || id || '() {{ return ' || user_id || '; }}' AS focal, 'assertEquals(<expected_value>, f' || id || '());' AS prefix FROM judged WHERE ord = 0), "
_N = (
    "r AS (SELECT *, CASE kind WHEN 'Boolean' THEN 'Complete the placeholder with assertTrue or assertFalse and say briefly why.' WHEN 'NullValues' THEN 'Complete the placeholder with assertNull or assertNotNull and say briefly why.' "
    "ELSE 'Reply with the code of the expected value only.' END AS rule FROM q), m AS (SELECT *, concat_ws(chr(10), 'Method under test:', focal, 'Test:', prefix, rule) AS prompt FROM r) "
)


def _naive():
    return prompts.naive(F.col("kind"), F.col("focal_method"), F.col("test_prefix"))


@query(f"WITH {views.VOTES} SELECT id::VARCHAR AS id, expected || k AS response, round(exp(-0.15 * (k + 1)) * 100, 2) AS prob FROM votes, unnest(range(2)) AS u(k) WHERE ord = 0")
def agents_samples(spark, sf_dir):
    draw = client.scripted_samples(lambda row, k: (f"{row['expected_value']}{k}", [-0.1 * (k + 1), -0.2 * (k + 1)]))
    return discussion.sampled(_questions(spark, sf_dir), draw, 2)


@query(_Q + _N + "SELECT id::VARCHAR AS id, prompt FROM m")
def agents_prompts(spark, sf_dir):
    return _questions(spark, sf_dir).select("id", _naive().alias("prompt"))


@query(_Q + _N + "SELECT id::VARCHAR AS id, concat_ws(chr(10), 'A similar method:', CASE WHEN id % 3 = 0 THEN 'int g();' ELSE 'int g' || id || '();' END, 'Its test:', CASE WHEN id % 3 = 0 THEN 'test g' ELSE 'test ' || id END, prompt) AS prompt FROM m")
def agents_prompt_with_example(spark, sf_dir):
    """A retrieved example, or the default one for every third question."""
    some = lambda text: F.when(F.col("id").cast("long") % 3 != 0, text)
    asked = prompts.with_example(_naive(), some(views.joined("int g", "$id", "();")), some(views.joined("test ", "$id")), "int g();", "test g")
    return _questions(spark, sf_dir).select("id", asked.alias("prompt"))


@query(
    _Q + _N + "SELECT id::VARCHAR AS id, unnest(range(7))::INT AS step, unnest(['Which scenario does this test check?' || chr(10) || 'test' || id || chr(10) || prefix, 'Which path does the method take in it?' || chr(10) || focal, 'What does the method return on that path?', "
    "concat_ws(chr(10), 'Test:', prefix, rule), 'Explain this method.' || chr(10) || focal, 'Explain this test.' || chr(10) || prefix, 'Write exactly one assertion for the test from both explanations.']) AS prompt FROM m"
)
def agents_prompt_steps(spark, sf_dir):
    """The four steps of one agent and the three of another."""
    four = prompts.steps(views.joined("test", "$id"), F.col("test_prefix"), F.col("focal_method"), F.col("kind"))
    three = prompts.understand(F.col("focal_method"), F.col("test_prefix"))
    return _questions(spark, sf_dir).select("id", F.posexplode(F.array(*four, *three)).alias("step", "prompt"))


@query(_P + "SELECT id, concat_ws(chr(10), CASE WHEN z % 2 = 0 THEN 'Superclass:' || chr(10) || 'Base' || z END, 'Interface:', a, 'Fields:', 'int ' || a || ';', 'int ' || b || ';', 'Method under test:', 'void ' || b || '() {}', 'Write a JUnit 4 test class that covers as much of the method as it can.') AS prompt FROM p")
def agents_prompt_whole_class(spark, sf_dir):
    superclass = F.when(F.col("z") % 2 == 0, views.joined("Base", "$z"))
    asked = prompts.whole_class(superclass, F.col("a"), F.array(views.joined("int ", "$a", ";"), views.joined("int ", "$b", ";")), F.array().cast("array<string>"), views.joined("void ", "$b", "() {}"))
    return views.parts(spark, sf_dir).select("id", asked.alias("prompt"))


def _classes(spark, sf_dir):
    """A source class, its test class and a file without a class for each supplier."""
    k = F.col("s_suppkey")
    s = F.concat(F.lit("S"), k.cast("string"), F.lit("x"))
    lines = lambda text, n: F.repeat(F.lit(text), n.cast("int"))
    source = F.concat(F.lit("package p; public class "), s, F.lit(" { int n; "), s, F.lit("() {} public void push"), k, F.lit("(int v) {\n"), lines(" n++;\n", k % 8), F.lit("} public int getN() { return n; } }"))
    test = F.concat(F.lit("public class "), s, F.lit("Test extends TestCase { public void testPush() { "), s, F.lit(" s = new "), s, F.lit("(); s.push"), k, F.lit("(1); "), F.when(k % 3 > 0, "assertEquals(1, s.n); ").otherwise(""), F.when(k % 3 > 1, "assertTrue(s.ok()); ").otherwise(""), F.lit("} void helper() {} }"))
    file = lambda folder, name, text: F.struct(F.concat(F.lit(folder), name).alias("path"), name.alias("name"), text.alias("text"))
    files = F.array(file("src/", F.concat(s, F.lit(".java")), source), file("test/", F.concat(s, F.lit("Test.java")), test), file("test/", F.concat(s, F.lit(".txt")), F.lit("// nothing")))
    return projects.classes(table(spark, sf_dir, "supplier").select(F.explode(files).alias("f")).select("f.*"))


@query("SELECT 2 * count(*) AS classes, 4 * count(*) AS methods FROM supplier")
def project_totals(spark, sf_dir):
    return projects.totals(_classes(spark, sf_dir))


@query("SELECT 'S' || s_suppkey || 'xTest' AS class_name, 'testPush' AS name, CASE WHEN s_suppkey % 3 = 2 THEN 3 ELSE 1 END AS variants FROM supplier")
def project_tests(spark, sf_dir):
    found = projects.variants(projects.tests(_classes(spark, sf_dir)))
    return found.groupBy("class_name", "name").agg(F.count("*").cast("int").alias("variants"))


@query("SELECT 'S' || s_suppkey || 'xTest' AS class_name, 'testPush' AS name, 'push' || s_suppkey AS focal_name FROM supplier")
def project_focal_methods(spark, sf_dir):
    found = _classes(spark, sf_dir)
    return projects.focal_methods(projects.tests(found), found.filter("path like 'src/%'")).select("class_name", "name", "focal_name")


@query("SELECT 'S' || s_suppkey || 'x' AS class_name, 'push' || s_suppkey AS name FROM supplier WHERE s_suppkey % 8 >= 5")
def project_candidates(spark, sf_dir):
    return projects.candidates(_classes(spark, sf_dir).filter("path like 'src/%'")).select("class_name", "name")


@query("SELECT 'b' || s_nationkey AS bug_id, count(DISTINCT s_suppkey % 3)::INT AS n, max(s_name) FILTER (s_suppkey % 3 = 0) AS k0 FROM supplier GROUP BY s_nationkey")
def project_corpus(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("b"), F.col("s_nationkey").cast("string")).alias("bug_id"), F.concat(F.lit("k"), (F.col("s_suppkey") % 3).cast("string")).alias("key"), F.col("s_name").alias("test"))
    return projects.corpus(rows).select("bug_id", F.size("uts").alias("n"), F.try_element_at("uts", F.lit("k0")).alias("k0"))
