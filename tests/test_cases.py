"""Functions over small inputs whose answers are stated beside them: odd shapes that the supplied tables don't have."""

import pytest
from granary.functions import java, logs
from granary.functions import text as t
from granary.operators import projects
from pyspark.sql import functions as F

CASES = []


def case(names, *rows):
    def put(function):
        CASES.append((function, names.split(", "), rows))
        return function

    return put


def _fixture(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


IDENTIFIERS = {1: "camelCase", 2: "HTTPServer2", 3: "parseXMLDoc", 4: "x1Y2", 5: "_a_b", 6: '"quoted Literal"', 7: ""}
ANSWERS = [(1, "no fence"), (2, "a\n```java\nassertTrue(x);\n```\nb"), (3, "```\none\n two\n```\nmid\n```java\nthree\n```"), (4, "```java\nopen"), (5, "  ```\nAssert.assertNull(y);\n```")]
LOGS = [
    (1, "start\nerror: in\n  [javac] A.java:12: error: missing ;: x\n  [javac] A.java:13: warning: error: x\n  [exec] B.java:7: error: cannot find symbol\n  [javac] Note: y", "--- a.B::testC\njunit.framework.AssertionFailedError: 1\n\tat x\n--- a.B::testD\njava.lang.Error", "Failing tests: 2\n  - a.B::testC", "x\n[ERROR] COMPILATION ERROR : x"),
    (2, "", None, "none", "Tests run: 3, Failures: 1\nBUILD FAILURE"),
    (3, "ok", "java.lang.NullPointerException\n  AssertionX", "Failing tests: 0", "BUILD SUCCESS"),
]


def _logs(spark):
    return _fixture(spark, LOGS, "id int, javac string, failing string, counts string, build string")


TESTS = [
    (1, 'public void testA() {\n  int x = f(1, "a,b");\n  assertEquals(3, x);\n}'),
    (2, 'void testB() { Foo f = new Foo(); assertEquals("msg", f.get(), g(1, 2)); assertTrue("m", f.ok()); assertNull(f.n()); }'),
    (3, "void testC() { run(); }"),
    (4, "int getX() { return x; }"),
    (5, "broken ( {"),
]
CLASS = 'package a.b;\nimport java.util.List;\nimport a.c.*;\n/** doc { */\npublic class Foo extends Base implements Runnable {\n  private int x = 1;\n  List<String> names;\n  public int getX() { return x; }\n  public void run() {\n    if (x > 0) { x--; }\n    helper("}");\n  }\n  @Test\n  protected static void helper(String s) {}\n}\n'


def _tests(spark):
    return spark.createDataFrame(TESTS, "id int, code string")


ARGS = [(1, ["1", "x"]), (2, ['"m"', "1", "x"]), (3, ["1.0", "x", "0.1"]), (4, ['"a" + b', "1", "x"]), (5, ["a + b", "1", "x"]), (6, ['"m"', "1", "x", "0.1"]), (7, ["x"]), (8, ["a", "b", "0.5f"])]


FILES = [
    ("src/Stack.java", "Stack.java", "package a; public class Stack { int n; public void push(int x) {\n n++;\n a[n] = x;\n b();\n c();\n d();\n} public int getN() { return n; } }"),
    ("test/StackTest.java", "StackTest.java", "public class StackTest extends TestCase { public void testPush() { Stack s = new Stack(); s.push(1); assertEquals(1, s.n); assertTrue(s.ok()); } void helper() {} }"),
    ("test/note.java", "note.java", "// nothing"),
]


def _classes(spark):
    return projects.classes(spark.createDataFrame(FILES, "path string, name string, text string"))


@case("id, ord, name, n_args, first", (1, 0, "assertEquals", 2, "3"), (2, 0, "assertEquals", 3, '"msg"'), (2, 1, "assertTrue", 2, '"m"'), (2, 2, "assertNull", 1, "f.n()"))
def code_assertions(spark):
    found = _tests(spark).select("id", F.explode(java.assertions_of("code")).alias("a"))
    return found.select("id", "a.ord", "a.name", F.size("a.args").alias("n_args"), F.element_at("a.args", 1).alias("first"))


@case("id, expected, actual", (1, "1", "x"), (2, "1", "x"), (3, "1.0", "x"), (4, "1", "x"), (5, None, None), (6, "1", "x"), (7, None, None), (8, "a", "b"))
def code_expected_actual(spark):
    return spark.createDataFrame(ARGS, "id int, args array<string>").select("id", java.expected_of("args").alias("e")).select("id", "e.expected", "e.actual")


@case("id, kind", (1, "string"), (2, "number"), (3, "float"), (4, "concat"), (5, "arithmetic"), (6, "boolean"), (7, "null"), (8, "other"), (9, "number"))
def code_argument_kinds(spark):
    rows = list(enumerate(['"a"', "12", "1.5", '"a" + b', "a + 1", "true", "null", "f(1 + 2)", "-3"], 1))
    return spark.createDataFrame(rows, "id int, arg string").select("id", java.kind_of("arg").alias("kind"))


@case("id, name, n, called, single", (1, "testA", 2, ["f", "assertEquals"], False), (2, "testB", 4, ["assertEquals", "get", "g", "assertTrue", "ok", "assertNull", "n"], False), (3, "testC", 1, ["run"], False), (4, "getX", 1, [], True), (5, None, 0, [], False))
def code_method_facts(spark):
    c = F.col("code")
    facts = _tests(spark).select("id", java.name_of(c).alias("name"), java.nloc(c).alias("n"), java.invocations_of(c).alias("called"), java.single_return(c).alias("single"))
    return facts.withColumn("single", F.coalesce("single", F.lit(False)))


@case("id, variable", (1, 'int x = f(1, "a,b");'), (2, "Foo f = new Foo();"))
def code_local_variables(spark):
    return _tests(spark).select("id", F.explode(java.variables_of("code")).alias("variable"))


@case("id, variants, prefixes", (1, 1, 1), (2, 4, 3), (3, 1, 0), (4, 1, 0), (5, 1, 0))
def code_split_by_assertion(spark):
    return _tests(spark).select("id", F.size(java.variants_of("code")).alias("variants"), F.size(java.prefixes_of("code")).alias("prefixes"))


@case("name, package, superclass, interface, imports, n_fields, methods", ("Foo", "a.b", "Base", "Runnable", ["import java.util.List;", "import a.c.*;"], 2, ["getX", "run", "helper"]))
def code_class_facts(spark):
    facts = spark.createDataFrame([(CLASS,)], "source string").select(java.class_of("source").alias("c"))
    return facts.select("c.name", "c.package", "c.superclass", "c.interface", "c.imports", F.size("c.fields").alias("n_fields"), F.transform("c.methods", lambda m: m["name"]).alias("methods"))


@case("name, start_line, end_line, is_getter, is_static_test", ("getX", 8, 8, True, False), ("run", 9, 12, False, False), ("helper", 13, 14, False, True))
def code_methods(spark):
    found = spark.createDataFrame([(CLASS,)], "source string").select(java.methods_of("source").alias("m"))
    names = F.transform(java.getters(F.col("m")), lambda x: x["name"])
    rows = found.select(F.explode("m").alias("x"), names.alias("getters"))
    has = lambda w: F.array_contains("x.modifiers", w)
    return rows.select("x.name", "x.start_line", "x.end_line", F.array_contains("getters", F.col("x.name")).alias("is_getter"), (has("static") & has("@Test")).alias("is_static_test"))


@case("id, first", (1, "assertTrue(x);"), (2, ""))
def code_first_assertion(spark):
    return spark.createDataFrame([(1, "int y; assertTrue(x); assertNull(y);"), (2, "none")], "id int, code string").select("id", java.first_assertion(F.col("code")).alias("first"))


@case("id, found", (1, ""), (2, "assertTrue(x);"), (3, 'assertEquals("a b",y);'), (4, ""), (5, "x=1;"))
def code_answered_assertion(spark):
    rows = [(1, "no fence"), (2, "```java\nassertTrue( x );\n```"), (3, '```\nint y;\nassertEquals("a b", y);\n```\n```\nassertNull(z);\n```'), (4, "```\nint a;\nint b;\n```"), (5, "```\nx = 1;")]
    return spark.createDataFrame(rows, "id int, answer string").select("id", java.answered_assertion(F.col("answer")).alias("found"))


@case("classes, methods", (2, 4))
def project_totals(spark):
    return projects.totals(_classes(spark))


@case("class_name, name, variants", ("StackTest", "testPush", 3))
def project_tests(spark):
    found = projects.variants(projects.tests(_classes(spark)))
    return found.groupBy("class_name", "name").agg(F.count("*").cast("int").alias("variants"))


@case("name, focal_name", ("testPush", "push"))
def project_focal_methods(spark):
    found = _classes(spark)
    sources = found.filter("path like 'src/%'")
    return projects.focal_methods(projects.tests(found), sources).select("name", "focal_name")


@case("class_name, name", ("Stack", "push"))
def project_candidates(spark):
    return projects.candidates(_classes(spark).filter("path like 'src/%'")).select("class_name", "name")


@case("bug_id, n", ("b1", 2), ("b2", 1))
def project_corpus(spark):
    rows = spark.createDataFrame([("b1", "k1", "t"), ("b1", "k1", "u"), ("b1", "k2", "v"), ("b2", "k1", "w")], "bug_id string, key string, test string")
    return projects.corpus(rows).select("bug_id", F.size("uts").alias("n"))


@case("id, parts", (1, ["camel", "Case"]), (2, ["HTTP", "Server2"]), (3, ["parse", "XML", "Doc"]), (4, ["x1", "Y", "2"]), (5, ["a", "b"]), (6, ['"quoted Literal"']), (7, []))
def text_camel_parts(spark):
    return _fixture(spark, list(IDENTIFIERS.items()), "id int, token string").select("id", t.camel_parts(F.col("token")).alias("parts"))


@case("id, tokens", (1, ["assert", "equals", '"a b // c"', "x", "get", "name", "1", "5"]), (2, []))
def text_code_tokens(spark):
    return _fixture(spark, [(1, 'assertEquals("A b // C", x.getName(), /* no */ 1.5); // none'), (2, "")], "id int, code string").select("id", t.code_tokens(F.col("code")).alias("tokens"))


@case("id, code", (1, 'f("a  b",x);'), (2, "'x'+y"), (3, r'"q\" z"+1'), (4, '"openab'))
def text_strip_outside_literals(spark):
    rows = [(1, ' f( "a  b", x );'), (2, "'x' + y"), (3, r'"q\" z" + 1'), (4, '"open a b')]
    return _fixture(spark, rows, "id int, code string").select("id", t.strip_outside_literals(F.col("code")).alias("code"))


@case("id, joined, first_stripped, first", (1, "", "", ""), (2, "assertTrue(x);", "assertTrue(x);", "assertTrue(x);"), (3, "one\n two\nthree", "one\ntwo", "one\n two"), (4, "open", "open", "open"), (5, "", "assertNull(y);", ""))
def text_fenced_blocks(spark):
    a = F.col("answer")
    return _fixture(spark, ANSWERS, "id int, answer string").select("id", t.fenced_joined(a).alias("joined"), t.fenced_first_stripped(a).alias("first_stripped"), t.fenced_first(a).alias("first"))


@case("id, imports", (1, "import a.b.*;\nimport java.util.List;"), (2, ""))
def text_import_lines(spark):
    rows = [(1, "package a.b;\nimport java.util.List;\n import static x.Y.z;\nclass C {}"), (2, "class D {}")]
    return _fixture(spark, rows, "id int, source string").select("id", t.import_lines(F.col("source")).alias("imports"))


@case("id, text", (1, "a\n\nb\n \nc"), (2, "x"), (3, "a\n"))
def text_blank_lines(spark):
    return _fixture(spark, [(1, "a\n\n\nb\n \n\nc"), (2, "\n\nx"), (3, "a\n\n")], "id int, text string").select("id", t.collapse_blank_lines(F.col("text")).alias("text"))


@case("id, path", (1, "a/b/C.java"), (2, "D.java"))
def text_signature_path(spark):
    return _fixture(spark, [(1, "a.b.C::run"), (2, "D")], "id int, s string").select("id", t.signature_path(F.col("s")).alias("path"))


@case("id, types", (1, []), (2, ["java.lang.integer", "java.lang.string"]), (3, ["java.lang.long[][]", "java.util.list", "java.lang.boolean[]"]))
def text_descriptor_types(spark):
    rows = [(1, "()V"), (2, "(ILjava/lang/String;)V"), (3, "([[JLjava/util/List;[Z)I")]
    return _fixture(spark, rows, "id int, d string").select("id", t.descriptor_types(F.col("d")).alias("types"))


@case("kind, answers", ("boolean", "true, false"), ("number", "0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 200, 404, 500"), ("string", None))
def text_candidate_values(spark):
    return _fixture(spark, [("boolean",), ("number",), ("string",)], "kind string").select("kind", t.candidate_values(F.col("kind")).alias("answers"))


@case("id, line, message", (1, 12, "missing ;"), (1, 7, "cannot find symbol"))
def log_compile_errors(spark):
    return _logs(spark).select("id", F.explode(logs.compile_errors(F.col("javac"))).alias("e")).select("id", "e.line", "e.message")


@case("id, name, reason", (1, "a.B::testC", "junit.framework.AssertionFailedError: 1"), (1, "a.B::testD", "java.lang.Error"))
def log_failing_tests(spark):
    return _logs(spark).select("id", F.explode(logs.failing_tests(F.col("failing"))).alias("f")).select("id", "f.name", "f.reason")


@case("id, n, failure, compiled, tested", (1, 2, "assertion_error", "compilation failure", None), (2, None, "no_failing_test_file", "success", "Failed Execution"), (3, 0, "other", "success", "Passed"))
def log_status(spark):
    return _logs(spark).select("id", logs.failing_count(F.col("counts")).alias("n"), logs.failure_class(F.col("failing")).alias("failure"), logs.compile_result(F.col("build")).alias("compiled"), logs.test_result(F.col("build"), F.lit(True)).alias("tested"))


@case("id, ok", (1, True), (2, True), (3, False), (4, True), (5, True))
def text_parameter_matches(spark):
    rows = [(1, "List<A>", "java.util.list"), (2, "String", "Ljava.lang.string;"), (3, "Map", "java.util.set"), (4, "char", "java.lang.character"), (5, "int[]", "java.lang.integer[]")]
    return _fixture(spark, rows, "id int, declared string, found string").select("id", t.parameter_matches(F.col("declared"), F.col("found")).alias("ok"))


@pytest.mark.parametrize(("function", "names", "rows"), CASES, ids=[f.__name__ for f, _, _ in CASES])
def test_case(spark, function, names, rows):
    frame = function(spark)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(map(str, ([r[n] for n in names] for r in frame.collect()))) == sorted(map(str, map(list, rows)))
