"""Runs of external commands over every row of a table; the commands are shell tools that stand in for a compiler and a test runner."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.execution import runner
from granary.plans import views
from granary.plans.registry import query
from granary.session import table

#: A compiler that reports each line with BAD after two lines of greeting, and a test run that fails where FAIL stands.
COMPILE = r"""echo Buildfile; echo; grep -n BAD T.java | sed 's/^\([0-9]*\):.*/[javac] T.java:\1: error: bad/'; ! grep -q BAD T.java"""
TEST = "if grep -q FAIL T.java; then echo AssertionFailedError; exit 1; fi"


@query(
    "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'unfilled' ELSE 'ready' END AS status, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 5 <> 1 END AS compiled, "
    "CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 5 > 2 END AS passed, CASE s_suppkey % 5 WHEN 1 THEN 'other' WHEN 2 THEN 'assertion_error' END AS reason FROM supplier"
)
def execute_filled_tests(spark, sf_dir):
    """No answer, one that doesn't compile, one that fails, and two that pass."""
    k = F.col("s_suppkey") % 5
    answer = F.when(k == 1, "BAD").when(k == 2, "FAIL").when(k > 2, "assertEquals(1, x);")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), views.joined("void test", "$s_suppkey", "() {\n  <AssertionPlaceHolder>\n}").alias("test_prefix"), answer.alias("assertion"))
    return runner.fill_and_test(rows.repartition(8, "id"), COMPILE, TEST, "T.java").select("id", "status", "compiled", "passed", "reason")


@query(
    "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 6 IN (1, 2, 3) THEN 2 ELSE 1 END AS rounds, (CASE s_suppkey % 6 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END)::INT AS n_lost, "
    "s_suppkey % 6 <> 4 AS compiled, s_suppkey % 6 IN (0, 1, 2) AS passed FROM supplier"
)
def execute_repaired_classes(spark, sf_dir):
    """Classes with no, one or two bad methods, a bad one beside a failing one, a bad head, and a failing method alone."""
    k = F.col("s_suppkey") % 6
    method = lambda name, body: F.concat(F.lit(f"void {name}() {{\n  "), body, F.lit(";\n}"))
    word = lambda *when: F.when(k.isin(*when), "BAD").otherwise("x = 1")
    methods = F.array(method("a", word(1, 2)), method("b", F.when(k.isin(3, 5), "FAIL").otherwise("y = 1")), method("c", word(2, 3)))
    head = F.when(k == 4, "class T {\nBAD;").otherwise("class T {")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), head.alias("head"), methods.alias("methods"), F.lit("}").alias("tail"))
    return runner.compile_repaired(rows.repartition(8, "id"), COMPILE, TEST, "T.java").select("id", "rounds", "n_lost", "compiled", "passed")
