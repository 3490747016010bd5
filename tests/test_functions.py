import pytest

from granary.functions import java


@pytest.mark.parametrize(
    ("args", "expected"),
    [(["1", "x"], ("1", "x")), (['"m"', "1", "x"], ("1", "x")), (["a", "b", "0.1"], ("a", "b")), (["a + b", "1", "x"], (None, None)), (["a"], (None, None)), (['"m"', "1", "x", "2"], ("1", "x")), (list("abcde"), (None, None))],
)
def test_expected_actual(args, expected):
    assert java.expected_actual(args) == expected


def test_literals_and_comments_do_not_confuse_brackets():
    source = 'void t() { /* assertTrue(a); */ String s = "}("; assertEquals("a,b", f(\'(\', g(1, 2))); // assertNull(x)\n}'
    found = java.assertions(source)
    assert [(a["name"], a["args"]) for a in found] == [("assertEquals", ['"a,b"', "f('(', g(1, 2))"])]


def test_generics_do_not_part_arguments():
    found = java.methods("public Map<String, List<A>> f(Map<String, B> m, int... x) throws E { return null; }")
    assert [(m["name"], m["return_type"], m["params"]) for m in found] == [("f", "Map<String, List<A>>", ["Map<String, B> m", "int... x"])]


def test_variants_and_prefixes():
    source = "void t() {\n  a();\n  assertTrue(x);\n  assertNull(y);\n}"
    variants = java.split_by_assertion(source)
    assert variants[0] == source and len(variants) == 3
    assert "assertNull" not in variants[1] and "assertTrue" not in variants[2]
    prefixes = java.assertion_prefixes(source)
    assert [p["assertion"] for p in prefixes] == ["assertTrue(x);", "assertNull(y);"]
    assert "assertTrue" not in prefixes[1]["ut"]


def test_broken_sources_give_nothing():
    assert java.method_name("int f( {") is None
    assert java.class_facts("no class here") is None
    assert java.assertions(None) == [] and java.methods("") == [] and java.body_statements("x") == []


def test_class_choice():
    source = "abstract class A {}\npublic abstract class B {}\npublic class C { int x; }"
    assert java.class_facts(source)["name"] == "C"
    assert java.class_facts(source, "A")["name"] == "A"


def test_unary_subject():
    assert java.unary_subject(["x"]) == "x"
    assert java.unary_subject(['"m"', "x"]) == "x"
    assert java.unary_subject(["x", '"m"']) == "x"
    assert java.unary_subject(["a", "b", "c"]) is None


def test_replace_assertion():
    assert java.replace_assertion("void t() { f(); assertEquals(1, g()); }", "assertEquals(2, g())") == "void t() { f(); assertEquals(2, g()); }"
    assert java.replace_assertion("none", "x") == "none"


def test_costly_functions_of_a_file_with_one_row_group_run_on_all_cores(spark, sf_dir):
    from granary.plans import code

    cores = spark.sparkContext.defaultParallelism
    for rows in (code._tests(spark, sf_dir), code._class_sources(spark, sf_dir), code._questions(spark, sf_dir)):
        assert rows.rdd.getNumPartitions() >= cores
        assert sum(n > 0 for n in rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()) >= cores
