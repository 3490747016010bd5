"""Prompts as expressions over a row's columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lines(*parts: Column) -> Column:
    """The parts that aren't empty, a line each."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n")


def _titled(title: str, body: Column) -> Column:
    return F.when(F.length(body) > 0, F.concat(F.lit(title + "\n"), body))


def _rule(kind: Column) -> Column:
    return (
        F.when(kind == "Boolean", "Complete the placeholder with assertTrue or assertFalse and say briefly why.")
        .when(kind == "NullValues", "Complete the placeholder with assertNull or assertNotNull and say briefly why.")
        .otherwise("Reply with the code of the expected value only.")
    )


def naive(kind: Column, focal_method: Column, test_prefix: Column, fields: Column | None = None, methods: Column | None = None, test_fields: Column | None = None) -> Column:
    """The method, its class's fields and public methods, the test's fields, and the test with its placeholder."""
    listed = lambda c: F.array_join(c, "\n") if c is not None else F.lit("")
    public = F.filter(methods, lambda m: F.contains(m, F.lit("public"))) if methods is not None else None
    return _lines(
        _titled("Method under test:", focal_method), _titled("Fields of its class:", listed(fields)), _titled("Public methods of its class:", listed(public)),
        _titled("Fields of the test:", listed(test_fields)), _titled("Test:", test_prefix), _rule(kind),
    )


def with_example(prompt: Column, retrieved_method: Column, retrieved_test: Column, default_method: str = "", default_test: str = "") -> Column:
    """A prompt with a similar method and its test in front; the default pair where none was retrieved."""
    whole = retrieved_method.isNotNull() & retrieved_test.isNotNull()
    method = F.when(whole, retrieved_method).otherwise(F.lit(default_method))
    test = F.when(whole, retrieved_test).otherwise(F.lit(default_test))
    return _lines(_titled("A similar method:", method), _titled("Its test:", test), prompt)


def steps(name: Column, test_prefix: Column, focal_method: Column, kind: Column) -> list[Column]:
    """The rounds of the four-step agent: scenario, path, output, answer."""
    return [
        _lines(_titled("Which scenario does this test check?", name), test_prefix),
        _lines(F.lit("Which path does the method take in it?"), focal_method),
        F.lit("What does the method return on that path?"),
        _lines(_titled("Test:", test_prefix), _rule(kind)),
    ]


def peers(answers: Column, variables: Column) -> Column:
    """The other members' last answers, numbered, and the variables that may be used."""
    numbered = F.transform(F.sequence(F.lit(1), F.size(answers)), lambda i: F.concat(F.lit("Member "), i.cast("string"), F.lit(": "), F.element_at(answers, i)))
    request = F.when(F.size(variables) > 0, F.concat(F.lit("Variables in scope:\n"), F.array_join(variables, "\n"), F.lit("\nGive your refined answer.")))
    return _lines(F.lit("Other members answered:"), F.when(F.size(answers) > 0, F.array_join(numbered, "\n")), request)


def debate(test_prefix: Column, focal_method: Column, statements: Column) -> Column:
    numbered = F.transform(F.sequence(F.lit(1), F.size(statements)), lambda i: F.concat(F.lit("user"), i.cast("string"), F.lit(": "), F.element_at(statements, i)))
    return _lines(_titled("Test:", test_prefix), _titled("Method under test:", focal_method), F.array_join(numbered, "\n"), F.lit("Weigh these statements; give the final answer and the reason."))


def judge(focal_method: Column, test_prefix: Column, answers: Column) -> Column:
    """answers: a map from member to answer."""
    listed = F.array_join(F.transform(F.map_entries(answers), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return _lines(_titled("Method under test:", focal_method), _titled("Test:", test_prefix), listed, F.lit("Do they agree on one right answer? Reply **YES** and the assertion, or **NO** and a comment."))


def whole_class(superclass: Column, interface: Column, fields: Column, other_methods: Column, focal_method: Column) -> Column:
    return _lines(
        _titled("Superclass:", superclass), _titled("Interface:", interface), _titled("Fields:", F.array_join(fields, "\n")), _titled("Other public methods:", F.array_join(other_methods, "\n")),
        _titled("Method under test:", focal_method), F.lit("Write a JUnit 4 test class that covers as much of the method as it can."),
    )


def understand(focal_method: Column, test_prefix: Column) -> list[Column]:
    """Explain the method, explain the test, then generate one assertion."""
    return [_lines(F.lit("Explain this method."), focal_method), _lines(F.lit("Explain this test."), test_prefix), F.lit("Write exactly one assertion for the test from both explanations.")]
