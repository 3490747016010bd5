"""Parsers of compiler, test and build logs as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compile_errors(log: Column) -> Column:
    """array<struct<line, message>> of a build log: the compiler's error lines after its first two lines, without warnings and notes.

    A line is path:line:kind:message; a message ends at its next colon.
    """
    lines = F.slice(F.split(log, "\n"), 3, 1_000_000_000)
    tagged = F.filter(lines, lambda x: F.contains(x, F.lit("[javac]")) | F.contains(x, F.lit("[exec]")))
    errors = F.filter(tagged, lambda x: F.contains(x, F.lit("error:")) & ~F.contains(x, F.lit("warning:")) & ~F.contains(x, F.lit("[javac] Note:")) & ~F.contains(x, F.lit("compiler be upgraded.")))
    part = lambda x, k: F.trim(F.split_part(x, F.lit(":"), F.lit(k)))
    return F.transform(errors, lambda x: F.struct(part(x, 2).cast("int").alias("line"), part(x, 4).alias("message")))


def failing_tests(log: Column) -> Column:
    """array<struct<name, reason>>: a line that begins with three dashes names a test, the line after it is the reason."""
    lines = F.split(log, "\n")
    at = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).startswith("---"))
    return F.transform(at, lambda i: F.struct(F.trim(F.substr(F.element_at(lines, i), F.lit(5))).alias("name"), F.coalesce(F.try_element_at(lines, i + 1), F.lit("")).alias("reason")))


def failing_count(log: Column) -> Column:
    """n of 'Failing tests: n'; null without such a line."""
    return F.try_to_number(F.nullif(F.regexp_extract(log, r"Failing tests: (\d+)", 1), F.lit("")), F.lit("999999999")).cast("int")


def failure_class(listing: Column) -> Column:
    """Why tests failed: assertion_error if an unindented line of the listing names an assertion, else other; no listing is no_failing_test_file."""
    hit = F.exists(F.split(listing, "\n"), lambda x: ~x.startswith(" ") & F.contains(x, F.lit("Assertion")))
    return F.when(listing.isNull(), "no_failing_test_file").when(hit, "assertion_error").otherwise("other")


def compile_result(log: Column) -> Column:
    return F.when(F.contains(log, F.lit("[ERROR] COMPILATION ERROR :")), "compilation failure").otherwise("success")


def test_result(log: Column, has_report: Column) -> Column:
    """Passed, Failed Compilation or Failed Execution of a build with tests; null where the log says neither."""
    failed = F.contains(log, F.lit("BUILD FAILURE")) | (F.contains(log, F.lit("Tests run:")) & F.contains(log, F.lit("Failures:")))
    return F.when(F.contains(log, F.lit("BUILD SUCCESS")), "Passed").when(failed & ~has_report, "Failed Compilation").when(failed, "Failed Execution")


def methods_hit(errors: DataFrame, methods: DataFrame, keep: bool) -> DataFrame:
    """Methods whose lines (first and last included, from 1) hold an error of their file, or, with keep, the others."""
    from granary.operators.joins import ranges_hit

    place = ["file", "start_line", "end_line"]
    ranges = methods.select(F.col("file").alias("key"), F.struct(*place).alias("rid"), F.col("start_line").alias("lo"), F.col("end_line").alias("hi")).distinct()
    hit = ranges_hit(ranges, errors.select(F.col("file").alias("key"), F.col("line").alias("at")), "rid").select("rid.*")
    return methods.join(hit, place, "left_anti" if keep else "left_semi")
