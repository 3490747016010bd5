"""Source trees as frames: classes, tests, and the rows that map a test to the method it checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import java
from granary.operators import filters, joins


def classes(files: DataFrame) -> DataFrame:
    """(path, name, facts) of source files; files without a class have null facts. files: path, name, text."""
    return files.select("path", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), "text", java.class_of("text").alias("facts"))


def totals(found: DataFrame) -> DataFrame:
    return found.filter("facts.name is not null").agg(F.count("*").alias("classes"), F.sum(F.size("facts.methods")).alias("methods"))


def tests(found: DataFrame) -> DataFrame:
    """(path, class_name, test, key) of test methods, by base class and name or by annotation; key is a digest of the signature."""
    rows = found.select("path", F.col("facts.name").alias("class_name"), F.col("facts.superclass").alias("superclass"), F.explode("facts.methods").alias("m"))
    is_test = filters.is_test(F.col("superclass"), F.col("m.name"), F.col("m.modifiers"))
    signature = F.concat(F.col("class_name"), F.lit("."), F.col("m.name"), F.lit("("), F.array_join("m.params", ", "), F.lit(")"))
    return rows.filter(is_test).select("path", "class_name", F.col("m.name").alias("name"), F.col("m.text").alias("test"), F.md5(signature).alias("key"))


def corpus(bugs: DataFrame) -> DataFrame:
    """(bug_id, uts): the tests of each bug as a map from digest to text. bugs: bug_id, key, test."""
    last = bugs.groupBy("bug_id", "key").agg(F.max("test").alias("test"))
    return last.groupBy("bug_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "test"))).alias("uts"))


def variants(found: DataFrame) -> DataFrame:
    """One row a variant of each test: itself, and one for each assertion where it hasn't exactly one."""
    return found.select("*", F.posexplode(java.variants_of("test")).alias("variant", "variant_text"))


def focal_methods(found: DataFrame, source_classes: DataFrame) -> DataFrame:
    """(path, name, class_name, focal_method): tests with the one method of their class under test that they call.

    The class is the first by path whose stem is part of the test class's name; a test that calls none or several of
    its methods is left out.
    """
    stems = source_classes.filter("facts.name is not null").select("stem", F.col("path").alias("source"))
    named = found.select(F.col("class_name").alias("test")).distinct()
    under_test = joins.stem_match(named, stems).select(F.col("test").alias("class_name"), "source")
    declared = source_classes.select(F.col("path").alias("source"), F.col("facts.methods").alias("methods"))
    rows = found.withColumn("called", F.array_distinct(java.invocations_of("test"))).join(under_test, "class_name").join(declared, "source")
    picked = rows.withColumn("focal_name", joins.resolved_call(F.col("called"), F.array_distinct(F.transform("methods", lambda m: m["name"])))).filter("focal_name is not null")
    text = F.element_at(F.filter("methods", lambda m: m["name"] == F.col("focal_name")), 1)["text"]
    return picked.select("path", "name", "class_name", "focal_name", text.alias("focal_method"))


def candidates(source_classes: DataFrame, least_lines: int = 5) -> DataFrame:
    """(path, class_name, name, focal_method): methods worth a test, neither plain getters nor shorter than least_lines."""
    rows = source_classes.select("path", F.col("facts.name").alias("class_name"), F.explode("facts.methods").alias("m"))
    lines = F.col("m.end_line") - F.col("m.start_line") - 1
    dropped = filters.short_or_getter(F.col("m.name"), java.single_return(F.col("m.text")), lines, least_lines)
    return rows.filter(~dropped).select("path", "class_name", F.col("m.name").alias("name"), F.col("m.text").alias("focal_method"))
