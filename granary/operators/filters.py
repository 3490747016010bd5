"""Filters and status columns over parsed test records. Every exclusion is a column of one plan, so counts and kept rows agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.java import ASSERTIONS


def named_in(names: Column, wanted: tuple[str, ...] = ASSERTIONS) -> Column:
    """The entries of an array that are in a fixed list; repeats count."""
    listed = F.array(*map(F.lit, wanted))
    return F.filter(names, lambda x: F.array_contains(listed, x))


def exactly_one(names: Column, wanted: tuple[str, ...] = ASSERTIONS) -> Column:
    return F.size(named_in(names, wanted)) == 1


def calls_any(names: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(names, F.array(*map(F.lit, wanted)))


def status(count: Column, text: Column, name: Column, parsed: Column) -> Column:
    """Why a row goes, in a fixed order; null for rows that stay."""
    return (
        F.when((count != 1) & F.contains(text, F.lit("assertThat")), "assertThat")
        .when(count != 1, "assertion_count_mismatch")
        .when(name.isin("assertTrue", "assertFalse"), F.when(text.rlike("true|false"), "trivial_boolean"))
        .when(name.isin("assertNull", "assertNotNull"), F.when(F.regexp_count(text, F.lit("null")) > 0, "trivial_null"))
        .when(name == "assertEquals", F.when(~parsed, "equals_parse_failure"))
        .otherwise("assertion_type_not_equals")
    )


def kept_and_counts(rows: DataFrame, why: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and (reason, n) of the others."""
    judged = rows.withColumn("reason", why)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def trivial(text: Column, kind: Column) -> Column:
    """A boolean assertion that spells true or false, or a null one that spells null."""
    return ((kind == "Boolean") & (F.contains(text, F.lit("true")) | F.contains(text, F.lit("false")))) | ((kind == "NullValues") & F.contains(text, F.lit("null")))


def containing(items: Column, part: str) -> Column:
    return F.filter(items, lambda x: F.contains(x, F.lit(part)))


def short_or_getter(name: Column, is_single_return: Column, newlines: Column, least: int = 5) -> Column:
    return (name.startswith("get") & is_single_return) | (newlines < least)


def is_test(superclass: Column, name: Column, modifiers: Column) -> Column:
    """A test by base class and name, or by its annotation."""
    return F.when(F.contains(superclass, F.lit("TestCase")), name.startswith("test")).otherwise(F.exists(modifiers, lambda m: F.contains(m, F.lit("@Test"))))


def with_modifiers(methods: Column, required: tuple[str, ...]) -> Column:
    return F.filter(methods, lambda m: F.forall(F.array(*map(F.lit, required)), lambda r: F.array_contains(m["modifiers"], r)))


def first_parsable(assertions: Column) -> Column:
    """The first of parsed assertions that is marked ok; null without one."""
    return F.try_element_at(F.filter(assertions, lambda a: a["ok"]), F.lit(1))


def same_digest(text: Column, digest: Column) -> Column:
    return F.md5(text) == digest


def allow_deny(rows: DataFrame, column: str, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    kept = rows.filter(F.col(column).isin(*allow)) if allow is not None else rows
    return kept.filter(~F.col(column).isin(*deny)) if deny else kept


def in_ids(rows: DataFrame, ids: DataFrame, key: str = "id", keep: bool = True) -> DataFrame:
    """Rows whose key is in a fixed set of ids, or (keep=False) isn't; a set of any size, repeated ids count once.

    A null key is in no set.
    """
    return rows.join(ids.select(F.col(key).alias("_id")), F.col(key) == F.col("_id"), "left_semi" if keep else "left_anti")


def mentions_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text has one of the words as a part; false for a null text."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return F.coalesce(found, F.lit(False))


def asserts_bug(flag: Column, label: Column, wanted: tuple[str, ...] = ASSERTIONS[:5]) -> Column:
    """Rows of a labelled set that are worth a try: the flag says that the assertion shows the bug, and the label has a known assertion."""
    return F.coalesce(flag != "0", F.lit(False)) & mentions_any(label, wanted)


def return_kind(return_type: Column) -> Column:
    """Methods that return nothing apart from those with a value."""
    return F.when(F.trim(return_type) == "void", "void").otherwise("value")
