"""Evaluation metrics. Each is one aggregation over status columns, with map-side combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(test: Column) -> Column:
    return F.avg(F.coalesce(test, F.lit(False)).cast("int"))


def accuracy(rows: DataFrame, correct: Column, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(correct).alias("correct"), share(correct).alias("accuracy"))


def upper_bound(rows: DataFrame, correct: str = "correct") -> DataFrame:
    """The share of ids that any member has right."""
    return rows.groupBy("id").agg(F.bool_or(correct).alias("any")).agg(F.count("*").alias("total"), F.count_if("any").alias("correct"), share(F.col("any")).alias("upper_bound"))


def all_correct(rows: DataFrame, members: int, correct: str = "correct") -> DataFrame:
    per_id = rows.groupBy("id").agg(F.count_if(F.col(correct)).alias("n"))
    return per_id.agg(F.count("*").alias("total"), F.count_if(F.col("n") == members).alias("correct"), share(F.col("n") == members).alias("accuracy"))


def by_member_and_kind(rows: DataFrame) -> DataFrame:
    """Correct ids by member and kind, with 'all' for the kinds together; a null kind or member is one of its own."""
    rolled = rows.filter("correct").rollup("member", "kind").agg(F.count("*").alias("n"), F.grouping_id().alias("_all")).filter("_all < 3")
    return rolled.select("member", F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("kind")).alias("kind"), "n")


def unique_by_member(rows: DataFrame) -> DataFrame:
    """How many ids only this member has right."""
    alone = rows.filter("correct").groupBy("id").agg(F.count("*").alias("n"), F.min("member").alias("member")).filter("n = 1")
    return alone.groupBy("member").agg(F.count("*").alias("n"))


def rescued(rows: DataFrame, missed: DataFrame) -> DataFrame:
    """Of missed ids, how many each member, and any of them, has right."""
    hits = rows.join(missed.select("id"), "id", "left_semi").filter("correct")
    return hits.groupBy("member").agg(F.count_distinct("id").alias("n")).unionByName(hits.agg(F.lit("any").alias("member"), F.count_distinct("id").alias("n")))


def two_stage(rows: DataFrame) -> DataFrame:
    """rows: id, answer, correct of the members of stage one and two (stage)."""
    per = rows.groupBy("id").agg(
        F.count_distinct(F.when(F.col("stage") == 1, F.trim("answer"))).alias("d1"), F.count_if((F.col("stage") == 1) & F.col("correct")).alias("c1"), F.count_if(F.col("stage") == 1).alias("n1"),
        F.count_distinct(F.when(F.col("stage") == 2, F.trim("answer"))).alias("d2"), F.count_if((F.col("stage") == 2) & F.col("correct")).alias("c2"), F.count_if(F.col("stage") == 2).alias("n2"),
    )
    first = (F.col("d1") == 1) & (F.col("c1") == F.col("n1"))
    agreed_wrong = (F.col("d1") == 1) & (F.col("c1") == 0)
    second = (F.col("d1") > 1) & (((F.col("d2") == 1) & (F.col("c2") > 0)) | (F.col("c2") >= 2))
    possible = (F.col("d1") > 1) & (F.col("c2") == 1)
    return per.agg(
        F.count("*").alias("total"), F.count_if(first).alias("stage_1"), F.count_if(second).alias("stage_2"), F.count_if(agreed_wrong).alias("agreed_wrong"),
        F.count_if(possible).alias("still_possible"), share(first | second).alias("accuracy"),
    )


def only_by(rows: DataFrame, member: str) -> DataFrame:
    """Ids that this member has right and no other."""
    mine = rows.filter((F.col("member") == member) & F.col("correct")).select("id").distinct()
    return mine.join(rows.filter((F.col("member") != member) & F.col("correct")).select("id").distinct(), "id", "left_anti")


def most_common(rows: DataFrame, column: str, n: int, seen: Column) -> DataFrame:
    """The n most frequent values; of equal ones the one seen first, by the order `seen`."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"), F.min(seen).alias("_seen"))
    return counted.orderBy(F.desc("n"), "_seen", column).limit(n).drop("_seen")


def pass_outcome(rows: DataFrame, denied: list[str]) -> DataFrame:
    """Rows of bugs that aren't denied with right (the answer counts as correct) and fixed (the run counts as passed).

    rows: id, bug_id, correct, passed, is_argument, executed. A right answer whose run failed counts as passed if the value is an
    argument of the assertion, and as wrong otherwise.
    """
    kept = rows.filter(~F.col("bug_id").isin(*denied)) if denied else rows
    right = F.col("correct") & (F.col("passed") | F.col("is_argument"))
    return kept.withColumns({"right": right, "fixed": F.col("passed") | (F.col("correct") & F.col("is_argument"))})


def pass_counts(rows: DataFrame, denied: list[str]) -> DataFrame:
    """Counts of pass_outcome(), for id sets of any size."""
    names = {"right": "corrected", "passed": "passed", "fixed": "fixed", "executed": "compiled"}
    return pass_outcome(rows, denied).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for c, n in names.items()))


def pass_rate(rows: DataFrame, denied: list[str]) -> DataFrame:
    """rows: id, bug_id, correct, passed, is_argument, executed. Denied bugs leave the denominator.

    Ids are arrays, as results of an evaluation are; pass_counts() and pass_outcome() are what to use on large sets.
    """
    kept = rows.filter(~F.col("bug_id").isin(*denied)) if denied else rows
    right = F.col("correct") & (F.col("passed") | F.col("is_argument"))
    regarded = F.col("correct") & ~F.col("passed") & F.col("is_argument")
    ids = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("id"))))
    return kept.agg(
        F.count("*").alias("total"), share(right).alias("accuracy"), share(F.col("passed")).alias("pass_rate"), share(F.col("passed") | regarded).alias("fixed_pass_rate"),
        share(F.col("executed")).alias("compile_rate"), ids(right).alias("corrected_ids"), ids(F.col("passed") | regarded).alias("passed_ids"),
    )


def verdict_outcome(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, correct) of a judged discussion; correct is null where the judge disagreed and no second round is there.

    On **YES** the judge's explanation must hold the expected value, else the final verdict; white space doesn't count.
    first: id, expected_value, first_round_verdict, verdict_explain; second: id, final_verdict.
    """
    from granary.functions.text import contains_without_space

    agreed = F.contains("first_round_verdict", F.lit("**YES**"))
    joined = first.join(second.select("id", "final_verdict"), "id", "left")
    return joined.select("id", F.when(agreed, contains_without_space(F.col("verdict_explain"), F.col("expected_value"))).otherwise(contains_without_space(F.col("final_verdict"), F.col("expected_value"))).alias("correct"))


def verdict_accuracy(outcome: DataFrame) -> DataFrame:
    """Correct ones over all, rows without a second round included; missed are those known to be wrong."""
    return outcome.agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"), F.count_if(~F.col("correct")).alias("missed"), share(F.col("correct")).alias("accuracy"))


def bug_detection(rows: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """(ids that fail on the buggy version, most frequent reasons; of equally frequent ones that of the smallest id)."""
    failed = rows.filter(~F.col("passed"))
    return failed.select("id").distinct(), most_common(failed, "reason", top, F.col("id"))


def detected_bugs(fixed: DataFrame, buggy: DataFrame) -> DataFrame:
    """Bugs with an id that passes on the fixed and fails on the buggy version."""
    failing = buggy.filter(~F.col("passed")).select("id")
    return fixed.filter("passed").join(failing, "id", "left_semi").select("bug_id").distinct()


def funnel(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if("compiled").alias("compiled"), F.count_if(F.col("compiled") & F.col("passed")).alias("passed"))


def suite_summary(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """Runs with triggered tests, and those of them that an assertion made fail."""
    found = runs.filter(F.col("num_trigger").isNotNull() & (F.col("num_trigger") != 0)).select("project_id", "version_id").distinct()
    by_assertion = found.join(logs, ["project_id", "version_id"], "left").groupBy("project_id", "version_id").agg(F.max(F.coalesce(F.contains("log", F.lit("junit.framework.AssertionFailedError")), F.lit(False))).alias("asserted"))
    return by_assertion.agg(F.count("*").alias("identified"), F.count_if("asserted").alias("by_assertion"))


def confidence(tokens: DataFrame) -> DataFrame:
    """(id, confidence): the mean log probability before the first fence, as a percentage rounded half to even.

    tokens: id, at, token, logprob.
    """
    fence = tokens.filter(F.contains("token", F.lit("```"))).groupBy("id").agg(F.min("at").alias("stop"))
    before = tokens.join(fence, "id", "left").filter(F.col("stop").isNull() | (F.col("at") < F.col("stop")))
    return before.groupBy("id").agg(F.bround(F.exp(F.avg("logprob")) * 100, 2).alias("confidence"))


def contained_not_in_prefix(output: Column, expected: Column, prefix: Column) -> Column:
    return F.contains(output, expected) & ~F.contains(prefix, expected)


def without_judge(rows: DataFrame) -> DataFrame:
    """Accuracy of answers, apart for values that the prompt already shows. rows: expected, response, prompt.

    Rows that expect true or false but whose answer has neither word are left out.
    """
    spelled = F.contains("response", F.lit("true")) | F.contains("response", F.lit("false"))
    kept = rows.filter(~F.col("expected").isin("true", "false") | spelled)
    shown, right = F.contains("prompt", F.col("expected")), F.contains("response", F.col("expected"))
    return kept.agg(F.count("*").alias("total"), share(right).alias("accuracy"), F.count_if(shown).alias("shown"), F.count_if(shown & right).alias("shown_correct"), F.count_if(~shown & right).alias("hidden_correct"))
