"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import metrics as m
from granary.plans import views
from granary.plans.registry import query
from granary.session import table


def _flat(frame, places=9):
    """Doubles rounded, for comparison between engines."""
    return frame.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes))


@query(f"WITH {views.VOTES} SELECT member, count(*) AS total, count(*) FILTER (correct) AS correct, round(avg(correct::INT), 9) AS accuracy FROM judged GROUP BY member")
def metric_accuracy(spark, sf_dir):
    return _flat(m.accuracy(views.votes(spark, sf_dir), F.col("correct"), "member"))


@query(f"WITH {views.VOTES}, p AS (SELECT id, bool_or(correct) AS a FROM judged GROUP BY id) SELECT count(*) AS total, count(*) FILTER (a) AS correct, round(avg(a::INT), 9) AS upper_bound FROM p")
def metric_upper_bound(spark, sf_dir):
    return _flat(m.upper_bound(views.votes(spark, sf_dir)))


@query(f"WITH {views.VOTES}, p AS (SELECT id, count(*) FILTER (correct) AS n FROM judged GROUP BY id) SELECT count(*) AS total, count(*) FILTER (n = 3) AS correct, round(avg((n = 3)::INT), 9) AS accuracy FROM p")
def metric_all_correct(spark, sf_dir):
    return _flat(m.all_correct(views.votes(spark, sf_dir), 3))


@query(f"WITH {views.VOTES} SELECT member, coalesce(kind, 'all') AS kind, count(*) AS n FROM judged WHERE correct GROUP BY GROUPING SETS ((member, kind), (member))")
def metric_by_member_and_kind(spark, sf_dir):
    return m.by_member_and_kind(views.votes(spark, sf_dir))


@query(f"WITH {views.VOTES}, p AS (SELECT id, min(member) AS member FROM judged WHERE correct GROUP BY id HAVING count(*) = 1) SELECT member, count(*) AS n FROM p GROUP BY member")
def metric_unique_by_member(spark, sf_dir):
    return m.unique_by_member(views.votes(spark, sf_dir))


@query(
    f"WITH {views.VOTES}, missed AS (SELECT DISTINCT id FROM judged WHERE member = 'a' AND NOT correct), h AS (SELECT * FROM judged WHERE correct AND id IN (SELECT id FROM missed)) "
    "SELECT member, count(DISTINCT id) AS n FROM h GROUP BY member UNION ALL SELECT 'any', count(DISTINCT id) FROM h"
)
def metric_rescued_by_members(spark, sf_dir):
    rows = views.votes(spark, sf_dir)
    return m.rescued(rows, rows.filter((F.col("member") == "a") & ~F.col("correct")).select("id").distinct())


_STAGES = (
    f"WITH {views.VOTES}, s AS (SELECT id // 2 AS id, id % 2 + 1 AS stage, answer, answer = ['click','error','purchase','signup','view'][(id // 2) % 5 + 1] AS correct FROM votes), "
    "p AS (SELECT id, count(DISTINCT CASE WHEN stage = 1 THEN answer END) AS d1, count(*) FILTER (stage = 1 AND correct) AS c1, count(*) FILTER (stage = 1) AS n1, "
    "count(DISTINCT CASE WHEN stage = 2 THEN answer END) AS d2, count(*) FILTER (stage = 2 AND correct) AS c2 FROM s GROUP BY id) "
)


@query(
    _STAGES + "SELECT count(*) AS total, count(*) FILTER (d1 = 1 AND c1 = n1) AS stage_1, count(*) FILTER (d1 > 1 AND ((d2 = 1 AND c2 > 0) OR c2 >= 2)) AS stage_2, "
    "count(*) FILTER (d1 = 1 AND c1 = 0) AS agreed_wrong, count(*) FILTER (d1 > 1 AND c2 = 1) AS still_possible, "
    "round(avg(((d1 = 1 AND c1 = n1) OR (d1 > 1 AND ((d2 = 1 AND c2 > 0) OR c2 >= 2)))::INT), 9) AS accuracy FROM p"
)
def metric_two_stage(spark, sf_dir):
    rows = views.votes(spark, sf_dir)
    first = F.floor(F.col("id") / 2).cast("long")
    truth = F.element_at(F.array(*map(F.lit, views.KINDS)), (first % 5 + 1).cast("int"))
    staged = rows.select(first.alias("id"), (F.col("id") % 2 + 1).alias("stage"), "answer", (F.col("answer") == truth).alias("correct"))
    found = m.two_stage(staged)
    # an answer that all give and that is right only in one stage is reported once
    return _flat(found)


@query(f"WITH {views.VOTES} SELECT DISTINCT id FROM judged WHERE member = 'b' AND correct AND id NOT IN (SELECT id FROM judged WHERE member <> 'b' AND correct)")
def metric_found_only_by(spark, sf_dir):
    return m.only_by(views.votes(spark, sf_dir), "b")


_RUNS = (
    "runs AS (SELECT event_id AS id, 'bug' || (user_id % 20)::VARCHAR AS bug_id, event_type = 'purchase' AS correct, value > 20 AS passed, value > 5 AS executed, event_id % 7 = 0 AS is_argument, event_type AS reason FROM events), "
    "buggy AS (SELECT event_id AS id, 'bug' || (user_id % 20)::VARCHAR AS bug_id, value > 60 AS passed, event_type AS reason FROM events)"
)


def _runs(spark, sf_dir, cut):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("bug"), (F.col("user_id") % 20).cast("string")).alias("bug_id"), (F.col("event_type") == "purchase").alias("correct"), (F.col("value") > cut).alias("passed"),
        (F.col("value") > 5).alias("executed"), (F.col("event_id") % 7 == 0).alias("is_argument"), F.col("event_type").alias("reason"),
    )


@query(
    f"WITH {_RUNS}, k AS (SELECT * FROM runs WHERE bug_id NOT IN ('bug1', 'bug2')) SELECT count(*) AS total, round(avg((correct AND (passed OR is_argument))::INT), 9) AS accuracy, "
    "round(avg(passed::INT), 9) AS pass_rate, round(avg((passed OR correct AND is_argument)::INT), 9) AS fixed_pass_rate, round(avg(executed::INT), 9) AS compile_rate, "
    "list_sort(list(id) FILTER (correct AND (passed OR is_argument))) AS corrected_ids, list_sort(list(id) FILTER (passed OR correct AND is_argument)) AS passed_ids FROM k"
)
def metric_pass_rate(spark, sf_dir):
    return _flat(m.pass_rate(_runs(spark, sf_dir, 20), ["bug1", "bug2"]))


@query(
    "WITH f AS (SELECT event_id AS id, event_type AS expected_value, CASE WHEN event_id % 3 = 0 THEN '**YES**' ELSE '**NO**' END AS v, CASE WHEN event_id % 2 = 0 THEN 'is ' || event_type ELSE 'none' END AS e FROM events), "
    "s AS (SELECT event_id AS id, 'f(' || CASE WHEN value > 20 THEN event_type ELSE '' END || ')' AS final FROM events WHERE event_id % 5 <> 0), "
    "o AS (SELECT CASE WHEN v = '**YES**' THEN contains(e, expected_value) ELSE contains(final, expected_value) END AS correct FROM f LEFT JOIN s USING (id)) "
    "SELECT count(*) AS total, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct) AS missed, round(avg(coalesce(correct, false)::INT), 9) AS accuracy FROM o"
)
def metric_verdict_accuracy(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_id", "id")
    spaced = F.concat_ws(" ", F.split("event_type", ""))  # white space must not count
    first = e.select("id", spaced.alias("expected_value"), F.when(F.col("id") % 3 == 0, "**YES** ok").otherwise("**NO**").alias("first_round_verdict"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("is "), F.col("event_type"))).otherwise("none").alias("verdict_explain"))
    second = e.filter("id % 5 <> 0").select("id", F.concat(F.lit("f( "), F.when(F.col("value") > 20, F.col("event_type")).otherwise(""), F.lit(")")).alias("final_verdict"))
    return _flat(m.verdict_accuracy(m.verdict_outcome(first, second)))


@query(f"WITH {_RUNS} SELECT reason, count(*) AS n FROM buggy WHERE NOT passed GROUP BY reason ORDER BY n DESC, min(id), reason LIMIT 3")
def metric_failure_reasons(spark, sf_dir):
    return m.bug_detection(_runs(spark, sf_dir, 60), 3)[1]


@query(f"WITH {_RUNS} SELECT DISTINCT bug_id FROM runs WHERE passed AND id IN (SELECT id FROM buggy WHERE NOT passed)")
def metric_detected_bugs(spark, sf_dir):
    return m.detected_bugs(_runs(spark, sf_dir, 20), _runs(spark, sf_dir, 60))


@query("SELECT count(*) AS total, count(*) FILTER (value > 5) AS compiled, count(*) FILTER (value > 20) AS passed FROM events")
def metric_generation_funnel(spark, sf_dir):
    return m.funnel(_runs(spark, sf_dir, 20).withColumnRenamed("executed", "compiled"))


@query(
    "WITH r AS (SELECT DISTINCT user_id % 12 AS p, event_id % 40 AS v FROM events WHERE nullif((event_id % 9)::INT, 0) IS NOT NULL), l AS (SELECT user_id % 12 AS p, event_id % 40 AS v, bool_or(event_type = 'error') AS a FROM events GROUP BY ALL) "
    "SELECT count(*) AS identified, count(*) FILTER (l.a) AS by_assertion FROM r LEFT JOIN l USING (p, v)"
)
def metric_suite_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("project_id"), (F.col("event_id") % 40).alias("version_id"), "event_type", "event_id")
    runs = e.withColumn("num_trigger", F.nullif(F.col("event_id") % 9, F.lit(0)))
    logs = e.withColumn("log", F.when(F.col("event_type") == "error", "junit.framework.AssertionFailedError: x").otherwise("ok"))
    return m.suite_summary(runs, logs)


@query(
    'WITH t AS (SELECT conv_id AS id, turn AS "at", CASE WHEN turn = 3 THEN $$```$$ ELSE role END AS token, -(length(text) % 10) / 100.0 AS logprob FROM conversations), s AS (SELECT id, min("at") AS stop FROM t WHERE token LIKE $$%```%$$ GROUP BY id) '
    'SELECT t.id, round_even(exp(avg(logprob::DOUBLE)) * 100, 2) AS confidence FROM t LEFT JOIN s USING (id) WHERE stop IS NULL OR "at" < stop GROUP BY t.id'
)
def metric_confidence(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    tokens = c.select(F.col("conv_id").alias("id"), F.col("turn").alias("at"), F.when(F.col("turn") == 3, "```").otherwise(F.col("role")).alias("token"), (-(F.length("text") % 10) / 100.0).alias("logprob"))
    return m.confidence(tokens)


@query(f"WITH {views.VOTES} SELECT kind = 'Boolean' AS is_boolean, count(*) AS n FROM judged GROUP BY 1")
def metric_boolean_share(spark, sf_dir):
    return views.votes(spark, sf_dir).groupBy((F.col("kind") == "Boolean").alias("is_boolean")).agg(F.count("*").alias("n"))


@query("SELECT split_part(p_name, ' ', 1) AS project, list_sort(list(DISTINCT p_brand)) AS bugs FROM part GROUP BY 1")
def metric_project_bugs(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("project")).agg(F.sort_array(F.collect_set("p_brand")).alias("bugs"))


@query("SELECT count(*) AS classes, sum(len(string_split(text, chr(10)))) AS methods FROM documents")
def metric_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("classes"), F.sum(F.size(F.split("text", "\n"))).alias("methods"))


@query("WITH t AS (SELECT item_id, lower(unnest(string_split(text, ' '))) AS term FROM benchmark) SELECT term, count(*) AS tf, count(DISTINCT item_id) AS df FROM t GROUP BY term")
def metric_term_frequency(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("tf"), F.count_distinct("item_id").alias("df"))


@query(f"WITH {views.VOTES} SELECT expected, count(*) AS missed FROM judged WHERE NOT correct GROUP BY expected")
def metric_missed_values(spark, sf_dir):
    return views.votes(spark, sf_dir).filter(~F.col("correct")).groupBy("expected").agg(F.count("*").alias("missed"))


@query("SELECT d.source, count(*) FILTER (d.text LIKE '%' || split_part(d.text, ' ', 3) || '%' AND NOT contains(split_part(d.text, ' ', 1), split_part(d.text, ' ', 3))) AS correct, count(*) AS total FROM documents d GROUP BY 1")
def metric_contained_not_in_prefix(spark, sf_dir):
    word = lambda k: F.split_part("text", F.lit(" "), F.lit(k))
    test = m.contained_not_in_prefix(F.col("text"), word(3), word(1))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(test).alias("correct"), F.count("*").alias("total"))


@query(
    "WITH r AS (SELECT CASE WHEN event_type = 'view' THEN 'true' ELSE event_type END AS expected, CASE WHEN event_id % 3 = 0 THEN 'x true' ELSE event_type END AS response, event_type || user_id::VARCHAR AS prompt FROM events), "
    "k AS (SELECT * FROM r WHERE expected NOT IN ('true', 'false') OR contains(response, 'true') OR contains(response, 'false')) "
    "SELECT count(*) AS total, round(avg(contains(response, expected)::INT), 9) AS accuracy, count(*) FILTER (contains(prompt, expected)) AS shown, count(*) FILTER (contains(prompt, expected) AND contains(response, expected)) AS shown_correct, count(*) FILTER (NOT contains(prompt, expected) AND contains(response, expected)) AS hidden_correct FROM k"
)
def metric_without_judge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    rows = e.select(F.when(kind == "view", "true").otherwise(kind).alias("expected"), F.when(F.col("event_id") % 3 == 0, "x true").otherwise(kind).alias("response"), F.concat(kind, F.col("user_id").cast("string")).alias("prompt"))
    return _flat(m.without_judge(rows))


@query(
    f"WITH {views.VOTES}, m AS (SELECT expected, count(*) AS missed, min(id * 10 + ord) AS seen FROM judged WHERE NOT correct GROUP BY expected) "
    "SELECT expected, missed, (SELECT sum(missed)::BIGINT FROM m) AS total FROM m ORDER BY missed DESC, seen LIMIT 3"
)
def metric_most_missed(spark, sf_dir):
    """The values missed most often, of equal ones the first seen, and how many answers missed theirs."""
    missed = views.votes(spark, sf_dir).filter(~F.col("correct"))
    top = m.most_common(missed, "expected", 3, F.struct("id", "ord")).withColumnRenamed("n", "missed")
    return top.join(F.broadcast(missed.agg(F.count("*").alias("total"))))


@query(
    f"WITH {views.VOTES}, p AS (SELECT id, count(*) FILTER (correct) AS n, bool_or(member = 'a' AND correct) AS a, bool_or(member = 'b' AND correct) AS b, bool_or(member = 'c' AND correct) AS c FROM judged GROUP BY id) "
    "SELECT unnest(['total', 'any', 'all', 'right', 'right', 'right', 'only', 'only', 'only']) AS metric, unnest([NULL, NULL, NULL, 'a', 'b', 'c', 'a', 'b', 'c']) AS member, "
    "unnest([count(*), count(*) FILTER (n > 0), count(*) FILTER (a AND b AND c), count(*) FILTER (a), count(*) FILTER (b), count(*) FILTER (c), count(*) FILTER (a AND NOT b AND NOT c), count(*) FILTER (b AND NOT a AND NOT c), count(*) FILTER (c AND NOT a AND NOT b)]) AS n FROM p"
)
def metric_sets_in_one_pass(spark, sf_dir):
    from granary.operators.bitmaps import set_metrics

    return set_metrics(views.votes(spark, sf_dir), list(views.MEMBERS))


@query("WITH p AS (SELECT o_orderkey AS id, o_totalprice > 50000 AS a, o_custkey % 3 = 0 AS b, o_orderstatus = 'F' AS c FROM orders) SELECT a, b, c, count(*) AS n FROM p WHERE a OR b OR c GROUP BY ALL")
def set_regions_by_bitmap(spark, sf_dir):
    """Ids by the sets that they are in, from a bitmap a bucket of ids and set."""
    from granary.operators import bitmaps

    o = table(spark, sf_dir, "orders")
    tests = {"a": F.col("o_totalprice") > 50000, "b": F.col("o_custkey") % 3 == 0, "c": F.col("o_orderstatus") == "F"}
    named = o.select(F.col("o_orderkey").alias("id"), F.explode(F.array(*(F.when(t, n) for n, t in tests.items()))).alias("set"))
    return bitmaps.regions(bitmaps.id_bitmaps(named, F.col("set")), list(tests))


@query(
    f"WITH {_RUNS}, k AS (SELECT * FROM runs WHERE bug_id NOT IN ('bug1', 'bug2')) SELECT count(*) AS total, count(*) FILTER (correct AND (passed OR is_argument)) AS corrected, "
    "count(*) FILTER (passed) AS passed, count(*) FILTER (passed OR correct AND is_argument) AS fixed, count(*) FILTER (executed) AS compiled FROM k"
)
def metric_pass_counts(spark, sf_dir):
    """Counts beside the rates, whatever the number of ids."""
    return m.pass_counts(_runs(spark, sf_dir, 20), ["bug1", "bug2"])


@query(f"WITH {_RUNS} SELECT id FROM runs WHERE bug_id NOT IN ('bug1', 'bug2') AND correct AND (passed OR is_argument)")
def metric_corrected_ids(spark, sf_dir):
    return m.pass_outcome(_runs(spark, sf_dir, 20), ["bug1", "bug2"]).filter("right").select("id")
