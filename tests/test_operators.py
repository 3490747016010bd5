import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary import storage
from granary.agents import client, discussion
from granary.execution import runner
from granary.operators import joins, metrics, retrieval, sets, votes
from granary.streaming import votes as stream


def test_bm25_is_zero_without_common_terms_and_matches_the_formula(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["b", "c"]), (3, ["z"])], "id long, terms array<string>")
    found = {r.tgt: (r.src, r.sim) for r in retrieval.bm25_top1(docs.filter("id = 1"), docs.filter("id > 1")).collect()}
    mean = 2.5
    g = lambda f, n: 2.5 * f / (f + 1.5 * (0.25 + 0.75 * n / mean))
    assert found[1][0] == 2 and found[1][1] == pytest.approx(math.log(1.2) / 2 * (2 * g(1, 2) + 1 * g(2, 3)))
    assert retrieval.bm25_top1(docs.filter("id = 3"), docs.filter("id = 1")).first().sim == 0


@pytest.mark.parametrize("block", [2, 512])
def test_tiles_agree_whatever_their_size(spark, block):
    rng = np.random.default_rng(1)
    sets_ = [sorted(set(map(int, rng.integers(0, 12, rng.integers(0, 9))))) for _ in range(30)]
    side = spark.createDataFrame([(str(i % 3), i, s) for i, s in enumerate(sets_)], "grp string, id long, value array<long>")
    found = {r.tgt: (r.src, round(r.sim, 9)) for r in retrieval.top1(side, side, "jaccard", True, block).collect()}
    for i, a in enumerate(sets_):
        best = max(((len({*a} & {*b}) / len({*a} | {*b}) if a or b else 0.0), -j) for j, b in enumerate(sets_) if j != i and j % 3 == i % 3)
        assert found[i] == (-best[1], round(best[0], 9))


def test_group_rule(spark):
    side = spark.createDataFrame([("a", 1, [1]), ("b", 2, [1]), ("b", 3, [2])], "grp string, id long, value array<long>")
    got = {r.tgt: (r.src, r.sim) for r in retrieval.with_group_rule(retrieval.top1(side, side, "jaccard", True), side).collect()}
    assert got == {1: (None, None), 2: (3, -1.0), 3: (2, -1.0)}


def test_votes_prefer_the_first_member_on_ties(spark):
    rows = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "z"), (2, 0, "p"), (2, 1, "q"), (2, 2, "q")], "id int, ord int, answer string")
    assert {r.id: r.answer for r in votes.majority(rows).collect()} == {1: "x", 2: "q"}


def test_members_must_agree_on_the_expected_value(spark):
    rows = spark.createDataFrame([(1, "a", "x", "e"), (1, "b", "y", "other")], "id int, member string, answer string, expected string")
    with pytest.raises(Exception, match="disagree"):
        joins.members_side_by_side(rows, ["a", "b"], "answer", "expected").collect()


def test_confidence_stops_at_the_fence_and_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(1, 0, "a", -0.1), (1, 1, "```", -5.0), (2, 0, "x", 0.0)], "id int, at int, token string, logprob double")
    assert {r.id: r.confidence for r in metrics.confidence(rows).collect()} == {1: 90.48, 2: 100.0}


def test_venn(spark):
    a, b = spark.range(0, 4).toDF("id"), spark.range(2, 6).toDF("id")
    assert {(r.a, r.b): r.n for r in sets.venn({"a": a, "b": b}).collect()} == {(True, False): 2, (True, True): 2, (False, True): 2}


def test_failed_calls_become_rows(spark):
    calls = []

    def say(member, history, row):
        calls.append(1)
        raise ConnectionError("down")

    rows = spark.createDataFrame([("m", [("user", "hi")])], f"member string, history {client.HISTORY}")
    row = client.speak(rows, client.scripted(say)).first()
    assert row.err_msg == "ConnectionError: down" and row.history[-1].content == ""


def test_judged_discussion_and_chain(spark):
    questions = spark.createDataFrame([("1", "m", "p", "v"), ("2", "m", "p", "v")], "id string, focal_method string, test_prefix string, expected_value string")
    judge = client.scripted(lambda member, history, row: "**YES** fine" if row["id"] == "1" else "**NO** wrong")
    found = discussion.judged_discussion(questions, ["a", "b"], client.scripted(lambda m, h, r: "x"), judge)
    assert {r.id: r.response for r in found.collect()} == {"1": "fine", "2": "wrong"}
    chained = discussion.chained(questions.withColumn("member", F.lit("a")), [F.lit("one"), F.lit("two")], client.scripted(lambda m, h, r: str(len(h))))
    assert [m.content for m in chained.first().history] == ["one", "1", "two", "3"]


def test_consensus_agrees_with_brute_force_without_shuffles(spark):
    """Questions that settle at once, later, never (most votes, or the first member's), whose calls fail, and equal ids."""
    members = ["b", "a", "c"]

    def say(member, history, row):
        turn, kind = len(history) // 2, row["expected_value"]
        if kind == "fails" and member == "c":
            raise OSError("down")
        if kind == "none" and member == "a":
            return None
        if kind == "votes":
            return " x" if member != "b" else f"y{turn}"
        if kind == "apart":
            return f"{member} of {row['focal_method']}"
        if kind == "heard":  # the first member ends with what it was asked last, so with what the others said
            return history[-1]["content"] if turn == 2 and member == "b" else f"{member}{turn} "
        return member if kind == "later" and not turn else " same "

    def brute(kind, focal):
        talks = {m: [{"role": "user", "content": None}] for m in members}
        for number in range(3):
            for m, history in talks.items():
                try:
                    said = say(m, history, {"expected_value": kind, "focal_method": focal})
                except OSError:
                    said = ""
                history.append({"role": "assistant", "content": said})
            heard = [None if h[-1]["content"] is None else h[-1]["content"].strip(" ") for h in talks.values()]
            known = {x for x in heard if x is not None}
            if len(known) == 1:
                return known.pop(), number
            last = {m: h[-1]["content"] for m, h in talks.items()}
            for m, history in talks.items():
                others = [last[k] for k in sorted(members) if k != m]
                history.append({"role": "user", "content": "\n".join(["Other members answered:", *(f"Member {i}: {x}" for i, x in enumerate(others, 1))])})
        return max(heard, key=lambda x: (heard.count(x), -heard.index(x))), number

    asked = [(str(i), kind, f"m{i}") for i, kind in enumerate(["votes", "apart", "heard", "later", "fails", "none", "settled"] * 2)] + [("0", "settled", "m"), ("1", "apart", "n")]
    questions = spark.createDataFrame(asked, "id string, expected_value string, focal_method string").withColumn("test_prefix", F.lit("t"))
    found = discussion.consensus(questions, members, client.scripted(say), most_rounds=2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(i, *brute(kind, focal)) for i, kind, focal in asked]
    assert {number for _, _, number in want} == {0, 1, 2}
    assert sorted((r.id, r.response, r.rounds) for r in found.collect()) == sorted(want)
    assert discussion.consensus(questions.limit(0), members, client.scripted(say)).count() == 0


def test_columns_are_read_as_by_to_pylist():
    kind = pa.list_(pa.struct([("member", pa.string()), ("history", pa.list_(pa.struct([("role", pa.string()), ("n", pa.int64())])))]))
    rows = [[{"member": "a", "history": [{"role": "x", "n": 1}, None, {"role": None, "n": None}]}, {"member": None, "history": None}], None, [], [None], [{"member": "", "history": []}]]
    column = pa.array(rows, kind)
    for part in (column, column[1:], column[2:4], column[:0]):
        assert client.plain(part) == part.to_pylist()


def test_commands_run_apart_and_never_fail_the_job(spark):
    rows = spark.createDataFrame([("cat a/b.txt", {"a/b.txt": "hello"}), ("no-such-tool", {}), ("cat x", {"../x": "no"})], "command string, files map<string,string>")
    got = [(r.exit_code, r.log) for r in runner.run_commands(rows, files="files").collect()]
    assert got[0] == (0, "hello") and got[1][0] == 127 and "leaves the working folder" in got[2][1]


def test_a_run_that_is_stopped_keeps_what_it_printed(spark):
    rows = spark.createDataFrame([({"x": "1"},)], "files map<string,string>")
    got = runner.compile_and_test(rows, "echo built", "sleep 20", seconds=1).first()
    assert (got.compiled, got.passed, got.reason, got.exit_code) == (True, False, "timeout", None)
    assert "built" in got.log


def test_classes_are_repaired_once(spark):
    """A method whose loss doesn't help, a class without methods, a method of several lines."""
    compile_ = r"echo; echo; grep -n BAD T | sed 's/^\([0-9]*\):.*/[javac] T:\1: error: bad/'; ! grep -q -e BAD -e WORSE T"
    rows = spark.createDataFrame([(1, "h", ["BAD", "WORSE"], "t"), (2, "h", [], "t"), (3, "h", ["a\nBAD\nb", "c", "BAD"], "t")], "id int, head string, methods array<string>, tail string")
    got = {r.id: (r.rounds, r.n_lost, r.compiled, r.passed, r.methods) for r in runner.compile_repaired(rows, compile_, "true", "T").collect()}
    assert got == {1: (2, 1, False, False, ["WORSE"]), 2: (1, 0, True, True, []), 3: (2, 2, True, True, ["c"])}


def test_streamed_votes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"id": 1, "answer": "x", "ord": 0}\n{"id": 1, "answer": "x", "ord": 1}\n{"id": 1, "answer": "y", "ord": 2}\n')
    rows = stream.running_votes(stream.stream_jsonl(spark, str(folder), "id long, answer string, ord long"))
    q = rows.writeStream.outputMode("complete").format("memory").queryName("running_votes").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.answer, r.n) for r in spark.table("running_votes").collect()} == {("x", 2), ("y", 1)}


def pairwise(a, b):
    mean = (len(a) + len(b)) / 2
    part = lambda f, n: 2.5 * f / (f + 1.5 * (0.25 + 0.75 * n / mean))
    return math.log(1.2) / 2 * sum(a.count(t) * part(b.count(t), len(b)) + b.count(t) * part(a.count(t), len(a)) for t in {*a} & {*b})


def test_bm25_ties_go_to_the_smallest_id_however_terms_are_ordered(spark):
    """Sources that are permutations of each other score alike, whatever the order of their sums."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    targets, sources, want = [], [], {}
    for case in range(60):
        text = [words[i] for i in rng.integers(0, 30, 25)]
        targets.append((f"g{case}", case, [words[i] for i in rng.integers(0, 30, 12)]))
        ids = rng.permutation(3) + 3 * case
        sources += [(f"g{case}", int(i), [text[k] for k in rng.permutation(25)]) for i in ids]
        want[case] = 3 * case
    sides = [spark.createDataFrame(x, "grp string, id long, terms array<string>") for x in (targets, sources)]
    for nearest in (1, 1024):
        assert {r.tgt: r.src for r in retrieval.bm25_top1(*sides, nearest=nearest).collect()} == want


@pytest.mark.parametrize("nearest", [1, 3, 1024])
def test_bm25_leaves_one_out_by_name_and_visits_only_what_can_win(spark, nearest):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 4)), i, int(rng.integers(0, 9)), [f"w{k}" for k in rng.zipf(1.5, rng.integers(0, 40)) if k < 50]) for i in range(120)]
    rows += [(9, 500, 1, ["a"]), (9, 501, 1, ["a"]), (8, 600, 1, ["a"]), (7, 700, 1, None), (7, 701, 2, ["a"]), (7, 702, 3, ["b"]), (None, 703, 1, ["a"]), (7, None, 1, ["a"])]
    side = spark.createDataFrame(rows, "grp long, id long, skip long, terms array<string>")
    got = {r.tgt: (r.src, round(r.sim, 9)) for r in retrieval.bm25_top1(side, side, same=True, nearest=nearest, block=5).collect()}
    want = {}
    for g, i, name, terms in rows:
        others = [(round(pairwise(terms or [], t or []), 9), -j) for h, j, n, t in rows if None not in (g, h, i, j) and h == g and n != name]
        if others:
            want[i] = (-max(others)[1], max(others)[0])
    assert {i: s for i, (s, _) in got.items()} == {i: s for i, (s, _) in want.items()}
    assert {i: x for i, (_, x) in got.items()} == pytest.approx({i: x for i, (_, x) in want.items()}, abs=2e-9)


def test_most_similar_other_text(spark):
    """Equal texts are skipped, repeated ones count once, nothing in common gives no source and 0."""
    rng = np.random.default_rng(8)
    text = lambda: " ".join("abcdefgh"[i] for i in rng.integers(0, 8, rng.integers(0, 6)))
    sources = [(f"b{rng.integers(0, 3)}", i, text()) for i in range(60)] + [("b0", 100, None), (None, 101, "a"), ("b0", 102, "z z")]
    targets = [(g, i + 1000, t) for g, i, t in sources[:40]] + [("other", 2000, "a b"), ("b0", 2001, None), (None, 2002, "a"), ("b0", 2003, "y"), ("b1", 2004, "")]
    frames = [spark.createDataFrame(x, "grp string, id long, text string") for x in (targets, sources)]
    got = {r.tgt: (r.src, round(r.sim, 9)) for r in retrieval.other_text_top1(*frames, lambda t: F.filter(F.split(t, " "), lambda x: x != "")).collect()}
    want = {}
    for g, i, t in targets:
        a = set((t or "").split())
        seen = [(round(len(a & {*u.split()}) / len(a | {*u.split()}), 9), -j) for h, j, u in sources if h == g and None not in (g, t, u) and u != t and a & {*u.split()}]
        want[i] = (-max(seen)[1], max(seen)[0]) if seen else (None, 0.0)
    assert got == want


def test_ranges_of_any_length_meet_points_in_few_rows(spark):
    """Ranges of one number and of 10 ** 9 in one table, also below zero, empty, repeated and null ones."""
    rng = np.random.default_rng(2)
    ranges = [(int(k), i, int(lo), int(lo + n)) for i, (k, lo, n) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(-200, 200, 60), rng.choice([-1, 0, 1, 5, 63, 64, 300, 10**9], 60), strict=True))]
    ranges += [(1, 100, None, 5), (1, 101, 5, None), (None, 102, 0, 5), (1, 103, -(2**62), 2**62 - 2), ranges[0]]
    points = [(int(k), int(at)) for k, at in zip(rng.integers(0, 4, 80), rng.integers(-300, 600, 80), strict=True)] + [(1, 10**9), (1, None), (None, 1), (2, 7), (2, 7)]
    r = spark.createDataFrame(ranges, "key long, rid long, lo long, hi long")
    p = spark.createDataFrame(points, "key long, at long")
    inside = [(k, at, i) for k, at in points for j, i, lo, hi in ranges if None not in (k, at, lo, hi) and j == k and lo <= at <= hi]
    assert sorted((x.key, x["at"], x.rid) for x in joins.range_hits(p, r).collect()) == sorted(inside)
    made = [x["count"] for x in joins._nodes(r).distinct().groupBy("rid", "lo", "hi").count().collect()]
    assert max(made) <= 2 * 63 and max(x["count"] for x in joins._nodes(r.filter("hi - lo <= 1000000000")).distinct().groupBy("rid").count().collect()) <= 64
    hit = {i for _, _, i in inside}
    assert sorted(x.rid for x in joins.ranges_hit(r, p, "rid").collect()) == sorted(i for _, i, _, _ in ranges if i in hit)
    assert sorted(x.rid for x in joins.ranges_hit(r, p, "rid", hit=False).collect()) == sorted(i for _, i, _, _ in ranges if i not in hit)
    assert joins.range_hits(p, r.limit(0)).count() == joins.range_hits(p.limit(0), r).count() == 0


def test_stems_in_names(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join("abc"[i] for i in rng.integers(0, 3, n))
    names = [word(n) for n in rng.integers(0, 12, 60)] + ["", "x" * 200 + "abcabc", None]
    stems = [(word(n), f"s{i}") for i, n in enumerate(rng.integers(0, 7, 30))] + [("", "s"), (None, "n"), ("x" * 50, "long"), ("abcabcabcabcabcabc", "longer")]
    got = {r.test: r.source for r in joins.stem_match(spark.createDataFrame([(n,) for n in names], "test string"), spark.createDataFrame(stems, "stem string, source string")).collect()}
    assert got == {n: min(s for t, s in stems if t and t in n) for n in names if n and any(t and t in n for t, _ in stems)}
    assert joins.stem_match(spark.createDataFrame([("a",)], "test string"), spark.createDataFrame([], "stem string, source string")).count() == 0


def test_most_common_prefers_what_was_seen_first_and_null_kinds_stay_apart(spark):
    rows = spark.createDataFrame([(0, "z"), (1, "b"), (2, "a"), (3, "b"), (4, "a"), (5, None)], "at long, v string")
    assert [(r.v, r.n) for r in metrics.most_common(rows, "v", 3, F.col("at")).collect()] == [("b", 2), ("a", 2), ("z", 1)]
    votes_ = spark.createDataFrame([("a", None, True), ("a", "x", True), ("a", None, True), (None, "x", True)], "member string, kind string, correct boolean")
    got = sorted(((r.member, r.kind, r.n) for r in metrics.by_member_and_kind(votes_).collect()), key=str)
    assert got == sorted([("a", None, 2), ("a", "x", 1), ("a", "all", 3), (None, "x", 1), (None, "all", 1)], key=str)


def test_regions_of_sets_by_bitmap(spark):
    """Ids over several buckets, repeated, null and negative ones."""
    from granary.operators import bitmaps

    rng = np.random.default_rng(7)
    rows = [(int(i), n) for n in "abcd" for i in rng.integers(-5, 100_000, 400)] + [(1, "a"), (1, "a"), (None, "a"), (2, None), (32_768, "a"), (32_768, "b"), (32_769, "other")]
    frame = spark.createDataFrame(rows, "id long, of string")
    names = ["a", "b", "c", "d"]
    held = {}
    for i, n in rows:
        if i is not None and n in names:
            held.setdefault(i, set()).add(n)
    want = {}
    for s in held.values():
        key = tuple(n in s for n in names)
        want[key] = want.get(key, 0) + 1
    got = {tuple(r[n] for n in names): r.n for r in bitmaps.regions(bitmaps.id_bitmaps(frame, F.col("of")), names).collect()}
    assert got == want
    assert bitmaps.regions(bitmaps.id_bitmaps(frame.limit(0), F.col("of")), names).count() == 0
    empty = {(r.metric, r.member): r.n for r in bitmaps.set_metrics(spark.createDataFrame([], "id long, member string, correct boolean"), ["a", "b"]).collect()}
    assert set(empty.values()) == {0} and len(empty) == 7


@pytest.mark.parametrize("few", [0, 16])
def test_blocks_of_a_group_are_stored_once(spark, monkeypatch, few):
    """All pairs of many blocks, with and without the nested loop: right, and each row is stored once."""
    rng = random.Random(5)
    docs = {i: [f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.choice([0, 3, 40]))] for i in range(120)}
    frame = spark.createDataFrame([(i % 2, i, t) for i, t in docs.items()], "grp long, id long, terms array<string>")
    stored = []
    monkeypatch.setattr(retrieval, "FEW", few)
    monkeypatch.setattr(retrieval, "stored_table", lambda df: stored.append(storage.stored_table(df)) or stored[-1])
    side = frame.select("grp", "id", retrieval.token_hashes(F.col("terms")).alias("value"))
    sets = {i: set(t) for i, t in docs.items()}
    near = lambda a, b: round(len(sets[a] & sets[b]) / (len(sets[a] | sets[b]) or 1), 9)
    want = {i: max((j for j in docs if j != i and (j - i) % 2 == 0), key=lambda j: (near(i, j), -j)) for i in docs}
    assert {r.tgt: r.src for r in retrieval.top1(side, side, "jaccard", True, 7).collect()} == want
    assert sum(len(r.ids) // 8 for r in stored[0].collect()) == len(docs) and stored[0].count() > 10
    pairs = {(r.tgt, r.src): round(r.sim, 9) for r in retrieval.bm25_all(frame.filter("grp = 0").drop("grp"), frame.filter("grp = 1").drop("grp"), 7).collect()}
    terms = [retrieval.term_counts(frame.filter(f"grp = {g}"), "id", "terms").withColumnRenamed("id", n) for g, n in enumerate(("tgt", "src"))]
    assert pairs == {(r.tgt, r.src): pytest.approx(r.sim, abs=2e-9) for r in retrieval.bm25_pairs(*terms).collect()}


def test_large_groups_and_frequent_imports_are_spread(spark):
    """One nation, one wildcard: all pairs, over more tasks than groups."""
    rows = spark.range(60).select(F.lit(7).alias("g"), "id")
    found = joins.siblings(rows, "g", part=4)
    assert sorted((r.tgt, r.src) for r in found.collect()) == [(a, b) for a in range(60) for b in range(60) if a != b]
    assert sum(n > 0 for n in found.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()) > 2
    sources = spark.range(60).select("id", F.array(F.lit("p.*"), F.lit("p.B"), F.lit("q.*")).alias("imports"))
    types = spark.createDataFrame([("p.A",), ("p.B",), ("p.B",), ("r.C",)], "type string")
    assert sorted((r.id, r.type) for r in joins.import_types(sources, types).collect()) == [(i, t) for i in range(60) for t in ("p.A", "p.B")]
    plan = joins.import_types(sources, types)._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan


@pytest.mark.parametrize("often", [0.08, 2])
def test_common_tokens_are_counted_in_every_way(monkeypatch, often):
    """Frequent, middling and rare tokens, more than 255 of a set, tables in parts; each set's best partner of either block."""
    from granary.operators import set_blocks

    monkeypatch.setattr(set_blocks, "OFTEN", often)
    rng = np.random.default_rng(3)
    made = []
    for block in range(2):
        sets_ = [np.unique(np.append(rng.zipf(1.2, k) % 5000, rng.integers(0, 300, k))) for k in rng.choice([0, 1, 9, 60, 600], 300)]
        made.append((np.arange(300) * 2 + block, sets_, set_blocks.made(np.arange(300) * 2 + block, np.array([len(x) for x in sets_]), np.ones(300, bool), np.concatenate(sets_))))
    (ids, sets_, left), (more, others, right) = made
    for limit in (1 << 26, 1 << 16):
        monkeypatch.setattr(set_blocks, "TABLE", limit)
        i, j = set_blocks._shared(left, right)
        counts = np.concatenate([x.copy() for _, x in set_blocks._counts(left, right, i, j, np.arange(300), np.arange(299))])
        assert (counts == [[len(np.intersect1d(a, b)) for b in others[:299]] for a in sets_]).all()
    set_blocks.met(left, right)
    everything = list(zip([*ids, *more], [set(x) for x in sets_ + others], strict=True))
    for block in (left, right):
        for i, near, src in zip(block.ids, block.near, block.src, strict=True):
            own = dict(everything)[i]
            sim, at = max((round(len(own & x) / (len(own | x) or 1), 9), -j) for j, x in everything if j != i)
            assert round(near, 9) == sim and (sim == 0 or src == -at)


@pytest.mark.parametrize("few", [0, 16])
def test_equal_sets_are_compared_once_and_texts_of_both_sides_are_stored_once(spark, monkeypatch, few):
    stored = []
    monkeypatch.setattr(retrieval, "FEW", few)
    monkeypatch.setattr(retrieval, "CHUNK", 40)
    monkeypatch.setattr(retrieval, "stored_table", lambda df: stored.append(storage.stored_table(df)) or stored[-1])
    rng = random.Random(9)
    kinds = [[rng.randrange(40) for _ in range(rng.choice([1, 5, 12]))] for _ in range(12)]
    rows = [("g", i, sorted({*rng.choice(kinds)})) for i in range(150)] + [("g", 150, []), ("g", 151, None), ("h", 200, [1]), (None, 201, [1]), ("g", 7, None)]
    rows[-1] = rows[7]  # a row that is there twice
    side = spark.createDataFrame(rows, "grp string, id long, value array<long>")
    got = {r.tgt: (r.src, round(r.sim, 9)) for r in retrieval.top1(side, side, "jaccard", True, 3).collect()}
    near = lambda a, b: round(len({*(a or [])} & {*(b or [])}) / (len({*(a or [])} | {*(b or [])}) or 1), 9)
    want = {}
    for g, i, v in rows:
        others = [(near(v, w), -j) for h, j, w in rows if g is not None and h == g and j != i]
        if others:
            want[i] = (-max(others)[1], max(others)[0])
    assert got == want
    held = stored[0].collect()
    assert sum(len(r.sizes) // 4 for r in held) < 100 < sum(len(r.ids) // 8 for r in held) == 152 + 1
    stored.clear()
    texts = spark.createDataFrame([("g", i, f"a w{i % 20} w{i % 7}") for i in range(60)], "grp string, id long, text string")
    assert retrieval.other_text_top1(texts, texts, lambda t: F.split(t, " ")).count() == 60
    assert sum(len(r.ids) // 8 for df in stored if "ids" in df.columns for r in df.collect()) == 60


def test_bm25_bounds_leave_out_no_best_source(spark):
    """Frequent, middling and rare terms, long and short texts, sources to be passed over; with a best score so far, only what reaches it is found."""
    from granary.operators import term_blocks

    rng = np.random.default_rng(12)
    docs = [[f"w{k % 400}" for k in rng.zipf(1.3, size)] + [f"x{k}" for k in rng.integers(0, 900, size // 2)] for size in rng.choice([0, 1, 20, 150, 900], 90)]
    side = spark.createDataFrame([(0, i, i // 2, d) for i, d in enumerate(docs)], "grp long, id long, skip long, terms array<string>")
    made = [retrieval._terms_of(x, False).withColumn("floor", F.lit(0.0)) for x in (side.filter("id % 3 > 0"), side.filter("id % 3 < 2"))]
    tiles = retrieval._dealt(made, "bm25", 16)
    cut = [np.frombuffer(r.l_lengths, np.int64) for r in tiles.select("l_lengths").distinct().collect()]
    assert max(map(len, cut)) <= 16 and all((np.diff(x) <= 0).all() for x in cut)
    checked = 0
    for row in tiles.collect():
        left, right = (retrieval.Block(*(np.frombuffer(row[p + c], t) for c, t in retrieval._KINDS.items())) for p in ("l_", "r_"))
        want = np.array([[-1.0 if i // 2 == j // 2 else pairwise(docs[i], docs[j]) * 2 / retrieval.IDF for j in right.ids] for i in left.ids])
        for share in (0.0, 0.9, 1.1):
            floor = np.maximum(want.max(1) * share, 0)
            found = {}
            for r, c, score in zip(*term_blocks.best(left, right, *retrieval._shared(left, right), floor, True), strict=True):
                assert score == pytest.approx(want[r, c])
                found[r] = max(found.get(r, 0), score)
            for r, most in enumerate(want.max(1)):
                assert (share > 1 and found.get(r, 0) <= floor[r]) or most <= 0 or found[r] == pytest.approx(most)
                checked += 1
    assert checked > 3 * 60
