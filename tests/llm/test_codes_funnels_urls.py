"""Vector codes, funnels and URL filters against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import datetime
import hashlib
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from granary.llm import funnel, url_filter, vector_codes
from granary.llm.funnel import Funnel, count_funnels
from granary.llm.url_filter import filter_urls, rules_table
from granary.llm.vector_codes import compress_vectors, nearest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

CLASHING = ["id", "uid", "label_error", "code", "error", "bucket", "client", "at", "step", "took", "rule", "verdict", "token", "n", "tokens", "address", "host"]


def clashing(frame):
    return frame.withColumns({c: F.lit("x") for c in CLASHING if c not in frame.columns})


# vector codes


def exact_nearest(x, entries):
    return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(entries))


def compressed(rows, parts, entries, rounds, scale):
    """rows: (id, vector, label); the contract's steps in Python integers."""
    kept = [r for r in rows if r[1] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) % parts == 0]
    with_id = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))
    if not with_id:
        return []
    d = len(with_id[0][1])
    kept = [r for r in kept if len(r[1]) == d]
    cut = lambda v: [[math.floor(Fraction(x) * scale) for x in v[p * d // parts : (p + 1) * d // parts]] for p in range(parts)]
    books = [list(b) for b in zip(*(cut(r[1]) for r in [r for r in with_id if len(r[1]) == d][:entries]), strict=True)]
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for r in kept:
                part = cut(r[1])[p]
                own[exact_nearest(part, book)[1]].append(part)
            books[p] = [[sum(c) // len(own[i]) for c in zip(*own[i], strict=True)] if own[i] else e for i, e in enumerate(book)]
    out, errors = [], defaultdict(int)
    for i, v, label in kept:
        found = [exact_nearest(x, b) for x, b in zip(cut(v), books, strict=True)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), label))
        errors[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, e, errors[label], digest) for i, code, e, label in out]


def vectors(spark, rows):
    return clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))


def odd_vectors(seed, n=60, d=8):
    rng = random.Random(seed)
    value = lambda: float(np.float32(rng.choice([rng.gauss(0, 1), rng.randint(-2, 2) / 4])))
    rows = [(i, [value() for _ in range(d)], rng.choice([0, 0, 0, 1, None])) for i in rng.sample(range(1000), n)]
    one, bad = rows[0][1], rows[1][1]
    rows += [(rows[0][0], one, 5), rows[0], (rows[3][0], rows[4][1], 1), (None, one, 0), (None, one, None)]  # repeated and null ids
    rows += [(-1, None, 0), (-2, [], 0), (-3, [None, *bad[1:]], 0), (-4, [math.nan, *bad[1:]], 0), (-5, [*bad[:-1], math.inf], 1), (-6, [-math.inf, *bad[1:]], 1), (-7, bad[:-1], 0), (2000, bad + bad, 1)]
    return rows


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(2, 4, 3), (4, 7, 2), (8, 16, 0), (1, 100, 2)])
def test_codes_match_brute_force(spark, parts, entries, rounds):
    rows = odd_vectors(parts)
    got = compress_vectors(vectors(spark, rows), parts, entries, rounds, scale=16)
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=key) == sorted(compressed(rows, parts, entries, rounds, 16), key=key)


def test_codes_of_tables_without_usable_rows(spark):
    for rows in ([], [(1, None, 0)], [(None, [1.0] * 8, 0)], [(1, [1.0] * 7, 0)]):
        got = compress_vectors(vectors(spark, rows))
        assert got.columns[:5] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0
    one = compress_vectors(vectors(spark, [(1, [0.25] * 16, None)])).first()
    assert (one.code, one.error, one.label_error) == ("00" * 8, 0, 0)


def test_very_large_components_are_cut_off(spark):
    rows = [(1, [3e38] * 8, 0), (2, [-3e38] * 8, 0), (3, [0.0] * 8, 0), (4, [1e10] * 8, 0)]
    got = {r.vec_id: r for r in compress_vectors(vectors(spark, rows), entries=2, rounds=0).collect()}
    most = vector_codes.limit_of(8)
    assert got[4].error == 0 and got[3].error == 8 * most**2 and got[3].label_error == 8 * most**2


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 17), st.integers(1, 9), st.sampled_from([1, 40, 5000, 1 << 24]), st.integers(0, 10**6))
def test_bounds_never_drop_the_nearest_entry(width, n, size, seed):
    rng = np.random.default_rng(seed)
    x, entries = rng.integers(-size, size + 1, (30, width)), rng.integers(-size, size + 1, (n, width))
    entries[rng.integers(0, n)] = x[0] + rng.integers(-1, 2, width)
    index, distance, taken = nearest(x, entries)
    all_distances = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (index == all_distances.argmin(1)).all() and (distance == all_distances.min(1)).all()
    assert len(x) <= taken


def test_bounds_spare_distances():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (16, 8))
    _, _, taken = nearest(centres[rng.integers(0, 16, 500)] + rng.integers(-300, 300, (500, 8)), centres)
    assert taken < 0.3 * 500 * 16


# funnels


def counted(events, funnels, within, per_cent=90):
    """events: (client, kind, microseconds) or None in any."""
    rows = defaultdict(set)
    for c, k, t in events:
        if None not in (c, k, t):
            rows[c].add((t, k))
    out = []
    for f in funnels:
        for c, own in rows.items():
            reach, times = [0] * len(f.steps), [[] for _ in f.steps]
            for start, k in own:
                if k != f.steps[0]:
                    continue
                reach[0] += 1
                at = start
                for s, kind in enumerate(f.steps[1:], 1):
                    later = [t for t, k in own if k == kind and t > at]
                    if not later or min(later) - start > within or any(k in f.excluded and at < t <= min(later) for t, k in own):
                        break
                    reach[s] += 1
                    times[s].append(min(later) - at)
                    at = min(later)
            if reach[0]:
                nth = [sorted(x)[-(-per_cent * len(x) // 100) - 1] if x else None for x in times[1:]]
                out.append((f.name, c, *reach, max(s for s, n in enumerate(reach, 1) if n), *nth))
    depth = defaultdict(int)
    steps = max(len(f.steps) for f in funnels)
    for r in out:
        depth[r[0], r[1 + steps + 1]] += 1
    return sorted((*r, depth[r[0], r[1 + steps + 1]]) for r in out)


def events_of(seed, n=400):
    rng = random.Random(seed)
    kinds = ["view", "click", "purchase", "error", "signup", "other", None]
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, 4, None]), rng.choices(kinds, [6, 5, 3, 0.5, 0.5, 1, 0.3])[0], rng.choice([rng.randint(0, 3000), rng.randint(0, 200) * 10, None] if rng.random() < 0.05 else [rng.randint(0, 3000), rng.randint(0, 200) * 10])) for _ in range(n)]
    return rows + rows[:40]


def clicks(spark, rows, moment=datetime.datetime(2024, 3, 31, 0, 30)):
    """Around a change of clocks, which must not matter to times without a zone."""
    made = [(c, k, None if t is None else moment + datetime.timedelta(microseconds=t)) for c, k, t in rows]
    return clashing(spark.createDataFrame(made, "client_id long, kind string, arrived_at timestamp_ntz"))


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("within", [60, 400])
def test_funnels_match_brute_force(spark, partitions, within):
    rows = events_of(within + partitions)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = sorted(tuple(r) for r in count_funnels(clicks(spark, rows), within=within).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == counted(rows, funnel.FUNNELS, within)


def test_times_without_a_zone_ignore_the_sessions_zone(spark):
    rows = [(c, k, None if t is None else t * 3_000_000) for c, k, t in events_of(5)]
    want = counted(rows, funnel.FUNNELS, funnel.WITHIN)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert sorted(tuple(r) for r in count_funnels(clicks(spark, rows)).collect()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_funnels_with_other_steps_and_clients(spark):
    funnels = [Funnel("two", ("a", "b"), ("x", "y")), Funnel("three", ("b", "a", "b")), Funnel("one", ("a",))]
    rng = random.Random(9)
    rows = [(rng.choice(["p", "q"]), rng.choice("aabbxyz"), rng.randint(0, 400)) for _ in range(200)]
    made = [(c, k, datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=t)) for c, k, t in rows]
    frame = spark.createDataFrame(made, "client_id string, kind string, arrived_at timestamp")
    got = count_funnels(frame, funnels, within=50, per_cent=50)
    assert got.columns == ["funnel", "client_id", "n1", "n2", "n3", "deepest", "t2", "t3", "same_depth"]
    padded = [Funnel(f.name, (*f.steps, "-", "-")[:3], f.excluded) for f in funnels]
    assert sorted(tuple(r) for r in got.collect()) == counted(rows, padded, 50, 50)


def test_funnels_of_no_events(spark):
    for rows in ([], [(None, "view", 1)], [(1, None, 1)], [(1, "view", None)], [(1, "other", 5)]):
        assert count_funnels(clicks(spark, rows)).count() == 0


# URL filters

PIECES = ["http://", "https://", "://", "x://", "com", "example.com", "www.example.com", "a.net", "NET", "Ads", "ads", "-", ".", "/", "/en/", "/es/", "?", "#", "é", "", "login", "%20", "sitemap", ".xml", " ", "\n"]


def split_url(url):
    if not url or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    tail = rest[len(host) :]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    return host, re.match(r"[^?#]*", tail)[0], f"//{host}{tail}"


def fits(pattern, address, any_case):
    start = r"^//(?:[^/?#]*\.)?" if pattern.startswith("||") else "^//" if pattern.startswith("|") else ""
    body = pattern[2 if pattern.startswith("||") else 1 if pattern.startswith("|") else 0 :]
    end = r"\Z" if pattern.endswith("|") and len(pattern) > 1 else ""
    body = body[:-1] if end else body
    inner = "".join(".*" if c == "*" else r"(?:[^A-Za-z0-9_.%-]|\Z)" if c == "^" else re.escape(c) for c in body)
    return re.search(start + inner + end, address, re.DOTALL | (re.IGNORECASE | re.ASCII if any_case else 0)) is not None


def judged(urls, rules):
    out = []
    for i, u in urls:
        host, path, address = split_url(u)
        found = sorted((-priority, -len(r), v != "allow", r) for r, p, v, priority, any_case in set(rules) if fits(p, address, any_case))
        best = found[0] if found else None
        out.append((i, host, path, best[3] if best else None, ("block" if best[2] else "allow") if best else "allow", -best[0] if best else None))
    return sorted(out, key=str)


def urls_of(seed, n=250):
    rng = random.Random(seed)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9))) for _ in range(n)]
    made += ["http://a.net/ads/x", "http://ads.a.net", "http://x.com", "http://x.com/", "HTTP://WWW.EXAMPLE.COM/en/1", "http://m.example.com/en/", "no address", "", None, "http://a.org/login?x", "http://a.org/Login", "http://loginx.org/xlogin", "http://" + "a/" * 20_000 + "ads/"]
    return [*enumerate(made), (0, "http://x.com/"), (0, "http://x.com/"), (None, "http://net/es/")]


RULES = [(r, f"||{r}", v, 1, False) for r, v in url_filter.BASE] + [(p, p, v, 0, True) for p, v in url_filter.PATTERNS]
RULES += [(p, p, "block", 0, True) for p in ("|com", "a*net", "^", "*", "|", "||", "en", "é", "/en/|", "||a.net^*ads", "ads*", "example.com/en/", "-")] + [("en", "en", "allow", 0, True), ("en", "en", "block", 0, True)]


@pytest.mark.parametrize("rules", [RULES, RULES[: len(url_filter.BASE) + len(url_filter.PATTERNS)], RULES[-7:], []])
def test_verdicts_match_trying_every_rule(spark, rules):
    urls = urls_of(len(rules))
    table = spark.createDataFrame(rules, url_filter.RULES_SCHEMA)
    frame = clashing(spark.createDataFrame(urls, "page_id long, url string"))
    got = filter_urls(frame, table)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == judged(urls, rules)


def test_rules_are_fetched_by_their_rarest_token(spark):
    urls = [(i, f"http://h{i}.example.com/en/{i}") for i in range(50)] + [(50, "http://rare.example.com/en/")]
    table = rules_table(spark, [("example.com/en/", "block"), ("rare.example.com/en/", "allow")], [])
    addresses = spark.createDataFrame(urls, "page_id long, url string").select(url_filter.tokens_of(url_filter.address_of(F.col("url"))).alias("tokens"))
    assert {r.rule: r.token for r in url_filter.indexed(table, addresses).collect()} == {"example.com/en/": "example", "rare.example.com/en/": "rare"}
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(urls, "page_id long, url string"), table).collect()}
    assert got[0].n_regex == 1 and got[50].n_regex == 2 and got[50].verdict == "allow" and got[0].verdict == "block"


def test_odd_rules_and_no_pages(spark):
    table = spark.createDataFrame([("a", None, "block", 0, True), ("b", "b", None, 0, True), (None, "*", "block", 0, True), ("c", "*", "block", None, True)], url_filter.RULES_SCHEMA)
    pages = spark.createDataFrame([(1, "http://a.b/"), (2, None)], "page_id long, url string")
    assert sorted((r.page_id, r.verdict) for r in filter_urls(pages, table).collect()) == [(1, "allow"), (2, "allow")]
    assert filter_urls(pages.limit(0), rules_table(spark)).count() == 0
