"""The operators against brute force, exact round trips and held-out accuracy, with nulls, ties, repeats and clashing names."""

import hashlib
import os
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import common, decontamination, html_extract, jaccard_join, line_dedup, quality_rules, secrets, substring_dedup, toxicity
from granary.llm.decontamination import find_contaminated
from granary.llm.license_scan import scan_licenses
from granary.llm.source_mixing import mix_sources

ODD = [None, "", " ", "\n", "a", "a", "A b", "é", "x\x00y", "tab\tand\x0bmore", "long " * 20_000]
#: Columns that operators use inside, as extra columns of the input.
CLASHING = ["id", "uid", "spans", "bitmap", "score", "items", "weight", "group", "n", "tokens"]


def documents(spark, texts, ids=None):
    rows = list(zip(ids if ids is not None else range(len(texts)), texts, strict=True))
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHING})


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


# substring dedup


def removed(texts, length, keep_first):
    data = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for d, b in enumerate(data):
        for s in range(len(b) - length + 1):
            places[b[s : s + length]].append((d, s))
    cover = [np.zeros(len(b), bool) for b in data]
    for found in places.values():
        if len(found) > 1:
            for d, s in found:
                if not keep_first or (d, s) != min(found):
                    cover[d][s : s + length] = True
    out = []
    for d, (b, c) in enumerate(zip(data, cover, strict=True)):
        runs = sum(1 for i in range(len(c)) if c[i] and (i == 0 or not c[i - 1]))
        out.append((d, len(b), int(c.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, c, strict=True) if not g)).hexdigest()))
    return out


def copied_texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 160))) for _ in range(10)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 40) :][: rng.randint(5, 120)] if rng.random() < 0.6 else "".join(rng.choice("abcdefg") for _ in range(25)) for _ in range(rng.randint(0, 5))) for _ in range(60)]
    return [*texts, texts[3], texts[3], "a" * 250, *ODD[:-1]]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("length", [9, 40])
def test_substrings_match_brute_force(spark, length, keep_first):
    texts = copied_texts(length)
    got = substring_dedup.dedup_substrings(documents(spark, texts), length, keep_first)
    assert sorted(tuple(r)[:5] for r in got.collect()) == removed(texts, length, keep_first)


@pytest.mark.parametrize(("hot", "crowded"), [(1, 1), (1, 3), (3, 20)])
@pytest.mark.parametrize("keep_first", [False, True])
def test_crowded_grams_are_cut_by_halves_and_then_by_windows(spark, monkeypatch, keep_first, hot, crowded):
    whole = substring_dedup.repeated_spans
    monkeypatch.setattr(substring_dedup, "repeated_spans", lambda rows, length, first: whole(rows, length, first, hot, crowded))
    texts = copied_texts(5 + hot + crowded)
    got = substring_dedup.dedup_substrings(documents(spark, texts), 30, keep_first, keep_text=False)
    assert sorted(map(tuple, got.collect())) == removed(texts, 30, keep_first)


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("length", [9, 30])
def test_blocks_of_crowded_grams_are_cut_in_the_task(spark, monkeypatch, keep_first, length):
    whole = substring_dedup._block_rows
    monkeypatch.setattr(substring_dedup, "_block_rows", lambda length, first: whole(length, first, 64, 2))
    texts = copied_texts(40 + length)
    got = substring_dedup.dedup_substrings(documents(spark, texts), length, keep_first, keep_text=False)
    assert sorted(map(tuple, got.collect())) == removed(texts, length, keep_first)


def test_small_groups_hold_every_pair_of_equal_windows():
    rng = random.Random(12)
    length = 30
    gram, side = substring_dedup._geometry(length)
    core = "g" * gram
    around = lambda: "".join(rng.choice("ab") for _ in range(side))
    lefts, rights = [around() for _ in range(6)], [around() for _ in range(6)]
    parts = [(i, 0, True, side - k, (rng.choice(lefts)[k:] + core + rng.choice(rights)[: rng.randint(side // 2, side)]).encode()) for i in range(80) for k in [rng.randint(0, side // 2)]]
    windows = lambda x: {x[4][j : j + length]: x[1] + j for j in range(len(x[4]) - length + 1) if j <= x[3] <= j + length - gram}
    def pairs(groups):
        return {(a[0], b[0], w) for g in groups for a in g for b in g if a[0] < b[0] for w in windows(a).keys() & windows(b).keys()}
    groups = list(substring_dedup.small_groups(parts, 0, side, length, 4))
    assert max(map(len, groups)) <= 5 and pairs(groups) <= pairs([parts])
    # of windows that all are equal the first goes with every part of the others
    found = {w for _, _, w in pairs(groups)}
    assert found == {w for _, _, w in pairs([parts])}
    by = lambda ps: {(x, w) for a, b, w in ps for x in (a, b)}
    assert by(pairs(groups)) == by(pairs([parts]))


def test_anchors_of_very_long_rows_are_found_piece_by_piece(monkeypatch):
    """Positions are packed beside hashes; rows beyond the packed range are walked in overlapping pieces."""
    rng = random.Random(8)
    text = "".join(rng.choice("abc") for _ in range(3000)).encode()
    data = np.frombuffer(text + text[1000:1800] + text, np.uint8)
    for place in (255, 4095):
        monkeypatch.setattr(substring_dedup, "_PLACE", np.uint64(place))
        row, pos, gram, _ = substring_dedup.find_anchors(data, np.array([0, len(data)]), 60)
        at = set(pos.tolist())
        # every window has an anchor within it
        gaps = np.diff(sorted(at))
        assert gaps.max() <= 41 and min(at) <= 40 and max(at) >= len(data) - 60
        assert len(row) == len(gram) == len(at)


def test_substrings_keep_repeated_and_unnamed_rows_apart(spark):
    text = "".join(random.Random(2).choice("abcdef") for _ in range(300))
    rows = substring_dedup.dedup_substrings(documents(spark, [text, text, text], [1, 1, None]), 200).collect()
    assert [r.n_removed for r in rows] == [300, 300, 300]
    assert substring_dedup.dedup_substrings(documents(spark, []), 200).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=30), max_size=6), st.integers(3, 9))
def test_truncated_order_finds_equal_prefixes(texts, length):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.arange(max(0, len(data) - length + 1))
    if not len(starts):
        return
    rank, levels = substring_dedup.truncated_ranks(data, starts, length)
    pieces = [data[s : s + length].tobytes() for s in starts]
    assert [pieces[i] for i in np.argsort(rank, kind="stable")] == sorted(pieces)
    previous, later = substring_dedup.factors(rank, np.zeros(len(starts), int), starts, starts, levels, length)
    common = lambda a, b: next((k for k in range(length) if a[k] != b[k]), length)
    assert previous.tolist() == [max((common(p, x) for x in pieces[:i]), default=0) for i, p in enumerate(pieces)]
    assert later.tolist() == [max((common(p, x) for x in pieces[i + 1 :]), default=0) for i, p in enumerate(pieces)]


@pytest.mark.parametrize("length", [24, 72, 200])
def test_factor_arrays_of_longer_strings(length):
    """Copies with changes, over all spans of the doubling, and places that are given twice."""
    rng = random.Random(length)
    text = "".join(rng.choice("ab") for _ in range(400))
    parts = [text, text[50:300] + "x" + text[301:], "a" * 260, text[:length], "b" * length]
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    starts, uid, at = [], [], 0
    for k, part in enumerate(parts):
        starts += range(at, at + len(part) - length + 1)
        uid += [k] * (len(part) - length + 1)
        at += len(part)
    starts, uid = np.array([*starts, *starts[:40]]), np.array([*uid, *uid[:40]])
    rank, levels = substring_dedup.truncated_ranks(data, starts, length)
    previous, later = substring_dedup.factors(rank, uid, starts, starts, levels, length)
    pieces = [data[s : s + length].tobytes() for s in starts]
    common = lambda a, b: len(os.path.commonprefix([a, b]))
    for i in rng.sample(range(len(starts)), 60):
        assert previous[i] == max((common(pieces[i], pieces[j]) for j in range(len(starts)) if starts[j] < starts[i]), default=0)
        assert later[i] == max((common(pieces[i], pieces[j]) for j in range(len(starts)) if starts[j] > starts[i]), default=0)


# html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>%s
<footer>&copy; site</footer></body></html>"""
LONG = "A paragraph with a good many words in it, so that it is plainly text &amp; not furniture."


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<article><h1>Title</h1><p>{LONG}<p>Short.<aside>x</aside><div class='ad'>Buy</div></article>", ["Title", LONG, "Short."]),
        (f"<div class='post'><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div><div id='sidebar'><p>{LONG}</p></div>", ["Title", LONG, LONG]),
        (f"<main><p>{LONG}</p><form><p>{LONG}</p></form></main><section class='comments'><p>{LONG}</p></section>", [LONG]),
        (f"<article><p>{LONG}</p></article><article class='comment'><p>{LONG}</p></article>", [LONG]),
        (f"<div role='alert'>{LONG}</div><div hidden><p>{LONG}</p></div><article><p>a  b\n c&#233; {LONG}</p></article>", ["a b cé " + LONG]),
    ],
)
def test_pages(body, text):
    assert html_extract.extract(PAGE % body) == "\n".join(text).replace("&amp;", "&")


@pytest.mark.parametrize("name", ["page-footer", "comments", "comment-list", "sidebar-left", "cookieNotice", "ad-slot", "main_nav", "newsletter-form", "post-comments", "site-header"])
def test_furniture_by_name(name):
    assert html_extract.extract(PAGE % f"<div class=post><p>{LONG}</p><p>{LONG}</p></div><div class='{name}'><p>{LONG}</p></div>") == "\n".join([LONG.replace("&amp;", "&")] * 2)
    assert html_extract.named_furniture(None, name)


@pytest.mark.parametrize("name", ["content-with-sidebar", "has-menu", "entry-header", "post tag-social", "no-footer", "body", "loader", "reading"])
def test_content_by_name(name):
    assert not html_extract.named_furniture(name, None)


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<div><h1>T</h1><p>%s</p><p>%s</p></div>", ["T", "a " * 450, "b " * 100]),
        ("<div><div><p>%s</p></div><div><p>%s</p></div></div>", ["a " * 450, "b " * 150]),
        ("<section><p>%s</p></section><section><p>%s</p></section>", ["a " * 450, "b " * 150]),
        ("<div><p>%s</p><ul><li><a href=x>A linked item</a><li>Short</ul><p>%s</p></div>", ["a " * 450, "A linked item", "Short", "b " * 150]),
        ("<div><p>%s</p><p>%s</p><ul><li><a href=x>A linked item</a></ul></div>", ["a " * 450, "b " * 150, "A linked item"]),
        ("<table><tr><td><p>%s</p><td><p>%s</p></table>", ["a " * 450, "b " * 150]),
    ],
)
def test_pages_without_article(body, text):
    long = [t for t in text if len(t) > 100]
    assert html_extract.extract(PAGE % (body % tuple(long))) == "\n".join(t.strip() for t in text)


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "v", "<p>a<p>b"), (3, "w", "<" * 3000), (3, "w", "no markup")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract_pages(pages).collect()]
    assert got[:3] == [(1, "u", "", 0), (2, None, "", 0), (None, "v", "a\nb", 3)]
    assert got[4][2] == "no markup"


# jaccard


def clusters(texts, n, percent):
    sets = []
    for t in texts:
        w = words(lower(t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    texts = []
    for size in [2, 5, 12, 40, 120, 300] * 4:
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(rng.choice([1, 2, 6])):
            x = list(base)
            for _ in range(int(size * rng.random() * 0.06)):
                x[rng.randrange(size)] = rng.choice(vocabulary)
            texts.append(" ".join(x))
    group = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(60):
        x = list(group)
        for _ in range(rng.randint(0, 6)):
            x[rng.randrange(len(x))] = rng.choice(vocabulary)
        texts.append("  ".join(x).title())
    texts += ODD
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 40)])
@pytest.mark.parametrize(("rows", "shingles"), [(4096, 4_000_000), (8, 2000)])
def test_components_match_brute_force(spark, n, percent, rows, shingles):
    texts = near_copies(percent)
    got = jaccard_join.jaccard_components(documents(spark, texts), n, percent, rows, shingles)
    assert sorted(map(tuple, got.collect())) == clusters(texts, n, percent)


def test_whole_prefixes_give_the_same_components(spark):
    texts = near_copies(7)
    assert sorted(map(tuple, jaccard_join.jaccard_components(documents(spark, texts), 5, 80, miss=0).collect())) == clusters(texts, 5, 80)
    assert jaccard_join.prefix_length(1000, 80) == 18 and jaccard_join.prefix_length(1000, 80, 0) == 201 and jaccard_join.prefix_length(10, 80) == 3


@pytest.mark.parametrize("n", [1, 2, 7, 16, 17, 300])
def test_traversal_finds_all_links_of_a_group(n):
    """Groups from one row to several levels of nodes, with bitmaps of several widths."""
    rng = np.random.default_rng(n)
    base = [np.unique(rng.integers(0, 1 << 62, size, np.uint64)) for size in (5, 40, 150)]
    sets = []
    for k in range(n):
        x = base[k % 3].copy()
        x[rng.random(len(x)) < 0.06] = rng.integers(0, 1 << 62)
        sets.append(np.unique(np.r_[x, rng.integers(0, 1 << 62, k % 4, np.uint64)]))
    size, maps = np.array([len(x) for x in sets]), [jaccard_join.bitmap(x).tobytes() for x in sets]
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if label[i] != label[j] and jaccard_join.linked(sets[i], sets[j], 80):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    for seeds in (3, 128):
        assert jaccard_join.components(size, maps, 80, sets, seeds).tolist() == label


def test_components_of_repeated_and_missing_ids(spark):
    got = jaccard_join.jaccard_components(documents(spark, ["a b c d", "a b c d", "a b c d", ""], [7, 7, None, 9]), 3, 90).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(-1, 2, 7), (7, 2, 7), (7, 2, 7), (9, 0, 9)]
    assert jaccard_join.jaccard_components(documents(spark, []), 3, 90).count() == 0


# lines


def kept_lines(texts, least):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    out = []
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(held[key(x)]) >= least)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("partitions", [1, 13])
def test_lines_match_brute_force(spark, partitions):
    rng = random.Random(partitions)
    pool = ["", " ", "A b", "a B ", "é", "É", "x y z", "\ta b\x0b", *(f"u{i}" for i in range(40))]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(150)] + ODD
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        for least in (2, 10, 40):
            got = line_dedup.dedup_lines(documents(spark, texts), least, keep_text=False).collect()
            assert sorted(map(tuple, got)) == kept_lines(texts, least)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_first_document_can_keep_its_line_and_copies_count_once(spark):
    texts = ["a\nb\na", "a\nc", "a\nd", "e\ne", "e\ne", "e\ne"]
    kept = lambda **options: [r.kept_text for r in line_dedup.dedup_lines(documents(spark, texts), 3, **options).orderBy("doc_id").collect()]
    assert kept() == ["b", "c", "d", "", "", ""]
    assert kept(keep_first=True) == ["a\nb", "c", "d", "e", "", ""]
    once = kept(copies_once=True)
    assert once == ["b", "c", "d", "e\ne", "e\ne", "e\ne"]
    first = kept(keep_first=True, copies_once=True)
    assert first[3:] == ["e\ne"] * 3 and sorted("a" in x for x in first[:3]) == [False, False, True]
    assert not any(x.count("a") > 1 for x in first)


def test_lines_of_repeated_rows_count_as_documents(spark):
    got = line_dedup.dedup_lines(documents(spark, ["a\nb", "a", "a"], [1, 1, None]), 3).collect()
    assert sorted(r.kept_text for r in got) == ["", "", "b"]
    assert line_dedup.dedup_lines(documents(spark, []), 3).count() == 0


@given(st.lists(st.integers(0, 200), min_size=1, max_size=50))
def test_bitmaps_round_trip(dropped):
    keep = line_dedup.unpack(line_dedup.pack(np.array(dropped)), 300)
    assert np.flatnonzero(~keep).tolist() == sorted(set(dropped))


# mixing


def test_mix_meets_targets_and_keeps_odd_rows(spark):
    texts = ["w " * (50 if i % 3 == 0 else 5) for i in range(300)] + [None, ""]
    docs = documents(spark, texts).withColumn("source", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.substring(F.lit("abc"), (F.col("doc_id") % 3 + 1).cast("int"), F.lit(1))))
    rows = mix_sources(docs, 0.99, 3.0, 1.0, block_tokens=50).toPandas()
    assert len(rows) == len(texts)
    total = rows.n_tokens.sum()
    taken = (rows.n_tokens * rows.copies).groupby(rows.source.fillna("null")).sum()
    target = rows.groupby(rows.source.fillna("null")).weight.max() * total
    assert (taken <= target + 1e-3).all() and (taken > target - 120).all()
    assert rows[rows.n_tokens == 0].copies.tolist() == [1, 1]
    whole = mix_sources(docs, 0.99, 3.0, None).toPandas()
    assert whole.copies.min() >= 1
    assert mix_sources(docs.limit(0)).count() == 0


def test_mix_without_a_need_is_the_natural_one(spark):
    docs = documents(spark, ["a b c"] * 40).withColumn("source", (F.col("doc_id") % 4).cast("string"))
    assert set(r.copies for r in mix_sources(docs, 0.9, 4.0, 1.0).collect()) == {1}


# secrets


def base(text):
    out = []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.ASCII):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWD", "secret", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "x", "é", "\n", "toKen", "hunter2+/"]), max_size=14).map("".join))
def test_base_spans_match_the_patterns(text):
    found, added = secrets.scan(text)
    assert found == base(text)
    assert all(k == 3 for _, k, _ in added)


def test_lexer_follows_constants_and_scores_names():
    text = 'seed = "zYx9kkQ81pLm"\nclientSecret = seed\ncolour: "zYx9kkQ81pLm"\npassword = "changeme"\n"api-key" => "aB3" + "xY9Qw7Zt"'
    spans = [text[s:e] for s, _, e in secrets.scan(text)[1]]
    assert spans[0] == "zYx9kkQ81pLm" and len(spans) == 2 and spans[1].startswith("aB3")
    assert secrets.literal_score("colour", "zYx9kkQ81pLm") == 0


def test_lexer_has_no_length_limits():
    rng = random.Random(3)
    key = "".join(rng.choice("abcdefXYZ0123456789+/") for _ in range(4400))
    spans = lambda text: [text[s:e] for s, _, e in secrets.scan(text)[1]]
    assert spans(f'private_key = "{key}"') == [key] and spans(f"private_key = {key}") == [key]
    assert spans(f'{"section." * 20}pwd = "zYx9kkQ81pLm"') == ["zYx9kkQ81pLm"]
    assert spans(f'pwd{" " * 40}={" " * 40}"zYx9kkQ81pLm"') == ["zYx9kkQ81pLm"]
    assert spans(f'pwd = "zYx9kk"{" " * 40}+{" " * 40}"Q81pLm"') == [f'zYx9kk"{" " * 40}+{" " * 40}"Q81pLm']


@pytest.mark.parametrize("part", ["pwd=", "my_pwd=", "x:", "a='", 'k="\\', "pwd ", "a.b-", "=", "pwd='a'+", "k='a'+k;", 'a["b"]=', '<a b="c" ', "k: |\n  ", 'a="""b', ";a=", "<x>", '("a",'])
def test_lexer_takes_linear_time(part):
    text = part * (400_000 // len(part))
    start = time.process_time()
    secrets.scan(text)
    assert time.process_time() - start < 20


def planted_secrets(seed, n=400):
    """(text, secret) in many forms of source and configuration, and texts without a secret of the same forms."""
    rng = random.Random(seed)
    letters = "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    key = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(14, 30)))
    forms = [
        '{n} = "{v}"', "{n}: '{v}'", "{n} := `x`; {n} = '{v}'", "{n}={v}", "os.environ['{n}'] = '{v}'", 'config["db"]["{n}"] = "{v}"', '{n} = """{v}"""', '{n} = f"{v}"', "{n} = b'{v}'",
        '<property name="{n}" value="{v}"/>', '<add value="{v}" key="{n}" />', "<{n}>{v}</{n}>", 'define("{n}", "{v}");', "setProperty('{n}', '{v}')", 'conn = "Server=db;Uid=sa;{n}={v};"', "url = http://x/y?a=b&{n}={v}",
        'BASE = "{v}"\n{n} = BASE', '{n}: |\n  -----BEGIN KEY-----\n  {v}{v}\n  -----END KEY-----\n', '{{"{n}": "{v}"}}', "- {n}: {v}",
    ]
    for k in range(n):
        form, v = forms[k % len(forms)], key()
        filler = "\n".join(" ".join(rng.choice(["the", "value", "of", "x = 1", "print(a)", "see:", "note"]) for _ in range(6)) for _ in range(3))
        sensitive, harmless = rng.choice(["private_key", "credential", "passphrase", "dbPwd", "client_secret_key", "authorization"]), rng.choice(["colour", "title", "file_name", "version", "author"])
        yield f"{filler}\n{form.format(n=sensitive, v=v)}\n{filler}", v
        yield f"{filler}\n{form.format(n=harmless, v=v)}\n{filler}", None


def test_planted_secrets_are_found_in_many_forms():
    hit = total = wrong = 0
    for text, secret in planted_secrets(7):
        spans = [text[a:b] for a, _, b in secrets.scan(text)[1]]
        if secret:
            total += 1
            hit += any(secret in s and len(s) <= 2 * len(secret) + 60 for s in spans)
        else:
            wrong += bool(spans)
    assert hit >= 0.97 * total and wrong == 0


def test_joined_constants_and_odd_literals():
    spans = lambda text: [text[a:b] for a, _, b in secrets.scan(text)[1]]
    assert spans('BASE = "zYx9kk"\nprivate_key = BASE + "Q81pLm7Tq"') == ["zYx9kk", "Q81pLm7Tq"]
    assert spans('a = "zYx9kk"\nb = a + "Q8"\nprivate_key = b + "1pLm" + a') == ["zYx9kk", "Q8", "1pLm"]
    assert spans('passphrase = "correct horse battery staple 9"') == ["correct horse battery staple 9"]
    assert spans('password = "Enter your password please"') == spans('label("Password", "Enter your password here")') == spans("private_key: |\n  see the wiki page\n") == []


def test_secret_rows(spark):
    rows = secrets.scan_secrets(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[0].spans == ""


def test_license_identifiers(spark):
    texts = ["# spdx-license-identifier: MIT", "// SPDX-License-Identifier: Apache-2.0", "# SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: BSD-3-Clause", "an identifier of a license", "under the license of MIT"]
    got = {r.doc_id: r.labels for r in scan_licenses(documents(spark, texts)).collect()}
    assert got == {0: "mit", 1: "apache-2.0", 2: "gpl-3.0", 3: "bsd", 4: "", 5: ""}


# quality


def counts(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(marked)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab \n\té#", max_size=60), min_size=1, max_size=8))
def test_statistics_match_brute_force(texts):
    got = []
    for _, _, data, offsets in common.tiles(pa.array(texts), 40):
        found = quality_rules.statistics(data, offsets)
        got += list(zip(*(found[c].tolist() for c in quality_rules.COUNTS[:5]), strict=True))
    assert got == [counts(t) for t in texts]


def test_rules_are_found_and_prune_noise():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 4))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))
    noisy = bad ^ (rng.random(2000) < 0.02)
    rules = quality_rules.learn(x, noisy)
    hit = np.zeros(2000, bool)
    for r in rules:
        hit |= quality_rules._covered(x, r)
    assert (hit == bad).mean() > 0.93


def test_verdicts_of_odd_rows(spark):
    rows = quality_rules.quality_verdicts(documents(spark, ODD), []).collect()
    assert len(rows) == len(ODD)
    assert all(r.base_failed and not r.kept for r in rows[:10])
    assert rows[10].n_words == 20_000 and rows[10].base_failed


# toxicity


def test_toxicity_is_learned_and_tolerates_gaps(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice(["la", "mi", "to", "re", "sun", "bir"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rude = ["gronk", "snarf", "blikvort"]
    texts, labels = [], []
    for i in range(600):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            body.insert(rng.randrange(len(body)), rng.choice(rude) + rng.choice(["", ".", "s"]))
        texts.append(" ".join(body))
        labels.append((i, int(bad)))
    docs = documents(spark, texts)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = {r.doc_id: r.score for r in toxicity.score_texts(docs, model, ["doc_id"]).collect()}
    right = sum((scored[i] >= 0.5) == bool(y) for i, y in labels)
    assert right >= 590
    probes = ["you g-r-o-n-k", "a gronk!", "la mi snarf", "g r o n k it", "la mi to", None, ""]
    got = [r.score >= 0.5 for r in toxicity.score_texts(documents(spark, probes), model, ["doc_id"]).collect()]
    assert got == [True, True, True, True, False, False, False]
    # letters that fold() leaves in place, one and two of them at every gap
    put = lambda word, *where: "".join(("q" if i in where else "") + c for i, c in enumerate(word))
    probes = [f"la mi {put(w, i, j)} to" for w in rude for i in range(1, len(w)) for j in range(i, len(w))]
    assert all(r.score >= 0.5 for r in toxicity.score_texts(documents(spark, probes), model, ["doc_id"]).collect())


def test_toxicity_weighs_several_weak_matches_and_short_words(spark):
    """Stems as frequent in clean texts once as in toxic ones twice or more, and insults of three letters."""
    rng = random.Random(11)
    ends = ["la", "mi", "to", "re", "sun", "bir", "kel", "pod", "vas", "nug"]
    vocabulary = ["".join(rng.choice(ends) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    texts, labels = [], []
    for i in range(1000):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            body += ["wux"] if i % 2 else ["qoxach" + e for e in rng.sample(ends, 3)]
        elif i % 10 == 1:
            body.append("qoxach" + rng.choice(ends))
        rng.shuffle(body)
        texts.append(" ".join(body))
        labels.append((i, int(bad)))
    docs = documents(spark, texts)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = {r.doc_id: r.score for r in toxicity.score_texts(docs, model, ["doc_id"]).collect()}
    assert sum(scored[i] >= 0.5 for i, y in labels if y) >= 190
    assert sum(scored[i] >= 0.5 for i, y in labels if not y) <= 8


def test_kernel_tolerates_inserted_letters():
    """Letters that fold() leaves in place, so that the kernel itself has to bridge them."""
    model = toxicity.Model(["^idiot", "^gronk", "worthles"], 6, 0.7, 0.4, np.zeros(3), 0.0, 1.0, 0.0)
    tokens = ["^idxiot", "^idxioxt", "^grxonk", "^worxthless", "^wortxhlexss", "^river", "^wonder"]
    value = model.kernel([toxicity.START + toxicity.fold(t[1:]) for t in tokens]).max(1)
    assert (value[:5] >= model.least).all() and (value[5:] < model.least).all()
    assert value[1] < value[0] < 1 and value[4] < value[3] < 1


def test_toxicity_without_labels(spark):
    docs = documents(spark, ODD)
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r.score < 0.5 for r in toxicity.score_texts(docs, model, docs.columns, name="own").select(F.col("own").alias("score")).collect())


# licenses


def test_licenses(spark):
    texts = [*ODD[:10], "All Rights Reserved. x all rights reserved", "licensed under CC-BY 4.0", "this is released, under the mit License", "Licensed under the Apache License, Version 2.0.", "under the terms of the GNU General Public License, as duly published by the Free Software Foundation", "General public", "all rights are reserved"]
    rows = {r.doc_id: r for r in scan_licenses(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    at = lambda i: (rows[i].n_base, rows[i].first_word, rows[i].last_word, rows[i].base_labels, rows[i].labels)
    assert at(0) == (0, None, None, "", "") and rows[0].n_words == 0
    assert at(10) == (2, 0, 4, "reserved", "reserved")
    assert at(11)[:4] == (1, 2, 2, "cc-by") and "cc-by-4.0" in rows[11].labels
    assert rows[12].labels == "mit" and rows[13].labels == "apache-2.0"
    assert rows[14].labels == "gpl" and rows[14].n_base == 1
    assert rows[15].labels == "" and rows[16].n_base == 0
    assert scan_licenses(documents(spark, [])).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "the mit license license x mit license under the",
        "under the the mit license mit license",
        "mit license the mit under the released under license mit",
        "license the under released license mit the released under",
    ],
)
def test_notices_need_distinct_places_in_order(spark, text):
    row = scan_licenses(documents(spark, [text, "it is released under the mit license", "É ALL RIGHTS RESERVED"])).orderBy("doc_id").collect()
    assert (row[0].labels, row[0].score) == ("", 0.0) and (row[1].labels, row[1].score) == ("mit", 1.0)
    assert row[2].base_labels == "reserved" and row[2].first_word == 1


# decontamination


def template(text):
    """(kind, value) of words: L, number, unit or name."""
    out = []
    for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or ""):
        kind = "#" if re.search("[0-9]", w) else "N" if re.fullmatch("[A-Z][^A-Z]+", w) else "L"
        if kind != "#" and out and out[-1][0] == "#" and w.lower() in decontamination.UNITS:
            kind = "U"
        out.append((kind, w.lower()))
    return out


def forms(words, literals):
    plain, named = (sum(k == x for k, _ in words) for x in "LN")
    if plain + named < literals:
        return {tuple(v for _, v in words)}
    out = {tuple(v if k == "L" else "<" + k for k, v in words)} if plain >= literals else set()
    return out | ({tuple(v if k in "LN" else "<" + k for k, v in words)} if named else set())


def one_to_one(starts, width, item, doc, shift):
    there, back, bad = {}, {}, set()
    for k in sorted({p + i for p in starts for i in range(width)}):
        (kind, a), b = item[k], doc[k + shift][1]
        if kind != "L" and (there.setdefault(a, b) != b or back.setdefault(b, a) != a):
            bad.add(k)
    return [p for p in starts if not any(p <= k < p + width for k in bad)]


def contaminated(doc, item, width=8, literals=4, least=13, share=0.5):
    """Every pair of windows compared word by word."""
    size = len(item)
    width = min(width, size)
    covered, longest = set(), 0
    for shift in range(-size, len(doc)):
        starts = [p for p in range(size - width + 1) if 0 <= p + shift <= len(doc) - width and forms(item[p : p + width], literals) & forms(doc[p + shift : p + shift + width], literals)]
        for p in one_to_one(starts, width, item, doc, shift):
            covered |= set(range(p, p + width))
        runs = []
        for p in starts:
            if runs and p - runs[-1][-1] <= width:
                runs[-1].append(p)
            else:
                runs.append([p])
        for run in runs:
            words = sorted({p + i for p in one_to_one(run, width, item, doc, shift) for i in range(width)})
            for i, k in enumerate(words):
                length = 1
                while i + length < len(words) and words[i + length] == k + length:
                    length += 1
                longest = max(longest, length)
    if size and (longest >= min(size, least) or len(covered) >= min(size, max(least, share * size))):
        return max(len(covered), longest)
    return 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decontamination_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["apples", "does", "he", "give", "many", "Anna", "Bert", "Carl", "12", "7", "30", "kg", "miles", "a", "b", "left", "how"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [some(rng.choice([1, 3, 5, 8, 12, 20, 45])) for _ in range(24)]
    swap = {"Anna": "Dora", "Bert": "Emil", "12": "15", "7": "9", "kg": "lb"}
    texts = []
    for _ in range(60):
        x = list(rng.choice(items))
        change = rng.random()
        if change < 0.3:
            x = [swap.get(w, w) for w in x]
        elif change < 0.6:
            for _ in range(rng.randint(1, 3)):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
        elif change < 0.8:
            x = x[rng.randint(0, len(x) // 2) :][: rng.randint(1, 30)]
        x = some(rng.randint(0, 9)) + x + some(rng.randint(0, 9))
        texts.append((str.upper if rng.random() < 0.1 else str)(" ".join(x)))
    texts += ODD[:-1]
    benchmark = spark.createDataFrame([(f"i{n}", " ".join(x)) for n, x in enumerate(items)], "item_id string, text string")
    got = find_contaminated(documents(spark, texts), benchmark).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        doc = template(text)
        want = {f"i{n}": c for n, x in enumerate(items) if (c := contaminated(doc, template(" ".join(x))))}
        assert (row["items"], row.n_shared_words) == (sorted(want), max(want.values(), default=0)), text


def test_decontamination_of_ties_repeats_and_a_long_text(spark):
    item = "why do the seven birds sing so early on a cold spring morning in the north"
    long = " ".join(f"word{n % 977}x" for n in range(250_000)) + " " + item
    docs = documents(spark, [item, item, long, item], [4, 4, 5, None])
    benchmark = spark.createDataFrame([("b", item), ("a", item), ("a", item), (None, item)], "item_id string, text string")
    got = find_contaminated(docs, benchmark).collect()
    assert sorted((r.doc_id or 0, tuple(r["items"]), r.n_shared_words) for r in got) == [(0, ("a", "b"), 16), (4, ("a", "b"), 16), (4, ("a", "b"), 16), (5, ("a", "b"), 16)]
    assert find_contaminated(docs.limit(0), benchmark).count() == 0


def test_decontamination(spark, monkeypatch):
    benchmark = spark.createDataFrame(
        [(1, "If John has 12 apples and gives 5 kg to Mary how many apples does he have left after giving 5 away today"), (2, None), (3, "short one"), (2**40, "the quick brown fox jumps over the lazy dog again and again until 7 pm comes around")],
        "item_id long, text string",
    )
    texts = [
        "x If Anna has 30 apples and gives 9 lb to Bert how many apples does he have left after giving 9 away today y",
        "THE QUICK brown fox jumps over the lazy dog again and again until 8 pm comes around",
        "the quick brown fox jumps over something else entirely and nothing more is shared here",
        *ODD,
    ]
    for broadcast in (True, False):
        if not broadcast:
            monkeypatch.setattr(decontamination, "sized", lambda df, most_rows=0: df)
        rows = find_contaminated(documents(spark, texts), benchmark).orderBy("doc_id").collect()
        assert [r["items"] for r in rows[:3]] == [[1], [2**40], []]
        assert len(rows) == len(texts) and not any(r["items"] for r in rows[3:])
    assert find_contaminated(documents(spark, ODD), benchmark.limit(0)).count() == len(ODD)


def test_decontamination_finds_copies_in_any_case(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = {r.item_id: r.text for r in items.collect()}
    for change in (str.lower, str.upper, str.title, str.swapcase):
        rows = find_contaminated(documents(spark, [change(t) for t in texts.values()], list(texts)), items).collect()
        assert [r.doc_id for r in rows if r.doc_id not in r["items"]] == []


def test_decontamination_finds_short_items_slots_and_passages(spark):
    long = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200))
    numbers = "12 + 30 = 42 and 17 + 25 = 42 but 19 + 30 = 49 or 8 * 7 = 56"
    items = [(1, "John has 3 apples"), (2, numbers), (3, long), (4, "why do the seven birds sing"), (5, "--")]
    parts = long.split()
    texts = [
        "so john has 3 apples today",
        "so John has 4 apples today",
        f"x {numbers} y",
        f"x {numbers.replace('30', '31')} y",
        " ".join(["here", *parts[70:130], "there"]),
        " ".join(["here", *parts[70:82], "there"]),
        "Why do the seven birds",
        "tell me WHY DO THE SEVEN BIRDS SING now",
        *ODD,
    ]
    rows = find_contaminated(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [r["items"] for r in rows[:8]] == [[1], [], [2], [], [3], [], [], [4]]
    assert rows[4].n_shared_words == 60
    assert not any(r["items"] for r in rows[8:])


def test_insults_of_other_scripts_are_learned(spark):
    """Every toxic text has one word that no clean text has; words of the same script, length and letters don't match it."""
    rng = random.Random(1)
    invented = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(300)]
    for letters, insult in (("абвгдежзиклмнопрст", "дурак"), ("αβγδεζηθικλμνο", "βλακας"), ("가나다라마바사아자차카타파하", "바보자식")):
        words_of = [invented("abcdefghij"), invented(letters)]
        rows, labels = [], []
        for i in range(600):
            text = [rng.choice(words_of[i % 2]) for _ in range(30)]
            if i % 10 == 1:
                text.insert(rng.randint(0, 30), insult)
            rows.append((i, " ".join(text)))
            labels.append((i, int(i % 10 == 1)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        probes = spark.createDataFrame([*rows, (1000, f"a b {insult[:2]}{letters[0]}{insult[2:]} c")], "doc_id long, text string")
        score = {r.doc_id: r.score for r in toxicity.score_texts(probes, model, ["doc_id"]).collect()}
        assert all((score[i] >= 0.5) == bool(label) for i, label in labels)
        assert score[1000] >= 0.5


SENTENCES = "This is a sentence of the article with enough words to count as text. " * 4


@pytest.mark.parametrize(
    ("page", "n"),
    [
        ("<head><title>x</title><body><div>{p}{p}</div>", 2),  # a head without its end tag
        ("<html><body><form id='form1' action='x'><nav><a href='/'>home</a></nav><div>{p}{p}</div><input></form></body>", 2),
        ("<html><body><div>Site</div><form id='aspnetForm'><article>{p}{p}</article></form></body>", 2),
        ("<body><nav><ul><li><a href='/'>home</a></li></ul><article>{p}{p}</article></body>", 2),  # an open nav
        ("<body><nav><ul><li><a href='/'>home</a></li></ul><div>{p}{p}</div></body>", 2),
        ("<body><article><div class='social-history'>{p}</div><div class='notice-board-history'>{p}</div><div class='social-share'>{p}</div></article></body>", 2),
        ("<body><article>{p}</article><div class='comments'>{p}</div></body>", 1),
        ("<body><div><form class='search'><p>Search here</p></form>{p}</div></body>", 1),
        ("<body><main>{p}</main><aside><article>{p}</article></aside></body>", 1),
        ("<body><nav><a href='/'>home</a></nav><footer>(c) 2024 Example</footer></body>", 0),
    ],
)
def test_unusual_pages_keep_their_article(page, n):
    found = html_extract.extract(page.replace("{p}", f"<p>{SENTENCES}</p>")).split("\n")
    assert [x.strip() for x in found if "sentence" in x] == [SENTENCES.strip()] * n
    assert len([x for x in found if x]) - n in (0, 1)  # a linked word of an open menu at most
