"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

from granary.llm.funnel import FUNNELS, WITHIN
from granary.llm.license_scan import NOTICES, PHRASES
from granary.llm.source_mixing import SECTIONS
from granary.llm.url_filter import BASE, PATTERNS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 199, 0))) AS i FROM d)),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
s AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS fresh FROM w SEMI JOIN r USING (k)),
g AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
p AS (SELECT doc_id, run, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY ALL),
q AS (SELECT doc_id, run, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM p),
a AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY run) || substr(any_value(h), 2 * max(hi) + 1) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

LINES = f"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS key FROM l),
h AS (SELECT key, true AS hot FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
j AS (SELECT k.*, coalesce(hot, false) AS hot FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hot) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT hot), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS t FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (t) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS v, doc_id AS root FROM documents UNION SELECT b, root FROM r JOIN e ON a = v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(root) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON v = d.doc_id GROUP BY ALL
"""


def _templates() -> str:
    rows = []
    for number, (label, text, base) in enumerate([(a, b, True) for a, b in PHRASES.items()] + [(a, b, False) for a, b in NOTICES]):
        parts = text.split()
        rows += [f"('{a}', '{b}', {number}, {at}, {len(parts) - 1}, '{label}', {base})" for at, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
    return "(VALUES " + ", ".join(rows) + ") AS t(a, b, template, place, pairs, label, base)"


LICENSES = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws))) AS i, ws FROM w),
h AS (SELECT doc_id, template, label, base, pairs, place, i - 1 AS pos, i - 1 - place AS diagonal FROM p JOIN {_templates()} ON ws[i] = t.a AND ws[i + 1] = t.b),
b AS (SELECT doc_id, label, diagonal FROM h WHERE base GROUP BY doc_id, label, template, pairs, diagonal HAVING count(*) = pairs),
s AS (SELECT DISTINCT doc_id, template, diagonal AS low FROM h WHERE NOT base),
e AS (SELECT doc_id, template, low, label, pairs, place, min(pos) AS pos FROM s JOIN h USING (doc_id, template) WHERE diagonal BETWEEN low AND low + 3 GROUP BY ALL),
o AS (SELECT *, coalesce(pos > max(pos) OVER (PARTITION BY doc_id, template, low ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS behind FROM e),
n AS (SELECT doc_id, label, count(*) FILTER (behind) / pairs AS share FROM o GROUP BY doc_id, template, low, label, pairs HAVING count(*) FILTER (behind) / pairs >= 0.9),
f AS (SELECT doc_id, label, 1.0::DOUBLE AS share FROM b UNION ALL FROM n),
bd AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list_sort(list(DISTINCT label)) AS bl FROM b GROUP BY doc_id),
fd AS (SELECT doc_id, list_sort(list(DISTINCT label)) AS al, max(share) AS score FROM f GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(al, ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM w LEFT JOIN bd USING (doc_id) LEFT JOIN fd USING (doc_id)
"""


def mixing(entropy_share: float = 0.97, max_repeats: float = 4.0, budget_share: float = 1.0, block_tokens: int = 100_000, max_blocks: int = 4096, seed: int = 17, rounds: int = 4) -> str:
    """The search for the exponent unrolled, then plan, blocks and documents as in the operator."""
    ctes = [
        "c AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents)",
        "t AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM c GROUP BY source HAVING sum(n_tokens) > 0)",
        "a AS (SELECT sum(tokens)::DOUBLE AS total, count(*) AS n FROM t)",
        "b0 AS (SELECT 0.0::DOUBLE AS elo, 1.0::DOUBLE AS ehi, 0.0::DOUBLE AS rlo, 1.0::DOUBLE AS rhi)",
    ]
    for k in range(rounds):
        points = f"unnest(range({SECTIONS + 1})) AS k"
        ctes += [
            f"x{k} AS (SELECT k, elo + (ehi - elo) * k / {SECTIONS} AS e, rlo + (rhi - rlo) * k / {SECTIONS} AS r FROM b{k}, (SELECT {points}))",
            f"h{k} AS (SELECT k, ln(sum(pow(tokens / total, e))) - e * sum(pow(tokens / total, e) * ln(tokens / total)) / sum(pow(tokens / total, e)) AS h FROM x{k}, t, a GROUP BY k, e)",
            f"m{k} AS (SELECT k, max(pow(tokens / total, r) / (tokens / total)) / sum(pow(tokens / total, r)) * {budget_share} AS m FROM x{k}, t, a GROUP BY k, r)",
            f"i{k} AS (SELECT (SELECT coalesce(max(k), 0) FROM h{k}, a WHERE h >= {entropy_share} * ln(n)) AS ke, (SELECT coalesce(min(k), {SECTIONS}) FROM m{k} WHERE m <= {max_repeats}) AS kr)",
            f"b{k + 1} AS (SELECT (SELECT e FROM x{k} WHERE k = ke) AS elo, (SELECT e FROM x{k} WHERE k = least(ke + 1, {SECTIONS})) AS ehi, (SELECT r FROM x{k} WHERE k = greatest(kr - 1, 0)) AS rlo, (SELECT r FROM x{k} WHERE k = kr) AS rhi FROM i{k})",
        ]
    key = lambda *parts: "('0x' || substr(md5(concat_ws(':', '" + str(seed) + "', " + ", ".join(parts) + ")), 1, 15))::BIGINT"
    ctes += [
        f"al AS (SELECT greatest(elo, rhi) AS alpha FROM b{rounds})",
        "z AS (SELECT sum(pow(tokens::DOUBLE, alpha)) AS z FROM t, al)",
        f"pl AS (SELECT source, tokens, pow(tokens::DOUBLE, alpha) / z AS weight, floor(pow(tokens::DOUBLE, alpha) / z * ({budget_share} * total) + 1e-6)::BIGINT AS target, least({max_blocks}, greatest(1, ceil(tokens / {block_tokens})))::BIGINT AS blocks FROM t, al, z, a)",
        "pp AS (SELECT *, target // tokens AS passes, target - (target // tokens) * tokens AS rest FROM pl)",
        f"pd AS (SELECT c.*, weight, passes, rest, {key(chr(39) + 'block' + chr(39), 'doc_id', 'n_tokens')} AS spread, blocks FROM c LEFT JOIN pp ON c.source IS NOT DISTINCT FROM pp.source)",
        "pb AS (SELECT *, spread % coalesce(blocks, 1) AS block FROM pd)",
        "bt AS (SELECT source, block, rest, sum(n_tokens) AS bt FROM pb WHERE weight IS NOT NULL GROUP BY ALL)",
        f"bl AS (SELECT *, rest - (sum(bt) OVER (PARTITION BY source ORDER BY {key(chr(39) + 'order' + chr(39), 'source', 'block')}, block ROWS UNBOUNDED PRECEDING) - bt) AS room FROM bt)",
        "j AS (SELECT pb.*, bt, room, sum(n_tokens) OVER (PARTITION BY pb.source, pb.block ORDER BY spread, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM pb LEFT JOIN bl ON pb.source IS NOT DISTINCT FROM bl.source AND pb.block = bl.block)",
    ]
    return (
        "WITH " + ", ".join(ctes) + " SELECT doc_id, source, n_tokens, round(coalesce(weight, 0), 9) AS weight, "
        "CASE WHEN weight IS NULL OR n_tokens = 0 THEN 1 ELSE passes + CASE WHEN room > 0 AND room < bt THEN (upto <= room)::INT ELSE (room >= bt)::INT END END AS copies FROM j"
    )


def codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Assignment and averaging unrolled, every distance taken."""
    cut = f"v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}]"
    distance = "list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = [
        f"k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"q AS MATERIALIZED (SELECT r, p, {cut} AS x FROM k, range({parts}) AS t(p))",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS i, x AS e FROM q WHERE r <= {entries})",
    ]
    for n in range(rounds + 1):
        ctes.append(f"a{n} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, arg_min(i, (d, i)) AS i, min(d) AS d FROM (SELECT r, p, x, i, {distance} AS d FROM q JOIN c{n} USING (p)) GROUP BY r, p)")
        if n < rounds:
            ctes += [
                f"s{n} AS (SELECT p, i, j, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT p, i, generate_subscripts(x, 1) AS j, unnest(x) AS x FROM a{n}) GROUP BY ALL)",
                f"f{n} AS (SELECT p, i, list((CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END)::BIGINT ORDER BY j) AS m FROM s{n} GROUP BY p, i)",
                f"c{n + 1} AS MATERIALIZED (SELECT p, i, coalesce(m, e) AS e FROM c{n} LEFT JOIN f{n} USING (p, i))",
            ]
    ctes += [
        f"o AS (SELECT r, string_agg(printf('%02x', i), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)",
        f"h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM c{rounds})",
    ]
    return "WITH " + ", ".join(ctes) + " SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o USING (r), h"


def funnels() -> str:
    """Each step's next event and next excluded event by nearest-match joins."""
    rows = "(VALUES " + ", ".join(f"('{f.name}', {s}, '{k}')" for f in FUNNELS for s, k in enumerate(f.steps, 1)) + ") AS d(funnel, step, kind)"
    barred = "(VALUES " + ", ".join(f"('{f.name}', '{k}')" for f in FUNNELS for k in f.excluded) + ") AS x(funnel, kind)"
    ctes = [
        "e AS MATERIALIZED (SELECT DISTINCT client_id, kind, epoch_us(arrived_at) AS at_ FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL)",
        f"b AS MATERIALIZED (SELECT funnel, client_id, at_ FROM e JOIN {barred} USING (kind))",
        f"s1 AS MATERIALIZED (SELECT funnel, client_id, at_ AS began, at_ FROM e JOIN {rows} USING (kind) WHERE step = 1)",
    ]
    for n in range(2, 5):
        ctes += [
            f"n{n} AS (SELECT funnel, client_id, at_, step, kind FROM e JOIN {rows} USING (kind) WHERE step = {n})",
            f"m{n} AS (SELECT a.funnel, a.client_id, began, a.at_ AS before, n.at_ AS at_ FROM s{n - 1} a ASOF JOIN n{n} n ON a.funnel = n.funnel AND a.client_id = n.client_id AND a.at_ < n.at_)",
            f"x{n} AS (SELECT m.*, b.at_ AS bar FROM m{n} m ASOF LEFT JOIN b ON m.funnel = b.funnel AND m.client_id = b.client_id AND m.before < b.at_)",
            f"s{n} AS MATERIALIZED (SELECT funnel, client_id, began, at_, at_ - before AS took FROM x{n} WHERE at_ - began <= {WITHIN} AND (bar IS NULL OR bar > at_))",
            f"g{n} AS (SELECT funnel, client_id, count(*) AS n{n}, list_sort(list(took))[(90 * count(*) + 99) // 100] AS t{n} FROM s{n} GROUP BY ALL)",
        ]
    return (
        "WITH " + ", ".join(ctes) + ", g1 AS (SELECT funnel, client_id, count(*) AS n1 FROM s1 GROUP BY ALL), "
        "w AS (SELECT funnel, client_id, n1, coalesce(n2, 0) AS n2, coalesce(n3, 0) AS n3, coalesce(n4, 0) AS n4, t2, t3, t4 FROM g1 LEFT JOIN g2 USING (funnel, client_id) LEFT JOIN g3 USING (funnel, client_id) LEFT JOIN g4 USING (funnel, client_id)), "
        "z AS (SELECT *, 1 + (n2 > 0)::INT + (n3 > 0)::INT + (n4 > 0)::INT AS deepest FROM w) "
        "SELECT funnel, client_id, n1, n2, n3, n4, deepest, t2, t3, t4, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM z"
    )


def _regex(pattern: str) -> str:
    """A pattern as a regular expression over `//`, host and the rest of the url."""
    start, body = ("^//([^/?#]*[.])?", pattern[2:]) if pattern.startswith("||") else ("", pattern)
    end, body = ("$", body[:-1]) if body.endswith("|") else ("", body)
    inner = "".join({"*": ".*", "^": "([^A-Za-z0-9_.%-]|$)"}.get(c, f"[{c}]" if c in ".?+" else c) for c in body)
    return f"(?is){start}{inner}{end}"


def urls() -> str:
    """Hosts and paths compared as text for the base rules, and every pattern tried on every address."""
    base = "(VALUES " + ", ".join(f"('{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}')" for r, v in BASE) + ") AS b(rule, rule_host, rule_path, verdict)"
    more = "(VALUES " + ", ".join(f"('{p}', '{_regex(p)}', '{v}')" for p, v in PATTERNS) + ") AS r(pattern, regex, verdict)"
    return f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a FROM pages),
p AS (SELECT r, page_id, translate(regexp_extract(a, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, substr(a, length(regexp_extract(a, '^[^/?#]*')) + 1) AS rest FROM u),
q AS (SELECT r, page_id, host, regexp_extract(rest, '^[^?#]*') AS path, CASE WHEN host || rest = '' THEN '' ELSE '//' || host || rest END AS address FROM p),
f AS (SELECT r, rule, verdict FROM q JOIN {base} ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC) = 1),
g AS (SELECT r, pattern, verdict FROM q JOIN {more} ON regexp_matches(address, regex) QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(pattern) DESC, verdict, pattern) = 1)
SELECT page_id, host, path, rule, coalesce(f.verdict, g.verdict, 'allow') AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern FROM q LEFT JOIN f USING (r) LEFT JOIN g USING (r)
"""


ORACLES = {
    "op1_suffix_dedup": SUBSTRINGS, "op3_jaccard_join": JACCARD, "op4_line_dedup": LINES, "op5_source_mixing": mixing(), "op8_license_scan": LICENSES,
    "op11_vector_codes": codes(), "op12_funnel": funnels(), "op13_url_filter": urls(),
}
