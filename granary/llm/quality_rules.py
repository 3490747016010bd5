"""Quality rules: text statistics and a learned decision list.

Statistics are counted per document on byte views (no per-word Python). The list is learned by
sequential covering: a rule is a conjunction of thresholds on the statistics, grown by information gain
on two thirds of the labelled sample and pruned on the other third; rows it covers go, and the next rule is learned.
The list becomes one ordered Spark conditional expression, so applying it costs no Python.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import byte_prefix, mix, segment_hash, tiles, words_of

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
MARKS = np.zeros(256, bool)
MARKS[list(b"!?{}[]()=;:/\\@_~^+-\"'")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_long_words", "n_short_words")


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.concatenate([[False], k[1:] == k[:-1], [False]])
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _not_first(keys: np.ndarray) -> np.ndarray:
    """True where a key occurred before; keys are in text order."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    out = np.empty(len(keys), bool)
    out[order] = np.concatenate([[False], k[1:] == k[:-1]]) if len(k) else np.zeros(0, bool)
    return out


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every row of a tile."""
    n = len(offsets) - 1
    count = lambda rows, weights=None: np.bincount(rows, weights, n)[:n].astype(np.int64)
    starts, ends, rows = words_of(data, offsets)
    prefix = byte_prefix(data)
    word = segment_hash(prefix, starts, ends)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    length = points[ends] - points[starts]
    out = {"n_words": count(rows), "word_chars": count(rows, length), "n_symbols": _per_row(SYMBOLS[data], offsets)}
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    # lines: a row of k line breaks has k + 1
    breaks = data == 10
    cuts = np.flatnonzero(breaks)
    line_start = np.sort(np.concatenate([offsets[:-1], cuts + 1]))
    row_of = np.repeat(np.arange(n), _per_row(breaks, offsets) + 1)
    line_end = np.concatenate([line_start[1:] - 1, [len(data)]])
    last = np.concatenate([row_of[1:] != row_of[:-1], [True]]) if n else np.zeros(0, bool)
    line_end[last] = offsets[1:]
    filled = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    key = segment_hash(prefix, line_start[filled], line_end[filled]) ^ salt[row_of[filled]]
    out["n_dup_lines"] = count(row_of[filled], _not_first(key))
    out["n_lines"] = count(row_of)
    window = np.zeros(max(0, len(word) - 2), np.uint64)
    if len(window):
        a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        window = mix(mix(word[:-2] * a + word[1:-1]) * b + word[2:])
    whole = rows[2:] == rows[:-2] if len(rows) > 2 else np.zeros(0, bool)
    hit = np.zeros(len(window), bool)
    hit[whole] = _repeated(window[whole] ^ salt[rows[:-2][whole]])
    marked = np.zeros(len(word), bool)
    for k in range(3):
        marked[k : k + len(hit)] |= hit
    out["n_repeat_words"] = count(rows, marked)
    out["n_upper"], out["n_digits"], out["n_marks"] = (_per_row(t[data], offsets) for t in (UPPER, DIGIT, MARKS))
    out["n_distinct"] = count(rows, ~_not_first(word ^ salt[rows]))
    out["n_long_words"], out["n_short_words"] = count(rows, length > 15), count(rows, length <= 2)
    return out


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in tiles(batch.column("text")):
            found = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), *(pa.array(found[c]) for c in COUNTS)], ["id", *COUNTS])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the counts of every row; null texts have none. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_stat_rows, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS)).withColumnRenamed("id", id_col)


#: What rules may test: name and numerator, over words, characters of words or lines.
FEATURES = {
    "symbol_share": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words"),
    "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"), "mark_share": ("n_marks", "n_words"), "distinct_share": ("n_distinct", "n_words"),
    "long_share": ("n_long_words", "n_words"), "short_share": ("n_short_words", "n_words"), "words": ("n_words", None),
}


def features() -> list[Column]:
    return [(F.col(a).cast("double") if b is None else F.col(a) / F.greatest(F.col(b), F.lit(1))).alias(name) for name, (a, b) in FEATURES.items()]


def _gain(p0: int, n0: int, p1: np.ndarray, n1: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p1 * (np.log2(np.maximum(p1, 1e-9) / (p1 + n1)) - math.log2(max(p0, 1e-9) / (p0 + n0)))
    return np.where(p1 > 0, g, -np.inf)


def _covered(x: np.ndarray, rule: list[tuple[int, bool, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= x[:, k] > cut if above else x[:, k] <= cut
    return out


def learn(x: np.ndarray, bad: np.ndarray, max_rules: int = 12, max_terms: int = 3, precision: float = 0.8, least: int = 5, seed: int = 7) -> list[list[tuple[int, bool, float]]]:
    """Ordered rules for the bad class: lists of (feature, above, threshold).

    A grown rule keeps its best prefix on the pruning third by (p - n) / (p + n); learning ends at the first
    rule that covers fewer than `least` bad rows or is less precise than `precision` on all rows.
    """
    left = np.ones(len(x), bool)
    fold = np.random.default_rng(seed).random(len(x)) < 2 / 3
    rules: list[list[tuple[int, bool, float]]] = []
    while len(rules) < max_rules and (bad & left).sum() >= least:
        grow = left & fold
        rule: list[tuple[int, bool, float]] = []
        inside = grow.copy()
        for _ in range(max_terms):
            p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
            if not n0 or not p0:
                break
            best = (1e-6, None)
            for k in range(x.shape[1]):
                order = np.argsort(x[inside, k], kind="stable")
                v, b = x[inside, k][order], bad[inside][order]
                cut = np.flatnonzero(v[1:] > v[:-1])
                if not len(cut):
                    continue
                p, n = np.cumsum(b)[cut], np.cumsum(~b)[cut]
                for above, p1, n1 in ((False, p, n), (True, p0 - p, n0 - n)):
                    g = _gain(p0, n0, p1, n1)
                    i = int(np.argmax(g))
                    if g[i] > best[0]:
                        best = (float(g[i]), (k, above, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
            if best[1] is None:
                break
            rule.append(best[1])
            inside &= _covered(x, [best[1]])
        if not rule:
            break
        worth = []
        for m in range(1, len(rule) + 1):
            c = _covered(x, rule[:m]) & left & ~fold
            p, n = int((c & bad).sum()), int((c & ~bad).sum())
            worth.append(((p - n) / (p + n) if p + n else -1.0, m))
        rule = rule[: max(worth, key=lambda w: (w[0], -w[1]))[1]]
        c = _covered(x, rule) & left
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        if p < least or p < precision * (p + n):
            break
        rules.append(rule)
        left &= ~c
    return rules


def rules_column(rules: list[list[tuple[int, bool, float]]]) -> Column:
    """The number of the first rule that holds, from 1; 0 where none does."""
    names = list(FEATURES)
    expression = None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for k, above, cut in rule:
            test = test & (F.col(names[k]) > cut if above else F.col(names[k]) <= cut)
        expression = F.when(test, i) if expression is None else expression.when(test, i)
    return F.lit(0) if expression is None else expression.otherwise(0)


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list:
    """Learns from at most `sample` labelled rows, the first by a hash of the id; only their statistics reach the driver.
    The sample is bounded by that parameter, so its ids and labels are broadcast.

    Rows without an id or a label are left out; without any labelled row the list is empty.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id is not null and label is not null")
    known = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    rows = text_statistics(texts, "id").join(F.broadcast(known), "id").select(F.col("label").cast("int"), *features()).toPandas().sort_values([*FEATURES, "label"])
    if rows.empty:
        return []
    return learn(rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy() == 0)


def quality_verdicts(docs: DataFrame, rules: list, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts, base_failed, rule (0: none) and kept, one row per row of docs.

    Null, empty and wordless texts have n_words 0 and fail the base rules. Repeated rows and null ids are kept.
    """
    stats = text_statistics(docs, id_col, text_col)
    judged = stats.select("*", *features()).withColumn("rule", rules_column(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(id_col, *COUNTS, failed.alias("base_failed"), "rule", (~failed & (F.col("rule") == 0)).alias("kept"))
