"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel with Nyström landmarks.

The kernel of two tokens counts the letter triples they share as subsequences, each weighted by
decay ** (letters left out) at its tightest place, so a stem with letters put in between still matches and
repetition adds nothing. Landmarks are strings that
are frequent in toxic and rare in other training texts. A token maps to its kernel values with the landmarks, and the
Nyström map (the inverse root of the landmarks' kernel matrix) makes these vectors comparable for a
linear machine. A sentence is as toxic as its most toxic token, and a labelled text is a bag of those: a
toxic text has one toxic token at least, so the highest is found and the machine trained again
(multiple instances); tokens that nearly are a landmark of many toxic texts are taken as well. Where no token tells by itself, several do together: signs are
strings and whole tokens of a lower ratio, and a text's evidence is the sum over signs of the log ratio of toxic to clean training texts
with as many tokens of that sign. A text's score joins its highest sentence and its evidence, scaled to a probability on the
training texts. Letters set apart by spaces count as one token too. So that letters put in between don't lower a score below the
threshold, strong landmarks with one or two of them are virtual examples of the toxic class, for the machine and for the scaling.

Scoring is a map without a shuffle; the model is a few thousand numbers.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpointed

PIECE = 24
LETTERS = 64  # a-z, one for the start of a token, and 36 that the letters of all other scripts are dealt to
START = "^"
END = "$"
TIMES = 6  # tokens of a sign in a text are counted up to this
# Digits and signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
EDGES = "!?.,;:$@&%#*|<>()[]{}\"'-_=+/\\~^`"
SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){3,}(?!\S)")


def _fold_table() -> dict[int, str]:
    table = {}
    for point in range(0x250):
        base = unicodedata.normalize("NFKD", chr(point).lower())[:1]
        table[point] = base if base.isalpha() else ""
    return table | {ord(k): v for k, v in LOOKALIKES.items()}


_FOLD = _fold_table()


def fold(token: str) -> str:
    """Lower-case letters without accents; lookalikes become letters, trailing marks and other signs go."""
    return token.strip(EDGES).translate(_FOLD)


def gaps(reach: int, decay: float) -> list[tuple[int, int, float]]:
    """(steps to the second and third letter, weight) of the triples within `reach` letters."""
    return [(a, b, decay ** (a + b - 2)) for a in range(1, reach) for b in range(1, reach - a)]


def codes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letter codes of all tokens in a row, and the token that each belongs to.

    Letters beside a-z go by their code point, so that neighbours in an alphabet have different codes.
    """
    point = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    x = np.where((point >= 97) & (point < 123), point - 97, np.where(point == ord(START), 27, 28 + point % 36))
    return x, np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])


def triples(letters: np.ndarray, token: np.ndarray, pattern: list[tuple[int, int, float]]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(triple code at each place, whether it lies in one token, weight) for each pattern."""
    for a, b, weight in pattern:
        n = len(letters) - a - b
        if n > 0:
            yield (letters[:n] * LETTERS + letters[a : a + n]) * LETTERS + letters[a + b :], token[:n] == token[a + b :], weight


@dataclass
class Model:
    landmarks: list[str]
    reach: int
    decay: float
    least: float
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    signs: tuple[str, ...] = ()
    tells: np.ndarray | None = None  # log ratio by sign and number of tokens
    trust: float = 0.0  # the slope of the evidence

    def __post_init__(self) -> None:
        self.pattern = gaps(self.reach, self.decay)
        self.place = np.full(LETTERS**3, -1, np.int32)  # rows of the table: triples that a landmark has
        found = [list(triples(*codes([mark]), self.pattern)) for mark in self.landmarks]
        seen = np.unique(np.concatenate([code for marks in found for code, _, _ in marks] or [np.zeros(0, np.int32)]))
        self.place[seen] = np.arange(len(seen))
        self.table = np.zeros((len(seen), max(1, len(self.landmarks))), np.float32)
        for j, marks in enumerate(found):
            for code, _, weight in marks:
                np.maximum.at(self.table[:, j], self.place[code], np.float32(weight))
        norms = (self.table.astype(np.float64) ** 2).sum(0)
        self.scaled = (self.table / np.where(norms, norms, 1)).astype(np.float32)
        # a kernel value of `least` needs triples of this weight together
        self.fewest = self.least * float((norms / np.maximum(self.table.max(0, initial=0), 1e-9)).min(initial=np.inf, where=norms > 0)) * 0.999

    def kernel(self, tokens: list[str]) -> np.ndarray:
        """Kernel values of folded tokens with the landmarks, over the landmarks' own; 1 for a landmark itself."""
        out = np.zeros((len(tokens), self.table.shape[1]), np.float32)
        if not tokens:
            return out
        for lo in range(0, len(tokens), 16_384):
            some = tokens[lo : lo + 16_384]
            letters, owner = codes(some)
            token, code, weight = [], [], []
            for found, whole, w in triples(letters, owner, self.pattern):
                at = self.place[found]
                hit = np.flatnonzero((at >= 0) & whole)
                token.append(owner[hit])
                code.append(at[hit])
                weight.append(np.full(len(hit), w, np.float32))
            if not token:
                continue
            token, code, weight = (np.concatenate(x) for x in (token, code, weight))
            key = token.astype(np.int64) * len(self.table) + code
            order_in = np.lexsort((-weight, key))
            key = key[order_in]
            first = order_in[np.r_[True, key[1:] != key[:-1]]] if len(key) else order_in
            token, code, weight = token[first], code[first], weight[first]
            # most tokens hold too few known triples to reach any landmark
            mass = np.bincount(token, weight, len(some))
            ok = mass[token] >= self.fewest
            token, code, weight = token[ok], code[ok], weight[ok]
            if len(token):
                start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
                out[lo + token[start]] = np.add.reduceat(weight[:, None] * self.scaled[code], start, axis=0)
        return out

    def map(self) -> np.ndarray:
        """The Nyström map: inverse root of the landmarks' kernel matrix, in the scale of kernel()."""
        values, vectors = np.linalg.eigh(self.kernel_matrix())
        keep = values > 1e-6 * values.max()
        return (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T

    def kernel_matrix(self) -> np.ndarray:
        raw = self.table.T.astype(np.float64) @ self.table
        root = np.sqrt(np.diag(raw))
        return raw / np.outer(root, root)


def pieces(token: str) -> list[str]:
    """A long token as overlapping pieces, so that nothing of it is left out."""
    if len(token) <= PIECE:
        return [token]
    return [token[i : i + PIECE] for i in range(0, len(token) - PIECE // 2, PIECE // 2)]


class Reader:
    """Token vectors of texts under a model; remembers tokens up to a bound."""

    def __init__(self, model: Model, remember: int = 150_000) -> None:
        self.model, self.remember = model, remember
        self.hits: dict[str, np.ndarray] = {}
        self.cold: set[str] = set()
        self.told: dict[str, tuple[str, tuple[int, ...]]] = {}
        # signs by their first three letters; none is shorter
        self.heads: dict[str, list[tuple[int, str]]] = {}
        for k, s in enumerate(model.signs):
            self.heads.setdefault(s[:3], []).append((k, s))

    def learn(self, tokens: set[str]) -> None:
        if len(self.cold) + len(self.hits) > self.remember:
            self.cold, self.hits, self.told = set(), {}, {}
        new = [t for t in tokens if t not in self.cold and t not in self.hits]
        folded = [(t, p) for t in new for p in pieces(START + fold(t)) if len(p) > 3]
        values = self.model.kernel([p for _, p in folded])
        best = np.flatnonzero(values.max(1) >= self.model.least) if len(folded) else []
        for i in best:
            t = folded[i][0]
            v = np.where(values[i] >= self.model.least, np.minimum(values[i], 1), 0).astype(np.float32)
            self.hits[t] = np.maximum(self.hits[t], v) if t in self.hits else v
        self.cold.update(t for t in new if t not in self.hits)
        if self.model.signs:
            for t in new:
                whole = START + fold(t) + END
                heads = {whole[i : i + 3] for i in range(len(whole) - 2)} & self.heads.keys()
                found = tuple(k for h in heads for k, s in self.heads[h] if s in whole)
                if found:
                    self.told[t] = whole, found

    def evidence(self, bag: set[str]) -> float:
        """The sum over signs of what the number of the bag's tokens with it tells."""
        if not self.model.signs:
            return 0.0
        n = np.zeros(len(self.model.signs), np.int64)
        for _, found in {self.told[t] for t in bag & self.told.keys()}:
            n[list(found)] += 1
        return float(self.model.tells[np.arange(len(n)), np.minimum(n, TIMES)].sum())

    def vectors(self, texts: list[str]) -> Iterator[tuple[np.ndarray, float]]:
        """For each text the vectors of its distinct tokens that match a landmark, no rows if none does; and its evidence."""
        low = [t.lower() for t in texts]
        spelled = [["".join(m[0].split()) for m in SPELLED.finditer(t)] for t in low]
        bags = [set(t.split()).union(s) for t, s in zip(low, spelled, strict=True)]
        self.learn(set().union(*bags) if bags else set())
        for bag in bags:
            found = bag & self.hits.keys()
            if not found:
                yield np.zeros((0, len(self.model.landmarks)), np.float32), self.evidence(bag)
                continue
            yield np.array([self.hits[t] for t in sorted(found)], np.float32), self.evidence(bag)


def substrings(token: str, shortest: int = 4, longest: int = 8) -> set[str]:
    """The strings of a token from 4 letters on; the start of the token counts as one."""
    return {token[i : i + k] for k in range(shortest, min(longest, len(token)) + 1) for i in range(len(token) - k + 1)}


def candidates(toxic: Counter, most: int, strings_of=lambda token: substrings(START + token)) -> list[str]:
    """The strings that reach most toxic texts by the tokens that tell them."""
    reach: Counter = Counter()
    for token, n in toxic.items():
        for s in strings_of(token):
            reach[s] += n
    return [s for s, n in sorted(reach.items(), key=lambda x: (-x[1], x[0]))[:most] if n >= 4]


def choose_landmarks(toxic: Counter, counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, most: int = 64, least_ratio: float = 60.0) -> list[str]:
    """Strings that tell toxic texts: counts has the toxic and clean texts of each candidate.

    A candidate needs least_ratio times the share of toxic texts that it has of clean ones. Greedy: the string whose
    tokens reach most toxic texts is taken, its tokens are marked as covered, the next is chosen on the rest.
    """
    enough = max(4, 0.005 * n_toxic)
    allowed = {s for s, (a, b) in counts.items() if a >= enough and (a + 0.5) * n_clean >= least_ratio * (b + 0.5) * n_toxic}
    strings: dict[str, set[str]] = {}
    for token in toxic:
        for s in substrings(START + token) & allowed:
            strings.setdefault(s, set()).add(token)
    chosen: list[str] = []
    left = Counter(toxic)
    while strings and len(chosen) < most:
        worth = {s: ((sum(left[t] for t in ts) - least_ratio * counts[s][1] * n_toxic / n_clean) * (1 + 0.03 * len(s)), s) for s, ts in strings.items()}
        best = max(worth, key=worth.get)
        if worth[best][0] < enough:
            break
        chosen.append(best)
        for t in strings[best]:
            left[t] = 0
        strings = {s: ts for s, ts in strings.items() if any(left[t] for t in ts)}
    return chosen


def sign_strings(token: str) -> set[str]:
    """The strings of a folded token that can be signs: substrings, and the token as a whole."""
    whole = START + token + END
    return substrings(START + token) | {whole}


def _sign_rows(wanted: list[str]):
    """(sign, label, number of its tokens in a text up to TIMES, texts) summed over each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(wanted)
        seen: dict[str, frozenset] = {}
        for batch in batches:
            counts: Counter = Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                if len(seen) > 100_000:
                    seen = {}
                times: Counter = Counter()
                for token in {fold(t) for t in (text or "").lower().split()}:
                    if token not in seen:
                        seen[token] = known & sign_strings(token)
                    times.update(seen[token])
                counts.update((s, label, min(n, TIMES)) for s, n in times.items())
            yield pa.RecordBatch.from_arrays([*(pa.array([c[k] for c in counts], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))), pa.array(list(counts.values()), pa.int64())], ["sign", "label", "times", "texts"])

    return run


def choose_signs(toxic: Counter, counts: dict[str, np.ndarray], marks: list[str], n_toxic: int, n_clean: int, most: int = 128, least_ratio: float = 20.0) -> tuple[tuple[str, ...], np.ndarray]:
    """Signs and what each number of their tokens tells; counts has the clean and toxic texts by number of tokens, 0 to TIMES.

    A sign needs, at some number of tokens or more, four toxic texts and least_ratio times the share of toxic texts that it
    has of clean ones. Greedy by mutual information with the label, on the tokens without a landmark; a string whose tokens
    mostly are another's is passed over, a whole token is not: it tells more than its stem.
    """
    tokens: dict[str, list[str]] = {}
    left = {t: 0 if any(m in START + t for m in marks) else n for t, n in toxic.items()}
    for t in toxic:
        for s in sign_strings(t) & counts.keys():
            tokens.setdefault(s, []).append(t)
    gain = {}
    for s in tokens:
        clean, bad = (counts[s][:, ::-1].cumsum(1)[:, ::-1])[:, 1:]
        if ((bad >= 4) & ((bad + 0.5) * n_clean >= least_ratio * (clean + 0.5) * n_toxic)).any():
            p = counts[s] / (n_clean + n_toxic)
            gain[s] = float((p[p > 0] * np.log(p[p > 0] / (p.sum(0) * p.sum(1)[:, None])[p > 0])).sum())
    chosen: list[str] = []
    for s in sorted(gain, key=lambda s: (-gain[s], -len(s), s)):
        if len(chosen) == most:
            break
        if (s.endswith(END) and not any(m in s for m in marks)) or sum(left[t] for t in tokens[s]) >= 0.5 * sum(toxic[t] for t in tokens[s]):
            chosen.append(s)
            left.update(dict.fromkeys(tokens[s], 0))
    smooth = [(c + 0.5) / (c.sum(1, keepdims=True) + 0.5 * (TIMES + 1)) for c in (counts[s] for s in chosen)]
    return tuple(chosen), np.array([np.log(p[1] / p[0]) for p in smooth]).reshape(len(chosen), TIMES + 1)


def _candidate_rows(wanted: list[str]):
    """(candidate, toxic texts, clean texts) summed over each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(wanted)
        seen: dict[str, tuple] = {}
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                if len(seen) > 100_000:
                    seen = {}
                found: set[str] = set()
                for token in set((text or "").lower().split()):
                    if token not in seen:
                        seen[token] = tuple(s for p in pieces(START + fold(token)) for s in substrings(p) & known)
                    found.update(seen[token])
                for s in found:
                    counts.setdefault(s, [0, 0])[0 if label else 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], ["string", "toxic", "clean"])

    return run


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine with classes weighted alike, by Newton steps."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * c
    ridge = np.eye(a.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        inside = y * (a @ w) < 1
        s = a[inside]
        gradient = ridge @ w - (s.T * weight[inside]) @ (y[inside] - s @ w)
        step = np.linalg.solve(ridge + (s.T * weight[inside]) @ s, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _platt(f: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Slopes and offset of a logistic curve, lightly ridged so that separable scores stay finite.

    The rarer class weighs more, by the cube root of the ratio, so that 0.5 lies between the classes rather than near the rare one.
    """
    a = np.c_[f, np.ones(len(f))]
    n_bad, n_good = max(1, (y > 0).sum()), max(1, (y < 0).sum())
    t = np.where(y > 0, (n_bad + 1) / (n_bad + 2), 1 / (n_good + 2))
    weight = np.where(y > 0, (n_good / n_bad) ** (1 / 3), 1.0)
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a.T * (weight * p * (1 - p))) @ a + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (weight * (p - t)) + 1e-3 * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: Column) -> Column:
    """Whether a row is outside the training folds: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            found = sorted({p for t in set((text or "").lower().split()) for p in pieces(fold(t)) if p})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], ["token", "label"])


def _vector_rows(model: Model, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out, told = [], []
                for v, e in reader.vectors([t or "" for t in part.column("text").to_pylist()]):
                    top = np.argsort(-v.max(1), kind="stable")[:most] if len(v) else []
                    out.append(v[top].ravel() if len(v) else np.zeros(0, np.float32))
                    told.append(e)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(out, pa.list_(pa.float32())), pa.array(told, pa.float64())], ["label", "vectors", "evidence"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = 10_000, reach: int = 6, decay: float = 0.7, least: float = 0.4, tokens: int = 10_000, matches: int = 12, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Trains on at most `sample` labelled rows of the training folds, the first by a hash of the id.

    The sample bounds what is broadcast (ids and labels) and, with `tokens` (tokens kept by class) and
    `matches` (vectors kept a text), what reaches the driver. Texts are read whole. Without labelled rows
    of both classes the model scores every text 0.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null")
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # the sample is stored: training reads it several times, the corpus once
    chosen = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("text", "label"))
    counts = chosen.mapInArrow(_token_rows, "token string, label int").groupBy("token").agg(F.sum(F.col("label").cast("long")).alias("toxic"), F.sum(1 - F.col("label").cast("long")).alias("clean"))
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    empty = Model([], reach, decay, least, np.zeros(0), -1.0, 1.0, -5.0)
    if not n_toxic or not n_clean:
        return empty
    ratio = n_clean / n_toxic
    telling = counts.filter((F.col("toxic") >= 2) & (F.col("toxic") * ratio > 5 * F.col("clean"))).orderBy(F.desc("toxic"), "token").limit(tokens).collect()
    toxic = Counter({r.token: r.toxic for r in telling})
    strings = chosen.mapInArrow(_candidate_rows(candidates(toxic, tokens)), "string string, toxic long, clean long").groupBy("string").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    seen = {r.string: (r.toxic, r.clean) for r in strings.collect()}
    marks = choose_landmarks(toxic, seen, n_toxic, n_clean)
    totals = [F.sum(F.when((F.col("label") == label) & (F.col("times") == n), F.col("texts")).otherwise(0)).alias(f"n{label}_{n}") for label in (0, 1) for n in range(1, TIMES + 1)]
    found = chosen.mapInArrow(_sign_rows(candidates(toxic, tokens, sign_strings)), "sign string, label int, times int, texts long").groupBy("sign").agg(*totals).collect()
    counts_of = {}
    for r in found:
        n = np.array(r[1:], float).reshape(2, TIMES)
        counts_of[r.sign] = np.c_[np.maximum([n_clean, n_toxic] - n.sum(1), 0), n]
    signs = choose_signs(toxic, counts_of, marks, n_toxic, n_clean)
    # without a landmark of the high ratio the first sign is one
    first = lambda signs: [s for s in (x.removesuffix(END) for x in signs[0]) if len(s) > 3][:1]
    marks = marks or first(signs)
    if not marks:
        return empty
    model = fitted(chosen, marks, signs, seen, n_toxic, n_clean, reach, decay, least, matches)
    # landmarks that the machine gives no weight were chance; without them scoring is cheaper and surer, and what they covered can be signs
    kept = [m for m, w in zip(marks, model.weights, strict=True) if w > 0 and w >= 0.25 * model.weights.max()]
    if len(kept) == len(marks):
        return model
    signs = choose_signs(toxic, counts_of, kept, n_toxic, n_clean)
    kept = kept or first(signs) or marks
    return fitted(chosen, kept, signs, seen, n_toxic, n_clean, reach, decay, least, matches)


def spread_letters(mark: str, most: int = 2) -> list[str]:
    """A landmark with one to `most` letters put in between its own: at each gap alone, and at pairs of gaps."""
    gaps_of = range(1 + mark.startswith(START), len(mark))
    put = lambda where: "".join(("x" if i in where else "") + c for i, c in enumerate(mark))
    return [put({*where}) for n in range(1, most + 1) for where in combinations(gaps_of, n)]


def fitted(chosen: DataFrame, marks: list[str], signs: tuple[tuple[str, ...], np.ndarray], seen: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, reach: int, decay: float, least: float, matches: int) -> Model:
    """The machine over given landmarks, trained on the chosen texts and labels."""
    model = Model(marks, reach, decay, least, np.zeros(len(marks)), 0.0, 1.0, 0.0, *signs)
    rows = chosen.mapInArrow(_vector_rows(model, matches), "label int, vectors array<float>, evidence double").toArrow()
    zero = np.zeros((1, len(marks)))
    bags = []
    for v in rows.column("vectors").iterchunks():
        flat, at = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
        bags += [flat[a:b].astype(float).reshape(-1, len(marks)) if b > a else zero for a, b in zip(at[:-1], at[1:], strict=True)]
    y = np.where(rows.column("label").to_numpy() > 0, 1.0, -1.0)
    mapped = model.map()
    # a toxic text without any match can't teach the machine; it counts in the scaling below
    matched = [b.any() or t < 0 for b, t in zip(bags, y, strict=True)]
    # landmarks of many toxic texts and hardly any clean one: tokens like these are toxic wherever they stand
    strong = np.array([a >= max(8, 0.03 * n_toxic) and b * n_toxic <= 0.002 * a * n_clean for a, b in (seen.get(m, (0, 0)) for m in marks)])
    sure = [b[(b * strong).max(1) >= 0.9] for b in bags]
    picks = [(s if len(s) else b[[int(np.argmax(b.max(1)))]]) if t > 0 else b for b, s, t in zip(bags, sure, y, strict=True)]
    # virtual examples: strong landmarks with letters put in between are as toxic as they are themselves
    broken = model.kernel([v for m, s in zip(marks, strong, strict=True) if s for v in spread_letters(m)]).astype(float)
    broken = np.where(broken >= least, np.minimum(broken, 1), 0)[broken.max(1, initial=0) >= least]
    for _ in range(3):
        used = [p for p, m in zip(picks, matched, strict=True) if m] + [broken]
        x, t = np.concatenate(used) @ mapped, np.repeat([*y[matched], 1.0], [len(p) for p in used])
        w, bias = svm(x, t)
        picks = [np.concatenate([s, b[[int(np.argmax(b @ mapped @ w))]]]) if t > 0 else b for b, s, t in zip(bags, sure, y, strict=True)]
    model.weights, model.bias = mapped @ w, bias
    highest = np.array([(b @ model.weights).max() + bias for b in bags])
    evidence = rows.column("evidence").to_numpy()
    # a virtual example stands in a text that is clean otherwise
    highest = np.r_[highest, broken @ model.weights + bias]
    evidence = np.r_[evidence, np.full(len(broken), np.median(evidence[y < 0]))]
    model.slope, model.trust, model.offset = map(float, _platt(np.c_[highest, evidence], np.r_[y, np.ones(len(broken))]))
    return model


def _score_rows(model: Model, at: int, drop: bool):
    """Appends the score of the texts in column `at`, which goes if `drop`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        none = model.bias
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [t or "" for t in part.column(at).to_pylist()]
                if model.landmarks:
                    f = np.array([model.slope * ((v @ model.weights).max() + none if len(v) else none) + model.trust * e for v, e in reader.vectors(texts)])
                else:
                    f = np.full(len(texts), model.slope * none)
                score = 1 / (1 + np.exp(-np.clip(f + model.offset, -60, 60)))
                kept = part.num_columns - drop
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], pa.array(score, pa.float64())], [*part.schema.names[:kept], "score"])

    return run


def score_texts(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns `keep` of every row and its score (in the column `name`), 0 to 1; a map without a shuffle.

    Null, empty and wordless texts get the score of a text without any match. Repeated rows are kept.
    """
    names = [f"c{i}" for i in range(len(keep))]
    # a text that is kept anyway travels once
    held = text_col in keep and docs.schema[text_col].dataType.simpleString() == "string"
    own = [] if held else [F.col(text_col).cast("string").alias("text_to_score")]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), *own)
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True))
    return rows.mapInArrow(_score_rows(model, keep.index(text_col) if held else len(keep), not held), f"{schema}, score double").toDF(*keep, name)
