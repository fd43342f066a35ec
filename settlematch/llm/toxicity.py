"""Toxic passages as maximum-scoring segments of token log-odds.

Token scores are log-odds of toxic against clean texts with an informative Dirichlet prior: the
prior's counts follow the word's share of both classes, so rare words stay near zero. A
linear-time scan over a text's scores finds every maximal-scoring segment. Extreme-value theory
turns a segment's score into an expected count under clean text; the sum statistic over the best
segments is the text's evidence, and a logistic curve fitted on the sample maps it to 0..1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlematch.llm.common import byte_blocks, held_out, record_batch
from settlematch.llm.quality import sample_texts
from settlematch.storage import written

SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", pa.list_(pa.list_(pa.int32())))])
_SPACES = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of any other characters."""
    return (text or "").lower().encode().translate(_SPACES).split()


def stems(word: bytes) -> list[bytes]:
    """Longer to shorter beginnings of a word, marked so that they differ from whole words."""
    return [b"^" + word[:n] for n in (6, 5, 4) if len(word) > n]


def cluster_key(words: list[bytes]) -> int:
    """Smallest hash of five words in a row, alike for near copies, so that they can count once."""
    if len(words) < 5:
        return xxhash.xxh64_intdigest(b" ".join(words)) >> 1
    return min(xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(len(words) - 4)) >> 1


def log_odds(word_t: np.ndarray, word_c: np.ndarray, total_t: float, total_c: float, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each word and its z-value, under a Dirichlet prior of ``strength`` pseudo-counts."""
    prior = strength * (word_t + word_c) / max(total_t + total_c, 1)
    t, c = word_t + prior, word_c + prior
    odds = np.log(t / np.maximum(total_t + strength - t, 1e-9)) - np.log(c / np.maximum(total_c + strength - c, 1e-9))
    return odds, odds / np.sqrt(1 / t + 1 / c)


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a text's tokens, in linear time.

    scores: position and value of the tokens that have a score; the others have ``drift`` (< 0).
    Candidates are kept with the running totals before and after them, and the place of the
    nearest earlier one that starts from a lower total. A new one is joined with that one, as long
    as this makes it larger. Following places skips all between, so every candidate is passed once.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, place of the lower one
    total, last = 0.0, 0
    for at, value in scores:
        total += drift * (at - last)
        last = at + 1
        if value <= 0:
            total += value
            continue
        start, before = at, total
        total += value
        j = len(kept) - 1
        while j >= 0 and kept[j][2] >= before:
            j = kept[j][4]
        while j >= 0 and kept[j][3] < total:
            start, _, before, _, lower = kept[j]
            del kept[j:]
            j = lower
        kept.append((start, at + 1, before, total, j))
    return [(s, e, after - before) for s, e, before, after, _ in kept]


@dataclass
class Scorer:
    """The broadcast model: the scored words of at most 2 x ``per_class`` texts and five numbers."""

    words: dict[bytes, float]
    drift: float
    rate: float
    scale: float
    slope: float
    intercept: float
    significance: float

    def value(self, word: bytes) -> float | None:
        """A word's own score, or that of its longest scored beginning."""
        get = self.words.get
        if (s := get(word)) is not None:
            return s
        return next((s for x in stems(word) if (s := get(x)) is not None), None)

    def scored(self, words: list[bytes]) -> list[tuple[int, float]]:
        memo = self.__dict__.setdefault("_memo", {})
        if len(memo) > 300_000:
            memo.clear()
        out = []
        for i, w in enumerate(words):
            if w in memo:
                s = memo[w]
            else:
                s = memo[w] = self.value(w)
            if s is not None:
                out.append((i, s))
        return out

    def evidence(self, words: list[bytes]) -> tuple[float, list[tuple[int, int, float]]]:
        """-ln p of the best sum of segments, and the significant segments."""
        return self.weigh(self.scored(words), len(words))

    def weigh(self, scored: list[tuple[int, float]], n: int) -> tuple[float, list[tuple[int, int, float]]]:
        if not any(s > 0 for _, s in scored):
            return 0.0, []
        segments = maximal_segments(scored, self.drift)
        level = math.log(self.scale * max(n, 1))
        best = sorted((self.rate * s - level for *_, s in segments), reverse=True)
        most, total = 0.0, 0.0
        for r, x in enumerate(best, 1):
            total += x
            if total <= 0:
                break
            # tail of the sum of the r best normalised scores
            most = max(most, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
        strong = math.log(1 / self.significance)
        return most, [x for x in segments if self.rate * x[2] - level >= strong]

    def score(self, evidence: float) -> float:
        return round(1 / (1 + math.exp(-max(min(self.slope * math.log1p(evidence) + self.intercept, 60), -60))), 6)


def telling_words(counts: DataFrame, n_toxic: int, n_clean: int, *, strength: float, least_z: float, least_odds: float) -> dict[bytes, float]:
    """Log-odds of the words (word, t, c: texts of each class that hold it) that pass both tests, worked out by Spark.

    The prior's counts follow the word's share of both classes (:func:`log_odds`).
    """
    if not n_toxic or not n_clean:
        return {}
    prior = F.lit(strength) * (F.col("t") + F.col("c")) / F.lit(float(max(n_toxic + n_clean, 1)))
    t, c = F.col("t") + prior, F.col("c") + prior
    odds = F.log(t / F.greatest(F.lit(n_toxic + strength) - t, F.lit(1e-9))) - F.log(c / F.greatest(F.lit(n_clean + strength) - c, F.lit(1e-9)))
    rows = counts.select("word", odds.alias("odds"), (odds / F.sqrt(1 / t + 1 / c)).alias("z"))
    found = rows.where((F.abs("z") >= least_z) & (F.abs("odds") >= least_odds)).select("word", "odds").collect()
    return {bytes(r["word"]): r["odds"] for r in found}


def calibrate(words: dict[bytes, float], texts: list[tuple[list[float], int, int]], drift: float, significance: float) -> Scorer:
    """texts: (scores of the scored tokens with their positions flattened, tokens, label) of the sample."""
    model = Scorer(words, drift, 1.0, 0.1, 1.0, -3.0, significance)
    clean = [x for x in texts if not x[2] and x[1]]
    if not words or not clean or len(clean) == len(texts):
        share = sum(x[2] for x in texts) / max(len(texts), 1)
        model.slope, model.intercept = 1.0, math.log((share + 0.01) / (1.01 - share))
        return model
    # rate: the positive root of E[exp(rate * score)] = 1 over tokens of clean texts
    n = sum(x[1] for x in clean)
    seen = np.array([v for x in clean for v in x[0][1::2]], np.float64)
    low, high = 1e-3, 50.0

    def moment(rate: float) -> float:
        return float(np.exp(np.minimum(rate * seen, 700)).sum() + (n - len(seen)) * math.exp(rate * drift)) / n - 1

    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 0 else (low, mid)
    model.rate = max(min(low, 3.0), 0.05)
    # scale: the median of n * exp(-rate * best score) over clean texts is ln 2 / scale
    best = [max([0.0, *(s for *_, s in maximal_segments(list(zip(map(int, x[0][::2]), x[0][1::2], strict=True)), drift))]) for x in clean]
    model.scale = float(np.clip(math.log(2) / np.median([x[1] * math.exp(-model.rate * b) for x, b in zip(clean, best, strict=True)]), 1e-4, 1.0))
    return model


def logistic(x: np.ndarray, y: np.ndarray, mass: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by damped Newton steps, with a small ridge that keeps separable data finite."""
    a = np.column_stack([x, np.ones_like(x)])
    share = float(np.clip((mass * y).sum() / mass.sum(), 1e-3, 1 - 1e-3))
    w = np.array([0.0, math.log(share / (1 - share))])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((mass * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * w @ w)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
        g = a.T @ (mass * (p - y)) + w
        h = (a * (mass * p * (1 - p))[:, None]).T @ a + np.eye(2)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return max(float(w[0]), 1e-3), float(w[1])


def train(documents: DataFrame, labels: DataFrame, *, column: str = "toxic", per_class: int = 3000, strength: float = 50.0, least_z: float = 3.5, least_odds: float = 1.0, drift: float = -0.05, significance: float = 0.05) -> Scorer:
    """Fit on at most 2 x ``per_class`` labelled texts, near copies counting once.

    Words are counted and tested by Spark; the driver sees those that pass, and for the sample's
    texts the scores of their scored tokens. Both are bounded by the sample. An id with several
    texts counts with the first in order.
    """
    totals = {r["y"]: r["n"] for r in labels.where(F.col(column).isin(0, 1) & ~held_out()).groupBy(F.col(column).cast("int").alias("y")).agg(F.countDistinct("doc_id").alias("n")).collect()}
    sample = sample_texts(documents, labels, column, per_class)
    schema = pa.schema([("y", pa.int32()), ("key", pa.int64()), ("words", pa.list_(pa.binary()))])

    def run(batches):
        for batch in byte_blocks(batches):
            found = [tokens(t) for t in batch.column("text").to_pylist()]
            yield record_batch(schema, {"y": batch.column("y"), "key": [cluster_key(w) for w in found], "words": [list({x for w in set(f) for x in (w, *stems(w))}) for f in found]})

    one = written(sample.mapInArrow(run, "y int, key long, words array<binary>").dropDuplicates(["y", "key"]))
    sizes = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_t, n_c = sizes.get(1, 0), sizes.get(0, 0)
    by_word = one.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    words = telling_words(by_word, n_t, n_c, strength=strength, least_z=least_z, least_odds=least_odds)

    lookup = Scorer(words, drift, 1.0, 1.0, 1.0, 0.0, significance)

    def scan(batches):
        for batch in byte_blocks(batches):
            found = [tokens(t) for t in batch.column("text").to_pylist()]
            flat = [[float(v) for pair in lookup.scored(x) for v in pair] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([cluster_key(x) for x in found], pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(flat, pa.list_(pa.float64()))], names=["y", "key", "n", "flat"])

    seen = sorted(sample.mapInArrow(scan, "y int, key long, n long, flat array<double>").dropDuplicates(["y", "key"]).collect(), key=lambda r: (r["key"], r["y"]))
    model = calibrate(words, [(r["flat"], r["n"], r["y"]) for r in seen], drift, significance)
    if n_t and n_c:
        x = np.log1p([model.weigh(list(zip(map(int, r["flat"][::2]), r["flat"][1::2], strict=True)), r["n"])[0] for r in seen])
        y = np.array([r["y"] for r in seen], np.float64)
        mass = np.where(y == 1, totals[1] / n_t, totals[0] / n_c)
        model.slope, model.intercept = logistic(x, y, mass / mass.mean())
    return model


def score(documents: DataFrame, model: Scorer, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and the significant passages as [first word, last word + 1].

    Null and empty texts have no evidence. Repeated rows repeat.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in byte_blocks(batches):
            found = [shared.value.evidence(tokens(t)) for t in batch.column("text").to_pylist()]
            yield record_batch(SCORES, {"doc_id": batch.column("doc_id"), "score": [shared.value.score(e) for e, _ in found], "passages": [[[s, e] for s, e, _ in segments] for _, segments in found]})

    scored = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, passages array<array<int>>")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that score below ``threshold``, with their columns as they were."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def run(batches):
        for batch in byte_blocks(batches):
            yield batch.filter(pa.array([shared.value.score(shared.value.evidence(tokens(t))[0]) < threshold for t in batch.column("text").to_pylist()]))

    return documents.mapInArrow(run, documents.schema)
