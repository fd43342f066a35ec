"""Text quality by nearest-neighbour voting in a latent-semantic space.

Texts become counts of hashed byte trigrams, of their letters and of their shape (runs of small
letters, capitals, digits and spaces taken as one sign each), log-scaled, weighted by inverse document
frequency and projected on the leading singular directions of the labelled sample. The sample's vectors are
broadcast; every document takes its exact cosine with each of them, in blocks, and the nearest
vote with weights that grow with similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlematch.llm.common import byte_blocks, held_out, record_batch

DIMS, SHAPES = 2048, 256
#: What a byte is in a text's shape: a letter's, digit's or space's kind, any other sign itself.
_KIND = bytes(97 if chr(b).islower() else 65 if chr(b).isupper() else 48 if chr(b).isdigit() else 32 if chr(b).isspace() and b != 10 else b for b in range(128)) + bytes(128)
_NOT_ASCII = bytes(range(128, 256))
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


#: Bytes of text that are counted at a time; the work arrays take some thirty bytes for each.
CHUNK = 1 << 20


def trigram_counts(texts: list[bytes], dims: int = DIMS) -> np.ndarray:
    """One row per text: counts of its byte trigrams, hashed to ``dims`` (a power of two). Digits count alike."""
    out = np.zeros((len(texts), dims), np.float32)
    first, held = 0, 0
    for i, t in enumerate(texts):
        if len(t) > CHUNK:
            for at in range(0, len(t) - 2, CHUNK):
                out[i] += _counted([t[at : at + CHUNK + 2]], dims)[0]
        elif held + len(t) > CHUNK:
            out[first:i] += _counted([x if len(x) <= CHUNK else b"" for x in texts[first:i]], dims)
            first, held = i, len(t)
        else:
            held += len(t)
    if first < len(texts):
        out[first:] += _counted([x if len(x) <= CHUNK else b"" for x in texts[first:]], dims)
    return out


def shape_of(text: bytes) -> bytes:
    """The text with each run of one kind of sign as a single one; letters beyond ASCII are left out."""
    kinds = np.frombuffer(text.translate(_KIND, _NOT_ASCII), np.uint8)
    return kinds[np.append(True, kinds[1:] != kinds[:-1])].tobytes() if len(kinds) else b""


def features(texts: list[bytes]) -> np.ndarray:
    """Counts of the trigrams of texts, and behind them of their shapes."""
    return np.hstack([trigram_counts(texts), trigram_counts([shape_of(t) for t in texts], SHAPES)])


def _counted(texts: list[bytes], dims: int) -> np.ndarray:
    joined = np.frombuffer(b"".join(texts), np.uint8)
    joined = np.where((joined >= 48) & (joined < 58), 48, joined).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if len(joined) < 3:
        return np.zeros((len(texts), dims), np.float32)
    code = joined[:-2] << 16 | joined[1:-1] << 8 | joined[2:]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - dims.bit_length() + 1)
    inside = owner[:-2] == owner[2:]
    flat = owner[:-2][inside] * dims + bucket[inside]
    return np.bincount(flat, minlength=len(texts) * dims).reshape(len(texts), dims).astype(np.float32)


@dataclass
class Neighbours:
    """The broadcast model: at most ``sample`` vectors of ``rank`` numbers, whatever the corpus."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    mass: np.ndarray
    prior: float
    near: int
    sharpness: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit(terms(counts, self.idf) @ self.axes)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability-like score of label 1; the prior where nothing is similar (empty texts too).

        All neighbours as near as the last of the ``near`` nearest vote, so ties need no order.
        """
        z = self.embed(features([(t or "").encode() for t in texts]))
        if not len(self.vectors):
            return np.full(len(texts), self.prior)
        cosine = z @ self.vectors.T
        k = min(self.near, cosine.shape[1])
        last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
        row, col = np.nonzero(cosine >= last[:, None])
        weight = np.maximum(cosine[row, col], 0).astype(np.float64) ** self.sharpness * self.mass[col]
        total, good = np.bincount(row, weight, len(texts)), np.bincount(row, weight * self.votes[col], len(texts))
        return np.round(np.where(total > 0, good / np.where(total > 0, total, 1), self.prior), 6)


def terms(counts: np.ndarray, idf: np.ndarray, weight: float = 1.0) -> np.ndarray:
    """Rows of the term-document matrix: weighted trigrams of letters and of the shape, and pseudo-terms for how often a text repeats itself.

    Words differ from language to language and text to text; lists, capitals and stray signs have
    the same shape in all of them, so few labelled texts are enough to know them.

    The pseudo-terms are cells of text length against trigrams per distinct trigram, both on a
    log scale, each text shared out between the two nearest cells of the second.
    """
    weighted = np.log1p(counts) * idf
    letters = counts[:, :DIMS]
    total, distinct = letters.sum(axis=1), (letters > 0).sum(axis=1)
    length = np.clip(np.log2(1 + total).astype(int), 0, 15)
    repeats = np.clip(2 * np.log2(np.maximum(total, 1) / np.maximum(distinct, 1)), 0, 22.99)
    cell, part = length * 24 + repeats.astype(int), (repeats % 1).astype(np.float32)
    pseudo = np.zeros((len(counts), 16 * 24), np.float32)
    rows = np.arange(len(counts))
    pseudo[rows, cell], pseudo[rows, cell + 1] = weight * (1 - part), weight * part
    return np.hstack([_unit(weighted[:, :DIMS]), _unit(weighted[:, DIMS:]), pseudo])


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def fit(counts: np.ndarray, labels: np.ndarray, totals: dict[int, int], *, rank: int, near: int, sharpness: float, seed: int = 3) -> Neighbours:
    """counts: sample x dims; labels 0/1; totals: labelled rows of each class, to undo the sample's balance."""
    n = len(labels)
    prior = totals.get(1, 0) / max(sum(totals.values()), 1) if totals else 0.5
    idf = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    if not n:
        return Neighbours(idf, np.zeros((terms(counts, idf).shape[1], 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), prior, near, sharpness)
    x = terms(counts, idf)
    rank = min(rank, *x.shape)
    basis = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(4):  # randomised range finder with power iterations
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ right[:rank].T).astype(np.float32)
    share = {c: totals.get(c, 0) / max(int((labels == c).sum()), 1) for c in (0, 1)}
    return Neighbours(idf, axes, _unit(x @ axes), labels.astype(np.float64), np.array([share[int(c)] for c in labels]), prior, near, sharpness)


def labelled_sample(labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each class, by a hash of the id; never held-out rows.

    A doc_id with several labels keeps the smallest. Labels other than 0 and 1, and null ids, are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(column).cast("int").alias("y"))
    picked = [known.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return picked[0].unionByName(picked[1])


def sample_texts(documents: DataFrame, labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """doc_id, text and y of the labelled sample; an id with several texts has the first in order."""
    picked = documents.select("doc_id", "text").join(F.broadcast(labelled_sample(labels, column, per_class)), "doc_id")  # at most 2 x per_class rows
    return picked.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def train(documents: DataFrame, labels: DataFrame, *, column: str = "quality", per_class: int = 2048, rank: int = 64, near: int = 24, sharpness: float = 64.0) -> Neighbours:
    """Fit on at most 2 x ``per_class`` labelled texts; their counts, not their texts, reach the driver."""
    totals = {r["y"]: r["n"] for r in labels.where(F.col(column).isin(0, 1) & ~held_out()).groupBy(F.col(column).cast("int").alias("y")).agg(F.countDistinct("doc_id").alias("n")).collect()}
    sample = sample_texts(documents, labels, column, per_class)

    def run(batches):
        for batch in byte_blocks(batches, rows=128):
            counts = features([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([c.astype("<u4").tobytes() for c in counts], pa.binary())], names=["doc_id", "y", "counts"])

    rows = sorted(sample.mapInArrow(run, "doc_id long, y int, counts binary").collect(), key=lambda r: r["doc_id"])
    unique: dict[bytes, list[int]] = {}
    for r in rows:  # copies count once, with the label most of them have
        unique.setdefault(bytes(r["counts"]), []).append(r["y"])
    counts = np.array([np.frombuffer(c, "<u4") for c in unique], np.float32).reshape(-1, DIMS + SHAPES)
    y = np.array([int(2 * sum(v) >= len(v)) for v in unique.values()], np.int64)
    return fit(counts, y, totals, rank=rank, near=near, sharpness=sharpness)


def score(documents: DataFrame, model: Neighbours, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; null and empty texts get the prior."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in byte_blocks(batches, rows=128):
            yield record_batch(SCORES, {"doc_id": batch.column("doc_id"), "score": shared.value.score(batch.column("text").to_pylist())})

    scored = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``documents`` that score at least ``threshold``, with their columns as they were."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def run(batches):
        for batch in byte_blocks(batches, rows=128):
            yield batch.filter(pa.array(shared.value.score(batch.column("text").to_pylist()) >= threshold))

    return documents.mapInArrow(run, documents.schema)
