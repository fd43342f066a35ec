"""Whitening of vectors from exact integer sums over bit planes.

Vector entries become whole numbers. A block of distinct vectors is turned on its side: every
dimension, shifted by its smallest value in the block, is cut into bit planes, and each plane's
bits of 64 rows are packed into a word. The product sum of two dimensions is then the sum over
pairs of their planes of 2^(a+b) times the number of rows that have both bits, which is the
popcount of the AND of two words. A plane of ones beside them gives sums and row counts by the
same rule. All of it stays in whole numbers until the covariance is centred; only then is it
divided, rounded once, and handed to an eigenvalue routine.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from settlematch.llm.common import record_batch
from settlematch.storage import discard, written

#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Rows whose planes are held together: 256 words a plane.
BLOCK = 16_384
#: Product sums travel as LIMBS numbers of WIDTH bits, so that sums of millions of tasks fit a long.
WIDTH, LIMBS = 40, 4
#: Largest whole number taken, so that differences and four limbs always suffice.
MOST = 1 << 60
#: Eigenvalues below this share of the largest are taken for zero.
RANK = 1e-12

_SUMS = pa.schema([("i", pa.int32()), ("j", pa.int32()), *((f"limb{k}", pa.int64()) for k in range(LIMBS))])


def whole_numbers(vector: str) -> Column:
    """``vector`` as whole numbers; null where it is null or empty or has an entry that is null or not finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(c.cast("double"), F.lit(0.0))))

    def whole(c: Column) -> Column:
        scaled = SCALE * c.cast("double")
        return F.when(F.abs(scaled) < float(MOST), F.floor(scaled) + OFFSET).otherwise(F.raise_error(F.concat(F.lit("too large to whiten: "), c.cast("string"))).cast("long"))

    return F.when(v.isNotNull() & (F.size(v) > 0) & finite, F.transform(v, whole))


def as_matrix(column: pa.Array) -> np.ndarray:
    """Rows x dimensions of a list column without nulls."""
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.int64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def product_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns of ``x`` and a column of ones behind them, as Python integers."""
    rows, dims = x.shape
    low = np.append(x.min(axis=0), 0)
    flat = np.ones((dims + 1, -(-rows // 64) * 64), np.int64)
    flat[:dims, :rows] = x.T - low[:dims, None]
    flat[:, rows:] = 0
    bits = np.maximum(1, [int(v).bit_length() for v in flat.max(axis=1)])
    dim, bit = np.repeat(np.arange(dims + 1), bits), np.concatenate([np.arange(b) for b in bits])
    planes = np.empty((len(dim), flat.shape[1] // 64), np.uint64)
    for b in range(bits.max()):
        planes[bit == b] = np.packbits((flat[bits > b] >> b & 1).astype(np.uint8), axis=1).view(np.uint64)
    both = np.zeros((len(dim), len(dim)), np.int64)
    for p in range(len(dim)):
        both[p, p:] = np.bitwise_count(planes[p] & planes[p:]).sum(axis=1, dtype=np.int64)
    both += np.triu(both, 1).T
    # whole numbers of the machine where nothing can overflow, else Python's
    kind = np.int64 if 2 * max(int(np.abs(x).max()).bit_length(), int(bits.max())) + rows.bit_length() < 60 else object
    weight = np.array([1 << int(b) for b in bit], kind)
    start = np.concatenate([[0], np.cumsum(bits)[:-1]])
    sums = np.add.reduceat(np.add.reduceat(both.astype(kind) * weight * weight[:, None], start, axis=0), start, axis=1)
    low, ones = low.astype(kind), sums[-1]
    return (sums + np.outer(low, ones) + np.outer(ones, low) + rows * np.outer(low, low)).astype(object)


def _blocks_of(batches) -> np.ndarray:
    """Matrices of BLOCK rows, the last one shorter."""
    held, n = [], 0
    for batch in batches:
        x = as_matrix(batch.column("x"))
        while len(x):
            held.append(x[: BLOCK - n])
            n, x = n + len(held[-1]), x[BLOCK - n :]
            if n == BLOCK:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def _scatter(batches):
    """One batch a task: product sums of its rows as limbs; the column of ones has number -1."""
    total = functools.reduce(np.add, map(product_sums, _blocks_of(batches)), 0)
    if isinstance(total, int):
        return
    i, j = np.triu_indices(len(total))
    out, rest = {c: (k + 1) % len(total) - 1 for c, k in (("i", i), ("j", j))}, total[i, j]
    for k in range(LIMBS):
        last = k == LIMBS - 1
        out[f"limb{k}"] = np.array(rest if last else [v & (1 << WIDTH) - 1 for v in rest], np.int64)
        rest = [v >> WIDTH for v in rest]
    yield record_batch(_SUMS, out)


class Whitening:
    """Means and components of the fit list, made on the driver from exact sums.

    n: rows; quotient, rest: the sums' whole part and remainder by n; axes: dimensions x components,
    each divided by the root of its eigenvalue; explained: shares of the trace.
    """

    def __init__(self, sums: dict[tuple[int, int], int], dims: int, k: int):
        self.n = n = sums[-1, -1]
        total = [sums[d, -1] for d in range(dims)]
        self.quotient, self.rest = [s // n for s in total], [s % n for s in total]
        # n^2 V is a whole number; the division of two Python integers is rounded once
        v = np.array([[(n * _of(sums, a, b) - total[a] * total[b]) / (n * n) for b in range(dims)] for a in range(dims)])
        value, vector = np.linalg.eigh(v)
        order = np.argsort(-value, kind="stable")[:k]
        order = order[value[order] > RANK * max(value.max(), 0.0)]
        value, vector = value[order], vector[:, order]
        side = np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(len(order))])
        self.axes = vector * side / np.sqrt(value)
        trace = sum(n * _of(sums, d, d) - total[d] ** 2 for d in range(dims)) / (n * n)
        self.explained = value / trace if trace else value

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x less the whole part of the mean (exact), and x less the mean."""
        d = x - np.array(self.quotient, np.int64)
        return d, d - np.array([r / self.n for r in self.rest])

    def deviations(self, d: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2 of each row, exact: n d - rest is n x - S."""
        most = int(np.abs(d).max(initial=0))
        wide = d if most * max(most, self.n) * d.shape[1] < 1 << 62 else d.astype(object)
        squares, mixed = (wide * wide).sum(axis=1), (wide * np.array(self.rest, wide.dtype)).sum(axis=1)
        last = sum(r * r for r in self.rest)
        return [self.n * (self.n * int(a) - 2 * int(b)) + last for a, b in zip(squares, mixed, strict=True)]


def _of(sums: dict[tuple[int, int], int], a: int, b: int) -> int:
    return sums[a, b] if (a, b) in sums else sums[b, a]


def fit(vectors: DataFrame, k: int) -> tuple[Whitening, float] | None:
    """The whitening of distinct vectors (``x``: whole numbers), and its identity error; None without vectors.

    The driver gets one row for each pair of dimensions, whatever the number of vectors.
    """
    size = vectors.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).head()
    if size["most"] is None:
        return None
    if size["least"] != size["most"]:
        raise ValueError(f"vectors of {size['least']} and of {size['most']} entries in one table")
    dims = size["most"]
    limbs = [f"limb{i}" for i in range(LIMBS)]
    rows = vectors.select("x").mapInArrow(_scatter, "i int, j int, " + ", ".join(f"{c} long" for c in limbs)).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in limbs]).collect()
    model = Whitening({(r["i"], r["j"]): sum(r[c] << WIDTH * at for at, c in enumerate(limbs)) for r in rows}, dims, k)
    return model, identity_error(vectors, model)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, summed over the vectors themselves."""
    k = model.axes.shape[1]

    def moments(batches):
        total = np.zeros((k, k))
        for x in _blocks_of(batches):
            w = model.centred(x)[1] @ model.axes
            total += w.T @ w
        i, j = np.indices((k, k))
        yield record_batch(pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())]), {"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    rows = vectors.select("x").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max((abs(r["s"] / model.n - (r["i"] == r["j"])) for r in rows), default=0.0)


def whiten(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 16) -> DataFrame:
    """Each vector on the first ``k`` principal components of the distinct ones, scaled to unit variance.

    Columns: ``key``, component (from 1, by falling variance), n (distinct vectors), deviation
    (exact sum of (n x - S)^2; null where it is beyond a long), whitened, explained (share of the
    variance), identity_error (one value), deviation_exact (the same deviation as decimal(38,0)).

    Rows without a usable vector (null, empty, with an entry that is null or not finite) are left
    out. Repeated rows are fitted once and all returned. Components without variance do not exist:
    a table of fewer directions than ``k`` gives fewer rows each, a table of one distinct vector or
    none gives no rows. Vectors of different lengths, or with entries of 2^60 / 64 and more, are an
    error. Other columns are left out; ``key`` may have any name but those above.
    """
    made = [("component", IntegerType()), ("n", LongType()), ("deviation", LongType()), ("whitened", DoubleType()), ("explained", DoubleType()), ("identity_error", DoubleType()), ("deviation_exact", DecimalType(38, 0))]
    if key.lower() in [name for name, _ in made]:
        raise ValueError(f"the key cannot be named {key}")
    schema = StructType([StructField(key, rows.schema[key].dataType), *(StructField(*f) for f in made)])
    usable = rows.select(F.col(key).alias("id"), whole_numbers(vector).alias("x")).where("x is not null")
    distinct = written(usable.select("x").distinct())
    found = fit(distinct, k)
    discard(distinct)
    if found is None or not found[0].axes.shape[1]:
        return rows.sparkSession.createDataFrame([], schema)
    model, error = found
    width = model.axes.shape[1]

    def project(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                d, x = model.centred(as_matrix(part.column("x")))
                each = np.repeat(np.arange(len(d)), width)
                exact = model.deviations(d)
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(d))), pa.array(np.full(len(each), model.n)),
                    pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()).take(pa.array(each)), pa.array((x @ model.axes).ravel()), pa.array(np.tile(model.explained, len(d))), pa.array(np.full(len(each), error)),
                    pa.array([v if v < 10**38 else None for v in exact], pa.decimal128(38, 0)).take(pa.array(each)),
                ], names=schema.names)

    return usable.mapInArrow(project, schema)
