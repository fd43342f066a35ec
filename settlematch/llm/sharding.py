"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

A uniformly random permutation of N rows cut into shards sends a random number of rows from
every source partition to every shard. Those numbers follow the multivariate hypergeometric
law, so they can be drawn first, on counts alone: one row of the matrix per source partition,
conditioned on what the shards still lack. Each source partition then permutes its rows locally
and deals them out by the drawn counts, the rows travel once, and every shard permutes what
arrived. Shard sizes are exact by construction.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from settlematch.storage import written


def shard_sizes(total: int, shards: int) -> np.ndarray:
    """Sizes at most one apart that sum to ``total``."""
    return np.full(shards, total // shards, np.int64) + (np.arange(shards) < total % shards)


def communication_matrix(counts: dict[int, int], shards: int, seed: int) -> dict[int, list[int]]:
    """Rows that each source partition sends to each shard.

    Drawn partition by partition from the hypergeometric law over the shards' open places.
    Every row sums to its partition's count, every column to the shard's size.
    """
    rng, open_places, matrix = np.random.default_rng(seed), shard_sizes(sum(counts.values()), shards), {}
    for part in sorted(counts):
        drawn, left, pool = [], counts[part], int(open_places.sum())
        for places in open_places.tolist():
            pool -= places
            n = hypergeometric(rng, places, pool, left)
            drawn.append(n)
            left -= n
        open_places = open_places - np.array(drawn, np.int64)
        matrix[part] = drawn
    return matrix


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` draws without replacement are good; numpy's sampler where it takes the numbers."""
    if not sample or not good:
        return 0
    if max(good, bad) < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, sample))
    return by_ratio_of_uniforms(rng, good, bad, sample)


def by_ratio_of_uniforms(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """The same by rejection from a ratio of uniforms, for counts of any size.

    Proposals are accepted by the exact probability over that of the mode. Factorials enter only as
    quotients of near ones (:func:`_log_quotient`), so nothing large cancels.
    """
    total = good + bad
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    mean, share = sample * good / total, good / total
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(sample * share * (bad / total) * ((total - sample) / (total - 1)) + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    mode = min(max((sample + 1) * (good + 1) // (total + 2), low), high)
    while True:
        u, v = rng.random(2)
        x = math.floor(mean + 0.5 + width * (v - 0.5) / u) if u else low - 1
        if not low <= x <= high:
            continue
        d = x - mode
        log_ratio = -(_log_quotient(mode, d) + _log_quotient(good - mode, -d) + _log_quotient(sample - mode, -d) + _log_quotient(bad - sample + mode, d))
        if 2 * math.log(u) <= log_ratio:
            return x


def _log_quotient(n: int, d: int) -> float:
    """log((n + d)! / n!): a sum where it is short or n is small, else Stirling's series term by term."""
    if abs(d) < 64 or min(n, n + d) < 1000:
        lo, hi = sorted((n, n + d))
        part = float(np.log(np.arange(lo + 1, hi + 1, dtype=np.float64)).sum())
        return part if d >= 0 else -part
    m = n + d
    return (m + 0.5) * math.log1p(d / n) + d * (math.log(n) - 1) + (1 / m - 1 / n) / 12 - (1 / m**3 - 1 / n**3) / 360


def shuffle_into_shards(rows: DataFrame, shards: int, *, key: Column, seed: int = 20, most_parts: int = 16_384, most_lanes: int = 4096, each: int = 1_000_000) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    rows   the slim rows to place: ids and sizes, not texts. They are written once to the shared
           folder, which pins the source partitions.
    key    column mixed into the random order; rows may share it, repeat or have nulls there.
    each   rows that one task should permute: the number of source partitions told apart (256 to
           ``most_parts``) and of lanes (16 to ``most_lanes``), the ranges of the random order that a
           shard's last permutation is cut into, follow from it and the number of rows.

    The driver sees at most ``most_parts`` x ``shards`` counts. An empty table gives an empty
    result. Repeated rows are placed one by one. Columns of ``rows`` that are named shard or slot,
    in any case, are replaced. The same files and split size give the same placement.
    """
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    # the rows travel in one struct, so that no name of theirs can be one of the names used here
    row = [F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("_row")] if names else []
    here = written(rows.select(*row, F.spark_partition_id().alias("_raw"), F.monotonically_increasing_id().alias("_at"), key.alias("_key")))
    total = here.count()
    parts, lanes = min(max(total // each, 256), most_parts), min(max(total // (each * shards), 16), most_lanes)
    here = here.withColumn("_part", F.col("_raw") % parts).drop("_raw")
    counts = {r["_part"]: r["n"] for r in here.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix(counts, shards, seed)
    # at most most_parts x shards numbers: a bound that does not grow with the rows
    until = F.broadcast(here.sparkSession.createDataFrame([(p, np.cumsum(m).tolist()) for p, m in matrix.items()], "_part int, _until array<long>"))

    def draw(stage: int) -> Column:
        return F.xxhash64(F.lit(seed * 8 + stage), "_key", "_at")

    ranked = here.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(draw(1), "_at")))
    sent = ranked.join(until, "_part").withColumn("shard", F.size(F.filter("_until", lambda x: x < F.col("_rank"))))
    sent = written(sent.withColumn("_draw", draw(2)).withColumn("_lane", F.pmod(F.shiftright("_draw", 48), F.lit(lanes)).cast("int")).select(*(["_row"] if names else []), "shard", "_lane", "_draw", "_at"))
    lane = Window.partitionBy("shard").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "_lane").agg(F.count("*").alias("_n")).select("shard", "_lane", F.coalesce(F.sum("_n").over(lane), F.lit(0)).alias("_start"))
    slot = F.row_number().over(Window.partitionBy("shard", "_lane").orderBy("_draw", "_at"))
    # at most shards x most_lanes rows
    return sent.withColumn("_slot", slot).join(F.broadcast(starts), ["shard", "_lane"]).select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)], "shard", (F.col("_start") + F.col("_slot") - 1).alias("slot"))
