"""Who takes what by recorded decisions in subject order, settled for all subjects in rounds of joins.

A record answers one question, and its text lists what was on offer then. So a record that takes a
counterpart is a *claim*: it takes its ``chosen_id`` where at its subject's turn everything it listed
is free and everything else that would have stood there is taken, and it takes nothing otherwise.
Whether a counterpart is free depends on claims of earlier subjects alone. In a round a counterpart is sure
for a subject where no earlier subject has an open claim on it: it is then taken or free for good. A
claim that misses one of its conditions is dropped, one whose conditions are all sure and met takes.
Most claims of a neighbourhood fall with its first taker, so few rounds are left whatever the
number of subjects. After ``ROUNDS`` rounds, or where no more than ``SLICE`` claims are open, the first ``SLICE``
in subject order are settled in one task; the result does not depend on these numbers.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlematch.storage import discard, written

#: Rounds of joins before a slice is taken, and the claims of a slice; any numbers give the same result.
ROUNDS, SLICE = 8, 100_000

CLAIMS = "subject_id string, prompt_hash string, chosen_id string, free array<string>, gone array<string>"
TAKEN = "counterpart_id string, taker string"


def _checked(live: DataFrame, status: DataFrame) -> DataFrame:
    """Claims that no condition fails, with those that are not sure yet.

    status: counterpart_id, taker, and first: the first subject that may still claim it, where it is known.
    """
    asks = F.concat(F.transform("free", lambda x: F.struct(x.alias("counterpart_id"), F.lit(True).alias("wants_free"))), F.transform("gone", lambda x: F.struct(x.alias("counterpart_id"), F.lit(False).alias("wants_free"))))
    rows = live.select("subject_id", "prompt_hash", "chosen_id", F.explode(asks).alias("x")).select("subject_id", "prompt_hash", "chosen_id", "x.*").join(status, "counterpart_id", "left")
    is_taken = F.coalesce(F.col("taker") < F.col("subject_id"), F.lit(False))
    is_open = ~is_taken & (F.coalesce(F.col("first") < F.col("subject_id"), F.lit(False)) if "first" in status.columns else F.lit(True))
    wants_free = F.col("wants_free")
    return rows.groupBy("subject_id", "prompt_hash", "chosen_id").agg(
        F.bool_or(F.when(wants_free, is_taken).otherwise(~is_taken & ~is_open)).alias("missed"),
        F.collect_list(F.when(wants_free & is_open, F.col("counterpart_id"))).alias("free"), F.collect_list(F.when(~wants_free & is_open, F.col("counterpart_id"))).alias("gone"),
    ).where("not missed").drop("missed")


def _round(live: DataFrame, taken: DataFrame) -> DataFrame:
    """One round: claims that stay, with the conditions that are still open; ``won`` where none is."""
    first = live.groupBy(F.col("chosen_id").alias("counterpart_id")).agg(F.min("subject_id").alias("first"))
    return _checked(live, first.join(taken, "counterpart_id", "full_outer")).withColumn("won", F.size("free") + F.size("gone") == 0)


def one_by_one(claims: list[tuple[str, str, list[str], list[str]]]) -> list[tuple[str, str]]:
    """(counterpart, taker) of claims (subject, chosen, free, gone) that depend on each other alone."""
    taken: set[str] = set()
    out = []
    for subject, chosen, free, gone in sorted(claims, key=lambda c: c[0]):
        # what a subject takes itself is not gone at its own turn
        if not (out and out[-1][1] == subject) and taken.isdisjoint(free) and taken.issuperset(gone):
            taken.add(chosen)
            out.append((chosen, subject))
    return out


def _sliced(live: DataFrame, taken: DataFrame | None, n: int) -> tuple[DataFrame, DataFrame]:
    """What the first SLICE claims in subject order take, settled in one task, and the claims after them; a subject is taken whole or not at all."""
    inside = F.lit(True)
    if n > SLICE:  # none where one subject alone has so many: the next round settles it
        inside = F.col("subject_id") < live.select("subject_id").orderBy("subject_id").limit(SLICE).agg(F.max("subject_id")).head()[0]
    now = live.where(inside)

    def solve(batches):
        for table in [pa.Table.from_batches(x).to_pydict() for x in [list(batches)] if x]:
            out = one_by_one(list(zip(*(table[c] for c in ("subject_id", "chosen_id", "free", "gone")), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["counterpart_id", "taker"])

    return (now if taken is None else _checked(now, taken)).coalesce(1).mapInArrow(solve, TAKEN), live.where(~inside)


def settle_claims(claims: DataFrame) -> DataFrame:
    """counterpart_id, taker: what is taken by ``claims`` (the columns of CLAIMS), of which at most one of a subject can come true.

    free, gone: the counterparts that must be free, ``chosen_id`` among them, and those that must be taken.
    """
    live = written(claims.select("subject_id", "prompt_hash", "chosen_id", "free", "gone"))
    made, parts, n, turn = [live], [], live.count(), 0
    none = live.sparkSession.createDataFrame([], TAKEN)
    while n:
        turn += 1
        taken = functools.reduce(DataFrame.unionByName, parts) if parts else None
        if n <= SLICE or turn % (ROUNDS + 1) == 0:
            won, live = _sliced(live, taken, n)
            made.append(written(won))
            parts.append(made[-1])
        else:
            made.append(written(_round(live, none if taken is None else taken)))
            live = made[-1].where("not won").drop("won")
            parts.append(made[-1].where("won").select(F.col("chosen_id").alias("counterpart_id"), F.col("subject_id").alias("taker")))
        n = live.count()
    out = written(functools.reduce(DataFrame.unionByName, parts, none))
    for x in made:
        discard(x)
    return out
