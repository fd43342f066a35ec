"""Answers on disk: parts of a version are written apart and published together.

A version is a folder with matches, exceptions, scorecards and the call log. Nothing refers to it
until its manifest stands under the next free number; the manifest is written under another name
and renamed. A job that fails, or is killed, leaves the version before it as the newest, and of
two that publish at once one fails. Matches and exceptions are kept in buckets of their payment, so that
one payment's story is read from one bucket.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from settlematch.operators.audit import trace_payment

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def fingerprint(spark: SparkSession, folder: str) -> str:
    """Of the files below a folder: their names, sizes and times."""
    fs, at = _fs(spark, folder)
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()[:20]


def _bucket(payment: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(payment), F.lit(buckets)).cast("int")


def save(folder: str, matches: DataFrame, exceptions: DataFrame, scorecards: DataFrame | None = None, calls: DataFrame | None = None, *, buckets: int = BUCKETS, order: list[str] | None = None) -> int:
    """Write a version of the answer and publish it; gives its number.

    scorecards: a row per matcher and leg, kept as JSON. calls: the call log, kept as JSON lines in
    the ``order`` of its columns given (which are not kept themselves where they begin with an underscore).
    """
    spark = matches.sparkSession
    version = uuid.uuid4().hex
    at, parts = f"{folder}/{version}", {}
    for name, rows, who in (("matches", matches, "payment_id"), ("exceptions", exceptions, "subject_id")):
        kept = rows.withColumn("bucket", _bucket(F.col(who), buckets))
        kept.repartition("bucket").sortWithinPartitions("bucket", who).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{at}/{name}")
        parts[name] = json.loads(kept.schema.json())
    if scorecards is not None:
        scorecards.coalesce(1).write.json(f"{at}/scorecards")  # a few rows
        parts["scorecards"] = json.loads(scorecards.schema.json())
    if calls is not None:
        rows = calls.repartitionByRange(*order).sortWithinPartitions(*order) if order else calls
        rows = rows.select([c for c in rows.columns if not c.startswith("_")])
        rows.write.option("ignoreNullFields", "false").json(f"{at}/calls")
        parts["calls"] = json.loads(rows.schema.json())
    return _publish(spark, folder, {"version": version, "buckets": buckets, "parts": parts})


def _publish(spark: SparkSession, folder: str, manifest: dict) -> int:
    number = max((int(n[9:-5]) for n in _names(spark, folder) if n.startswith("manifest-")), default=0) + 1
    fs, draft = _fs(spark, f"{folder}/{manifest['version']}/manifest.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    _, place = _fs(spark, f"{folder}/manifest-{number:08d}.json")
    if fs.exists(place) or not fs.rename(draft, place):
        raise RuntimeError(f"version {number} of {folder} was published by another job")
    return number


@dataclass
class Results:
    """A published version."""

    spark: SparkSession
    at: str
    buckets: int
    parts: dict[str, dict]

    def part(self, name: str) -> DataFrame:
        """A part as it was saved, and ``bucket`` for matches and exceptions."""
        schema = StructType.fromJson(self.parts[name])
        read = self.spark.read.schema(schema)
        return read.parquet(f"{self.at}/{name}") if name in ("matches", "exceptions") else read.json(f"{self.at}/{name}")

    @property
    def matches(self) -> DataFrame:
        return self.part("matches").drop("bucket")

    @property
    def exceptions(self) -> DataFrame:
        return self.part("exceptions").drop("bucket")

    def trace(self, payment_id: str) -> DataFrame:
        """Every match, evidence line and exception of one payment, from one bucket of each table."""
        mine = F.col("bucket") == _bucket(F.lit(payment_id), self.buckets)
        return trace_payment(self.part("matches").where(mine), self.part("exceptions").where(mine), payment_id)


def latest(spark: SparkSession, folder: str) -> Results | None:
    """The newest published version, or None."""
    found = [n for n in _names(spark, folder) if n.startswith("manifest-")]
    if not found:
        return None
    fs, place = _fs(spark, f"{folder}/{found[-1]}")
    stream = fs.open(place)
    manifest = json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    stream.close()
    return Results(spark, f"{folder}/{manifest['version']}", manifest["buckets"], manifest["parts"])
