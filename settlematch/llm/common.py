"""Small shared pieces of the ``llm`` operators."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def byte_blocks(batches, size: int = 4 << 20, rows: int = 512, column: str = "text"):
    """Arrow batches cut into slices of at most ``rows`` rows and about ``size`` bytes of text; a longer text comes alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        at, held = 0, 0
        for i, n in enumerate(lengths):
            if i > at and (held + n > size or i - at == rows):
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at, batch.num_rows - at)


def record_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


def held_out(column: str = "doc_id"):
    """True for rows kept out of every fit: crc32 of the id as text, divisible by five."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0
