"""Token ids as Parquet lists that can be read in part.

A token table is a folder with two Parquet tables. ``tokens`` holds a row per document in order
of id: the file's number, the place of its first token within the file, how many there are, and
the ids. Ids are dictionary encoded (or delta encoded), the other columns delta encoded; row
groups and pages have a set size and every page has its limits in the page index, so a reader that
asks for some documents, or for a stretch of the token stream, skips the other pages. ``index``
holds a row per file with its first and last id and its place in the whole stream.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from settlematch.llm.common import byte_blocks, record_batch
from settlematch.llm.packing import encoder

TOKENS = "file int, at long, n_tokens long, doc_id long, ids array<int>"
_ROWS = pa.schema([("file", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_SUMS = pa.schema([("file", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("doc_id", pa.int64()), ("ids_crc32", pa.int64())])


def layout(encoding: str, row_group: int, page: int, page_rows: int) -> dict[str, str]:
    """Writer options: sizes in bytes, encodings by column. The page index is always written."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding of ids: {encoding}")
    return {
        "parquet.writer.version": "PARQUET_2_0",  # whole numbers without a dictionary are delta encoded
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        "parquet.dictionary.page.size": str(4 << 20),  # room for every id of a large vocabulary
        "parquet.block.size.row.check.min": "10", "parquet.page.size.row.check.min": "10",  # rows differ much in size
        "parquet.block.size": str(row_group), "parquet.page.size": str(page), "parquet.page.row.count.limit": str(page_rows), "compression": "zstd",
    }


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int, *, encoding: str = "dictionary", row_group: int = 16 << 20, page: int = 64 << 10, page_rows: int = 1000) -> None:
    """Encode every whole text, close it with ``end_id``, and write the table at ``path`` in ascending ``doc_id``.

    One shuffle deals rows to files by ranges of (doc_id, hash of the text, place in the input), so
    that not even one much repeated id makes a large file; tasks encode their range in order and
    count as they go. Null texts are empty; a null id comes first; rows of one id follow each
    other in order of the text's hash. Other columns are left out. A table without rows has no files.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row")]
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})

    def encode(batches):
        ids_of, number, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in byte_blocks(batches):
            ids = [np.array([*ids_of(text), end_id], np.int32) for text in batch.column("text").to_pylist()]
            n = np.array([len(x) for x in ids], np.int64)
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.concatenate(ids)))
            yield record_batch(_ROWS, {"file": np.full(len(n), number, np.int32), "at": at + ends - n, "n_tokens": n, "doc_id": batch.column("doc_id"), "ids": lists})
            at += int(ends[-1])

    encoded = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(encode, TOKENS)
    encoded.write.mode("overwrite").options(**layout(encoding, row_group, page, page_rows)).parquet(f"{path}/tokens")
    _write_index(documents.sparkSession, path)


def _write_index(spark: SparkSession, path: str) -> None:
    """One row per file, from the metadata columns alone; its place is the sum of all files before it."""
    files = _tokens(spark, path).groupBy("file").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as files
    files.withColumn("file_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENS).parquet(f"{path}/tokens")


def index(spark: SparkSession, path: str) -> DataFrame:
    """file, documents, n_tokens, first_id, last_id, file_start of every file."""
    return spark.read.schema("file int, documents long, n_tokens long, first_id long, last_id long, file_start long").parquet(f"{path}/index")


def _placed(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    starts = index(spark, path).select("file", "file_start")
    return rows.join(starts, "file").withColumn("start", F.col("file_start") + F.col("at")).drop("file", "at", "file_start")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, start of every document; ids are not read."""
    return _placed(_tokens(spark, path).select("file", "at", "n_tokens", "doc_id"), spark, path)


def documents_between(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """doc_id, n_tokens, ids, start of the documents with ids from ``first`` to ``last``; pages of others are skipped."""
    return _placed(_tokens(spark, path).where(F.col("doc_id").between(first, last)), spark, path)


def stream_between(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """doc_id, start, ids: the tokens at places ``start`` to ``end`` - 1 of the whole stream, a row for each document they lie in.

    The index tells which files hold them; their places in the files are compared in the scan.
    """
    if end <= start:
        return _tokens(spark, path).select("doc_id", F.lit(0).cast("long").alias("start"), "ids").where("false")
    held = index(spark, path).where((F.col("file_start") < end) & (F.col("file_start") + F.col("n_tokens") > start))
    ends = held.agg(F.min(F.struct("file", "file_start")).alias("a"), F.max(F.struct("file", "file_start")).alias("b")).head()
    if ends["a"] is None:
        return stream_between(spark, path, 0, 0)
    (first, first_start), (last, last_start) = ends
    after_start = (F.col("file") > first) | (F.col("at") + F.col("n_tokens") > start - first_start)
    before_end = (F.col("file") < last) | (F.col("at") < end - last_start)
    rows = _placed(_tokens(spark, path).where(F.col("file").between(first, last) & after_start & before_end), spark, path)
    skip = F.greatest(start - F.col("start"), F.lit(0))
    taken = F.least(end - F.col("start"), F.col("n_tokens")) - skip
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), taken.cast("int")).alias("ids"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, all from the files; the checksum is of little-endian unsigned 32-bit ids."""

    def check(batches):
        for batch in batches:
            ids = batch.column("ids")
            ends, flat = np.asarray(ids.offsets), np.asarray(ids.values)
            sums = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield record_batch(_SUMS, {"file": batch.column("file"), "at": batch.column("at"), "n_tokens": np.diff(ends).astype(np.int64), "doc_id": batch.column("doc_id"), "ids_crc32": sums})

    rows = _tokens(spark, path).select("file", "at", "doc_id", "ids").mapInArrow(check, "file int, at long, n_tokens long, doc_id long, ids_crc32 long")
    return _placed(rows, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
