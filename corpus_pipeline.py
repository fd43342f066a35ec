"""From raw documents to packed training sequences: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlematch.llm import jaccard, packing, pii, quality, toxicity
from settlematch.llm.common import table
from settlematch.storage import written


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose labelled neighbours call them good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without significant toxic passages."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 80 % of their 5-word shingles."""
    return jaccard.keep_one_of_each(docs, width=5, num=80, den=100)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers, plain and disguised, replaced by their kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of at most 1024."""
    import public_tokenizers

    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2), 1024)


STAGES = [
    ("quality", drop_low_quality),
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores decide the first two stages, which SQL cannot express; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars"))
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
