"""First layer: identifiers that occur on exactly one free counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _unique_join(subjects: DataFrame, subject: str, rows: DataFrame, name: str, key: str, claimed: DataFrame | None, rule: str) -> DataFrame:
    free = rows.where(F.col(key).isNotNull())
    if claimed is not None:
        free = free.join(claimed, name, "left_anti")
    once = free.groupBy(key).agg(F.count("*").alias("n"), F.min(name).alias("counterpart_id")).where("n = 1").drop("n")
    # null keys stay out of the shuffle; two subjects with one key both get the counterpart
    return subjects.where(F.col(key).isNotNull()).join(once, key).select(F.col(subject).alias("subject_id"), "counterpart_id", F.lit("l1_exact").alias("layer"), F.lit(rule).alias("rule"), F.lit(0.99).alias("confidence"))


def l1_utr_column_join(batches: DataFrame, bank: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    return _unique_join(batches, "settlement_id", bank, "txn_id", "utr", claimed, "l1_utr_column_join")


def l1_order_id_join(payments: DataFrame, invoices: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    return _unique_join(payments, "payment_id", invoices, "invoice_id", "order_id", claimed, "l1_order_id_join")
