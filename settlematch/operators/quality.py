"""Checks that sources and truth hold together; each gives its violations."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _broken(rows: DataFrame, rule: str, subject: str, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(subject).alias("subject_id"), detail.alias("detail"))


def check_money_invariants(payments: DataFrame) -> DataFrame:
    """Parts add up to the net, deductions lead from gross to net, gross is positive."""
    left = F.col("gross") - F.col("fee") - F.col("tax") - F.col("tds")
    return _broken(payments.where(left != F.col("net")), "net_of_deductions", "payment_id", (left - F.col("net")).cast("string")).unionByName(_broken(payments.where("gross <= 0"), "gross_positive", "payment_id", F.col("gross").cast("string")))


def check_batch_tieout(batches: DataFrame, bank: DataFrame, truth_bank: DataFrame, tagged: DataFrame, payments: DataFrame, allowed: int = 5) -> DataFrame:
    """A batch's credit equals its total (not below zero), and it settles no earlier than its last capture; ``tagged`` batches may be off by ``allowed`` paise."""
    pairs = truth_bank.select("settlement_id", F.col("counterpart_id").alias("txn_id")).distinct().join(batches, "settlement_id").join(bank, "txn_id")
    off = F.col("credit") - F.greatest(F.lit(0), F.col("expected_credit"))
    limit = F.when(F.col("tagged").isNotNull(), allowed).otherwise(0)
    rows = pairs.join(tagged.select("settlement_id", F.lit(1).alias("tagged")).distinct(), "settlement_id", "left")
    off_total = _broken(rows.where(F.abs(off) > limit), "credit_is_total", "settlement_id", off.cast("string"))
    last = payments.select("captured_on", F.explode("settlement_ids").alias("settlement_id")).groupBy("settlement_id").agg(F.max("captured_on").alias("last"))
    early = batches.join(last, "settlement_id").where("settled_date < last")
    return off_total.unionByName(_broken(early, "settled_after_capture", "settlement_id", F.col("last").cast("string")))


def check_references(payments: DataFrame, truth: DataFrame, truth_edges: DataFrame, bank: DataFrame, invoices: DataFrame, orphans: DataFrame) -> DataFrame:
    """Ids of the truth and its orphans exist, both sides know the same payments, and no payment is in two splits."""
    ids = bank.select(F.col("txn_id").alias("counterpart_id")).unionByName(invoices.select(F.col("invoice_id").alias("counterpart_id")))
    dangling = truth_edges.join(ids, "counterpart_id", "left_anti")
    unknown = truth.join(payments.select("payment_id"), "payment_id", "left_anti")
    extra = payments.join(truth.select("payment_id"), "payment_id", "left_anti")
    twice = truth.groupBy("payment_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")
    out = _broken(dangling, "counterpart_exists", "counterpart_id", F.col("payment_id"))
    out = out.unionByName(_broken(orphans.join(ids, F.col("subject_id") == F.col("counterpart_id"), "left_anti"), "orphan_exists", "subject_id", F.col("subject_type")))
    for rows, rule in ((unknown, "payment_in_report"), (extra, "payment_in_truth"), (twice, "one_split")):
        out = out.unionByName(_broken(rows, rule, "payment_id", F.lit("")))
    return out


def check_defect_coverage(counts: list[DataFrame], wanted: DataFrame) -> DataFrame:
    """Tags asked for that none of the count tables (payments' own, batches', payments riding in them) holds."""
    known = functools.reduce(DataFrame.unionByName, [t.select("tag").distinct() for t in counts])
    return wanted.select("tag").join(known, "tag", "left_anti")
