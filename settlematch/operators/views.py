"""Payments, refunds and payout batches rebuilt from the settlement report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from settlematch.operators.order import running_sum


def local_date(iso: Column) -> Column:
    """The row's own date: the first ten characters, whatever the offset behind them."""
    return F.try_to_timestamp(F.substring(iso, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def payment_views(gateway: DataFrame) -> DataFrame:
    """One row per payment. The capture row (largest amount; earliest on ties) gives ids, fees and capture time."""
    rows = gateway.where((F.col("entity_type") == "payment") & F.col("payment_id").isNotNull())
    at = F.coalesce("settled_at", "created_at")
    head = F.struct("order_id", "order_receipt", "method", F.col("amount").alias("gross"), "fee", "tax", "tds", "captured_at")
    order = F.struct((-F.col("amount")).alias("a"), at.alias("t"), "entity_id", "settlement_id")
    line = F.sort_array(F.collect_list(F.struct(at.alias("t"), "entity_id", "settlement_id", "settlement_utr", local_date(F.col("settled_at")).alias("settled"))))
    grouped = rows.groupBy("payment_id").agg(F.min_by(head, order).alias("head"), F.sum("credit").alias("net"), F.count("*").alias("row_count"), line.alias("line"))

    def known(name: str) -> Column:
        return F.filter(F.transform("line", lambda x: x[name]), lambda v: v.isNotNull())

    return grouped.select(
        "payment_id", "head.*", "net",
        known("settlement_id").alias("settlement_ids"), known("settlement_utr").alias("settlement_utrs"), known("settled").alias("settled_dates"),
        "row_count", local_date(F.col("head.captured_at")).alias("captured_on"),
    )


def refund_views(gateway: DataFrame) -> DataFrame:
    return gateway.where(F.col("entity_type").isin("refund", "adjustment")).select("entity_id", "entity_type", "payment_id", F.col("debit").alias("amount"), "settlement_id", "settlement_utr", "created_at")


def _repeats(gateway: DataFrame) -> DataFrame:
    """Rows of batches, with whether each is a refund seen before in its batch (same payment and debit)."""
    seen = Window.partitionBy("settlement_id", "payment_id", "debit").orderBy("created_at", "entity_id")
    rows = gateway.where(F.col("settlement_id").isNotNull())
    debits = rows.where("debit <> 0").withColumn("repeat", (F.row_number().over(seen) > 1) & (F.col("entity_type") == "refund"))
    return debits.unionByName(rows.where("debit = 0").withColumn("repeat", F.lit(False)))


def settlement_batches(gateway: DataFrame) -> DataFrame:
    """One row per payout batch: totals as reported and with repeated refunds left out, and how many payments, refunds and adjustments.

    A batch's row does not grow with the batch; who is in it are the rows of :func:`batch_members`.
    """
    kind = F.col("entity_type")
    grouped = _repeats(gateway).groupBy("settlement_id").agg(
        F.when(F.min("settlement_utr") == F.max("settlement_utr"), F.min("settlement_utr")).alias("utr"),
        F.min(local_date(F.col("settled_at"))).alias("settled_date"),
        (F.sum("credit") - F.sum("debit")).alias("expected_credit"),
        (F.sum("credit") - F.sum(F.when(F.col("repeat"), 0).otherwise(F.col("debit")))).alias("expected_credit_dedup"),
        F.max("repeat").alias("has_duplicate_refund_rows"),
        F.count_distinct(F.when(kind == "payment", F.col("payment_id"))).alias("n_payments"),
        F.count(F.when(kind == "refund", 1)).alias("n_refunds"), F.count(F.when(kind == "adjustment", 1)).alias("n_adjustments"),
    )
    return grouped


def batch_members(gateway: DataFrame) -> DataFrame:
    """settlement_id, kind, member_id: a row for each payment, refund and adjustment of each batch; a payment once."""
    rows = gateway.where(F.col("settlement_id").isNotNull())
    payments = rows.where("entity_type = 'payment' and payment_id is not null").select("settlement_id", F.lit("payment").alias("kind"), F.col("payment_id").alias("member_id")).distinct()
    others = rows.where(F.col("entity_type").isin("refund", "adjustment")).select("settlement_id", F.col("entity_type").alias("kind"), F.col("entity_id").alias("member_id"))
    return payments.unionByName(others)


#: Signs of batches are told modulo this.
SIGNS = 10**15


def batch_signs(members: DataFrame) -> DataFrame:
    """settlement_id, n, sign: how many members a batch has and a number that stands for them, in whatever order they come.

    Batches of the same members have the same sign, so that two reports are compared batch by batch without lists.
    """
    one = F.conv(F.substring(F.sha2(F.concat_ws(" ", "kind", "member_id"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return members.groupBy("settlement_id").agg(F.count("*").alias("n"), F.pmod(F.sum(one), F.lit(SIGNS)).cast("long").alias("sign"))


def with_member_lists(batches: DataFrame, members: DataFrame) -> DataFrame:
    """``batches`` with sorted lists of their members, for files that want them so; a list holds the whole batch."""
    lists = members.groupBy("settlement_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("member_id")))).alias(name) for kind, name in (("payment", "payment_ids"), ("refund", "refund_entity_ids"), ("adjustment", "adjustment_entity_ids"))])
    return batches.join(lists, "settlement_id", "left")


def duplicate_refund_rows(gateway: DataFrame) -> DataFrame:
    return _repeats(gateway).where("repeat").drop("repeat")


def running_balance(bank: DataFrame, opening: int, by: list[str] | None = None) -> DataFrame:
    """``bank`` with the balance after each row in order of value date and id.

    With ``by`` each account or split runs by itself. Ranges of the order add up first and rows
    within their range, so a day of very many rows is many tasks.
    """
    moved = running_sum(bank, by or [], ["value_date", "txn_id"], F.col("credit") - F.col("debit"), "balance")
    return moved.withColumn("balance", F.col("balance") + F.lit(opening))
