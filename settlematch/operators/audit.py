"""Tables to look single answers up in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_verdicts(matches: DataFrame, truth_edges: DataFrame) -> DataFrame:
    """Each match against the truth: correct (sets equal), partial (a part of it, nothing else) or incorrect."""
    truth = truth_edges.groupBy("link_type", "payment_id").agg(F.sort_array(F.collect_set("counterpart_id")).alias("expected"))
    rows = matches.join(truth, ["link_type", "payment_id"], "left").withColumn("expected", F.coalesce("expected", F.expr("cast(array() as array<string>)")))
    got = F.array_distinct("counterpart_ids")
    extra, missing = F.array_except(got, F.col("expected")), F.array_except(F.col("expected"), got)
    verdict = F.when((F.size(extra) == 0) & (F.size(missing) == 0), "correct").when((F.size(extra) == 0) & (F.size(got) > 0), "partial").otherwise("incorrect")
    return rows.select("match_id", "link_type", "payment_id", "rule", "confidence", verdict.alias("verdict"), F.array_join(F.sort_array("counterpart_ids"), ",").alias("counterparts"), F.array_join("expected", ",").alias("expected"), F.array_join(missing, ",").alias("missing"))


def exception_verdicts(judged: DataFrame) -> DataFrame:
    return judged.select("exception_id", "subject_type", "subject_id", "link_type", "reason", F.when(F.col("right"), "rightly_open").otherwise("missed").alias("verdict"))


def audit_rows(matches: DataFrame, payments: DataFrame, bank: DataFrame, invoices: DataFrame) -> DataFrame:
    """A row per match and counterpart with the records behind it and one text to search."""
    rows = matches.select("match_id", "link_type", "payment_id", "layer", "rule", "confidence", F.explode("counterpart_ids").alias("counterpart_id"))
    both = bank.select(F.col("txn_id").alias("counterpart_id"), F.col("credit").alias("counterpart_amount"), F.col("value_date").alias("counterpart_date"), F.col("narration").alias("said"))
    ledger = invoices.select(F.col("invoice_id").alias("counterpart_id"), F.col("invoice_amount").alias("counterpart_amount"), F.col("issue_date").alias("counterpart_date"), F.coalesce("order_id", F.lit("")).alias("said"))
    records = rows.join(both.unionByName(ledger), "counterpart_id").join(payments.select("payment_id", "gross", "net", F.coalesce("order_id", F.lit("")).alias("order_id")), "payment_id")
    return records.withColumn("searchable", F.lower(F.concat_ws(" ", "payment_id", "order_id", "counterpart_id", "rule", "said")))


def trace_payment(matches: DataFrame, exceptions: DataFrame, payment_id: str) -> DataFrame:
    """Every match, evidence line and exception of one payment."""
    found = matches.where(F.col("payment_id") == payment_id).select(F.lit("match").alias("kind"), "link_type", F.col("rule").alias("about"), F.posexplode("evidence").alias("line", "text"))
    open_ = exceptions.where((F.col("subject_type") == "payment") & (F.col("subject_id") == payment_id)).select(F.lit("exception").alias("kind"), "link_type", F.col("reason").alias("about"), F.posexplode("evidence").alias("line", "text"))
    return found.unionByName(open_)
