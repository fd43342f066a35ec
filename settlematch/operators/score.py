"""Answers held against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlematch.functions.stats import safe_div, wilson_interval


def edge_frame(truth_edges: DataFrame, predicted_edges: DataFrame) -> DataFrame:
    """payment_id, link_type, counterpart_id with in_truth and in_pred: one full outer join that the scores share."""
    keys = ["link_type", "payment_id", "counterpart_id"]
    t = truth_edges.select(keys).distinct().withColumn("t", F.lit(True))
    p = predicted_edges.select(keys).distinct().withColumn("p", F.lit(True))
    return t.join(p, keys, "full_outer").select(*keys, F.coalesce("t", F.lit(False)).alias("in_truth"), F.coalesce("p", F.lit(False)).alias("in_pred"))


def payment_frame(edges: DataFrame) -> DataFrame:
    """Per payment and leg: edges in truth and in the answer, and whether both sets are equal."""
    return edges.groupBy("link_type", "payment_id").agg(
        F.sum(F.col("in_truth").cast("int")).alias("n_truth"), F.sum(F.col("in_pred").cast("int")).alias("n_pred"),
        F.sum((F.col("in_truth") & F.col("in_pred")).cast("int")).alias("n_both"), F.bool_and(F.col("in_truth") == F.col("in_pred")).alias("exact"),
    )


def _rate(k: Column, n: Column, name: str) -> list[Column]:
    low, high = wilson_interval(k, n)
    return [F.round(safe_div(k, n), 6).alias(name), F.round(low, 6).alias(f"{name}_lo"), F.round(high, 6).alias(f"{name}_hi")]


def score_links(edges: DataFrame) -> DataFrame:
    """Per leg: edges, precision, recall, F1, and how many resolvable payments are exactly resolved or matched at all."""
    pay = payment_frame(edges)
    total = pay.groupBy("link_type").agg(
        F.sum("n_truth").alias("truth_edges"), F.sum("n_pred").alias("predicted_edges"), F.sum("n_both").alias("true_positives"),
        F.count(F.when(F.col("n_truth") > 0, 1)).alias("resolvable"),
        F.count(F.when((F.col("n_truth") > 0) & F.col("exact"), 1)).alias("exactly_resolved"),
        F.count(F.when((F.col("n_truth") > 0) & (F.col("n_pred") > 0), 1)).alias("matched"),
    )
    tp, p, t = F.col("true_positives"), F.col("predicted_edges"), F.col("truth_edges")
    return total.select(
        *total.columns, *_rate(tp, p, "precision"), *_rate(tp, t, "recall"), F.round(safe_div(2 * tp, p + t), 6).alias("f1"),
        *_rate(F.col("exactly_resolved"), F.col("resolvable"), "exact_rate"), F.round(safe_div(F.col("matched"), F.col("resolvable")), 6).alias("match_rate"),
    )


def score_honesty(payments: DataFrame, edges: DataFrame, payment_exceptions: DataFrame, link: str) -> DataFrame:
    """Payments without a true counterpart on a leg: sent to exceptions, or falsely matched."""
    pay = payment_frame(edges.where(F.col("link_type") == link))
    none = payments.select("payment_id").join(pay.where("n_truth > 0").select("payment_id"), "payment_id", "left_anti")
    raised = payment_exceptions.where(F.col("link_type") == link).select(F.col("subject_id").alias("payment_id")).distinct().withColumn("raised", F.lit(1))
    asserted = pay.where("n_pred > 0").select("payment_id", F.lit(1).alias("asserted"))
    both = none.join(raised, "payment_id", "left").join(asserted, "payment_id", "left")
    total = both.agg(F.count("*").alias("unresolvable"), F.count("raised").alias("routed_to_exceptions"), F.count("asserted").alias("falsely_matched"))
    return total.select(F.lit(link).alias("link_type"), "*", *_rate(F.col("falsely_matched"), F.col("unresolvable"), "false_match_rate"))


def score_counterparts(flagged: DataFrame, orphans: DataFrame) -> DataFrame:
    """Per kind: unused counterparts reported against true orphans."""
    f = flagged.select("subject_type", "subject_id").distinct().withColumn("f", F.lit(1))
    o = orphans.select("subject_type", "subject_id").distinct().withColumn("o", F.lit(1))
    both = f.join(o, ["subject_type", "subject_id"], "full_outer")
    total = both.groupBy("subject_type").agg(F.count("f").alias("flagged"), F.count("o").alias("orphans"), F.count(F.when(F.col("f").isNotNull() & F.col("o").isNotNull(), 1)).alias("correct"))
    return total.select("*", F.round(safe_div(F.col("correct"), F.col("flagged")), 6).alias("precision"), F.round(safe_div(F.col("correct"), F.col("orphans")), 6).alias("recall"))


def score_fully_reconciled(payments: DataFrame, edges: DataFrame) -> DataFrame:
    """Payments whose answers equal the truth on both legs; nothing expected and nothing asserted counts."""
    wrong = payment_frame(edges).where(~F.col("exact")).select("payment_id").distinct().withColumn("wrong", F.lit(1))
    total = payments.select("payment_id").join(wrong, "payment_id", "left").agg(F.count("*").alias("payments"), (F.count("*") - F.count("wrong")).alias("fully_reconciled"))
    return total.select("*", *_rate(F.col("fully_reconciled"), F.col("payments"), "rate"))


def exception_reasons(exceptions: DataFrame) -> DataFrame:
    return exceptions.groupBy("reason").agg(F.count("*").alias("n"))


def rule_calibration(breakdown: DataFrame) -> DataFrame:
    """Confidence per rule: observed precision rounded down to a percent, at most 0.99."""
    return breakdown.select("rule", F.least(F.floor(F.col("precision") * 100) / 100, F.lit(0.99)).alias("confidence"))


def ablation_summary(rates: DataFrame) -> DataFrame:
    """(seed, tag, rate), tag null for the baseline -> effect of each tag in points against its own seed's baseline."""
    base = rates.where("tag is null").select("seed", F.col("rate").alias("base"))
    delta = rates.where("tag is not null").join(base, "seed").withColumn("points", 100 * (F.col("rate") - F.col("base")))
    out = delta.groupBy("tag").agg(F.count("*").alias("seeds"), F.avg("points").alias("mean"), F.stddev_samp("points").alias("sd"))
    se = F.when(F.col("seeds") > 1, F.col("sd") / F.sqrt("seeds")).otherwise(0.0)
    return out.select("tag", "seeds", F.round("mean", 2).alias("mean_points"), F.round(se, 2).alias("standard_error"), (F.abs(F.col("mean")) > 2 * se).alias("above_noise"))
