"""Results broken down by defect, rule, exception and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlematch.functions.stats import call_cost_usd, safe_div, wilson_interval

#: A property of every bundled payout, which tells nothing apart.
UNINFORMATIVE = ("bundled_payout",)


def defect_breakdown(verdicts: DataFrame, tags: DataFrame) -> DataFrame:
    """verdicts: link_type, payment_id, resolved (resolvable payments only); tags: payment_id, tag.

    Marginal rates count every payment with the tag, isolated ones those with no other; the lift
    is the isolated rate over that of payments without tags, in points.
    """
    tags = tags.where(~F.col("tag").isin(*UNINFORMATIVE)).select("payment_id", "tag").distinct()
    count = tags.groupBy("payment_id").agg(F.count("*").alias("n_tags"))
    hit = F.col("resolved").cast("int")
    clean = verdicts.join(count, "payment_id", "left_anti").groupBy("link_type").agg((F.sum(hit) / F.count("*")).alias("clean"))
    rows = verdicts.join(tags, "payment_id").join(count, "payment_id").withColumn("alone", F.col("n_tags") == 1)
    per = rows.groupBy("link_type", "tag").agg(
        F.count("*").alias("n"), F.sum(hit).alias("resolved"),
        F.count(F.when(F.col("alone"), 1)).alias("isolated_n"), F.sum(F.when(F.col("alone"), hit).otherwise(0)).alias("isolated_resolved"),
    ).join(F.broadcast(clean), "link_type", "left")  # one row per leg
    low, high = wilson_interval(F.col("isolated_resolved"), F.col("isolated_n"))
    alone = F.col("isolated_resolved") / F.nullif(F.col("isolated_n"), F.lit(0))
    return per.select(
        "link_type", "tag", "n", "resolved", F.round(safe_div(F.col("resolved"), F.col("n")), 6).alias("rate"), "isolated_n", "isolated_resolved",
        F.round(alone, 6).alias("isolated_rate"), F.round(low, 6).alias("isolated_lo"), F.round(high, 6).alias("isolated_hi"), F.round(100 * (alone - F.col("clean")), 4).alias("lift_points"),
    )


def layer_breakdown(matches: DataFrame, truth_edges: DataFrame) -> DataFrame:
    """Per layer, rule and leg: edges asserted (repeats kept), distinct ones that are true, precision."""
    asserted = matches.select("layer", "rule", "link_type", "payment_id", F.explode("counterpart_ids").alias("counterpart_id"))
    known = truth_edges.select("link_type", "payment_id", "counterpart_id").distinct().withColumn("ok", F.lit(True))
    per = asserted.join(known, ["link_type", "payment_id", "counterpart_id"], "left").groupBy("layer", "rule", "link_type", "payment_id", "counterpart_id").agg(F.count("*").alias("m"), F.max("ok").alias("ok"))
    out = per.groupBy("layer", "rule", "link_type").agg(F.sum("m").alias("asserted"), F.count("ok").alias("correct"))
    low, high = wilson_interval(F.col("correct"), F.col("asserted"))
    return out.select("*", F.round(safe_div(F.col("correct"), F.col("asserted")), 6).alias("precision"), F.round(low, 6).alias("precision_lo"), F.round(high, 6).alias("precision_hi"))


def judged_exceptions(exceptions: DataFrame, truth_edges: DataFrame, known_payments: DataFrame, orphans: DataFrame) -> DataFrame:
    """Each exception with ``right``: the payment has no true counterpart on that leg, or the counterpart is an orphan."""
    tied = truth_edges.select("link_type", F.col("payment_id").alias("subject_id")).distinct().withColumn("tied", F.lit(1))
    payments = known_payments.select(F.col("payment_id").alias("subject_id"), F.lit(1).alias("known")).distinct()
    of_payments = exceptions.where("subject_type = 'payment'").join(tied, ["link_type", "subject_id"], "left").join(payments, "subject_id", "left").withColumn("right", F.col("known").isNotNull() & F.col("tied").isNull()).drop("tied", "known")
    orphan = orphans.select("subject_type", "subject_id").distinct().withColumn("orphan", F.lit(1))
    others = exceptions.where("subject_type <> 'payment'").join(orphan, ["subject_type", "subject_id"], "left").withColumn("right", F.col("orphan").isNotNull()).drop("orphan")
    return of_payments.unionByName(others)


def exception_breakdown(judged: DataFrame) -> DataFrame:
    n, right = F.count("*"), F.count(F.when(F.col("right"), 1))
    return judged.groupBy("reason", "subject_type").agg(n.alias("total"), right.alias("correctly_raised"), (n - right).alias("missed"), F.round(right / n, 6).alias("precision"))


def cost_breakdown(calls: DataFrame, prices: DataFrame, records: int, reaching: int = 0, miss: str = "no recorded answer") -> DataFrame:
    """Totals of a call log, per hundred records where a rate is meant; ``reaching``: records that came to the third layer."""
    rows = calls.join(F.broadcast(prices), "model", "left")  # a price list
    cost = call_cost_usd(F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens"), F.col("in_rate"), F.col("out_rate"))
    per = 100.0 / records
    return rows.agg(
        F.count("*").alias("calls"), (F.count("*") - F.count(F.when(F.col("error") == miss, 1))).alias("answered"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum(cost), 6).alias("cost_usd"), F.round(F.sum(cost) * per, 6).alias("cost_per_100"), F.round(F.count("*") * F.lit(per), 6).alias("calls_per_100"),
        F.round(F.sum("latency_ms") / 1000 * per, 6).alias("seconds_per_100"), F.round(F.avg("latency_ms"), 6).alias("latency_ms_mean"), F.lit(reaching).cast("long").alias("records_reaching_layer3"), F.bool_and("replayed").alias("all_replayed"),
        F.count(F.when(~F.col("schema_valid"), 1)).alias("schema_failures"), F.count("error").alias("errors"),
    )


def layer3_payment_count(matches: DataFrame) -> DataFrame:
    return matches.where("layer = 'l3_llm'").agg(F.count_distinct("payment_id").alias("payments"))


def measure_tolerances(payments: DataFrame, batches: DataFrame, bank: DataFrame, invoices: DataFrame, truth_bank: DataFrame, truth_invoice: DataFrame) -> DataFrame:
    """Distributions behind the rules' windows, over true links: issue-to-capture lag, paise off the batch total, days from settlement to value date."""
    lag = truth_invoice.join(invoices.select(F.col("invoice_id").alias("counterpart_id"), "issue_date"), "counterpart_id").join(payments.select("payment_id", "captured_on"), "payment_id")
    first = lag.agg(F.expr("percentile(datediff(captured_on, issue_date), 0.99)").alias("issue_lag_p99"))
    pairs = truth_bank.select("settlement_id", F.col("counterpart_id").alias("txn_id")).distinct().join(bank, "txn_id").join(batches, "settlement_id")
    off = F.least(F.abs(F.col("credit") - F.col("expected_credit")), F.abs(F.col("credit") - F.col("expected_credit_dedup")))
    second = pairs.agg(F.max(off).alias("largest_residual"), F.max(F.datediff("value_date", "settled_date")).alias("largest_value_lag"))
    return first.crossJoin(second)  # one row each
