"""Matchers without parameters: assert a link only where exactly one counterpart fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANK, INVOICE = "payment_to_bank", "payment_to_invoice"


def _verdict(found: DataFrame, link: str, matcher: str) -> DataFrame:
    """payment_id, candidates, counterpart_id -> one row with a match or the reason for none."""
    n = F.coalesce("candidates", F.lit(0))
    return found.select(
        "payment_id", F.lit(link).alias("link_type"), F.lit(matcher).alias("matcher"), n.cast("long").alias("candidates"),
        F.when(n == 1, F.col("counterpart_id")).alias("counterpart_id"),
        F.when(n == 0, "no_candidate").when(n > 1, "ambiguous_candidates").alias("reason"),
    )


def _counted(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Counterparts per key: how many, and the smallest id. At most one row joins each payment."""
    return rows.groupBy(*keys).agg(F.count("*").alias("candidates"), F.min(name).alias("counterpart_id"))


def baseline_amount(payments: DataFrame, bank: DataFrame, invoices: DataFrame, *, use_date: bool) -> DataFrame:
    """Amount alone, or amount and date, on both legs."""
    name = "amount_date" if use_date else "amount_only"
    if use_date:
        credits = _counted(bank.select(F.col("credit").alias("net"), F.col("value_date").alias("on"), "txn_id"), ["net", "on"], "txn_id")
        wanted = payments.select("payment_id", "net", F.explode_outer(F.array_distinct("settled_dates")).alias("on"))
        hits = wanted.join(credits, ["net", "on"], "left").groupBy("payment_id").agg(F.sum("candidates").alias("candidates"), F.min("counterpart_id").alias("counterpart_id"))
        ledger = _counted(invoices.select(F.col("invoice_amount").alias("gross"), F.col("issue_date").alias("captured_on"), "invoice_id"), ["gross", "captured_on"], "invoice_id")
        owed = payments.select("payment_id", "gross", "captured_on").join(ledger, ["gross", "captured_on"], "left")
    else:
        credits = _counted(bank.select(F.col("credit").alias("net"), "txn_id"), ["net"], "txn_id")
        hits = payments.select("payment_id", "net").join(credits, "net", "left")
        ledger = _counted(invoices.select(F.col("invoice_amount").alias("gross"), "invoice_id"), ["gross"], "invoice_id")
        owed = payments.select("payment_id", "gross").join(ledger, "gross", "left")
    return _verdict(hits, BANK, name).unionByName(_verdict(owed, INVOICE, name))


def baseline_id_join(payments: DataFrame, bank: DataFrame, invoices: DataFrame) -> DataFrame:
    """payment_id, link_type, counterpart_ids, reason: all of a payment's UTRs must hit one credit each; one invoice must carry its order id."""
    credits = _counted(bank.where("utr is not null").select("utr", "txn_id"), ["utr"], "txn_id")
    legs = payments.select("payment_id", F.posexplode_outer("settlement_utrs").alias("pos", "utr"))
    known = legs.where("utr is not null").join(credits.where("candidates = 1"), "utr", "left").select("payment_id", "pos", "utr", "counterpart_id")
    legs = known.unionByName(legs.where("utr is null").select("payment_id", "pos", "utr", F.lit(None).cast("string").alias("counterpart_id")))
    hit = F.count("counterpart_id")
    want = F.count("utr")
    ids = F.transform(F.sort_array(F.collect_list(F.when(F.col("counterpart_id").isNotNull(), F.struct("pos", "counterpart_id")))), lambda x: x["counterpart_id"])
    bank_leg = legs.groupBy("payment_id").agg(hit.alias("hit"), want.alias("want"), ids.alias("ids")).select(
        "payment_id", F.lit(BANK).alias("link_type"),
        F.when((F.col("want") > 0) & (F.col("hit") == F.col("want")), F.col("ids")).alias("counterpart_ids"),
        F.when((F.col("want") > 0) & (F.col("hit") == F.col("want")), None).when(F.col("hit") == 0, "no_candidate").otherwise("ambiguous_candidates").alias("reason"),
    )
    ledger = _counted(invoices.where("order_id is not null").select("order_id", "invoice_id"), ["order_id"], "invoice_id")
    keyed = payments.where("order_id is not null").select("payment_id", "order_id").join(ledger, "order_id", "left")
    n = F.coalesce("candidates", F.lit(0))
    invoice_leg = keyed.select("payment_id", F.lit(INVOICE).alias("link_type"), F.when(n == 1, F.array("counterpart_id")).alias("counterpart_ids"), F.when(n == 0, "no_candidate").when(n > 1, "ambiguous_candidates").alias("reason"))
    missing = payments.where("order_id is null").select("payment_id", F.lit(INVOICE).alias("link_type"), F.lit(None).cast("array<string>").alias("counterpart_ids"), F.lit("no_order_id").alias("reason"))
    return bank_leg.unionByName(invoice_leg).unionByName(missing)


def unmatched_counterparts(edges: DataFrame, bank: DataFrame, invoices: DataFrame) -> DataFrame:
    """Credits and invoices that no edge (link_type, counterpart_id) uses."""

    def rest(rows: DataFrame, name: str, kind: str, link: str) -> DataFrame:
        used = edges.where(F.col("link_type") == link).select(F.col("counterpart_id").alias(name)).distinct()
        return rows.join(used, name, "left_anti").select(F.lit(kind).alias("subject_type"), F.col(name).alias("subject_id"), F.lit(link).alias("link_type"), F.lit("unmatched_counterpart").alias("reason"))

    return rest(bank, "txn_id", "bank_txn", BANK).unionByName(rest(invoices, "invoice_id", "invoice", INVOICE))


def as_edges(matches: DataFrame, ids: str | Column = "counterpart_ids", threshold: float | None = None) -> DataFrame:
    """Links one by one; with a ``threshold`` those of matches at least so confident."""
    if threshold is not None:
        matches = matches.where(F.col("confidence") >= threshold)
    return matches.select("payment_id", "link_type", F.explode(ids).alias("counterpart_id"))
