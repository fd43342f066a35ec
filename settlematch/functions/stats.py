"""Rates and intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence of each rule, the ceiling on recorded decisions and the threshold of a match.
RULE_CONFIDENCE = {
    "l1_utr_column_join": 0.99,
    "l1_order_id_join": 0.99,
    "l2_narration_utr_exact": 0.99,
    "l2_narration_utr_truncated": 0.95,
    "l2_utr_fuzzy": 0.95,
    "l2_batch_amount_reconstruction": 0.90,
    "l2_batch_amount_reconstruction_deduped": 0.90,
    "l2_receipt_invoice_hint": 0.99,
    "l2_order_id_normalised": 0.99,
    "l2_order_id_fuzzy": 0.95,
    "l2_invoice_amount_date_window": 0.80,
}
L3_BANK, L3_INVOICE = "l3_llm_batch_disambiguation", "l3_llm_invoice_disambiguation"
UNKNOWN_RULE = 0.5
CEILING = 0.85
THRESHOLD = 0.70


def confidence_for(rule: Column) -> Column:
    pairs = [x for name, value in RULE_CONFIDENCE.items() for x in (F.lit(name), F.lit(value))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), rule), F.lit(UNKNOWN_RULE))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def wilson_interval(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a proportion, within [0, 1]; (0, 0) where there are no trials."""
    p = k / n
    base = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0)
    return low, F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(0.0)


def call_cost_usd(input_tokens: Column, output_tokens: Column, cache_read: Column, cache_write: Column, in_rate: Column, out_rate: Column) -> Column:
    """Cost of a call at per-million rates; a cached read counts a tenth, a cache write one and a quarter. Unknown rates: 0."""
    paid = input_tokens + 0.10 * cache_read + 1.25 * cache_write
    return F.coalesce((paid * in_rate + output_tokens * out_rate) / 1_000_000, F.lit(0.0))
