"""All layers together: matches with their evidence and a typed list of exceptions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlematch.functions.ids import exception_id, match_id
from settlematch.functions.money import format_rupees
from settlematch.functions.stats import CEILING, L3_BANK, L3_INVOICE, THRESHOLD
from settlematch.functions.text import extract_utrs, is_truncation_of, one_edit_apart
from settlematch.operators import decisions, exact, fuzzy
from settlematch.operators.baselines import BANK, INVOICE, as_edges, unmatched_counterparts
from settlematch.storage import written

NO_LINES = "cast(array() as array<string>)"


@dataclass
class Leg:
    """How one leg is resolved: ids, the two first layers, the recorded decisions of the third, and what is said about a link."""

    subject: str
    row: str
    first: Callable[[DataFrame, DataFrame], DataFrame]
    second: Callable[[DataFrame, DataFrame], DataFrame]
    third: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
    third_rule: str
    evidence: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def _said(column: str, *parts: str | Column) -> Column:
    """Parts in a row; strings starting with = are columns."""
    return F.concat(*[F.coalesce(F.col(p[1:]).cast("string"), F.lit("none")) if isinstance(p, str) and p.startswith("=") else F.lit(p) if isinstance(p, str) else p for p in parts]).alias(column)


def bank_evidence(resolved: DataFrame, batches: DataFrame, bank: DataFrame) -> DataFrame:
    """``resolved`` with ``evidence``: what the rule saw, with its values."""
    rows = resolved.join(batches.select(F.col("settlement_id").alias("subject_id"), F.col("utr").alias("_utr"), F.col("n_payments").alias("_n"), "expected_credit", "expected_credit_dedup", "has_duplicate_refund_rows"), "subject_id")
    rows = rows.join(bank.select(F.col("txn_id").alias("counterpart_id"), F.col("utr").alias("_shown"), "narration", "credit", "value_date"), "counterpart_id")
    tokens = extract_utrs(F.col("narration"))
    shown = F.concat(tokens, F.when(F.col("_shown").isNotNull(), F.array("_shown")).otherwise(F.expr(NO_LINES)))
    begin = F.get(F.filter(tokens, lambda t: is_truncation_of(t, F.col("_utr"))), F.lit(0))
    near = F.get(F.filter(shown, lambda t: one_edit_apart(t, F.col("_utr"))), F.lit(0))
    narration, credit = _said("x", "narration: ", "=narration"), _said("x", "credit ", "=counterpart_id", " of ", format_rupees(F.col("credit")), " on ", "=value_date")

    def amount(total: str, how: str) -> list[Column]:
        off = (F.col("credit") - F.col(total)).cast("string")
        return [_said("x", "batch total ", how, " is ", format_rupees(F.col(total))), F.concat(credit, F.lit(", off by "), off, F.lit(" paise"))]

    told = {
        "l1_utr_column_join": [_said("x", "UTR ", "=_utr", " stands in the statement's column once"), credit],
        "l2_narration_utr_exact": [_said("x", "UTR ", "=_utr", " stands whole in the narration"), narration],
        "l2_narration_utr_truncated": [_said("x", "the narration shows ", begin, ", how ", "=_utr", " begins"), narration],
        "l2_utr_fuzzy": [_said("x", "the statement shows ", near, ", one edit from ", "=_utr"), credit],
        "l2_batch_amount_reconstruction": amount("expected_credit", "as reported"),
        "l2_batch_amount_reconstruction_deduped": [*amount("expected_credit_dedup", "without repeated refunds"), F.when(F.col("has_duplicate_refund_rows"), "a refund of one payment and amount is reported twice")],
    }
    return _with_evidence(rows, resolved, told, _said("x", "the batch holds ", "=_n", " payment(s)"))


def invoice_evidence(resolved: DataFrame, payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """The same for payments and invoices."""
    rows = resolved.join(payments.select(F.col("payment_id").alias("subject_id"), F.col("order_id").alias("_order"), "order_receipt", "captured_on"), "subject_id")
    rows = rows.join(invoices.select(F.col("invoice_id").alias("counterpart_id"), F.col("order_id").alias("_shown"), "invoice_amount", "issue_date"), "counterpart_id")
    invoice = _said("x", "invoice ", "=counterpart_id", " of ", format_rupees(F.col("invoice_amount")), " issued ", "=issue_date")
    told = {
        "l1_order_id_join": [_said("x", "order ", "=_order", " stands on one invoice"), invoice],
        "l2_receipt_invoice_hint": [_said("x", "receipt ", "=order_receipt", " names the invoice"), invoice],
        "l2_order_id_normalised": [_said("x", "orders ", "=_order", " and ", "=_shown", " differ in case and signs only"), invoice],
        "l2_order_id_fuzzy": [_said("x", "orders ", "=_order", " and ", "=_shown", " are one edit apart"), invoice],
        "l2_invoice_amount_date_window": [invoice, _said("x", "capture followed on ", "=captured_on", ", ", F.datediff("captured_on", "issue_date").cast("string"), " day(s) later")],
    }
    return _with_evidence(rows, resolved, told, None)


def _with_evidence(rows: DataFrame, resolved: DataFrame, told: dict[str, list[Column]], last: Column | None) -> DataFrame:
    lines = None
    for rule, said in told.items():
        said = F.array_compact(F.array(*said, *([last] if last is not None else [])))
        lines = F.when(F.col("rule") == rule, said) if lines is None else lines.when(F.col("rule") == rule, said)
    return rows.select(*resolved.columns, F.coalesce(lines, F.expr(NO_LINES)).alias("evidence"))


def two_places(x: Column) -> Column:
    return F.round(x, 2).cast("decimal(10,2)").cast("string")


def decided(outcomes: DataFrame, rule: str) -> tuple[DataFrame, DataFrame]:
    """Links and declines of :func:`decisions.decide_in_turn`, both with evidence."""
    answer = _said("x", "recorded answer ", "=prompt_hash", " to a question with ", "=offered", " candidate(s)")
    reason = _said("x", "its reason: ", "=reasoning")
    cut = F.when(F.coalesce(F.col("inferred_deduction_paise"), F.lit(0)) != 0, F.concat(F.lit("it explains a shortfall of "), format_rupees(F.col("inferred_deduction_paise"))))
    sure = F.concat(F.lit("its confidence "), two_places(F.col("raw_confidence")), F.lit(" counts as "), two_places(F.col("raw_confidence") * CEILING))
    links = outcomes.where("outcome = 'accepted'").select("subject_id", F.col("chosen_id").alias("counterpart_id"), F.lit("l3_llm").alias("layer"), F.lit(rule).alias("rule"), (F.col("raw_confidence") * CEILING).alias("confidence"), F.array_compact(F.array(answer, reason, cut, sure)).alias("evidence"))
    strange = F.when(F.col("outcome") == "not_offered", F.concat(F.lit("it names "), "chosen_id", F.lit(", which was not on offer")))
    declines = outcomes.where("outcome in ('declined', 'not_offered')").select("subject_id", F.array_compact(F.array(answer, reason, strange, F.concat(F.lit("its confidence "), two_places(F.col("raw_confidence"))))).alias("declined"))
    return links, declines


def bank_decisions(batches: DataFrame, bank: DataFrame, transcript: DataFrame) -> DataFrame:
    choices = decisions.bank_choices(batches, bank, decisions.recorded_subjects(transcript))
    return decisions.decide_in_turn(written(choices), transcript)


BANK_LEG = Leg("settlement_id", "txn_id", exact.l1_utr_column_join, fuzzy.assign_batches, bank_decisions, L3_BANK, bank_evidence)
INVOICE_LEG = Leg("payment_id", "invoice_id", exact.l1_order_id_join, fuzzy.assign_invoices, decisions.decide_invoices_in_turn, L3_INVOICE, invoice_evidence)


def open_rows(leg: Leg, subjects: DataFrame, rows: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subjects and counterparts that no link of ``resolved`` uses."""
    left = subjects.join(resolved.select(F.col("subject_id").alias(leg.subject)), leg.subject, "left_anti")
    free = rows.join(resolved.select(F.col("counterpart_id").alias(leg.row)).distinct(), leg.row, "left_anti")
    return left, free


def two_layers(leg: Leg, subjects: DataFrame, rows: DataFrame) -> DataFrame:
    """Exact links, then fuzzy ones among what is left, with evidence; written, since later steps read it."""
    done = written(leg.first(subjects, rows))
    found = done.unionByName(leg.second(*open_rows(leg, subjects, rows, done)))
    return written(leg.evidence(written(found), subjects, rows))


def resolve(leg: Leg, subjects: DataFrame, rows: DataFrame, transcript: DataFrame | None = None, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links of all layers, earlier ones never overwritten, and the declines (subject_id, declined: lines).

    found: what :func:`two_layers` gave, where it is at hand.
    """
    found = two_layers(leg, subjects, rows) if found is None else found
    if transcript is None:
        return found, found.sparkSession.createDataFrame([], "subject_id string, declined array<string>")
    links, declines = decided(written(leg.third(*open_rows(leg, subjects, rows, found), transcript)), leg.third_rule)
    return found.unionByName(links), declines


def resolve_bank_leg(batches: DataFrame, bank: DataFrame, transcript: DataFrame | None = None) -> DataFrame:
    return resolve(BANK_LEG, batches, bank, transcript)[0]


def resolve_invoice_leg(payments: DataFrame, invoices: DataFrame, transcript: DataFrame | None = None) -> DataFrame:
    return resolve(INVOICE_LEG, payments, invoices, transcript)[0]


def propagate_bank_matches(payments: DataFrame, resolved: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A payment inherits what its batches resolved to: layer and confidence of the weakest part, rules joined by +."""
    legs = payments.select("payment_id", "settlement_ids", F.posexplode("settlement_ids").alias("pos", "subject_id"))
    parts = legs.join(resolved, "subject_id", "left")
    sure = F.coalesce(F.col("confidence") >= threshold, F.lit(False))
    grouped = parts.groupBy("payment_id").agg(
        F.sort_array(F.collect_list(F.when(sure, F.col("counterpart_id")))).alias("counterpart_ids"),
        F.min_by(F.when(sure, F.struct("layer", "confidence")), F.when(sure, F.struct("confidence", "pos"))).alias("worst"),
        F.array_join(F.sort_array(F.collect_set(F.when(sure, F.col("rule")))), "+").alias("rule"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.when(sure, F.struct("pos", "evidence")))), lambda x: x["evidence"])).alias("evidence"),
        F.first("settlement_ids").alias("settlement_ids"), F.count("*").alias("legs"), F.count(F.when(sure, 1)).alias("tied"),
    ).where("tied > 0")
    partial = F.concat(F.lit("tied: "), F.col("tied").cast("string"), F.lit(" of "), F.col("legs").cast("string"), F.lit(" payouts of this payment; the others are exceptions"))
    notes = F.when(F.col("tied") < F.col("legs"), F.concat("evidence", F.array(partial))).otherwise(F.col("evidence"))
    records = F.create_map(F.lit("gateway"), F.array("payment_id"), F.lit("settlement"), F.col("settlement_ids"), F.lit("bank"), F.col("counterpart_ids"))
    return _match(grouped.withColumns({"layer": F.col("worst.layer"), "confidence": F.col("worst.confidence"), "evidence": notes, "source_records": records}), BANK)


def invoice_matches(resolved: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    rows = resolved.where(F.col("confidence") >= threshold)
    records = F.create_map(F.lit("gateway"), F.array("subject_id"), F.lit("erp"), F.array("counterpart_id"))
    return _match(rows.select(F.col("subject_id").alias("payment_id"), F.array("counterpart_id").alias("counterpart_ids"), "layer", "rule", "confidence", "evidence", records.alias("source_records")), INVOICE)


def _match(rows: DataFrame, link: str) -> DataFrame:
    return rows.select(match_id(F.lit(link), F.col("payment_id"), F.col("counterpart_ids"), F.col("rule")).alias("match_id"), F.lit(link).alias("link_type"), "payment_id", "counterpart_ids", "layer", "rule", "confidence", "evidence", "source_records")


def _open_leg(legs: DataFrame, resolved: DataFrame, declines: DataFrame, link: str, missing: Column, threshold: float) -> DataFrame:
    """Exceptions of the legs (payment_id, subject_id) that have no link, or one below the threshold."""
    rows = legs.join(resolved, "subject_id", "left").where(F.col("confidence").isNull() | (F.col("confidence") < threshold)).join(declines, "subject_id", "left")
    none, refused = F.col("confidence").isNull(), F.col("declined").isNotNull()
    weak = F.concat(F.lit("a link by "), "rule", F.lit(" has confidence "), two_places(F.col("confidence")), F.lit(f", less than {threshold:.2f}"))
    return rows.select(
        F.lit("payment").alias("subject_type"), F.col("payment_id").alias("subject_id"), F.lit(link).alias("link_type"),
        F.when(none & refused, "llm_declined").when(none, "no_candidate").otherwise("below_confidence").alias("reason"),
        F.when(none & refused, F.lit("a recorded answer refused to link it")).when(none, missing).otherwise(weak).alias("detail"),
        F.when(none, "l3_llm").otherwise(F.col("layer")).alias("layer_reached"), F.when(none, 0).otherwise(1).alias("candidates_considered"),
        F.when(none, F.concat(F.array(missing), F.coalesce("declined", F.expr(NO_LINES)))).otherwise(F.col("evidence")).alias("evidence"),
    )


def build_exceptions(payments: DataFrame, bank_resolved: tuple[DataFrame, DataFrame], invoice_resolved: tuple[DataFrame, DataFrame], matches: DataFrame, bank: DataFrame, invoices: DataFrame, threshold: float = THRESHOLD, *, asked: bool = True) -> DataFrame:
    """Open legs of payments and unused counterparts, each with its reason, the layer reached and the evidence.

    The pairs are links and declines of :func:`resolve`; ``asked``: the third layer took part.
    """
    legs = payments.select("payment_id", F.explode("settlement_ids").alias("subject_id"))
    bank_open = _open_leg(legs, *bank_resolved, BANK, F.concat(F.lit("no bank credit is tied to payout "), "subject_id"), threshold)
    whole = payments.select("payment_id", F.col("payment_id").alias("subject_id"))
    invoice_open = _open_leg(whole, *invoice_resolved, INVOICE, F.lit("no invoice is tied to the payment"), threshold)
    unused = unmatched_counterparts(as_edges(matches), bank, invoices)
    credits = bank.select(F.lit("bank_txn").alias("subject_type"), F.col("txn_id").alias("subject_id"), F.lit("no payout uses this credit").alias("detail"), F.array(_said("x", "credit of ", format_rupees(F.col("credit")), " on ", "=value_date"), _said("x", "narration: ", "=narration")).alias("evidence"))
    ledger = invoices.select(F.lit("invoice").alias("subject_type"), F.col("invoice_id").alias("subject_id"), F.lit("no payment uses this invoice").alias("detail"), F.array(_said("x", "invoice of ", format_rupees(F.col("invoice_amount")), " issued ", "=issue_date"), _said("x", "customer ", "=customer_id")).alias("evidence"))
    unused = unused.join(credits.unionByName(ledger), ["subject_type", "subject_id"]).withColumns({"layer_reached": F.lit("l3_llm" if asked else "l2_fuzzy"), "candidates_considered": F.lit(0)})
    every = bank_open.unionByName(invoice_open).unionByName(unused)
    return every.withColumn("exception_id", exception_id(F.col("subject_type"), F.col("subject_id"), F.col("link_type"), F.col("reason")))


def run_layered(payments: DataFrame, batches: DataFrame, bank: DataFrame, invoices: DataFrame, threshold: float = THRESHOLD, transcript: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """matches and exceptions of both legs; with a ``transcript`` its recorded decisions are the third layer."""
    by_batch, by_payment = resolve(BANK_LEG, batches, bank, transcript), resolve(INVOICE_LEG, payments, invoices, transcript)
    return assembled(payments, by_batch, by_payment, bank, invoices, threshold, asked=transcript is not None)


def assembled(payments: DataFrame, by_batch: tuple[DataFrame, DataFrame], by_payment: tuple[DataFrame, DataFrame], bank: DataFrame, invoices: DataFrame, threshold: float = THRESHOLD, *, asked: bool = True) -> tuple[DataFrame, DataFrame]:
    """matches and exceptions from the links and declines of both legs."""
    matches = written(propagate_bank_matches(payments, by_batch[0], threshold).unionByName(invoice_matches(by_payment[0], threshold)))
    return matches, build_exceptions(payments, by_batch, by_payment, matches, bank, invoices, threshold, asked=asked)


def rule_counts(payments: DataFrame, by_batch: DataFrame, by_payment: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rule, n: parts of payments (batches they ride in, and invoices) that each rule ties confidently."""
    legs = payments.select(F.explode("settlement_ids").alias("subject_id")).join(by_batch, "subject_id").select("rule", "confidence")
    every = legs.unionByName(by_payment.select("rule", "confidence"))
    return every.where(F.col("confidence") >= threshold).groupBy("rule").agg(F.count("*").alias("n"))
