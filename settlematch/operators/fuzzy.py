"""Second layer: candidates by damaged identifiers, amounts and dates.

Each rule gives the pairs (subject_id, counterpart_id) that it allows; order and uniqueness are
settled in :mod:`settlematch.operators.assign`. No rule compares all pairs: each joins on a key
that every allowed pair shares, then checks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlematch.functions.text import SHORTEST_PREFIX, extract_utrs, find_id_like, is_truncation_of, normalise_id, one_edit_apart
from settlematch.operators.assign import DayWindow, greedy_assign
from settlematch.storage import written

TOLERANCE, DATE_WINDOW, ISSUE_WINDOW = 10, 2, 14


def _tokens(bank: DataFrame) -> DataFrame:
    return bank.select("txn_id", F.explode(extract_utrs(F.col("narration"))).alias("token"))


def narration_utr_exact(batches: DataFrame, bank: DataFrame) -> DataFrame:
    return batches.where("utr is not null").join(_tokens(bank), F.col("utr") == F.col("token")).select(F.col("settlement_id").alias("subject_id"), F.col("txn_id").alias("counterpart_id")).distinct()


def narration_utr_truncated(batches: DataFrame, bank: DataFrame) -> DataFrame:
    head = F.lit(SHORTEST_PREFIX)
    left = batches.where("utr is not null").select("settlement_id", "utr", F.col("utr").substr(F.lit(1), head).alias("start"))
    right = _tokens(bank).withColumn("start", F.col("token").substr(F.lit(1), head))
    return left.join(right, "start").where(is_truncation_of(F.col("token"), F.col("utr"))).select(F.col("settlement_id").alias("subject_id"), F.col("txn_id").alias("counterpart_id")).distinct()


#: A group of values is compared within itself where it makes at most so many pairs for each of its values.
PAIRS_EACH = 16


def _cut_keys(value: str) -> Column:
    """Keys of a value whose edit lies somewhere in the characters ``a`` + 1 to ``b``, for both halves of that stretch.

    An edit lies in one half, and then all else is equal; or it swaps the two characters that meet
    in the middle. So values one edit apart share the key of a half left out, or the key with the
    middle pair put in order. A key tells the length, what was left out, and the rest.
    """
    text, a, b = F.col(value), F.col("a"), F.col("b")
    m = a + ((b - a) / 2).cast("int")

    def part(first: Column, last: Column) -> Column:
        return F.substring(text, first + 1, F.greatest(last - first, F.lit(0)))

    n = F.length(text)

    def left_out(x: Column, y: Column) -> Column:
        return F.when(y > x, F.struct(F.xxhash64(F.lit("out"), n, x, y, part(F.lit(0), x), part(y, n)).alias("key"), x.alias("a"), y.alias("b")))

    pair = F.array(part(m - 1, m), part(m, m + 1))
    swap = F.xxhash64(F.lit("swap"), n, m, m, part(F.lit(0), m - 1), F.concat(F.array_min(pair), F.array_max(pair), part(m + 1, n)))
    return F.array_compact(F.array(left_out(a, m), left_out(m, b), F.when((m > a) & (b > m), F.struct(swap.alias("key"), m.alias("a"), m.alias("b")))))


def one_edit_values(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (x of ``left``, y of ``right``) of distinct values of one length, one substitution or swap apart.

    Values are halved where the halves tell them apart, and halved again only where very many
    share what is left (:func:`_cut_keys`): three keys a value for ids that vary throughout, three more
    for each halving of a stretch that few of them vary outside of. A stretch of one character ends
    it. No group that is compared makes more than PAIRS_EACH pairs a value, but for groups of one character's
    variants and of the two orders of a pair.
    """
    sides = left.select("value", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select("value", F.lit(0).alias("l"), F.lit(1).alias("r")))
    values = sides.where(F.length("value") > 0).groupBy("value").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    now, found = written(values.select("*", F.lit(0).alias("a"), F.length("value").alias("b"))), None
    while found is None or not now.isEmpty():
        keyed = now.select("value", "l", "r", F.explode(_cut_keys("value")).alias("k")).select("value", "l", "r", "k.*")
        shared = F.count("*").alias("n"), F.sum("l").alias("nl"), F.sum("r").alias("nr")
        groups = written(keyed.groupBy("key").agg(*shared).where("n > 1 and nl > 0 and nr > 0").select("key", (F.col("nl") * F.col("nr") <= PAIRS_EACH * F.col("n")).alias("few")))
        keyed = keyed.join(groups, "key")
        ready = keyed.where(F.col("few") | (F.col("b") - F.col("a") < 2))
        x, y = (ready.where(f"{side} = 1").select("key", F.col("value").alias(name)) for side, name in (("l", "x"), ("r", "y")))
        pairs = x.join(y, "key").where((F.col("x") != F.col("y")) & (F.length("x") == F.length("y"))).select("x", "y")
        found = pairs if found is None else found.unionByName(pairs)
        now = written(keyed.where(~F.col("few") & (F.col("b") - F.col("a") > 1)).select("value", "l", "r", "a", "b"))
    return found.distinct().where(one_edit_apart(F.col("x"), F.col("y")))


def _one_edit(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (subject_id, value) and right (counterpart_id, value): values of one length, one substitution or swap apart."""
    pairs = written(one_edit_values(left, right))
    a, b = left.withColumnRenamed("value", "x"), right.withColumnRenamed("value", "y")
    return pairs.join(a, "x").join(b, "y").select("subject_id", "counterpart_id").distinct()


def utr_fuzzy(batches: DataFrame, bank: DataFrame) -> DataFrame:
    shown = _tokens(bank).select(F.col("txn_id").alias("counterpart_id"), F.col("token").alias("value"))
    column = bank.where("utr is not null").select(F.col("txn_id").alias("counterpart_id"), F.col("utr").alias("value"))
    return _one_edit(batches.where("utr is not null").select(F.col("settlement_id").alias("subject_id"), F.col("utr").alias("value")), shown.unionByName(column).distinct())


def batch_amount(batches: DataFrame, bank: DataFrame, *, deduped: bool) -> DataFrame:
    """Credit within TOLERANCE paise of the batch total and DATE_WINDOW days of its date: a band join on amount buckets and days."""
    width = 2 * TOLERANCE + 1
    total = F.col("expected_credit_dedup" if deduped else "expected_credit")
    bucket = F.floor(total / width)
    probes = batches.where("settled_date is not null").select("settlement_id", "settled_date", total.alias("total"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    probes = probes.withColumn("value_date", F.explode(F.transform(F.sequence(F.lit(-DATE_WINDOW), F.lit(DATE_WINDOW)), lambda i: F.date_add("settled_date", i))))
    rows = bank.select("txn_id", "value_date", "credit", F.floor(F.col("credit") / width).alias("bucket"))
    return probes.join(rows, ["bucket", "value_date"]).where(F.abs(F.col("credit") - F.col("total")) <= TOLERANCE).select(F.col("settlement_id").alias("subject_id"), F.col("txn_id").alias("counterpart_id"))


def receipt_invoice_hint(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    hinted = payments.select(F.col("payment_id").alias("subject_id"), F.explode(find_id_like(F.col("order_receipt"))).alias("invoice_id"))
    return hinted.join(invoices.select("invoice_id"), "invoice_id").select("subject_id", F.col("invoice_id").alias("counterpart_id"))


def order_id_normalised(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    left = payments.where("order_id is not null").select(F.col("payment_id").alias("subject_id"), normalise_id(F.col("order_id")).alias("key"))
    right = invoices.where("order_id is not null and order_id <> ''").select(F.col("invoice_id").alias("counterpart_id"), normalise_id(F.col("order_id")).alias("key"))
    return left.join(right, "key").select("subject_id", "counterpart_id")


def order_id_fuzzy(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    return _one_edit(
        payments.where("order_id is not null").select(F.col("payment_id").alias("subject_id"), F.col("order_id").alias("value")),
        invoices.where("order_id is not null").select(F.col("invoice_id").alias("counterpart_id"), F.col("order_id").alias("value")),
    )


def invoice_amount_window(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """Exact amount, issued at most ISSUE_WINDOW days before capture: an equi-join on amount and each day of the window."""
    left = payments.where("captured_on is not null").select(F.col("payment_id").alias("subject_id"), F.col("gross").alias("invoice_amount"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(ISSUE_WINDOW)), lambda i: F.date_sub("captured_on", i))).alias("issue_date"))
    return left.join(invoices.select("invoice_id", "invoice_amount", "issue_date"), ["invoice_amount", "issue_date"]).select("subject_id", F.col("invoice_id").alias("counterpart_id"))


Rule = tuple[str, Callable[[DataFrame, DataFrame], DataFrame]]

#: In order of rank.
BANK_RULES: list[Rule] = [
    ("l2_narration_utr_exact", narration_utr_exact),
    ("l2_narration_utr_truncated", narration_utr_truncated),
    ("l2_utr_fuzzy", utr_fuzzy),
    ("l2_batch_amount_reconstruction", lambda b, r: batch_amount(b, r, deduped=False)),
    ("l2_batch_amount_reconstruction_deduped", lambda b, r: batch_amount(b, r, deduped=True)),
]
INVOICE_RULES: list[Rule] = [
    ("l2_receipt_invoice_hint", receipt_invoice_hint),
    ("l2_order_id_normalised", order_id_normalised),
    ("l2_order_id_fuzzy", order_id_fuzzy),
    ("l2_invoice_amount_date_window", invoice_amount_window),
]


def amount_window(payments: DataFrame, invoices: DataFrame) -> DayWindow:
    """The last invoice rule by its two sides, for assignment without its pairs."""
    day = F.lit("1970-01-01").cast("date")
    return DayWindow(
        "l2_invoice_amount_date_window", len(INVOICE_RULES) - 1, ISSUE_WINDOW,
        payments.where("captured_on is not null").select(F.col("payment_id").alias("subject_id"), F.col("gross").alias("amount"), F.datediff("captured_on", day).alias("day")),
        invoices.where("issue_date is not null").select(F.col("invoice_id").alias("counterpart_id"), F.col("invoice_amount").alias("amount"), F.datediff("issue_date", day).alias("day")),
    )


def assign_batches(batches: DataFrame, bank: DataFrame) -> DataFrame:
    """Claim-once links of unresolved batches to free credits."""
    return greedy_assign(candidates(batches, bank, BANK_RULES))


def assign_invoices(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """Claim-once links of unresolved payments to free invoices."""
    return greedy_assign(candidates(payments, invoices, INVOICE_RULES[:-1]), amount_window(payments, invoices))


def candidates(subjects: DataFrame, rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """subject_id, rank, rule, counterpart_id over all rules."""
    out = None
    for rank, (name, rule) in enumerate(rules):
        one = rule(subjects, rows).select("subject_id", F.lit(rank).alias("rank"), F.lit(name).alias("rule"), "counterpart_id")
        out = one if out is None else out.unionByName(one)
    return out
