"""Registered queries over the derived sources, each with the same question in SQL.

The SQL is written apart from the operators; only the source tables are shared text
(:mod:`settlematch.sources.testdata`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from settlematch.functions import calendar, ids, money, stats, text
from settlematch.operators import assemble, audit, baselines, breakdown, corpus, decisions, exact, fuzzy, order, quality, score, views
from settlematch.operators.baselines import BANK, INVOICE
from settlematch.sources import files, results
from settlematch.sources.testdata import oracle_prefix, sources
from settlematch.storage import shared_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The questions as functions of :class:`Inputs`; several may share one.
MAKERS: dict[str, Callable[[Inputs], DataFrame]] = {}


class Inputs:
    """The derived tables and the views built on them, each made once per query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.at = spark, sources(spark, sf_dir)
        self.inputs = results.fingerprint(spark, sf_dir)
        self.kept: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        return self.at[name]

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    @property
    def payments(self) -> DataFrame:
        return self.once("payments", lambda: written(views.payment_views(self["gateway"])))

    @property
    def batches(self) -> DataFrame:
        return self.once("batches", lambda: written(views.settlement_batches(self["gateway"])))

    @property
    def bank(self) -> DataFrame:
        return self.once("bank", lambda: written(self["bank"]))

    @property
    def invoices(self) -> DataFrame:
        return self.once("invoices", lambda: written(self["invoices"]))

    @property
    def truth_edges(self) -> DataFrame:
        return self["truth_bank"].select(F.lit(BANK).alias("link_type"), "payment_id", "counterpart_id").unionByName(self["truth_invoice"].select(F.lit(INVOICE).alias("link_type"), "payment_id", "counterpart_id"))

    @property
    def orphans(self) -> DataFrame:
        return self["orphan_bank"].select(F.lit("bank_txn").alias("subject_type"), F.col("txn_id").alias("subject_id")).unionByName(self["orphan_invoices"].select(F.lit("invoice").alias("subject_type"), F.col("invoice_id").alias("subject_id")))

    @property
    def found_bank(self) -> DataFrame:
        """Links of the first two layers."""
        return self.once("found_bank", lambda: assemble.two_layers(assemble.BANK_LEG, self.batches, self.bank))

    @property
    def found_invoice(self) -> DataFrame:
        return self.once("found_invoice", lambda: assemble.two_layers(assemble.INVOICE_LEG, self.payments, self.invoices))

    def of_leg(self, name: str, leg: str) -> DataFrame:
        """``choices``, ``questions`` or ``transcript`` of one leg, made without the other."""

        def choices() -> DataFrame:
            if leg == "bank":
                rows = decisions.bank_choices(*assemble.open_rows(assemble.BANK_LEG, self.batches, self.bank, self.found_bank))
            else:  # one more than is offered: the transcript also asks without the first
                rows = decisions.invoice_choices(*assemble.open_rows(assemble.INVOICE_LEG, self.payments, self.invoices, self.found_invoice), most=decisions.OFFERED + 1)
            return rows.withColumn("leg", F.lit(leg))

        def questions() -> DataFrame:
            return _questions_of(leg, self.of_leg("choices", leg))

        def transcript() -> DataFrame:
            rest = _without_first(self.of_leg("choices", leg))
            return _transcript(self.of_leg("questions", leg).unionByName(_questions_of(leg, rest)))

        make = {"choices": choices, "questions": questions, "transcript": transcript}[name]
        return self.once(f"{name} of {leg}", lambda: written(make()))

    def of_both(self, name: str) -> DataFrame:
        return self.once(name, lambda: self.of_leg(name, "bank").unionByName(self.of_leg(name, "invoice")))

    @property
    def choices(self) -> DataFrame:
        """What is left on both legs, as questions are made of it."""
        return self.of_both("choices")

    @property
    def questions(self) -> DataFrame:
        """Of every open subject the question if it were the first to be asked."""
        return self.of_both("questions")

    @property
    def transcript(self) -> DataFrame:
        """Recorded answers to these questions, and to those without the first choice."""
        return self.of_both("transcript")

    @property
    def rivals(self) -> DataFrame:
        """Below the questions about batches, when they name all others that are open."""

        def make() -> DataFrame:
            left, _ = assemble.open_rows(assemble.BANK_LEG, self.batches, self.bank, self.found_bank)
            return written(decisions.rivals_by_name(left, self.choices.where("leg = 'bank'").select(F.col("subject_id").alias("settlement_id")).distinct()))

        return self.once("rivals", make)

    @property
    def whole_questions(self) -> DataFrame:
        """:attr:`questions` that name the other open batches instead of adding them up by day."""
        return self.once("whole_questions", lambda: written(_questions(self.choices, self.rivals)))

    @property
    def whole_transcript(self) -> DataFrame:
        """The same call log of questions that name the other open batches."""
        return self.once("whole_transcript", lambda: written(_transcript(self.whole_questions.unionByName(_questions(_without_first(self.choices), self.rivals)))))

    @property
    def whole_log(self) -> DataFrame:
        """:attr:`whole_transcript` as lines in order: from the table where it is at hand, else straight from the questions, whose texts are in no table then."""
        if "whole_transcript" in self.kept:
            return self.whole_transcript.repartitionByRange("seq", "prompt_hash").sortWithinPartitions("seq", "prompt_hash")
        return _transcript(_questions(self.choices, self.rivals).unionByName(_questions(_without_first(self.choices), self.rivals)))

    @property
    def by_batch(self) -> tuple[DataFrame, DataFrame]:
        """Links and declines of all layers."""
        return self.once("by_batch", lambda: assemble.resolve(assemble.BANK_LEG, self.batches, self.bank, self.of_leg("transcript", "bank"), self.found_bank))

    @property
    def by_payment(self) -> tuple[DataFrame, DataFrame]:
        return self.once("by_payment", lambda: assemble.resolve(assemble.INVOICE_LEG, self.payments, self.invoices, self.of_leg("transcript", "invoice"), self.found_invoice))

    @property
    def store(self) -> results.Results:
        """The layered answer on disk: worked out by the session's first query that needs it, and read by the others."""

        def make() -> results.Results:
            at = f"{shared_folder(self.spark)}/answer-{self.spark.sparkContext.applicationId}-{self.inputs}"
            if (kept := results.latest(self.spark, at)) is None:
                results.save(at, *assemble.assembled(self.payments, self.by_batch, self.by_payment, self.bank, self.invoices))
                kept = results.latest(self.spark, at)
            return kept

        return self.once("store", make)

    @property
    def layered(self) -> tuple[DataFrame, DataFrame]:
        return self.store.matches, self.store.exceptions

    @property
    def layered_edges(self) -> DataFrame:
        return baselines.as_edges(self.layered[0])

    @property
    def id_join(self) -> DataFrame:
        """The identifier join's edges: an answer that SQL can reproduce whole."""
        found = baselines.baseline_id_join(self.payments, self.bank, self.invoices)
        return self.once("id_join", lambda: written(found))

    @property
    def id_edges(self) -> DataFrame:
        return baselines.as_edges(self.id_join.where("counterpart_ids is not null"))


def query(sql: str | None = None, name: str | None = None):
    """Register a function of :class:`Inputs`; ``sql`` continues the common table expressions."""

    def add(make: Callable[[Inputs], DataFrame]):
        key = name or make.__name__
        MAKERS[key] = make
        QUERIES[key] = lambda spark, sf_dir: make(Inputs(spark, sf_dir))
        QUERIES[key].__doc__ = make.__doc__
        if sql and sql.startswith("WITH"):
            ORACLE_SQL[key] = sql
        elif sql:
            ORACLE_SQL[key] = oracle_prefix() + (", " if sql.lstrip().startswith("--with") else "\n") + sql.replace("--with", "", 1)
        return make

    return add


def joined(column: str) -> Column:
    return F.array_join(column, ",")


# --- shared SQL: views of the report, and the identifier join --------------------------------

PAYMENTS = """
pv AS (SELECT payment_id, arg_min(struct_pack(o := order_id, r := order_receipt, m := method, g := amount, fee := fee, tax := tax, tds := tds, c := captured_at), (-amount, coalesce(settled_at, created_at), entity_id, settlement_id)) AS h,
    CAST(sum(credit) AS BIGINT) AS net, count(*) AS row_count,
    list(settlement_id ORDER BY coalesce(settled_at, created_at), entity_id, settlement_id) AS sids, list(settlement_utr ORDER BY coalesce(settled_at, created_at), entity_id, settlement_id) AS utrs,
    list(CAST(substr(settled_at, 1, 10) AS DATE) ORDER BY coalesce(settled_at, created_at), entity_id, settlement_id) AS days
    FROM gateway WHERE entity_type = 'payment' AND payment_id IS NOT NULL GROUP BY payment_id),
payments AS (SELECT payment_id, h.o AS order_id, h.r AS order_receipt, h.m AS method, h.g AS gross, h.fee AS fee, h.tax AS tax, h.tds AS tds, h.c AS captured_at, CAST(substr(h.c, 1, 10) AS DATE) AS captured_on, net, row_count, sids, utrs, days FROM pv)
"""
BATCHES = """
rep AS (SELECT *, entity_type = 'refund' AND debit <> 0 AND row_number() OVER (PARTITION BY settlement_id, payment_id, debit ORDER BY created_at, entity_id) > 1 AS repeat FROM gateway WHERE settlement_id IS NOT NULL),
batches AS (SELECT settlement_id, CASE WHEN count(DISTINCT settlement_utr) = 1 THEN min(settlement_utr) END AS utr, min(CAST(substr(settled_at, 1, 10) AS DATE)) AS settled_date,
    CAST(sum(credit) - sum(debit) AS BIGINT) AS expected_credit, CAST(sum(credit) - sum(CASE WHEN repeat THEN 0 ELSE debit END) AS BIGINT) AS expected_credit_dedup, bool_or(repeat) AS has_duplicate_refund_rows,
    count(DISTINCT CASE WHEN entity_type = 'payment' THEN payment_id END) AS n_payments, count(CASE WHEN entity_type = 'refund' THEN 1 END) AS n_refunds, count(CASE WHEN entity_type = 'adjustment' THEN 1 END) AS n_adjustments
    FROM rep GROUP BY settlement_id)
"""
ID_JOIN = PAYMENTS + """,
one_utr AS (SELECT utr, min(txn_id) AS txn_id FROM bank WHERE utr IS NOT NULL GROUP BY utr HAVING count(*) = 1),
legs AS (SELECT payment_id, unnest(utrs) AS utr FROM payments),
hits AS (SELECT l.payment_id, count(*) AS want, count(o.txn_id) AS hit FROM legs l LEFT JOIN one_utr o USING (utr) WHERE l.utr IS NOT NULL GROUP BY 1),
by_order AS (SELECT order_id, count(*) AS n, min(invoice_id) AS invoice_id FROM invoices WHERE order_id IS NOT NULL GROUP BY 1),
id_edges AS (SELECT 'payment_to_bank' AS link_type, l.payment_id, o.txn_id AS counterpart_id FROM legs l JOIN one_utr o USING (utr) JOIN hits h USING (payment_id) WHERE h.want = h.hit
    UNION ALL SELECT 'payment_to_invoice', p.payment_id, b.invoice_id FROM payments p JOIN by_order b USING (order_id) WHERE b.n = 1),
id_open AS (SELECT p.payment_id, 'payment_to_bank' AS link_type, CASE WHEN coalesce(h.hit, 0) = 0 THEN 'no_candidate' ELSE 'ambiguous_candidates' END AS reason FROM payments p LEFT JOIN hits h USING (payment_id) WHERE h.want IS NULL OR h.want <> h.hit
    UNION ALL SELECT p.payment_id, 'payment_to_invoice', CASE WHEN p.order_id IS NULL THEN 'no_order_id' WHEN b.n IS NULL THEN 'no_candidate' ELSE 'ambiguous_candidates' END FROM payments p LEFT JOIN by_order b USING (order_id) WHERE p.order_id IS NULL OR b.n IS NULL OR b.n > 1)
"""
TRUTH = """
truth_edges AS (SELECT DISTINCT 'payment_to_bank' AS link_type, payment_id, counterpart_id FROM truth_bank UNION ALL SELECT 'payment_to_invoice', payment_id, counterpart_id FROM truth_invoice),
orphans AS (SELECT 'bank_txn' AS subject_type, txn_id AS subject_id FROM orphan_bank UNION ALL SELECT 'invoice', invoice_id FROM orphan_invoices)
"""
def wilson(k: str, n: str, name: str) -> str:
    p, z = f"({k} * 1.0 / {n})", "1.96"
    base, mid = f"(1 + {z} * {z} / {n})", f"({p} + {z} * {z} / (2 * {n}))"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n})))"
    return f"round(CASE WHEN {n} > 0 THEN greatest(0.0, ({mid} - {half}) / {base}) ELSE 0.0 END, 6) AS {name}_lo, round(CASE WHEN {n} > 0 THEN least(1.0, ({mid} + {half}) / {base}) ELSE 0.0 END, 6) AS {name}_hi"


def ratio(a: str, b: str, name: str) -> str:
    return f"round(CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END, 6) AS {name}"


# --- column functions ------------------------------------------------------------------------

AMOUNT = "CASE k % 4 WHEN 0 THEN '₹' || CAST(gross // 100 AS VARCHAR) || '.' || lpad(CAST(gross % 100 AS VARCHAR), 2, '0') WHEN 1 THEN '(' || CAST(gross // 100 AS VARCHAR) || '.5)' WHEN 2 THEN ' ' || CAST(gross // 100000 AS VARCHAR) || ',' || lpad(CAST(gross // 100 % 1000 AS VARCHAR), 3, '0') || ' ' ELSE 'n/a' END"


@query(f"SELECT k, CASE k % 4 WHEN 0 THEN gross WHEN 1 THEN -(gross // 100 * 100 + 50) WHEN 2 THEN gross // 100 * 100 END AS paise FROM (SELECT *, {AMOUNT} AS said FROM base_orders) x")
def parse_rupees(t: Inputs) -> DataFrame:
    """Amount texts of four shapes, made from the orders, back to paise."""
    g = F.col("gross")
    whole, cents = F.expr("gross div 100").cast("string"), F.lpad((g % 100).cast("string"), 2, "0")
    grouped = F.concat(F.lit(" "), F.expr("gross div 100000").cast("string"), F.lit(","), F.lpad(F.expr("(gross div 100) % 1000").cast("string"), 3, "0"), F.lit(" "))
    said = F.when(F.col("k") % 4 == 0, F.concat(F.lit("₹"), whole, F.lit("."), cents)).when(F.col("k") % 4 == 1, F.concat(F.lit("("), whole, F.lit(".5)"))).when(F.col("k") % 4 == 2, grouped).otherwise("n/a")
    return t["base_orders"].select("k", money.parse_rupees(said).alias("paise"))


@query("SELECT k, CAST(gross // 100 AS VARCHAR) || '.' || lpad(CAST(gross % 100 AS VARCHAR), 2, '0') AS rupees FROM base_orders")
def format_rupees(t: Inputs) -> DataFrame:
    return t["base_orders"].select("k", money.format_rupees(F.col("gross")).alias("rupees"))


@query("SELECT k, (gross * 236 + 5000) // 10000 AS up, CASE WHEN (gross * 25) % 10000 = 5000 AND (gross * 25 // 10000) % 2 = 0 THEN gross * 25 // 10000 ELSE (gross * 25 + 5000) // 10000 END AS even, gross - fee - tax - tds AS net FROM base_paid")
def pct_of(t: Inputs) -> DataFrame:
    """2.36 % half-up, 0.25 % half-even, and the net."""
    g = F.col("gross")
    return t["base_paid"].select("k", money.pct_of(g, F.lit("2.36")).alias("up"), money.pct_of(g, F.lit("0.25"), half_even=True).alias("even"), money.net_of(g, F.col("fee"), F.col("tax"), F.col("tds")).alias("net"))


GROSS = """--with rated AS (SELECT k, net, CASE WHEN k % 20 < 11 THEN 90 WHEN k % 20 < 16 THEN 236 WHEN k % 20 < 19 THEN 180 ELSE 200 END AS f, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS d FROM base_paid),
about AS (SELECT *, 1000000 - 118 * f - 10000 * d AS part FROM rated), tried AS (SELECT k, net, f, d, o, (2000000 * net + part) // (2 * part) + o AS g FROM about, (SELECT unnest(range(-4, 5)) AS o) x),
fees AS (SELECT *, (g * f + 5000) // 10000 AS fee FROM tried), left_over AS (SELECT k, o, g, abs(g - fee - (fee * 18 + 50) // 100 - (g * d + 50) // 100 - net) AS off FROM fees)
SELECT k, arg_min(g, 10 * off + o) AS gross, CAST(min(off) AS BIGINT) AS off FROM left_over GROUP BY k"""


@query(GROSS)
def reconstruct_gross(t: Inputs) -> DataFrame:
    """Gross rebuilt from the net at each payment's rates, and how far off the net is that it leads to."""
    at = F.col("k") % 20
    rate = F.when(at < 11, "0.90").when(at < 16, "2.36").when(at < 19, "1.80").otherwise("2.00")
    cut = F.when(F.col("k") % 7 == 0, "1").otherwise("0")
    rows = t["base_paid"].withColumn("g", money.reconstruct_gross(F.col("net"), rate, F.lit("18"), cut))
    fee = money.pct_of(F.col("g"), rate)
    off = F.abs(F.col("g") - fee - money.pct_of(fee, F.lit("18")) - money.pct_of(F.col("g"), cut) - F.col("net"))
    return rows.select("k", F.col("g").alias("gross"), off.alias("off"))


@query("--with tok AS (SELECT txn_id, list_distinct(regexp_extract_all(upper(narration), '\\b[A-Z]{4}\\d{6,12}\\b')) AS l FROM bank) SELECT txn_id, CAST(len(l) AS INT) AS n, l[1] AS first FROM tok")
def extract_utrs(t: Inputs) -> DataFrame:
    found = text.extract_utrs(F.col("narration"))
    return t["bank"].select("txn_id", F.size(found).alias("n"), F.get(found, F.lit(0)).alias("first"))


@query("SELECT invoice_id, regexp_replace(lower(order_id), '[^a-z0-9]', '', 'g') AS norm FROM invoices")
def normalise_id(t: Inputs) -> DataFrame:
    return t["invoices"].select("invoice_id", text.normalise_id(F.col("order_id")).alias("norm"))


@query("SELECT i.invoice_id, damerau_levenshtein(i.order_id, 'order_' || lpad(CAST(k * 100003 % 100000000000000 AS VARCHAR), 14, '0')) AS distance FROM invoices i JOIN truth t USING (invoice_id) WHERE i.order_id IS NOT NULL")
def damerau_levenshtein(t: Inputs) -> DataFrame:
    """Ledger order ids against the gateway's."""
    rows = t["invoices"].join(t["truth"], "invoice_id").where("order_id is not null").withColumn("want", F.concat(F.lit("order_"), F.lpad((F.col("k") * 100003 % 100000000000000).cast("string"), 14, "0")))
    return rows.select("invoice_id", text.damerau_levenshtein_of_many(F.col("order_id"), F.col("want"), 30).cast("long").alias("distance"))


@query("SELECT payment_id, regexp_extract(order_receipt, 'INV-\\d{4}-\\d{4,6}') AS hint FROM gateway WHERE regexp_matches(order_receipt, 'INV-\\d{4}-\\d{4,6}')")
def find_id_like(t: Inputs) -> DataFrame:
    return t["gateway"].select("payment_id", F.explode(text.find_id_like(F.col("order_receipt"))).alias("hint"))


CAL = "--with days AS (SELECT d, NOT (dayofweek(d) = 0 OR (dayofweek(d) = 6 AND (day(d) - 1) // 7 + 1 IN (2, 4)) OR d IN (" + ", ".join(f"DATE '{d}'" for d in calendar.HOLIDAYS) + ")) AS open FROM (SELECT CAST(unnest(generate_series(DATE '2025-12-01', DATE '2027-02-28', INTERVAL 1 DAY)) AS DATE) AS d) x), num AS (SELECT *, sum(CAST(open AS INT)) OVER (ORDER BY d) AS n FROM days), asked AS (SELECT DISTINCT CAST(DATE '2026-01-01' + CAST(n % 365 AS INT) AS DATE) AS day, CAST(k % 5 AS INT) AS count FROM base_orders) "


@query(CAL + "SELECT a.day, a.count, num.open AS open, CASE WHEN a.count = 0 THEN a.day ELSE g.d END AS due, datediff('day', a.day, CASE WHEN a.count = 0 THEN a.day ELSE g.d END) AS drift, datediff('day', a.day, CASE WHEN a.count = 0 THEN a.day ELSE g.d END) > 2 AS drifted FROM asked a JOIN num ON num.d = a.day LEFT JOIN num g ON g.open AND g.n = num.n + a.count AND a.count > 0")
def add_business_days(t: Inputs) -> DataFrame:
    """None to four working days after every order's day, moved into the year of the holidays."""
    cal = calendar.business_calendar(t.spark, date(2025, 12, 1), date(2027, 2, 28))
    days = t["base_orders"].select(F.date_add(F.lit(date(2026, 1, 1)), (F.col("n") % 365).cast("int")).alias("day"), (F.col("k") % 5).cast("int").alias("count")).distinct()
    out = calendar.add_business_days(days, "day", "count", cal, "due")
    day, due = F.col("day"), F.col("due")
    return out.select("day", "count", calendar.is_business_day(day).alias("open"), "due", calendar.drift_days(day, due).cast("long").alias("drift"), calendar.weekend_drift(day, due, 2).alias("drifted"))


@query("SELECT payment_id, 'm_' || substr(sha1('payment_to_invoice|' || payment_id || '|' || counterpart_id || '|l1_order_id_join'), 1, 12) AS match_id, substr(sha256('a' || chr(0) || payment_id), 1, 20) AS content_key FROM truth_invoice")
def match_id(t: Inputs) -> DataFrame:
    rows = t["truth_invoice"]
    return rows.select("payment_id", ids.match_id(F.lit(INVOICE), F.col("payment_id"), F.array("counterpart_id"), F.lit("l1_order_id_join")).alias("match_id"), ids.content_key(F.lit("a"), F.col("payment_id")).alias("content_key"))


@query(name="wilson_interval")
def _wilson(t: Inputs) -> DataFrame:
    """Interval of the share of payments with TDS, by method."""
    method = F.when(F.col("k") % 20 < 11, "upi").when(F.col("k") % 20 < 16, "card").when(F.col("k") % 20 < 19, "netbanking").otherwise("wallet")
    rows = t["base_paid"].groupBy(method.alias("method")).agg(F.count("*").alias("n"), F.count(F.when(F.col("tds") > 0, 1)).alias("kk"))
    low, high = stats.wilson_interval(F.col("kk"), F.col("n"))
    return rows.select("method", F.round(low, 6).alias("share_lo"), F.round(high, 6).alias("share_hi"))


ORACLE_SQL["wilson_interval"] = oracle_prefix() + " SELECT method, " + wilson("kk", "n", "share") + " FROM (SELECT CASE WHEN k % 20 < 11 THEN 'upi' WHEN k % 20 < 16 THEN 'card' WHEN k % 20 < 19 THEN 'netbanking' ELSE 'wallet' END AS method, count(*) AS n, count(*) FILTER (tds > 0) AS kk FROM base_paid GROUP BY 1) y"


@query("SELECT payment_id, entity_id, settlement_id, CAST(substr(created_at, 1, 10) AS DATE) AS created_on, CAST(substr(created_at, 12, 2) AS INT) - 6 + CASE WHEN CAST(substr(created_at, 15, 2) AS INT) >= 30 THEN 1 ELSE 0 END < 0 AS utc_is_a_day_earlier FROM gateway")
def parse_timestamp(t: Inputs) -> DataFrame:
    """The row's own date, and whether the instant's UTC date is another."""
    created = views.local_date(F.col("created_at"))
    instant = F.try_to_timestamp("created_at").cast("date")
    return t["gateway"].select("payment_id", "entity_id", "settlement_id", created.alias("created_on"), (instant < created).alias("utc_is_a_day_earlier"))


@query("SELECT txn_id, b.utr AS utr, length(b.utr) >= 10 AND length(b.utr) < length(whole) AND starts_with(whole, b.utr) AS truncated FROM (SELECT txn_id, substr(utr, 1, CAST(8 + credit % 9 AS INT)) AS utr, utr AS whole FROM bank WHERE utr IS NOT NULL) b")
def is_truncation_of(t: Inputs) -> DataFrame:
    """UTRs cut to 8 to 16 characters against themselves."""
    cut = F.expr("substring(utr, 1, cast(8 + credit % 9 as int))")
    return t["bank"].where("utr is not null").select("txn_id", cut.alias("utr"), text.is_truncation_of(cut, F.col("utr")).alias("truncated"))


@query("SELECT txn_id, 'x_' || substr(sha1('bank_txn|' || txn_id || '|None|unmatched_counterpart'), 1, 12) AS exception_id FROM bank")
def exception_id(t: Inputs) -> DataFrame:
    """Ids of exceptions without a link."""
    return t["bank"].select("txn_id", ids.exception_id(F.lit("bank_txn"), F.col("txn_id"), F.lit(None).cast("string"), F.lit("unmatched_counterpart")).alias("exception_id"))


@query("SELECT k, CASE k % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.8 ELSE 0.5 END AS confidence, CASE WHEN k % 4 = 0 THEN 0.0 ELSE CAST(gross AS DOUBLE) / (k % 4) END AS share FROM base_orders")
def confidence_for(t: Inputs) -> DataFrame:
    """Confidence of known and unknown rules, and a division by what may be zero."""
    rule = F.when(F.col("k") % 3 == 0, "l2_utr_fuzzy").when(F.col("k") % 3 == 1, "l2_invoice_amount_date_window").otherwise("unknown")
    return t["base_orders"].select("k", stats.confidence_for(rule).alias("confidence"), stats.safe_div(F.col("gross").cast("double"), F.col("k") % 4).alias("share"))


@query("SELECT b, CASE WHEN b % 4 = 3 THEN 0.0 ELSE ((100 + b % 50 + 0.10 * (b % 30) + 1.25 * (b % 20)) * 0.5 + (20 + b % 7) * 4.0) / 1000000 END AS usd FROM base_batches")
def call_cost_usd(t: Inputs) -> DataFrame:
    """Cost of each call of the derived log; an unknown model costs nothing."""
    b = F.col("b")
    rate = F.when(b % 4 == 3, F.lit(None).cast("double"))
    return t["base_batches"].select("b", stats.call_cost_usd(100 + b % 50, 20 + b % 7, b % 30, b % 20, rate.otherwise(0.5), rate.otherwise(4.0)).alias("usd"))


# --- files: the derived sources written as the formats' files and read back -------------------


def _folder(t: Inputs) -> str:
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


def _as_files(t: Inputs) -> str:
    """The three sources as CSV folders; columns that the derived tables lack are blank."""
    blank = F.lit("")
    gateway = t["gateway"].withColumns({"card_network": blank, "currency": F.lit("INR"), "description": blank})
    bank = t["bank"].withColumns({"posted_date": F.col("value_date"), "balance": F.lit(0), "ref_no": blank})
    ledger = t["invoices"].withColumns({"customer_name": blank, "tax_amount": F.lit(0), "currency": F.lit("INR"), "due_date": F.col("issue_date"), "po_number": blank, "status": F.lit("paid"), "notes": blank})
    folder = _folder(t)
    files.write_sources(folder, gateway, bank, ledger)
    return folder


@query("SELECT entity_type, entity_id, payment_id, order_id, order_receipt, method, amount, fee, tax, tds, credit, debit, settlement_id, settlement_utr, created_at, captured_at, settled_at FROM gateway")
def read_gateway(t: Inputs) -> DataFrame:
    return files.load_split(t.spark, _as_files(t))["gateway"].drop("card_network", "currency", "description")


@query("SELECT txn_id, value_date, narration, utr, credit, debit FROM bank")
def read_bank(t: Inputs) -> DataFrame:
    return files.load_split(t.spark, _as_files(t))["bank"].select("txn_id", "value_date", "narration", "utr", "credit", "debit")


@query("SELECT invoice_id, customer_id, order_id, invoice_amount, issue_date FROM invoices")
def read_invoices(t: Inputs) -> DataFrame:
    return files.load_split(t.spark, _as_files(t))["invoices"].select("invoice_id", "customer_id", "order_id", "invoice_amount", "issue_date")


@query("SELECT payment_id, counterpart_id FROM truth_bank UNION ALL SELECT payment_id, counterpart_id FROM truth_invoice")
def read_truth(t: Inputs) -> DataFrame:
    """The truth as JSON documents, one per 2000 payments, flattened again."""
    edges = t["truth_bank"].groupBy("payment_id").agg(F.collect_list("counterpart_id").alias("bank_txn_ids"))
    links = t["truth"].join(edges, "payment_id", "left").select(F.expr("k div 2000").alias("part"), F.struct("payment_id", F.when(F.col("has_invoice"), F.col("invoice_id")).alias("invoice_id"), F.coalesce("bank_txn_ids", F.expr("cast(array() as array<string>)")).alias("bank_txn_ids")).alias("link"))
    folder = _folder(t)
    links.groupBy("part").agg(F.collect_list("link").alias("links")).select("links").write.option("maxRecordsPerFile", 1).json(folder)
    found = files.read_truth(t.spark, folder)
    return found["bank_edges"].unionByName(found["invoice_edges"])


@query("SELECT kind AS section, tag AS name, count(DISTINCT payment_id) AS n FROM truth_tags GROUP BY 1, 2")
def read_manifest(t: Inputs) -> DataFrame:
    """Tag counts as a manifest file, read back as rows."""
    counts = t["truth_tags"].groupBy("kind", "tag").agg(F.count_distinct("payment_id").alias("n"))
    per_kind = counts.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("m"))
    body = per_kind.agg(F.map_from_entries(F.collect_list(F.struct("kind", "m"))).alias("manifest"))
    folder = _folder(t)
    body.write.json(folder)
    return files.read_manifest(t.spark, folder)


@query(name="read_transcript")
def _read_transcript(t: Inputs) -> DataFrame:
    """The derived call log as JSON lines in order, without numbers and with a model's own hashes; the last good record of each question, and the how-manieth about it that is."""
    folder = _folder(t)
    shown = t.whole_log.select("purpose", "system", "user", "response_text", F.coalesce("error", F.lit("")).alias("error"), F.lit("of a model").alias("prompt_hash"))
    shown.write.option("compression", "gzip").json(folder)
    return decisions.latest_answers(decisions.numbered(files.read_transcript(t.spark, folder))).select("prompt_hash", "seq", "response_text")


@query("SELECT 'gateway' AS source, row_number() OVER (ORDER BY coalesce(nullif(settled_at, ''), created_at), entity_id) AS line, entity_id AS id FROM gateway UNION ALL SELECT 'bank', row_number() OVER (ORDER BY value_date, txn_id), txn_id FROM bank UNION ALL SELECT 'invoices', row_number() OVER (ORDER BY invoice_id), invoice_id FROM invoices")
def write_sources(t: Inputs) -> DataFrame:
    """The three files, and the line on which each row stands when files are read by name."""
    folder, parts = _as_files(t), []
    for source, name, names in (("gateway", "gateway_settlements.csv", files.GATEWAY), ("bank", "bank_statement.csv", files.BANK), ("invoices", "erp_invoices.csv", files.INVOICES)):
        scan = t.spark.read.csv(f"{folder}/{name}", schema=", ".join(f"{c} string" for c in names), header=True)
        own = {"gateway": "entity_id", "bank": "txn_id", "invoices": "invoice_id"}[source]
        parts.append(order.line_numbers(order.with_place(scan).select("place", own)).select(F.lit(source).alias("source"), "line", F.col(own).alias("id")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def write_results(t: Inputs) -> DataFrame:
    """Matches, exceptions, scorecards and the call log published as one version, and all parts counted from the files."""
    folder = _folder(t)
    calls = t.transcript.withColumn("_seq", F.col("seq")).drop("seq")
    results.save(folder, *t.layered, scorecard(t), calls, order=["_seq", "prompt_hash"])
    kept = results.latest(t.spark, folder)
    parts = [
        kept.matches.groupBy(F.col("link_type").alias("part")).count(), kept.exceptions.groupBy(F.col("reason").alias("part")).count(),
        kept.part("scorecards").select(F.concat_ws(" ", "matcher", "link_type").alias("part"), F.col("true_positives").alias("count")),
        kept.part("calls").groupBy(F.when(F.col("error").isNull(), "answered calls").otherwise("failed calls").alias("part")).count(),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- views -----------------------------------------------------------------------------------


@query("--with " + PAYMENTS + "SELECT payment_id, order_id, order_receipt, method, gross, fee, tax, tds, net, row_count, captured_on, array_to_string(sids, ',') AS settlement_ids, array_to_string(utrs, ',') AS settlement_utrs FROM payments")
def payment_views(t: Inputs) -> DataFrame:
    return t.payments.select("payment_id", "order_id", "order_receipt", "method", "gross", "fee", "tax", "tds", "net", "row_count", "captured_on", joined("settlement_ids").alias("settlement_ids"), joined("settlement_utrs").alias("settlement_utrs"))


@query("SELECT entity_id, entity_type, payment_id, debit AS amount, settlement_id FROM gateway WHERE entity_type IN ('refund', 'adjustment')")
def refund_views(t: Inputs) -> DataFrame:
    return views.refund_views(t["gateway"]).select("entity_id", "entity_type", "payment_id", "amount", "settlement_id")


@query("--with " + BATCHES + "SELECT * FROM batches")
def settlement_batches(t: Inputs) -> DataFrame:
    return t.batches.select("settlement_id", "utr", "settled_date", "expected_credit", "expected_credit_dedup", "has_duplicate_refund_rows", "n_payments", "n_refunds", "n_adjustments")


_MEMBERS = "mb AS (SELECT DISTINCT settlement_id, 'payment' AS kind, payment_id AS member_id FROM gateway WHERE entity_type = 'payment' AND payment_id IS NOT NULL UNION ALL SELECT settlement_id, entity_type, entity_id FROM gateway WHERE entity_type <> 'payment')"


@query("--with " + _MEMBERS + " SELECT * FROM mb")
def batch_members(t: Inputs) -> DataFrame:
    return views.batch_members(t["gateway"])


@query("--with " + _MEMBERS + f" SELECT settlement_id, count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(kind || ' ' || member_id), 1, 15) AS HUGEINT)) % {views.SIGNS} AS BIGINT) AS sign FROM mb GROUP BY 1")
def batch_signs(t: Inputs) -> DataFrame:
    return views.batch_signs(views.batch_members(t["gateway"]))


@query("--with " + BATCHES + "SELECT entity_id, settlement_id, payment_id, debit FROM rep WHERE repeat")
def duplicate_refund_rows(t: Inputs) -> DataFrame:
    return views.duplicate_refund_rows(t["gateway"]).select("entity_id", "settlement_id", "payment_id", "debit")


@query("SELECT txn_id, CAST(1000000 + sum(credit - debit) OVER (ORDER BY value_date, txn_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM bank")
def running_balance(t: Inputs) -> DataFrame:
    return views.running_balance(t.bank, 1_000_000).select("txn_id", "balance")


# --- baselines -------------------------------------------------------------------------------


def _baseline_sql(use_date: bool) -> str:
    name = "amount_date" if use_date else "amount_only"
    bank = "(SELECT payment_id, sum(n) AS n, min(id) AS id FROM (SELECT DISTINCT payment_id, net, unnest(days) AS on_day FROM payments) p LEFT JOIN (SELECT credit, value_date, count(*) AS n, min(txn_id) AS id FROM bank GROUP BY 1, 2) c ON c.credit = p.net AND c.value_date = p.on_day GROUP BY 1)" if use_date else "(SELECT payment_id, n, id FROM payments p LEFT JOIN (SELECT credit, count(*) AS n, min(txn_id) AS id FROM bank GROUP BY 1) c ON c.credit = p.net)"
    on = " AND c.issue_date = p.captured_on" if use_date else ""
    led = f"(SELECT payment_id, n, id FROM payments p LEFT JOIN (SELECT invoice_amount{', issue_date' if use_date else ''}, count(*) AS n, min(invoice_id) AS id FROM invoices GROUP BY ALL) c ON c.invoice_amount = p.gross{on})"
    verdict = "CAST(coalesce(n, 0) AS BIGINT) AS candidates, CASE WHEN n = 1 THEN id END AS counterpart_id, CASE WHEN coalesce(n, 0) = 0 THEN 'no_candidate' WHEN n > 1 THEN 'ambiguous_candidates' END AS reason"
    return f"--with {PAYMENTS} SELECT payment_id, 'payment_to_bank' AS link_type, '{name}' AS matcher, {verdict} FROM {bank} a UNION ALL SELECT payment_id, 'payment_to_invoice', '{name}', {verdict} FROM {led} b"


@query(_baseline_sql(True))
def baseline_amount_date(t: Inputs) -> DataFrame:
    return baselines.baseline_amount(t.payments, t.bank, t.invoices, use_date=True)


@query(_baseline_sql(False))
def baseline_amount_only(t: Inputs) -> DataFrame:
    return baselines.baseline_amount(t.payments, t.bank, t.invoices, use_date=False)


@query("--with " + ID_JOIN + "SELECT link_type, payment_id, string_agg(counterpart_id, ',' ORDER BY counterpart_id) AS counterparts, CAST(NULL AS VARCHAR) AS reason FROM id_edges GROUP BY 1, 2 UNION ALL SELECT link_type, payment_id, NULL, reason FROM id_open")
def baseline_id_join(t: Inputs) -> DataFrame:
    return t.id_join.select("link_type", "payment_id", F.array_join(F.sort_array("counterpart_ids"), ",").alias("counterparts"), "reason")


@query("--with " + ID_JOIN + "SELECT 'bank_txn' AS subject_type, txn_id AS subject_id FROM bank WHERE txn_id NOT IN (SELECT counterpart_id FROM id_edges WHERE link_type = 'payment_to_bank') UNION ALL SELECT 'invoice', invoice_id FROM invoices WHERE invoice_id NOT IN (SELECT counterpart_id FROM id_edges WHERE link_type = 'payment_to_invoice')")
def unmatched_counterparts(t: Inputs) -> DataFrame:
    return baselines.unmatched_counterparts(t.id_edges, t.bank, t.invoices).select("subject_type", "subject_id")


# --- layers ----------------------------------------------------------------------------------


@query("--with " + BATCHES + "SELECT b.settlement_id AS subject_id, o.txn_id AS counterpart_id FROM batches b JOIN (SELECT utr, min(txn_id) AS txn_id FROM bank WHERE utr IS NOT NULL GROUP BY 1 HAVING count(*) = 1) o USING (utr)")
def l1_utr_column_join(t: Inputs) -> DataFrame:
    return exact.l1_utr_column_join(t.batches, t.bank).select("subject_id", "counterpart_id")


@query("--with " + ID_JOIN + "SELECT payment_id AS subject_id, counterpart_id FROM id_edges WHERE link_type = 'payment_to_invoice'")
def l1_order_id_join(t: Inputs) -> DataFrame:
    return exact.l1_order_id_join(t.payments, t.invoices).select("subject_id", "counterpart_id")


TOKENS = ", tok AS (SELECT txn_id, unnest(list_distinct(regexp_extract_all(upper(narration), '\\b[A-Z]{4}\\d{6,12}\\b'))) AS token FROM bank) "
RULE_SQL = {
    "l2_narration_utr_exact": "SELECT DISTINCT settlement_id AS subject_id, txn_id AS counterpart_id FROM batches JOIN tok ON token = utr",
    "l2_narration_utr_truncated": "SELECT DISTINCT settlement_id AS subject_id, txn_id AS counterpart_id FROM batches JOIN tok ON length(token) >= 10 AND length(token) < length(utr) AND starts_with(utr, token)",
    "l2_utr_fuzzy": "SELECT DISTINCT settlement_id AS subject_id, txn_id AS counterpart_id FROM batches b JOIN (SELECT txn_id, token FROM tok UNION SELECT txn_id, utr FROM bank WHERE utr IS NOT NULL) s ON length(s.token) = length(b.utr) AND substr(s.token, 1, 4) = substr(b.utr, 1, 4) AND damerau_levenshtein(s.token, b.utr) = 1 UNION SELECT settlement_id, txn_id FROM batches b JOIN (SELECT txn_id, token FROM tok UNION SELECT txn_id, utr FROM bank WHERE utr IS NOT NULL) s ON length(s.token) = length(b.utr) AND substr(s.token, 1, 4) <> substr(b.utr, 1, 4) AND substr(s.token, 6) = substr(b.utr, 6) AND damerau_levenshtein(s.token, b.utr) = 1",
    "l2_batch_amount_reconstruction": "SELECT settlement_id AS subject_id, txn_id AS counterpart_id FROM batches JOIN bank ON abs(credit - expected_credit) <= 10 AND abs(datediff('day', settled_date, value_date)) <= 2",
    "l2_batch_amount_reconstruction_deduped": "SELECT settlement_id AS subject_id, txn_id AS counterpart_id FROM batches JOIN bank ON abs(credit - expected_credit_dedup) <= 10 AND abs(datediff('day', settled_date, value_date)) <= 2",
    "l2_receipt_invoice_hint": "SELECT payment_id AS subject_id, invoice_id AS counterpart_id FROM payments JOIN invoices ON invoice_id = regexp_extract(order_receipt, 'INV-\\d{4}-\\d{4,6}')",
    "l2_order_id_normalised": "SELECT payment_id AS subject_id, invoice_id AS counterpart_id FROM payments p JOIN invoices i ON regexp_replace(lower(p.order_id), '[^a-z0-9]', '', 'g') = regexp_replace(lower(i.order_id), '[^a-z0-9]', '', 'g')",
    # ids are order_ and 14 digits; equal digit sums up to nine apart and equal lengths narrow the pairs, a swap or a substitution keeps all but two neighbouring places
    "l2_order_id_fuzzy": "SELECT DISTINCT payment_id AS subject_id, invoice_id AS counterpart_id FROM (SELECT payment_id, order_id AS a, unnest([substr(order_id, 1, 13), substr(order_id, 14)]) AS part FROM payments WHERE order_id IS NOT NULL) p JOIN (SELECT invoice_id, order_id AS b, unnest([substr(order_id, 1, 13), substr(order_id, 14)]) AS part FROM invoices WHERE order_id IS NOT NULL) i ON p.part = i.part AND length(a) = length(b) WHERE damerau_levenshtein(a, b) = 1",
    "l2_invoice_amount_date_window": "SELECT payment_id AS subject_id, invoice_id AS counterpart_id FROM payments p JOIN invoices i ON i.invoice_amount = p.gross AND datediff('day', issue_date, captured_on) BETWEEN 0 AND 14",
}
#: Subjects and counterparts that the exact layer leaves.
LEFT_BANK = BATCHES + ", l1b AS (SELECT b.settlement_id, o.txn_id FROM batches b JOIN (SELECT utr, min(txn_id) AS txn_id FROM bank WHERE utr IS NOT NULL GROUP BY 1 HAVING count(*) = 1) o USING (utr))"


def _rule_query(name: str, rule, leg: str) -> None:
    """Candidates of one rule over all subjects and counterparts."""

    def make(t: Inputs) -> DataFrame:
        return rule(t.batches, t.bank) if leg == "bank" else rule(t.payments, t.invoices)

    query("--with " + (BATCHES + TOKENS if leg == "bank" else PAYMENTS) + RULE_SQL[name], name=name)(make)


for _name, _rule in fuzzy.BANK_RULES:
    _rule_query(_name, _rule, "bank")
for _name, _rule in fuzzy.INVOICE_RULES:
    _rule_query(_name, _rule, "invoice")


def greedy_sql(edges: str, ed: str = "ed", gr: str = "gr") -> str:
    """Sequential claim-once over a table of edges (subject_id, rank, counterpart_id) as a recursion over subjects."""
    return f"""{ed} AS MATERIALIZED (SELECT DISTINCT dense_rank() OVER (ORDER BY subject_id) AS i, subject_id, rank, counterpart_id FROM ({edges}) e),
{gr} AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS claimed, CAST(NULL AS INT) AS rank, CAST(NULL AS VARCHAR) AS got
  UNION ALL SELECT g.i + 1, CASE WHEN w.c IS NULL THEN g.claimed ELSE list_append(g.claimed, w.c) END, w.rank, w.c
  FROM {gr} g LEFT JOIN LATERAL (SELECT rank, min(counterpart_id) AS c FROM {ed} x WHERE x.i = g.i + 1 AND NOT list_contains(g.claimed, x.counterpart_id) GROUP BY rank HAVING count(*) = 1 ORDER BY rank LIMIT 1) w ON TRUE
  WHERE g.i < (SELECT max(i) FROM {ed}))"""


def _edges_sql(rules) -> str:
    """All rules' candidates with their rank."""
    return " UNION ALL ".join(f"SELECT subject_id, {i} AS rank, counterpart_id FROM ({RULE_SQL[n]}) r{i}" for i, (n, _) in enumerate(rules))


def rule_case(rules, rank: str) -> str:
    return f"CASE {rank} " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(rules)) + " END"


RECURSIVE = "WITH RECURSIVE " + oracle_prefix().removeprefix("WITH ") + ","
GREEDY_BANK = LEFT_BANK + ", free_bank AS MATERIALIZED (SELECT * FROM bank WHERE txn_id NOT IN (SELECT txn_id FROM l1b)), open_batches AS MATERIALIZED (SELECT * FROM batches WHERE settlement_id NOT IN (SELECT settlement_id FROM l1b)), tok AS (SELECT txn_id, unnest(list_distinct(regexp_extract_all(upper(narration), '\\b[A-Z]{4}\\d{6,12}\\b'))) AS token FROM free_bank), " + greedy_sql(_edges_sql(fuzzy.BANK_RULES).replace("FROM batches b ", "FROM open_batches b ").replace("FROM batches ", "FROM open_batches ").replace("JOIN bank ON", "JOIN free_bank ON").replace("FROM bank WHERE", "FROM free_bank WHERE"), "edb", "grb")
GREEDY_INVOICE = ID_JOIN + ", l1i AS (SELECT payment_id, counterpart_id FROM id_edges WHERE link_type = 'payment_to_invoice'), open_payments AS MATERIALIZED (SELECT * FROM payments WHERE payment_id NOT IN (SELECT payment_id FROM l1i)), free_invoices AS MATERIALIZED (SELECT * FROM invoices WHERE invoice_id NOT IN (SELECT counterpart_id FROM l1i)), " + greedy_sql(_edges_sql(fuzzy.INVOICE_RULES).replace("FROM payments ", "FROM open_payments ").replace("JOIN invoices ", "JOIN free_invoices ").replace("FROM invoices ", "FROM free_invoices "), "edi", "gri")


@query(name="l2_greedy_assign_bank")
def _greedy_bank(t: Inputs) -> DataFrame:
    """Claim-once assignment of what the UTR join leaves."""
    done = written(exact.l1_utr_column_join(t.batches, t.bank))
    left = t.batches.join(done.select(F.col("subject_id").alias("settlement_id")), "settlement_id", "left_anti")
    free = t.bank.join(done.select(F.col("counterpart_id").alias("txn_id")).distinct(), "txn_id", "left_anti")
    return fuzzy.assign_batches(left, free).select("subject_id", "counterpart_id")


ORACLE_SQL["l2_greedy_assign_bank"] = RECURSIVE + GREEDY_BANK + " SELECT DISTINCT e.subject_id, g.got AS counterpart_id FROM grb g JOIN edb e ON e.i = g.i WHERE g.got IS NOT NULL"


@query(name="l2_greedy_assign_invoice")
def _greedy_invoice(t: Inputs) -> DataFrame:
    """Claim-once assignment of what the order id join leaves."""
    done = written(exact.l1_order_id_join(t.payments, t.invoices))
    left = t.payments.join(done.select(F.col("subject_id").alias("payment_id")), "payment_id", "left_anti")
    free = t.invoices.join(done.select(F.col("counterpart_id").alias("invoice_id")).distinct(), "invoice_id", "left_anti")
    return fuzzy.assign_invoices(left, free).select("subject_id", "counterpart_id", "rule")


ORACLE_SQL["l2_greedy_assign_invoice"] = RECURSIVE + GREEDY_INVOICE + f" SELECT DISTINCT e.subject_id, g.got AS counterpart_id, {rule_case(fuzzy.INVOICE_RULES, 'g.rank')} AS rule FROM gri g JOIN edi e ON e.i = g.i WHERE g.got IS NOT NULL"


# --- recorded decisions ----------------------------------------------------------------------


def _questions_of(leg: str, choices: DataFrame, rivals: DataFrame | None = None) -> DataFrame:
    """Questions of a leg; ``rivals``: what stands below those about batches, instead of sums by day."""
    system, most = (decisions.SYSTEM, None) if leg == "bank" else (decisions.INVOICE_SYSTEM, decisions.OFFERED)
    return decisions.l3_render_questions(choices.where(F.col("leg") == leg), system, most, rivals if leg == "bank" else None).withColumn("leg", F.lit(leg))


def _questions(choices: DataFrame, rivals: DataFrame | None = None) -> DataFrame:
    """Questions of both legs."""
    return _questions_of("bank", choices, rivals).unionByName(_questions_of("invoice", choices))


def _without_first(choices: DataFrame) -> DataFrame:
    """Choices without the first of each subject."""
    first = choices.groupBy("leg", "subject_id").agg(F.min("counterpart_id").alias("counterpart_id"))
    return choices.join(first, ["leg", "subject_id", "counterpart_id"], "left_anti")


def _transcript(questions: DataFrame) -> DataFrame:
    """A call log derived from the questions: most answered, some broken, failed or asked twice."""
    n = F.conv(F.substring("prompt_hash", 1, 6), 16, 10).cast("long")
    pick = F.regexp_extract("question", r"\n(?:credit|invoice) (\S+)", 1)
    good = F.to_json(F.struct(pick.alias("chosen_id"), F.lit(0.9).alias("confidence"), F.lit("closest total").alias("reasoning")))
    body = F.when(n % 7 == 0, F.lit("not json")).when(n % 7 == 1, F.lit('{"chosen_id":"bank_unknown","confidence":0.5,"reasoning":"guess"}')).when(n % 7 == 2, F.lit('{"chosen_id":null,"confidence":0.2,"reasoning":"none fits"}')).otherwise(good)
    system = F.when(F.col("leg") == "bank", decisions.SYSTEM).otherwise(decisions.INVOICE_SYSTEM).alias("system")
    first = F.struct(F.lit(1).alias("seq"), body.alias("response_text"), F.when(n % 5 == 0, "timeout").alias("error"))
    again = F.when(n % 11 == 0, F.struct(F.lit(2).alias("seq"), good.alias("response_text"), F.lit(None).cast("string").alias("error")))
    # the records of a question are neighbours, in order
    records = questions.select(F.concat("leg", F.lit(":"), "subject_id").alias("purpose"), "prompt_hash", system, F.col("question").alias("user"), F.explode(F.array_compact(F.array(first, again))).alias("r"))
    return records.select("purpose", "prompt_hash", "system", "user", "r.*")


L3_BANK = "l3c AS (SELECT settlement_id, txn_id, expected_credit_dedup AS total, credit, value_date FROM batches JOIN bank ON abs(datediff('day', settled_date, value_date)) <= 4 AND credit <= expected_credit_dedup + 10 AND 100 * (expected_credit_dedup - credit) / CAST(expected_credit_dedup AS DOUBLE) <= 5.0 WHERE expected_credit_dedup > 0)"


@query("--with " + BATCHES + "," + L3_BANK + " SELECT settlement_id, txn_id, total - credit AS short FROM l3c")
def l3_bank_candidates(t: Inputs) -> DataFrame:
    return decisions.l3_bank_candidates(t.batches, t.bank).select("settlement_id", "txn_id", (F.col("total") - F.col("credit")).alias("short"))


def _sign(told: str) -> str:
    return f"CAST('0x' || substr(sha256({told}), 1, 15) AS HUGEINT)"


def _rupees(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST(abs({x}) // 100 AS VARCHAR) || '.' || lpad(CAST(abs({x}) % 100 AS VARCHAR), 2, '0')"


def _rivals_sql(batches: str) -> str:
    """All pairs of batches within four days, added up by batch and day."""
    told = f"b.settlement_id || ' ' || {_rupees('b.expected_credit_dedup')}"
    return f"SELECT a.settlement_id, b.settled_date AS day, count(*) AS n, CAST(sum(b.expected_credit_dedup) AS BIGINT) AS total, CAST(sum({_sign(told)}) % {decisions.SIGNS} AS BIGINT) AS sign FROM {batches} a JOIN {batches} b ON a.settlement_id <> b.settlement_id AND abs(datediff('day', a.settled_date, b.settled_date)) <= 4 GROUP BY 1, 2"


@query("--with " + BATCHES + "SELECT a.settlement_id, b.settlement_id AS other_id FROM batches a JOIN batches b ON a.settlement_id <> b.settlement_id AND abs(datediff('day', a.settled_date, b.settled_date)) <= 4")
def l3_competing_batches(t: Inputs) -> DataFrame:
    """Every batch with each other one that settles within four days."""
    return decisions.competing_pairs(t.batches)


@query("--with " + BATCHES + f"SELECT settled_date AS day, CAST(0 AS BIGINT) AS block, count(*) AS n, string_agg(settlement_id || ' ' || {_rupees('expected_credit_dedup')}, ', ' ORDER BY settlement_id) AS said FROM batches WHERE settled_date IS NOT NULL GROUP BY 1")
def l3_rival_blocks(t: Inputs) -> DataFrame:
    """Open batches of each day by name; a day of the derived tables is one block."""
    return decisions.rival_blocks(t.batches)


_L3_SUBJECTS = "l3p AS (SELECT p.* FROM payments p WHERE p.order_id IS NULL), l3i AS (SELECT * FROM invoices WHERE order_id IS NULL)"


@query("--with " + PAYMENTS + "," + _L3_SUBJECTS + " SELECT payment_id, invoice_id, CAST(place AS INT) AS place FROM (SELECT payment_id, invoice_id, row_number() OVER (PARTITION BY payment_id ORDER BY invoice_id) AS place FROM l3p JOIN l3i ON abs(datediff('day', captured_on, issue_date)) <= 21 AND abs(invoice_amount - gross) <= gross * CAST(0.15 AS DOUBLE)) x WHERE place <= 12")
def l3_invoice_candidates(t: Inputs) -> DataFrame:
    """Payments and invoices without an order id."""
    return decisions.l3_invoice_candidates(t.payments.where("order_id is null"), t.invoices.where("order_id is null")).select("payment_id", "invoice_id", "place")


CONFIDENCE = "CASE rule " + " ".join(f"WHEN '{n}' THEN {c}" for n, c in stats.RULE_CONFIDENCE.items()) + f" ELSE CAST(0.9 AS DOUBLE) * {stats.CEILING} END"
_SHORT = "(total - credit)"
_HUNDREDTHS = f"(CASE WHEN {_SHORT} < 0 THEN -1 ELSE 1 END * ((2 * abs({_SHORT}) * 10000 + total) // (2 * total)))"
_BY_DAY = f"rivals AS (SELECT settlement_id, string_agg(day || ' ' || n || ' of ' || {_rupees('total')} || ' #' || sign, '; ' ORDER BY day) AS said FROM ({_rivals_sql('ob')}) x GROUP BY 1)"
_BY_NAME = f"rivals AS (SELECT a.settlement_id, string_agg(b.settlement_id || ' ' || {_rupees('b.expected_credit_dedup')}, ', ' ORDER BY b.settlement_id) AS said FROM ob a JOIN ob b ON a.settlement_id <> b.settlement_id AND abs(datediff('day', a.settled_date, b.settled_date)) <= 4 GROUP BY 1)"
#: What two layers leave, the questions about it, and the derived answers.
RESIDUE = RECURSIVE + GREEDY_BANK + "," + GREEDY_INVOICE + f""",
two_bank AS MATERIALIZED (SELECT settlement_id, txn_id, 'l1_utr_column_join' AS rule, 'l1_exact' AS layer FROM l1b UNION ALL SELECT DISTINCT e.subject_id, g.got, {rule_case(fuzzy.BANK_RULES, 'g.rank')}, 'l2_fuzzy' FROM grb g JOIN edb e ON e.i = g.i WHERE g.got IS NOT NULL),
two_inv AS MATERIALIZED (SELECT payment_id, counterpart_id AS invoice_id, 'l1_order_id_join' AS rule, 'l1_exact' AS layer FROM l1i UNION ALL SELECT DISTINCT e.subject_id, g.got, {rule_case(fuzzy.INVOICE_RULES, 'g.rank')}, 'l2_fuzzy' FROM gri g JOIN edi e ON e.i = g.i WHERE g.got IS NOT NULL),
ob AS MATERIALIZED (SELECT * FROM batches WHERE settlement_id NOT IN (SELECT settlement_id FROM two_bank)), fb AS MATERIALIZED (SELECT * FROM bank WHERE txn_id NOT IN (SELECT txn_id FROM two_bank)),
op AS MATERIALIZED (SELECT * FROM payments WHERE payment_id NOT IN (SELECT payment_id FROM two_inv)), fi AS MATERIALIZED (SELECT * FROM invoices WHERE invoice_id NOT IN (SELECT invoice_id FROM two_inv)),
{_BY_DAY},
cb AS (SELECT settlement_id, txn_id, expected_credit_dedup AS total, credit, value_date FROM ob JOIN fb ON abs(datediff('day', settled_date, value_date)) <= 4 AND credit <= expected_credit_dedup + 10 AND 100 * (expected_credit_dedup - credit) / CAST(expected_credit_dedup AS DOUBLE) <= 5.0 WHERE expected_credit_dedup > 0),
ch AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY leg, subject_id ORDER BY c) AS rn FROM (
    SELECT 'bank' AS leg, settlement_id AS subject_id, 'batch ' || settlement_id || ' total ' || {_rupees('total')} AS head, coalesce(chr(10) || 'other open batches by day: ' || said, '') AS tail, txn_id AS c,
        'credit ' || txn_id || ' | ' || {_rupees('credit')} || ' | on ' || CAST(value_date AS VARCHAR) || ' | short by ' || {_rupees(_SHORT)} || ' (' || {_rupees(_HUNDREDTHS)} || '%)' AS line FROM cb LEFT JOIN rivals USING (settlement_id)
    UNION ALL SELECT 'invoice', payment_id, 'payment ' || payment_id || ' of ' || {_rupees('gross')} || ' captured ' || CAST(captured_on AS VARCHAR) || ' order ' || coalesce(p.order_id, 'none') || ' receipt ' || coalesce(order_receipt, 'none'), '', invoice_id,
        'invoice ' || invoice_id || ' | ' || {_rupees('invoice_amount')} || ' | differs by ' || {_rupees('(invoice_amount - gross)')} || ' | issued ' || CAST(issue_date AS VARCHAR)
        FROM op p JOIN fi i ON abs(datediff('day', captured_on, issue_date)) <= 21 AND abs(invoice_amount - gross) <= gross * CAST(0.15 AS DOUBLE)) x),
sy AS (SELECT * FROM (VALUES ('bank', '{decisions.SYSTEM}', 1000000000), ('invoice', '{decisions.INVOICE_SYSTEM}', {decisions.OFFERED})) v(leg, system, most)),
qs AS (SELECT leg, subject_id, v, count(*) AS offered, min(head) || chr(10) || string_agg(line, chr(10) ORDER BY c) || min(tail) AS question, min(c) AS first FROM ch JOIN sy USING (leg), (VALUES (0), (1)) w(v) WHERE rn > v AND rn <= most + v GROUP BY 1, 2, 3),
q AS MATERIALIZED (SELECT qs.*, substr(sha256(system || chr(0) || question), 1, 20) AS prompt_hash FROM qs JOIN sy USING (leg)),
tn AS (SELECT *, CAST('0x' || substr(prompt_hash, 1, 6) AS BIGINT) AS n, '{{"chosen_id":"' || first || '","confidence":0.9,"reasoning":"closest total"}}' AS good FROM q),
ta AS MATERIALIZED (SELECT *, CASE WHEN n % 11 = 0 OR n % 7 > 2 THEN 'good' WHEN n % 7 = 0 THEN 'broken' WHEN n % 7 = 1 THEN 'unknown' ELSE 'none' END AS kind, n % 11 <> 0 AND n % 5 = 0 AS missed FROM tn)
"""
#: The same with all other open batches by name below a question.
WHOLE = RESIDUE.replace(_BY_DAY, _BY_NAME).replace("other open batches by day: ", "other open batches: ")
RESPONSE = """CASE WHEN missed THEN NULL WHEN kind = 'good' THEN good WHEN kind = 'broken' THEN 'not json' WHEN kind = 'unknown' THEN '{"chosen_id":"bank_unknown","confidence":0.5,"reasoning":"guess"}' ELSE '{"chosen_id":null,"confidence":0.2,"reasoning":"none fits"}' END"""


def in_turn_sql(leg: str) -> str:
    """The answers applied one subject after another, as a recursion that carries what is taken."""
    ed, out = f"l3e_{leg}", f"l3r_{leg}"
    return f"""{ed} AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY subject_id) AS i, subject_id, head, tail, c, line FROM ch WHERE leg = '{leg}' AND subject_id IN (SELECT subject_id FROM ta WHERE leg = '{leg}' AND NOT missed)),
{out} AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS claimed, CAST(NULL AS VARCHAR) AS h, CAST(0 AS BIGINT) AS offered, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS first
  UNION ALL SELECT g.i + 1, CASE WHEN w.kind = 'good' THEN list_append(g.claimed, w.first) ELSE g.claimed END, w.h, w.offered, w.kind, w.first
  FROM {out} g LEFT JOIN LATERAL (SELECT y.h, y.offered, a.kind, a.first FROM (
      SELECT substr(sha256((SELECT system FROM sy WHERE leg = '{leg}') || chr(0) || min(head) || chr(10) || string_agg(line, chr(10) ORDER BY c) || min(tail)), 1, 20) AS h, count(*) AS offered
      FROM (SELECT head, tail, c, line FROM (SELECT x.*, row_number() OVER (ORDER BY c) AS rn FROM {ed} x WHERE x.i = g.i + 1 AND NOT list_contains(g.claimed, x.c)) z WHERE rn <= (SELECT most FROM sy WHERE leg = '{leg}')) o) y
      LEFT JOIN (SELECT prompt_hash, kind, first FROM ta WHERE leg = '{leg}' AND NOT missed) a ON a.prompt_hash = y.h WHERE y.offered > 0) w ON TRUE
  WHERE g.i < (SELECT max(i) FROM {ed})),
l3_{leg} AS MATERIALIZED (SELECT DISTINCT e.subject_id, r.h, r.offered, r.first, r.kind, CASE WHEN r.kind IS NULL THEN 'missed' WHEN r.kind = 'broken' THEN 'invalid' WHEN r.kind = 'good' THEN 'accepted' WHEN r.kind = 'none' THEN 'declined' ELSE 'not_offered' END AS outcome FROM {out} r JOIN {ed} e ON e.i = r.i WHERE r.h IS NOT NULL)"""


IN_TURN = RESIDUE + "," + in_turn_sql("bank") + "," + in_turn_sql("invoice")


@query(name="l3_render_questions")
def _render(t: Inputs) -> DataFrame:
    """Questions about what two layers leave open, on both legs; those about batches name all others that are open."""
    return t.whole_questions.select("leg", "subject_id", "offered", "question", "prompt_hash")


ORACLE_SQL["l3_render_questions"] = WHOLE + "SELECT leg, subject_id, offered, question, prompt_hash FROM q WHERE v = 0"


@query(name="l3_replay_join")
def _replay(t: Inputs) -> DataFrame:
    return decisions.l3_replay_join(t.questions, t.transcript).select("subject_id", "prompt_hash", "response_text", "missed")


ORACLE_SQL["l3_replay_join"] = RESIDUE + f"SELECT subject_id, prompt_hash, missed, {RESPONSE} AS response_text FROM ta WHERE v = 0"


@query(name="l3_validate_decision")
def _validate(t: Inputs) -> DataFrame:
    answers = decisions.l3_replay_join(t.questions, t.transcript).where("not missed").select("subject_id", "response_text")
    return decisions.l3_validate_decision(answers).drop("response_text", "inferred_deduction_paise")


ORACLE_SQL["l3_validate_decision"] = RESIDUE + "SELECT subject_id, CASE kind WHEN 'good' THEN first WHEN 'unknown' THEN 'bank_unknown' END AS chosen_id, CASE kind WHEN 'good' THEN 0.9 WHEN 'unknown' THEN 0.5 WHEN 'none' THEN 0.2 END AS raw_confidence, CASE kind WHEN 'good' THEN 'closest total' WHEN 'unknown' THEN 'guess' WHEN 'none' THEN 'none fits' END AS reasoning, kind <> 'broken' AS valid FROM ta WHERE v = 0 AND NOT missed"


@query(name="l3_accept")
def _accept(t: Inputs) -> DataFrame:
    """Every recorded decision taken in turn: what was asked then, and what came of it."""
    bank = decisions.decide_in_turn(t.of_leg("choices", "bank"), t.of_leg("transcript", "bank"))
    ledger = decisions.decide_invoices_in_turn(*assemble.open_rows(assemble.INVOICE_LEG, t.payments, t.invoices, t.found_invoice), t.of_leg("transcript", "invoice"))
    both = bank.withColumn("leg", F.lit("bank")).unionByName(ledger.withColumn("leg", F.lit("invoice")))
    return both.select("leg", "subject_id", "prompt_hash", "offered", "outcome", "chosen_id", "raw_confidence")


ORACLE_SQL["l3_accept"] = IN_TURN + " UNION ALL ".join(f" SELECT '{leg}' AS leg, subject_id, h AS prompt_hash, CAST(offered AS INT) AS offered, outcome, CASE kind WHEN 'good' THEN first WHEN 'unknown' THEN 'bank_unknown' END AS chosen_id, CASE kind WHEN 'good' THEN 0.9 WHEN 'unknown' THEN 0.5 WHEN 'none' THEN 0.2 END AS raw_confidence FROM l3_{leg}" for leg in ("bank", "invoice"))
ORACLE_SQL["read_transcript"] = WHOLE + f"SELECT prompt_hash, CAST(CASE WHEN n % 11 = 0 THEN 2 ELSE 1 END AS BIGINT) AS seq, {RESPONSE} AS response_text FROM ta WHERE NOT missed"


@query(name="l3_resume_plan")
def _resume(t: Inputs) -> DataFrame:
    """Questions, by their key, that the log leaves unanswered; those about batches name all others that are open."""
    return decisions.l3_resume_plan(t.whole_questions, t.whole_transcript).select("subject_id", "prompt_hash")


ORACLE_SQL["l3_resume_plan"] = WHOLE + "SELECT subject_id, prompt_hash FROM ta WHERE v = 0 AND missed"


# --- assembly --------------------------------------------------------------------------------

_TOKENS = "list_distinct(regexp_extract_all(upper(narration), '\\b[A-Z]{4}\\d{6,12}\\b'))"
_CREDIT = f"'credit ' || txn_id || ' of ' || {_rupees('credit')} || ' on ' || CAST(value_date AS VARCHAR)"
_HOLDS = "'the batch holds ' || n_payments || ' payment(s)'"
_ANSWER = "'recorded answer ' || h || ' to a question with ' || offered || ' candidate(s)'"
_INVOICE = f"'invoice ' || invoice_id || ' of ' || {_rupees('invoice_amount')} || ' issued ' || CAST(issue_date AS VARCHAR)"
_TOOK = f"[{_ANSWER}, 'its reason: closest total', 'its confidence 0.90 counts as 0.77']"


def _total(column: str, how: str) -> str:
    return f"'batch total {how} is ' || {_rupees(column)}, {_CREDIT} || ', off by ' || (credit - {column}) || ' paise'"


LAYERED = IN_TURN + "," + TRUTH + f""",
res_bank AS (SELECT settlement_id, txn_id, rule, layer, CASE rule
    WHEN 'l1_utr_column_join' THEN ['UTR ' || b.utr || ' stands in the statement''s column once', {_CREDIT}, {_HOLDS}]
    WHEN 'l2_narration_utr_exact' THEN ['UTR ' || b.utr || ' stands whole in the narration', 'narration: ' || narration, {_HOLDS}]
    WHEN 'l2_narration_utr_truncated' THEN ['the narration shows ' || list_filter({_TOKENS}, lambda t: length(t) >= 10 AND length(t) < length(b.utr) AND starts_with(b.utr, t))[1] || ', how ' || b.utr || ' begins', 'narration: ' || narration, {_HOLDS}]
    WHEN 'l2_utr_fuzzy' THEN ['the statement shows ' || list_filter(list_concat({_TOKENS}, CASE WHEN k.utr IS NULL THEN [] ELSE [k.utr] END), lambda t: length(t) = length(b.utr) AND damerau_levenshtein(t, b.utr) = 1)[1] || ', one edit from ' || b.utr, {_CREDIT}, {_HOLDS}]
    WHEN 'l2_batch_amount_reconstruction' THEN [{_total('expected_credit', 'as reported')}, {_HOLDS}]
    WHEN 'l2_batch_amount_reconstruction_deduped' THEN list_concat([{_total('expected_credit_dedup', 'without repeated refunds')}], CASE WHEN has_duplicate_refund_rows THEN ['a refund of one payment and amount is reported twice'] ELSE [] END, [{_HOLDS}]) END AS evidence
    FROM two_bank JOIN batches b USING (settlement_id) JOIN bank k USING (txn_id) UNION ALL SELECT subject_id, first, '{stats.L3_BANK}', 'l3_llm', {_TOOK} FROM l3_bank WHERE outcome = 'accepted'),
res_inv AS (SELECT payment_id, invoice_id, rule, layer, CASE rule
    WHEN 'l1_order_id_join' THEN ['order ' || p.order_id || ' stands on one invoice', {_INVOICE}]
    WHEN 'l2_receipt_invoice_hint' THEN ['receipt ' || order_receipt || ' names the invoice', {_INVOICE}]
    WHEN 'l2_order_id_normalised' THEN ['orders ' || p.order_id || ' and ' || i.order_id || ' differ in case and signs only', {_INVOICE}]
    WHEN 'l2_order_id_fuzzy' THEN ['orders ' || p.order_id || ' and ' || i.order_id || ' are one edit apart', {_INVOICE}]
    ELSE [{_INVOICE}, 'capture followed on ' || captured_on || ', ' || datediff('day', issue_date, captured_on) || ' day(s) later'] END AS evidence
    FROM two_inv JOIN payments p USING (payment_id) JOIN invoices i USING (invoice_id) UNION ALL SELECT subject_id, first, '{stats.L3_INVOICE}', 'l3_llm', {_TOOK} FROM l3_invoice WHERE outcome = 'accepted'),
refused AS (SELECT leg, subject_id, list_concat([{_ANSWER}, 'its reason: ' || CASE kind WHEN 'none' THEN 'none fits' ELSE 'guess' END], CASE kind WHEN 'none' THEN [] ELSE ['it names bank_unknown, which was not on offer'] END, ['its confidence ' || CASE kind WHEN 'none' THEN '0.20' ELSE '0.50' END]) AS said FROM (SELECT 'bank' AS leg, * FROM l3_bank UNION ALL SELECT 'invoice', * FROM l3_invoice) x WHERE outcome IN ('declined', 'not_offered')),
riders AS (SELECT payment_id, unnest(sids) AS settlement_id, unnest(range(1, len(sids) + 1)) AS pos FROM payments),
parts AS (SELECT r.payment_id, r.settlement_id, r.pos, b.txn_id, b.rule, b.layer, b.evidence, {CONFIDENCE.replace('CASE rule', 'CASE b.rule')} AS confidence FROM riders r LEFT JOIN res_bank b USING (settlement_id)),
tied AS (SELECT payment_id, list(txn_id ORDER BY txn_id) FILTER (txn_id IS NOT NULL) AS cs, arg_min(layer, (confidence, pos)) FILTER (txn_id IS NOT NULL) AS layer, min(confidence) FILTER (txn_id IS NOT NULL) AS confidence, string_agg(DISTINCT rule, '+' ORDER BY rule) AS rule, count(txn_id) AS hit, count(*) AS legs, flatten(list(evidence ORDER BY pos) FILTER (txn_id IS NOT NULL)) AS ev FROM parts GROUP BY 1),
matches AS (SELECT 'payment_to_bank' AS link_type, payment_id, cs, layer, rule, confidence, list_concat(ev, CASE WHEN hit < legs THEN ['tied: ' || hit || ' of ' || legs || ' payouts of this payment; the others are exceptions'] ELSE [] END) AS evidence FROM tied WHERE hit > 0
    UNION ALL SELECT 'payment_to_invoice', payment_id, [invoice_id], layer, rule, {CONFIDENCE}, evidence FROM res_inv),
lay_edges AS (SELECT DISTINCT link_type, payment_id, unnest(cs) AS counterpart_id FROM matches),
opened AS (SELECT 'payment' AS subject_type, payment_id AS subject_id, link_type, CASE WHEN said IS NULL THEN 'no_candidate' ELSE 'llm_declined' END AS reason, CASE WHEN said IS NULL THEN missing ELSE 'a recorded answer refused to link it' END AS detail, 'l3_llm' AS layer_reached, list_concat([missing], coalesce(said, [])) AS evidence FROM (
        SELECT payment_id, 'payment_to_bank' AS link_type, said, 'no bank credit is tied to payout ' || settlement_id AS missing FROM parts p LEFT JOIN refused d ON d.leg = 'bank' AND d.subject_id = p.settlement_id WHERE txn_id IS NULL
        UNION ALL SELECT payment_id, 'payment_to_invoice', said, 'no invoice is tied to the payment' FROM payments p LEFT JOIN refused d ON d.leg = 'invoice' AND d.subject_id = p.payment_id WHERE payment_id NOT IN (SELECT payment_id FROM res_inv)) x
    UNION ALL SELECT 'bank_txn', txn_id, 'payment_to_bank', 'unmatched_counterpart', 'no payout uses this credit', 'l3_llm', ['credit of ' || {_rupees('credit')} || ' on ' || value_date, 'narration: ' || narration] FROM bank WHERE txn_id NOT IN (SELECT counterpart_id FROM lay_edges)
    UNION ALL SELECT 'invoice', invoice_id, 'payment_to_invoice', 'unmatched_counterpart', 'no payment uses this invoice', 'l3_llm', ['invoice of ' || {_rupees('invoice_amount')} || ' issued ' || issue_date, 'customer ' || customer_id] FROM invoices WHERE invoice_id NOT IN (SELECT counterpart_id FROM lay_edges))
"""
_MATCH_ID = "'m_' || substr(sha1(link_type || '|' || payment_id || '|' || array_to_string(cs, ',') || '|' || rule), 1, 12)"
ORACLE_SQL["run_layered"] = LAYERED + f"SELECT {_MATCH_ID} AS match_id, link_type, payment_id, array_to_string(cs, ',') AS counterparts, layer, rule, round(CAST(confidence AS DOUBLE), 6) AS confidence, CAST(len(evidence) AS INT) AS lines, CASE link_type WHEN 'payment_to_bank' THEN 'bank,gateway,settlement' ELSE 'erp,gateway' END AS record_kinds FROM matches"
ORACLE_SQL["run_layered_summary"] = LAYERED + "SELECT link_type, layer, rule, count(*) AS payments, CAST(sum(len(cs)) AS BIGINT) AS edges FROM matches GROUP BY ALL"
ORACLE_SQL["build_exceptions"] = LAYERED + "SELECT 'x_' || substr(sha1(subject_type || '|' || subject_id || '|' || link_type || '|' || reason), 1, 12) AS exception_id, * EXCLUDE (evidence), CAST(0 AS INT) AS candidates_considered, array_to_string(evidence, ' | ') AS evidence FROM opened"
ORACLE_SQL["layer3_payment_count"] = LAYERED + "SELECT count(DISTINCT payment_id) AS payments FROM matches WHERE layer = 'l3_llm'"
ORACLE_SQL["rule_counts"] = LAYERED + "SELECT rule, count(*) AS n FROM (SELECT rule FROM parts WHERE txn_id IS NOT NULL UNION ALL SELECT rule FROM res_inv) x GROUP BY 1"
ORACLE_SQL["evidence_lines"] = LAYERED + "SELECT link_type, payment_id, unnest(range(len(evidence))) AS place, unnest(evidence) AS line FROM matches"
ORACLE_SQL["propagate_bank_matches"] = LAYERED + f"SELECT {_MATCH_ID} AS match_id, payment_id, array_to_string(cs, ',') AS counterparts, len(cs) AS tied, layer, rule FROM matches WHERE link_type = 'payment_to_bank'"
ORACLE_SQL["invoice_matches"] = LAYERED + f"SELECT {_MATCH_ID} AS match_id, payment_id, rule FROM matches WHERE link_type = 'payment_to_invoice'"


@query()
def run_layered(t: Inputs) -> DataFrame:
    matches, _ = t.layered
    return matches.select("match_id", "link_type", "payment_id", joined("counterpart_ids").alias("counterparts"), "layer", "rule", F.round("confidence", 6).alias("confidence"), F.size("evidence").alias("lines"), F.array_join(F.sort_array(F.map_keys("source_records")), ",").alias("record_kinds"))


@query()
def run_layered_summary(t: Inputs) -> DataFrame:
    """Matches by leg and rule: the flagship question, end to end."""
    matches, _ = t.layered
    return matches.groupBy("link_type", "layer", "rule").agg(F.count("*").alias("payments"), F.sum(F.size("counterpart_ids")).alias("edges"))


@query()
def build_exceptions(t: Inputs) -> DataFrame:
    return t.layered[1].select("exception_id", "subject_type", "subject_id", "link_type", "reason", "detail", "layer_reached", "candidates_considered", F.array_join("evidence", " | ").alias("evidence"))


@query()
def propagate_bank_matches(t: Inputs) -> DataFrame:
    """Riders of the batches that any layer resolves."""
    found = assemble.propagate_bank_matches(t.payments, t.by_batch[0])
    return found.select("match_id", "payment_id", joined("counterpart_ids").alias("counterparts"), F.size("counterpart_ids").cast("long").alias("tied"), "layer", "rule")


@query()
def invoice_matches(t: Inputs) -> DataFrame:
    return assemble.invoice_matches(t.by_payment[0]).select("match_id", "payment_id", "rule")


@query(LAYERED + "SELECT settlement_id AS subject_id, txn_id AS counterpart_id, layer, rule FROM res_bank")
def resolve_bank_leg(t: Inputs) -> DataFrame:
    return t.by_batch[0].select("subject_id", "counterpart_id", "layer", "rule")


@query(LAYERED + "SELECT payment_id AS subject_id, invoice_id AS counterpart_id, layer, rule FROM res_inv")
def resolve_invoice_leg(t: Inputs) -> DataFrame:
    return t.by_payment[0].select("subject_id", "counterpart_id", "layer", "rule")


@query()
def evidence_lines(t: Inputs) -> DataFrame:
    """Every line of every match."""
    return t.layered[0].select("link_type", "payment_id", F.posexplode("evidence").alias("place", "line")).withColumn("place", F.col("place").cast("long"))


@query()
def rule_counts(t: Inputs) -> DataFrame:
    """Parts of payments that each rule ties."""
    return assemble.rule_counts(t.payments, t.by_batch[0], t.by_payment[0])


# --- scoring: the layered answer against the truth -------------------------------------------

SCORED = LAYERED + """,
edges AS (SELECT link_type, payment_id, counterpart_id, t IS NOT NULL AS in_truth, p IS NOT NULL AS in_pred FROM (SELECT DISTINCT *, 1 AS t FROM truth_edges) a FULL JOIN (SELECT *, 1 AS p FROM lay_edges) b USING (link_type, payment_id, counterpart_id)),
per_payment AS (SELECT link_type, payment_id, count(*) FILTER (in_truth) AS n_truth, count(*) FILTER (in_pred) AS n_pred, count(*) FILTER (in_truth AND in_pred) AS n_both, bool_and(in_truth = in_pred) AS exact FROM edges GROUP BY 1, 2)
"""
TOTALS = "CAST(sum(n_truth) AS BIGINT) AS truth_edges, CAST(sum(n_pred) AS BIGINT) AS predicted_edges, CAST(sum(n_both) AS BIGINT) AS true_positives, count(*) FILTER (n_truth > 0) AS resolvable, count(*) FILTER (n_truth > 0 AND exact) AS exactly_resolved, count(*) FILTER (n_truth > 0 AND n_pred > 0) AS matched"
RATES = ", ".join((ratio("true_positives", "predicted_edges", "precision"), wilson("true_positives", "predicted_edges", "precision"), ratio("true_positives", "truth_edges", "recall"), wilson("true_positives", "truth_edges", "recall"), ratio("2 * true_positives", "(predicted_edges + truth_edges)", "f1"), ratio("exactly_resolved", "resolvable", "exact_rate"), wilson("exactly_resolved", "resolvable", "exact_rate"), ratio("matched", "resolvable", "match_rate")))


def _edges(t: Inputs) -> DataFrame:
    return score.edge_frame(t.truth_edges, t.layered_edges)


@query(name="score_links")
def _score_links(t: Inputs) -> DataFrame:
    """At two thresholds of confidence."""
    parts = [score.score_links(score.edge_frame(t.truth_edges, baselines.as_edges(t.layered[0], threshold=x))).withColumn("threshold", F.lit(x)) for x in (0.0, 0.96)]
    return parts[0].unionByName(parts[1])


ORACLE_SQL["score_links"] = LAYERED + f""",
sure AS (SELECT DISTINCT threshold, link_type, payment_id, unnest(cs) AS counterpart_id FROM matches, (VALUES (0.0), (0.96)) v(threshold) WHERE confidence >= threshold),
pp AS (SELECT threshold, link_type, payment_id, count(*) FILTER (in_truth) AS n_truth, count(*) FILTER (in_pred) AS n_pred, count(*) FILTER (in_truth AND in_pred) AS n_both, bool_and(in_truth = in_pred) AS exact FROM (
    SELECT threshold, link_type, payment_id, t IS NOT NULL AS in_truth, p IS NOT NULL AS in_pred FROM (SELECT DISTINCT threshold, x.*, 1 AS t FROM truth_edges x, (VALUES (0.0), (0.96)) v(threshold)) a FULL JOIN (SELECT *, 1 AS p FROM sure) b USING (threshold, link_type, payment_id, counterpart_id)) e GROUP BY 1, 2, 3),
s AS (SELECT threshold, link_type, {TOTALS} FROM pp GROUP BY 1, 2)
SELECT CAST(threshold AS DOUBLE) AS threshold, * EXCLUDE (threshold), {RATES} FROM s"""


@query(name="score_honesty")
def _score_honesty(t: Inputs) -> DataFrame:
    """Payments without a counterpart, on both legs."""
    open_ = t.layered[1].where("subject_type = 'payment'").select("subject_id", "link_type")
    return score.score_honesty(t.payments, _edges(t), open_, BANK).unionByName(score.score_honesty(t.payments, _edges(t), open_, INVOICE))


ORACLE_SQL["score_honesty"] = SCORED + ", none AS (SELECT l.link_type, payment_id FROM payments, (VALUES ('payment_to_bank'), ('payment_to_invoice')) l(link_type) WHERE (l.link_type, payment_id) NOT IN (SELECT (link_type, payment_id) FROM truth_edges)), s AS (SELECT link_type, count(*) AS unresolvable, count(*) FILTER ((link_type, payment_id) IN (SELECT (link_type, subject_id) FROM opened WHERE subject_type = 'payment')) AS routed_to_exceptions, count(*) FILTER ((link_type, payment_id) IN (SELECT (link_type, payment_id) FROM lay_edges)) AS falsely_matched FROM none GROUP BY 1) SELECT *, " + ratio("falsely_matched", "unresolvable", "false_match_rate") + ", " + wilson("falsely_matched", "unresolvable", "false_match_rate") + " FROM s"


@query(name="score_counterparts")
def _score_counterparts(t: Inputs) -> DataFrame:
    return score.score_counterparts(t.layered[1].where("subject_type <> 'payment'"), t.orphans)


ORACLE_SQL["score_counterparts"] = SCORED + ", fl AS (SELECT subject_type, subject_id FROM opened WHERE subject_type <> 'payment'), s AS (SELECT subject_type, count(f) AS flagged, count(o) AS orphans, count(*) FILTER (f = 1 AND o = 1) AS correct FROM (SELECT *, 1 AS f FROM fl) a FULL JOIN (SELECT *, 1 AS o FROM orphans) b USING (subject_type, subject_id) GROUP BY 1) SELECT *, " + ratio("correct", "flagged", "precision") + ", " + ratio("correct", "orphans", "recall") + " FROM s"


@query(name="score_fully_reconciled")
def _score_fully(t: Inputs) -> DataFrame:
    return score.score_fully_reconciled(t.payments, _edges(t))


ORACLE_SQL["score_fully_reconciled"] = SCORED + ", s AS (SELECT count(*) AS payments, count(*) FILTER (payment_id NOT IN (SELECT payment_id FROM per_payment WHERE NOT exact)) AS fully_reconciled FROM payments) SELECT *, " + ratio("fully_reconciled", "payments", "rate") + ", " + wilson("fully_reconciled", "payments", "rate") + " FROM s"


@query(name="exception_reasons")
def _exception_reasons(t: Inputs) -> DataFrame:
    return score.exception_reasons(t.layered[1])


ORACLE_SQL["exception_reasons"] = LAYERED + " SELECT reason, count(*) AS n FROM opened GROUP BY 1"


CARD = LAYERED + ", answers AS (SELECT DISTINCT 'identifier_join' AS matcher, link_type, payment_id, counterpart_id FROM id_edges UNION ALL SELECT 'layered', link_type, payment_id, counterpart_id FROM lay_edges" + "".join(f" UNION ALL SELECT matcher, link_type, payment_id, counterpart_id FROM ({_baseline_sql(d).split(PAYMENTS, 1)[1]}) z{int(d)} WHERE counterpart_id IS NOT NULL" for d in (True, False)) + """),
asked AS (SELECT matcher, link_type, payment_id, counterpart_id FROM truth_edges, (SELECT DISTINCT matcher FROM answers) m),
joint AS (SELECT matcher, link_type, payment_id, t IS NOT NULL AS in_truth, p IS NOT NULL AS in_pred FROM (SELECT *, 1 AS t FROM asked) a FULL JOIN (SELECT *, 1 AS p FROM answers) b USING (matcher, link_type, payment_id, counterpart_id)),
pp AS (SELECT matcher, link_type, payment_id, count(*) FILTER (in_truth) AS n_truth, count(*) FILTER (in_pred) AS n_pred, count(*) FILTER (in_truth AND in_pred) AS n_both, bool_and(in_truth = in_pred) AS exact FROM joint GROUP BY 1, 2, 3),
s AS (SELECT matcher, link_type, """ + TOTALS + """ FROM pp GROUP BY 1, 2)
SELECT *, """ + RATES + " FROM s"


ORACLE_SQL["write_results"] = CARD.rsplit("SELECT *, ", 1)[0] + "SELECT link_type AS part, count(*) AS count FROM matches GROUP BY 1 UNION ALL SELECT reason, count(*) FROM opened GROUP BY 1 UNION ALL SELECT matcher || ' ' || link_type, true_positives FROM s UNION ALL SELECT 'answered calls', count(*) FILTER (n % 5 <> 0) + count(*) FILTER (n % 11 = 0) FROM ta UNION ALL SELECT 'failed calls', count(*) FILTER (n % 5 = 0) FROM ta"


@query(CARD)
def scorecard(t: Inputs) -> DataFrame:
    """All four matchers side by side: precision and recall per leg."""
    matches, _ = t.layered
    answers = {"identifier_join": t.id_edges, "layered": baselines.as_edges(matches)}
    for name, use_date in (("amount_date", True), ("amount_only", False)):
        answers[name] = baselines.baseline_amount(t.payments, t.bank, t.invoices, use_date=use_date).where("counterpart_id is not null").select("payment_id", "link_type", "counterpart_id")
    out = None
    for name, edges in answers.items():
        one = score.score_links(score.edge_frame(t.truth_edges, edges)).withColumn("matcher", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# --- breakdowns ------------------------------------------------------------------------------


@query(name="defect_breakdown")
def _defect_breakdown(t: Inputs) -> DataFrame:
    pay = score.payment_frame(_edges(t)).where("n_truth > 0").select("link_type", "payment_id", F.col("exact").alias("resolved"))
    return breakdown.defect_breakdown(pay, t["truth_tags"])


ORACLE_SQL["defect_breakdown"] = SCORED + ", tg AS (SELECT DISTINCT payment_id, tag FROM truth_tags WHERE tag <> 'bundled_payout'), nt AS (SELECT payment_id, count(*) AS c FROM tg GROUP BY 1), v AS (SELECT link_type, payment_id, CAST(exact AS INT) AS r FROM per_payment WHERE n_truth > 0), cl AS (SELECT link_type, avg(r) AS clean FROM v WHERE payment_id NOT IN (SELECT payment_id FROM nt) GROUP BY 1), s AS (SELECT link_type, tag, count(*) AS n, CAST(sum(r) AS BIGINT) AS resolved, count(*) FILTER (c = 1) AS isolated_n, CAST(coalesce(sum(r) FILTER (c = 1), 0) AS BIGINT) AS isolated_resolved FROM v JOIN tg USING (payment_id) JOIN nt USING (payment_id) GROUP BY 1, 2) SELECT link_type, tag, n, resolved, " + ratio("resolved", "n", "rate") + ", isolated_n, isolated_resolved, round(isolated_resolved / nullif(isolated_n, 0), 6) AS isolated_rate, " + wilson("isolated_resolved", "isolated_n", "isolated") + ", round(100 * (isolated_resolved / nullif(isolated_n, 0) - clean), 4) AS lift_points FROM s LEFT JOIN cl USING (link_type)"
LAYERS = LAYERED + ", ly AS (SELECT layer, rule, link_type, count(*) AS asserted, count(DISTINCT CASE WHEN t = 1 THEN payment_id || counterpart_id END) AS correct FROM (SELECT layer, rule, link_type, payment_id, unnest(cs) AS counterpart_id FROM matches) m LEFT JOIN (SELECT DISTINCT *, 1 AS t FROM truth_edges) x USING (link_type, payment_id, counterpart_id) GROUP BY ALL)"


@query(LAYERS + " SELECT *, " + ratio("correct", "asserted", "precision") + ", " + wilson("correct", "asserted", "precision") + " FROM ly")
def layer_breakdown(t: Inputs) -> DataFrame:
    return breakdown.layer_breakdown(t.layered[0], t.truth_edges)


@query(LAYERS + " SELECT rule, least(floor(round(correct / asserted, 6) * 100) / 100, 0.99) AS confidence FROM ly")
def rule_calibration(t: Inputs) -> DataFrame:
    return score.rule_calibration(breakdown.layer_breakdown(t.layered[0], t.truth_edges))


_JUDGED = LAYERED + ", ju AS (SELECT subject_type, subject_id, link_type, reason, CASE WHEN subject_type = 'payment' THEN (link_type, subject_id) NOT IN (SELECT (link_type, payment_id) FROM truth_edges) ELSE (subject_type, subject_id) IN (SELECT (subject_type, subject_id) FROM orphans) END AS ok FROM opened)"


def _judged(t: Inputs) -> DataFrame:
    return breakdown.judged_exceptions(t.layered[1].select("exception_id", "subject_type", "subject_id", "link_type", "reason"), t.truth_edges, t["truth"], t.orphans)


@query(_JUDGED + " SELECT reason, subject_type, count(*) AS total, count(*) FILTER (ok) AS correctly_raised, count(*) FILTER (NOT ok) AS missed, round(count(*) FILTER (ok) / count(*), 6) AS precision FROM ju GROUP BY 1, 2")
def exception_breakdown(t: Inputs) -> DataFrame:
    return breakdown.exception_breakdown(_judged(t))


@query("SELECT count(*) AS calls, count(*) - count(*) FILTER (b % 10 = 3) AS answered, CAST(sum(100 + b % 50) AS BIGINT) AS input_tokens, CAST(sum(20 + b % 7) AS BIGINT) AS output_tokens, round(sum(CASE WHEN b % 4 = 3 THEN 0.0 ELSE ((100 + b % 50 + 0.10 * (b % 30) + 1.25 * (b % 20)) * 0.5 + (20 + b % 7) * 4.0) / 1000000 END), 6) AS cost_usd, round(sum(CASE WHEN b % 4 = 3 THEN 0.0 ELSE ((100 + b % 50 + 0.10 * (b % 30) + 1.25 * (b % 20)) * 0.5 + (20 + b % 7) * 4.0) / 1000000 END) * 0.1, 6) AS cost_per_100, round(count(*) * 0.1, 6) AS calls_per_100, round(sum(300 + b % 900) / 1000 * 0.1, 6) AS seconds_per_100, round(avg(300 + b % 900), 6) AS latency_ms_mean, CAST(77 AS BIGINT) AS records_reaching_layer3, bool_and(b % 6 <> 1) AS all_replayed, count(*) FILTER (b % 13 = 2) AS schema_failures, count(*) FILTER (b % 10 IN (3, 4)) AS errors FROM base_batches")
def cost_breakdown(t: Inputs) -> DataFrame:
    """A call log derived from the batches, at a price list of one known model."""
    b = F.col("b")
    calls = t["base_batches"].select(
        F.when(b % 4 == 3, "other").otherwise("known").alias("model"), (100 + b % 50).alias("input_tokens"), (20 + b % 7).alias("output_tokens"), (b % 30).alias("cache_read_tokens"), (b % 20).alias("cache_write_tokens"),
        (300 + b % 900).alias("latency_ms"), F.when(b % 10 == 3, "no recorded answer").when(b % 10 == 4, "timeout").alias("error"), (b % 6 != 1).alias("replayed"), (b % 13 != 2).alias("schema_valid"),
    )
    prices = t.spark.createDataFrame([("known", 0.5, 4.0)], "model string, in_rate double, out_rate double")
    return breakdown.cost_breakdown(calls, prices, 1000, 77)


@query()
def layer3_payment_count(t: Inputs) -> DataFrame:
    return breakdown.layer3_payment_count(t.layered[0])


@query("--with " + PAYMENTS + ", " + BATCHES + ", pr AS (SELECT DISTINCT settlement_id, counterpart_id AS txn_id FROM truth_bank) SELECT (SELECT quantile_cont(datediff('day', issue_date, captured_on), 0.99) FROM truth_invoice t JOIN invoices i ON i.invoice_id = t.counterpart_id JOIN payments USING (payment_id)) AS issue_lag_p99, (SELECT max(least(abs(credit - expected_credit), abs(credit - expected_credit_dedup))) FROM pr JOIN bank USING (txn_id) JOIN batches USING (settlement_id)) AS largest_residual, (SELECT CAST(max(datediff('day', settled_date, value_date)) AS INT) FROM pr JOIN bank USING (txn_id) JOIN batches USING (settlement_id)) AS largest_value_lag")
def measure_tolerances(t: Inputs) -> DataFrame:
    return breakdown.measure_tolerances(t.payments, t.batches, t.bank, t.invoices, t["truth_bank"], t["truth_invoice"])


@query("--with r AS (SELECT n % 8 AS seed, CASE k % 5 WHEN 0 THEN NULL ELSE 'tag' || CAST(k % 5 AS VARCHAR) END AS tag, avg(CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.0 END) AS rate FROM base_orders GROUP BY 1, 2), d AS (SELECT a.tag, 100 * (a.rate - b.rate) AS points FROM r a JOIN r b ON a.seed = b.seed AND a.tag IS NOT NULL AND b.tag IS NULL) SELECT tag, count(*) AS seeds, round(avg(points), 2) AS mean_points, round(stddev_samp(points) / sqrt(count(*)), 2) AS standard_error, abs(avg(points)) > 2 * stddev_samp(points) / sqrt(count(*)) AS above_noise FROM d GROUP BY 1")
def ablation_summary(t: Inputs) -> DataFrame:
    """Rates by seed (day modulo eight) and group, as an ablation would leave them."""
    tag = F.when(F.col("k") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("tag"), (F.col("k") % 5).cast("string")))
    rates = t["base_orders"].groupBy((F.col("n") % 8).alias("seed"), tag.alias("tag")).agg(F.avg(F.when(F.col("k") % 3 == 0, 1.0).otherwise(0.0)).alias("rate"))
    return score.ablation_summary(rates)


# --- audit and quality -----------------------------------------------------------------------


@query(LAYERED + ", te AS (SELECT link_type, payment_id, list(DISTINCT counterpart_id ORDER BY counterpart_id) AS want FROM truth_edges GROUP BY 1, 2) SELECT link_type, payment_id, array_to_string(cs, ',') AS counterparts, coalesce(array_to_string(want, ','), '') AS expected, CASE WHEN list_has_all(coalesce(want, []), cs) AND list_has_all(cs, coalesce(want, [])) THEN 'correct' WHEN list_has_all(coalesce(want, []), cs) THEN 'partial' ELSE 'incorrect' END AS verdict FROM matches LEFT JOIN te USING (link_type, payment_id)")
def match_verdicts(t: Inputs) -> DataFrame:
    return audit.match_verdicts(t.layered[0], t.truth_edges).select("link_type", "payment_id", "counterparts", "expected", "verdict")


@query(_JUDGED + " SELECT subject_type, subject_id, link_type, reason, CASE WHEN ok THEN 'rightly_open' ELSE 'missed' END AS verdict FROM ju")
def exception_verdicts(t: Inputs) -> DataFrame:
    return audit.exception_verdicts(_judged(t)).drop("exception_id")


@query(LAYERED + ", ct AS (SELECT txn_id AS counterpart_id, credit AS counterpart_amount, value_date AS counterpart_date, narration AS said FROM bank UNION ALL SELECT invoice_id, invoice_amount, issue_date, coalesce(order_id, '') FROM invoices) SELECT link_type, payment_id, counterpart_id, counterpart_amount, counterpart_date, lower(payment_id || ' ' || coalesce(order_id, '') || ' ' || counterpart_id || ' ' || rule || ' ' || said) AS searchable FROM (SELECT link_type, payment_id, rule, unnest(cs) AS counterpart_id FROM matches) m JOIN ct USING (counterpart_id) JOIN payments USING (payment_id)")
def audit_rows(t: Inputs) -> DataFrame:
    return audit.audit_rows(t.layered[0], t.payments, t.bank, t.invoices).select("link_type", "payment_id", "counterpart_id", "counterpart_amount", "counterpart_date", "searchable")


TRACED = "pay_00000000000003"


@query(LAYERED + f" SELECT 'match' AS kind, link_type, rule AS about, CAST(unnest(range(len(evidence))) AS INT) AS line, unnest(evidence) AS text FROM matches WHERE payment_id = '{TRACED}' UNION ALL SELECT 'exception', link_type, reason, CAST(unnest(range(len(evidence))) AS INT), unnest(evidence) FROM opened WHERE subject_type = 'payment' AND subject_id = '{TRACED}'")
def trace_payment(t: Inputs) -> DataFrame:
    """From the answer on disk: one bucket of it."""
    return t.store.trace(TRACED)


_HURT = "hurt AS (SELECT payment_id, CASE WHEN payment_id LIKE '%9' THEN -gross ELSE gross END AS gross, fee, tax, tds, CASE WHEN payment_id LIKE '%7' THEN net + 1 ELSE net END AS net FROM payments)"


@query("--with " + PAYMENTS + "," + _HURT + " SELECT 'net_of_deductions' AS rule, payment_id AS subject_id, CAST(gross - fee - tax - tds - net AS VARCHAR) AS detail FROM hurt WHERE gross - fee - tax - tds <> net UNION ALL SELECT 'gross_positive', payment_id, CAST(gross AS VARCHAR) FROM hurt WHERE gross <= 0")
def check_money_invariants(t: Inputs) -> DataFrame:
    """Over payments of which some are spoiled: gross negative, net a paisa off."""
    hurt = t.payments.withColumns({"gross": F.when(F.col("payment_id").endswith("9"), -F.col("gross")).otherwise(F.col("gross")), "net": F.when(F.col("payment_id").endswith("7"), F.col("net") + 1).otherwise(F.col("net"))})
    return quality.check_money_invariants(hurt)


@query("--with " + BATCHES + "," + PAYMENTS + ", early AS (SELECT * REPLACE (CAST(CASE WHEN expected_credit % 3 = 0 THEN settled_date - 3 ELSE settled_date END AS DATE) AS settled_date) FROM batches), pr AS (SELECT DISTINCT settlement_id, counterpart_id AS txn_id FROM truth_bank), tg AS (SELECT DISTINCT settlement_id FROM batches WHERE has_duplicate_refund_rows), lc AS (SELECT settlement_id, max(captured_on) AS last FROM (SELECT unnest(sids) AS settlement_id, captured_on FROM payments) x GROUP BY 1) SELECT 'credit_is_total' AS rule, settlement_id AS subject_id, CAST(credit - greatest(0, expected_credit) AS VARCHAR) AS detail FROM pr JOIN bank USING (txn_id) JOIN early USING (settlement_id) LEFT JOIN (SELECT *, 1 AS t FROM tg) g USING (settlement_id) WHERE abs(credit - greatest(0, expected_credit)) > CASE WHEN t = 1 THEN 5 ELSE 0 END UNION ALL SELECT 'settled_after_capture', settlement_id, CAST(last AS VARCHAR) FROM early JOIN lc USING (settlement_id) WHERE settled_date < last")
def check_batch_tieout(t: Inputs) -> DataFrame:
    """Over batches of which some are said to settle three days earlier."""
    early = t.batches.withColumn("settled_date", F.when(F.col("expected_credit") % 3 == 0, F.date_sub("settled_date", 3)).otherwise(F.col("settled_date")))
    return quality.check_batch_tieout(early, t.bank, t["truth_bank"], t.batches.where("has_duplicate_refund_rows").select("settlement_id"), t.payments)


@query("--with " + PAYMENTS + ", " + TRUTH + ", kb AS (SELECT * FROM bank WHERE credit % 10 <> 3), ki AS (SELECT * FROM invoices WHERE invoice_amount % 10 <> 3), kp AS (SELECT * FROM payments WHERE gross % 10 <> 3), kt AS (SELECT * FROM truth WHERE gross % 10 <> 4) SELECT 'counterpart_exists' AS rule, counterpart_id AS subject_id, payment_id AS detail FROM truth_edges WHERE counterpart_id NOT IN (SELECT txn_id FROM kb UNION ALL SELECT invoice_id FROM ki) UNION ALL SELECT 'orphan_exists', subject_id, subject_type FROM orphans WHERE subject_id NOT IN (SELECT txn_id FROM kb UNION ALL SELECT invoice_id FROM ki) UNION ALL SELECT 'payment_in_report', payment_id, '' FROM kt WHERE payment_id NOT IN (SELECT payment_id FROM kp) UNION ALL SELECT 'payment_in_truth', payment_id, '' FROM kp WHERE payment_id NOT IN (SELECT payment_id FROM kt) UNION ALL SELECT 'one_split', payment_id, '' FROM kt WHERE gross % 100 = 50")
def check_references(t: Inputs) -> DataFrame:
    """Over tables of which some rows are taken away, and a truth that puts some payments into a second split."""
    truth = t["truth"].where("gross % 10 <> 4")
    truth = truth.unionByName(truth.where("gross % 100 = 50").withColumn("split", F.lit("third")))
    return quality.check_references(t.payments.where("gross % 10 <> 3"), truth, t.truth_edges.distinct(), t.bank.where("credit % 10 <> 3"), t.invoices.where("invoice_amount % 10 <> 3"), t.orphans)


_BATCH_TAGS = "bt AS (SELECT b AS batch, 'narration_opaque' AS tag FROM base_batches WHERE b % 11 IN (0, 3, 4, 5) UNION ALL SELECT b, 'phantom_refund' FROM base_batches WHERE b % 11 = 5 UNION ALL SELECT b, 'no_bank_credit' FROM base_batches WHERE b % 37 = 9)"
_WANTED = ("narration_opaque", "fx_adjustment", "order_id_case", "phantom_refund", "late_invoice")


def _batch_tags(t: Inputs) -> DataFrame:
    b = F.col("b")
    tags = F.array_compact(F.array(F.when((b % 11).isin(0, 3, 4, 5), "narration_opaque"), F.when(b % 11 == 5, "phantom_refund"), F.when(b % 37 == 9, "no_bank_credit")))
    return t["base_batches"].select(b.alias("batch"), F.explode(tags).alias("tag"))


@query("--with " + _BATCH_TAGS + " SELECT w.tag FROM (VALUES " + ", ".join(f"('{x}')" for x in _WANTED) + ") w(tag) WHERE w.tag NOT IN (SELECT tag FROM truth_tags UNION ALL SELECT tag FROM bt)")
def check_defect_coverage(t: Inputs) -> DataFrame:
    wanted = t.spark.createDataFrame([(x,) for x in _WANTED], "tag string")
    return quality.check_defect_coverage([t["truth_tags"].where("kind = 'own'"), _batch_tags(t), t["truth_tags"].where("kind = 'batch'")], wanted)


# --- corpora ---------------------------------------------------------------------------------


@query("--with " + _BATCH_TAGS + " SELECT 'tag_' || kind AS kind, tag AS name, count(DISTINCT payment_id) AS n FROM truth_tags GROUP BY 1, 2 UNION ALL SELECT 'tag_of_batches', tag, count(DISTINCT batch) FROM bt GROUP BY 2 UNION ALL SELECT 'rows', 'gateway', count(*) FROM gateway UNION ALL SELECT 'rows', 'bank', count(*) FROM bank UNION ALL SELECT 'rows', 'invoices', count(*) FROM invoices")
def corpus_counts(t: Inputs) -> DataFrame:
    return corpus.corpus_counts({n: t[n] for n in ("gateway", "bank", "invoices")}, t["truth_tags"], _batch_tags(t))


MIX = "mx AS (SELECT split, tag, n, round(n / p, 6) AS share FROM (SELECT split, tag, count(DISTINCT payment_id) AS n FROM truth_tags JOIN truth USING (payment_id) GROUP BY 1, 2) a JOIN (SELECT split, count(DISTINCT payment_id) AS p FROM truth GROUP BY 1) b USING (split))"


@query("--with " + MIX + " SELECT * FROM mx")
def defect_mix(t: Inputs) -> DataFrame:
    return corpus.defect_mix(t["truth"], t["truth_tags"])


@query("--with " + MIX + ", g AS (SELECT tag, coalesce(a.share, 0) AS x, coalesce(b.share, 0) AS y FROM (SELECT * FROM mx WHERE split = 'dev') a FULL JOIN (SELECT * FROM mx WHERE split = 'holdout') b USING (tag)) SELECT tag, round(abs(x - y), 6) AS gap, CASE WHEN x > y THEN 'dev' ELSE 'holdout' END AS harder FROM g ORDER BY gap DESC, tag LIMIT 1")
def distribution_gap(t: Inputs) -> DataFrame:
    return corpus.distribution_gap(corpus.defect_mix(t["truth"], t["truth_tags"]), "dev", "holdout")


def _payment_batches(t: Inputs) -> DataFrame:
    return t["truth"].select("payment_id", F.explode(F.array("b1", "b2")).alias("batch")).where("batch is not null")


@query("--with b AS (SELECT DISTINCT x AS batch FROM (SELECT b1 AS x FROM truth UNION ALL SELECT b2 FROM truth WHERE b2 IS NOT NULL) q), l AS (SELECT DISTINCT b2 AS hi FROM truth WHERE b2 IS NOT NULL), s AS (SELECT batch, CASE WHEN batch IN (SELECT hi FROM l) THEN 0 ELSE 1 END AS starts FROM b), g AS (SELECT batch, sum(starts) OVER (ORDER BY batch) AS run FROM s) SELECT batch, min(batch) OVER (PARTITION BY run) AS component FROM g")
def batch_components(t: Inputs) -> DataFrame:
    """Batches chained by split payments; here a split always rides into the next day's batch, so components are runs of days."""
    return corpus.batch_components(_payment_batches(t))


@query(name="stratified_component_split")
def _component_split(t: Inputs) -> DataFrame:
    rides = _payment_batches(t)
    label = written(corpus.batch_components(rides))
    parts = rides.join(label, "batch")
    profile = parts.groupBy("component").agg(F.count_distinct("payment_id").alias("n")).withColumn("stratum", F.lit("payments"))
    tags = parts.select("component", "batch", (F.col("batch") % 11).alias("m")).distinct().where("m in (0, 3, 4, 5)").groupBy("component").agg(F.count("*").alias("n")).withColumn("stratum", F.lit("narration_opaque"))
    return corpus.stratified_component_split(profile.unionByName(tags), {"dev": 0.6, "holdout": 0.4})


# one component after another, the fills of both splits carried along; places within a profile go by id
ORACLE_SQL["stratified_component_split"] = RECURSIVE + """rd AS (SELECT payment_id, b1 AS batch FROM truth UNION ALL SELECT payment_id, b2 FROM truth WHERE b2 IS NOT NULL),
ba AS (SELECT DISTINCT batch FROM rd), st AS (SELECT batch, CASE WHEN batch IN (SELECT b2 FROM truth WHERE b2 IS NOT NULL) THEN 0 ELSE 1 END AS starts FROM ba),
ru AS (SELECT batch, sum(starts) OVER (ORDER BY batch) AS run FROM st), la AS MATERIALIZED (SELECT batch, min(batch) OVER (PARTITION BY run) AS component FROM ru),
pr AS (SELECT component, count(DISTINCT payment_id) AS p FROM rd JOIN la USING (batch) GROUP BY 1), tg AS (SELECT component, count(*) FILTER (batch % 11 IN (0, 3, 4, 5)) AS o FROM la GROUP BY 1),
od AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY p DESC, said, component) AS i FROM (SELECT component, p, o, CASE WHEN o > 0 THEN 'narration_opaque=' || o || ';' ELSE '' END || 'payments=' || p AS said FROM pr JOIN tg USING (component)) x),
tt AS (SELECT CAST(sum(p) AS DOUBLE) AS tp, CAST(sum(o) AS DOUBLE) AS t_o FROM od),
fl AS (SELECT CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS dp, 0.0::DOUBLE AS d_o, 0.0::DOUBLE AS hp, 0.0::DOUBLE AS ho, CAST(NULL AS BOOLEAN) AS dev
  UNION ALL SELECT i, CASE WHEN dev THEN dp + p ELSE dp END, CASE WHEN dev THEN d_o + o ELSE d_o END, CASE WHEN dev THEN hp ELSE hp + p END, CASE WHEN dev THEN ho ELSE ho + o END, dev FROM (
    SELECT od.i, dp, d_o, hp, ho, od.p, od.o, pow((d_o + od.o) / (t_o * 0.6::DOUBLE), 2) + 8.0::DOUBLE * pow((dp + od.p) / (tp * 0.6::DOUBLE), 2) <= pow((ho + od.o) / (t_o * 0.4::DOUBLE), 2) + 8.0::DOUBLE * pow((hp + od.p) / (tp * 0.4::DOUBLE), 2) AS dev
    FROM fl JOIN od ON od.i = fl.i + 1, tt) y),
cl AS (SELECT said, count(*) FILTER (dev) AS n FROM fl JOIN od USING (i) WHERE dev IS NOT NULL GROUP BY 1)
SELECT component, CASE WHEN row_number() OVER (PARTITION BY said ORDER BY component) <= n THEN 'dev' ELSE 'holdout' END AS split FROM od JOIN cl USING (said)"""


_DRAW = "CASE WHEN CAST('0x' || substr(sha1('0|' || {0}), 1, 8) AS BIGINT) % 10 < 6 THEN 'dev' ELSE 'holdout' END"


@query("--with sp AS (SELECT DISTINCT settlement_id, CASE WHEN batch_no % 2 = 0 THEN 'dev' ELSE 'holdout' END AS split FROM gateway), rd AS (SELECT DISTINCT payment_id, split FROM gateway JOIN sp USING (settlement_id) WHERE payment_id IS NOT NULL), cr AS (SELECT DISTINCT counterpart_id AS txn_id, split FROM truth_bank JOIN sp USING (settlement_id) UNION SELECT txn_id, " + _DRAW.format("txn_id") + " FROM orphan_bank), iv AS (SELECT counterpart_id AS invoice_id, split FROM truth_invoice JOIN rd USING (payment_id) UNION SELECT invoice_id, " + _DRAW.format("invoice_id") + " FROM orphan_invoices) SELECT 'gateway' AS part, entity_id AS id, split, settlement_id AS detail FROM gateway JOIN sp USING (settlement_id) UNION ALL SELECT 'bank', txn_id, split, CAST(CAST(1000000 + sum(credit - debit) OVER (PARTITION BY split ORDER BY value_date, txn_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS VARCHAR) FROM bank JOIN cr USING (txn_id) UNION ALL SELECT 'invoices', invoice_id, split, customer_id FROM invoices JOIN iv USING (invoice_id)")
def apply_split(t: Inputs) -> DataFrame:
    """Report, statement with a fresh balance, and ledger of both splits; batches of even number are in one."""
    split = t["gateway"].select("settlement_id", F.when(F.col("batch_no") % 2 == 0, "dev").otherwise("holdout").alias("split")).distinct()
    shares = {"dev": 6, "holdout": 4}
    links = {"bank": t["truth_bank"].select("settlement_id", F.col("counterpart_id").alias("txn_id")), "invoices": t["truth_invoice"].select("payment_id", F.col("counterpart_id").alias("invoice_id"))}
    extras = {"bank": corpus.deal_extras(t["orphan_bank"], "txn_id", shares), "invoices": corpus.deal_extras(t["orphan_invoices"], "invoice_id", shares)}
    parts = corpus.apply_split({n: t[n] for n in ("gateway", "bank", "invoices")}, split, links, extras, 1_000_000)
    shown = [parts[n].select(F.lit(n).alias("part"), F.col(i).alias("id"), "split", F.col(d).cast("string").alias("detail")) for n, i, d in (("gateway", "entity_id", "settlement_id"), ("bank", "txn_id", "balance"), ("invoices", "invoice_id", "customer_id"))]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query("SELECT txn_id, " + _DRAW.format("txn_id") + " AS split FROM orphan_bank")
def deal_extras(t: Inputs) -> DataFrame:
    return corpus.deal_extras(t["orphan_bank"], "txn_id", {"dev": 6, "holdout": 4})


@query("--with " + _BATCH_TAGS + " SELECT DISTINCT payment_id, tag FROM (SELECT payment_id, b1 AS batch FROM truth UNION ALL SELECT payment_id, b2 FROM truth WHERE b2 IS NOT NULL) x JOIN bt USING (batch) WHERE tag <> 'no_bank_credit'")
def propagate_batch_tags(t: Inputs) -> DataFrame:
    return corpus.propagate_batch_tags(_payment_batches(t), _batch_tags(t))
