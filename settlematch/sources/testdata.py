"""Settlement report, bank statement, ledger and truth derived from the driver's order tables.

The shipped tables hold no payments, so these are derived from ``orders`` by integer arithmetic
on the order key: one payment per order, one payout batch per settlement day and merchant, one bank
credit per batch, one invoice per order, with defects planted by remainders. A merchant stands for
1500 customers, so merchants, batches and credits grow with the orders, and a batch stays as large as it is. Each table is one SQL text in
the dialect that Spark and DuckDB share, so that both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def div(a: str, n: str | int) -> str:
    return f"CAST((({a}) - ({a}) % {n}) / {n} AS BIGINT)"


def half_up(a: str, n: int) -> str:
    """a / n to the nearest whole, halves up, for a >= 0."""
    return div(f"({a}) + {n // 2}", n)


def day(n: str) -> str:
    return f"CAST(DATE '1995-01-01' + CAST({n} AS INT) AS DATE)"


def pad(a: str, n: int) -> str:
    return f"lpad(CAST({a} AS STRING), {n}, '0')"


def stamp(d: str, hour: str) -> str:
    return f"CAST({d} AS STRING) || 'T' || {pad(hour, 2)} || ':15:00+05:30'"


def pick(n: str, *values: str) -> str:
    return "CASE " + f"({n}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


#: Batches are numbered as merchant * DAYS + day.
DAYS = 10_000
_SETL = "'setl_' || " + pad("{0}", 14)
_UTR = pick("{0}", "'HDFC'", "'ICIC'", "'SBIN'", "'AXIS'", "'UTIB'") + " || " + pad("({0} * 7919104729) % 1000000000000", 12)


def setl(n: str) -> str:
    return _SETL.format(f"({n})")


def utr(n: str) -> str:
    return "(" + _UTR.format(f"({n})") + ")"


def tables(since: str) -> list[tuple[str, str]]:
    """(name, SQL) in order of use. ``since``: days from 1995-01-01 to o_orderdate, in the engine's dialect."""
    price = pick(div("k", 5), "49900", "99900", "149900", "199900", "249900", "499900", "999900")
    orders = f"""
        SELECT k, c, n, {day('n')} AS d, CASE WHEN k % 5 = 0 THEN CAST({price} AS BIGINT) ELSE paise END AS gross
        FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST(round(o_totalprice * 100) AS BIGINT) AS paise, CAST({since} AS BIGINT) AS n FROM orders) x"""
    rate = "CASE WHEN k % 20 < 11 THEN 90 WHEN k % 20 < 16 THEN 236 WHEN k % 20 < 19 THEN 180 ELSE 200 END"
    method = "CASE WHEN k % 20 < 11 THEN 'upi' WHEN k % 20 < 16 THEN 'card' WHEN k % 20 < 19 THEN 'netbanking' ELSE 'wallet' END"
    paid = f"""
        SELECT *, gross - fee - tax - tds AS net, {div('(gross - fee - tax - tds) * 60', 100)} AS part
        FROM (SELECT *, {half_up('fee * 18', 100)} AS tax
              FROM (SELECT *, {half_up(f'gross * ({rate})', 10000)} AS fee, CASE WHEN k % 7 = 0 THEN {half_up('gross', 100)} ELSE 0 END AS tds FROM base_orders) x) y"""
    captured = stamp("d", "(k * 7) % 24")
    order_id = "CASE WHEN k % 31 = 7 THEN CAST(NULL AS STRING) ELSE 'order_' || " + pad("k * 100003 % 100000000000000", 14) + " END"
    invoice_no = "'INV-2026-' || " + pad("k", 6)
    receipt = f"CASE WHEN k % 12 = 4 THEN 'ref ' || {invoice_no} ELSE 'rcpt_' || {pad('k', 8)} END"

    def row(kind, entity, payment, order, rec, meth, amount, fee, tax, tds, credit, debit, batch, created, cap, settled, where, src="base_paid"):
        return f"""SELECT '{kind}' AS entity_type, {entity} AS entity_id, {payment} AS payment_id, {order} AS order_id, {rec} AS order_receipt, {meth} AS method,
            CAST({amount} AS BIGINT) AS amount, CAST({fee} AS BIGINT) AS fee, CAST({tax} AS BIGINT) AS tax, CAST({tds} AS BIGINT) AS tds, CAST({credit} AS BIGINT) AS credit, CAST({debit} AS BIGINT) AS debit,
            {setl(batch)} AS settlement_id, {utr(batch)} AS settlement_utr, {created} AS created_at, {cap} AS captured_at, {settled} AS settled_at, CAST({batch} AS BIGINT) AS batch_no
            FROM {src} WHERE {where}"""

    no = "CAST(NULL AS STRING)"
    paid_out = f"{div('c', 1500)} * {DAYS} + n + 2"
    pay = "'pay_' || " + pad("k", 14)
    settled, later = stamp(day("n + 2"), "11"), stamp(day("n + 3"), "11")
    refund = div("gross * 30", 100)
    gateway = " UNION ALL ".join((
        row("payment", pay, pay, order_id, receipt, method, "gross", "fee", "tax", "tds", "CASE WHEN k % 17 = 3 THEN part ELSE net END", "0", paid_out, captured, captured, settled, "TRUE"),
        row("payment", pay, pay, order_id, receipt, method, "0", "0", "0", "0", "net - part", "0", f"{paid_out} + 1", captured, captured, later, "k % 17 = 3"),
        row("refund", "'rfnd_' || " + pad("k", 14), pay, no, "''", no, refund, "0", "0", "0", "0", refund, paid_out, stamp("d", "13"), no, settled, "k % 13 = 5"),
        row("refund", "'rfne_' || " + pad("k", 14), pay, no, "''", no, refund, "0", "0", "0", "0", refund, paid_out, stamp("d", "14"), no, settled, "k % 39 = 5"),
        row("adjustment", "'adj_' || " + pad("m", 14), no, no, "''", no, "5000 + m % 100", "0", "0", "0", "0", "5000 + m % 100", "m", stamp(day(f"m % {DAYS}"), "00"), no, stamp(day(f"m % {DAYS}"), "11"), "m % 8 = 3", f"(SELECT DISTINCT {paid_out} AS m FROM base_orders) z"),
    ))
    batch = """
        SELECT batch_no AS b, SUM(credit) - SUM(debit) AS expected, SUM(credit) - SUM(CASE WHEN entity_id LIKE 'rfne_%' THEN 0 ELSE debit END) AS deduped
        FROM gateway GROUP BY batch_no"""
    code = utr("b")
    swapped = f"(substr({code}, 1, 7) || substr({code}, 9, 1) || substr({code}, 8, 1) || substr({code}, 10))"
    blind = "'NEFT CR SETTLEMENT PAYOUT'"
    told = f"'NEFT-' || {code} || '-PAYMENTS PVT LTD-SETTLEMENT'"
    narration = f"CASE WHEN b % 11 IN (0, 3, 4, 5) THEN {blind} WHEN b % 11 = 2 THEN 'NEFT/' || substr({code}, 1, CAST(10 + b % 4 AS INT)) || '/PAYOUT' ELSE {told} END"
    column = f"CASE WHEN b % 11 IN (0, 1, 2, 4, 5) THEN CAST(NULL AS STRING) WHEN b % 11 = 3 THEN {swapped} ELSE {code} END"
    amount = f"CASE WHEN b % 11 = 4 THEN expected - {div('expected * 4', 1000)} WHEN b % 11 = 5 THEN deduped ELSE expected + b % 5 - 2 END"
    value = day(f"b % {DAYS} + b % 3")

    def credit(txn, narr, col, amt, valued, where, src="base_batches"):
        return f"SELECT {txn} AS txn_id, {valued} AS value_date, {narr} AS narration, {col} AS utr, CAST({amt} AS BIGINT) AS credit, CAST(0 AS BIGINT) AS debit FROM {src} WHERE {where}"

    bank = " UNION ALL ".join((
        credit("'bank_' || " + pad("b", 12), narration, column, f"greatest(0, {amount})", value, "b % 37 <> 9"),
        credit("'bankd_' || " + pad("b", 12), told, code, "4321", value, "b % 29 = 5"),
        credit("'bankn_' || " + pad("b", 12), "'NEFT-VENDOR-' || " + pad("b", 6), "CAST(NULL AS STRING)", "123456 + b * 7", day(f"b % {DAYS} + 1"), "b % 9 = 4"),
    ))
    plain = "'order_' || " + pad("k * 100003 % 100000000000000", 14)
    ledger_order = f"CASE WHEN k % 12 IN (1, 4) THEN CAST(NULL AS STRING) WHEN k % 12 = 2 THEN upper({plain}) WHEN k % 12 = 3 THEN substr({plain}, 1, 16) || substr({plain}, 18, 1) || substr({plain}, 17, 1) || substr({plain}, 19) ELSE {plain} END"

    def invoice(number, order, amt, issued, where):
        return f"SELECT {number} AS invoice_id, 'cust_' || {pad('c', 6)} AS customer_id, {order} AS order_id, CAST({amt} AS BIGINT) AS invoice_amount, {issued} AS issue_date FROM base_paid WHERE {where}"

    issued = day("n - k % 16")
    invoices = " UNION ALL ".join((
        invoice(invoice_no, ledger_order, "CASE WHEN k % 50 = 7 THEN gross + 100 ELSE gross END", issued, "k % 25 <> 11"),
        invoice("'INV-2027-' || " + pad("k", 6), "CAST(NULL AS STRING)", "gross", issued, "k % 60 = 13"),
        invoice("'INV-2028-' || " + pad("k", 6), "CAST(NULL AS STRING)", "77777 + k", day("n"), "k % 40 = 19"),
    ))
    truth = f"""
        SELECT {pay} AS payment_id, gross, net, 'INV-2026-' || {pad('k', 6)} AS invoice_id, k % 25 <> 11 AS has_invoice, k, {paid_out} AS b1, CASE WHEN k % 17 = 3 THEN {paid_out} + 1 END AS b2,
            CASE WHEN k % 37 < 22 THEN 'dev' ELSE 'holdout' END AS split FROM base_paid"""
    bank_edges = " UNION ALL ".join(f"SELECT payment_id, 'bank_' || {pad(b, 12)} AS counterpart_id, {setl(b)} AS settlement_id FROM truth WHERE {b} IS NOT NULL AND {b} % 37 <> 9" for b in ("b1", "b2"))
    tags = " UNION ALL ".join((
        "SELECT payment_id, 'split_settlement' AS tag, 'own' AS kind FROM truth WHERE b2 IS NOT NULL",
        "SELECT payment_id, 'no_invoice', 'own' FROM truth WHERE NOT has_invoice",
        "SELECT payment_id, 'order_id_missing', 'own' FROM truth WHERE k % 12 IN (1, 4)",
        "SELECT payment_id, 'order_id_case', 'own' FROM truth WHERE k % 12 = 2",
        "SELECT payment_id, 'order_id_swapped', 'own' FROM truth WHERE k % 12 = 3",
        "SELECT payment_id, 'bundled_payout', 'batch' FROM truth",
        "SELECT payment_id, 'narration_opaque', 'batch' FROM truth WHERE b1 % 11 IN (0, 3, 4, 5)",
        "SELECT payment_id, 'unexplained_deduction', 'batch' FROM truth WHERE b1 % 11 = 4",
        "SELECT payment_id, 'phantom_refund', 'batch' FROM truth WHERE b1 % 11 = 5",
        "SELECT payment_id, 'no_bank_credit', 'batch' FROM truth WHERE b1 % 37 = 9",
    ))
    return [
        ("base_orders", orders), ("base_paid", paid), ("gateway", gateway), ("base_batches", batch), ("bank", bank), ("invoices", invoices),
        ("truth", truth), ("truth_bank", bank_edges),
        ("truth_invoice", "SELECT payment_id, invoice_id AS counterpart_id FROM truth WHERE has_invoice"),
        ("truth_tags", tags),
        ("orphan_bank", "SELECT txn_id FROM bank WHERE substr(txn_id, 1, 5) <> 'bank_'"),
        ("orphan_invoices", "SELECT invoice_id FROM invoices WHERE substr(invoice_id, 1, 9) <> 'INV-2026-'"),
    ]


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All derived tables as DataFrames; nothing is computed until they are used."""
    found = {"orders": spark.read.parquet(f"{sf_dir}/orders.parquet")}
    for name, sql in tables("datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01')"):
        found[name] = spark.sql(_named(sql, found), **{k: v for k, v in found.items() if f"{{{k}}}" in _named(sql, found)})
    return found


def _named(sql: str, known: dict) -> str:
    """The SQL with the names of known tables as parameters."""
    import re

    return re.sub(r"\bFROM (\w+)\b", lambda m: f"FROM {{{m[1]}}}" if m[1] in known else m[0], sql)


def oracle_prefix() -> str:
    """The same tables as common table expressions for DuckDB."""
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in tables("datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))"))
