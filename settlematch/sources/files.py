"""Readers and writers of the source, truth and result files.

CSV columns are read as text with the header checked, then typed by expressions, so that a bad
value fails with its row's id instead of turning null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from settlematch.functions.ids import content_key
from settlematch.functions.money import format_rupees, money_or_zero
from settlematch.operators.order import with_place

# Header names in file order.
GATEWAY = ("entity_type", "entity_id", "payment_id", "order_id", "order_receipt", "method", "card_network", "amount", "currency", "fee", "tax", "tds", "credit", "debit", "settlement_id", "settlement_utr", "created_at", "captured_at", "settled_at", "description")
BANK = ("txn_id", "value_date", "posted_date", "narration", "utr", "credit_amount", "debit_amount", "balance", "ref_no")
INVOICES = ("invoice_id", "customer_id", "customer_name", "invoice_amount", "tax_amount", "currency", "issue_date", "due_date", "order_id", "po_number", "status", "notes")
ENTITY_TYPES = ("payment", "refund", "adjustment")
METHODS = ("upi", "card", "netbanking", "wallet")

TRANSCRIPT_SCHEMA = "call_id string, purpose string, model string, prompt_hash string, system string, user string, response_text string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, latency_ms double, stop_reason string, request_id string, error string, schema_valid boolean, replayed boolean, cost_usd double, metadata map<string,string>"
TRUTH_SCHEMA = (
    "manifest struct<split: string>, orphan_invoice_ids array<string>, orphan_bank_txn_ids array<string>, "
    "links array<struct<payment_id: string, order_id: string, invoice_id: string, settlement_ids: array<string>, utrs: array<string>, bank_txn_ids: array<string>, gross_paise: bigint, net_paise: bigint, defect_tags: array<string>, bundle_defect_tags: array<string>, unresolvable_reason: string>>"
)


def _raw(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    schema = ", ".join(f"{n} string" for n in names)
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST", multiLine=False)


def _text(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def _one_of(name: str, allowed: tuple[str, ...], who: str, *, optional: bool = False) -> Column:
    value = _text(name)
    bad = F.raise_error(F.concat(F.lit(f"unknown {name} of "), F.coalesce(F.col(who), F.lit("?"))))
    known = F.when(value.isin(*allowed), value)
    return (known.when(value.isNull(), F.lit(None)) if optional else known).otherwise(bad.cast("string"))


def _date(name: str, who: str) -> Column:
    value = F.try_to_timestamp(_text(name), F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"no {name} in "), F.coalesce(F.col(who), F.lit("?")))).cast("date"))


def read_gateway(spark: SparkSession, path: str) -> DataFrame:
    """The settlement report; money in paise, blanks null, created_at required."""
    raw = _raw(spark, path, GATEWAY)
    created = F.coalesce(_text("created_at"), F.raise_error(F.concat(F.lit("no created_at in "), "entity_id")).cast("string"))
    special = {"entity_type": _one_of("entity_type", ENTITY_TYPES, "entity_id"), "method": _one_of("method", METHODS, "entity_id", optional=True), "created_at": created}
    amounts = ("amount", "fee", "tax", "tds", "credit", "debit")
    return raw.select(*[(special.get(n) if n in special else money_or_zero(F.col(n)) if n in amounts else F.coalesce(_text(n), F.lit("")) if n == "order_receipt" else _text(n)).alias(n) for n in GATEWAY])


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    raw = _raw(spark, path, BANK)
    return raw.select("txn_id", _date("value_date", "txn_id").alias("value_date"), _date("posted_date", "txn_id").alias("posted_date"), "narration", _text("utr").alias("utr"), money_or_zero(F.col("credit_amount")).alias("credit"), money_or_zero(F.col("debit_amount")).alias("debit"), money_or_zero(F.col("balance")).alias("balance"), "ref_no")


def read_invoices(spark: SparkSession, path: str) -> DataFrame:
    raw = _raw(spark, path, INVOICES)
    return raw.select(
        "invoice_id", "customer_id", "customer_name", money_or_zero(F.col("invoice_amount")).alias("invoice_amount"), money_or_zero(F.col("tax_amount")).alias("tax_amount"), "currency",
        _date("issue_date", "invoice_id").alias("issue_date"), _date("due_date", "invoice_id").alias("due_date"), _text("order_id").alias("order_id"), "po_number", "status", "notes",
    )


def load_split(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {"gateway": read_gateway(spark, f"{folder}/gateway_settlements.csv"), "bank": read_bank(spark, f"{folder}/bank_statement.csv"), "invoices": read_invoices(spark, f"{folder}/erp_invoices.csv")}


def read_truth(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Truth JSON as flat tables: links, bank and invoice edges, tags, orphans."""
    whole = spark.read.json(path, schema=TRUTH_SCHEMA, multiLine=True)
    links = whole.selectExpr("manifest.split", "inline(links)")
    tags = links.select("payment_id", F.explode("defect_tags").alias("tag"), F.lit("own").alias("kind")).unionByName(links.select("payment_id", F.explode("bundle_defect_tags").alias("tag"), F.lit("batch").alias("kind")))
    orphans = whole.select(F.lit("bank_txn").alias("subject_type"), F.explode("orphan_bank_txn_ids").alias("subject_id")).unionByName(whole.select(F.lit("invoice").alias("subject_type"), F.explode("orphan_invoice_ids").alias("subject_id")))
    return {
        "links": links, "bank_edges": links.select("payment_id", F.explode("bank_txn_ids").alias("counterpart_id")),
        "invoice_edges": links.where("invoice_id is not null").select("payment_id", F.col("invoice_id").alias("counterpart_id")), "tags": tags, "orphans": orphans,
    }


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Counts of a manifest as rows (section, name, n)."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("top"))
    inner = whole.select(F.explode(F.from_json(F.col("top")["manifest"], "map<string,string>")).alias("section", "body")).where(F.col("body").startswith("{"))
    return inner.select("section", F.explode(F.from_json("body", "map<string,string>")).alias("name", "n")).select("section", "name", F.expr("try_cast(n as bigint)").alias("n")).where("n is not null")


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """The call log, one JSON record a line: its fields, ``place`` of the line, and ``prompt_hash`` of what was asked.

    Records are told apart by the question alone, whatever model answered: ``prompt_hash`` is made
    of ``system`` and ``user``, and the hash that the record holds itself is ``recorded_hash``. Lines come
    in order of ``place``, over several files in order of their names. Blank lines are skipped, a
    line that is no JSON is an error, and a path that does not exist gives no rows.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not any(fs.globStatus(at) or []):
        lines = spark.createDataFrame([], "value string, place struct<file: string, start: long, row: long>")
    else:
        lines = with_place(spark.read.text(path)).where(F.trim("value") != "")
    records = lines.select(F.from_json("value", TRANSCRIPT_SCHEMA, {"mode": "FAILFAST"}).alias("r"), "place").select("r.*", "place").withColumnRenamed("prompt_hash", "recorded_hash")
    return records.withColumn("prompt_hash", content_key(F.coalesce("system", F.lit("")), F.coalesce("user", F.lit(""))))


def write_csv(rows: DataFrame, path: str, names: tuple[str, ...], money: tuple[str, ...], order: list[Column], *, one_file: bool = False) -> None:
    """``rows`` with the columns in file order, paise as rupees, null as empty, in ``order`` over all files.

    Files are ranges of the order and are named by them, so that reading them by name gives the
    whole order; nulls come first. ``one_file``: a single file, written by one task.
    """
    shown = rows.select(*[(format_rupees(F.col(n)) if n in money else F.coalesce(F.col(n).cast("string"), F.lit(""))).alias(n) for n in names])
    dealt = shown.repartition(1) if one_file else shown.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_sources(folder: str, gateway: DataFrame, bank: DataFrame, invoices: DataFrame, *, one_file: bool = False) -> None:
    """The three CSVs, each a folder of part files in order: the report by settlement (else creation) and id, the statement by value date and id, the ledger by id."""
    write_csv(gateway, f"{folder}/gateway_settlements.csv", GATEWAY, ("amount", "fee", "tax", "tds", "credit", "debit"), [F.coalesce(F.nullif("settled_at", F.lit("")), F.col("created_at")), F.col("entity_id")], one_file=one_file)
    write_csv(bank.withColumnsRenamed({"credit": "credit_amount", "debit": "debit_amount"}), f"{folder}/bank_statement.csv", BANK, ("credit_amount", "debit_amount", "balance"), [F.col("value_date"), F.col("txn_id")], one_file=one_file)
    write_csv(invoices, f"{folder}/erp_invoices.csv", INVOICES, ("invoice_amount", "tax_amount"), [F.col("invoice_id")], one_file=one_file)
