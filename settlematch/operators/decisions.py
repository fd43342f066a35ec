"""Third layer: candidates offered to a model, and its recorded answers joined back.

The model itself is not called here. Its answers come as a transcript table keyed by a hash of
the question. A question lists what is still free when its subject's turn comes, so which question
was asked depends on the answers before it (:func:`decide_in_turn`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from datetime import date
from itertools import tee

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from settlematch.functions.ids import content_key
from settlematch.functions.money import format_rupees
from settlematch.functions.stats import CEILING
from settlematch.operators import shelves, turns
from settlematch.operators.components import components
from settlematch.operators.runs import solve_runs
from settlematch.storage import written

DAYS, SHORTFALL_PCT, OFFERED = 4, 5.0, 12


def l3_bank_candidates(batches: DataFrame, bank: DataFrame) -> DataFrame:
    """Credits within DAYS of a batch, not above its total by more than 10 paise and short by at most SHORTFALL_PCT."""
    probes = batches.where("settled_date is not null and expected_credit_dedup > 0").select("settlement_id", "settled_date", F.col("expected_credit_dedup").alias("total"))
    probes = probes.withColumn("value_date", F.explode(F.transform(F.sequence(F.lit(-DAYS), F.lit(DAYS)), lambda i: F.date_add("settled_date", i))))
    # amounts on a log scale whose step is wider than the shortfall: a credit is on the total's level or next to it
    level = shelves.level(F.col("total"), 0.06)
    probes = probes.withColumn("level", F.explode(F.array(level - 1, level, level + 1)))
    short = F.col("total") - F.col("credit")
    rows = bank.select("txn_id", "value_date", "credit", shelves.level(F.col("credit"), 0.06).alias("level"))
    found = probes.join(rows, ["value_date", "level"]).where((F.col("credit") <= F.col("total") + 10) & (100 * short / F.col("total") <= SHORTFALL_PCT))
    return found.select("settlement_id", "txn_id", "total", "credit", "value_date")


def _told(name: str) -> Column:
    """How a batch is named to the model among others."""
    return F.concat(F.col(name), F.lit(" "), format_rupees(F.col("expected_credit_dedup")))


def _sign_of(text: Column) -> Column:
    """A number that stands for a text; numbers of many texts add up in any order."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")


#: Sums of signs are told modulo this.
SIGNS = 10**15


def rival_days(batches: DataFrame) -> DataFrame:
    """day, n, total, sign: the open batches of each day as one row, however many they are."""
    rows = batches.where("settled_date is not null")
    return rows.groupBy(F.col("settled_date").alias("day")).agg(F.count("*").alias("n"), F.sum("expected_credit_dedup").alias("total"), F.sum(_sign_of(_told("settlement_id"))).alias("sign"))


def rival_blocks(batches: DataFrame, each: int = 1000) -> DataFrame:
    """day, block, n, said: the open batches of each day by name, in blocks of about ``each``, once for all that are asked about.

    What a model is shown below a question: the blocks of the days that the question names.
    """
    rows = batches.where("settled_date is not null").select(F.col("settled_date").alias("day"), F.conv(F.substring(F.sha2("settlement_id", 256), 1, 8), 16, 10).cast("long").alias("lane"), _told("settlement_id").alias("told"))
    blocks = rows.groupBy("day").agg(F.expr(f"count(*) div {each} + 1").alias("blocks"))
    rows = rows.join(blocks, "day").withColumn("block", F.pmod(F.col("lane"), F.col("blocks")))
    return rows.groupBy("day", "block").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("told")), ", ").alias("said"))


def l3_competing_batches(batches: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """settlement_id, day, n, total, sign: the other open batches settling within DAYS, as at most nine rows a batch.

    Batches of a day are added up once (:func:`rival_days`), and a batch itself is taken off its
    own day's row, so that rows grow with the batches and not with their pairs.
    asked: the batches to answer for; all where left out.
    """
    own = (batches if asked is None else asked).where("settled_date is not null").select("settlement_id", "settled_date", "expected_credit_dedup", _sign_of(_told("settlement_id")).alias("own"))
    near = own.withColumn("day", F.explode(F.transform(F.sequence(F.lit(-DAYS), F.lit(DAYS)), lambda i: F.date_add("settled_date", i))))
    home = (F.col("day") == F.col("settled_date")).cast("int")
    rows = near.join(rival_days(batches), "day").select(
        "settlement_id", "day", (F.col("n") - home).alias("n"), (F.col("total") - home * F.col("expected_credit_dedup")).alias("total"),
        F.pmod(F.col("sign") - home * F.col("own"), F.lit(SIGNS)).cast("long").alias("sign"),
    )
    return rows.where("n > 0")


def competing_pairs(batches: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """settlement_id, other_id: every batch with each other batch settling within DAYS, by name.

    asked: the batches to answer for; all where left out.
    """
    own = (batches if asked is None else asked).select("settlement_id", F.explode(F.transform(F.sequence(F.lit(-DAYS), F.lit(DAYS)), lambda i: F.date_add("settled_date", i))).alias("day")).where("day is not null")
    others = batches.where("settled_date is not null").select(F.col("settlement_id").alias("other_id"), F.col("settled_date").alias("day"))
    return own.join(others, "day").where("settlement_id <> other_id").select("settlement_id", "other_id")


def rivals_by_name(batches: DataFrame, asked: DataFrame) -> DataFrame:
    """subject_id, tail: below the question about each batch of ``asked``, all other batches settling within DAYS with their totals.

    What stands near a day is listed once for all batches of the day. The tail comes to a question
    and not to its lines, of which there may be many.
    """
    told = batches.where("settled_date is not null").select("settlement_id", "settled_date", _told("settlement_id").alias("told"))
    near = told.withColumn("day", F.explode(F.transform(F.sequence(F.lit(-DAYS), F.lit(DAYS)), lambda i: F.date_add("settled_date", i))))
    near = near.join(told.join(asked, "settlement_id", "left_semi").select(F.col("settled_date").alias("day")).distinct(), "day", "left_semi")
    lists = near.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("settlement_id", "told"))).alias("near"))
    rows = told.join(asked, "settlement_id", "left_semi").withColumnRenamed("settled_date", "day").join(lists, "day")
    others = F.filter("near", lambda x: x["settlement_id"] != F.col("settlement_id"))
    rows = rows.select(F.col("settlement_id").alias("subject_id"), F.transform(others, lambda x: x["told"]).alias("others")).where(F.size("others") > 0)
    return rows.select("subject_id", F.concat(F.lit("\nother open batches: "), F.array_join("others", ", ")).alias("tail"))


def l3_invoice_candidates(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """The first OFFERED invoices in reach, by id."""
    return shelves.first_in_reach(payments, invoices, OFFERED).join(payments.select("payment_id", "gross"), "payment_id").select("payment_id", "invoice_id", "place", "gross", "invoice_amount")


def percent_text(part: Column, whole: Column) -> Column:
    """100 * part / whole with two decimals, from integers."""
    hundredths = F.round(part.cast("decimal(20,0)") * 10000 / whole.cast("decimal(20,0)"), 0).cast("long")
    return F.concat((hundredths.cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string"), F.lit("%"))


SYSTEM = "Name the credit that pays the batch, or none."
INVOICE_SYSTEM = "Name the invoice that the payment settles, or none."


def _asked(subjects: DataFrame, name: str, asked: DataFrame | None) -> DataFrame:
    return subjects if asked is None else subjects.join(asked.select(F.col("subject_id").alias(name)), name, "left_semi")


def bank_choices(batches: DataFrame, bank: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """subject_id, head, tail, counterpart_id, line: what the question of each batch, or of those ``asked`` about, is made of.

    The head names the batch and its total, each line one credit, and the tail the days near it on
    which other open batches settle, which may want the same credits: how many, their total, and a
    sign of who they are. Their names are in :func:`rival_blocks`.
    """
    about = _asked(batches, "settlement_id", asked)
    found = l3_bank_candidates(about, bank)
    short = F.col("total") - F.col("credit")
    line = F.concat_ws(" | ", F.concat(F.lit("credit "), "txn_id"), format_rupees(F.col("credit")), F.concat(F.lit("on "), F.col("value_date").cast("string")), F.concat(F.lit("short by "), format_rupees(short), F.lit(" ("), percent_text(short, F.col("total")), F.lit(")")))
    rivals = l3_competing_batches(batches, about.join(found.select("settlement_id").distinct(), "settlement_id", "left_semi"))
    told = F.concat(F.col("day").cast("string"), F.lit(" "), F.col("n").cast("string"), F.lit(" of "), format_rupees(F.col("total")), F.lit(" #"), F.col("sign").cast("string"))
    rivals = rivals.groupBy("settlement_id").agg(F.array_join(F.sort_array(F.collect_list(told)), "; ").alias("rivals"))  # at most nine
    rows = found.join(rivals, "settlement_id", "left")
    head = F.concat(F.lit("batch "), "settlement_id", F.lit(" total "), format_rupees(F.col("total")))
    tail = F.coalesce(F.concat(F.lit("\nother open batches by day: "), "rivals"), F.lit(""))
    return rows.select(F.col("settlement_id").alias("subject_id"), head.alias("head"), tail.alias("tail"), F.col("txn_id").alias("counterpart_id"), line.alias("line"))


def _head_of_payment() -> Column:
    return F.concat(F.lit("payment "), "payment_id", F.lit(" of "), format_rupees(F.col("gross")), F.lit(" captured "), F.col("captured_on").cast("string"), F.lit(" order "), F.coalesce("order_id", F.lit("none")), F.lit(" receipt "), F.coalesce("order_receipt", F.lit("none")))


def invoice_choices(payments: DataFrame, invoices: DataFrame, asked: DataFrame | None = None, *, most: int = OFFERED) -> DataFrame:
    """The same for each payment and the first ``most`` invoices in reach."""
    payments = _asked(payments, "payment_id", asked)
    found = shelves.first_in_reach(payments, invoices, most).join(payments, "payment_id")
    off = F.col("invoice_amount") - F.col("gross")
    line = F.concat_ws(" | ", F.concat(F.lit("invoice "), "invoice_id"), format_rupees(F.col("invoice_amount")), F.concat(F.lit("differs by "), format_rupees(off)), F.concat(F.lit("issued "), F.col("issue_date").cast("string")))
    return found.select(F.col("payment_id").alias("subject_id"), _head_of_payment().alias("head"), F.lit("").alias("tail"), F.col("invoice_id").alias("counterpart_id"), line.alias("line"))


def l3_render_questions(choices: DataFrame, system: str = SYSTEM, most: int | None = None, tails: DataFrame | None = None) -> DataFrame:
    """subject_id, question and its key for each subject with choices, as if it were the first to be asked; lines in id order.

    tails: subject_id and the tail of its question, instead of those of the choices.
    """
    lines = F.sort_array(F.collect_list(F.struct("counterpart_id", "line")))
    grouped = choices.groupBy("subject_id", "head", "tail").agg((F.slice(lines, 1, most) if most else lines).alias("lines"))
    if tails is not None:
        grouped = grouped.drop("tail").join(tails, "subject_id", "left").fillna("", ["tail"])
    question = F.concat("head", F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), "tail")
    return grouped.select("subject_id", F.size("lines").cast("long").alias("offered"), question.alias("question"), content_key(F.lit(system), question).alias("prompt_hash"))


def _good(transcript: DataFrame) -> DataFrame:
    """Records without an error; an empty one is none."""
    return transcript.where(F.coalesce("error", F.lit("")) == "")


def numbered(transcript: DataFrame) -> DataFrame:
    """``seq``: the how-manieth record of its question each one is, failed ones counted, by ``place`` in the files."""
    return transcript.withColumn("seq", F.row_number().over(Window.partitionBy("prompt_hash").orderBy("place")).cast("long"))


def latest_answers(transcript: DataFrame) -> DataFrame:
    """The last good record of each key, by ``place`` in the files or else by a column ``seq``; records with an error are dropped."""
    last = Window.partitionBy("prompt_hash").orderBy(F.desc("place" if "place" in transcript.columns else "seq"))
    return _good(transcript).withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def l3_replay_join(questions: DataFrame, transcript: DataFrame) -> DataFrame:
    """Each question with its recorded answer; ``missed`` where there is none."""
    return questions.join(latest_answers(transcript).select("prompt_hash", "response_text"), "prompt_hash", "left").withColumn("missed", F.col("response_text").isNull())


def l3_validate_decision(answers: DataFrame) -> DataFrame:
    """Parsed decisions; ``valid`` is false for broken JSON, unknown or missing fields, and values out of range."""
    known = F.array(*[F.lit(x) for x in ("chosen_id", "confidence", "reasoning", "inferred_deduction_paise")])
    parsed = answers.withColumn("d", F.from_json("response_text", "chosen_id string, confidence double, reasoning string, inferred_deduction_paise long"))
    keys = F.json_object_keys("response_text")
    ok = keys.isNotNull() & (F.size(F.array_except(keys, known)) == 0) & F.col("d.confidence").between(0, 1) & F.col("d.reasoning").isNotNull() & (F.length("d.reasoning") <= 1200)
    return parsed.withColumn("valid", F.coalesce(ok, F.lit(False))).select(*answers.columns, "d.chosen_id", F.col("d.confidence").alias("raw_confidence"), "d.reasoning", "d.inferred_deduction_paise", "valid")


def l3_resume_plan(questions: DataFrame, transcript: DataFrame) -> DataFrame:
    """Questions without a good answer."""
    return questions.join(latest_answers(transcript).select("prompt_hash"), "prompt_hash", "left_anti")


OUTCOMES = "subject_id string, prompt_hash string, offered int, outcome string, chosen_id string, raw_confidence double, reasoning string, inferred_deduction_paise long"


def recorded_subjects(transcript: DataFrame) -> DataFrame:
    """subject_id of everything that a good record is about."""
    return _good(transcript).select(F.regexp_extract("purpose", "^[^:]*:(.*)$", 1).alias("subject_id")).distinct()


#: How the lines of a question name what they offer.
CREDIT_LINE, INVOICE_LINE = r"^credit (.*) \| -?[0-9.]+ \| on \S+ \| short by -?[0-9.]+ \(-?[0-9.]+%\)$", r"^invoice (.*) \| -?[0-9.]+ \| differs by -?[0-9.]+ \| issued \S+$"


def _known_answers(transcript: DataFrame, system: str, line: str) -> DataFrame:
    """subject_id, answers: the checked answers that are recorded about each subject.

    ``told`` of an answer: for each line of the question it answers, whom the line offers ("" where it
    offers none); null where the record does not hold the text that its key is made of.
    """
    last = latest_answers(transcript)
    if "user" in last.columns:
        lines = F.transform(F.split("user", "\n"), lambda x: F.regexp_extract(x, line, 1))
        told = F.when(content_key(F.lit(system), F.col("user")) == F.col("prompt_hash"), lines)
        if "system" in last.columns:  # a question put in other words is none that is asked here
            told = F.coalesce(told, F.when(content_key(F.col("system"), F.col("user")) == F.col("prompt_hash"), F.expr("cast(array() as array<string>)")))
    else:
        told = F.lit(None).cast("array<string>")
    answers = l3_validate_decision(last.select("purpose", "prompt_hash", "response_text", told.alias("told")))
    takes = F.col("valid") & F.col("chosen_id").isNotNull()
    answers = answers.select(F.regexp_extract("purpose", "^[^:]*:(.*)$", 1).alias("subject_id"), F.struct("prompt_hash", "chosen_id", "raw_confidence", "reasoning", "inferred_deduction_paise", "valid", F.when(takes, F.col("told")).alias("told")).alias("answer"))
    return answers.groupBy("subject_id").agg(F.collect_list("answer").alias("answers"))


def _can_be_claims(about: DataFrame, rows: DataFrame, name: str) -> bool:
    """Whether every answer that may take something tells what was on offer, and ids fit into a line."""
    unknown = about.where(F.exists("answers", lambda a: a["valid"] & a["chosen_id"].isNotNull() & a["told"].isNull()))
    return unknown.isEmpty() and rows.where(F.contains(name, F.lit("\n"))).isEmpty()


def _lines_of(text: str | None) -> int:
    return (text or "").count("\n")


def _outcome(subject: str, question: str, system: str, free: list[str], known: list) -> tuple:
    """A row of OUTCOMES: the recorded answer to the question, where there is one, and whether it takes what was free."""
    key = hashlib.sha256(f"{system}\0{question}".encode()).hexdigest()[:20]
    answer = next((a for a in known if a["prompt_hash"] == key), None)
    if answer is None or not answer["valid"]:
        return (subject, key, len(free), "missed" if answer is None else "invalid", None, None, None, None)
    chosen = answer["chosen_id"]
    outcome = "declined" if chosen is None else "accepted" if chosen in free else "not_offered"
    return (subject, key, len(free), outcome, chosen, answer["raw_confidence"], answer["reasoning"], answer["inferred_deduction_paise"])


def decide_in_turn(choices: DataFrame, transcript: DataFrame, *, system: str = SYSTEM, most: int | None = None) -> DataFrame:
    """The recorded answers applied in id order, each to the question its subject would have been asked.

    choices: subject_id, head, tail, counterpart_id, line. A question offers what no subject before
    has been given, the first ``most`` by id. Its answer is looked up by the question's key, and is
    accepted (the counterpart is taken), declined, not_offered (it names something else, and
    counts as declined), invalid or missed. ``purpose`` of a record (kind:subject) tells whom it is
    about; subjects without a record take nothing and stand in nobody's way. Who takes what is
    settled from what the records tell was on offer (:mod:`settlematch.operators.turns`), and then every
    question is made by itself. Where a record that may take something does not hold its question, parts of the graph are solved
    one by one (:func:`_decide_by_parts`).
    """
    asked = written(_known_answers(transcript, system, INVOICE_LINE if system == INVOICE_SYSTEM else CREDIT_LINE))
    own = written(choices.join(asked.select("subject_id"), "subject_id", "left_semi"))
    if not _can_be_claims(asked, own, "counterpart_id"):
        return _decide_by_parts(own, asked, system, most)
    lines = F.sort_array(F.collect_list(F.struct("counterpart_id", "line"))).alias("lines")
    takes = asked.select(F.explode("answers").alias("a")).where("a.valid and a.chosen_id is not null").select(F.col("a.chosen_id").alias("counterpart_id")).distinct()
    takers = asked.where(F.exists("answers", lambda a: a["valid"] & a["chosen_id"].isNotNull()))
    marked = own.join(takers, "subject_id").join(takes.withColumn("named", F.lit(True)), "counterpart_id", "left")
    rows = marked.groupBy("subject_id", "head", "tail").agg(F.sort_array(F.collect_list(F.struct("counterpart_id", "line", "named"))).alias("lines"), F.any_value("answers").alias("answers"))

    def claims(batches):
        for batch in batches:
            out = []
            for subject, head, tail, lines, known in zip(*(batch.column(c).to_pylist() for c in ("subject_id", "head", "tail", "lines", "answers")), strict=True):
                rows, named = [(x["counterpart_id"], x["line"]) for x in lines], {x["counterpart_id"] for x in lines if x["named"]}
                out += _claims(subject, head, tail, rows, named, known, system, most)
            yield pa.RecordBatch.from_pylist(out, schema=_CLAIMS_ARROW)

    taken = turns.settle_claims(rows.select("subject_id", "head", "tail", "lines", "answers").mapInArrow(claims, turns.CLAIMS))
    free = own.join(taken, "counterpart_id", "left").where("taker is null or taker >= subject_id")
    grouped = free.groupBy("subject_id", "head", "tail").agg((F.slice(lines, 1, most) if most else lines).alias("lines"))
    question = F.concat("head", F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), "tail")
    questions = grouped.select("subject_id", content_key(F.lit(system), question).alias("prompt_hash"), F.transform("lines", lambda x: x["counterpart_id"]).alias("ids"))
    found = questions.join(asked, "subject_id").withColumn("a", F.get(F.filter("answers", lambda a: a["prompt_hash"] == F.col("prompt_hash")), F.lit(0)))
    valid = F.coalesce("a.valid", F.lit(False))
    chosen = F.when(valid, F.col("a.chosen_id"))
    outcome = F.when(F.col("a").isNull(), "missed").when(~valid, "invalid").when(chosen.isNull(), "declined").when(F.array_contains("ids", chosen), "accepted").otherwise("not_offered")
    return found.select("subject_id", "prompt_hash", F.size("ids").alias("offered"), outcome.alias("outcome"), chosen.alias("chosen_id"), *[F.when(valid, F.col(f"a.{c}")).alias(c) for c in ("raw_confidence", "reasoning", "inferred_deduction_paise")])


def _claims(subject: str, head: str, tail: str, rows: Iterable[tuple[str, str]], named: set[str], known: list, system: str, most: int | None) -> list[dict[str, object]]:
    """Rows of turns.CLAIMS: answers of a subject that take something where the question is the one that they answer.

    rows: id and line of all that is in reach, by id; named: the ids that any record names, others are never taken.
    """
    out, seen = [], tee(rows, len(known))
    for a, rows in zip(known, seen, strict=True):
        told = a["told"] and a["told"][_lines_of(head) + 1 : len(a["told"]) - _lines_of(tail)]
        if not a["valid"] or not told or a["chosen_id"] not in told:
            continue
        wanted, shown, gone = set(told), [], {}
        for i, line in rows:
            if i in wanted:
                shown.append((i, line))
                if len(shown) == most:
                    break
            elif i in named:
                gone[i] = None
            else:
                shown = []  # it is never taken and would stand among them
                break
        key = hashlib.sha256(f"{system}\0{head}\n{chr(10).join(x for _, x in shown)}{tail}".encode()).hexdigest()[:20]
        if shown and key == a["prompt_hash"]:
            out.append({"subject_id": subject, "prompt_hash": key, "chosen_id": a["chosen_id"], "free": sorted({i for i, _ in shown if i in named}), "gone": list(gone)})
    return out


def _decide_by_parts(own: DataFrame, asked: DataFrame, system: str, most: int | None) -> DataFrame:
    """:func:`decide_in_turn` where keys are all that is known of questions: parts that compete are solved one by one.

    Their size is bounded by the records, not by the data.
    """
    node = F.xxhash64(F.lit("s"), "subject_id")
    part = components(own.select(node.alias("a"), F.xxhash64(F.lit("c"), "counterpart_id").alias("b")))
    rows = own.groupBy("subject_id", "head", "tail").agg(F.sort_array(F.collect_list(F.struct("counterpart_id", "line"))).alias("lines"))
    rows = rows.join(asked, "subject_id").withColumn("node", node).join(part, "node")

    def solve(part: dict[str, list]) -> list[tuple]:
        taken, out = set(), []
        for subject, head, tail, lines, known in zip(*(part[c] for c in ("subject_id", "head", "tail", "lines", "answers")), strict=True):
            free = [x for x in lines if x["counterpart_id"] not in taken][:most]
            if not free:
                continue
            out.append(_outcome(subject, head + "\n" + "\n".join(x["line"] for x in free) + tail, system, [x["counterpart_id"] for x in free], known))
            if out[-1][3] == "accepted":
                taken.add(out[-1][4])
        return out

    return solve_runs(rows.select("component", "subject_id", "head", "tail", "lines", "answers"), "component", ["subject_id"], solve, OUTCOMES)


def _rupees(paise: int) -> str:
    return f"{'-' if paise < 0 else ''}{abs(paise) // 100}.{abs(paise) % 100:02d}"


def _invoice_line(i: str, amount: int, day: int, gross: int) -> str:
    return f"invoice {i} | {_rupees(amount)} | differs by {_rupees(amount - gross)} | issued {date.fromordinal(day + EPOCH)}"


def decide_invoices_in_turn(payments: DataFrame, invoices: DataFrame, transcript: DataFrame, *, system: str = INVOICE_SYSTEM, most: int = OFFERED) -> DataFrame:
    """:func:`decide_in_turn` for payments and the first ``most`` free invoices in reach, without their pairs.

    Only invoices that a recorded answer names can ever be taken; of the others the first ``most`` of one
    date and amount are enough. Claims are checked bucket by bucket against the shelves around, settled for all
    payments together, and then each bucket is asked again, with what was taken put away as its payments' turns
    come. Rows grow with the records and the invoices, and a task sees a bucket's payments and the shelves around it.
    """
    asked = _known_answers(transcript, system, INVOICE_LINE)
    about = written(shelves.payment_rows(payments).join(asked, asked["subject_id"] == F.col("id")).drop("subject_id").join(payments.select(F.col("payment_id").alias("id"), _head_of_payment().alias("head")), "id"))
    named = written(about.select(F.explode("answers").alias("a")).where("a.valid and a.chosen_id is not null").select(F.col("a.chosen_id").alias("invoice_id")).distinct())
    takeable = invoices.join(named, "invoice_id", "left_semi")
    stock = shelves.invoice_rows(shelves.enough_of_each(invoices.join(named, "invoice_id", "left_anti"), most)).withColumn("named", F.lit(False)).unionByName(shelves.invoice_rows(takeable).withColumn("named", F.lit(True)))
    if not _can_be_claims(about, invoices, "invoice_id"):
        return _decide_invoices_by_parts(about, takeable, stock.drop("named"), system, most)
    stock = written(stock)

    def claims(shelf: shelves.Shelf, there: pa.Table, asked: pa.Table) -> Iterable[tuple]:
        named = set(there.filter(there.column("named")).column("id").to_pylist())
        for subject, gross, day, head, known in zip(*(asked.column(c).to_pylist() for c in ("id", "amount", "day", "head", "answers")), strict=True):
            reach = ((shelf.ids[i], _invoice_line(shelf.ids[i], int(shelf.amounts[i]), int(shelf.days[i]), gross)) for i in shelf.near(gross, day))
            for c in _claims(subject, head, "", reach, named, known, system, most):
                yield tuple(c.values())

    takers = about.where(F.exists("answers", lambda a: a["valid"] & a["chosen_id"].isNotNull()))
    taken = turns.settle_claims(shelves.in_lanes(takers, stock, claims, turns.CLAIMS))
    stock = stock.drop("named").join(taken.withColumnRenamed("counterpart_id", "id"), "id", "left").select(*stock.drop("named").columns, "taker")

    def ask(shelf: shelves.Shelf, there: pa.Table, asked: pa.Table) -> Iterable[tuple]:
        put_away = iter(sorted((t, i) for t, i in zip(there.column("taker").to_pylist(), shelf.ids, strict=True) if t is not None))
        next_ = next(put_away, None)
        for subject, gross, day, head, known in zip(*(asked.column(c).to_pylist() for c in ("id", "amount", "day", "head", "answers")), strict=True):
            while next_ and next_[0] < subject:
                shelf.take(next_[1])
                next_ = next(put_away, None)
            if free := shelf.first(gross, day, most):
                yield _outcome(subject, "\n".join([head, *(_invoice_line(i, a, d, gross) for i, a, d in free)]), system, [i for i, _, _ in free], known)

    return shelves.in_lanes(about, stock, ask, OUTCOMES)


def _decide_invoices_by_parts(about: DataFrame, takeable: DataFrame, stock: DataFrame, system: str, most: int) -> DataFrame:
    """:func:`decide_invoices_in_turn` where keys are all that is known of questions.

    What the buckets of two payments have in common matters only where an invoice that can be taken lies between them:
    buckets linked by them are one part, solved in id order over its shelves, and such a part may be all there is.
    """
    on_shelf, homes = written(stock), about.select("bucket").distinct()
    between = shelves.invoice_rows(takeable).select(F.col("bucket").alias("b")).distinct().withColumn("bucket", F.explode(shelves.around(F.col("b")))).join(homes, "bucket")
    part = components(between.select((2 * F.col("bucket")).alias("a"), (2 * F.col("b") + 1).alias("b")))
    homes = written(homes.join(part.select(F.expr("node div 2").alias("bucket"), "component").where("pmod(node, 2) = 0"), "bucket", "left").select("bucket", F.coalesce("component", 2 * F.col("bucket")).alias("part")))
    none = {"head": F.lit(None).cast("string"), "answers": F.lit(None).cast(about.schema["answers"].dataType)}
    columns = ("part", "kind", "bucket", "id", "amount", "day", "head", "answers")
    shelved = on_shelf.withColumn("home", F.explode(shelves.around(F.col("bucket")))).join(homes.withColumnRenamed("bucket", "home"), "home").drop("home").distinct().withColumns(none)
    rows = about.join(homes, "bucket").select(*columns).unionByName(shelved.select(*columns))

    def solve(part: dict[str, list]) -> list[tuple]:
        rows, out = list(zip(*(part[c] for c in columns[1:]), strict=True)), []
        stock = shelves.Shelves((b, i, a, d) for k, b, i, a, d, _, _ in rows if k == "i")
        for _, number, subject, gross, day, head, known in sorted((r for r in rows if r[0] == "p"), key=lambda r: r[2]):
            free = stock.first(number, gross, day, most)
            if not free:
                continue
            out.append(_outcome(subject, "\n".join([head, *(_invoice_line(i, a, d, gross) for i, a, d in free)]), system, [i for i, _, _ in free], known))
            if out[-1][3] == "accepted":
                stock.take(number, out[-1][4])
        return out

    return solve_runs(rows, "part", [], solve, OUTCOMES)


#: Ordinal of the first of January 1970.
EPOCH = date(1970, 1, 1).toordinal()
_CLAIMS_ARROW = pa.schema([("subject_id", pa.string()), ("prompt_hash", pa.string()), ("chosen_id", pa.string()), ("free", pa.list_(pa.string())), ("gone", pa.list_(pa.string()))])
