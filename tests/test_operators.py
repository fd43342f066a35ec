import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from settlematch import storage
from settlematch.operators import assemble, assign, baselines, breakdown, corpus, decisions, exact, fuzzy, order, score, shelves, turns, views
from settlematch.operators.assign import NEVER, TOP, DayWindow, greedy, greedy_assign, latest_winners
from settlematch.operators.components import components
from settlematch.plans.queries import MAKERS, Inputs

DAY = dt.date(2026, 2, 5)
UTR = "HDFC000000000001"
PAY = "payment_id string, order_id string, order_receipt string, gross long, net long, settlement_ids array<string>, settlement_utrs array<string>, settled_dates array<date>, captured_on date"
BATCH = "settlement_id string, utr string, settled_date date, expected_credit long, expected_credit_dedup long, n_payments long, has_duplicate_refund_rows boolean"
BANK = "txn_id string, value_date date, narration string, utr string, credit long, debit long"
INV = "invoice_id string, order_id string, invoice_amount long, issue_date date, customer_id string"


def payment(spark, *rows):
    base = {"payment_id": "pay_1", "order_id": "order_1", "order_receipt": "rcpt_x", "gross": 100000, "net": 97000, "settlement_ids": ["setl_1"], "settlement_utrs": [UTR], "settled_dates": [DAY], "captured_on": dt.date(2026, 2, 3)}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], PAY)


def batch(spark, *rows):
    base = {"settlement_id": "setl_1", "utr": UTR, "settled_date": DAY, "expected_credit": 97000, "expected_credit_dedup": 97000, "n_payments": 1, "has_duplicate_refund_rows": False}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], BATCH)


def bank(spark, *rows):
    base = {"txn_id": "bank_1", "value_date": DAY, "narration": f"NEFT-{UTR}-SETTLEMENT", "utr": UTR, "credit": 97000, "debit": 0}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], BANK)


def invoice(spark, *rows):
    base = {"invoice_id": "INV-2026-00001", "order_id": "order_1", "invoice_amount": 100000, "issue_date": dt.date(2026, 2, 3), "customer_id": "cust_0001"}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], INV)


def pairs(rows):
    return sorted((r["subject_id"], r["counterpart_id"]) for r in rows.collect())


def test_exact_utr_join_needs_one_free_row(spark):
    assert pairs(exact.l1_utr_column_join(batch(spark, {}), bank(spark, {}))) == [("setl_1", "bank_1")]
    assert pairs(exact.l1_utr_column_join(batch(spark, {}), bank(spark, {}, {"txn_id": "bank_2"}))) == []
    taken = spark.createDataFrame([("bank_1",)], "txn_id string")
    assert pairs(exact.l1_utr_column_join(batch(spark, {}), bank(spark, {}), taken)) == []
    # two batches on one UTR both get the credit
    assert len(pairs(exact.l1_utr_column_join(batch(spark, {}, {"settlement_id": "setl_2"}), bank(spark, {})))) == 2


def test_bank_rules(spark):
    assert pairs(fuzzy.narration_utr_exact(batch(spark, {}), bank(spark, {"utr": None}))) == [("setl_1", "bank_1")]
    assert pairs(fuzzy.narration_utr_truncated(batch(spark, {}), bank(spark, {"utr": None, "narration": f"NEFT/{UTR[:12]}/X"}))) == [("setl_1", "bank_1")]
    assert pairs(fuzzy.utr_fuzzy(batch(spark, {"utr": "HDFC566880316647"}), bank(spark, {"utr": "HDFC566880316467", "narration": "x"}))) == [("setl_1", "bank_1")]
    for off, hit in ((10, 1), (11, 0), (-10, 1), (-11, 0)):
        assert len(pairs(fuzzy.batch_amount(batch(spark, {}), bank(spark, {"credit": 97000 - off}), deduped=False))) == hit
    for days, hit in ((2, 1), (3, 0), (-2, 1)):
        assert len(pairs(fuzzy.batch_amount(batch(spark, {}), bank(spark, {"value_date": DAY + dt.timedelta(days)}), deduped=False))) == hit
    dup = batch(spark, {"expected_credit": 83000, "expected_credit_dedup": 90000})
    assert pairs(fuzzy.batch_amount(dup, bank(spark, {"credit": 90000}), deduped=True)) == [("setl_1", "bank_1")]
    assert pairs(fuzzy.batch_amount(batch(spark, {"settled_date": None}), bank(spark, {}), deduped=True)) == []


def test_invoice_rules(spark):
    assert pairs(fuzzy.receipt_invoice_hint(payment(spark, {"order_receipt": "for INV-2026-00001"}), invoice(spark, {}))) == [("pay_1", "INV-2026-00001")]
    assert pairs(fuzzy.order_id_normalised(payment(spark, {}), invoice(spark, {"order_id": "ORDER-1"}))) == [("pay_1", "INV-2026-00001")]
    assert pairs(fuzzy.order_id_fuzzy(payment(spark, {"order_id": "order_12"}), invoice(spark, {"order_id": "order_21"}))) == [("pay_1", "INV-2026-00001")]
    for days, hit in ((-6, 1), (1, 0), (-14, 1), (-15, 0)):
        assert len(pairs(fuzzy.invoice_amount_window(payment(spark, {}), invoice(spark, {"issue_date": dt.date(2026, 2, 3) + dt.timedelta(days)})))) == hit


def apart(x, y):
    """One substitution or one swap of neighbours, by the definition."""
    off = [i for i, (a, b) in enumerate(zip(x, y, strict=True)) if a != b]
    return len(off) == 1 or len(off) == 2 and off[1] == off[0] + 1 and x[off[0]] == y[off[1]] and x[off[1]] == y[off[0]]


def test_values_one_edit_apart_are_all_found(spark, monkeypatch):
    """Short alphabets, hot beginnings and ends, repeated values, odd characters; large and small groups."""
    for each, seed in ((16, 1), (0, 2), (1, 3)):
        monkeypatch.setattr(fuzzy, "PAIRS_EACH", each)
        rng = random.Random(seed)

        def value(rng=rng):
            kind = rng.randrange(4)
            if kind == 0:
                return "".join(rng.choice("ab") for _ in range(rng.randrange(0, 7)))
            if kind == 1:
                return f"order_{rng.randrange(300):014}"
            if kind == 2:
                return f"{rng.randrange(200):05}-the same end"
            return "".join(rng.choice("é\x00🙂x") for _ in range(rng.randrange(1, 5)))

        left, right = [value() for _ in range(250)], [value() for _ in range(250)]
        got = fuzzy.one_edit_values(spark.createDataFrame([(v,) for v in left], "value string"), spark.createDataFrame([(v,) for v in right], "value string")).collect()
        want = {(x, y) for x in left for y in right if len(x) == len(y) and x != y and apart(x, y)}
        assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 100


def test_ids_with_a_common_beginning_take_few_keys(spark, monkeypatch):
    """20,000 ids that vary in their last places: the rows that travel, against 39 keys a value."""
    ids = spark.range(20_000).select(F.format_string("order_%014d", F.col("id") * 7919 % 10_000_000).alias("value"))
    rows, plain = [], fuzzy.written
    monkeypatch.setattr(fuzzy, "written", lambda df: (rows.append(df.columns), plain(df))[1])
    swapped = ids.withColumn("value", F.concat(F.substring("value", 1, 15), F.substring("value", 17, 1), F.substring("value", 16, 1), F.substring("value", 18, 9)))
    found = fuzzy.one_edit_values(ids, swapped)
    assert found.where("substring(x, 16, 1) = substring(y, 17, 1) and substring(x, 17, 1) = substring(y, 16, 1) and substring(x, 18, 3) = substring(y, 18, 3)").count() > 15_000
    assert sum(c == ["value", "l", "r", "a", "b"] for c in rows) <= 4  # the values, and at most three further halvings


def test_assignment_is_the_sequential_one(spark):
    rng = random.Random(1)
    edges = {(f"g{g}s{rng.randrange(6)}", rng.randrange(3), f"g{g}c{rng.randrange(6)}") for g in range(60) for _ in range(rng.randrange(1, 12))}
    rows = spark.createDataFrame([(s, r, f"rule{r}", c) for s, r, c in edges], "subject_id string, rank int, rule string, counterpart_id string")
    got = pairs(greedy_assign(rows.repartition(7)))
    assert got == sorted((s, c) for s, _, c in greedy(list(edges)))
    assert len({c for _, c in got}) == len(got)


def test_chains_longer_than_the_rounds_are_settled_in_slices(spark, monkeypatch):
    monkeypatch.setattr(assign, "ROUNDS", 2)
    monkeypatch.setattr(assign, "SLICE", 7)
    for seed in range(3):
        rng = random.Random(seed)
        edges = {(f"s{i:02}", 0, f"c{i + d:02}") for i in range(30) for d in range(rng.randrange(1, 3))}  # a claim frees or takes the next one's
        edges |= {(f"s{rng.randrange(30):02}", rng.randrange(3), f"c{rng.randrange(40):02}") for _ in range(25)}
        rows = spark.createDataFrame([(s, r, f"rule{r}", c) for s, r, c in edges], "subject_id string, rank int, rule string, counterpart_id string")
        got = sorted((r["subject_id"], r["rule"], r["counterpart_id"]) for r in greedy_assign(rows).collect())
        assert got == sorted((s, f"rule{r}", c) for s, r, c in greedy(list(edges)))


def test_a_counterpart_named_by_very_many_is_settled_in_a_few_rounds(spark, monkeypatch):
    """100,000 payments whose receipts name one invoice, half of them another one beside it."""
    turns, plain = [], assign._round
    monkeypatch.setattr(assign, "_round", lambda *a: turns.append(a[2]) or plain(*a))
    monkeypatch.setattr(assign, "_sliced", None)
    monkeypatch.setattr(assign, "MANY", 1)  # as with millions of edges
    n = 100_000
    ids = spark.range(n).select(F.format_string("pay_%07d", "id").alias("subject_id"), "id")
    hot = ids.select("subject_id", F.lit(0).alias("rank"), F.lit("hint").alias("rule"), F.lit("INV-hot").alias("counterpart_id"))
    own = ids.where("id % 2 = 1").select("subject_id", F.lit(0).alias("rank"), F.lit("hint").alias("rule"), F.concat(F.lit("INV-"), "id").alias("counterpart_id"))
    won = greedy_assign(hot.unionByName(own))
    assert won.count() == 1 + n // 2 and won.where("counterpart_id = 'INV-hot'").head()["subject_id"] == "pay_0000000"
    assert len(turns) <= 3
    turns.clear()
    # all name both: the hint is never unique, and a later rule settles each
    own = ids.select("subject_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("rank"), F.concat(F.lit("INV-"), "id").alias("counterpart_id")).withColumn("rule", F.concat(F.lit("rule"), "rank"))
    won = greedy_assign(hot.unionByName(own))
    assert won.where("rule = 'rule1'").count() == won.count() == n and len(turns) <= 4


def test_window_without_pairs_is_the_same_assignment(spark):
    rng = random.Random(3)
    pay = payment(spark, *[{"payment_id": f"p{i:03}", "order_id": rng.choice([None, f"order_{rng.randrange(12)}"]), "gross": rng.choice([100, 200, 300]), "captured_on": DAY + dt.timedelta(rng.randrange(150))} for i in range(90)])
    inv = invoice(spark, *[{"invoice_id": f"INV-2026-{i:05}", "order_id": rng.choice([None, f"ORDER_{rng.randrange(12)}"]), "invoice_amount": rng.choice([100, 200, 300, 400]), "issue_date": DAY + dt.timedelta(rng.randrange(150))} for i in range(70)])
    by_pairs = pairs(greedy_assign(fuzzy.candidates(pay, inv, fuzzy.INVOICE_RULES)))
    assert pairs(fuzzy.assign_invoices(pay, inv)) == by_pairs and len(by_pairs) > 20


def test_window_narrowing_is_exact_on_common_prices(spark):
    for seed, days, sold in ((1, 40, 400), (2, 200, 150), (3, 12, 300)):
        rng = random.Random(seed)
        subjects = {f"p{i:03}": (rng.randrange(2), rng.randrange(days)) for i in range(300)}
        rows = {f"c{i:03}": (rng.randrange(2), rng.randrange(days)) for i in range(sold)}
        edges = {(rng.choice(list(subjects)), rng.randrange(3), c) for c in rows if rng.random() < 0.7}
        want = sorted((s, c) for s, _, c in greedy(list(edges), subjects, rows, 3, 14))
        window = DayWindow("r3", 3, 14, spark.createDataFrame([(k, *v) for k, v in subjects.items()], "subject_id string, amount long, day int"), spark.createDataFrame([(k, *v) for k, v in rows.items()], "counterpart_id string, amount long, day int"))
        pairs_ = spark.createDataFrame([(s, r, f"r{r}", c) for s, r, c in edges], "subject_id string, rank int, rule string, counterpart_id string")
        assert pairs(greedy_assign(pairs_, window)) == want


def test_a_price_sold_daily_leaves_few_live_subjects():
    """Ten years of one price: the more a day, the fewer subjects can win by the window, and none is more than a short run."""
    for per_day in (1, 3, 20):
        rng = random.Random(per_day)
        ids = [f"{rng.random():.9f}" for _ in range(3650 * per_day)]
        subjects, firsts = {}, {}
        for i, own in enumerate(ids):
            subjects.setdefault(i // per_day, []).append(own)
            firsts.setdefault(i // per_day - rng.randrange(15), []).append(own if rng.random() < 0.75 else NEVER)
        top = [{d: sorted(x, reverse=True)[:TOP] for d, x in side.items()} for side in (firsts, subjects)]
        size = latest_winners(*top, 14)
        live = sorted(d for d, n in size.items() if n)
        run, longest = 0, 0
        for a, b in zip([-99, *live], live, strict=False):
            run = run + size[b] if b - a <= 14 else size[b]
            longest = max(longest, run)
        assert longest <= 20 and sum(size.values()) < 100


def test_assignment_of_nothing(spark):
    assert pairs(greedy_assign(spark.createDataFrame([], "subject_id string, rank int, rule string, counterpart_id string"))) == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_split_payment_is_tied_in_part(spark):
    pay = payment(spark, {"settlement_ids": ["setl_1", "setl_2"], "settlement_utrs": [UTR, "HDFC000000000002"]})
    matches, open_ = assemble.run_layered(pay, batch(spark, {}, {"settlement_id": "setl_2", "utr": "HDFC000000000002", "expected_credit": 1, "expected_credit_dedup": 1}), bank(spark, {}), invoice(spark, {}))
    found = {r["link_type"]: r for r in matches.collect()}
    assert found[baselines.BANK]["counterpart_ids"] == ["bank_1"]
    assert found[baselines.BANK]["evidence"][-1].startswith("tied: 1 of 2")
    assert found[baselines.BANK]["source_records"] == {"gateway": ["pay_1"], "settlement": ["setl_1", "setl_2"], "bank": ["bank_1"]}
    assert [(r["subject_id"], r["reason"]) for r in open_.collect()] == [("pay_1", "no_candidate")]
    whole = baselines.baseline_id_join(pay, bank(spark, {}), invoice(spark, {})).where(F.col("link_type") == baselines.BANK).head()
    assert (whole["counterpart_ids"], whole["reason"]) == (None, "ambiguous_candidates")


def test_threshold_sends_weak_matches_to_exceptions(spark):
    matches, open_ = assemble.run_layered(payment(spark, {}), batch(spark, {}), bank(spark, {}), invoice(spark, {"order_id": None}), threshold=0.9)
    assert [r["link_type"] for r in matches.collect()] == [baselines.BANK]
    assert {(r["subject_type"], r["reason"]) for r in open_.collect()} == {("payment", "below_confidence"), ("invoice", "unmatched_counterpart")}


def test_baselines_refuse_equal_candidates(spark):
    found = baselines.baseline_amount(payment(spark, {}), bank(spark, {}, {"txn_id": "bank_2"}), invoice(spark, {}), use_date=True).collect()
    by = {r["link_type"]: r for r in found}
    assert by[baselines.BANK]["reason"] == "ambiguous_candidates" and by[baselines.BANK]["candidates"] == 2
    assert by[baselines.INVOICE]["counterpart_id"] == "INV-2026-00001"


def test_views(spark):
    cols = "entity_type string, entity_id string, payment_id string, order_id string, order_receipt string, method string, amount long, fee long, tax long, tds long, credit long, debit long, settlement_id string, settlement_utr string, created_at string, captured_at string, settled_at string"
    rows = [
        ("payment", "e1", "p", "o", "r", "upi", 100, 2, 0, 0, 60, 0, "s1", "U1", "2026-01-06T00:10:00+05:30", "2026-01-06T00:10:00+05:30", "2026-01-08T11:00:00+05:30"),
        ("payment", "e2", "p", None, "", None, 0, 0, 0, 0, 38, 0, "s2", "U2", "2026-01-06T00:10:00+05:30", None, "2026-01-09T11:00:00+05:30"),
        ("refund", "r1", None, None, "", None, 5, 0, 0, 0, 0, 5, "s1", "U1", "2026-01-07T10:00:00+05:30", None, "2026-01-08T11:00:00+05:30"),
        ("refund", "r2", None, None, "", None, 5, 0, 0, 0, 0, 5, "s1", "U1", "2026-01-07T11:00:00+05:30", None, "2026-01-08T11:00:00+05:30"),
    ]
    gateway = spark.createDataFrame(rows, cols)
    p = views.payment_views(gateway).head()
    assert (p["gross"], p["net"], p["order_id"], p["settlement_ids"], p["captured_on"], p["row_count"]) == (100, 98, "o", ["s1", "s2"], dt.date(2026, 1, 6), 2)
    b = {r["settlement_id"]: r for r in views.settlement_batches(gateway).collect()}
    assert (b["s1"]["expected_credit"], b["s1"]["expected_credit_dedup"], b["s1"]["has_duplicate_refund_rows"]) == (50, 55, True)
    assert [r["entity_id"] for r in views.duplicate_refund_rows(gateway).collect()] == ["r2"]
    assert (b["s1"]["utr"], b["s1"]["n_payments"], b["s1"]["n_refunds"], b["s1"]["n_adjustments"]) == ("U1", 1, 2, 0)
    members = views.batch_members(gateway.unionByName(gateway.where("entity_id = 'e1'")))  # a payment on two lines is one member
    assert sorted(map(tuple, members.collect())) == [("s1", "payment", "p"), ("s1", "refund", "r1"), ("s1", "refund", "r2"), ("s2", "payment", "p")]
    signs = {r["settlement_id"]: r for r in views.batch_signs(members.repartition(5)).collect()}
    assert signs["s1"]["n"] == 3 and signs["s1"]["sign"] == sum(int(hashlib.sha256(x.encode()).hexdigest()[:15], 16) for x in ("payment p", "refund r1", "refund r2")) % views.SIGNS
    listed = views.with_member_lists(views.settlement_batches(gateway), members).where("settlement_id = 's1'").head()
    assert (listed["payment_ids"], listed["refund_entity_ids"], listed["adjustment_entity_ids"]) == (["p"], ["r1", "r2"], [])
    two = gateway.withColumn("settlement_utr", F.when(F.col("entity_id") == "r1", "U9").when(F.col("entity_id") == "r2", F.lit(None)).otherwise(F.col("settlement_utr")))
    assert {r["settlement_id"]: r["utr"] for r in views.settlement_batches(two).collect()} == {"s1": None, "s2": "U2"}


def test_a_batch_of_very_many_payments_is_one_small_row(spark):
    n = 60_000
    columns = {"entity_type": F.lit("payment"), "entity_id": F.concat(F.lit("e"), "id"), "payment_id": F.concat(F.lit("p"), F.expr("id div 2")), "credit": F.lit(3).cast("long"), "debit": F.lit(0).cast("long"), "settlement_id": F.lit("s"), "settlement_utr": F.lit("U"), "created_at": F.lit("2026-01-06T00:10:00+05:30"), "settled_at": F.lit("2026-01-08T00:10:00+05:30")}
    gateway = spark.range(n).select(*[c.alias(k) for k, c in columns.items()])
    batches = views.settlement_batches(gateway)
    r = batches.head()
    assert (r["n_payments"], r["expected_credit"], r["utr"]) == (n // 2, 3 * n, "U")
    assert "collect" not in batches._jdf.queryExecution().optimizedPlan().toString()
    assert views.batch_signs(views.batch_members(gateway)).head()["n"] == n // 2


def answered(spark, questions, *replies):
    """A transcript of (subject, reply) for questions by subject, each reply the fields of a decision or a raw text."""
    rows = [(f"bank:{s}", q, i, r if isinstance(r, str) else json.dumps({"reasoning": "r"} | r), None) for i, (s, q, r) in enumerate((s, questions[s], r) for s, r in replies)]
    return spark.createDataFrame(rows, "purpose string, prompt_hash string, seq int, response_text string, error string")


def asked(choices, **kw):
    return {r["subject_id"]: r["prompt_hash"] for r in decisions.l3_render_questions(choices, **kw).collect()}


def test_decisions_are_checked(spark):
    rows = [("a", '{"chosen_id":"x","confidence":1.0,"reasoning":"r"}'), ("d", "oops"), ("f", '{"chosen_id":"x","confidence":2,"reasoning":"r"}'), ("g", '{"chosen_id":"x","confidence":0.5,"reasoning":"r","more":1}'), ("h", '{"chosen_id":null,"confidence":0.5,"reasoning":"' + "r" * 1201 + '"}')]
    valid = decisions.l3_validate_decision(spark.createDataFrame(rows, "subject_id string, response_text string"))
    assert {r["subject_id"] for r in valid.where("not valid").collect()} == {"d", "f", "g", "h"}


def test_decisions_take_turns(spark):
    """One credit, several batches: the first named has it, and the next is asked without it."""
    batches = batch(spark, *[{"settlement_id": f"setl_{i}", "utr": None} for i in range(1, 7)])
    credits = bank(spark, {"utr": None, "credit": 96500}, {"txn_id": "bank_2", "utr": None, "credit": 96400}, {"txn_id": "bank_3", "credit": 98000}, {"txn_id": "bank_4", "credit": 77000})
    choices = decisions.bank_choices(batches, credits)
    assert {r["counterpart_id"] for r in choices.collect()} == {"bank_1", "bank_2"}  # above the total or far below it: not offered
    assert "short by 5.00 (0.52%)" in choices.where("counterpart_id = 'bank_1'").head()["line"] and "2026-02-05 5 of 4850.00 #" in choices.where("subject_id = 'setl_1'").head()["tail"]
    full, rest = asked(choices), asked(choices.where("counterpart_id <> 'bank_1'"))
    log = answered(spark, full, ("setl_1", {"chosen_id": "bank_1", "confidence": 1.0}), ("setl_2", {"chosen_id": "bank_1", "confidence": 1.0}))
    log = log.unionByName(answered(spark, rest, ("setl_3", {"chosen_id": None, "confidence": 0.2}), ("setl_4", {"chosen_id": "bank_9", "confidence": 0.6}), ("setl_5", "no answer")))
    got = {r["subject_id"]: r for r in decisions.decide_in_turn(choices, log).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {"setl_1": "accepted", "setl_2": "missed", "setl_3": "declined", "setl_4": "not_offered", "setl_5": "invalid"}
    assert got["setl_1"]["offered"] == 2 and got["setl_2"]["offered"] == 1
    links, declines = assemble.decided(decisions.decide_in_turn(choices, log), "rule")
    assert [(r["subject_id"], r["counterpart_id"], r["confidence"]) for r in links.collect()] == [("setl_1", "bank_1", 0.85)]
    told = {r["subject_id"]: " ".join(r["declined"]) for r in declines.collect()}
    assert told.keys() == {"setl_3", "setl_4"} and "bank_9, which was not on offer" in told["setl_4"]


def test_turns_equal_one_pass(spark):
    """Against a plain loop over all subjects, whatever the partitions."""
    rng = random.Random(4)
    pay = payment(spark, *[{"payment_id": f"p{i:02}", "order_id": None, "gross": rng.choice([1000, 1010, 5000]), "captured_on": DAY + dt.timedelta(rng.randrange(60))} for i in range(40)])
    inv = invoice(spark, *[{"invoice_id": f"INV-2026-{i:05}", "order_id": None, "invoice_amount": rng.choice([1000, 1100, 5100]), "issue_date": DAY + dt.timedelta(rng.randrange(60))} for i in range(60)])
    choices = decisions.invoice_choices(pay, inv, most=60)
    rows, text = {}, {}
    for r in choices.collect():
        rows.setdefault(r["subject_id"], []).append((r["counterpart_id"], r["line"]))
        text[r["subject_id"]] = r["head"]
    taken, log, want = set(), [], {}
    for s in sorted(rows):
        free = [x for x in sorted(rows[s]) if x[0] not in taken][:12]
        if not free:
            continue
        key = hashlib.sha256((decisions.INVOICE_SYSTEM + "\0" + text[s] + "\n" + "\n".join(x for _, x in free)).encode()).hexdigest()[:20]
        kind = rng.randrange(4)
        if kind == 0 and rng.random() < 0.5:
            continue  # never asked
        chosen = rng.choice(free)[0] if kind else None
        log.append((f"invoice:{s}", key if kind < 3 else f"another {s}", len(log), json.dumps({"chosen_id": chosen, "confidence": 0.5, "reasoning": ""}), None))
        want[s] = "missed" if kind == 3 else "declined" if chosen is None else chosen
        if kind in (1, 2):
            taken.add(chosen)
    log = spark.createDataFrame(log, "purpose string, prompt_hash string, seq int, response_text string, error string").repartition(5)
    got = decisions.decide_in_turn(choices.repartition(7), log, system=decisions.INVOICE_SYSTEM, most=12).collect()
    assert {r["subject_id"]: r["chosen_id"] if r["outcome"] == "accepted" else r["outcome"] for r in got} == want and len(taken) > 8
    shared = decisions.decide_invoices_in_turn(pay.repartition(3), inv.repartition(4), log).collect()
    assert sorted(shared) == sorted(got)


def asked_in_turn(choices, most, system, rng, subjects_asked=0.9):
    """A log that a plain loop over the subjects leaves, with the questions' texts, and what the loop decided."""
    rows, text = {}, {}
    for r in choices.collect():
        rows.setdefault(r["subject_id"], []).append((r["counterpart_id"], r["line"]))
        text[r["subject_id"]] = (r["head"], r["tail"])
    taken, log, want = set(), [], {}
    for s in sorted(rows):
        free = [x for x in sorted(rows[s]) if x[0] not in taken][:most]
        head, tail = text[s]
        # a question of another turn: with one more gone, or with all there
        old = [sorted(rows[s])[:most], [x for x in sorted(rows[s]) if x[0] not in taken][1:][: most or None]]
        for shown, picks in [(x, 0.7) for x in old if x != free and rng.random() < 0.7] + [(free, 1.0)] * (rng.random() < subjects_asked):
            if shown:
                question = head + "\n" + "\n".join(x for _, x in shown) + tail
                chosen = rng.choice([*(x for x, _ in shown), None, "nobody"])
                key = hashlib.sha256(f"{system}\0{question}".encode()).hexdigest()[:20]
                log.append((f"x:{s}", key, len(log), json.dumps({"chosen_id": chosen, "confidence": 0.5, "reasoning": "r"}), None, system, question))
                if shown is free:
                    want[s] = chosen
                    if chosen in {x for x, _ in free}:
                        taken.add(chosen)
    return log, want, taken


def test_claims_equal_one_pass(spark, monkeypatch):
    """Records that hold their questions are settled in rounds, with no part solved one by one; keys alone give the same."""
    parts = [decisions._decide_by_parts, decisions._decide_invoices_by_parts]
    for seed, prices, days, most in ((1, [1000], 1, 12), (2, [1000, 1010, 5000], 60, 4)):
        rng = random.Random(seed)
        pay = payment(spark, *[{"payment_id": f"p{i:03}", "order_id": None, "order_receipt": "two\nlines", "gross": rng.choice(prices), "captured_on": DAY + dt.timedelta(rng.randrange(days))} for i in range(60)])
        inv = invoice(spark, *[{"invoice_id": f"INV-2026-{i:05}", "order_id": None, "invoice_amount": rng.choice(prices), "issue_date": DAY + dt.timedelta(rng.randrange(days))} for i in range(70)])
        choices = decisions.invoice_choices(pay, inv, most=70)
        log, want, taken = asked_in_turn(choices, most, decisions.INVOICE_SYSTEM, rng)
        assert len(taken) > 8
        log = spark.createDataFrame(log, "purpose string, prompt_hash string, seq int, response_text string, error string, system string, user string").repartition(5)
        by_parts = sorted(decisions.decide_invoices_in_turn(pay, inv, log.drop("user"), most=most).collect())
        with monkeypatch.context() as m:
            m.setattr(decisions, "_decide_by_parts", None)
            m.setattr(decisions, "_decide_invoices_by_parts", None)
            for rounds, each in ((8, 100_000), (1, 20)):
                m.setattr(turns, "ROUNDS", rounds)
                m.setattr(turns, "SLICE", each)
                got = sorted(decisions.decide_invoices_in_turn(pay.repartition(3), inv.repartition(2), log, most=most).collect())
                assert got == by_parts
            assert sorted(decisions.decide_in_turn(choices.repartition(3), log, system=decisions.INVOICE_SYSTEM, most=most).collect()) == by_parts
        assert {r["subject_id"]: r["chosen_id"] for r in got if r["outcome"] in ("accepted", "not_offered", "declined")} == want
    assert parts == [decisions._decide_by_parts, decisions._decide_invoices_by_parts]


def test_claims_of_credits_equal_one_pass(spark, monkeypatch):
    rng = random.Random(9)
    batches = batch(spark, *[{"settlement_id": f"setl_{i:02}", "utr": None, "settled_date": DAY + dt.timedelta(rng.randrange(9)), "expected_credit_dedup": 97000 + rng.randrange(900)} for i in range(40)])
    credits = bank(spark, *[{"txn_id": f"bank_{i:02}", "utr": None, "credit": 96000 + rng.randrange(900), "value_date": DAY + dt.timedelta(rng.randrange(9))} for i in range(50)])
    choices = decisions.bank_choices(batches, credits)
    log, want, taken = asked_in_turn(choices, None, decisions.SYSTEM, rng)
    log = spark.createDataFrame(log, "purpose string, prompt_hash string, seq int, response_text string, error string, system string, user string")
    by_parts = sorted(decisions.decide_in_turn(choices, log.drop("user")).collect())
    monkeypatch.setattr(decisions, "_decide_by_parts", None)
    got = sorted(decisions.decide_in_turn(choices, log).collect())
    assert got == by_parts and len(taken) > 8
    assert {r["subject_id"]: r["chosen_id"] for r in got if r["outcome"] in ("accepted", "not_offered", "declined")} == want


def test_the_bank_leg_waits_for_no_invoice(spark):
    """Only the tables of the bank leg are at hand; payments and invoices would have to be read."""
    batches = batch(spark, *[{"settlement_id": f"setl_{i}", "utr": None} for i in range(1, 4)])
    credits = bank(spark, {"utr": None, "credit": 96500}, {"txn_id": "bank_2", "utr": None, "credit": 96400})
    none = spark.createDataFrame([], "subject_id string, counterpart_id string, layer string, rule string, confidence double, evidence array<string>")
    given = Inputs.__new__(Inputs)
    given.spark, given.at, given.kept = spark, {}, {"batches": batches, "bank": credits, "found_bank": none}
    assert {c for r in MAKERS["resolve_bank_leg"](given).collect() for c in [r["counterpart_id"]]} <= {"bank_1", "bank_2"}
    assert not any("invoice" in name for name in given.kept)


def nearest(payments, invoices, most):
    """The rule itself: all pairs, then the first by id."""
    out = {}
    for p, gross, day in payments:
        near = sorted(i for i, a, d in invoices if abs(d - day) <= 21 and abs(a - gross) <= gross * 0.15)
        out[p] = near[:most]
    return out


def test_invoices_in_reach_are_the_first_by_id(spark, monkeypatch):
    monkeypatch.setattr(shelves, "EACH", 7)  # several lanes of a bucket
    for seed, prices in ((1, [1000]), (2, [100, 115, 85, 120, 1000]), (3, list(range(290, 400))), (4, [10**k for k in range(2, 12)])):
        rng = random.Random(seed)
        pays = [(f"p{i:03}", rng.choice(prices), rng.randrange(80)) for i in range(70)]
        sold = [(f"INV-2026-{rng.randrange(10**5):05}-{i}", int(rng.choice(prices) * rng.choice([1, 1, 0.85, 1.15, 1.151])), rng.randrange(80)) for i in range(400)]
        pay = payment(spark, *[{"payment_id": p, "gross": g, "captured_on": DAY + dt.timedelta(d)} for p, g, d in pays], {"payment_id": "undated", "captured_on": None})
        inv = invoice(spark, *[{"invoice_id": i, "invoice_amount": a, "issue_date": DAY + dt.timedelta(d)} for i, a, d in sold], {"invoice_id": "undated", "issue_date": None})
        got = {}
        for r in decisions.l3_invoice_candidates(pay, inv.repartition(5)).orderBy("payment_id", "place").collect():
            got.setdefault(r["payment_id"], []).append(r["invoice_id"])
            assert r["place"] == len(got[r["payment_id"]])
        assert got == {p: x for p, x in nearest(pays, sold, 12).items() if x}


def test_one_price_level_is_linear_in_its_rows(spark):
    """4,000 payments and 40,000 invoices of one price and week: 160 million pairs, and 12 rows a payment."""
    pay = spark.range(4000).select(F.format_string("p%05d", "id").alias("payment_id"), F.lit(100000).cast("long").alias("gross"), F.date_add(F.lit(DAY), (F.col("id") % 7).cast("int")).alias("captured_on"), F.lit(None).cast("string").alias("order_id"), F.lit("r").alias("order_receipt"))
    inv = spark.range(40000).select(F.format_string("INV-2026-%06d", "id").alias("invoice_id"), F.lit(100000).cast("long").alias("invoice_amount"), F.date_add(F.lit(DAY), (F.col("id") % 7).cast("int")).alias("issue_date"))
    got = decisions.l3_invoice_candidates(pay, inv)
    assert got.count() == 4000 * 12 and {r["invoice_id"] for r in got.select("invoice_id").distinct().collect()} == {f"INV-2026-{i:06}" for i in range(12)}
    assert shelves.enough_of_each(inv, 12).count() == 7 * 12
    # answers to the questions in turn: every payment takes the first that is free
    want, log = 60, []
    for n in range(want):
        p, left = f"p{n:05}", [f"INV-2026-{i:06}" for i in range(n, n + 12)]
        lines = [f"invoice {i} | 1000.00 | differs by 0.00 | issued {DAY + dt.timedelta(int(i[-6:]) % 7)}" for i in left]
        head = f"payment {p} of 1000.00 captured {DAY + dt.timedelta(n % 7)} order none receipt r"
        key = hashlib.sha256((decisions.INVOICE_SYSTEM + "\0" + "\n".join([head, *lines])).encode()).hexdigest()[:20]
        log.append((f"invoice:{p}", key, n, json.dumps({"chosen_id": left[0], "confidence": 1.0, "reasoning": ""}), None))
    taken = decisions.decide_invoices_in_turn(pay, inv, spark.createDataFrame(log, "purpose string, prompt_hash string, seq int, response_text string, error string")).collect()
    assert {(r["subject_id"], r["outcome"], r["chosen_id"]) for r in taken} == {(f"p{n:05}", "accepted", f"INV-2026-{n:06}") for n in range(want)}


def test_shelves_put_taken_invoices_away():
    shelf = shelves.Shelf([(f"i{n:05}", 100, 5) for n in range(20_000)])
    for n in range(15_000):
        assert shelf.first(100, 5, 1)[0][0] == f"i{n:05}"
        shelf.take(f"i{n:05}")
    assert len(shelf.ids) < 10_000 and shelf.first(100, 5, 2) == [("i15000", 100, 5), ("i15001", 100, 5)]
    shelf.take("i00001")
    assert shelf.first(100, 40, 1) == [] == shelf.first(10, 5, 1)


def test_rivals_are_added_up_by_day(spark):
    rng = random.Random(6)
    rows = [(f"setl_{i:02}", DAY + dt.timedelta(rng.randrange(20)) if i else None, rng.randrange(-5, 10**6)) for i in range(40)]
    batches = batch(spark, *[{"settlement_id": s, "settled_date": d, "expected_credit_dedup": c} for s, d, c in rows])
    want = {}
    for s, d, _ in rows:
        for o, e, c in rows:
            if d and e and s != o and abs((d - e).days) <= 4:
                n, total, sign = want.get((s, e), (0, 0, 0))
                told = f"{o} {'-' if c < 0 else ''}{abs(c) // 100}.{abs(c) % 100:02}"
                want[s, e] = n + 1, total + c, sign + int(hashlib.sha256(told.encode()).hexdigest()[:15], 16)
    got = {(r["settlement_id"], r["day"]): (r["n"], r["total"], r["sign"]) for r in decisions.l3_competing_batches(batches.repartition(3)).collect()}
    assert got == {k: (n, t, s % decisions.SIGNS) for k, (n, t, s) in want.items()}
    few = decisions.l3_competing_batches(batches, batches.where("settlement_id = 'setl_07'")).collect()
    assert {(r["settlement_id"], r["day"]): r["n"] for r in few} == {k: v[0] for k, v in want.items() if k[0] == "setl_07"}


def test_every_rival_is_named(spark):
    """The registered query, over 40 batches of twenty days."""
    rng = random.Random(7)
    rows = [(f"setl_{i:02}", DAY + dt.timedelta(rng.randrange(20)) if i else None) for i in range(40)]
    batches = batch(spark, *[{"settlement_id": s, "settled_date": d} for s, d in rows])
    want = {(s, o) for s, d in rows for o, e in rows if d and e and s != o and abs((d - e).days) <= 4}

    class Given:
        pass

    Given.batches = batches.repartition(3)
    got = [tuple(r) for r in MAKERS["l3_competing_batches"](Given).select("settlement_id", "other_id").collect()]
    assert len(got) == len(want) and set(got) == want
    few = decisions.competing_pairs(batches, batches.where("settlement_id in ('setl_00', 'setl_07')")).collect()
    assert {tuple(r) for r in few} == {p for p in want if p[0] == "setl_07"}


def three_rivals(spark):
    """What :class:`Inputs` gives the queries about questions: three batches within four days, one far off, and a credit for each of the first two."""
    given = Inputs.__new__(Inputs)
    batches = batch(spark, *[{"settlement_id": f"setl_{i}", "utr": None, "settled_date": DAY + dt.timedelta(d), "expected_credit_dedup": c} for i, d, c in ((1, 0, 97000), (2, 4, 97000), (3, 2, -550), (4, 30, 97000))])
    credits = bank(spark, {"utr": None, "narration": "x", "credit": 96500}, {"txn_id": "bank_2", "utr": None, "narration": "x", "credit": 96400, "value_date": DAY + dt.timedelta(30)})
    none = spark.createDataFrame([], "subject_id string, counterpart_id string")
    choices = decisions.bank_choices(batches, credits).withColumn("leg", F.lit("bank"))
    given.spark, given.kept = spark, {"batches": batches, "bank": credits, "found_bank": none, "choices": choices}
    return given


def test_questions_name_every_rival(spark):
    asked = {r["subject_id"]: r["question"] for r in MAKERS["l3_render_questions"](three_rivals(spark)).collect()}
    credit = "credit bank_1 | 965.00 | on 2026-02-05 | short by 5.00 (0.52%)"
    assert asked["setl_1"] == f"batch setl_1 total 970.00\n{credit}\nother open batches: setl_2 970.00, setl_3 -5.50"
    assert asked["setl_2"] == f"batch setl_2 total 970.00\n{credit}\nother open batches: setl_1 970.00, setl_3 -5.50"
    assert asked["setl_4"].endswith("(0.62%)") and len(asked) == 3  # nobody near it


def test_what_is_asked_again_is_the_whole_question(spark):
    given = three_rivals(spark)
    keys = {r["subject_id"]: r["prompt_hash"] for r in MAKERS["l3_render_questions"](given).collect()}
    given.kept["whole_transcript"] = answered(spark, keys, ("setl_1", {"chosen_id": None, "confidence": 0.3}))
    want = {s: hashlib.sha256(f"{decisions.SYSTEM}\0batch {s} total 970.00\ncredit {c}{tail}".encode()).hexdigest()[:20] for s, c, tail in (
        ("setl_2", "bank_1 | 965.00 | on 2026-02-05 | short by 5.00 (0.52%)", "\nother open batches: setl_1 970.00, setl_3 -5.50"),
        ("setl_4", "bank_2 | 964.00 | on 2026-03-07 | short by 6.00 (0.62%)", ""),
    )}
    assert {r["subject_id"]: r["prompt_hash"] for r in MAKERS["l3_resume_plan"](given).collect()} == want


def test_ten_thousand_batches_of_one_day(spark):
    n = 10_000
    batches = spark.range(n).select(F.format_string("setl_%05d", "id").alias("settlement_id"), F.lit(DAY).alias("settled_date"), (F.col("id") * 100).alias("expected_credit_dedup"))
    got = decisions.l3_competing_batches(batches)
    assert got.count() == n and got.where(F.col("n") != n - 1).count() == 0  # a row each, not 100 million
    blocks = decisions.rival_blocks(batches).collect()
    assert sum(r["n"] for r in blocks) == n and max(r["n"] for r in blocks) < 2000
    assert sorted(x for r in blocks for x in r["said"].split(", ")) == sorted(f"setl_{i:05} {i}.00" for i in range(n))


def test_declines_reach_the_exceptions(spark):
    pay, batches, credits, ledger = payment(spark, {"order_id": None}), batch(spark, {"utr": None}), bank(spark, {"utr": None, "narration": "x", "credit": 96000}), invoice(spark, {"order_id": None, "invoice_amount": 500000})
    log = answered(spark, asked(decisions.bank_choices(batches, credits)), ("setl_1", {"chosen_id": None, "confidence": 0.3}))
    matches, open_ = assemble.run_layered(pay, batches, credits, ledger, transcript=log)
    assert matches.count() == 0
    found = {(r["subject_type"], r["link_type"]): r for r in open_.collect()}
    refused = found["payment", baselines.BANK]
    assert (refused["reason"], refused["layer_reached"], refused["candidates_considered"]) == ("llm_declined", "l3_llm", 0) and "its confidence 0.30" in refused["evidence"][-1]
    assert found["payment", baselines.INVOICE]["reason"] == "no_candidate" and found["bank_txn", baselines.BANK]["layer_reached"] == "l3_llm"
    log = answered(spark, asked(decisions.bank_choices(batches, credits)), ("setl_1", {"chosen_id": "bank_1", "confidence": 0.9, "inferred_deduction_paise": 1000}))
    matches, _ = assemble.run_layered(pay, batches, credits, ledger, transcript=log)
    r = matches.head()
    assert (r["layer"], r["rule"], round(r["confidence"], 4)) == ("l3_llm", "l3_llm_batch_disambiguation", 0.765) and "it explains a shortfall of 10.00" in r["evidence"]


def test_transcript_keeps_the_last_good_answer(spark):
    log = spark.createDataFrame([("k", 1, "old", None), ("k", 2, "new", None), ("k", 3, "bad", "timeout"), ("m", 1, None, "timeout")], "prompt_hash string, seq int, response_text string, error string")
    questions = spark.createDataFrame([("s", "k"), ("t", "m")], "subject_id string, prompt_hash string")
    assert {r["subject_id"]: r["response_text"] for r in decisions.l3_replay_join(questions, log).collect()} == {"s": "new", "t": None}
    assert [r["subject_id"] for r in decisions.l3_resume_plan(questions, log).collect()] == ["t"]


def test_scores(spark):
    cols = "link_type string, payment_id string, counterpart_id string"
    truth = spark.createDataFrame([("b", "p1", "x"), ("b", "p1", "y"), ("b", "p2", "z")], cols)
    said = spark.createDataFrame([("b", "p1", "x"), ("b", "p2", "z"), ("b", "p3", "w")], cols)
    r = score.score_links(score.edge_frame(truth, said)).head()
    assert (r["truth_edges"], r["predicted_edges"], r["true_positives"], r["resolvable"], r["exactly_resolved"], r["matched"]) == (3, 3, 2, 2, 1, 2)
    people = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("p4",)], "payment_id string")
    assert score.score_fully_reconciled(people, score.edge_frame(truth, said)).head()["fully_reconciled"] == 2
    verdicts = spark.createDataFrame([("b", "p1", True), ("b", "p2", False), ("b", "p3", True)], "link_type string, payment_id string, resolved boolean")
    tags = spark.createDataFrame([("p1", "a"), ("p1", "c"), ("p2", "a"), ("p2", "bundled_payout")], "payment_id string, tag string")
    d = {x["tag"]: x for x in breakdown.defect_breakdown(verdicts, tags).collect()}
    assert (d["a"]["n"], d["a"]["isolated_n"], d["a"]["lift_points"]) == (2, 1, -100.0)
    assert d["c"]["lift_points"] is None


@pytest.mark.parametrize("parts", [1, 9])
def test_results_do_not_depend_on_partitions(spark, parts):
    pay = payment(spark, *[{"payment_id": f"p{i}", "order_id": None, "gross": 100} for i in range(5)]).repartition(parts)
    inv = invoice(spark, *[{"invoice_id": f"INV-2026-0000{i}", "order_id": None, "invoice_amount": 100} for i in range(1)]).repartition(parts)
    assert pairs(fuzzy.assign_invoices(pay, inv)) == [("p0", "INV-2026-00000")]


def test_balances_run_by_split(spark):
    rows = [(f"t{i}", s, DAY + dt.timedelta(i % 3), 10 * i, i) for i in range(9) for s in ("a", "b")]
    df = spark.createDataFrame(rows, "txn_id string, split string, value_date date, credit long, debit long")
    got = {(r["txn_id"], r["split"]): r["balance"] for r in views.running_balance(df, 100, by=["split"]).collect()}
    for split in ("a", "b"):
        balance = 100
        for t, _, _, credit, debit in sorted((r for r in rows if r[1] == split), key=lambda r: (r[2], r[0])):
            balance += credit - debit
            assert got[t, split] == balance


def test_component_split_is_the_greedy_one(spark):
    rng = random.Random(7)
    profile = {i: {"payments": rng.choice([1, 1, 1, 2, 5, 9]), "tag": rng.choice([0, 0, 1])} for i in range(120)}
    rows = [(i, k, v) for i, p in profile.items() for k, v in p.items()]
    quotas = {"dev": 0.63, "holdout": 0.37}
    got = {r["component"]: r["split"] for r in corpus.stratified_component_split(spark.createDataFrame(rows, "component long, stratum string, n long"), quotas).collect()}
    assert got.keys() == profile.keys()
    total = {k: sum(p[k] for p in profile.values()) for k in ("payments", "tag")}
    filled, want = {s: dict.fromkeys(total, 0) for s in quotas}, {}
    text = {i: ";".join(f"{k}={v}" for k, v in sorted(p.items()) if v) for i, p in profile.items()}
    for i in sorted(profile, key=lambda i: (-profile[i]["payments"], text[i])):
        cost = {s: sum((8 if k == "payments" else 1) * ((filled[s][k] + profile[i][k]) / (t * quotas[s])) ** 2 for k, t in total.items()) for s in quotas}
        best = min(sorted(cost), key=lambda s: cost[s])
        want.setdefault(text[i], []).append(best)
        for k in total:
            filled[best][k] += profile[i][k]
    for t, splits in want.items():
        assert sorted(splits) == sorted(got[i] for i in profile if text[i] == t)


def test_one_profile_of_nearly_all_components_is_many_ranges(spark, monkeypatch):
    rows = spark.range(30_000).select(F.col("id").alias("component"), F.lit("payments").alias("stratum"), F.when(F.col("id") % 10 == 0, F.col("id") % 7 + 2).otherwise(1).cast("long").alias("n"))
    seen, plain = [], order.in_ranges
    monkeypatch.setattr(order, "in_ranges", lambda *a: seen.append(plain(*a)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = corpus.stratified_component_split(rows, {"a": 0.75, "b": 0.25})
        share = got.join(rows, "component").groupBy("split").agg(F.sum("n").alias("n")).collect()
        assert seen[0].where("profile = 'payments=1'").groupBy("_range").count().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = {r["split"]: r["n"] for r in share}
    assert got.count() == 30_000 and abs(n["a"] / sum(n.values()) - 0.75) < 0.001


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session())
