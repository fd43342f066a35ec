"""Files: call logs read in order, sources written in order, answers published as one."""

import datetime as dt
import hashlib
import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from settlematch import storage
from settlematch.operators import decisions, order, views
from settlematch.plans import queries
from settlematch.plans.queries import MAKERS, Inputs
from settlematch.sources import files, results


def record(system="s", user="u", response="{}", **more):
    return json.dumps({"call_id": "c", "purpose": "bank:b", "model": "one", "prompt_hash": "the model's", "system": system, "user": user, "response_text": response, "input_tokens": 5, "metadata": {"k": "v"}, "cost_usd": 0.5} | more)


def answers(spark, path):
    return {(r["system"], r["user"]): r["response_text"] for r in decisions.latest_answers(files.read_transcript(spark, path)).collect()}


def test_the_last_good_record_of_a_question_wins_without_numbers(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    lines = [record(response="old"), "", record(response="new", model="another"), "   ", record(response="lost", error="429"), record(user="v", response="only"), record(user="w", error="quota"), record(user="x", error="", response="kept")]
    path.write_text("\n".join(lines) + "\n")
    assert answers(spark, f"file://{path}") == {("s", "u"): "new", ("s", "v"): "only", ("s", "x"): "kept"}
    read = files.read_transcript(spark, f"file://{path}")
    r = read.where("user = 'v'").head()
    # what was asked decides, not the model or the hash that it noted down
    assert r["recorded_hash"] == "the model's" and r["prompt_hash"] == read.select(F.substring(F.sha2(F.concat(F.lit("s"), F.lit("\0"), F.lit("v")), 256), 1, 20)).head()[0]
    assert (r["input_tokens"], r["metadata"], r["cost_usd"]) == (5, {"k": "v"}, 0.5)
    questions = spark.createDataFrame([("a", read.where("user = 'u'").head()["prompt_hash"]), ("b", read.where("user = 'w'").head()["prompt_hash"])], "subject_id string, prompt_hash string")
    assert {x["subject_id"]: x["missed"] for x in decisions.l3_replay_join(questions, read).collect()} == {"a": False, "b": True}
    assert [x["subject_id"] for x in decisions.l3_resume_plan(questions, read).collect()] == ["b"]  # a failed call is asked again


def test_a_read_log_tells_which_record_counts(spark):
    """The registered query: a question asked twice, one that failed first, one asked once, and one that only failed."""
    log = [("k", 1, "old", None), ("k", 2, "new", None), ("f", 1, None, "timeout"), ("f", 2, "got", None), ("o", 1, "only", None), ("m", 1, None, "timeout")]
    given = Inputs.__new__(Inputs)
    given.spark, given.kept = spark, {"whole_transcript": spark.createDataFrame([("bank:b", "s", q, *more, "noted") for q, *more in log], "purpose string, system string, user string, seq int, response_text string, error string, prompt_hash string")}
    key = {hashlib.sha256(f"s\0{q}".encode()).hexdigest()[:20]: q for q in "kfom"}
    assert sorted((key[r["prompt_hash"]], r["seq"], r["response_text"]) for r in MAKERS["read_transcript"](given).collect()) == [("f", 2, "got"), ("k", 2, "new"), ("o", 1, "only")]


def test_a_log_is_written_without_tables_of_its_texts(spark, monkeypatch):
    """Straight from the questions: the texts go into packed lines and nowhere else, and the last good record counts as before."""
    rows = [("bank", f"b{i:03}", f"head {i}", "", c, f"credit {c} | 1") for i in range(300) for c in ("x", "y")]
    given, kept = Inputs.__new__(Inputs), []
    choices = spark.createDataFrame(rows, "leg string, subject_id string, head string, tail string, counterpart_id string, line string")
    tails = spark.createDataFrame([(f"b{i:03}", "\nother open batches: " + "z 1.00, " * 500) for i in range(300)], "subject_id string, tail string")
    given.spark, given.kept = spark, {"choices": choices, "rivals": tails}
    monkeypatch.setattr(queries, "written", lambda df: kept.append(df) or storage.written(df))
    monkeypatch.setattr(queries, "_folder", lambda t, at=f"{queries.shared_folder(spark)}/log-{uuid.uuid4().hex}": at)
    got = {tuple(r) for r in MAKERS["read_transcript"](given).collect()}
    assert kept == [] and all(f.endswith(".json.gz") for f in os.listdir(queries._folder(None).removeprefix("file://")) if f.startswith("part-"))
    given.kept = {"choices": choices, "rivals": tails}
    log = given.whole_transcript.where("error is null").select("prompt_hash", F.col("seq").cast("long"), "response_text").collect()
    last = {h: (h, q, x) for h, q, x in sorted(tuple(r) for r in log)}
    assert got == set(last.values()) and {q for _, q, _ in got} == {1, 2}


def test_a_missing_transcript_is_empty(spark, tmp_path):
    assert files.read_transcript(spark, f"file://{tmp_path}/nothing.jsonl").collect() == []
    assert answers(spark, f"file://{tmp_path}/nothing.jsonl") == {}
    (tmp_path / "bad.jsonl").write_text("{\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_transcript(spark, f"file://{tmp_path}/bad.jsonl").collect()


def test_order_holds_over_splits_of_a_file_and_over_files(spark, tmp_path):
    n = 4000
    for k in (0, 1):
        (tmp_path / f"log-{k}.jsonl").write_text("".join(record(user=str(i % 100), response=str(k * n + i)) + "\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        read = files.read_transcript(spark, f"file://{tmp_path}")
        assert read.select("place.file", "place.start").distinct().count() > 10  # many splits of both files
        assert {int(u): int(r) for (_, u), r in answers(spark, f"file://{tmp_path}").items()} == {i % 100: n + i for i in range(n)}
        lines = order.line_numbers(read).select("line", "response_text").collect()
        assert sorted(r["line"] for r in lines) == list(range(1, 2 * n + 1)) and all(int(r["response_text"]) + 1 == r["line"] for r in lines)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


BANK = "txn_id string, value_date date, posted_date date, narration string, utr string, credit long, debit long, balance long, ref_no string"


@pytest.mark.parametrize("one_file", [False, True])
def test_files_read_by_name_give_the_whole_order(spark, tmp_path, one_file):
    rng = random.Random(1)
    days = [None, *[dt.date(2026, 1, 1) + dt.timedelta(d) for d in range(5)]]
    rows = [(f"t{i:04}", rng.choice(days), None, "a, \"b\"\nc" if i % 50 == 0 else "n", None, i, 0, 5, "r") for i in range(800)]
    rng.shuffle(rows)
    bank = spark.createDataFrame(rows, BANK).repartition(6)
    path = f"{tmp_path}/bank"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_csv(bank.withColumnsRenamed({"credit": "credit_amount", "debit": "debit_amount"}).withColumn("narration", F.regexp_replace("narration", "\n", " ")), f"file://{path}", files.BANK, ("credit_amount", "debit_amount", "balance"), [F.col("value_date"), F.col("txn_id")], one_file=one_file)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(f for f in os.listdir(path) if f.endswith(".csv"))
    assert len(parts) == 1 if one_file else len(parts) > 2
    seen = []
    for f in parts:
        with open(f"{path}/{f}") as lines:
            assert next(lines).strip() == ",".join(files.BANK)
            seen += [line.split(",")[0] for line in lines]
    assert seen == [r[0] for r in sorted(rows, key=lambda r: (str(r[1] or ""), r[0]))]


def test_a_day_of_very_many_rows_is_many_ranges(spark):
    bank = spark.range(40_000).select(F.format_string("t%06d", "id").alias("txn_id"), F.lit(dt.date(2026, 1, 1)).alias("value_date"), (F.col("id") % 7).alias("credit"), (F.col("id") % 3).alias("debit"), F.lit("x").alias("note"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert order.in_ranges(bank, [F.col("value_date"), F.col("txn_id")]).groupBy("_range").count().count() > 2
        got = views.running_balance(bank, 100).orderBy("txn_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    at, want = 100, []
    for i in range(40_000):
        at += i % 7 - i % 3
        want.append(at)
    assert [r["balance"] for r in got] == want and got[0].asDict().keys() == {"txn_id", "value_date", "credit", "debit", "note", "balance"}
    assert views.running_balance(bank.where("false"), 5).collect() == []


MATCHES = "match_id string, link_type string, payment_id string, counterpart_ids array<string>, layer string, rule string, confidence double, evidence array<string>, source_records map<string,array<string>>"
OPEN = "exception_id string, subject_type string, subject_id string, link_type string, reason string, evidence array<string>"


def answer(spark, n, word):
    matches = spark.createDataFrame([(f"m{i}", "payment_to_bank", f"pay_{i}", [f"b{i}"], "l1", "rule", 1.0, [f"{word} {i}", "more"], {"bank": [f"b{i}"]}) for i in range(n)], MATCHES)
    open_ = spark.createDataFrame([("x1", "payment", "pay_3", "payment_to_invoice", "no_candidate", ["none"]), ("x2", "invoice", "pay_3", "payment_to_invoice", "unmatched_counterpart", ["not the payment"])], OPEN)
    return matches, open_


def test_versions_are_published_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/answers"
    assert results.latest(spark, folder) is None
    cards = spark.createDataFrame([("layered", "payment_to_bank", 0.5, None)], "matcher string, link_type string, precision double, recall double")
    calls = spark.createDataFrame([(i, f"call {i}", None if i % 2 else "timeout") for i in range(50)], "_n int, purpose string, error string").repartition(4)
    assert results.save(folder, *answer(spark, 40, "first"), cards, calls, order=["_n"]) == 1
    kept = results.latest(spark, folder)
    assert kept.matches.count() == 40 and sorted(kept.matches.columns) == sorted(answer(spark, 1, "")[0].columns)
    assert kept.matches.where("payment_id = 'pay_7'").head()["source_records"] == {"bank": ["b7"]}
    assert [tuple(r) for r in kept.part("scorecards").collect()] == [tuple(cards.head())]
    lines = [json.loads(x) for x in spark.read.text(f"{kept.at}/calls").toPandas()["value"]]
    assert sorted(x["purpose"] for x in lines) == sorted(f"call {i}" for i in range(50)) and all(x.keys() == {"purpose", "error"} for x in lines)
    broken = cards.withColumn("precision", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):  # after matches and exceptions stand
        results.save(folder, *answer(spark, 5, "half"), broken)
    assert results.latest(spark, folder).matches.count() == 40
    assert results.save(folder, *answer(spark, 3, "second")) == 2
    newest = results.latest(spark, folder)
    assert newest.matches.count() == 3 and newest.parts.keys() == {"matches", "exceptions"}
    assert kept.matches.count() == 40  # who reads the version before goes on doing so


def test_two_jobs_do_not_publish_one_number(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/answers"
    results.save(folder, *answer(spark, 2, "a"))
    monkeypatch.setattr(results, "_names", lambda *a: [])  # has not yet seen the first
    with pytest.raises(RuntimeError, match="another job"):
        results.save(folder, *answer(spark, 3, "b"))
    monkeypatch.undo()
    assert results.latest(spark, folder).matches.count() == 2


def test_a_trace_reads_one_bucket_and_runs_no_matcher(spark, tmp_path):
    folder = f"file://{tmp_path}/answers"
    results.save(folder, *answer(spark, 300, "said"), buckets=16)
    story = results.latest(spark, folder).trace("pay_3")
    assert sorted(map(tuple, story.collect())) == [("exception", "payment_to_invoice", "no_candidate", 0, "none"), ("match", "payment_to_bank", "rule", 0, "said 3"), ("match", "payment_to_bank", "rule", 1, "more")]
    plan = story._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") == 2 and "Join" not in plan and "Exchange" not in plan and "MapInArrow" not in plan
    assert spark.read.parquet(f"{results.latest(spark, folder).at}/matches").where("bucket = 3").count() < 60
    assert results.latest(spark, folder).trace("nobody").collect() == []


def test_fingerprints_follow_the_files(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    first = results.fingerprint(spark, f"file://{tmp_path}")
    assert first == results.fingerprint(spark, f"file://{tmp_path}")
    (tmp_path / "b").write_text("2")
    assert results.fingerprint(spark, f"file://{tmp_path}") != first


def test_an_application_clears_its_tables_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}")
    (tmp_path / "another-application" / "t").mkdir(parents=True)
    kept = storage.written(spark.range(5))
    assert kept.count() == 5 and len(os.listdir(tmp_path)) == 2
    storage.discard(storage.written(spark.range(3)))
    assert len(os.listdir(tmp_path / spark.sparkContext.applicationId)) == 1
    storage.clear(spark)
    storage.clear(spark)
    assert os.listdir(tmp_path) == ["another-application"]


def test_a_session_without_a_folder_gets_one_for_itself():
    class Conf(dict):
        pass

    class Context:
        master, applicationId = "local[2]", "app-of-this-test"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    folder = storage.shared_folder(Session())
    assert folder.startswith("file://") and storage.shared_folder(Session()) == folder
    Context.master = "local-cluster[2,1,1024]"  # executors of their own
    with pytest.raises(ValueError, match="share"):
        storage.shared_folder(Session())
