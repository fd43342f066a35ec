import pytest

import corpus_pipeline
from settlematch.llm import packing, pii, quality, toxicity
from tests.llm.test_text_operators import brute_components

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


def test_stages_equal_plain_python(spark, docs):
    """Every stage against its model or rule applied row by row in this process."""
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = {r["doc_id"]: r["text"] for r in now.collect()}
        model = {"quality": quality.train, "toxicity": toxicity.train}.get(name)
        if model:
            model = model(now, labels)
        after = stage(spark, now, TABLES)
        got = {r["doc_id"]: r["text"] for r in after.collect()}
        assert after.columns == docs.columns
        if name == "quality":
            want = {i: t for i, t in rows.items() if model.score([t])[0] >= 0.3}
        elif name == "toxicity":
            want = {i: t for i, t in rows.items() if model.score(model.evidence(toxicity.tokens(t))[0]) < 0.5}
        elif name == "near_copies":
            want = {i: rows[i] for i, (_, c) in brute_components(rows, 5, 80, 100).items() if c == i}
        else:
            want = {i: pii.redacted(t, pii.all_spans(t)[1]) for i, t in rows.items()}
        assert got == want
        now = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, TABLES).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in now.select("doc_id").collect()}
    fill = {}
    for r in pieces:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in fill.values():
        assert [o for o, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= 1024
    assert len(fill) <= 1.05 * sum(r["length"] for r in pieces) / 1024 + 3


def test_run_applies_the_stages(spark, docs):
    got = corpus_pipeline.run(spark, TABLES)
    assert got.columns == [*packing.PIECES.names, "sequence_id", "offset"]
    assert 0 < got.select("doc_id").distinct().count() < docs.count()


def test_stages_take_empty_tables(spark, docs):
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, TABLES).count() == 0
