import hashlib
import math
import os
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from settlematch.llm import infill, queries, token_files, whitening
from tests.llm.fixtures import empty, frame, rows

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# --- whitening ---


@pytest.mark.parametrize(("n", "dims", "most"), [(1, 3, 5), (64, 1, 1), (130, 4, 1000), (70, 2, 1 << 59), (900, 5, 2)])
def test_product_sums_are_exact(n, dims, most):
    x = np.random.default_rng(n).integers(-most, most, (n, dims))
    wide = np.append(x, np.ones((n, 1), np.int64), axis=1).astype(object)
    assert (whitening.product_sums(x) == wide.T @ wide).all()


def plainly_whitened(vectors, k):
    """The same by fractions and numpy, row by row."""
    usable = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    mean = [Fraction(s, n) for s in sums]
    v = np.array([[float(sum((x[a] - mean[a]) * (x[b] - mean[b]) for x in fit) / n) for b in range(dims)] for a in range(dims)])
    value, vector = np.linalg.eigh(v)
    order = [d for d in np.argsort(-value) if value[d] > 1e-12 * value.max()][:k]
    out = {}
    for i, x in usable:
        off = np.array([float(c - m) for c, m in zip(x, mean, strict=True)])
        out.setdefault(i, []).append((sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), [float(off @ vector[:, d] / math.sqrt(value[d])) for d in order]))
    return n, out, [value[d] / value.sum() for d in order]


def held_to(got, vectors, k, key="vec_id"):
    n, want, shares = plainly_whitened(vectors, k)
    found = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9 and r["explained"] == pytest.approx(shares[r["component"] - 1], rel=1e-9)
        found.setdefault(r[key], []).append((r["component"], int(r["deviation_exact"]), r["whitened"]))
        assert r["deviation"] == (int(r["deviation_exact"]) if r["deviation_exact"] < 1 << 63 else None)
    assert found.keys() == want.keys()
    sides = {}
    for i, copies in want.items():
        assert len(found[i]) == len(copies) * len(shares)
        assert sorted(d for c, d, _ in found[i] if c == 1) == sorted(d for d, _ in copies)
        for c in range(len(shares)):
            mine, plain = sorted(abs(w) for x, _, w in found[i] if x == c + 1), sorted(abs(w[c]) for _, w in copies)
            assert mine == pytest.approx(plain, rel=1e-6, abs=1e-8)
            for x, _, w in found[i]:
                if x == c + 1 and len(copies) == 1 and abs(w) > 1e-6:
                    sides.setdefault(c, set()).add(np.sign(w) == np.sign(copies[0][1][c]))
    assert all(len(s) == 1 for s in sides.values())  # either sign, the same for all rows


VECTORS = "vec_id long, embedding array<float>, n string, Component int"


def test_whitens_like_plain_arithmetic(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.gauss(0, 1) * (d + 1) + 40 for d in range(6)]) for i in range(90)]
    vectors += [(200, None), (201, []), (202, [1.0] * 5 + [None]), (203, [1.0] * 5 + [float("nan")]), (204, [float("-inf")] * 6)]
    vectors += [(205, vectors[0][1]), (205, vectors[0][1]), (None, vectors[1][1]), (206, vectors[2][1])] * 30  # a hot vector, and repeated rows
    df = spark.createDataFrame([(*v, "x", 1) for v in vectors], VECTORS).repartition(5)
    single = [(i, [float(np.float32(c)) if c is not None else None for c in v] if v else v) for i, v in vectors]
    got = whitening.whiten(df, k=4).collect()
    held_to(got, single, 4)
    assert max(r["component"] for r in got) == 4


def test_whitening_without_variance_or_rows(spark):
    same = spark.createDataFrame([(1, [2.0, 3.0], "", 0)] * 5, VECTORS)
    none = whitening.whiten(same)
    assert none.collect() == [] and none.columns == whitening.whiten(spark.createDataFrame([], VECTORS)).columns
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], "", 0) for i in range(9)], VECTORS)
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}  # one direction only
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(spark.createDataFrame([(1, [1.0], "", 0), (2, [1.0, 2.0], "", 0)], VECTORS))
    with pytest.raises(ValueError, match="key"):
        whitening.whiten(same.withColumnRenamed("n", "x").withColumnRenamed("vec_id", "N"), key="N")


def test_wide_values_stay_exact(spark):
    rng = random.Random(9)
    vectors = [(i, [rng.uniform(-1, 1) * 2.0**50, rng.uniform(-1, 1) * 2.0**30, float(i)]) for i in range(40)]
    df = spark.createDataFrame([(*v, "", 0) for v in vectors], "vec_id long, embedding array<double>, n string, Component int")
    got = whitening.whiten(df, k=1).collect()
    n, want, _ = plainly_whitened(vectors, 1)
    assert {r["vec_id"]: int(r["deviation_exact"]) for r in got} == {i: c[0][0] for i, c in want.items()}
    assert any(r["deviation"] is None for r in got)


@tables
def test_registered_whitening(spark):
    df = queries.op11_bit_sliced_whitening(spark, SF)
    assert df.dtypes[:7] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    held_to(df.collect(), [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()], 16)


# --- token lists ---


def plain_tokens(documents):
    tokenizer, out, start = Tokenizer.from_file(TOKENIZER), [], 0
    for doc_id, text in documents:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, ids))
        start += len(ids)
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_table_and_its_partial_reads(spark, tmp_path, encoding):
    path = f"file://{tmp_path}/t"
    token_files.write(frame(spark).repartition(3), path, TOKENIZER, 0, encoding=encoding, row_group=64 << 10, page=2 << 10, page_rows=7)
    want = plain_tokens(sorted(((r[0], r[1]) for r in rows()), key=lambda r: (r[0] is not None, r[0])))
    got = sorted(map(tuple, token_files.checksums(spark, path).collect()), key=lambda r: r[1])
    assert got == [(i, start, len(ids), crc(ids)) for i, start, ids in want]
    assert sorted(map(tuple, token_files.metadata(spark, path).select("doc_id", "start", "n_tokens").collect()), key=lambda r: r[1]) == [r[:3] for r in got]
    some = token_files.documents_between(spark, path, 10, 40)
    assert sorted((r["doc_id"], r["start"], list(r["ids"])) for r in some.collect()) == [w for w in want if w[0] is not None and 10 <= w[0] <= 40]
    stream = [t for _, _, ids in want for t in ids]
    for a, b in ((0, 5), (1000, 4321), (len(stream) - 3, len(stream) + 9), (0, len(stream)), (len(stream), len(stream) + 5), (7, 7)):
        part = sorted(token_files.stream_between(spark, path, a, b).collect(), key=lambda r: r["start"])
        assert [t for r in part for t in r["ids"]] == stream[a:b]
        assert not part or part[0]["start"] == a


def test_token_files_have_the_layout_asked_for(spark, tmp_path):
    for encoding, name in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = f"{tmp_path}/{encoding}"
        token_files.write(frame(spark, n=400), f"file://{path}", TOKENIZER, 0, encoding=encoding, row_group=16 << 10, page=4 << 10, page_rows=9)
        files = [pq.ParquetFile(f"{path}/tokens/{f}").metadata for f in sorted(os.listdir(f"{path}/tokens")) if f.endswith(".parquet")]
        assert sum(f.num_rows for f in files) == 401
        assert any(f.num_row_groups > 1 for f in files)
        for f in files:
            for g in range(f.num_row_groups):
                group = f.row_group(g)
                for c in range(group.num_columns):
                    column = group.column(c)
                    assert column.has_column_index and column.has_offset_index
                    is_list = column.path_in_schema.startswith("ids")
                    assert (name if is_list else "DELTA_BINARY_PACKED") in column.encodings
                    assert column.has_dictionary_page == (is_list and encoding == "dictionary")
    plan = token_files.metadata(spark, f"file://{path}")._jdf.queryExecution().toString()
    assert "ids:array" not in plan.split("Physical Plan")[1]
    plan = token_files.documents_between(spark, f"file://{path}", 3, 9)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,3)" in plan and "LessThanOrEqual(doc_id,9)" in plan
    with pytest.raises(ValueError, match="encoding"):
        token_files.layout("plain", 1, 1, 1)


def test_token_table_of_repeated_and_no_rows(spark, tmp_path):
    token_files.write(empty(spark), f"file://{tmp_path}/none", TOKENIZER, 0)
    assert token_files.checksums(spark, f"file://{tmp_path}/none").collect() == []
    assert token_files.stream_between(spark, f"file://{tmp_path}/none", 0, 10).collect() == []
    same = spark.createDataFrame([(5, "one text")] * 500 + [(5, "another"), (4, None)], "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(same, f"file://{tmp_path}/same", TOKENIZER, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(map(tuple, token_files.checksums(spark, f"file://{tmp_path}/same").collect()), key=lambda r: r[1])
    assert got[0] == (4, 0, 1, crc([0])) and len(got) == 502
    assert all(b[1] == a[1] + a[2] for a, b in zip(got, got[1:], strict=False))
    assert token_files.index(spark, f"file://{tmp_path}/same").count() > 1  # one id may fill many files


@tables
def test_registered_token_lists(spark):
    df = queries.op12_token_lists(spark, SF)
    assert df.dtypes[:4] == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    assert sorted(map(tuple, df.collect())) == [(i, start, len(ids), crc(ids)) for i, start, ids in plain_tokens(documents)]


# --- fill in the middle ---


def by_characters(text, doc_id):
    """The contract's rule, a character at a time."""
    text, lines, line = text or "", [], ""
    for c in text:
        line += c
        if c == "\n":
            lines, line = [*lines, line], ""
    lines += [line] if line else []
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text:
        return len(lines), "plain", None, None, text
    if h4 % 100 < 50:
        return len(lines), "spm", len(prefix), len(middle), "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    return len(lines), "psm", len(prefix), len(middle), "<P>" + prefix + "<S>" + suffix + "<M>" + middle


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = ["a", "é", "漢", "🙂", "\n", "\n\n", "\r\n", "\x00", "<", "<P", ">", "S>", " word"]
    shared = "".join(rng.choices(letters, k=3000))
    for i in range(n):
        text = "".join(rng.choices(letters, k=rng.choice((0, 1, 5, 400, 4000))))
        yield i, rng.choice((text, text + shared, shared + text, text + "\n", "x" * 9000 + text, "\n" * rng.randrange(3000)))


def test_cuts_equal_a_walk_over_characters():
    memo = infill.Memo()
    for i, text in random_texts(150, 3):
        assert infill.transformed(text, i, memo, 7, 100, 50) == by_characters(text, i)
    assert memo.hits > 100  # shared passages are cut into the same chunks
    small = infill.Memo(room=600)
    for i, text in random_texts(40, 4):
        assert infill.transformed(text, i, small, 7, 100, 50) == by_characters(text, i)
        assert small.held == sum(map(len, small.kept)) and (small.held <= 600 or len(small.kept) == 1)


def test_chunks_follow_the_content():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 200_000, dtype=np.uint8)
    ends = infill.chunk_ends(data)
    assert ends[-1] == len(data) and all(infill.LEAST <= b - a <= infill.MOST for a, b in zip([0, *ends], ends[:-1], strict=False))
    moved = infill.chunk_ends(np.concatenate([rng.integers(0, 256, 777, dtype=np.uint8), data]))
    assert len({e + 777 for e in ends} & set(moved)) > 0.9 * len(ends)
    gear, window = infill._GEAR.astype(object), 1 << infill.DOUBLINGS
    slow = [i + 1 for i in range(3000) if sum(gear[data[i - k]] << k for k in range(min(window, i + 1))) % (1 << 32) >> 32 - infill.CUT_BITS == 0]
    assert slow == [int(p) for p in infill.cut_places(data) if p <= 3000]
    old = infill.STRETCH
    try:
        infill.STRETCH = 1000
        assert infill.chunk_ends(data) == ends  # however long the stretches
    finally:
        infill.STRETCH = old
    assert infill.chunk_ends(data[:0]) == [] and infill.chunk_ends(np.zeros(20_000, np.uint8))[-1] == 20_000


def test_fill_in_middle_of_awkward_rows(spark):
    made = infill.fill_in_middle(frame(spark).withColumn("Output", F.lit("old")).withColumn("FORM", F.lit(1)))
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "shard", "slot", "path", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows())
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == by_characters(r["text"], r["doc_id"])
        assert r["back"] == (r["text"] or "")
    assert infill.fill_in_middle(empty(spark)).collect() == []
    texts = spark.createDataFrame(list(random_texts(80, 8)), "doc_id long, text string")
    for r in infill.fill_in_middle(texts).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect():
        assert r["back"] == r["text"]


def test_rate_and_order_are_parameters(spark):
    docs = spark.createDataFrame([(i, f"a{i}\nb\nc") for i in range(300)], "doc_id long, text string")
    forms = [r["form"] for r in infill.fill_in_middle(docs, seed=1, rate=30, spm=0).collect()]
    assert 50 < forms.count("psm") < 130 and set(forms) == {"psm", "plain"}


@tables
def test_registered_fill_in_middle(spark):
    df = queries.op13_fill_in_middle(spark, SF)
    assert df.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in df.collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        n, form, prefix, middle, output = by_characters(text, i)
        assert tuple(got[i]) == (i, n, form, prefix, middle, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
