import hashlib
import math
import os
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from settlematch.llm import iblt, jaccard, quality, segmentations, sitetree, toxicity
from tests.llm.fixtures import empty, frame, rows


# --- fingerprints ---

LINES = __import__("re").compile(rf"[^\n]{{{iblt.LONG},}}?[.!?,|](?=\s|$)|[^\n]+")


def likeness(a, b):
    x, y = set(LINES.findall(a)), set(LINES.findall(b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_equal_brute_force(spark):
    df = frame(spark, n=60)
    got = {r["doc_id"]: r for r in iblt.fingerprints(df.select("doc_id", "text", "path")).collect()}
    texts = [r[1] or "" for r in rows(n=60)]
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == __import__("hashlib").sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(likeness(text, edited)) and r["near_next"] == pytest.approx(likeness(text, after))
    assert got[3]["fingerprint"] == got[4]["fingerprint"] == got[5]["fingerprint"] and got[3]["near_next"] == 1.0
    assert got[8]["fingerprint"] == got[9]["fingerprint"]


@pytest.mark.parametrize("ids", [[0, 1, 2, 2**62], [-9 * 10**18, 9 * 10**18], [3, 1, 2], [hash(str(i)) % 2**64 - 2**63 for i in range(40)]])
def test_any_spread_of_ids_has_a_next_document(spark, ids, monkeypatch):
    monkeypatch.setattr(iblt, "EACH", 3)
    texts = {i: f"line {k}\ncommon" for k, i in enumerate(ids)}
    got = {r["doc_id"]: r for r in iblt.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    line = sorted(texts)
    for k, i in enumerate(line):
        after = texts[line[(k + 1) % len(line)]]
        half = len(texts[i]) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((texts[i][: len(texts[i]) - half] + after[:half]).encode()).hexdigest()
        assert got[i]["near_next"] == pytest.approx(1 / 3)


def test_repeated_and_missing_ids_follow_each_other_by_text(spark):
    rows_ = [(5, "c\nx"), (5, "a\nx"), (5, "b\nx"), (None, "n"), (9, "z")]
    got = iblt.fingerprints(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    edited = sorted(hashlib.sha256(x.encode()).hexdigest() for x in ("a\nb", "b\nc", "c\nz", "n", "z"))
    assert len(got) == 5 and sorted(r["edited_sha256"] for r in got) == edited


def test_a_fingerprint_gives_its_digests_back(spark):
    df = frame(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows_ = iblt.fingerprints(df).select("doc_id", iblt.own_digests(F.col("fingerprint")).alias("own")).join(df.select("doc_id", iblt.digests(F.col("text")).alias("keys")), "doc_id").collect()
    assert rows_ and all(r["own"]["ok"] and sorted(r["own"]["plus"]) == sorted(r["keys"]) and not r["own"]["minus"] for r in rows_)


def test_differences_that_no_sketch_peels_are_compared_plainly(spark, monkeypatch):
    monkeypatch.setattr(iblt, "ROUNDS", 1)
    monkeypatch.setattr(iblt, "LEVELS", 1)
    a, b = "\n".join(f"a{i}" for i in range(900)), "\n".join(f"a{i}" for i in range(500, 1400))
    r = iblt.fingerprints(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    assert all(x["near_next"] == pytest.approx(400 / 1400) for x in r)


def test_fingerprints_of_one_and_no_rows(spark):
    assert iblt.fingerprints(empty(spark)).count() == 0
    r = iblt.fingerprints(spark.createDataFrame([(7, "a\nb")], "doc_id long, text string")).head()
    assert (r["near_next"], r["n_chars"]) == (1.0, 3)


def test_small_sketch_fails_and_a_larger_one_peels(spark):
    a, b = [f"a{i}" for i in range(200)], [f"a{i}" for i in range(100, 320)]
    df = spark.createDataFrame([(1, "\n".join(a)), (2, "\n".join(b))], "doc_id long, text string")
    r = {x["doc_id"]: x for x in iblt.fingerprints(df).collect()}
    assert r[1]["near_next"] == pytest.approx(100 / 320) == r[2]["near_next"]


# --- n-gram Jaccard join ---


def brute_components(texts, width, num, den):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            o = len(sets[i] & sets[j])
            if i < j and o and den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("tile", "few"), [(1024, 8), (3, 0)])
def test_join_equals_brute_force(spark, monkeypatch, tile, few):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "FEW", few)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    texts = {}
    for group in range(12):  # near copies with one to many edits
        base = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        for _ in range(8):
            mine = list(base)
            for _ in range(rng.randrange(5)):
                mine[rng.randrange(len(mine))] = rng.choice(words)
            texts[len(texts)] = " ".join(mine)
    passage = " ".join(rng.choice(words) for _ in range(25))
    for i in range(20):  # a passage that many share
        texts[len(texts)] = passage + " " + " ".join(rng.choice(words) for _ in range(12))
    texts |= {len(texts) + k: t for k, t in enumerate([None, "", " ", "One two", "one  TWO\n", "É é", passage, passage])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, width=4, num=85, den=100).collect()}
    assert got == brute_components(texts, 4, 85, 100)


def test_join_of_awkward_rows(spark):
    df = frame(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, width=5, num=80, den=100).collect()}
    assert got == brute_components({r[0]: r[1] for r in rows()}, 5, 80, 100)
    kept = jaccard.keep_one_of_each(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in got.items() if c == i}
    assert jaccard.jaccard_components(empty(spark), width=5, num=80, den=100).count() == 0


def test_texts_of_one_id_are_one_node(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words[:30]), " ".join(words[30:])
    texts = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (4, "else " * 9), (None, a), (1, a)]
    got = jaccard.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), width=4, num=85, den=100).collect()
    assert len(got) == len(texts)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, None)}
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] == 1) == [27, 27, 27]
    kept = jaccard.keep_one_of_each(spark.createDataFrame(texts, "doc_id long, text string"), width=4, num=85, den=100)
    assert sorted(kept.collect(), key=str) == sorted([t for t in texts if t[0] in (1, 4, None)], key=str)


def test_bitmap_bound_never_cuts_a_link():
    rng = np.random.default_rng(9)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, rng.integers(5, 200), dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.95], rng.integers(0, 2**63, rng.integers(0, 8), dtype=np.uint64)]))
        if not len(y):
            continue
        a, b = sorted((x, y), key=len)
        tile = jaccard._Tile([len(a), len(b)], [jaccard.bitmap(a).tobytes(), jaccard.bitmap(b).tobytes()], 85, 100)
        if jaccard._linked(a, b, 85, 100):
            assert tile.partners(0, 2).tolist() == [1]


# --- learned scores ---


def corpus(spark, n=300):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(60)]
        bad, foul = i % 3 == 0, i % 4 == 0
        if foul:
            for _ in range(4):
                body[rng.randrange(60)] = rng.choice(["vileness", "scorned"])
        docs.append((i, " ".join(w.upper() + "!!" if bad else w for w in body), "en", "s", 1))
        labels.append((i, 0 if bad else 1, 1 if foul else 0))
    labels += [(None, 1, 0), (10**6, 1, 1), (5, None, None), (1, 1, 0)]
    return spark.createDataFrame(docs + [(n, None, None, None, None), (n + 1, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(got, labels, column):
    truth = {r["doc_id"]: r[column] for r in labels.where(f"{column} is not null").collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)


def test_quality_generalises(spark):
    docs, labels = corpus(spark)
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert accuracy(got, labels, "quality") > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}


def test_toxicity_generalises_and_finds_passages(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert accuracy(got, labels, "toxic") > 0.95
    foul = next(r for r in got if r["doc_id"] == 4)
    words = toxicity.tokens(docs.where("doc_id = 4").head()["text"])
    assert foul["passages"] and all(w in (b"vileness", b"scorned") for s, e in foul["passages"] for w in (words[s], words[e - 1]))
    assert toxicity.keep_clean(docs, labels).count() == sum(not r["predicted"] for r in got)


def test_learned_scores_without_labels_or_rows(spark):
    docs, labels = corpus(spark, 40)
    none = labels.where("false")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    assert len(toxicity.score(docs, toxicity.train(docs, none)).collect()) == docs.count()
    assert quality.score(docs.where("false"), quality.train(docs, labels)).count() == 0


def test_word_tests_equal_the_formula(spark):
    rng = random.Random(3)
    rows_ = [(f"w{i}".encode(), rng.randrange(40), rng.randrange(400)) for i in range(300)]
    got = toxicity.telling_words(spark.createDataFrame(rows_, "word binary, t long, c long"), 50, 900, strength=50.0, least_z=2.0, least_odds=0.5)
    odds, z = toxicity.log_odds(np.array([r[1] for r in rows_], float), np.array([r[2] for r in rows_], float), 50, 900, 50.0)
    want = {w: o for (w, *_), o, z_ in zip(rows_, odds, z, strict=True) if abs(z_) >= 2 and abs(o) >= 0.5}
    assert got.keys() == want.keys() and len(want) > 50 and all(got[w] == pytest.approx(want[w]) for w in want)


def test_segment_search_takes_linear_time():
    spent = []
    for n in (50_000, 200_000):
        scores = [(i, 1.0 if i % 2 else -2.0) for i in range(n)]
        t = time.process_time()
        toxicity.maximal_segments(scores, -0.05)
        spent.append(time.process_time() - t)
    assert spent[1] < 9 * spent[0] + 0.3


@pytest.mark.parametrize(("column", "folder"), [("quality", "/root/testdata/sf0.1"), ("toxic", "/root/testdata/sf0.1"), ("quality", "/root/testdata/sf0.01")])
def test_held_out_rows_of_the_tables(spark, column, folder):
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    from settlematch.llm import queries

    query = {"quality": queries.op3_nearest_neighbour_quality, "toxic": queries.op7_toxic_segments}[column]
    got = query(spark, folder)
    assert dict(got.dtypes) | {"held_out": "boolean", "score": "double", "predicted": "int"} == dict(got.dtypes)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    both = [(r["predicted"], r[column]) for r in got.where("held_out").join(labels, "doc_id").where(f"{column} is not null").collect()]
    rare = 0 if column == "quality" else 1
    hits = [p == y for p, y in both if y == rare]
    assert sum(p == y for p, y in both) / len(both) > 0.97 and sum(hits) / len(hits) > 0.85


def test_votes_equal_brute_force(spark):
    """Scores again from trigram counts and cosines taken one by one."""
    docs, labels = corpus(spark, 80)
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        text = (r["text"] or "").encode()
        shape = re.sub(r"\s", lambda m: m.group() if m.group() == "\n" else " ", re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", text.decode().encode("ascii", "ignore").decode()))))
        shape = re.sub(r"(.)\1+", r"\1", shape, flags=re.DOTALL).encode()
        counts = np.zeros(quality.DIMS + quality.SHAPES)
        for signs, shift, first in ((text, 21, 0), (shape, 24, quality.DIMS)):
            for a, b, c in zip(signs, signs[1:], signs[2:], strict=False):
                a, b, c = (48 if 48 <= x <= 57 else x for x in (a, b, c))
                counts[first + (((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> shift)] += 1
        z = quality.terms(counts[None].astype(np.float32), model.idf)[0].astype(float) @ model.axes.astype(float)
        size = math.sqrt(sum(z * z))
        cosines = [sum(float(p) * float(q) for p, q in zip(z, v, strict=True)) / size if size else 0.0 for v in model.vectors]
        limit = sorted(cosines, reverse=True)[: model.near][-1]
        near = [(max(c, 0.0) ** model.sharpness * m, y) for c, m, y in zip(cosines, model.mass, model.votes, strict=True) if c >= limit - 1e-7]
        weight = sum(w for w, _ in near)
        assert got[r["doc_id"]] == pytest.approx(sum(w * y for w, y in near) / weight if weight else model.prior, abs=2e-3)


def test_long_texts_are_counted_in_chunks(monkeypatch):
    texts = [b"abcdefgh" * 50, b"", b"xy", b"0123 abc" * 9, b"q" * 333]
    whole = quality.trigram_counts(texts)
    monkeypatch.setattr(quality, "CHUNK", 64)
    assert (quality.trigram_counts(texts) == whole).all() and whole[0].sum() == 398


def test_segments_are_the_maximal_ones():
    rng = random.Random(11)
    for _ in range(400):
        values = [float(rng.choice([-4, -2, -1, 1, 2, 5])) for _ in range(rng.randrange(1, 14))]
        got = [(s, e) for s, e, _ in toxicity.maximal_segments(list(enumerate(values)), -1.0)]
        assert got == split(values, 0, len(values))


def split(values, lo, hi):
    """By definition: the best segment (shortest, then first, of equals), and the same on either side."""
    best, cut = 0.0, None
    for s in range(lo, hi):
        total = 0.0
        for e in range(s + 1, hi + 1):
            total += values[e - 1]
            if total > best + 1e-12 or (cut and abs(total - best) <= 1e-12 and e - s < cut[1] - cut[0]):
                best, cut = max(total, best), (s, e)
    return [*split(values, lo, cut[0]), cut, *split(values, cut[1], hi)] if cut else []


# --- segmentations ---

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def every_segmentation(v, word):
    """(ids, score) of all ways to cut one word, listed by recursion over the vocabulary."""
    if not word:
        return [((), 0.0)]
    out = []
    for n in range(1, len(word) + 1):
        if word[:n] in v.ids:
            k = v.ids[word[:n]]
            out += [((k, *ids), v.score(k) + s) for ids, s in every_segmentation(v, word[n:])]
    if word[0] not in v.ids:
        spelled = [v.bytes[b] for b in word[0].encode()]
        out += [((*spelled, *ids), sum(map(v.score, spelled)) + s) for ids, s in every_segmentation(v, word[1:])]
    return out


def test_samples_follow_the_distribution():
    v, n = segmentations.Vocabulary(MODEL), 8000
    paths = {a + b: s + t for a, s in every_segmentation(v, "\u2581ab") for b, t in every_segmentation(v, "\u2581cd")}
    total = math.log(sum(map(math.exp, paths.values())))
    first, weight = Counter(), Counter()
    for drawn, threshold in segmentations.draw(v, ["ab cd"] * n, list(range(n)), 3):
        assert len({tuple(i) for _, i in drawn}) == len(drawn)
        first[tuple(drawn[0][1].tolist())] += 1
        for p, i in drawn:
            assert p == pytest.approx(paths[tuple(i.tolist())] - total)
            weight[tuple(i.tolist())] += math.exp(p) / segmentations.inclusion(p, threshold) / n
    for ids, s in paths.items():
        p = math.exp(s - total)
        assert first[ids] / n == pytest.approx(p, abs=4.5 * math.sqrt(p / n) + 1e-4)
        assert p < 0.02 or weight[ids] == pytest.approx(p, rel=0.1)
    assert sum(weight.values()) == pytest.approx(1, abs=0.03)
    every, threshold = segmentations.draw(v, ["ab cd"], [1], 1000)[0]
    assert threshold == -math.inf and {tuple(i.tolist()) for _, i in every} == set(paths)


def test_draws_do_not_depend_on_the_block():
    v = segmentations.Vocabulary(MODEL)
    text = "the quick\n  brown\u2581fox \ue581 " + "y" * 300
    drawn, threshold = segmentations.draw(v, [text], [5], 3)[0]
    again, limit = segmentations.draw(v, ["other words here", "", text, "x"], [1, 2, 5, 3], 3)[2]
    assert [i.tolist() for _, i in drawn] == [i.tolist() for _, i in again] and threshold == pytest.approx(limit)
    assert all(segmentations.decode(v, i) == text for _, i in drawn)


def test_words_are_numbered_in_order():
    texts = ["a bc a", "", " a", "bc  bc", "x\ny z", "   ", "\u2581 a", "bc a "]
    words, count, distinct = segmentations._numbered(texts)
    assert [distinct[i] for i in words] == ["a", "bc", "a", " a", "bc", " bc", "x\ny", "z", "   ", "\u2581", "a", "bc", "a", ""]  # all but the first word of a text begin with one more space
    assert count.tolist() == [3, 0, 1, 2, 2, 1, 2, 3] and len(set(distinct)) == len(distinct)
    assert segmentations._numbered([""])[1].tolist() == [0]


def test_segmentations_decode(spark):
    texts = [r[1] for r in rows(n=40)] + ["a▁b", "  two  spaces ", "\n", "日本語", "\ue581", " ", "   "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "conv_id long, text string")
    got = segmentations.sample_segmentations(df, MODEL, ["conv_id"]).collect()
    assert all(r["decodes"] for r in got) and {r["conv_id"] for r in got} == set(range(len(texts)))
    again = segmentations.sample_segmentations(df.repartition(3), MODEL, ["conv_id"]).collect()
    assert sorted(got) == sorted(again)
    assert segmentations.sample_segmentations(df.where("false"), MODEL, ["conv_id"]).count() == 0


def test_segmentation_query_covers_documents(spark):
    from settlematch.llm import queries

    folder = "/root/testdata/sf0.001"
    got = queries.op6_gumbel_segmentations(spark, folder).collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r["doc_id"] for r in got if r["sample"] == 0} == ids and all(r["decodes"] for r in got)


# --- pages ---

PAGE = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a>Home</a></nav><div class='ad'>Buy</div><article><h1>Head &amp; line</h1><p>One\n two<br>three<p><b>Four <i>five</i></p><ul><li>a<li>b</ul><form>sign up</form><div class='comments'><p>first!</p></div></article><aside>More</aside><footer>&copy; x</footer></body></html>"


def test_main_text_of_a_page():
    assert sitetree.main_text(PAGE) == "Head & line\nOne two three\nFour five\na\nb"


def test_site_furniture_is_found_without_names(spark):
    rng = random.Random(12)
    pages = [(i, f"http://h.example/{i}", f"<body><div class=x1><span>Shop</span> <span>Blog</span></div><div class=x2><p>{rng.random()} words</p><p>{rng.random()} more</p></div></body>") for i in range(30)]
    pages += [(100, None, None), (101, "nonsense", ""), (102, "http://", "<p>a < b & c <"), (103, "http://once.example", PAGE), (103, "http://once.example", PAGE)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for limit in (1 << 20, -1):  # both ways to send the removal lists
        got = {r["page_id"]: r["text"] for r in sitetree.extract(df, broadcast_bytes=limit).collect()}
        assert all("Shop" not in got[i] and got[i].count("\n") == 1 for i in range(30))
        assert got[100] == got[101] == "" and got[102] == "a < b & c <" and got[103].startswith("Head & line")
    assert sitetree.extract(df.where("false")).count() == 0


def test_tree_alone_clears_neutral_pages(spark):
    """Menus and notices in elements without telling names go, what differs stays."""
    rng = random.Random(5)
    menu = "".join(f"<div class=k{i}><b>Entry {i}</b></div>" for i in range(6))
    pages = [(i, f"http://n.example/{i}", f"<body><div class=a1>{menu}</div><div class=a2><div class=a3>Story {rng.random()}</div><div class=a3>More {rng.random()}</div><div class=a5>All rights kept</div></div><div class=a4>We use small files</div></body>") for i in range(25)]
    got = sitetree.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(len(r["text"].split("\n")) == 2 and r["text"].startswith("Story") and "More" in r["text"] for r in got)


def test_importance_equals_brute_force(spark):
    rng = random.Random(6)
    pages = []
    for i in range(12):
        items = "".join(f"<i>{rng.choice('abc')}</i>" if rng.random() < 0.5 else "<b>x</b>" for _ in range(rng.randrange(1, 4)))
        pages.append((i, "http://b.example/", f"<body><div>{items}</div><p>{rng.choice(['one', 'two', str(i)])}</p><u>{i}</u></body>"))
    got = {(r["depth"], r["name"]): (r["pages"], r["importance"]) for r in sitetree.importance(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}

    # nodes by path: per page the set of layouts and the set of texts
    facts = {}
    for i, _, page in pages:
        body = re.search("<body>(.*)</body>", page)[1]
        inner = re.search("<div>(.*)</div>", body)[1]
        nodes = [("body",), ["div", "p", "u"], ""], [("body", "div"), re.findall("<([ib])>", inner), ""], [("body", "p"), [], re.search("<p>(.*)</p>", body)[1]], [("body", "u"), [], str(i)]
        nodes = [*nodes, *[[("body", "div", t), [], x] for t, x in re.findall("<([ib])>(.*?)</", inner)]]
        for path, children, text in nodes:
            f = facts.setdefault(path, {"pages": set(), "layouts": set(), "texts": set()})
            f["pages"].add(i)
            f["layouts"].add((i, tuple(c for k, c in enumerate(children) if not k or c != children[k - 1])))
            if text:
                f["texts"].add((i, text))
    value = {}
    for path in sorted(facts, key=lambda p: -len(p)):
        f = facts[path]
        n = len(f["pages"])
        if n < 2:
            continue
        layouts = Counter(x for _, x in f["layouts"])
        total = sum(layouts.values())
        layout = -sum(c / total * math.log(c / total, n) for c in layouts.values())
        parts = [(len(facts[q]["pages"]), value.get(q, 1.0)) for q in facts if q[:-1] == path]
        if f["texts"]:
            texts = Counter(x for _, x in f["texts"])
            parts.append((n, 1 - sum(math.log(c, n) for c in texts.values()) / len(texts)))
        share = 0.9 ** len(layouts) if parts else 1.0
        inner = sum(w * v for w, v in parts) / sum(w for w, _ in parts) if parts else 0.0
        value[path] = min(max((1 - share) * inner + share * max(layout, inner if parts else 0.0), 0.0), 1.0)
    assert len(value) >= 5
    for path, v in value.items():
        assert got[(len(path), path[-1])] == (len(facts[path]["pages"]), pytest.approx(v))


def test_hostile_pages_take_linear_time():
    shapes = ["<a ", "<div>", "<a '", "<a '>", "<!", "<!-- ", "<script>", "<p>x", "<b><p>", "</a ", "<ul><li>", "<b></i>"]
    for unit in shapes:
        spent = []
        for n in (50_000, 200_000):
            page = unit * (n // len(unit))
            t = time.process_time()
            sitetree.main_text(page)
            sitetree.observations(page)
            spent.append(time.process_time() - t)
        assert spent[1] < 9 * spent[0] + 0.5, (unit, spent)


def test_copies_are_no_template(spark):
    pages = [(i, f"http://c.example/{i}", f"<body><div class=x1>Text of article {i % 2} in many copies.</div><div class=x2 id=post-{i}><p>end {i % 2}</p></div></body>") for i in range(100)]
    df = spark.createDataFrame([*pages, *[(200 + i, "http://two.example/", "<div>same</div>") for i in range(2)]], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in sitetree.extract(df).collect()}
    assert all(got[i] == f"Text of article {i % 2} in many copies.\nend {i % 2}" for i in range(100))
    assert got[200] == got[201] == "same"


def test_paths_of_one_page_are_folded(spark):
    pages = [(i, f"http://f.example/{i}", f"<body><div>Shop</div><div id=post-{i}><p>words {i}</p></div></body>") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {(r["depth"], r["name"]) for r in sitetree.importance(df).collect()} == {(1, "body"), (2, "div")}
    assert {r["text"] for r in sitetree.extract(df).collect()} == {f"words {i}" for i in range(40)}


def test_importance_decides_inside_and_outside_articles(spark):
    def page(i):
        return f"<body><div class=z1>{'Shop Blog'}</div><div class=z2>lead {i} of the story</div><article><div class=q7>Sign here for offers</div><p>body {i}</p></article></body>"

    pages = [(i, f"http://t.example/{i}", page(i)) for i in range(40)]
    pages += [(100, "http://one.example/", page(100))]  # without statistics the tags decide
    pages += [(200 + i, f"http://alike.example/{i}", f"<body><div role=main><p>all the same</p></div><footer>{i}</footer><i hidden>{i}</i></body>") for i in range(20)]
    pages += [(300 + i, f"http://near.example/{i}", f"<body><main><p>all the same</p><b>{'x' * (i > 18)}</b></main></body>") for i in range(20)]
    pages += [(400 + i, f"http://role.example/{i}", f"<body><div role=main><div>Sign here</div><p>body {i}</p></div></body>") for i in range(40)]
    got = {r["page_id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"lead {i} of the story\nbody {i}" for i in range(40))
    assert got[100] == "Sign here for offers\nbody 100"
    assert {got[i] for i in range(200, 220)} == {"all the same"} and got[300] == "all the same"
    assert all(got[400 + i] == f"body {i}" for i in range(40))
