"""The registered queries, types and values, against plain rules on the smallest tables."""

import hashlib
import math
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from settlematch.llm import pii, queries, segmentations

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name, types):
    df = queries.QUERIES[name](spark, SF)
    assert df.dtypes[: len(types)] == types, df.dtypes
    return df.collect()


def whole(rows, documents):
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    return rows


def test_shards(spark, documents):
    rows = whole(result(spark, "op1_hypergeometric_shards", [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]), documents)
    slots = defaultdict(list)
    for r in rows:
        data = documents[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def frames_of(media):
    """Lengths of the Layer III frames by the header's own arithmetic, up to the end of the stream."""
    rate = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    assert media[:3] == b"ID3"  # a tag whose size has seven bits a byte
    at, out = 10 + sum(b << 7 * (3 - i) for i, b in enumerate(media[6:10])), []
    while at < len(media):
        head = int.from_bytes(media[at : at + 4], "big")
        assert head >> 21 == 0x7FF and head >> 19 & 3 == 3 and head >> 17 & 3 == 1 and head >> 10 & 3 == 1  # MPEG 1, Layer III, 48 kHz
        size = 144 * rate[head >> 12 & 15] * 1000 // 48000 + (head >> 9 & 1)
        out.append((at, size))
        at += size
    assert at == len(media)
    return out


def test_media(spark, documents):
    from settlematch.llm import mpeg

    rows = whole(result(spark, "op2_mpeg_audio", [("doc_id", "bigint"), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")]), documents)
    stored = {r["doc_id"]: bytes(r["media"]) for r in mpeg.store_text(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "media").collect()}
    same = defaultdict(set)
    for r in rows:
        data = documents[r["doc_id"]].encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        media = stored[r["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert len(frames_of(media)) - len(payload) // 192 in (0, 1)  # and a frame for the table of places
        same[data].add(repr(tuple(r)[1:]))
    assert all(len(v) == 1 for v in same.values())


@pytest.mark.parametrize(("name", "least"), [("op3_nearest_neighbour_quality", 0.3), ("op7_toxic_segments", 0.5)])
def test_scores(spark, documents, name, least):
    for r in whole(result(spark, name, [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]), documents):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= least)


def test_fingerprints(spark, documents):
    rows = whole(result(spark, "op4_iblt_fingerprints", [("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]), documents)
    ids, same = sorted(documents), defaultdict(set)
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    for r in rows:
        text, other = documents[r["doc_id"]], documents[after[r["doc_id"]]]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and (r["near_next"] == 1 or text != other)
        same[text].add(r["fingerprint"])
        same[edited].add(r["edited_fingerprint"])
    assert all(len(v) == 1 for v in same.values())


def test_jaccard(spark, documents):
    rows = whole(result(spark, "op5_ngram_jaccard", [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]), documents)
    sets = {}
    for i, text in documents.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        sets[i] = {tuple(words[k : k + 4]) for k in range(max(len(words) - 3, 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows} == {(i, len(s), find(i)) for i, s in sets.items()}


def test_segmentations(spark, documents):
    rows = result(spark, "op6_gumbel_segmentations", [("doc_id", "bigint"), ("sample", "int"), ("n_pieces", "bigint"), ("ids_sha256", "string"), ("log_prob", "double"), ("inclusion", "double"), ("log_inclusion", "double"), ("decodes", "boolean")])
    by = defaultdict(list)
    for r in rows:
        assert r["decodes"] and r["log_prob"] <= 0 and r["log_inclusion"] <= 0 and math.isfinite(r["log_inclusion"])
        assert r["inclusion"] == pytest.approx(math.exp(r["log_inclusion"]), abs=1e-300)
        by[r["doc_id"]].append((r["sample"], r["ids_sha256"]))
    assert by.keys() == documents.keys()
    assert all(len({h for _, h in v}) == len(v) and sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())


def test_inclusion_of_unlikely_paths():
    for above in (-900.0, -40.0, -36.5, -35.5, -1.0, 0.0, 5.0):
        assert segmentations.log_inclusion(above, 0.0) == pytest.approx(math.log(-math.expm1(-math.exp(above))) if above > -700 else above, rel=1e-9, abs=1e-12)
    assert segmentations.log_inclusion(-5.0, -math.inf) == 0.0


def test_pages(spark):
    rows = result(spark, "op8_site_style_tree", [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")])
    pages = {(r["page_id"], r["url"]) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    assert {(r["page_id"], r["url"]) for r in rows} == pages
    for r in rows:
        blocks = r["text"].split("\n")
        assert r["n_chars"] == len(r["text"]) and (not r["text"] or all(b and b == " ".join(b.split(" ")).strip() for b in blocks))


def test_packing(spark, documents):
    rows = result(spark, "op9_large_item_packing", [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")])
    tokenizer, by, bins = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by.keys() == documents.keys()
    for i, text in documents.items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part.tobytes()))
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == len(ids)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.02 * sum(r["length"] for r in rows) / 1024 + 2


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    """The contract's four patterns as they stand."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(s, ("email", "ip", "card", "phone")[k], e) for s, k, e in sorted(found)]


def test_personal_data(spark, documents):
    rows = whole(result(spark, "op10_pii_deobfuscation", [("doc_id", "bigint"), ("n_email", "bigint"), ("n_ip", "bigint"), ("n_card", "bigint"), ("n_phone", "bigint"), ("base_sha256", "string"), ("spans", "string")]), documents)
    for r in rows:
        base = [f"{k}:{s}:{e}" for s, k, e in plain_spans(documents[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x.startswith(k) for x in r["spans"].split(",")) for k in ("email", "ip", "card", "phone")]


def test_addresses_with_many_zeros():
    for text in ("000000000000000000000001.1.1.1", "a 1.2.00000000000000000000000255.4 b", "1.1.1.00000000000000000000000256", "0000.0.0.0", "1.1.1.9999999999999999999999999"):
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == want
