"""Exact Jaccard self-join on word n-grams, returned as connected components.

1. Equal sets become one representative, so copies never meet.
2. Sets with the same smallest hash are compared first, in tiles of bounded size that share the
   group's first member. Nearly all links of a group of near copies show up here, in linear work.
3. What that left apart is found by a prefix filter, which misses nothing: two sets of the wanted
   similarity share one of their first few hashes in any fixed order. (The order puts hashes that
   are frequent in a sample of documents last; it decides the work, never the result.) Groups
   whose members are already connected drop out. The others are cut into size bands, and bands
   into tiles; a pair of tiles is compared only if its sizes can match. Hashed bitmaps bound the
   overlap from above by bit counts, and pairs that pass are verified on the whole sorted sets.

Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlematch.llm.common import byte_blocks, record_batch
from settlematch.operators.components import components
from settlematch.storage import discard, written

TILE = 1024
#: Pairs of bands with no more sets than this give their pairs outright, without bitmaps.
FEW = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a finaliser of xor-shifts and odd products)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``width``-word shingles; A-Z count as a-z, words end at ASCII space.

    A text of fewer words is one shingle; one without words has none.
    """
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space are meant
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        out = _mix(out + _STEP) + h[i : len(h) - width + 1 + i]
    return np.unique(_mix(out))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """One bit per hash in 64 x 2^k bits, at least eight for each hash, so that few fall together."""
    words = 1 << max(0, math.ceil(math.log2(max(len(hashes), 8) / 8)))
    out = np.zeros(words, np.uint64)
    at = hashes % np.uint64(words * 64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def prefix_length(n: int, num: int, den: int) -> int:
    """Of a set of ``n``: whoever reaches num/den shares one of the first so many hashes."""
    return n - -(-num * n // den) + 1


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("low", pa.int64()), ("prefix", pa.list_(pa.int64())), ("bits", pa.binary())])
_SETS_SQL = "doc_id long, n int, set_a long, set_b long, low long, prefix array<long>, bits binary"


def describe(documents: DataFrame, width: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """Size, 128-bit digest, smallest hash, prefix and bitmap of every document's set."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        common = shared.value
        for batch in byte_blocks(batches):
            out = {name: [] for name in _SETS.names}
            for text in batch.column("text").to_pylist():
                h = shingles(text, width)
                n = len(h)
                hot = np.zeros(n, bool)
                if len(common) and n:
                    hot = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
                first = np.concatenate([h[~hot], h[hot]])[: prefix_length(n, num, den) if n else 0]
                out["n"].append(n)
                out["set_a"].append(int(h.sum(dtype=np.uint64).view(np.int64)) if n else 0)
                out["set_b"].append(int(np.bitwise_xor.reduce(_mix(h + _STEP)).view(np.int64)) if n else 0)
                out["low"].append(int(h[:1].view(np.int64)[0]) if n else 0)
                out["prefix"].append(first.view(np.int64))
                out["bits"].append(bitmap(h).tobytes() if n else b"")
            yield record_batch(_SETS, out | {"doc_id": batch.column("doc_id")})

    return documents.select("doc_id", "text").mapInArrow(run, _SETS_SQL)


def frequent_shingles(documents: DataFrame, width: int, *, docs: int = 20_000, least: int = 8, most: int = 65_536) -> np.ndarray:
    """Sorted hashes found in at least ``least`` of about ``docs`` documents picked by a hash of the id (at most ``most``).

    Only the order of the prefix filter depends on it.
    """
    every = max(1, documents.count() // docs)
    picked = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def run(batches):
        for batch in byte_blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([shingles(t, width).view(np.int64) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))], names=["h"])

    seen = picked.select("text").mapInArrow(run, "h array<long>").select(F.explode("h").alias("h")).groupBy("h").count().where(F.col("count") >= least)
    rows = seen.orderBy(F.desc("count"), "h").limit(most).collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


def _hashes_of(documents: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``id`` and its whole sorted set, for the ids asked for; repeated rows repeat, which adds no link."""
    schema = pa.schema([("id", pa.int64()), ("hashes", pa.binary())])

    def run(batches):
        for batch in byte_blocks(batches):
            yield record_batch(schema, {"id": batch.column("doc_id"), "hashes": [shingles(t, width).tobytes() for t in batch.column("text").to_pylist()]})

    wanted = documents.select("doc_id", "text").join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return wanted.mapInArrow(run, "id long, hashes binary")


def _least_overlap(x, y, num: int, den: int):
    """Smallest overlap with which sets of these sizes reach num/den."""
    return -(-num * (x + y) // (num + den))


class _Tile:
    """The sets of one tile in order of size, their bitmaps, and what is known to be connected."""

    def __init__(self, sizes, bits, num: int, den: int):
        self.n = np.array(sizes, np.int64)
        self.bits = [np.frombuffer(b, np.uint64) for b in bits]
        self.num, self.den = num, den
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        widths = np.array([len(b) for b in self.bits])
        for w in np.unique(widths):
            rows = np.flatnonzero(widths == w)
            self.by_width[int(w)] = (rows, np.stack([self.bits[i] for i in rows]))

    def partners(self, i: int, until: int) -> np.ndarray:
        """Rows after ``i`` and before ``until`` whose overlap with it may be large enough."""
        mine, n, found = self.bits[i], self.n[i], []
        for w in (len(mine), 2 * len(mine)):  # sizes that can match need no more than twice the bits
            if w not in self.by_width:
                continue
            rows, bits = self.by_width[w]
            lo, hi = np.searchsorted(rows, i + 1), np.searchsorted(rows, until)
            if lo == hi:
                continue
            rows, other = rows[lo:hi], bits[lo:hi]
            if w > len(mine):
                other = other[:, : len(mine)] | other[:, len(mine) :]
            over_i = n - np.bitwise_count(mine & ~other).sum(axis=1, dtype=np.int64)
            over_j = self.n[rows] - np.bitwise_count(other & ~mine).sum(axis=1, dtype=np.int64)
            found.append(rows[np.minimum(over_i, over_j) >= _least_overlap(n, self.n[rows], self.num, self.den)])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    o = _overlap(x, y)
    return den * o >= num * (len(x) + len(y) - o)


def _runs(batches, column: str):
    """Tables of the rows with one value of ``column``, from batches sorted by it; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(column)[0].as_py() != values[lo]:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _dealt(rows: DataFrame, *group: str) -> DataFrame:
    """``rows`` with the rows of a group side by side, in order of size; groups are bounded by TILE."""
    rows = rows.withColumn("group", F.xxhash64(*group))
    return rows.repartition("group").sortWithinPartitions("group", "n", "id")


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return record_batch(_EDGES, {"a": [x for x, _ in edges], "b": [x for _, x in edges]})


def _first_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links that join what is not joined yet, within each tile; exact."""

    def run(batches):
        edges = []
        for table in _runs(batches, "group"):
            if table.num_rows < 2:
                continue
            ids = table["id"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
            tile = _Tile([len(s) for s in sets], [bitmap(s).tobytes() for s in sets], num, den)
            root = np.arange(len(ids))
            reach = np.searchsorted(tile.n, tile.n * den // num, side="right")
            for i in range(len(ids)):
                if (root[i + 1 : reach[i]] == root[i]).all():
                    continue
                for j in tile.partners(i, reach[i]).tolist():
                    if root[j] != root[i] and _linked(sets[i], sets[j], num, den):
                        edges.append((ids[i], ids[j]))
                        root[root == root[j]] = root[i]
            if len(edges) > 50_000:
                yield _edge_batch(edges)
                edges = []
        yield _edge_batch(edges)

    return _dealt(rows, "key", "tile").select("group", "id", "hashes").mapInArrow(run, "a long, b long")


def _candidates(rows: DataFrame, num: int, den: int, with_bits: bool) -> DataFrame:
    """Pairs of unconnected sets of one pair of tiles that may have the wanted overlap.

    A pair whose first common hash stands at these places of its orders has at most the rest in
    common. With bits, the bitmaps' bound is taken too, and ``head``, what stands before the
    hash in each order, keeps a pair to the group of its first common hash.
    """

    def run(batches):
        out = []
        for table in _runs(batches, "group"):
            if table.num_rows < 2:
                continue
            n, ids, part, comp, pos = (table[c].to_numpy() for c in ("n", "id", "side", "comp", "pos"))
            n = n.astype(np.int64)
            reach = np.searchsorted(n, n * den // num, side="right")
            if (comp == comp[0]).all() or (reach <= np.arange(1, len(n) + 1)).all():
                continue
            tile, left = _Tile(n, table["bits"].to_pylist(), num, den) if with_bits else None, n - pos
            heads = [set(h) for h in table["head"].to_pylist()] if with_bits else []
            for i in range(len(ids)):
                if reach[i] <= i + 1:
                    continue
                js = tile.partners(i, reach[i]) if tile else np.arange(i + 1, reach[i])
                fits = np.minimum(left[i], left[js]) >= _least_overlap(n[i], n[js], num, den)
                js = js[fits & (comp[js] != comp[i]) & ((part[i] == 2) | (part[js] != part[i]))]
                out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in js.tolist() if not heads or heads[i].isdisjoint(heads[j])]
            if len(out) > 50_000:
                yield _edge_batch(out)
                out = []
        yield _edge_batch(out)

    columns = ["group", "id", "n", "side", "comp", "pos", *(["bits", "head"] if with_bits else [])]
    return _dealt(rows, "key", "tile_a", "tile_b").select(columns).mapInArrow(run, "a long, b long")


def _tile_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """``rows`` (key, id, n, ...) dealt to pairs of tiles of the same or neighbouring size bands.

    Bands grow by den/num, so sets that can match lie in one band or two neighbours. A band of
    more than TILE sets of one key is cut by a hash of the id. ``side`` is 2 in a pair of a tile
    with itself, where all pairs count, and 0 or 1 elsewhere, where only pairs across do.
    ``large`` tells pairs of bands with more than FEW sets.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9).cast("int")
    rows = rows.withColumn("band", band)
    cuts = rows.groupBy("key", "band").agg(F.count("*").alias("m")).withColumn("cuts", F.ceil(F.col("m") / TILE).cast("int"))
    near = cuts.select("key", F.explode(F.array(F.col("band"), F.col("band") + 1, F.col("band") - 1)).alias("band"), F.struct(F.col("band").alias("of"), "cuts", "m").alias("x"))
    # at most three bands each; one with nothing near it, and a lone row's own band, need no tile
    known = cuts.join(near.groupBy("key", "band").agg(F.collect_list("x").alias("x")), ["key", "band"])
    known = known.withColumn("x", F.filter("x", lambda x: (x["of"] != F.col("band")) | (F.col("m") > 1))).where(F.size("x") > 0).select("key", "band", F.col("cuts").alias("own"), "m", "x")
    rows = rows.join(known, ["key", "band"]).withColumn("cut", F.pmod(F.xxhash64("id"), F.col("own")).cast("int"))
    mine = F.struct("band", "cut")
    others = F.flatten(F.transform("x", lambda x: F.transform(F.sequence(F.lit(0), x["cuts"] - 1), lambda c: F.struct(F.struct(x["of"].alias("band"), c.alias("cut")).alias("tile"), (F.when(x["of"] == F.col("band"), F.col("m")).otherwise(F.col("m") + x["m"]) > FEW).alias("large")))))
    rows = rows.withColumn("me", mine).withColumn("other", F.explode(others))
    me, other = F.col("me"), F.col("other")["tile"]
    side = F.when(me == other, 2).when(me < other, 0).otherwise(1)
    return rows.select("key", "id", "n", "pos", "comp", side.alias("side"), F.least(me, other).alias("tile_a"), F.greatest(me, other).alias("tile_b"), F.col("other")["large"].alias("large"))


def jaccard_components(documents: DataFrame, *, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``documents``.

    Two documents link when den * overlap >= num * union of their ``width``-word shingle sets;
    component_id is the smallest doc_id reachable by links, the row's own included. Documents
    without words (null and empty texts too) link with nothing. Rows with a null doc_id get a
    null component. Rows that share an id are one node, which has the links of all their texts.
    """
    docs = documents.select("doc_id", "text")
    sets = written(describe(docs, width, num, den, frequent_shingles(docs, width)))
    several = sets.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("n", "set_a", "set_b")).alias("x"), F.max(F.struct("n", "set_a", "set_b")).alias("y")).where("x <> y").select("doc_id")
    several = written(several)
    if several.isEmpty():
        return _linked_components(docs, sets, width, num, den)
    # ids with several texts: each text is a node of its own first, and nodes of one id are joined afterwards
    flagged = docs.join(several.withColumn("several", F.lit(True)), "doc_id", "left")
    nodes = written(flagged.select("doc_id", "text", F.when(F.col("several"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("node")))
    by_node = nodes.select(F.col("node").alias("doc_id"), "text")
    sets = written(describe(by_node, width, num, den, frequent_shingles(by_node, width)))
    found = _linked_components(by_node, sets, width, num, den).withColumnRenamed("doc_id", "node").dropDuplicates(["node"])
    rows = written(nodes.select("doc_id", "node").join(found, "node", "left"))
    bound = components(rows.where("doc_id is not null").select(F.xxhash64(F.lit("id"), "doc_id").alias("a"), F.xxhash64(F.lit("of"), "component_id").alias("b")))
    rows = rows.withColumn("key", F.xxhash64(F.lit("id"), "doc_id")).join(bound.select(F.col("node").alias("key"), "component"), "key", "left")
    least = rows.where("doc_id is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = rows.where("doc_id is not null").drop("component_id").join(least, "component")
    null = nodes.where("doc_id is null").select("doc_id", "text")
    null = describe(null, width, num, den, np.zeros(0, np.uint64)).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return known.select("doc_id", "n_shingles", "component_id").unionByName(null)


def _linked_components(docs: DataFrame, sets: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The same for ids that have one text each; ``sets`` describes them."""
    full = sets.where("n > 0 and doc_id is not null")
    same = written(full.groupBy("n", "set_a", "set_b").agg(F.min("doc_id").alias("id")))
    unique = written(full.join(same.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "n", "low", "prefix", "bits"))
    slim = written(sets.select("doc_id", "n", "set_a", "set_b"))
    discard(sets)

    # groups of one smallest hash, in tiles that all hold the group's first member
    groups = unique.groupBy(F.col("low").alias("key")).agg(F.count("*").alias("m"), F.min("id").alias("lead")).where("m > 1")
    members = unique.select(F.col("low").alias("key"), "id", "n").join(groups, "key")
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    own = F.pmod(F.xxhash64("id"), tiles).cast("int")
    members = members.withColumn("tile", F.explode(F.when(F.col("id") == F.col("lead"), F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(own)))).select("key", "tile", "id", "n")
    members = written(members)
    first = written(_first_links(members.join(_hashes_of(docs, members.select("id").distinct(), width), "id"), num, den))
    discard(members)
    joined = written(components(first))

    # the prefix filter on what is still apart
    seen = unique.select("id", "n", F.posexplode("prefix").alias("pos", "key")).join(joined.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "n", "pos", "key", F.coalesce("component", "id").alias("comp"))
    seen = written(seen.join(seen.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "key", "left_semi"))
    tiled = written(_tile_pairs(seen, num, den))
    discard(seen)
    large = tiled.where("large").join(unique.select("id", "bits", "prefix"), "id").withColumn("head", F.slice("prefix", 1, F.col("pos"))).drop("prefix")
    large = _candidates(large, num, den, True)
    few = written(_candidates(tiled.where("not large"), num, den, False).distinct())

    def screen(batches):
        for batch in batches:
            ok = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "m")), strict=True):
                if n > m:
                    x, y, n, m = y, x, m, n
                ok.append(len(_Tile([n, m], [x, y], num, den).partners(0, 2)) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ends = [unique.select(F.col("id").alias(i), F.col("bits").alias(v), F.col("n").alias(c)) for i, v, c in (("a", "x", "n"), ("b", "y", "m"))]
    few = few.join(ends[0], "a").join(ends[1], "b").mapInArrow(screen, "a long, b long")
    pairs = written(large.unionByName(few).distinct())
    discard(tiled)
    discard(unique)
    whole = _hashes_of(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), width)
    whole = written(whole)
    both = pairs.join(whole.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(whole.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")

    def verify(batches):
        for batch in batches:
            ok = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    second = both.mapInArrow(verify, "a long, b long")
    last = components(first.unionByName(second))
    found = same.join(last.select(F.col("node").alias("id"), "component"), "id", "left").select("n", "set_a", "set_b", F.coalesce("component", "id").alias("component"))
    out = slim.join(found, ["n", "set_a", "set_b"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one_of_each(documents: DataFrame, *, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``documents`` without those that link, directly or through others, to one of a smaller doc_id.

    Rows of one id stay or go together; rows without an id stay.
    """
    found = jaccard_components(documents, width=width, num=num, den=den)
    extra = found.where("component_id < doc_id").select("doc_id")
    return documents.join(extra, "doc_id", "left_anti").select(documents.columns)
