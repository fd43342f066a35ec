"""Best-fit packing of token sequences by large-item matching, done on the histogram of lengths.

Lengths are small integers, so packing is decided on *how many* pieces have each length: the
driver works on at most ``capacity`` counts whatever the corpus. Pieces above a third of the
capacity fit at most twice in a bin: they are paired greedily, the longest with the longest
partner that fits. Shorter pieces then fill, longest first, the tightest gap that takes them.
Bins of equal content form one class with a multiplicity; pieces find their bin by their rank
among the pieces of their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from settlematch.llm.common import byte_blocks, record_batch
from settlematch.storage import written

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all full but the first, which may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))] if n > capacity else [(0, n)]


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Classes of bins, each (multiplicity, [(length, pieces of that length in one bin), ...])."""
    left = {size: n for size, n in counts.items() if n > 0}
    third = capacity // 3
    # (content, multiplicity) of the open bins, by gap
    gaps: dict[int, list[tuple[list, int]]] = {}

    def put(content: list, n: int) -> None:
        if n:
            gaps.setdefault(capacity - sum(s * q for s, q in content), []).append((content, n))

    large = sorted((s for s in left if s > third), reverse=True)
    for size in large:
        while n := left[size]:
            fits = [s for s in large if s <= min(size, capacity - size) and left[s] >= (2 if s == size else 1)]
            if not fits:
                put([(size, 1)], n)
                left[size] = 0
                break
            mate = fits[0]
            pairs = n // 2 if mate == size else min(n, left[mate])
            put([(size, 2)] if mate == size else [(size, 1), (mate, 1)], pairs)
            left[size] -= pairs
            left[mate] -= pairs
    for size in sorted((s for s in left if s <= third), reverse=True):
        n = left[size]
        while n:
            gap = min((g for g in gaps if g >= size), default=None)
            if gap is None:
                each = capacity // size
                put([(size, each)], n // each)
                if n % each:
                    put([(size, n % each)], 1)
                break
            each = gap // size  # the bin just filled has the tightest gap until it takes no more
            content, bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            full = min(bins, n // each)
            put([*content, (size, each)], full)
            n -= full * each
            rest = bins - full
            if rest and n:
                put([*content, (size, n)], 1)
                rest, n = rest - 1, 0
            put(content, rest)
    return [(n, content) for gap in sorted(gaps) for content, n in gaps[gap]]


def token_pieces(documents: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece of every document's ids: start, length and crc32 of the ids.

    tokenizer: path of the byte-level BPE file; ``end_id`` closes every document. Null texts are
    empty. Only these small rows leave the task that reads the text.
    """

    def run(batches):
        encode = encoder(tokenizer)
        for batch in byte_blocks(batches):
            out = {name: [] for name in PIECES.names}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    for name, value in zip(PIECES.names, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        out[name].append(value)
            yield record_batch(PIECES, out)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """text -> ids of the tokenizer file at ``path``.

    The file's merges run in tiktoken, about four times as fast; a text that names a special
    token, or that tiktoken refuses, goes to the tokenizers library itself. The two agree
    (``tests/llm/test_small_operators.py``).
    """
    if path not in _ENCODERS:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        specials = [t["content"] for t in spec["added_tokens"]]
        decode = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(decode[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in specials}
        fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            if any(s in text for s in specials):
                return slow.encode(text, add_special_tokens=False).ids
            try:
                return fast.encode_ordinary(text)
            except Exception:  # its regex engine gives up on some very long runs
                return slow.encode(text, add_special_tokens=False).ids

        _ENCODERS[path] = encode
    return _ENCODERS[path]


#: Fixed value: how the byte-level BPE file splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level BPE files."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def pack(pieces: DataFrame, capacity: int, *, each: int = 500_000) -> DataFrame:
    """``pieces`` (needs ``doc_id``, ``piece``, ``length``) with ``sequence_id`` and ``offset``.

    each: the ranking within one length is cut into hash lanes of at most about so many pieces, and
    into up to 64 where there are fewer; no length is one task. The driver sees ``capacity`` counts;
    the plan sent back has at most a few rows per length and class, and the lanes' table one row
    for each ``each`` pieces beside 64 x ``capacity``.
    Empty input gives an empty result; repeated rows are packed one by one. A piece longer than
    the capacity, or without a positive length, is an error. Columns of ``pieces`` that are named
    sequence_id or offset, in any case, are replaced.
    """
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    spark = pieces.sparkSession
    fits = F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(F.raise_error(F.concat(F.lit("no piece of this length fits: "), F.coalesce(F.col("length").cast("string"), F.lit("null")))).cast("long"))
    # other columns travel in one struct, so that no name of theirs can be one of the names used here
    other = [c for c in names if c.lower() not in ("doc_id", "piece", "length")]
    pieces = written(pieces.select("doc_id", "piece", fits.alias("length"), *([F.struct(*other).alias("_row")] if other else [])))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lanes = F.broadcast(spark.createDataFrame([(size, n // each + min(n // 64, 63) + 1) for size, n in counts.items()], "length long, _lanes long"))  # at most capacity rows
    pieces = pieces.join(lanes, "length").withColumn("_lane", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_lanes")))
    by_lane = pieces.groupBy("length", "_lane").agg(F.count("*").alias("_n"))
    rows, base, taken = [], 0, dict.fromkeys(counts, 0)
    for bins, content in plan_bins(counts, capacity):
        offset = 0
        for size, per_bin in content:
            rows.append((size, taken[size], taken[size] + bins * per_bin, base, per_bin, offset))
            taken[size] += bins * per_bin
            offset += size * per_bin
        base += bins
    plan = F.broadcast(spark.createDataFrame(rows, "length long, _from long, _to long, _base long, _each long, _offset long"))
    before = Window.partitionBy("length").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(by_lane.select("length", "_lane", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = F.row_number().over(Window.partitionBy("length", "_lane").orderBy("doc_id", "piece"))
    ranked = pieces.withColumn("_in", inside).join(starts, ["length", "_lane"]).withColumn("_rank", F.col("_before") + F.col("_in") - 1)
    placed = ranked.join(plan, "length").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from")
    return placed.select(*[F.col(f"_row.`{c}`") if c in other else F.col(c).alias(c) for c in names], F.expr("_base + (_rank - _from) div _each").alias("sequence_id"), (F.col("_offset") + (nth % F.col("_each")) * F.col("length")).cast("long").alias("offset"))
