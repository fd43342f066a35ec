"""Fill-in-the-middle transformation of texts, cut at lines that are counted by memoized chunks.

A rolling hash cuts the bytes of a text where their last 32 agree on it, so that a passage is cut
into the same chunks wherever it stands. A chunk's summary (characters, and the places behind its
line breaks) is made once and kept by the chunk's bytes: a repeated chunk is one that equals a
kept one byte for byte, never one that only has its hash. A text's lines are then the sum of its
chunks' counts, and a cut behind the k-th line lies in the chunk at which that sum reaches k.
Only a text's last line may have no break, and its end is the text's end.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# The three markers.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk: at least, at most, and on average about LEAST + 2 ** CUT_BITS.
LEAST, MOST, CUT_BITS = 256, 8192, 10
#: Steps of doubling of the rolling hash, which sees 2 ** DOUBLINGS bytes.
DOUBLINGS = 5
#: Bytes hashed at once.
STRETCH = 1 << 20
#: Bytes of chunks that a task remembers.
REMEMBERED = 16 << 20

_GEAR = np.random.default_rng(13).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Ascending places behind bytes at which the rolling hash asks for a cut."""
    seen, window = [], 1 << DOUBLINGS
    for at in range(0, len(data), STRETCH):
        begin = max(0, at - window + 1)
        h = _GEAR[data[begin : at + STRETCH]]
        for step in range(DOUBLINGS):  # sum over the last 2^k bytes, each weighted by two to its distance
            reach = 1 << step
            if len(h) > reach:
                h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
        found = np.flatnonzero(h[at - begin :] >> np.uint32(32 - CUT_BITS) == 0)
        seen.append(found + at + 1)
    return np.concatenate(seen) if seen else np.zeros(0, np.int64)


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks: the first cut place at least LEAST behind the chunk's start, or MOST behind it."""
    places, ends, at, n = cut_places(data), [], 0, len(data)
    while at < n:
        i = int(np.searchsorted(places, at + LEAST))
        at = min(int(places[i]) if i < len(places) else n, at + MOST, n)
        ends.append(at)
    return ends


@dataclass(slots=True)
class Summary:
    """What a chunk adds to a text: characters, and for each line break the bytes and the characters up to it."""

    chars: int
    bytes_at: np.ndarray
    chars_at: np.ndarray


def summary(chunk: bytes) -> Summary:
    """Characters are counted by their first bytes, so a character cut by a chunk's end counts once."""
    data = np.frombuffer(chunk, np.uint8)
    first = np.cumsum((data & 0xC0) != 0x80)
    breaks = np.flatnonzero(data == 10) + 1
    return Summary(int(first[-1]) if len(first) else 0, breaks, first[breaks - 1])


class Memo:
    """Summaries by the chunk's bytes; beyond ``room`` bytes of chunks those unused for longest go."""

    def __init__(self, room: int = REMEMBERED):
        self.kept: OrderedDict[bytes, Summary] = OrderedDict()
        self.room, self.held, self.hits, self.misses = room, 0, 0, 0

    def of(self, chunk: bytes) -> Summary:
        known = self.kept.get(chunk)  # a dictionary compares the bytes behind equal hashes
        if known is not None:
            self.hits += 1
            self.kept.move_to_end(chunk)
            return known
        self.misses += 1
        made = self.kept[chunk] = summary(chunk)
        self.held += len(chunk)
        while self.held > self.room and len(self.kept) > 1:
            self.held -= len(self.kept.popitem(last=False)[0])
        return made


class Lines:
    """Lines of a text by its chunks' summaries."""

    def __init__(self, data: bytes, memo: Memo):
        ends = chunk_ends(np.frombuffer(data, np.uint8))
        self.starts, self.size = [0, *ends][:-1], len(data)
        self.parts = [memo.of(data[a:b]) for a, b in zip(self.starts, ends, strict=True)]
        self.breaks = np.cumsum([0, *(len(p.bytes_at) for p in self.parts)])
        self.chars = np.cumsum([0, *(p.chars for p in self.parts)])
        self.count = int(self.breaks[-1]) + (1 if data and not data.endswith(b"\n") else 0)

    def end_of(self, k: int) -> tuple[int, int]:
        """Bytes and characters up to the end of the ``k``-th line; 0 lines end at 0."""
        if k == 0:
            return 0, 0
        if k > self.breaks[-1]:
            return self.size, int(self.chars[-1])
        i = int(np.searchsorted(self.breaks, k)) - 1
        at = k - int(self.breaks[i]) - 1
        return self.starts[i] + int(self.parts[i].bytes_at[at]), int(self.chars[i] + self.parts[i].chars_at[at])


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of a document: the first four groups of eight digits of sha256(seed:doc_id)."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: str, doc_id: int | None, memo: Memo, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    data = text.encode()
    lines = Lines(data, memo)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return lines.count, "plain", None, None, text
    (a, a_chars), (b, b_chars) = (lines.end_of(k) for k in sorted((h1 % (lines.count + 1), h2 % (lines.count + 1))))
    prefix, middle, suffix = (x.decode() for x in (data[:a], data[a:b], data[b:]))
    if h4 % 100 < spm:
        return lines.count, "spm", a_chars, b_chars - a_chars, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return lines.count, "psm", a_chars, b_chars - a_chars, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(documents: DataFrame, *, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """``documents`` with n (lines), form (plain, psm, spm), prefix_chars, middle_chars and output.

    rate: percentage of documents to transform; spm: percentage of those whose suffix comes first.
    A text that is empty or names a marker stays plain, and so does its output. Null texts count as
    empty and have an empty output; a null id counts as an id without digits. Repeated rows are transformed
    alike; the same text under another id is cut elsewhere. Columns of ``documents`` named like
    one of those added, in any case, are replaced, all others kept.
    """
    added = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]
    names = [c for c in documents.columns if c.lower() not in {f.name for f in added}]
    rows = documents.select(*names)
    schema = StructType([*rows.schema.fields, *added])

    def run(batches):
        memo = Memo()
        for batch in batches:
            held, size, at = [], 0, 0
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i, doc_id in enumerate(ids):
                held.append(transformed(texts[i].as_py() or "", doc_id, memo, seed, rate, spm))
                size += len(held[-1][-1])
                if size > 4 << 20 or i + 1 == len(ids):  # outputs leave in blocks of a few MB
                    made = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, len(held)).columns, *made], names=schema.names)
                    held, size, at = [], 0, i + 1

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of: its three parts put back in order."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    back = F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
    return back.when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))).otherwise(output)
