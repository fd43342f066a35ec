"""MPEG audio as a binary column: writing payload frames, and probing any stream.

``probe`` reads a stream the way a player must: it skips tags (ID3v1, ID3v2.2 to 2.4, APE),
resynchronises on frame headers, confirms each by its successor, verifies the 16-bit checksum of
protected frames of all three layers, reads the variable-bitrate table (Xing, Info or VBRI) and
the encoder's delay and padding, and gives exact durations (samples over rate) and the byte offset
of every frame. ``wrap`` stores bytes losslessly as the main data of Layer III frames.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from settlematch.llm.common import byte_blocks, record_batch

# Fixed values of the format: bitrates in kbit/s by index, and sampling rates in Hz.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
UNIT = 192


def _tables() -> tuple[np.ndarray, ...]:
    """Frame bytes, samples and rate for each value of a header's second and third byte (0: not a header)."""
    size, samples, rate = (np.zeros(65536, np.int32) for _ in range(3))
    for b1 in range(0xE0, 0x100):
        version, layer = b1 >> 3 & 3, 4 - (b1 >> 1 & 3)
        if version == 1 or layer == 4:
            continue
        kbits = BITRATES[1 if version == 3 else 2, layer]
        for b2 in range(256):
            index, hz, pad = b2 >> 4, b2 >> 2 & 3, b2 >> 1 & 1
            if index in (0, 15) or hz == 3:
                continue
            k, r = b1 << 8 | b2, RATES[version][hz]
            samples[k] = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
            size[k] = (12000 * kbits[index] // r + pad) * 4 if layer == 1 else samples[k] // 8 * kbits[index] * 1000 // r + pad
            rate[k] = r
    return size, samples, rate


SIZE, SAMPLES, RATE = _tables()


def crc16(data: bytes) -> int:
    """Checksum of protected frames: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def crc16_bits(bits: int, n: int, crc: int = 0xFFFF) -> int:
    """The same over the ``n`` bits of a number."""
    for i in range(n - 1, -1, -1):
        crc = (crc << 1 ^ 0x8005 if (crc >> 15 ^ bits >> i) & 1 else crc << 1) & 0xFFFF
    return crc


# Fixed values of the format: width in bits of each subband's allocation in Layer II, by table.
ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
}


def guarded_bits(data: bytes, at: int) -> tuple[int, int]:
    """The bits that a protected frame's checksum covers, and how many: half the header, then side information or bit allocation."""
    b1, b2, b3 = data[at + 1 : at + 4]
    version, layer, mode = b1 >> 3 & 3, 4 - (b1 >> 1 & 3), b3 >> 6
    channels, head = (1 if mode == 3 else 2), b2 << 8 | b3
    if layer == 3:
        n = side_bytes(b1, b3)
        return head << 8 * n | int.from_bytes(data[at + 6 : at + 6 + n].ljust(n, b"\0"), "big"), 16 + 8 * n
    bound = 4 * (b3 >> 4 & 3) + 4 if mode == 1 else 32  # from there on both channels share what is said
    if layer == 1:
        widths = (4,) * 32
    elif version != 3:
        widths = ALLOCATION["low"]
    else:
        each, rate = BITRATES[1, 2][b2 >> 4] // channels, RATES[3][b2 >> 2 & 3]
        widths = ALLOCATION[("d" if rate == 32000 else "c") if each <= 48 else "a" if rate == 48000 or each <= 80 else "b"]
    size = 8 * 64
    body, used, chosen = int.from_bytes(data[at + 6 : at + 6 + size // 8].ljust(size // 8, b"\0"), "big"), 0, 0
    for band, width in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            used += width
            if body >> (size - used) & ((1 << width) - 1):
                chosen += channels if band >= bound else 1
    if layer == 2:
        used += 2 * chosen
    return head << used | body >> (size - used), 16 + used


def side_bytes(b1: int, b3: int) -> int:
    """Length of Layer III side information by version and channel mode."""
    mono = b3 >> 6 == 3
    return (17 if mono else 32) if b1 >> 3 & 3 == 3 else (9 if mono else 17)


# Layer III, version 1, protected, 48 kHz, mono: 240 bytes at 80 kbit/s, 288 at 96 kbit/s
_SIDE = bytes(17)
_HEADS = {}
for _kbits in (80, 96):
    _head = bytes([0xFF, 0xFA, BITRATES[1, 3].index(_kbits) << 4 | 1 << 2, 0xC4])
    _HEADS[_kbits] = _head + crc16(_head[2:4] + _SIDE).to_bytes(2, "big") + _SIDE
_BODY = len(_HEADS[80])


def wrap(payload: bytes) -> bytes:
    """``payload`` (a multiple of 192 bytes) as a tagged variable-bitrate Layer III stream.

    An ID3v2 tag holds the payload's length; an Xing frame holds frame count, byte count and the
    100-entry seek table; then each 192 bytes are the main data of one frame, at 96 kbit/s where
    they hold a byte above 127 and at 80 kbit/s otherwise.
    """
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    wide = (units > 127).any(axis=1)
    frames = np.zeros((len(units), 288), np.uint8)
    frames[:, :_BODY] = np.where(wide[:, None], np.frombuffer(_HEADS[96], np.uint8), np.frombuffer(_HEADS[80], np.uint8))
    frames[:, _BODY : _BODY + UNIT] = units
    sizes = np.where(wide, 288, 240)
    body = frames[np.arange(288) < sizes[:, None]].tobytes()
    total = 288 + len(body)
    ends = np.concatenate([[0, 288], 288 + np.cumsum(sizes)])  # where each frame, the table's included, begins
    toc = (ends[(np.arange(100) * (len(units) + 1) // 100)] * 256 // total).astype(np.uint8).tobytes()
    table = b"Xing" + (7).to_bytes(4, "big") + len(units).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    text = b"\x00" + f"payload={len(payload)}".encode("latin-1")
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    n = len(tag)
    size = bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    return b"ID3\x03\x00\x00" + size + tag + (_HEADS[96] + table).ljust(288, b"\0") + body


@dataclass
class Probe:
    """What a stream holds. Offsets count from the stream's first byte."""

    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    samples: int = 0
    rate: int = 0
    protected: int = 0
    bad_checksums: int = 0
    skipped: int = 0
    tags: dict = field(default_factory=dict)
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: bytes = b""
    delay: int = 0
    padding: int = 0

    @property
    def heard(self) -> int:
        """Samples without the encoder's delay and padding."""
        return max(self.samples - self.delay - self.padding, 0)


def _syncsafe(raw: bytes) -> int:
    n = 0
    for b in raw:
        n = n << 7 | b & 127
    return n


def _tag_text(raw: bytes) -> str:
    """Text of an ID3v2 frame by its encoding byte."""
    if not raw:
        return ""
    name = {1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0], "latin-1")
    return raw[1:].decode(name, "replace").strip("\0")


def _id3v2(body: bytes, major: int, flags: int) -> dict:
    """Text frames of an ID3v2 tag: three-letter names before version 3, sizes of seven bits a byte from 4 on."""
    tags, at = {}, 0
    if flags & 128 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 64 and major > 2 and len(body) >= 4:  # extended header
        at = _syncsafe(body[:4]) if major > 3 else 4 + int.from_bytes(body[:4], "big")
    letters, head = (3, 6) if major < 3 else (4, 10)
    while at + head <= len(body) and body[at : at + letters].isalnum():
        raw = body[at + letters : at + 2 * letters]
        n = _syncsafe(raw) if major > 3 else int.from_bytes(raw, "big")
        value = body[at + head : at + head + n]
        if major > 3 and body[at + 9] & 2:
            value = value.replace(b"\xff\0", b"\xff")
        if major > 3 and body[at + 9] & 1:  # a length stands before the text
            value = value[4:]
        if body[at] == ord("T"):
            tags[body[at : at + letters].decode("latin-1")] = _tag_text(value)
        at += head + n
    return tags


def _ape(body: bytes) -> dict:
    """Text items of an APE tag's body."""
    tags, at = {}, 0
    while at + 9 <= len(body):
        n, flags = int.from_bytes(body[at : at + 4], "little"), int.from_bytes(body[at + 4 : at + 8], "little")
        stop = body.find(b"\0", at + 8)
        if stop < 0:
            break
        if not flags & 6:
            tags[body[at + 8 : stop].decode("latin-1")] = body[stop + 1 : stop + 1 + n].decode("utf-8", "replace")
        at = stop + 1 + n
    return tags


def _tags(data: bytes) -> tuple[int, int, dict]:
    """First and last byte position of the audio, and the tags around it."""
    start, end, tags = 0, len(data), {}
    while data[start : start + 3] == b"ID3" and len(data) >= start + 10 and max(data[start + 6 : start + 10]) < 128:
        n, flags = _syncsafe(data[start + 6 : start + 10]), data[start + 5]
        tags |= _id3v2(data[start + 10 : start + 10 + n], data[start + 3], flags)
        start += 10 + n + (10 if flags & 16 else 0)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        tags |= {k: v for k, at, n in (("title", 3, 30), ("artist", 33, 30), ("album", 63, 30)) if (v := data[end - 128 + at : end - 128 + at + n].decode("latin-1").rstrip("\0 "))}
        end -= 128
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        n, flags = int.from_bytes(data[end - 20 : end - 16], "little"), int.from_bytes(data[end - 12 : end - 8], "little")
        tags |= _ape(data[max(end - n, start) : end - 32])
        end = max(end - n - (32 if flags >> 31 else 0), start)
    return min(start, end), end, tags


def _table(out: Probe, data: bytes, first: int) -> bool:
    """Read the variable-bitrate table of a Layer III stream's first frame; False where it has none."""
    at = first + 4 + (0 if data[first + 1] & 1 else 2) + side_bytes(data[first + 1], data[first + 3])
    if data[at : at + 4] in (b"Xing", b"Info"):
        flags, p = int.from_bytes(data[at + 4 : at + 8], "big"), at + 8
        if flags & 1:
            out.vbr_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 2:
            out.vbr_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            out.toc, p = data[p : p + 100], p + 100
        p += 4 if flags & 8 else 0
        if data[p : p + 4] in (b"LAME", b"Lavc", b"Lavf"):
            gaps = int.from_bytes(data[p + 21 : p + 24], "big")
            out.delay, out.padding = gaps >> 12, gaps & 0xFFF
        return True
    at = first + 36
    if data[at : at + 4] == b"VBRI":
        out.delay = int.from_bytes(data[at + 6 : at + 8], "big")
        out.vbr_bytes, out.vbr_frames = int.from_bytes(data[at + 10 : at + 14], "big"), int.from_bytes(data[at + 14 : at + 18], "big")
        return True
    return False


def probe(data: bytes) -> Probe:
    """Parse any byte string; garbage, truncated frames and empty input give what frames there are.

    A candidate header counts if the frame ends at the end of the audio, or where another valid
    header of the same version, layer and rate begins; once in step, a valid header suffices.
    """
    out = Probe()
    start, end, out.tags = _tags(data)
    b = np.frombuffer(data, np.uint8)
    if end - start < 4:
        out.skipped = end - start
        return out
    sync = np.flatnonzero((b[start : end - 3] == 255) & (b[start + 1 : end - 2] >= 224)) + start
    keys = b[sync + 1].astype(np.int32) << 8 | b[sync + 2]
    good = SIZE[keys] > 0
    sync, keys = sync[good], keys[good]
    heads = dict(zip(sync.tolist(), keys.tolist(), strict=True))
    sizes, same = SIZE.tolist(), 0xFE0C  # version, layer and sampling rate
    offsets, found, at, in_step, nth, order = [], [], start, False, 0, sync.tolist()
    while at + 4 <= end:
        key = heads.get(at)
        if key is not None and found and (key ^ found[0]) & same:
            key = None
        if key is not None and at + sizes[key] <= end:
            after = at + sizes[key]
            follows = heads.get(after)
            if in_step or after == end or follows is not None and not (follows ^ key) & same:
                offsets.append(at)
                found.append(key)
                at, in_step = after, True
                continue
        in_step = False
        while nth < len(order) and order[nth] <= at:
            nth += 1
        if nth == len(order):
            break
        at = order[nth]
    if not offsets:
        out.skipped = end - start
        return out
    offs, key = np.array(offsets, np.int64), np.array(found)
    size = SIZE[key].astype(np.int64)
    out.skipped = int(end - start - size.sum())
    layer = 4 - (data[offsets[0] + 1] >> 1 & 3)
    if layer == 3 and _table(out, data, offsets[0]):
        offs, key, size = offs[1:], key[1:], size[1:]  # the table's frame is not sound
    guarded = [o for o, k in zip(offs.tolist(), key.tolist(), strict=True) if not k >> 8 & 1]
    out.protected = len(guarded)
    sums: dict[bytes, int] = {}
    for o in guarded:
        n = side_bytes(data[o + 1], data[o + 3]) if layer == 3 else 64
        covered = data[o + 1 : o + 4] + data[o + 6 : o + 6 + n]
        if covered not in sums:
            sums[covered] = crc16_bits(*guarded_bits(data, o))
        out.bad_checksums += sums[covered] != int.from_bytes(data[o + 4 : o + 6], "big")
    out.offsets, out.sizes = offs, size
    out.samples, out.rate = int(SAMPLES[key].sum()), int(RATE[found[0]])
    return out


def unwrap(data: bytes, seen: Probe) -> bytes:
    """The payload of a stream made by :func:`wrap`, read through the frames that were found; empty for others."""
    mine = seen.offsets[seen.sizes >= _BODY + UNIT] if seen.tags.get("TXXX", "").startswith("payload=") else []
    if not len(mine):
        return b""
    at = mine[:, None] + np.arange(_BODY, _BODY + UNIT)
    return np.frombuffer(data, np.uint8)[at].tobytes()


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % UNIT if raw else UNIT)


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FACTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int64()), ("duration_samples", pa.int64()), ("sample_rate", pa.int32()), ("frame_offsets", pa.list_(pa.int32()))])


def store_text(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and the MPEG stream ``media`` of every text (null: empty).

    Rows are handled one by one, so repeats stay repeats; other columns are left out.
    """

    def run(batches):
        for batch in byte_blocks(batches, rows=256):
            made = [payload_of(t) for t in batch.column("text").to_pylist()]
            yield record_batch(MEDIA, {"doc_id": batch.column("doc_id"), "n_bytes": [n for n, _ in made], "media": [wrap(p) for _, p in made]})

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def probe_column(media: DataFrame) -> DataFrame:
    """Facts of every stream in ``media``: digests, duration, frames and where they begin.

    ``feature`` names the sampling rate, samples, frames, mean bitrate in bit/s, checksum
    failures, whether the variable-bitrate table agrees with the frames, and the largest error
    of its seek points in bytes. Empty or foreign streams give zero frames.
    """

    def run(batches):
        for batch in byte_blocks(batches, rows=256, column="media"):
            out = {name: [] for name in FACTS.names}
            for doc, n, data in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
                data = data or b""
                seen = probe(data)
                payload = unwrap(data, seen)
                for name, value in zip(FACTS.names, (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(seen), len(seen.offsets), seen.heard, seen.rate, seen.offsets), strict=True):
                    out[name].append(value)
            yield record_batch(FACTS, out)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ", ".join(f"{f.name} {'array<int>' if f.name == 'frame_offsets' else {'int64': 'long', 'int32': 'int', 'string': 'string'}[str(f.type)]}" for f in FACTS))


def feature(seen: Probe) -> str:
    n = len(seen.offsets)
    bits = int(seen.sizes.sum()) * 8 * seen.rate // seen.samples if seen.samples else 0
    agrees = seen.vbr_frames == n if seen.vbr_frames is not None else False
    worst = 0
    if seen.toc and n and seen.vbr_bytes:
        base = int(seen.offsets[0]) - 288
        begins = np.concatenate([[0], seen.offsets - base])[np.arange(100) * (n + 1) // 100]
        worst = int(np.abs(np.frombuffer(seen.toc, np.uint8).astype(np.int64) * seen.vbr_bytes // 256 - begins).max())
    return f"rate={seen.rate};samples={seen.samples};frames={n};bitrate={bits};bad_crc={seen.bad_checksums};vbr_ok={int(agrees)};seek_error={worst}"
