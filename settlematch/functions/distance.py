"""Edit distance with adjacent swaps (each character moved once at most), in built-in functions.

The shorter text stands in the bits of a long: bit i of a vector tells whether the distance
grows (or falls) from character i to the next in the current column of the distance table, and a
column follows from the one before by a few operations on whole vectors. Texts whose shorter one
does not fit go through a band of the table as wide as the cap allows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a vector takes; one bit more is needed for a carry, and the sign is left alone.
BITS = 62


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _places(pattern: Column) -> Column:
    """character -> vector of the places where it stands in ``pattern`` (an array)."""
    marked = F.transform(pattern, lambda c, i: F.struct(c.alias("c"), F.call_function("shiftleft", F.lit(1).cast("long"), i).alias("bit")))

    def all_of(c: Column) -> Column:
        return F.aggregate(marked, F.lit(0).cast("long"), lambda s, m: F.when(m["c"] == c, s.bitwiseOR(m["bit"])).otherwise(s))

    return F.map_from_arrays(F.array_distinct(pattern), F.transform(F.array_distinct(pattern), all_of))


def _by_vectors(pattern: Column, text: Column) -> Column:
    """Distance of two arrays of characters, the first with 1 to BITS of them."""
    m = F.size(pattern)
    top = F.call_function("shiftleft", F.lit(1).cast("long"), m - 1)

    def run(places: Column, top: Column) -> Column:
        every = top.bitwiseOR(top - 1)  # as many ones as the pattern has characters
        zero = F.lit(0).cast("long")

        def step(s: Column, c: Column) -> Column:
            here = F.coalesce(F.try_element_at(places, c), zero)
            # a swap: the text's last character here, and this one a place before
            swap = F.shiftleft(F.bitwise_not(s["d"]).bitwiseAND(here), 1).bitwiseAND(s["last"])
            same = ((here.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(here).bitwiseOR(s["vn"]).bitwiseOR(swap).bitwiseAND(every)

            def column(x: Column) -> Column:  # x: here, same
                rise = s["vn"].bitwiseOR(F.bitwise_not(x["same"].bitwiseOR(s["vp"]))).bitwiseAND(every)
                fall = x["same"].bitwiseAND(s["vp"])
                n = s["n"] + F.when(rise.bitwiseAND(top) != 0, 1).when(fall.bitwiseAND(top) != 0, -1).otherwise(0)

                def next_(y: Column) -> Column:  # y: rise and fall moved on by a character
                    vp = y["fall"].bitwiseOR(F.bitwise_not(x["same"].bitwiseOR(y["rise"]))).bitwiseAND(every)
                    return F.struct(vp.alias("vp"), y["rise"].bitwiseAND(x["same"]).alias("vn"), x["same"].alias("d"), x["here"].alias("last"), n.alias("n"))

                return _let(F.struct(F.shiftleft(rise, 1).bitwiseOR(F.lit(1).cast("long")).bitwiseAND(every).alias("rise"), F.shiftleft(fall, 1).bitwiseAND(every).alias("fall")), next_)

            return _let(F.struct(here.alias("here"), same.alias("same")), column)

        start = F.struct(every.alias("vp"), zero.alias("vn"), zero.alias("d"), zero.alias("last"), m.alias("n"))
        return F.aggregate(text, start, step, lambda s: s["n"])

    return _let(F.struct(_places(pattern).alias("places"), top.alias("top")), lambda x: run(x["places"], x["top"]))


def _in_band(a: Column, b: Column, cap: int) -> Column:
    """Distance of two arrays of characters up to ``cap``, else cap + 1: rows of ``a``, and 2 cap + 1 columns around the diagonal."""
    wide, beyond = 2 * cap + 1, F.lit(cap + 1)
    many = F.size(b)

    def at(row: Column, o: Column) -> Column:
        return F.coalesce(F.get(row, o), beyond)

    def char(text: Column, i: Column) -> Column:
        return F.when(i > 0, F.get(text, i - 1))

    first = F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda o: F.when((o >= cap) & (o - cap <= many), o - cap).otherwise(beyond))

    def row(s: Column, i: Column) -> Column:
        x, before = char(a, i), char(a, i - 1)

        def cell(done: Column, o: Column) -> Column:
            j = i + o - cap
            y = char(b, j)
            swap = F.when((x == char(b, j - 1)) & (before == y), at(s["older"], o) + 1).otherwise(beyond)
            inside = F.least(at(s["old"], o + 1) + 1, F.when(o > 0, at(done, o - 1)).otherwise(beyond) + 1, at(s["old"], o) + F.when(x == y, 0).otherwise(1), swap, beyond)
            return F.array_append(done, F.when((j < 0) | (j > many), beyond).when(j == 0, F.least(i, beyond)).otherwise(inside))

        new = F.aggregate(F.sequence(F.lit(0), F.lit(wide - 1)), F.expr("cast(array() as array<int>)"), cell)
        return F.struct(s["old"].alias("older"), new.alias("old"))

    start = F.struct(F.transform(first, lambda _: beyond).alias("older"), first.alias("old"))
    rows = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(rows, start, row, lambda s: at(s["old"], many - F.size(a) + cap))


def damerau_levenshtein(a: Column, b: Column, cap: int = 2) -> Column:
    """Edits with adjacent swaps as one, up to ``cap`` (beyond: cap + 1); null where a text is null. For distance 1 between tables use keys."""

    def distance(x: Column) -> Column:
        short = F.least(F.size(x["s"]), F.size(x["t"]))
        swap = F.size(x["s"]) > F.size(x["t"])
        pattern, text = F.when(swap, x["t"]).otherwise(x["s"]), F.when(swap, x["s"]).otherwise(x["t"])
        far = F.abs(F.size(x["s"]) - F.size(x["t"])) > cap
        found = F.when(short == 0, F.size(text)).when(short <= BITS, _by_vectors(pattern, text)).otherwise(_in_band(x["s"], x["t"], cap))
        return F.when(far, cap + 1).otherwise(F.least(found, F.lit(cap + 1)))

    both = F.struct(characters(a).alias("s"), characters(b).alias("t"))
    return F.when(a.isNotNull() & b.isNotNull(), _let(both, distance)).cast("int")


def _code_points(texts: pa.Array, width: int) -> np.ndarray:
    """A row of ``width`` code points for each text, zeros behind its end."""
    data = "".join(x.ljust(width, "\0") for x in texts.to_pylist()).encode("utf-32-le")
    return np.frombuffer(data, np.uint32).reshape(len(texts), width)


def distances(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Distances of texts without nulls and of at most BITS characters: the vectors of :func:`_by_vectors`, of all pairs at once."""
    m, n = (pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    wide, steps = max(int(m.max(initial=0)), 1), int(n.max(initial=0))
    pattern, text = _code_points(a, wide), _code_points(b, max(steps, 1))
    one = np.uint64(1)
    every = (one << m.astype(np.uint64)) - one
    top = every ^ (every >> one)
    vp, vn, d, last, found = every.copy(), np.zeros_like(every), np.zeros_like(every), np.zeros_like(every), m.copy()
    bits = np.zeros((len(m), 64), bool)
    for j in range(steps):
        bits[:, :wide] = pattern == text[:, j : j + 1]
        here = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0] & every
        swap = ((~d & here) << one) & last
        same = ((((here & vp) + vp) ^ vp) | here | vn | swap) & every
        rise, fall = (vn | ~(same | vp)) & every, same & vp
        found += np.where(j < n, ((rise & top) != 0).astype(np.int64) - ((fall & top) != 0), 0)
        rise = ((rise << one) | one) & every
        vp, vn, d, last = (((fall << one) & every) | ~(same | rise)) & every, rise & same, same, here
    return np.where(m == 0, n, found)


def damerau_levenshtein_of_many(a: Column, b: Column, cap: int = 2) -> Column:
    """:func:`damerau_levenshtein` for very many pairs: texts of at most BITS characters go through Arrow, a batch of pairs at once."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("int")
    def batch(x: pa.Array, y: pa.Array) -> pa.Array:
        there = pc.and_(x.is_valid(), y.is_valid())
        out = np.zeros(len(x), np.int32)
        out[there.to_numpy(zero_copy_only=False)] = np.minimum(distances(x.filter(there), y.filter(there)), cap + 1)
        return pa.array(out, mask=~there.to_numpy(zero_copy_only=False))

    short = F.greatest(F.length(a), F.length(b)) <= BITS
    return F.coalesce(batch(F.when(short, a), F.when(short, b)), F.when(short, None).otherwise(damerau_levenshtein(a, b, cap)))
