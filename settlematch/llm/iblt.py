"""Fingerprints that subtract: invertible Bloom lookup sketches of a text's paragraphs.

Every paragraph digest is put into three cells; a cell keeps a count and the exclusive-or of its
digests and of their check values. Two sketches of one size subtract cell by cell, common
paragraphs cancel, and *peeling* reads off the rest: a cell of one digest (its check value
agrees) names it, the digest leaves its other cells, and so on until nothing is left. If cells
remain, the sketches were too small for the difference, and larger ones of both are tried.

A fingerprint holds two sketches: one of CELLS cells, which peels small differences, and where
that has too little room for the text's own digests, one with room for them all. The second peels
by itself, so it gives back every digest (:func:`own_digests`), and with them a sketch of any
larger size: likeness of two fingerprints needs nothing else.

Only DataFrame functions are used. Sketches are kept as sorted arrays of their non-empty cells,
so the work follows the number of digests and not the nominal size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of the small sketch; larger ones take GROWTH times as many each. Roomy sketches peel in two or three rounds.
CELLS = 24
GROWTH = 16
ROOM = 6
#: Sizes tried, and rounds of peeling of one sketch. Beyond both, digests are compared one by one.
LEVELS = 5
ROUNDS = 64
#: Ranges that the id order is cut into at most, rows that a range should hold, and ranges of rows without an id.
RANGES, EACH, UNKNOWN = 10_000, 512, 64
#: A paragraph is a line; lines longer than this many characters are cut behind the next sentence or clause mark.
LONG = 200
_PIECES = rf"[^\n]{{{LONG},}}?[.!?,|](?=\s|$)|[^\n]+"


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(7)).bitwiseAND(F.lit(0xFFFFFFFF))


def _entries(keys: Column, size: Column, sign: Column | int) -> Column:
    """Three cells of count ``sign`` for every key of an array of (key) longs."""
    third = F.expr("0L") + (size / 3).cast("long")

    def one(key: Column) -> Column:
        check = _check(key)
        places = [F.pmod(F.xxhash64(key, F.lit(i), size), third) + third * i for i in range(3)]
        return F.array(*[F.struct(p.alias("cell"), F.lit(sign).cast("long").alias("count"), key.alias("key"), check.alias("check")) for p in places])

    return F.flatten(F.transform(keys, one))


def _merged(entries: Column) -> Column:
    """Entries of one cell added up; empty cells are left out. Sorted by cell.

    Sorting brings a cell's entries together; each run of them is then folded by itself.
    """

    def folded(run: Column, cell: Column) -> Column:
        start = F.struct(cell.alias("cell"), *[F.lit(0).cast("long").alias(n) for n in ("count", "key", "check")])
        return F.aggregate(run, start, lambda x, y: F.struct(x["cell"].alias("cell"), (x["count"] + y["count"]).alias("count"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")))

    def runs(rows: Column, starts: Column) -> Column:
        def one(at: Column, k: Column) -> Column:
            n = F.coalesce(F.get(starts, k + 1), F.size(rows)) - at
            return F.when(n == 1, F.get(rows, at)).otherwise(folded(F.slice(rows, at + 1, n), F.get(rows, at)["cell"]))

        return F.filter(F.transform(starts, one), lambda c: (c["count"] != 0) | (c["key"] != 0) | (c["check"] != 0))

    def sorted_rows(rows: Column) -> Column:
        places = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(rows, i - 1)["cell"] != F.get(rows, i)["cell"]))
        return _let(starts, lambda at: runs(rows, at))

    return _let(F.sort_array(entries), sorted_rows)


def sketch(keys: Column, size: Column) -> Column:
    """Non-empty cells of the sketch of ``size`` cells (a multiple of 3) over an array of digests."""
    return _merged(_entries(keys, size, 1))


def subtracted(a: Column, b: Column) -> Column:
    """Cells of a minus those of b, for sketches of one size."""
    minus = F.transform(b, lambda c: F.struct(c["cell"].alias("cell"), (-c["count"]).alias("count"), c["key"].alias("key"), c["check"].alias("check")))
    return _merged(F.concat(a, minus))


def _let(value: Column, use) -> Column:
    """``use(value)`` with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def peeled(cells: Column, size: Column) -> Column:
    """struct(ok, plus, minus): whether the difference was read off whole, and its digests by sign."""
    none = F.expr("cast(array() as array<bigint>)")

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: (F.abs(c["count"]) == 1) & (c["check"] == _check(c["key"])))

        def signed(found: Column, sign: int) -> Column:
            return F.array_distinct(F.transform(F.filter(found, lambda c: c["count"] == sign), lambda c: c["key"]))

        def remove(named: Column) -> Column:
            gone = F.concat(state["cells"], _entries(named["plus"], size, -1), _entries(named["minus"], size, 1))
            return F.struct(_merged(gone).alias("cells"), F.concat(state["plus"], named["plus"]).alias("plus"), F.concat(state["minus"], named["minus"]).alias("minus"), F.lit(False).alias("stuck"))

        stuck = F.struct(state["cells"].alias("cells"), state["plus"].alias("plus"), state["minus"].alias("minus"), F.lit(True).alias("stuck"))
        named = _let(pure, lambda found: F.struct(signed(found, 1).alias("plus"), signed(found, -1).alias("minus")))
        return F.when(state["stuck"] | (F.size(state["cells"]) == 0), state).otherwise(_let(named, lambda x: F.when(F.size(x["plus"]) + F.size(x["minus"]) == 0, stuck).otherwise(remove(x))))

    start = F.struct(cells.alias("cells"), none.alias("plus"), none.alias("minus"), F.lit(False).alias("stuck"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.struct((F.size(s["cells"]) == 0).alias("ok"), s["plus"].alias("plus"), s["minus"].alias("minus")))


def size_for(n: Column) -> Column:
    """The smallest size with room for ``n`` digests."""
    level = F.ceil(F.log(F.greatest(n * ROOM, F.lit(CELLS)) / CELLS) / F.log(F.lit(float(GROWTH))) - 1e-9)
    return (F.lit(CELLS) * F.pow(F.lit(float(GROWTH)), level)).cast("long")


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """struct(ok, plus, minus) for two arrays of digests whose small sketches are at hand.

    The small sketches are tried first; on failure both are rebuilt larger, skipping sizes
    below ROOM times the number of digests, and with other cell places each time. Should the
    largest fail too, the digests are compared one by one.
    """
    small = F.lit(CELLS).cast("long")
    most = F.size(a) + F.size(b)

    def attempt(last: Column, level: Column) -> Column:
        size = (F.lit(CELLS) * F.pow(F.lit(float(GROWTH)), level)).cast("long")
        again = peeled(_merged(F.concat(_entries(a, size, 1), _entries(b, size, -1))), size)
        return F.when(last["ok"] | ((size < most * ROOM) & (level < LEVELS)), last).otherwise(again)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), peeled(subtracted(cells_a, cells_b), small), attempt)
    plain = F.struct(F.lit(True).alias("ok"), F.array_except(a, b).alias("plus"), F.array_except(b, a).alias("minus"))
    return _let(found, lambda x: F.when(x["ok"], x).otherwise(plain))


def likeness(a: Column, b: Column, found: Column) -> Column:
    """Shared digests over all digests of both; 1 where neither has any."""
    both, apart = F.size(a) + F.size(b), F.size(found["plus"]) + F.size(found["minus"])
    return F.when(both == 0, 1.0).otherwise(((both - apart) / (both + apart)).cast("double"))


def written_out(keys: Column, cells: Column) -> Column:
    """The fingerprint as text: size and non-empty cells (place, count, key, check in hex) of the small sketch and of the one with room."""

    def wide(x: Column, n: int) -> Column:
        return F.lpad(F.lower(F.hex(x)), n, "0")

    def shown(size: Column, cells: Column) -> Column:
        lines = F.transform(cells, lambda c: F.concat(wide(c["cell"], 8), wide(c["count"], 8), wide(c["key"], 16), wide(c["check"], 8)))
        return F.concat(F.lit("iblt"), size.cast("string"), F.lit(":"), F.array_join(lines, ""))

    def second(size: Column) -> Column:
        return F.concat(F.lit(";"), shown(size, sketch(keys, size)))

    def roomy(size: Column) -> Column:
        own = F.when(size > CELLS, sketch(keys, size)).otherwise(cells)
        written = F.when(size > CELLS, F.concat(F.lit(";"), shown(size, own))).otherwise(F.lit(""))
        # two digests may share all their places in a small sketch
        return F.when(peeled(own, size)["ok"], written).otherwise(second(size * GROWTH))

    return F.concat(shown(F.lit(CELLS), cells), _let(size_for(F.size(keys)), roomy))


def own_digests(fingerprint: Column) -> Column:
    """struct(ok, plus, minus): the digests in ``plus``, peeled from a fingerprint's last sketch alone."""
    last = F.element_at(F.split(fingerprint, ";"), -1)
    size = F.regexp_extract(last, "^iblt([0-9]+):", 1).cast("long")
    body = F.substring_index(last, ":", -1)

    def number(x: Column, at: int, n: int) -> Column:
        return F.conv(F.substring(x, at, n), 16, -10).cast("long")

    cell = F.transform(F.regexp_extract_all(body, F.lit("[0-9a-f]{40}"), F.lit(0)), lambda x: F.struct(number(x, 1, 8).alias("cell"), number(x, 9, 8).alias("count"), number(x, 17, 16).alias("key"), number(x, 33, 8).alias("check")))
    return peeled(cell, size)


def _bounds(documents: DataFrame) -> list[int]:
    """At most RANGES ids that cut the table into ranges of about EACH rows; all the driver sees."""
    n = documents.count()
    parts = min(max(n // EACH, 1), RANGES)
    if parts < 2:
        return []
    cuts = [i / parts for i in range(1, parts)]
    found = documents.agg(F.percentile_approx("doc_id", cuts, 4 * parts).alias("cuts")).head()["cuts"]
    return sorted(set(found or []))


def _range_of(bounds: list[int]) -> Column:
    """How many bounds are not above doc_id: coarse steps first, then the bounds of one step."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.lit([x[0] for x in rows])
    table = F.array(*[F.lit(x) for x in rows])

    def not_above(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= F.col("doc_id")))

    return _let(not_above(heads), lambda k: F.when(k == 0, 0).otherwise((k - 1) * step + not_above(F.get(table, k - 1))))


def with_next(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text, keys) with ``next_text`` and ``next_keys`` of the next doc_id; the last takes the first.

    Rows of one id follow each other in order of text. Rows without an id come first, in an order
    that depends on their texts. The order is cut at quantiles of the ids, so any spread of ids
    is dealt evenly; each range also gets a copy of the next one's first row, so one shuffle does.
    """
    unknown = F.pmod(F.xxhash64("text"), F.lit(UNKNOWN)).cast("int") - UNKNOWN
    documents = documents.withColumn("range", F.when(F.col("doc_id").isNull(), unknown).otherwise(_range_of(_bounds(documents))))
    heads = [tuple(r) for r in documents.groupBy("range").agg(F.min("doc_id").alias("first")).orderBy("range").collect()]  # at most RANGES + UNKNOWN rows
    around = [(r, first, heads[i - 1][0]) for i, (r, first) in enumerate(heads)]
    heads = documents.sparkSession.createDataFrame(around, "range int, first long, before int")
    first = documents.join(F.broadcast(heads), "range").where(F.col("doc_id").eqNullSafe(F.col("first")))
    copies = first.groupBy("before").agg(F.min(F.struct("text", "keys")).alias("x"), F.min("doc_id").alias("doc_id")).select("doc_id", "x.text", "x.keys", F.col("before").alias("range"), F.lit(1).alias("copy"))
    rows = documents.withColumn("copy", F.lit(0)).unionByName(copies)
    line = Window.partitionBy("range").orderBy("copy", "doc_id", "text")
    return rows.withColumns({"next_text": F.lead("text").over(line), "next_keys": F.lead("keys").over(line)}).where("copy = 0").drop("range", "copy")


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited version, and how like they are.

    Null texts are empty and have an empty sketch; two empty texts have likeness 1. In a table
    of one row the next document is the row itself. Rows that share an id follow each other in
    order of text; rows without one stand before all others. Extra columns are left out.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("keys", digests(F.col("text")))
    rows = with_next(rows)
    n = F.length("text").cast("long")
    half = F.expr("cast(n_chars div 2 as int)")
    rows = rows.withColumn("n_chars", n).withColumn("edited", F.concat(F.left("text", (F.col("n_chars") - half).cast("int")), F.left("next_text", half)))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "keys", "next_keys", digests(F.col("edited")).alias("edited_keys"))
    small = F.lit(CELLS).cast("long")
    rows = rows.withColumns({f"{x}cells": sketch(F.col(f"{x}keys"), small) for x in ("", "edited_", "next_")})
    rows = rows.withColumns({f"{x}diff": difference(F.col("keys"), F.col(f"{x}keys"), F.col("cells"), F.col(f"{x}cells")) for x in ("edited_", "next_")})
    near = {x: likeness(F.col("keys"), F.col(f"{x}keys"), F.col(f"{x}diff")) for x in ("edited_", "next_")}
    found = F.col("edited_diff")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        written_out(F.col("keys"), F.col("cells")).alias("fingerprint"), written_out(F.col("edited_keys"), F.col("edited_cells")).alias("edited_fingerprint"),
        near["edited_"].alias("near_edited"), near["next_"].alias("near_next"),
        F.size(found["plus"]).alias("removed_paragraphs"), F.size(found["minus"]).alias("added_paragraphs"),
    )
