"""Invoices in reach of payments, from shelves that many payments share.

A payment may settle any invoice issued within ISSUE_DAYS of its capture whose amount is within
SPREAD of its own; only the first few of them by id matter. Pairs of a common price are far too
many to write. Invoices stand on shelves instead, one for each bucket of days and of amounts, in
order of id; a payment looks through the nine shelves around its own until it has enough. What
travels is a row per payment and nine per invoice, and of invoices that agree in date and amount
only as many as one payment could be offered.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from settlematch.operators.runs import solve_runs

ISSUE_DAYS, SPREAD = 21, 0.15
#: Payments of one bucket that are looked up in one task.
EACH = 20_000
#: Buckets are numbered as day * LEVELS + level.
LEVELS = 1 << 12


def level(amount: Column, step: float) -> Column:
    """A whole number on a log scale; what is below 30 paise, where ten paise are much, is one level."""
    return F.floor(F.log(F.greatest(amount, F.lit(300)).cast("double")) / step).cast("int")


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def bucket(day: Column, amount: Column) -> Column:
    """Number of the bucket; what is in reach lies in the same or a neighbouring day and level."""
    return (F.floor(day_number(day) / ISSUE_DAYS) * LEVELS + level(amount, 0.18)).cast("long")


def around(number: Column) -> Column:
    """The bucket and its eight neighbours."""
    return F.array(*[number + (d * LEVELS + x) for d in (-1, 0, 1) for x in (-1, 0, 1)])


class Shelf:
    """Invoices of one or more buckets in order of id."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        rows.sort()
        self._put([r[0] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))

    def _put(self, ids: list[str], amounts: np.ndarray, days: np.ndarray) -> None:
        self.ids, self.amounts, self.days = ids, amounts, days
        self.there, self.gone = np.ones(len(ids), bool), 0

    @classmethod
    def of(cls, rows: pa.Table) -> Shelf:
        """From columns id, amount and day, in order already."""
        shelf = cls.__new__(cls)
        shelf._put(rows.column("id").to_pylist(), rows.column("amount").to_numpy(), rows.column("day").to_numpy().astype(np.int64))
        return shelf

    def near(self, gross: int, day: int) -> Iterator[int]:
        """Places of what is in reach and there, looked for in stretches that double."""
        at, size = 0, 256
        while at < len(self.ids):
            s = slice(at, at + size)
            yield from (np.flatnonzero(self.there[s] & (np.abs(self.days[s] - day) <= ISSUE_DAYS) & (np.abs(self.amounts[s] - gross) <= gross * SPREAD)) + at).tolist()
            at, size = at + size, size * 2

    def first(self, gross: int, day: int, most: int) -> list[tuple[str, int, int]]:
        """The first ``most`` in reach that are there."""
        return [(self.ids[i], int(self.amounts[i]), int(self.days[i])) for i in islice(self.near(gross, day), most)]

    def take(self, counterpart: str) -> None:
        """Take all rows of an id."""
        i, j = bisect_left(self.ids, counterpart), bisect_right(self.ids, counterpart)
        if i == j:
            return
        self.there[i:j], self.gone = False, self.gone + j - i
        if self.gone * 2 > len(self.ids) or self.gone >= 4096:  # taken ones are put away before they are in the way
            kept = np.flatnonzero(self.there)
            self._put([self.ids[k] for k in kept], self.amounts[kept], self.days[kept])


class Shelves:
    """The shelves of a task, by bucket."""

    def __init__(self, rows: Iterable[tuple[int, str, int, int]]):
        by: dict[int, list] = {}
        for number, *row in rows:
            by.setdefault(number, []).append(tuple(row))
        self.by = {number: Shelf(rows) for number, rows in by.items()}

    def first(self, number: int, gross: int, day: int, most: int) -> list[tuple[str, int, int]]:
        """The first ``most`` invoices (id, amount, day) in reach of a payment of bucket ``number``."""
        return sorted(i for s in self.near(number) for i in s.first(gross, day, most))[:most]

    def take(self, number: int, counterpart: str) -> None:
        """Take an invoice that was offered to a payment of bucket ``number``."""
        for shelf in self.near(number):
            shelf.take(counterpart)

    def near(self, number: int) -> list[Shelf]:
        return [s for d in (-1, 0, 1) for x in (-1, 0, 1) if (s := self.by.get(number + d * LEVELS + x))]


def enough_of_each(invoices: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of the invoices that agree in date and amount: all stand in reach of the same payments."""
    place = F.row_number().over(Window.partitionBy("issue_date", "invoice_amount").orderBy("invoice_id"))
    return invoices.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def payment_rows(payments: DataFrame) -> DataFrame:
    known = payments.where("captured_on is not null")
    return known.select(F.lit("p").alias("kind"), bucket(F.col("captured_on"), F.col("gross")).alias("bucket"), F.col("payment_id").alias("id"), F.col("gross").alias("amount"), day_number(F.col("captured_on")).alias("day"))


def invoice_rows(invoices: DataFrame) -> DataFrame:
    return invoices.where("issue_date is not null").select(F.lit("i").alias("kind"), bucket(F.col("issue_date"), F.col("invoice_amount")).alias("bucket"), F.col("invoice_id").alias("id"), F.col("invoice_amount").alias("amount"), day_number(F.col("issue_date")).alias("day"))


def in_lanes(asked: DataFrame, stock: DataFrame, solve: Callable[[Shelf, pa.Table, pa.Table], Iterable[tuple]], schema: str) -> DataFrame:
    """``solve`` for the payments of a bucket: what stands on the nine shelves around it, those rows, and the payments, all in order of id.

    asked, stock: rows of :func:`payment_rows` and :func:`invoice_rows`, with more columns if need be.
    Payments of a bucket are dealt to lanes of about EACH, and each lane gets the nine shelves.
    """
    lanes = asked.groupBy("bucket").agg((F.count("*") / EACH + 1).cast("int").alias("lanes"))
    group = F.concat_ws(":", "at", "lane").alias("group")
    left = asked.join(lanes, "bucket").withColumns({"at": F.col("bucket"), "lane": F.pmod(F.xxhash64("id"), F.col("lanes")).cast("int")})
    right = stock.withColumn("at", F.explode(around(F.col("bucket")))).join(lanes.withColumnRenamed("bucket", "at"), "at").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    rows = left.select(group, *asked.columns).unionByName(right.select(group, *stock.columns), allowMissingColumns=True)

    def run(table: pa.Table) -> Iterable[tuple]:
        n = pc.sum(pc.equal(table.column("kind"), "i")).as_py()  # invoices come first
        if n == len(table):
            return []
        return solve(Shelf.of(table.slice(0, n)), table.slice(0, n), table.slice(n))

    return solve_runs(rows, "group", ["kind", "id", "amount", "day"], run, schema, tables=True)


def first_in_reach(payments: DataFrame, invoices: DataFrame, most: int) -> DataFrame:
    """payment_id, invoice_id, place, invoice_amount, issue_date: the first ``most`` invoices in reach of each payment, by id."""

    def solve(shelf: Shelf, _: pa.Table, asked: pa.Table) -> Iterable[tuple]:
        for i, gross, day in zip(*(asked.column(c).to_pylist() for c in ("id", "amount", "day")), strict=True):
            for place, (found, amount, on) in enumerate(shelf.first(gross, day, most), 1):
                yield i, found, place, amount, on

    found = in_lanes(payment_rows(payments), invoice_rows(enough_of_each(invoices, most)), solve, "payment_id string, invoice_id string, place int, invoice_amount long, day int")
    return found.select("payment_id", "invoice_id", "place", "invoice_amount", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("issue_date"))
