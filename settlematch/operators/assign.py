"""Claim-once assignment in subject order, settled for all subjects together in rounds of joins.

Subjects are taken in id order and rules in rank order; the first rule that leaves a subject
exactly one unclaimed candidate wins and claims it. A decision depends only on what earlier
subjects may still claim, so a round asks of every candidate who is the first that may claim it:
for that subject and all before it the candidate is *sure* to be free at their turn. A rule with
two sure candidates can never be unique and is struck out; one whose only candidate is sure wins
where no rule before it is open. Struck rules, and candidates beside a sure one, are no longer
claims, which makes more candidates sure in the next round. So a counterpart that very many
subjects name is settled in a few rounds, whatever their number, and no task holds its subjects.
What is left after ``ROUNDS`` rounds are chains of claims that wait for each other; their
first ``SLICE`` edges in subject order are settled in one task, and rounds go on from there.

A rule by amount and date links everything of a common price over its whole history, so its
subjects are first narrowed to those that can win by it at all. Before the time (subject id) at
which another rule may first claim a counterpart, only the window can have claimed it. So a
subject that sees u counterparts not yet open to other rules needs u - 1 earlier window winners
within reach, and the first winner of all needs u = 1. The set that follows from this rule, grown
from nothing, holds every winner. On one amount and day it is always the latest ids, so a task
needs only the top few ids of each day of an amount: its input is bounded by the calendar. On a
common price next to nothing is left; on a rare one windows seldom meet. Only what is left is
paired with the counterparts it sees.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from settlematch.functions.stats import confidence_for
from settlematch.operators.components import MANY
from settlematch.operators.runs import solve_runs
from settlematch.storage import discard, written

#: Ids of one amount and day, from the latest on, that narrowing looks at; any number gives the same result.
TOP = 16
#: Amounts with fewer subjects are not narrowed.
COMMON = 8
#: Rounds of joins before a slice is taken, and the edges of a slice; any numbers give the same result.
ROUNDS, SLICE = 8, 200_000
#: Stands for a counterpart that no other rule can claim: behind every id.
NEVER = "\U0010ffff"


@dataclass
class DayWindow:
    """A last rule whose candidates are counterparts of one amount, dated at most ``length`` days before the subject.

    It is kept as the two sides, never as pairs, since one amount may have very many of both.
    subjects: subject_id, amount, day; rows: counterpart_id, amount, day (days as whole numbers).
    """

    rule: str
    rank: int
    length: int
    subjects: DataFrame
    rows: DataFrame


def greedy(edges: list[tuple[str, int, str]], wanted: dict[str, tuple[int, int]] | None = None, stock: dict[str, tuple[int, int]] | None = None, rank: int = 0, length: int = 0) -> list[tuple[str, int, str]]:
    """(subject, rank, counterpart) edges -> the winning ones.

    ``wanted`` (subject -> amount, day) and ``stock`` (counterpart -> amount, day) stand for the
    edges of a :class:`DayWindow` of that rank, which is tried last.
    """
    wanted, stock = wanted or {}, stock or {}
    offers: dict[str, dict[int, set[str]]] = {}
    for subject, r, counterpart in edges:
        offers.setdefault(subject, {}).setdefault(r, set()).add(counterpart)
    shelves: dict[int, list[tuple[int, str]]] = {}
    for counterpart, (amount, day) in stock.items():
        shelves.setdefault(amount, []).append((day, counterpart))
    for shelf in shelves.values():
        shelf.sort()
    claimed, won = set(), []
    for subject in sorted(offers.keys() | wanted.keys()):
        got = None
        for r in sorted(offers.get(subject, ())):
            free = offers[subject][r] - claimed
            if len(free) == 1:
                got = (subject, r, free.pop())
                break
        if got is None and subject in wanted:
            amount, day = wanted[subject]
            shelf = shelves.get(amount, [])
            first = bisect_left(shelf, (day - length,))
            if bisect_left(shelf, (day + 1,)) - first == 1:
                got = (subject, rank, shelf[first][1])
        if got:
            won.append(got)
            claimed.add(got[2])
            if got[2] in stock:
                amount, day = stock[got[2]]
                shelf = shelves[amount]
                del shelf[bisect_left(shelf, (day, got[2]))]
    return won


def _round(now: DataFrame, ranks: list[int], n: int) -> DataFrame:
    """One round: the rows of new winners (``won``), and of what stays open.

    now: edges with ``may`` (the subject may still claim the counterpart by this rule) and ``won``.
    Where a hub may be among ``n`` edges, the two small tables that edges are joined with are written
    first, so that adaptive execution splits the joins.
    """
    claims = now.groupBy("counterpart_id").agg(F.min(F.when(F.col("may") & ~F.col("won"), F.col("subject_id"))).alias("first"), F.max("won").alias("gone"))
    claims = written(claims) if n >= MANY else claims
    sure = F.col("first").isNull() | (F.col("subject_id") <= F.col("first"))
    rows = now.where("not won").join(claims, "counterpart_id").where("not gone").select("subject_id", "rank", "rule", "counterpart_id", sure.alias("sure"))
    counts = [x for r in ranks for mine in [F.col("rank") == r] for x in (F.count(F.when(mine, 1)).alias(f"all{r}"), F.count(F.when(mine & F.col("sure"), 1)).alias(f"sure{r}"), F.min(F.when(mine & F.col("sure"), F.col("counterpart_id"))).alias(f"one{r}"))]
    held = rows.groupBy("subject_id").agg(*counts)
    dead = {r: (F.col(f"all{r}") == 0) | (F.col(f"sure{r}") > 1) for r in ranks}
    alone = {r: (F.col(f"all{r}") == 1) & (F.col(f"sure{r}") == 1) for r in ranks}

    def first_of(kind: dict[int, Column], *, otherwise: int | None) -> Column:
        return F.coalesce(*[F.when(kind[r], F.lit(r)) for r in ranks], F.lit(otherwise).cast("int"))

    next_, last = first_of({r: ~dead[r] for r in ranks}, otherwise=None), first_of(alone, otherwise=ranks[-1])
    pick = F.coalesce(*[F.when((F.col("next") == r) & alone[r], F.col(f"one{r}")) for r in ranks])
    struck = F.array_compact(F.array(*[F.when(dead[r], F.lit(r)) for r in ranks]))
    settled = F.array_compact(F.array(*[F.when(F.col(f"sure{r}") == 1, F.lit(r)) for r in ranks]))
    verdict = held.withColumn("next", next_).select("subject_id", "next", last.alias("last"), pick.alias("pick"), struck.alias("struck"), settled.alias("settled")).where("next is not null")
    verdict = written(verdict) if n >= MANY else verdict
    won = F.col("pick").isNotNull()
    kept = F.when(won, (F.col("rank") == F.col("next")) & (F.col("counterpart_id") == F.col("pick"))).otherwise((F.col("rank") <= F.col("last")) & ~F.array_contains("struck", F.col("rank")))
    may = F.col("sure") | ~F.array_contains("settled", F.col("rank"))
    return rows.join(verdict, "subject_id").where(kept).select("subject_id", "rank", "rule", "counterpart_id", may.alias("may"), won.alias("won"))


def _sliced(now: DataFrame, n: int) -> DataFrame:
    """``now`` with the first SLICE edges in subject order settled in one task; a subject is taken whole or not at all."""
    taken = now.where("won").select("counterpart_id")
    left = now.where("not won").join(taken, "counterpart_id", "left_anti")
    head = left.select("subject_id").orderBy("subject_id").limit(SLICE).agg(F.min("subject_id").alias("a"), F.max("subject_id").alias("b")).head()
    if head["a"] is None or n > SLICE and head["a"] == head["b"]:
        return left  # the next round settles the very first subject
    inside, names = F.col("subject_id") < head["b"] if n > SLICE else F.lit(True), now.columns

    def solve(batches):
        table = pa.Table.from_batches(list(batches)).to_pydict()
        rules = dict(zip(table["rank"], table["rule"], strict=True))
        won = [(s, r, rules[r], c, True, True) for s, r, c in greedy(list(zip(table["subject_id"], table["rank"], table["counterpart_id"], strict=True)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*won, strict=True)) or [[]] * 6, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=names)

    won = left.where(inside).coalesce(1).mapInArrow(solve, now.schema)
    return won.unionByName(left.where(~inside))


def settle(edges: DataFrame) -> DataFrame:
    """Winning edges of subject_id, rank, rule, counterpart_id."""
    now = written(edges.select("subject_id", F.col("rank").cast("int").alias("rank"), "rule", "counterpart_id").distinct().withColumns({"may": F.lit(True), "won": F.lit(False)}))
    size = now.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("rank")).alias("ranks")).head()  # as many ranks as rules
    n, ranks, steps, turn = size["n"], size["ranks"], [], 0
    while n:
        turn += 1
        after = written(_sliced(now, n) if turn % (ROUNDS + 1) == 0 else _round(now, ranks, n))
        if not steps:
            discard(now)
        steps.append(after)
        now, n = after, after.where("not won").count()
    if not steps:
        return now.drop("may", "won")
    won = written(functools.reduce(DataFrame.unionByName, [x.where("won").drop("may", "won") for x in steps]))
    for x in steps:
        discard(x)
    return won


def _days(length: int, sign: int) -> Column:
    """``day`` and the ``length`` days after (sign 1) or before it (-1), one row each."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(length)), lambda i: F.col("day") + sign * i))


def latest_winners(firsts: dict[int, list[str]], subjects: dict[int, list[str]], length: int, top: int = TOP) -> dict[int, int]:
    """Per day, how many of its latest subjects may win by the window.

    firsts: per day of counterparts, the ids from which another rule may claim them, latest first;
    subjects: ids per day, latest first. Both hold the ``top`` latest; where all of a day's are
    taken, later ones beyond count as taken too.
    """
    size = dict.fromkeys(subjects, 0)
    seen, shut = {}, {}
    for day in subjects:
        lists = [firsts[x] for x in range(day - length, day + 1) if x in firsts]
        seen[day] = sorted(y for x in lists for y in x)
        shut[day] = max((x[1] for x in lists if len(x) > 1), default="")  # two of one day are always seen together
    todo = {day for day in subjects if seen[day]}
    while todo:
        day = todo.pop()
        ids, before = subjects[day], size[day]
        near = [e for e in range(day - length, day + length + 1) if e in size]
        while size[day] < len(ids) and (own := ids[size[day]]) > shut[day]:
            needed = len(seen[day]) - bisect_left(seen[day], own) - 1
            if needed > 0 and all(size[e] < top for e in near) and sum(t < own for e in near for t in subjects[e][: size[e]]) < needed:
                break
            size[day] += 1
        if size[day] > before:
            todo.update(e for e in near if e != day and seen[e])
    return size


def live_subjects(edges: DataFrame, window: DayWindow) -> DataFrame:
    """The window's subjects that may win by it: those of rare amounts, and the ones that :func:`latest_winners` leaves."""
    first = edges.groupBy("counterpart_id").agg(F.min("subject_id").alias("id"))
    common = window.subjects.groupBy("amount").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).select("amount")
    rows = window.rows.join(first, "counterpart_id", "left").select("amount", "day", F.lit("c").alias("kind"), F.coalesce("id", F.lit(NEVER)).alias("id"))
    both = rows.unionByName(window.subjects.select("amount", "day", F.lit("s").alias("kind"), F.col("subject_id").alias("id"))).join(common, "amount", "left_semi")
    latest = Window.partitionBy("amount", "day", "kind").orderBy(F.desc("id"))
    tops = both.withColumn("nth", F.row_number().over(latest)).where(F.col("nth") <= TOP).groupBy("amount", "day", "kind").agg(F.reverse(F.sort_array(F.collect_list("id"))).alias("ids"))
    length = window.length

    def narrow(part: dict[str, list]) -> list[tuple]:
        rows = list(zip(part["kind"], part["day"], part["ids"], strict=True))
        subjects = {d: x for k, d, x in rows if k == "s"}
        size = latest_winners({d: x for k, d, x in rows if k == "c"}, subjects, length)
        return [(part["amount"][0], d, "" if n == TOP else subjects[d][n - 1]) for d, n in size.items() if n]

    since = solve_runs(tops, "amount", [], narrow, "amount long, day int, since string")
    rare = window.subjects.join(common, "amount", "left_anti")
    return rare.unionByName(window.subjects.join(since, ["amount", "day"]).where("subject_id >= since").drop("since"))


def _in_window(window: DayWindow, live: DataFrame) -> DataFrame:
    """Edges of the window's rule for the subjects that may win by it."""
    sees = live.select("subject_id", "amount", _days(window.length, -1).alias("day"))
    return sees.join(window.rows, ["amount", "day"]).select("subject_id", F.lit(window.rank).alias("rank"), F.lit(window.rule).alias("rule"), "counterpart_id")


def greedy_assign(edges: DataFrame, window: DayWindow | None = None) -> DataFrame:
    """subject_id, rank, rule, counterpart_id (candidate edges), and a last rule by ``window`` -> at most one row per subject and counterpart."""
    edges = edges.select("subject_id", "rank", "rule", "counterpart_id")
    if window is None:
        return _dressed(settle(edges))
    known = F.col("amount").isNotNull() & F.col("day").isNotNull()
    window = replace(window, subjects=written(window.subjects.where(known)), rows=written(window.rows.where(known)))
    edges = written(edges.distinct())
    won = settle(edges.unionByName(_in_window(window, live_subjects(edges, window))))
    for x in (edges, window.subjects, window.rows):
        discard(x)
    return _dressed(won)


def _dressed(won: DataFrame) -> DataFrame:
    return won.select("subject_id", "counterpart_id", F.lit("l2_fuzzy").alias("layer"), "rule", confidence_for(F.col("rule")).alias("confidence"))
