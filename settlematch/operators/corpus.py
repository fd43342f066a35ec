"""Corpora for evaluation: counts, shares, and splits that cut no component."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlematch.operators.components import components
from settlematch.operators.order import running_sum
from settlematch.operators.runs import solve_runs
from settlematch.operators.views import running_balance
from settlematch.storage import written


def corpus_counts(tables: dict[str, DataFrame], tags: DataFrame, batch_tags: DataFrame) -> DataFrame:
    """kind, name, n: rows per table, payments per own and per batch tag, and batches per tag."""
    out = tags.groupBy(F.concat(F.lit("tag_"), "kind").alias("kind"), F.col("tag").alias("name")).agg(F.count_distinct("payment_id").alias("n"))
    out = out.unionByName(batch_tags.groupBy(F.lit("tag_of_batches").alias("kind"), F.col("tag").alias("name")).agg(F.count_distinct("batch").alias("n")))
    for name, rows in tables.items():
        out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit("rows").alias("kind"), F.lit(name).alias("name"), "n"))
    return out


def defect_mix(truth: DataFrame, tags: DataFrame) -> DataFrame:
    """Share of each split's payments that carries each tag."""
    total = truth.groupBy("split").agg(F.count_distinct("payment_id").alias("payments"))
    per = tags.join(truth.select("payment_id", "split"), "payment_id").groupBy("split", "tag").agg(F.count_distinct("payment_id").alias("n"))
    return per.join(F.broadcast(total), "split").select("split", "tag", "n", F.round(F.col("n") / F.col("payments"), 6).alias("share"))  # one row per split


def distribution_gap(mix: DataFrame, first: str, second: str) -> DataFrame:
    """The tag whose share differs most between two splits (smallest name on ties), and the split with more of it."""
    a, b = (mix.where(F.col("split") == s).select("tag", F.col("share").alias(n)) for s, n in ((first, "a"), (second, "b")))
    both = a.join(b, "tag", "full_outer").select("tag", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    gap = F.round(F.abs(F.col("a") - F.col("b")), 6)
    return both.select("tag", gap.alias("gap"), F.when(F.col("a") > F.col("b"), first).otherwise(second).alias("harder")).orderBy(F.desc("gap"), "tag").limit(1)


def batch_components(payment_batches: DataFrame) -> DataFrame:
    """(payment_id, batch) -> batch, component: batches that share a payment belong together."""
    pairs = payment_batches.select("payment_id", F.col("batch").alias("a")).join(payment_batches.select("payment_id", F.col("batch").alias("b")), "payment_id").where("a < b").select("a", "b").distinct()
    found = components(pairs).select(F.col("node").alias("batch"), "component")
    return payment_batches.select("batch").distinct().join(found, "batch", "left").select("batch", F.coalesce("component", "batch").alias("component"))


def dealt(total: int, costs: dict[str, Callable[[int], float]]) -> dict[str, int]:
    """How many of ``total`` equal items each bin gets when every item goes where the cost after it is least (first name on ties).

    costs: of each bin with so many more items, never falling. Giving items one by one merges the
    bins' rising costs, so the counts are found by bisection of each bin's place in the merged order.
    """
    names = sorted(costs)

    def before(name: str, n: int) -> int:
        """Items of all bins that come before this bin's n-th."""
        own, count = costs[name](n), n - 1
        for other in names:
            if other != name:
                ahead = (lambda c: c <= own) if other < name else (lambda c: c < own)
                lo, hi = 0, total
                while lo < hi:
                    mid = (lo + hi + 1) // 2
                    lo, hi = (mid, hi) if ahead(costs[other](mid)) else (lo, mid - 1)
                count += lo
        return count

    out = {}
    for name in names:
        lo, hi = 0, total
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if before(name, mid) < total else (lo, mid - 1)
        out[name] = lo
    return out


def stratified_component_split(profile: DataFrame, quotas: dict[str, float], payment_weight: float = 8.0) -> DataFrame:
    """component, stratum, n -> component, split.

    Components, largest first, go to the split that is left least over its quota, by weighted
    squares of its fill. Components of one profile are alike, so the greedy rule is worked out on
    classes of equal profiles with their counts (:func:`dealt`): one small row per class reaches
    the task that runs it, so it grows with the kinds of components and not with their number.
    Within a class components take their splits in order of their ids, whose places are counted in
    ranges: a profile that nearly all components share is many tasks.
    """
    kind = dict(profile.dtypes)["component"]
    line = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "stratum", F.col("n").cast("string")))), ";")
    summed = profile.groupBy("component", "stratum").agg(F.sum("n").alias("n")).where("n > 0")
    rows = written(summed.groupBy("component").agg(line.alias("profile")))
    classes = rows.groupBy("profile").agg(F.count("*").alias("m")).withColumn("all", F.lit(1))

    def deal(part: dict[str, list]) -> list[tuple]:
        vectors = [{k: float(v) for k, v in (x.split("=") for x in p.split(";"))} for p in part["profile"]]
        total: dict[str, float] = {}
        for vector, m in zip(vectors, part["m"], strict=True):
            for k, v in vector.items():
                total[k] = total.get(k, 0.0) + v * m
        filled = {s: dict.fromkeys(total, 0.0) for s in quotas}
        out = []
        for i in sorted(range(len(vectors)), key=lambda i: (-vectors[i].get("payments", sum(vectors[i].values())), part["profile"][i])):

            def cost(split: str, n: int, vector: dict[str, float] = vectors[i]) -> float:
                return sum((payment_weight if k == "payments" else 1.0) * ((filled[split][k] + n * vector.get(k, 0.0)) / (t * quotas[split])) ** 2 for k, t in sorted(total.items()) if t * quotas[split] > 0)

            counts, at = dealt(part["m"][i], {s: functools.partial(cost, s) for s in quotas}), 0
            for split, n in sorted(counts.items()):
                if n:
                    out.append((part["profile"][i], at, at + n, split))
                    at += n
                    for k, v in vectors[i].items():
                        filled[split][k] += n * v
        return out

    plan = written(solve_runs(classes, "all", [], deal, "profile string, lo long, hi long, split string"))
    ranked = written(running_sum(rows, ["profile"], ["component"], F.lit(1), "rank").withColumn("rank", F.col("rank") - 1))
    return ranked.join(plan, "profile").where("rank >= lo and rank < hi").select(F.col("component").cast(kind).alias("component"), "split")


def deal_extras(rows: DataFrame, key: str, shares: dict[str, int], seed: int = 0) -> DataFrame:
    """``rows`` with a split drawn by a hash of the key, in proportion to integer shares."""
    total, at, split = sum(shares.values()), 0, None
    draw = F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(key)).cast("binary")), 1, 8), 16, 10).cast("long") % total
    for name, share in sorted(shares.items()):
        at += share
        split = F.when(draw < at, name) if split is None else split.when(draw < at, name)
    return rows.withColumn("split", split)


def apply_split(tables: dict[str, DataFrame], batch_split: DataFrame, links: dict[str, DataFrame], extras: dict[str, DataFrame], opening: int) -> dict[str, DataFrame]:
    """The tables of every split, told apart by ``split``.

    Report rows follow their batch (``batch_split``: settlement_id, split). Credits follow the batch
    that they pay (``links["bank"]``: settlement_id, txn_id), and each split's statement has a
    balance of its own from ``opening`` on. Invoices follow the payments that ride in a split's
    batches (``links["invoices"]``: payment_id, invoice_id). ``extras`` (txn_id or invoice_id, split)
    are the dealt records without a batch.
    """
    gateway = tables["gateway"].join(batch_split, "settlement_id")
    riding = gateway.where("payment_id is not null").select("payment_id", "split").distinct()
    credits = links["bank"].join(batch_split, "settlement_id").select("txn_id", "split").unionByName(extras["bank"].select("txn_id", "split")).distinct()
    ledger = links["invoices"].join(riding, "payment_id").select("invoice_id", "split").unionByName(extras["invoices"].select("invoice_id", "split")).distinct()
    bank = running_balance(tables["bank"].join(credits, "txn_id"), opening, by=["split"])
    return {"gateway": gateway, "bank": bank, "invoices": tables["invoices"].join(ledger, "invoice_id")}


def propagate_batch_tags(payment_batches: DataFrame, batch_tags: DataFrame, never: tuple[str, ...] = ("no_bank_credit", "split_settlement")) -> DataFrame:
    """payment_id, tag: what a payment's batches carry, but for tags that do not pass on."""
    return payment_batches.join(batch_tags.where(~F.col("tag").isin(*never)), "batch").select("payment_id", "tag").distinct()


