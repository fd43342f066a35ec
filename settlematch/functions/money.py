"""Money as integer paise; decimals only at the file's edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_rupees(text: Column) -> Column:
    """Paise of a rupee string; null where it is no amount. Commas and the rupee sign are dropped, (x) is negative."""
    bare = F.regexp_replace(F.trim(text), "[,₹\\s]", "")
    negative = bare.rlike(r"^\(.*\)$")
    value = F.regexp_replace(bare, r"^\((.*)\)$", "$1").try_cast("decimal(38,10)")
    paise = F.round(value * 100, 0).cast("long")
    return F.when(negative, -paise).otherwise(paise)


def money_or_zero(text: Column) -> Column:
    """Source columns: blank is 0, anything else must parse."""
    blank = text.isNull() | (F.trim(text) == "")
    return F.when(blank, F.lit(0).cast("long")).otherwise(F.coalesce(parse_rupees(text), F.raise_error(F.concat(F.lit("not an amount: "), text)).cast("long")))


def format_rupees(paise: Column) -> Column:
    return (paise.cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string")


def pct_of(paise: Column, percent: Column, *, half_even: bool = False) -> Column:
    """A percentage of an amount in whole paise, halves up (away from zero) or to even."""
    exact = paise.cast("decimal(20,0)") * percent.cast("decimal(10,4)") / 100
    return (F.bround(exact, 0) if half_even else F.round(exact, 0)).cast("long")


def net_of(gross: Column, fee: Column, tax: Column, tds: Column) -> Column:
    return gross - fee - tax - tds


def reconstruct_gross(net: Column, fee_pct: Column, gst_pct: Column, tds_pct: Column) -> Column:
    """Gross from which rounded fee, tax on the fee and TDS leave ``net``; the nearest of nine guesses, smaller on ties."""
    fee, gst, tds = (x.cast("decimal(10,4)") for x in (fee_pct, gst_pct, tds_pct))
    kept = F.lit(1).cast("decimal(18,12)") - (fee / 100 + fee * gst / 10000 + tds / 100).cast("decimal(18,12)")
    rough = F.when(kept <= 0, F.raise_error(F.lit("deductions reach 100%")).cast("long")).otherwise(F.round(net.cast("decimal(20,0)") / kept, 0).cast("long"))

    def guess(step: Column) -> Column:
        gross = rough + step
        taken = pct_of(gross, fee_pct)
        left = net_of(gross, taken, pct_of(taken, gst_pct), pct_of(gross, tds_pct))
        return F.struct(F.abs(left - net).alias("miss"), step.alias("step"), gross.alias("gross"))

    return F.array_min(F.transform(F.sequence(F.lit(-4), F.lit(4)), guess))["gross"]
