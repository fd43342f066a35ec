"""Bank working days in India."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Bank holidays of 2026.
HOLIDAYS = tuple(date(2026, m, d) for m, d in ((1, 26), (3, 4), (3, 20), (4, 1), (4, 3), (4, 14), (5, 1), (5, 27), (8, 15), (10, 2), (11, 8), (12, 25)))


def is_second_or_fourth_saturday(day: Column) -> Column:
    return (F.dayofweek(day) == 7) & F.floor((F.dayofmonth(day) - 1) / 7 + 1).isin(2, 4)


def is_bank_holiday(day: Column) -> Column:
    return (F.dayofweek(day) == 1) | is_second_or_fourth_saturday(day) | day.isin(*HOLIDAYS)


def is_business_day(day: Column) -> Column:
    return ~is_bank_holiday(day)


def business_calendar(spark: SparkSession, first: date, last: date) -> DataFrame:
    """day, open, number: a row per day with the count of working days up to it. A few thousand rows at most."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day")).withColumn("open", is_business_day(F.col("day")))
    return days.withColumn("number", F.sum(F.col("open").cast("int")).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def add_business_days(rows: DataFrame, day: str, count: str, calendar: DataFrame, into: str) -> DataFrame:
    """``rows`` with the ``count``-th working day after ``day``; 0 leaves the day, below 0 raises."""
    start = F.broadcast(calendar.select(F.col("day").alias("_day"), F.col("number").alias("_number")))
    goal = F.broadcast(calendar.where("open").select(F.col("day").alias("_goal"), F.col("number").alias("_at")))
    n = F.when(F.col(count) < 0, F.raise_error(F.lit("count must not be negative")).cast("int")).otherwise(F.col(count))
    joined = rows.join(start, F.col(day) == F.col("_day"), "left").withColumn("_want", F.col("_number") + n)
    joined = joined.join(goal, F.col("_want") == F.col("_at"), "left")
    return joined.withColumn(into, F.when(F.col(count) == 0, F.col(day)).otherwise(F.col("_goal"))).drop("_day", "_number", "_want", "_goal", "_at")


def drift_days(captured: Column, settled: Column) -> Column:
    return F.datediff(settled, captured)


def weekend_drift(captured: Column, settled: Column, lag: int) -> Column:
    """Whether closed days came between: settled more than ``lag`` calendar days after capture."""
    return drift_days(captured, settled) > lag
