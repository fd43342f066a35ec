import datetime as dt
import itertools
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from settlematch.functions import calendar, money, stats, text
from settlematch.functions.distance import distances


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize(("said", "paise"), [("1234.56", 123456), ("1,234.56", 123456), (" 1234.5 ", 123450), ("0.01", 1), ("(12.00)", -1200), ("₹99.99", 9999), ("n/a", None), ("", None)])
def test_parse_rupees(spark, said, paise):
    assert one(spark, money.parse_rupees(F.lit(said))) == paise


def test_blank_money_is_zero_and_junk_raises(spark):
    assert one(spark, money.money_or_zero(F.lit(" "))) == 0
    with pytest.raises(Exception, match="not an amount"):
        one(spark, money.money_or_zero(F.lit("x")))


def test_rounding(spark):
    assert one(spark, money.pct_of(F.lit(500), F.lit("0.5"))) == 3
    assert one(spark, money.pct_of(F.lit(500), F.lit("0.5"), half_even=True)) == 2
    assert one(spark, money.format_rupees(F.lit(-1205))) == "-12.05"


@pytest.mark.parametrize("gross", [45000, 99900, 123457, 25000000, 1])
@pytest.mark.parametrize(("fee", "tds"), [("0.90", "0"), ("2.36", "1"), ("1.80", "1"), ("2.00", "0")])
def test_gross_from_net(spark, gross, fee, tds):
    taken = money.pct_of(F.lit(gross), F.lit(fee))
    net = F.lit(gross) - taken - money.pct_of(taken, F.lit("18")) - money.pct_of(F.lit(gross), F.lit(tds))
    assert one(spark, money.reconstruct_gross(net, F.lit(fee), F.lit("18"), F.lit(tds))) == gross


def test_gross_needs_deductions_below_all(spark):
    with pytest.raises(Exception, match="100%"):
        one(spark, money.reconstruct_gross(F.lit(100), F.lit("120"), F.lit("18"), F.lit("0")))


def test_utr_tokens(spark):
    assert one(spark, text.extract_utrs(F.lit("NEFT-HDFC1234567-x icic123456789012 HDFC1234567"))) == ["ICIC123456789012", "HDFC1234567"]
    assert one(spark, text.extract_utrs(F.lit("nothing"))) == []
    assert one(spark, text.is_truncation_of(F.lit("HDFC567890123"), F.lit("HDFC567890123456"))) is True
    assert one(spark, text.is_truncation_of(F.lit("HDFC56"), F.lit("HDFC567890123456"))) is False
    assert one(spark, text.is_truncation_of(F.lit("HDFC567890123456"), F.lit("HDFC567890123456"))) is False


def test_edit_distance(spark):
    for a, b, want in (("HDFC566880316647", "HDFC566880316467", 1), ("abc", "xyz", 3), ("a", "abcdef", 3), ("", "", 0), ("ab", "ab", 0)):
        assert one(spark, text.damerau_levenshtein(F.lit(a), F.lit(b))) == want


def row_by_row(a, b, cap):
    """The table of distances, a row at a time."""
    older, old = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y))
            if older and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            new.append(best)
        older, old = old, new
    return min(old[-1], cap + 1)


def test_edit_distance_by_vectors_and_in_a_band(spark):
    rng = random.Random(11)

    def near(a):
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(a) + 1)
            a = rng.choice([a[:i] + rng.choice("abé🙂") + a[i:], a[:i] + a[i + 1 :], a[: max(i - 1, 0)] + a[i : i + 1] + a[max(i - 1, 0) : i] + a[i + 1 :]])
        return a

    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abcé🙂\n") for _ in range(rng.choice([0, 1, 2, 6, 20, 61, 62, 63, 64, 90])))
        pairs.append((a, near(a)))
        pairs.append((a[:12], "".join(rng.choice("abcé🙂\n") for _ in range(rng.randrange(14)))))
    for cap in (0, 2, 7):
        rows = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string").withColumn("d", text.damerau_levenshtein(F.col("a"), F.col("b"), cap))
        assert rows.schema["d"].dataType.simpleString() == "int"
        assert all(r["d"] == (None if r["a"] is None or r["b"] is None else row_by_row(r["a"], r["b"], cap)) for r in rows.collect()), cap
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_one_edit_agrees_with_the_distance(spark):
    words = ["".join(w) for n in range(4) for w in itertools.product("abc", repeat=n)]
    rows = spark.createDataFrame([(a, b) for a in words for b in words if len(a) == len(b)], "a string, b string")
    wrong = rows.where(text.one_edit_apart(F.col("a"), F.col("b")) != (text.damerau_levenshtein(F.col("a"), F.col("b")) == 1))
    assert wrong.count() == 0


def test_bank_calendar(spark):
    days = {"2026-01-10": False, "2026-01-24": False, "2026-01-03": True, "2026-01-17": True, "2026-01-31": True, "2026-01-26": False, "2026-01-25": False}
    for day, open_ in days.items():
        assert one(spark, calendar.is_business_day(F.lit(dt.date.fromisoformat(day)))) is open_
    cal = calendar.business_calendar(spark, dt.date(2026, 1, 1), dt.date(2026, 12, 31))
    rows = spark.createDataFrame([(dt.date(2026, 1, 23), 2), (dt.date(2026, 3, 3), 1), (dt.date(2026, 1, 26), 0)], "day date, n int")
    got = {r["day"]: r["due"] for r in calendar.add_business_days(rows, "day", "n", cal, "due").collect()}
    assert got == {dt.date(2026, 1, 23): dt.date(2026, 1, 28), dt.date(2026, 3, 3): dt.date(2026, 3, 5), dt.date(2026, 1, 26): dt.date(2026, 1, 26)}
    with pytest.raises(Exception, match="negative"):
        calendar.add_business_days(spark.createDataFrame([(dt.date(2026, 1, 23), -1)], "day date, n int"), "day", "n", cal, "due").collect()


def test_wilson_and_confidence(spark):
    low, high = stats.wilson_interval(F.lit(0), F.lit(0))
    assert (one(spark, low), one(spark, high)) == (0.0, 0.0)
    low, high = stats.wilson_interval(F.lit(50), F.lit(100))
    assert one(spark, low) == pytest.approx(0.4038, abs=1e-3)
    assert one(spark, high) == pytest.approx(0.5962, abs=1e-3)
    assert one(spark, stats.confidence_for(F.lit("l2_utr_fuzzy"))) == 0.95
    assert one(spark, stats.confidence_for(F.lit("?"))) == 0.5
    assert one(spark, stats.call_cost_usd(F.lit(1000), F.lit(10), F.lit(100), F.lit(8), F.lit(2.0), F.lit(5.0))) == pytest.approx((1020 * 2 + 50) / 1e6)


def test_distances_of_many_equal_those_of_one(spark):
    """Batches of pairs against the built-in functions, texts beyond a vector and nulls among them; 200,000 pairs take one pass of a vector each."""
    rng = random.Random(5)
    words = ["", "a", "ab\0", "order_00000000012345", "é€\U0001f600b", "x" * 62, "x" * 61 + "y", "x" * 63, "z" * 70 + "b"] + ["".join(rng.choice("abcé") for _ in range(rng.randrange(12))) for _ in range(40)]
    rows = [(x, y) for x in [*words, None] for y in [*words[::2], None]]
    for cap in (2, 30):
        got = spark.createDataFrame(rows, "a string, b string").select(text.damerau_levenshtein(F.col("a"), F.col("b"), cap).alias("one"), text.damerau_levenshtein_of_many(F.col("a"), F.col("b"), cap).alias("many")).collect()
        assert [r["one"] for r in got] == [r["many"] for r in got] and len({r["many"] for r in got}) > 3
    a, b = (pa.array([f"order_{rng.randrange(10**14):014}" for _ in range(200_000)]) for _ in range(2))
    began = time.process_time()
    assert distances(a, b).max() <= 14 and time.process_time() - began < 20
