"""Calendar and accrual expressions against day-by-day Python on many dates."""

import calendar
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkcurves.functions import accrual as A
from sparkcurves.functions import dates as D

random.seed(7)
DAYS = [dt.date(1995, 1, 1) + dt.timedelta(days=random.randrange(20000)) for _ in range(400)]
DAYS += [dt.date(2020, 1, 31), dt.date(2020, 2, 29), dt.date(2019, 12, 31), dt.date(2021, 8, 31), dt.date(2000, 2, 28)]
PAIRS = [(a, a + dt.timedelta(days=random.randrange(1, 4000))) for a in DAYS]


def py_roll(d):
    while d.weekday() > 4:
        d += dt.timedelta(days=1)
    return d


def py_months(d, n):
    month = d.year * 12 + d.month - 1 + n
    year, month = divmod(month, 12)
    return dt.date(year, month + 1, min(d.day, calendar.monthrange(year, month + 1)[1]))


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "a DATE, b DATE")


def column(df, expression):
    return [tuple(r) for r in df.select("a", "b", expression.alias("x")).collect()]


def test_roll_and_back(pairs):
    for a, _, x in column(pairs, D.roll(F.col("a"))):
        assert x == py_roll(a)
    for a, _, x in column(pairs, D.roll(D.roll(F.col("a")))):
        assert x == py_roll(a)
    for a, _, x in column(pairs, D.roll_back(F.col("a"))):
        assert x <= a and x.weekday() < 5 and (a - x).days < 3


@pytest.mark.parametrize("frequency,months", [("Monthly", 1), ("Quarterly", 3), ("SemiAnnual", 6), ("Annual", 12)])
def test_shift_and_periods(pairs, frequency, months):
    for a, _, x in column(pairs, D.shift(F.col("a"), frequency, F.lit(5), "USD")):
        assert x == py_months(a, 5 * months)
    for a, b, k in column(pairs, D.periods_up_to(F.col("a"), F.col("b"), frequency, "USD")):
        def pay(i):
            return a if i == 0 else py_roll(py_months(a, i * months))
        assert pay(k) <= b < pay(k + 1)
    step = D.PERIOD_DAYS_MXN[frequency]
    for a, b, k in column(pairs, D.periods_up_to(F.col("a"), F.col("b"), frequency, "MXN")):
        def pay_mxn(i):
            return a if i == 0 else py_roll(a + dt.timedelta(days=i * step))
        assert pay_mxn(k) <= b < pay_mxn(k + 1)


def test_short_shifts_ignore_the_calendar(pairs):
    for cal in ("USD", "MXN"):
        for a, _, x in column(pairs, D.shift(F.col("a"), "Weekly", F.lit(3), cal)):
            assert x == a + dt.timedelta(days=21)
        for a, _, x in column(pairs, D.shift(F.col("a"), "Daily", F.lit(3), cal)):
            assert x == a + dt.timedelta(days=3)


def test_third_wednesday(pairs):
    for a, _, x in column(pairs, D.third_wednesday(F.trunc("a", "month"))):
        wednesdays = [d for d in (a.replace(day=1) + dt.timedelta(days=i) for i in range(28)) if d.weekday() == 2]
        assert x == wednesdays[2]


def test_payment_counts(pairs):
    def whole(a, b):
        return b.year - a.year, b.month - a.month

    rules = {
        "Annual": lambda y, m: y + math.ceil(m / 12),
        "SemiAnnual": lambda y, m: 2 * y + math.ceil(m / 6),
        "Monthly": lambda y, m: 12 * y + m,
        "Quarterly": lambda y, m: 4 * y + round(m / 4),  # Python rounds half to even too
    }
    for name, rule in rules.items():
        for a, b, n in column(pairs, D.payment_count(name, F.col("a"), F.col("b"))):
            assert n == rule(*whole(a, b)), (name, a, b)


def test_day_counts(pairs):
    for a, b, x in column(pairs, A.year_fraction("ACT/365F", F.col("a"), F.col("b"))):
        assert x == (b - a).days / 365
    usual = column(pairs, A.year_fraction("30/360", F.col("a"), F.col("b")))
    european = column(pairs, A.year_fraction("30E/360", F.col("a"), F.col("b")))
    for (a, b, x), (_, _, y) in zip(usual, european):
        if a.day < 31 and b.day < 31:
            assert x == y == (360 * (b.year - a.year) + 30 * (b.month - a.month) + b.day - a.day) / 360
        assert 0 <= x - y <= 1 / 360 + 1e-12


def test_conventions_in_a_column(pairs):
    named = pairs.withColumn("c", F.when(F.dayofmonth("a") % 2 == 0, "ACT/360").otherwise("30E/360"))
    rows = named.select(
        A.year_fraction(F.col("c"), F.col("a"), F.col("b")).alias("by_column"),
        F.when(F.col("c") == "ACT/360", A.year_fraction("ACT/360", F.col("a"), F.col("b")))
        .otherwise(A.year_fraction("30E/360", F.col("a"), F.col("b"))).alias("by_name"),
    ).collect()
    assert all(r["by_column"] == r["by_name"] for r in rows)


TENORS = {
    "1D": (dt.date(2020, 2, 1), dt.date(2020, 2, 1)), "2W": (dt.date(2020, 2, 14), dt.date(2020, 2, 14)),
    "1M": (dt.date(2020, 2, 29), dt.date(2020, 2, 28)), "1Q": (dt.date(2020, 4, 30), dt.date(2020, 5, 2)),
    "1S": (dt.date(2020, 7, 31), dt.date(2020, 7, 31)), "1Y": (dt.date(2021, 1, 31), dt.date(2021, 1, 29)),
    "32.5Y": (dt.date(2052, 7, 31), dt.date(2020, 1, 31) + dt.timedelta(days=65 * 182)), "0.3M": (None, None), "ON": (None, None), "ED1": (None, None),
}


def test_tenors(spark):
    rows = D.with_parsed_tenor(spark.createDataFrame([(t,) for t in TENORS], "tenor STRING"))
    start = F.lit(dt.date(2020, 1, 31))
    got = {r[0]: (r[1], r[2]) for r in rows.select("tenor", D.tenor_end(start, "USD"), D.tenor_end(start, "MXN")).collect()}
    assert got == TENORS
    known = spark.range(1).select(*[F.struct(*[v.alias(k) for k, v in D.tenor_parts(t).items()]).alias(t.replace(".", "_")) for t in TENORS]).first()
    for r in rows.collect():
        fixed = known[r["tenor"].replace(".", "_")]
        assert all(fixed[c] == r[c] for c in ("tenor_number", "tenor_unit")), r
        if r["tenor_unit"] is not None:
            assert all(fixed[c] == r[c] for c in ("usd_months", "usd_days", "mxn_days")), r


def test_settlement(spark):
    friday = spark.createDataFrame([(dt.date(2020, 5, 29),)], "d DATE")
    d = F.col("d")
    row = friday.select(
        D.overnight_date(d, "after_overnight"), D.spot_date(d, "after_overnight"), D.spot_date(d, "two_days"),
        D.overnight_date(d, "same_day"), D.spot_date(d, "same_day"), *D.settlement_pair(d, F.lit(2)), *D.settlement_pair(d, F.lit(0)),
    ).first()
    june = [dt.date(2020, 6, n) for n in range(1, 4)]
    assert list(row) == [june[0], june[1], june[0], dt.date(2020, 5, 30), dt.date(2020, 5, 29), june[0], june[0], june[0], dt.date(2020, 5, 29)]


def test_a_frequency_without_a_rule_has_no_payment_count(spark):
    rows = spark.createDataFrame([(f,) for f in ("Annual", "Weekly", None)], "f string")
    start, end = F.lit("2020-01-01").cast("date"), F.lit("2025-01-01").cast("date")
    got = {r["f"]: r["n"] for r in rows.select("f", D.schedule_count(F.col("f"), start, end).alias("n")).collect()}
    assert got == {"Annual": 5, "Weekly": None, None: None}
