"""The solver against a brute-force one, and its behaviour at the edges."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkcurves.operators import bootstrap as B
from sparkcurves.operators import checks as K
from sparkcurves.operators import pillars as P
from sparkcurves.operators import schedules as S
from sparkcurves.operators.interpolation import gathered, interpolate, log_df_at
from tests.test_dates import py_months, py_roll
from tests.test_fixtures import QUOTE_SCHEMA

PILLARS = [("1D", "OverNight"), ("2D", "OverNight"), ("1M", "Cash"), ("3M", "Cash"), ("6M", "Cash"), ("9M", "Cash"),
           ("15M", "Bond"), ("2Y", "Bond"), ("30M", "Bond"), ("5Y", "Bond"), ("7Y", "Bond"), ("12Y", "Bond"), ("30Y", "Bond")]
MONTHS = {"Monthly": 1, "Quarterly": 3, "SemiAnnual": 6, "Annual": 12}


def tenor_months(tenor):
    return int(tenor[:-1]) * (12 if tenor[-1] == "Y" else 1)


def brute_curve(date, rates, frequency):
    """Pillars one by one; each bond repriced in full inside a bisection."""
    night = py_roll(date + dt.timedelta(days=1))
    spot = py_roll(night + dt.timedelta(days=1))
    curve = []

    def at(points, day):
        points = sorted(points)
        if day <= points[0][0]:
            return points[0][1]
        for (t0, f0), (t1, f1) in zip(points, points[1:]):
            if t0 <= day <= t1:
                return math.exp(math.log(f0) + (math.log(f1) - math.log(f0)) * (day - t0) / (t1 - t0))
        return points[-1][1]

    for (tenor, kind), rate in zip(PILLARS, rates):
        if tenor == "1D":
            curve.append(((night - date).days, 1 / (1 + rate * (night - date).days / 360)))
        elif tenor == "2D":
            curve.append(((spot - date).days, curve[0][1] / (1 + rate * (spot - night).days / 360)))
        else:
            end = py_roll(py_months(spot, tenor_months(tenor)))
            days = (end - spot).days
            if kind == "Cash":
                curve.append((days, 1 / (1 + rate * days / 360)))
                continue
            step = MONTHS[frequency]
            dates = [py_roll(py_months(spot, k * step)) for k in range(1, 1 + -(-tenor_months(tenor) // step))][:-1] + [end]

            def worth(df):
                trial, value, before = curve + [(days, df)], 0.0, spot
                for d in dates:
                    value += rate * (d - before).days / 360 * at(trial, (d - spot).days)
                    before = d
                return value + df - 1.0

            low, high = 1e-6, 5.0
            for _ in range(200):
                middle = (low + high) / 2
                low, high = (middle, high) if worth(middle) < 0 else (low, middle)
            curve.append((days, (low + high) / 2))
    return curve


@pytest.mark.parametrize("frequency", list(MONTHS))
def test_against_bisection(spark, frequency):
    random.seed(frequency)
    dates = [dt.date(2019, 1, 1) + dt.timedelta(days=random.randrange(800)) for _ in range(12)] + [dt.date(2020, 1, 31), dt.date(2020, 2, 28)]
    rates = {d: [random.uniform(-0.005, 0.06) for _ in PILLARS] for d in dates}
    rows = [
        ("c", d, i, tenor, kind, r, False)
        for d in rates for i, ((tenor, kind), r) in enumerate(zip(PILLARS, rates[d]), start=1)
    ]
    rules = P.CurveRules(frequency=frequency)
    solved = B.bootstrap(B.prepare(spark.createDataFrame(rows, QUOTE_SCHEMA), rules), rules)
    got = {(r["val_date"], r["pos"]): r for r in solved.collect()}
    assert all(r["converged"] for r in got.values())
    for d in rates:
        for pos, (days, df) in enumerate(brute_curve(d, rates[d], frequency), start=1):
            assert got[d, pos]["days"] == days
            assert got[d, pos]["df"] == pytest.approx(df, abs=1e-12), (d, pos)


def test_flat_curve_in_flat_curve_out(spark):
    """Equal rates in: every bond factor is the annuity recursion of that one rate."""
    date, rate = dt.date(2020, 1, 31), 0.03
    pillars = [("1D", "OverNight"), ("2D", "OverNight")] + [(f"{y}Y", "Bond") for y in range(1, 11)]
    rows = [("c", date, i, t, k, rate, False) for i, (t, k) in enumerate(pillars, start=1)]
    solved = B.bootstrap(B.prepare(spark.createDataFrame(rows, QUOTE_SCHEMA), P.OIS), P.OIS).orderBy("pos").collect()
    spot, annuity = solved[0]["spot_date"], 0.0
    before = spot
    for r in solved[2:]:
        tau = (r["end_date"] - before).days / 360
        df = (1 - rate * annuity) / (1 + rate * tau)
        assert r["df"] == pytest.approx(df, abs=1e-14)
        annuity, before = annuity + tau * df, r["end_date"]
    factors = [r["df"] for r in solved[1:]]
    assert factors == sorted(factors, reverse=True)


def test_missing_quotes_become_zero_rates(spark):
    date = dt.date(2020, 1, 31)
    quotes = spark.createDataFrame([("c", date, "1D", 0.01), ("c", date, "2Y", 0.02)], "curve_id STRING, val_date DATE, tenor STRING, mid DOUBLE")
    pillars = ((1, "1D", "OverNight"), (2, "2D", "OverNight"), (3, "1Y", "Bond"), (4, "2Y", "Bond"))
    rows = {r["tenor"]: r for r in B.bootstrap(B.prepare(P.definition_join(quotes, pillars), P.OIS), P.OIS).collect()}
    assert [rows[t]["is_missing"] for t in ("1D", "2D", "1Y", "2Y")] == [False, True, True, False]
    assert rows["2D"]["df"] == rows["1D"]["df"] and rows["1Y"]["df"] == 1.0
    assert rows["2Y"]["converged"] and rows["2Y"]["df"] < 1


def test_repeated_tenor_keeps_the_first_quote(spark):
    """Thousands of later quotes of the same tenor change nothing and are combined before the shuffle."""
    date = dt.date(2020, 1, 31)
    once = [("c", date, i, t, k, 0.02, False) for i, (t, k) in enumerate(PILLARS, start=1)]
    again = [("c", date, 100 + i, PILLARS[i % len(PILLARS)][0], PILLARS[i % len(PILLARS)][1], 0.5, False) for i in range(3000)]
    quotes = P.first_quotes(spark.createDataFrame(again + once, QUOTE_SCHEMA))
    assert sorted(map(tuple, quotes.collect()), key=lambda r: r[2]) == once
    solved = B.bootstrap(B.prepare(quotes, P.OIS), P.OIS)
    alone = B.bootstrap(B.prepare(spark.createDataFrame(once, QUOTE_SCHEMA), P.OIS), P.OIS)
    assert [r["df"] for r in solved.orderBy("pos").collect()] == [r["df"] for r in alone.orderBy("pos").collect()]


def test_unsolvable_pillar_is_flagged(spark):
    """Coupons already worth more than the target leave no positive factor: NULL, not a crash."""
    date = dt.date(2020, 1, 31)
    rows = [("c", date, i, t, k, r, False) for i, (t, k, r) in enumerate(
        [("1D", "OverNight", 0.0), ("2D", "OverNight", 0.0), ("1Y", "Bond", 0.0), ("2Y", "Bond", 1.5)], start=1)]
    got = B.bootstrap(B.prepare(spark.createDataFrame(rows, QUOTE_SCHEMA), P.OIS), P.OIS).orderBy("pos").collect()
    assert got[3]["df"] is None and not got[3]["converged"]
    assert all(r["converged"] for r in got[:3])


def test_residual_check_sees_a_wrong_factor(spark):
    date = dt.date(2020, 1, 31)
    rows = [("c", date, i, t, k, 0.02, False) for i, (t, k) in enumerate(PILLARS, start=1)]
    curve = B.bootstrap(B.prepare(spark.createDataFrame(rows, QUOTE_SCHEMA), P.OIS), P.OIS)
    bonds = sum(k == "Bond" for _, k in PILLARS)
    good = K.residual_summary(K.bond_residuals(curve, P.OIS)).first()
    assert (good["pillars"], good["repriced"]) == (bonds, bonds)
    bent = curve.withColumn("df", F.when(F.col("tenor") == "30Y", F.col("df") * 1.0001).otherwise(F.col("df")))
    assert K.residual_summary(K.bond_residuals(bent, P.OIS)).first()["repriced"] == bonds - 1


def test_interpolation(spark):
    curve_rows = [("c", dt.date(2020, 1, 1), d, f) for d, f in ((1, 0.9999), (30, 0.998), (365, 0.97), (3650, 0.7))]
    curve = spark.createDataFrame(curve_rows, "curve_id STRING, val_date DATE, days INT, df DOUBLE")
    days = [-5, 0, 1, 2, 29, 30, 31, 200, 365, 1000, 3649, 3650, 3651, 9999]
    points = spark.createDataFrame([("c", dt.date(2020, 1, 1), d) for d in days], "curve_id STRING, val_date DATE, day INT")
    joined = {r["day"]: r for r in interpolate(points, curve, linear=True).collect()}
    salted = {r["day"]: r for r in interpolate(points, curve, spread="day").collect()}
    arrays = {
        r["day"]: math.exp(r["l"]) for r in
        points.join(gathered(curve), ["curve_id", "val_date"]).select("day", log_df_at(F.col("points"), F.col("day")).alias("l")).collect()
    }
    knots = [(d, f) for _, _, d, f in curve_rows]
    for day in days:
        if day <= 1 or day >= 3650:
            log_linear = linear = knots[0][1] if day <= 1 else knots[-1][1]
        else:
            (t0, f0), (t1, f1) = next((a, b) for a, b in zip(knots, knots[1:]) if a[0] <= day <= b[0])
            w = (day - t0) / (t1 - t0)
            log_linear, linear = math.exp(math.log(f0) * (1 - w) + math.log(f1) * w), f0 * (1 - w) + f1 * w
        assert joined[day]["df"] == pytest.approx(log_linear, abs=1e-14)
        assert joined[day]["df_linear"] == pytest.approx(linear, abs=1e-14)
        assert salted[day]["df"] == joined[day]["df"]
        assert arrays[day] == pytest.approx(log_linear, abs=1e-14)
    assert [joined[d]["df"] for d, _ in knots] == [f for _, f in knots]


def test_schedule_chains(spark):
    """The start of every period is the end of the one before, whatever the frequency."""
    loans = spark.createDataFrame(
        [(i, dt.date(2020, 1, 25) + dt.timedelta(days=i), t) for i in range(20) for t in ("18M", "3Y", "1Y")],
        "id INT, start_date DATE, tenor STRING",
    )
    for cal in ("USD", "MXN"):
        for frequency in MONTHS:
            rows = S.chained_starts(S.bond_schedule(S.with_maturity(loans, cal), frequency, calendar=cal), ["id", "tenor"])
            for r in rows.collect():
                assert (r["chained_start"] or r["start_date"]) == r["period_start"]
                assert r["k"] < r["n"] or r["period_end"] == r["maturity"]


@pytest.mark.parametrize("rate", [-0.02, 0.5, 0.8, 1.2])
def test_long_gaps_at_high_rates(spark, rate):
    date = dt.date(2020, 1, 31)
    pillars = [("1D", "OverNight"), ("2D", "OverNight"), ("1Y", "Bond"), ("30Y", "Bond"), ("50Y", "Bond")]
    rows = [("x", date, i, tenor, kind, rate, False) for i, (tenor, kind) in enumerate(pillars, 1)]
    got = B.bootstrap(B.prepare(spark.createDataFrame(rows, QUOTE_SCHEMA), P.OIS), P.OIS).orderBy("pos").collect()
    assert all(r["converged"] and abs(r["residual"]) <= 1e-10 for r in got)
    assert all(a["df"] > b["df"] > 0 for a, b in zip(got, got[1:])) == (rate > 0)


def test_definition_join_takes_the_first_of_repeated_tenors(spark):
    rows = [("x", dt.date(2020, 1, 31), pos, tenor, "Cash", rate, False) for pos, tenor, rate in [(3, "1M", 0.3), (1, "1M", 0.1), (2, "3M", 0.2)]]
    quotes = spark.createDataFrame(rows, QUOTE_SCHEMA)
    got = P.definition_join(quotes, ((1, "1M", "Cash"), (2, "3M", "Cash"), (3, "6M", "Cash")), "rate").collect()
    assert {r["tenor"]: (r["rate"], r["is_missing"]) for r in got} == {"1M": (0.1, False), "3M": (0.2, False), "6M": (0.0, True)}


def test_points_without_a_curve_keep_their_row(spark):
    date = dt.date(2020, 1, 31)
    curve = spark.createDataFrame([(1, date, 10, 0.9), (1, date, 20, 0.8)], "curve_id int, val_date date, days int, df double")
    points = spark.createDataFrame([(1, date, 15), (2, date, 15)], "curve_id int, val_date date, day int")
    for spread in (None, "day"):
        got = {r["curve_id"]: r["df"] for r in interpolate(points, curve, spread=spread).collect()}
        assert got[2] is None and got[1] == pytest.approx(math.sqrt(0.72))
