"""Curves by tables: definitions, names of discount curves, levels, prices row by row, published tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkcurves.operators import bootstrap as B
from sparkcurves.operators import dependencies as N
from sparkcurves.operators import pillars as P
from sparkcurves.operators import pricing as R
from sparkcurves.operators import schedules as S
from sparkcurves.operators.interpolation import curve_lines
from sparkcurves.sources import files as IO
from tests.test_fixtures import QUOTE_SCHEMA

DATE = dt.date(2020, 1, 31)
DEFINITION = "curve_id STRING, pos INT, tenor STRING, type_rate STRING"
LISTS = {
    "short": [("1D", "OverNight"), ("3M", "Cash")],
    "long": [("1D", "OverNight"), ("2D", "OverNight"), ("6M", "Cash"), ("1Y", "Bond"), ("2Y", "Bond"), ("10Y", "Bond"), ("30Y", "Bond")],
    "other": [("1D", "OverNight"), ("1Y", "Bond"), ("3Y", "Bond")],
}


def definitions(spark, lists):
    return spark.createDataFrame([(c, i, t, k) for c, own in lists.items() for i, (t, k) in enumerate(own, 1)], DEFINITION)


def test_lists_of_different_lengths_are_those_of_single_curves(spark):
    tenors = sorted({t for own in LISTS.values() for t, _ in own})
    quotes = spark.createDataFrame([(c, DATE, t, 0.01 + 0.001 * i) for c in [*LISTS, "undefined"] for i, t in enumerate(tenors)],
                                   "curve_id STRING, val_date DATE, tenor STRING, mid DOUBLE")
    lags = {"short": 0, "long": 2, "other": 1}
    settings = spark.createDataFrame(list(lags.items()), "curve_id STRING, settlement INT")
    rules = P.CurveRules(settlement=F.col("settlement"))
    rows = P.definition_list_join(quotes, P.definition_lists(definitions(spark, LISTS)).join(settings, "curve_id"))
    got = {(r["curve_id"], r["pos"]): r for r in B.bootstrap(B.prepare(rows, rules), rules, ["settlement"]).collect()}
    assert len(got) == sum(map(len, LISTS.values())) and all(r["converged"] for r in got.values())
    for curve, own in LISTS.items():
        alone = P.CurveRules(settlement=F.lit(lags[curve]))
        literal = tuple((i, t, k) for i, (t, k) in enumerate(own, 1))
        single = B.bootstrap(B.prepare(P.definition_join(quotes.where(F.col("curve_id") == curve), literal), alone), alone).collect()
        assert {r["pos"]: (r["days"], r["df"]) for r in single} == {p: (r["days"], r["df"]) for (c, p), r in got.items() if c == curve}


def test_definitions_that_are_too_long_or_repeat_a_position_are_refused(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_PILLARS", 5)
    with pytest.raises(Exception, match="more than 5 pillars in the definition of curve long"):
        P.definition_lists(definitions(spark, LISTS)).collect()
    twice = spark.createDataFrame([("c", 1, "1D", "OverNight"), ("c", 1, "1Y", "Bond"), ("c", None, "2Y", "Bond")], DEFINITION)
    with pytest.raises(Exception, match="a position is defined twice for curve c"):
        P.definition_lists(twice).collect()


def links(spark, pairs):
    return spark.createDataFrame(pairs, "curve_id LONG, discount_id LONG")


def test_links_by_name(spark):
    info = spark.createDataFrame([(1, "a", "b"), (2, "b", "b"), (3, "c", "nobody"), (4, "b", None)], "id_curve LONG, name STRING, dsct_curve STRING")
    assert {r[0]: r[1] for r in N.discount_links(info).collect()} == {1: 2, 2: 2, 3: None, 4: None}


def test_levels_of_chains_and_rings(spark):
    chain = [(i, i - 1) for i in range(2, 40)] + [(1, 1), (50, 3), (60, None), (70, 99)]
    got = {r["curve_id"]: r["level"] for r in N.dependency_levels(links(spark, chain)).collect()}
    assert got == {i: i - 1 for i in range(1, 40)} | {50: 3, 60: 1, 70: 1}
    with pytest.raises(ValueError, match="ring"):
        N.dependency_levels(links(spark, [(1, 1), (2, 3), (3, 4), (4, 2), (5, 2)]))


def test_a_chain_of_three_is_solved_level_by_level(spark):
    pillars = [("ON", "OverNight"), ("TN", "OverNight"), ("3M", "Cash"), ("ED1", "Future"), ("ED2", "Future"), ("2Y", "Swap"), ("3Y", "Swap")]
    rows = [(c, DATE, i, t, k, 0.01 * c + 0.001 * i, False) for c in (2, 3, 4) for i, (t, k) in enumerate(pillars, 1)]
    quotes = spark.createDataFrame(rows, QUOTE_SCHEMA.replace("curve_id STRING", "curve_id LONG"))
    prepared = B.prepare(quotes, P.PROJECTION)
    roots = spark.createDataFrame([(1, DATE, d, 0.98 ** (d / 365)) for d in (1, 90, 365, 730, 1500)], "curve_id LONG, val_date DATE, days INT, df DOUBLE")
    got = N.bootstrap_by_level(roots, prepared, P.PROJECTION, links(spark, [(1, 1), (2, 1), (3, 2), (4, 99)]))
    found = {(r["curve_id"], r["pos"]): r for r in got.collect()}
    assert {c: {r["level"] for (x, _), r in found.items() if x == c} for c in (2, 3, 4)} == {2: {1}, 3: {2}, 4: {1}}
    assert all(r["converged"] for (c, _), r in found.items() if c != 4)
    assert all(r["df"] is None and not r["converged"] for (c, _), r in found.items() if c == 4 and r["type_rate"] == "Swap")
    second = spark.createDataFrame([(2, DATE, r["days"], r["df"]) for (c, _), r in found.items() if c == 2], roots.schema)
    alone = B.bootstrap_dual(prepared.where("curve_id = 3").withColumn("discount_id", F.lit(2).cast("long")), P.PROJECTION, second).collect()
    assert {r["pos"]: r["df"] for r in alone} == {p: r["df"] for (c, p), r in found.items() if c == 3}


def test_curves_share_the_discounted_dates_of_their_longest(spark):
    """A short and a long curve on one discount curve are solved as each would be alone; one on another, or on none, too."""
    short = [("ON", "OverNight"), ("TN", "OverNight"), ("3M", "Cash"), ("2Y", "Swap")]
    long = [*short, ("5Y", "Swap"), ("30Y", "Swap")]
    on = {1: (short, 8), 2: (long, 8), 3: (short, 9), 4: (long, None), 5: ([("ON", "OverNight"), ("TN", "OverNight")], 8)}
    rows = [(c, DATE, i, t, k, 0.01 + 0.001 * i, False) for c, (own, _) in on.items() for i, (t, k) in enumerate(own, 1)]
    prepared = B.prepare(spark.createDataFrame(rows, QUOTE_SCHEMA.replace("curve_id STRING", "curve_id LONG")), P.PROJECTION)
    prepared = prepared.join(links(spark, [(c, d) for c, (_, d) in on.items()]), "curve_id")
    discount = spark.createDataFrame([(c, DATE, d, base ** (d / 365)) for c, base in ((8, 0.98), (9, 0.96)) for d in (1, 90, 365, 1500, 12000)],
                                     "curve_id LONG, val_date DATE, days INT, df DOUBLE")
    together = {(r["curve_id"], r["pos"]): (r["df"], r["converged"]) for r in B.bootstrap_dual(prepared, P.PROJECTION, discount).collect()}
    assert len(together) == len(rows)
    for curve, (own, other) in on.items():
        alone = B.bootstrap_dual(prepared.where(F.col("curve_id") == curve), P.PROJECTION, discount).collect()
        assert {(curve, r["pos"]): (r["df"], r["converged"]) for r in alone} == {k: v for k, v in together.items() if k[0] == curve}
        assert all(together[curve, i][1] == (other is not None or k != "Swap") for i, (_, k) in enumerate(own, 1))
    gathered = B.gather_pillars(prepared, ["discount_id"])
    shared = B._shared_legs(gathered, P.PROJECTION, B.gathered(discount, "discount"), "SemiAnnual", "30/360").collect()
    assert sorted((r["discount_id"] or 0) for r in shared) == [0, 8, 9]


def book(spark, rows):
    frame = spark.createDataFrame(rows, "curve_id LONG, val_date DATE, start_date DATE, tenor STRING, rate DOUBLE, notional DOUBLE")
    return S.with_maturity(frame).withColumn("discount_id", F.lit(1).cast("long"))


def curve(spark):
    return spark.createDataFrame([(1, DATE, d, 0.97 ** (d / 365)) for d in (1, 30, 365, 1000, 4000)], "curve_id LONG, val_date DATE, days INT, df DOUBLE")


def test_equal_and_nearly_equal_loans_stay_apart(spark):
    alike = (1, DATE, DATE, "2Y", 0.02)
    loans = book(spark, [(*alike, 100.0), (*alike, 100.0), (*alike, 300.0), (7, DATE, DATE, "2Y", 0.02, 100.0)])
    lines = curve_lines(curve(spark))
    values = sorted(r["pv"] for r in R.bond_values(loans, lines, "SemiAnnual").where("curve_id = 1").collect())
    assert values[0] == values[1] and values[2] == pytest.approx(3 * values[0], rel=1e-12)
    flows = R.floating_flows(loans, lines).collect()
    forwards = {}
    for r in flows:
        forwards.setdefault((r["curve_id"], r["k"]), []).append((r["forward_rate"], r["amount"] and r["amount"] / r["notional"]))
    assert {k: len(v) for k, v in forwards.items()} == {(1, k): 3 for k in range(1, 9)} | {(7, k): 1 for k in range(1, 9)}
    assert all(f > 0 and (f, a) == pytest.approx(v[0]) for (c, _), v in forwards.items() if c == 1 for f, a in v)
    assert all(r["pv"] is None for r in R.floating_values(loans, lines, lines).where("curve_id = 7").collect())
    pv = {r["notional"]: r["pv"] for r in R.floating_values(loans, lines, lines).where("curve_id = 1").collect()}
    assert pv[100.0] == pytest.approx(100.0 * 0.97 ** 0, abs=0.5) and pv[300.0] == pytest.approx(3 * pv[100.0])


def test_a_hot_book_is_priced_by_many_tasks(spark):
    loans = book(spark, [(1, DATE, DATE, "2Y", 0.02, 100.0)] * 20_000)
    values = R.bond_values(loans, curve_lines(curve(spark)), "SemiAnnual").withColumn("task", F.spark_partition_id())
    tasks = [r["count"] for r in values.groupBy("task").count().collect()]
    assert sum(tasks) == 20_000 and len(tasks) >= 4 and max(tasks) < 10_000


@pytest.mark.parametrize("frequency", ["Annual", "Monthly"])
def test_any_rate_has_a_root_or_none(spark, frequency):
    pillars = [("1D", "OverNight"), ("2D", "OverNight"), ("1Y", "Bond"), ("30Y", "Bond"), ("50Y", "Bond")]
    rows = [(str(r), DATE, i, t, k, r, False) for r in (-0.02, 0.0, 0.5, 1.2, 4.0, 20.0) for i, (t, k) in enumerate(pillars, 1)]
    rules = P.CurveRules(frequency=frequency)
    for r in B.bootstrap(B.prepare(spark.createDataFrame(rows, QUOTE_SCHEMA), rules), rules).collect():
        assert r["df"] is None or r["df"] > 0
        assert r["converged"] == (r["df"] is not None) and (r["residual"] is None or abs(r["residual"]) <= 1e-10)
        assert r["converged"] or (float(r["curve_id"]) >= 4 and r["tenor"] == "50Y")


def test_what_follows_an_unsolved_pillar_is_unsolved(spark):
    rates = [("1D", "OverNight", 0.0), ("2D", "OverNight", 0.0), ("1Y", "Bond", 0.0), ("2Y", "Bond", 1.5), ("3Y", "Bond", 0.01), ("5Y", "Bond", 0.01)]
    rows = [("c", DATE, i, t, k, r, False) for i, (t, k, r) in enumerate(rates, 1)]
    got = B.bootstrap(B.prepare(spark.createDataFrame(rows, QUOTE_SCHEMA), P.OIS), P.OIS).orderBy("pos").collect()
    assert [r["converged"] for r in got] == [True] * 3 + [False] * 3 and all(r["df"] is None for r in got[3:])


def test_published_tables(spark):
    good = spark.createDataFrame([(1, "a"), (2, "b")], "id LONG, name STRING")
    IO.publish_table(good, ["id"], "published_settings")
    for bad in ([(1, "a"), (1, "c")], [(3, None)], [(None, "x")]):
        with pytest.raises(ValueError, match="published_settings"):
            IO.publish_table(spark.createDataFrame(bad, good.schema), ["id"], "published_settings")
    assert sorted(map(tuple, spark.table("published_settings").collect())) == [(1, "a"), (2, "b")]
    IO.publish_table(good.where("id = 2"), ["id"], "published_settings")
    assert spark.table("published_settings").count() == 1 and not [t for t in spark.catalog.listTables() if "staged" in t.name]
    spark.sql("DROP TABLE published_settings")


def test_quote_files_by_any_name(spark, tmp_path):
    for name in ("bidaskOIS.csv", "bidaskOIS_20200527.csv", "curve_99999999.csv"):
        (tmp_path / name).write_text("tenor,typeRate,bid,ask,mid\r\n1D,OverNight,1.0,1.2,1.1\r\n3M,Cash,2.0,2.2,2.1\r\n")
    got = sorted({(r["curve_id"], str(r["val_date"]), r["pos"]) for r in IO.read_quote_files(spark, str(tmp_path)).collect()})
    assert got == [(c, d, p) for c, d in (("bidaskOIS", "2020-05-27"), ("bidaskOIS", "None"), ("curve", "None")) for p in (1, 2)]
