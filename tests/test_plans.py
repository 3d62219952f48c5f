"""What the plans must look like for the work to scale, and exact results under a hot key."""

import datetime as dt
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkcurves.operators import joins
from sparkcurves.plans.queries import REGISTRY
from tests.conftest import SF_DIR

FORBIDDEN = ("NestedLoop", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "CollectLimit", "TakeOrdered", "Sample")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_plan_needs_a_nested_loop_python_or_one_task(spark, name):
    plan = plan_of(REGISTRY[name](spark, SF_DIR))
    for operator in FORBIDDEN:
        assert operator not in plan, operator
    singles = plan.count("Exchange SinglePartition")
    assert singles == (2 if name == "definition_audit" else 0)  # counts over whole tables, combined before


EXCHANGES = {
    "accrual_day_counts": 0, "discount_factors": 0, "business_day_roll": 0, "frequency_yf": 0, "tenor_parsed": 0,
    "compound_growth": 1, "imm_strip": 1, "quote_panel": 1, "tenor_end_dates": 1, "payment_counts": 1, "rate_lookup": 2,
    "bond_schedule": 1, "definition_join": 2, "curve_short_end": 2, "curve_cash_block": 2, "curve_zero_basis": 2,
    "curve_two_basis": 2, "bootstrap_par": 2, "bootstrap_par_gap": 2, "bootstrap_mxn": 2, "bond_pv": 2, "float_leg": 2,
}


@pytest.mark.parametrize("name", sorted(EXCHANGES))
def test_shuffles(spark, name):
    """One exchange to group raw rows and one to bring a curve together, or to deal loans over all tasks."""
    plan = plan_of(REGISTRY[name](spark, SF_DIR))
    assert len(re.findall(r"\bExchange (?:hash|range|Round|Single)", plan)) == EXCHANGES[name]


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(REGISTRY["bootstrap_par"](spark, SF_DIR))
    assert "ReadSchema: struct<l_suppkey:bigint,l_linenumber:int,l_discount:double,l_tax:double,l_shipdate:timestamp_ntz>" in plan
    plan = plan_of(REGISTRY["business_day_roll"](spark, SF_DIR))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_a_definition_scan_reads_one_folder(spark):
    plan = plan_of(REGISTRY["definition_scan"](spark, SF_DIR))
    assert re.search(r"PartitionFilters: \[[^\]]*slice#\d+ = \d+", plan) and "EqualTo(curve_name,Supplier#000000007)" in plan


def test_salted_join_is_the_plain_join(spark):
    """One key holds a third of the left rows."""
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left"):
        got = joins.salted_join(left, right, ["k"], spread="v", how=how)
        assert got.exceptAll(left.join(right, "k", how)).isEmpty() and left.join(right, "k", how).exceptAll(got).isEmpty()


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    """The smallest tables again, with a third of all lines moved to one supplier, quarter and part."""
    folder = tmp_path_factory.mktemp("skewed")
    for name in ("supplier", "part", "orders"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(str(folder / f"{name}.parquet"))
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    hot = F.col("l_orderkey") % 3 == 0
    moved = lines.withColumns({
        "l_suppkey": F.when(hot, 3).otherwise(F.col("l_suppkey")),
        "l_partkey": F.when(hot, 5).otherwise(F.col("l_partkey")),
        "l_shipdate": F.when(hot, F.lit(dt.datetime(1999, 5, 7)).cast("timestamp_ntz")).otherwise(F.col("l_shipdate")),
    })
    moved.write.parquet(str(folder / "lineitem.parquet"))
    return str(folder)


def test_hot_curve_quotes(spark, skewed_dir):
    rows = spark.read.parquet(f"{skewed_dir}/lineitem.parquet").select("l_suppkey", "l_linenumber", "l_discount", "l_tax", "l_shipdate").collect()
    assert sum(r["l_suppkey"] == 3 for r in rows) > len(rows) / 3
    sums = defaultdict(lambda: [0, 0])
    for r in rows:
        d = r["l_shipdate"]
        cell = sums[r["l_suppkey"], dt.date(d.year, d.month - (d.month - 1) % 3, 1), r["l_linenumber"]]
        cell[0] += round(r["l_discount"] * 100) + round(r["l_tax"] * 100)
        cell[1] += 1
    got = {(r["curve_id"], r["val_date"], r["pos"]): r["mid"] for r in REGISTRY["quote_panel"](spark, skewed_dir).collect()}
    assert got == {k: pytest.approx(s / (200 * n), abs=1e-8) for k, (s, n) in sums.items()}


@pytest.mark.parametrize("name", ["bootstrap_dual_curve", "bond_pv", "price_deflated", "swap_dual_curve_pv", "curve_asof_interp", "pillar_match"])
def test_hot_keys_lose_no_row(spark, skewed_dir, name):
    import duckdb

    from __spark_entry__ import oracle_sql

    duck = duckdb.connect()
    for table in ("lineitem", "supplier", "part", "orders"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{skewed_dir}/{table}.parquet/*.parquet'")
    frame = REGISTRY[name](spark, skewed_dir)
    columns = sorted(frame.columns)
    cursor = duck.execute(oracle_sql()[name])
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == (pytest.approx(y, rel=1e-9, abs=1e-7) if isinstance(y, float) else y)
