"""Acceptance checks: repricing of solved pillars and constraints of definition tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcurves.operators.bootstrap import TOLERANCE
from sparkcurves.operators.interpolation import interpolate
from sparkcurves.operators.pillars import CURVE_KEY, CurveRules
from sparkcurves.operators.schedules import bond_schedule, fixed_amount


def bond_residuals(curve: DataFrame, rules: CurveRules) -> DataFrame:
    """Reprice every solved bond on its own curve: value of its payments less the target.

    Goes through the interpolation join and shares nothing with the solver, so it can vouch
    for it.
    """
    key = [*CURVE_KEY, "pos", "target"]
    bonds = curve.where(F.col("type_rate") == "Bond").select(
        *key, "rate", F.col("spot_date").alias("start_date"), F.col("end_date").alias("maturity")
    )
    rows = bond_schedule(bonds, rules.frequency, rules.day_count, rules.calendar)
    flows = rows.select(
        *key, F.datediff("period_end", "start_date").alias("day"), fixed_amount(F.lit(1.0), F.col("rate")).alias("amount")
    )
    value = interpolate(flows, curve.select(*CURVE_KEY, "days", "df")).groupBy(*key).agg(
        F.sum(F.col("amount") * F.col("df")).alias("pv")
    )
    return value.withColumn("residual", F.col("pv") - F.col("target"))


def swap_residuals(curve: DataFrame, discount: DataFrame, links: DataFrame) -> DataFrame:
    """Floating less fixed leg of every solved swap, both repriced through joins; NULL without a discount curve.

    `links` names each curve's discount curve. Like `bond_residuals` this shares nothing with the solver.
    """
    key = [*CURVE_KEY, "pos"]
    swaps = curve.where(F.col("type_rate") == "Swap").select(
        *key, "rate", F.col("spot_date").alias("start_date"), F.col("end_date").alias("maturity"),
    ).join(links, "curve_id", "left")
    other = discount.select(F.col("curve_id").alias("discount_id"), "val_date", "days", "df")

    def worth(flows: DataFrame, name: str) -> DataFrame:
        valued = interpolate(flows, other, name="df_discount", keys=["discount_id", "val_date"], spread="curve_id")
        return valued.groupBy(*key).agg(F.sum(F.col("amount") * F.col("df_discount")).alias(name))

    day = F.datediff("period_end", "val_date").alias("day")
    dates = bond_schedule(swaps, "Quarterly", with_start=True).select(*key, "discount_id", "n", "k", day)
    before = Window.partitionBy(*key).orderBy("k")
    projected = interpolate(dates, curve.select(*CURVE_KEY, "days", "df")).withColumn("growth", F.lag("df").over(before) / F.col("df") - 1.0)
    floating = projected.where("k > 0").withColumn("amount", F.col("growth") + F.when(F.col("k") == F.col("n"), 1.0).otherwise(0.0))
    fixed = bond_schedule(swaps, "SemiAnnual", "30/360").select(*key, "discount_id", day, fixed_amount(F.lit(1.0), F.col("rate")).alias("amount"))
    both = worth(floating, "floating").join(worth(fixed, "fixed"), key, "full")
    return both.withColumn("residual", F.col("floating") - F.col("fixed"))


def residual_summary(residuals: DataFrame) -> DataFrame:
    """Solved pillars of each curve and how many reprice to their target."""
    return residuals.groupBy(*CURVE_KEY).agg(
        F.count(F.lit(1)).alias("pillars"),
        F.count_if(F.abs("residual") <= TOLERANCE).alias("repriced"),
    )


def definition_audit(table: DataFrame, key: list[str], name: str) -> DataFrame:
    """Violations of NOT NULL on every column and of uniqueness on the key, in one pass."""
    others = [c for c in table.columns if c not in key]
    per_key = table.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in others]
    )
    nulls = {c: F.sum(F.when(F.col(c).isNull(), F.col("_n")).otherwise(0)) for c in key} | {c: F.sum(c) for c in others}
    totals = per_key.agg(
        F.count_if(F.col("_n") > 1).alias("_repeated"),
        *[F.coalesce(nulls[c], F.lit(0)).alias(c) for c in table.columns],
    )
    checks = [(f"{name}.{c} not null", F.col(c)) for c in table.columns]
    checks.append((f"{name} unique {', '.join(key)}", F.col("_repeated")))
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(check).alias("check_name"), violations.alias("violations")) for check, violations in checks
    ])))
