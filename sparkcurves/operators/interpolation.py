"""Interpolation on a curve, as a join for tables and as an expression for gathered arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurves.cluster import landed, partition_count
from sparkcurves.functions.exprs import let
from sparkcurves.operators.joins import salted_join
from sparkcurves.operators.pillars import CURVE_KEY, by_curve

DAY_MIN, DAY_MAX = -(2**31), 2**31 - 1


def segments(curve: DataFrame, keys: list[str] = CURVE_KEY) -> DataFrame:
    """Half-open day ranges between pillars; the ends reach out without bound and are flat."""
    order = Window.partitionBy(*keys).orderBy("days")
    return curve.select(
        *keys,
        F.when(F.lag("days").over(order).isNull(), DAY_MIN).otherwise(F.col("days")).alias("from_day"),
        F.coalesce(F.lead("days").over(order), F.lit(DAY_MAX)).alias("to_day"),
        F.col("days").alias("day_lo"),
        F.lead("days").over(order).alias("day_hi"),
        F.col("df").alias("df_lo"),
        F.lead("df").over(order).alias("df_hi"),
    )


def interpolate(
    points: DataFrame, curve: DataFrame, day: str = "day", name: str = "df",
    keys: list[str] = CURVE_KEY, spread: str | None = None, linear: bool = False,
) -> DataFrame:
    """Add the discount factor at `day`: equality on the curve's key, then the day range.

    The equality keeps this a hash or merge join; only the few segments of one curve are
    compared with each point. Factors are log-linear between pillars and flat outside.
    `spread` names a column to salt by, for when few curves serve very many points.
    `linear` adds the factor interpolated linearly as well. A point whose curve is missing keeps
    its row, with a NULL factor.
    """
    d, ranges = F.col(day), segments(curve, keys)
    joined = salted_join(points, ranges, keys, spread, "left") if spread else points.join(ranges.hint("merge"), keys, "left")
    inside = F.col("day_hi").isNotNull() & (d > F.col("day_lo"))
    w = (d - F.col("day_lo")) / (F.col("day_hi") - F.col("day_lo"))
    results = [
        F.when(inside, F.exp(F.log("df_lo") + (F.log("df_hi") - F.log("df_lo")) * w)).otherwise(F.col("df_lo")).alias(name)
    ]
    if linear:
        straight = w * F.col("df_hi") + (F.col("day_hi") - d) / (F.col("day_hi") - F.col("day_lo")) * F.col("df_lo")
        results.append(F.when(inside, straight).otherwise(F.col("df_lo")).alias(f"{name}_linear"))
    here = F.col("from_day").isNull() | ((d >= F.col("from_day")) & (d < F.col("to_day")))
    return joined.where(here).select(*points.columns, *results)


def gathered(curve: DataFrame, name: str = "points") -> DataFrame:
    """One row per curve with its pillars as an array sorted by day: struct(t, l = ln df)."""
    pillar = F.struct(F.col("days").alias("t"), F.log("df").alias("l"))
    return curve.groupBy(*CURVE_KEY).agg(F.array_sort(F.collect_list(pillar)).alias(name))


def curve_lines(curve: DataFrame) -> DataFrame:
    """One row per curve and date: curve_id, val_date, `on_curve`, ready for `with_curve`; stored.

    Stored once, curves can serve several joins, and Spark knows their size.
    """
    return landed(gathered(by_curve(curve)).select(*CURVE_KEY, _lines(F.col("points")).alias("on_curve")))


def with_curve(rows: DataFrame, lines: DataFrame, name: str = "on_curve", curve_key: str = "curve_id") -> DataFrame:
    """Every row with its curve on its date; NULL where there is no curve.

    Adaptive execution broadcasts the curves while they are small. Else both sides of the join are plain exchanges, and a
    (curve, date) that very many rows have is dealt over several tasks.
    """
    own = lines.select(F.col("curve_id").alias(curve_key), "val_date", F.col("on_curve").alias(name))
    return rows.join(own, [curve_key, "val_date"], "left")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over all partitions, whatever their keys, for work that is heavy for its few bytes."""
    return rows.repartition(partition_count(rows.sparkSession))


def _lines(points: Column) -> Column:
    """A gathered curve as struct(ts, at, y, slope): line i of ln df, from day at[i] on, holds where i pillars are passed."""
    def slope(p: Column, i: Column) -> Column:
        after = F.get(points, i + 1)
        return F.coalesce((after["l"] - p["l"]) / (after["t"] - p["t"]), F.lit(0.0))

    first, days = F.get(points, 0), F.transform(points, lambda p: p["t"])
    return F.struct(
        days.alias("ts"),
        F.concat(F.array(first["t"]), days).alias("at"),
        F.concat(F.array(first["l"]), F.transform(points, lambda p: p["l"])).alias("y"),
        F.concat(F.array(F.lit(0.0)), F.transform(points, slope)).alias("slope"),
    )


def factors_at(on_curve: Column, days: Column) -> Column:
    """Factors at an array of days, on a curve as `with_curve` adds it; NULL factors on a NULL curve."""
    passed = F.transform(days, lambda d: F.size(F.filter(on_curve["ts"], lambda t: t <= d)))
    return F.zip_with(days, passed, lambda d, i: F.exp(
        F.get(on_curve["y"], i) + F.get(on_curve["slope"], i) * (d - F.get(on_curve["at"], i))))


def log_df_at(points: Column, day: Column) -> Column:
    """ln df at a day on a gathered curve: log-linear inside, flat outside."""
    passed = F.size(F.filter(points, lambda p: p["t"] <= day))
    return let(
        passed,
        lambda n: let(
            F.struct(F.get(points, n - 1).alias("lo"), F.get(points, n).alias("hi")),
            lambda s: F.when(n == 0, s["hi"]["l"])
            .when(s["hi"].isNull(), s["lo"]["l"])
            .otherwise(s["lo"]["l"] + (s["hi"]["l"] - s["lo"]["l"]) * (day - s["lo"]["t"]) / (s["hi"]["t"] - s["lo"]["t"])),
        ),
    )
