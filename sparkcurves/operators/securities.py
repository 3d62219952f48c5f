"""Vendor price rows: the instrument list of a zero curve, and derived price columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurves.functions import dates as D
from sparkcurves.operators.bootstrap import with_schedule
from sparkcurves.operators.joins import salted_join
from sparkcurves.operators.pillars import CurveRules, by_curve, with_simple_df

ZERO_CURVE = CurveRules(calendar="MXN", settlement="same_day", base="spot", frequency="SemiAnnual")
BILL_DAYS = 360  # fixed value: longest maturity taken from bills, shortest beyond it from bonds


def price_universe(prices: DataFrame) -> DataFrame:
    """Overnight fund, bills and bonds of each date as one list of distinct pillars.

    The three lists are one UNION ALL; a row yields each of the entries it qualifies for, so the
    prices are read once and not three times. `maturity_rank` keeps the order by days to
    maturity. It is taken over the distinct maturities of a date, not over its securities, so
    no task has to sort a whole date.
    """

    def entry(applies: Column, kind: str, days: Column, rate: Column, coupon: Column, price: Column) -> Column:
        listed = F.struct(
            F.lit(kind).alias("type_rate"), days.alias("plazo"), rate.alias("yield"),
            coupon.alias("tasa_cupon"), price.alias("precio_sucio"),
        )
        return F.when(applies, listed)

    days, rate, zero = F.col("dias_venc"), F.col("rendimiento") / 100.0, F.lit(0.0)
    is_fund = (F.col("emisora") == "PROMO") & (F.col("tipo_valor") == "SP")
    is_bill = (F.col("emisora") == "SMALL") & (F.col("tipo_valor") == "S") & (days <= BILL_DAYS)
    is_bond = (F.left("instrumento", F.lit(4)) == "blue") & (F.col("brand") != "Brand#23") & (days > BILL_DAYS)
    entries = F.array(
        entry(is_fund, "Cash", F.lit(1), F.col("precio_sucio") / 100.0, zero, zero),
        entry(is_bill, "Cash", days, rate, zero, zero),
        entry(is_bond, "Bond", days, rate, F.col("tasa_cupon"), F.col("precio_sucio")),
    )
    wanted = prices.where(is_fund | is_bill | is_bond)
    listed = wanted.select("fecha", F.inline(F.array_compact(entries))).distinct()
    ranks = (
        listed.select("fecha", "plazo").distinct()
        .withColumn("maturity_rank", F.row_number().over(Window.partitionBy("fecha").orderBy("plazo")))
    )
    # few dates and maturities serve all securities, so their keys are hot
    ranked = salted_join(listed, ranks, ["fecha", "plazo"], spread="yield")
    return ranked.withColumn("maturity", F.date_add("fecha", F.col("plazo")))


def of_issuer(prices: DataFrame, issuer: str, kinds: tuple[str, ...]) -> DataFrame:
    """Securities of one issuer whose kind is in a list."""
    return prices.where(F.col("tipo_valor").isin(*kinds) & (F.col("emisora") == issuer))


def classified(prices: DataFrame) -> DataFrame:
    return prices.withColumn("tipo", F.when(F.col("tasa_cupon") == 0, "Cero Cupon").otherwise("Bullet"))


def deflated(prices: DataFrame, index_levels: DataFrame) -> DataFrame:
    """Prices in index units and yields as decimals.

    The index has one row per quarter of the calendar, a bound that does not depend on the
    number of prices; broadcasting it also keeps a date with very many prices from becoming hot.
    A date without an index keeps its rows, with a NULL price.
    """
    return prices.join(F.broadcast(index_levels), "fecha", "left").withColumns({
        "psucio": F.col("precio_sucio") / F.col("index_level"),
        "yield": F.col("rendimiento") / 100.0,
    })


def zero_curve_pillars(prices: DataFrame) -> DataFrame:
    """Pillars of one zero curve per brand and date; one security per maturity, the lowest key.

    The overnight row takes the yield of the lowest key of the curve. Bills up to 360 days are
    linear; bonds are solved against their dirty price per unit.
    """
    per_maturity = (
        prices.groupBy(F.col("brand").alias("curve_id"), F.col("fecha").alias("val_date"), "dias_venc")
        .agg(
            F.min("p_partkey").alias("first_key"),
            F.min_by("rendimiento", "p_partkey").alias("rendimiento"),
            F.min_by("tasa_cupon", "p_partkey").alias("tasa_cupon"),
            F.min_by("precio_sucio", "p_partkey").alias("precio_sucio"),
        )
    )
    security = F.struct(
        F.col("dias_venc").alias("plazo"), "first_key", "rendimiento", "tasa_cupon", "precio_sucio"
    )
    listed = by_curve(per_maturity).groupBy("curve_id", "val_date").agg(
        F.array_sort(F.collect_list(security)).alias("securities"),
        F.min_by("rendimiento", "first_key").alias("overnight"),
    )
    night = F.struct(
        F.lit(1).alias("plazo"), F.lit(0).cast("long").alias("first_key"), F.col("overnight").alias("rendimiento"),
        F.lit(0.0).alias("tasa_cupon"), F.lit(0.0).alias("precio_sucio"),
    )
    rows = listed.select(
        "curve_id", "val_date", F.posexplode(F.concat(F.array(night), "securities")).alias("at", "s")
    ).select("curve_id", "val_date", (F.col("at") + 1).alias("pos"), "s.*")
    is_bond, due = F.col("plazo") > BILL_DAYS, F.date_add("val_date", F.col("plazo"))
    rows = rows.select(
        "curve_id", "val_date", "pos", F.concat(F.col("plazo").cast("string"), F.lit("D")).alias("tenor"),
        F.when(is_bond, "Bond").otherwise("Cash").alias("type_rate"),
        F.when(is_bond, F.col("tasa_cupon")).otherwise(F.col("rendimiento") / 100.0).alias("rate"),
        F.lit(False).alias("is_missing"),
        F.when(is_bond, F.col("precio_sucio") / 100.0).otherwise(1.0).alias("target"),
        F.col("val_date").alias("spot_date"), F.col("val_date").alias("base_date"), F.col("val_date").alias("start_date"),
        F.when(is_bond, D.roll(due)).otherwise(due).alias("end_date"),
        D.schedule_count(ZERO_CURVE.frequency, F.col("val_date"), due).alias("payments"),
    ).withColumn("days", F.datediff("end_date", "val_date"))
    return with_schedule(with_simple_df(rows), ZERO_CURVE)
