"""Futures block of a projection curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcurves.operators.interpolation import interpolate
from sparkcurves.operators.pillars import CURVE_KEY, spot_factor


def futures_block(pillars: DataFrame) -> DataFrame:
    """Futures factors from today.

    The first one starts on the curve made of the short end and the money market; each next
    one starts where the one before ended, so the block is a running product.
    """
    anchored = pillars.withColumn("spot_df", spot_factor(pillars))
    kind, first_night = F.col("type_rate"), F.col("pos") == 1
    near = anchored.where(kind.isin("OverNight", "Cash")).withColumn(
        "df", F.when((kind == "OverNight") & first_night, F.col("simple_df"))
        .when(kind == "OverNight", F.col("spot_df"))
        .otherwise(F.col("simple_df") * F.col("spot_df")),
    )
    futures = anchored.where(kind == "Future")
    order = Window.partitionBy(*CURVE_KEY).orderBy("pos")
    chained = futures.withColumns({
        "chain": F.exp(F.sum(F.log("simple_df")).over(order)),
        "strip_day": F.datediff(F.first("start_date").over(order), "val_date"),
    })
    started = interpolate(
        chained.drop("df"), near.select(*CURVE_KEY, "days", "df"), day="strip_day", name="start_df"
    )
    return started.withColumn("df", F.col("chain") * F.col("start_df"))
