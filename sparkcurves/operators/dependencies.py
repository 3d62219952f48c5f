"""Which curve discounts which: links by name, levels of the graph, curves solved level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurves.cluster import landed
from sparkcurves.operators.bootstrap import bootstrap_dual
from sparkcurves.operators.pillars import CurveRules


def discount_links(info: DataFrame) -> DataFrame:
    """info(id_curve, name, dsct_curve) -> curve_id, discount_id: the curve that each curve's settings name.

    NULL where no curve has that name. A name that several curves have stands for the least of them.
    """
    named = info.groupBy(F.col("name").alias("dsct_curve")).agg(F.min("id_curve").alias("discount_id"))
    return info.select(F.col("id_curve").alias("curve_id"), "dsct_curve").join(named, "dsct_curve", "left").select("curve_id", "discount_id")


def dependency_levels(links: DataFrame) -> DataFrame:
    """links(curve_id, discount_id) -> curve_id, discount_id, level.

    Level 0 discounts on itself, the others one above the curve they discount on; a curve whose discount curve is not in the
    table is at level 1, and stays unsolved there. Pointers double in each round, so a chain of n curves takes log2(n) of
    them. Curves that depend on each other in a ring have no level: ValueError.
    """
    own = F.col("discount_id") == F.col("curve_id")
    known = links.select(F.col("curve_id").alias("discount_id"), F.lit(True).alias("known"))
    state = landed(links.join(known, "discount_id", "left").select(
        "curve_id", "discount_id", F.when(F.col("known") & ~own, F.col("discount_id")).alias("up"),
        F.when(F.coalesce(own, F.lit(False)), 0).otherwise(1).cast("long").alias("level"),
    ))
    longest = state.count()
    rounds = 0
    while not state.where("up is not null").isEmpty():
        if 1 << rounds > longest:
            raise ValueError("curves discount on each other in a ring")
        over = state.select(F.col("curve_id").alias("up"), F.col("up").alias("further"), F.col("level").alias("more"))
        state = landed(state.join(over, "up", "left").select(
            "curve_id", "discount_id", F.col("further").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")
        ))
        rounds += 1
    return state.drop("up")


def bootstrap_by_level(roots: DataFrame, pillars: DataFrame, rules: CurveRules, links: DataFrame) -> DataFrame:
    """Projection curves that discount on each other, level by level.

    `roots` holds the finished curves of level 0 in today basis (curve_id, val_date, days, df); `pillars` the prepared pillars
    of the others. Each level is solved in one job on the curves of the level below, and stored. Returns the curves above
    level 0 with their `level`. A curve whose discount curve has no solved pillars on its date stays unsolved.
    """
    levels = dependency_levels(links)
    solved, discount = [], roots
    for level in range(1, (levels.agg(F.max("level")).first()[0] or 0) + 1):
        own = levels.where(F.col("level") == level).select("curve_id", "discount_id")
        curve = landed(bootstrap_dual(pillars.join(own, "curve_id"), rules, discount))
        solved.append(curve.withColumn("level", F.lit(level)))
        discount = curve.where("converged").select("curve_id", "val_date", "days", "df")
    if not solved:
        raise ValueError("no curve discounts on another one")
    return reduce(DataFrame.unionByName, solved)
