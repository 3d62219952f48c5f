"""Quotes, loans, prices and curve settings derived from the sales tables.

Sums are taken over integers (percent points, cents) so that the order in which rows arrive
cannot change a double. Every grouping combines on the map side first; a supplier that holds a
third of all rows still ends as a few rows per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurves.functions.dates import TENOR_FIELDS, tenor_parts
from sparkcurves.functions.exprs import choose
from sparkcurves.sources.files import read_table

# Instruments by line number, (pos, tenor, type_rate).
PAR_PILLARS = (
    (1, "1D", "OverNight"), (2, "2D", "OverNight"), (3, "3M", "Cash"), (4, "6M", "Cash"),
    (5, "1Y", "Bond"), (6, "2Y", "Bond"), (7, "3Y", "Bond"),
)
GAP_PILLARS = PAR_PILLARS[:6] + ((7, "5Y", "Bond"),)
SEMIANNUAL_PILLARS = PAR_PILLARS[:4] + ((5, "18M", "Bond"), (6, "30M", "Bond"), (7, "4Y", "Bond"))
MXN_PILLARS = (
    (1, "1D", "OverNight"), (2, "28D", "Cash"), (3, "91D", "Cash"), (4, "182D", "Bond"),
    (5, "364D", "Bond"), (6, "728D", "Bond"), (7, "1820D", "Bond"),
)
PROJECTION_PILLARS = (
    (1, "ON", "OverNight"), (2, "TN", "OverNight"), (3, "3M", "Cash"), (4, "ED1", "Future"),
    (5, "ED2", "Future"), (6, "2Y", "Swap"), (7, "3Y", "Swap"),
)
# Definitions of different lengths, by the settlement lag of the curve: only a lag of 2 has a second night.
DEFINITIONS = (
    ((1, "1D", "OverNight"), (2, "3M", "Cash"), (3, "6M", "Cash"), (4, "1Y", "Bond"), (5, "3Y", "Bond")),
    ((1, "1D", "OverNight"), (2, "6M", "Cash"), (3, "2Y", "Bond"), (4, "3Y", "Bond")),
    PAR_PILLARS,
)
PAY_FREQUENCIES = ("Annual", "SemiAnnual", "Quarterly", "Monthly")
DAY_COUNTS = ("ACT/360", "ACT/365F", "30/360", "30E/360")
DISCOUNT_CURVES = 10
THIN = 8  # a vendor gives no mid quote on fewer sales


def pillar_tenor(pos: Column, pillars: tuple = PAR_PILLARS) -> Column:
    return choose(pos, {p: F.lit(tenor) for p, tenor, _ in pillars})


def pillar_type(pos: Column, pillars: tuple = PAR_PILLARS) -> Column:
    return choose(pos, {p: F.lit(kind) for p, _, kind in pillars})


def pillar_columns(pos: Column, pillars: tuple = PAR_PILLARS) -> list[Column]:
    """Tenor with its parsed fields, which are constants per pillar and not matched per row."""
    parts = {p: tenor_parts(tenor) for p, tenor, _ in pillars}
    return [
        pillar_tenor(pos, pillars).alias("tenor"),
        *[choose(pos, {p: fields[name] for p, fields in parts.items()}).alias(name) for name in TENOR_FIELDS],
    ]


def quarter(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "quarter")


def percent_points(rate: Column) -> Column:
    return F.rint(rate * 100).cast("long")


def cents(amount: Column) -> Column:
    return F.rint(amount * 100).cast("long")


def quotes(spark: SparkSession, sf_dir: str, pillars: tuple = PAR_PILLARS) -> DataFrame:
    """One quote per (curve_id, val_date, pos): bid, ask and mid as decimals."""
    discount, tax = percent_points(F.col("l_discount")), percent_points(F.col("l_tax"))
    grouped = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("curve_id"),
            quarter(F.col("l_shipdate")).alias("val_date"),
            F.col("l_linenumber").alias("pos"),
        )
        .agg(
            F.sum(F.least(discount, tax)).alias("low"),
            F.sum(F.greatest(discount, tax)).alias("high"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return grouped.select(
        "curve_id", "val_date", "pos",
        pillar_tenor(F.col("pos"), pillars).alias("tenor"),
        pillar_type(F.col("pos"), pillars).alias("type_rate"),
        (F.col("low") / (F.col("n") * 100.0)).alias("bid"),
        (F.col("high") / (F.col("n") * 100.0)).alias("ask"),
        ((F.col("low") + F.col("high")) / (F.col("n") * 200.0)).alias("mid"),
    )


def nation_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as a vendor sends them: one file per nation and quarter, a mid quote of few sales as text.

    Sales are grouped by supplier before they meet the supplier's nation.
    """
    discount, tax = percent_points(F.col("l_discount")), percent_points(F.col("l_tax"))
    sold = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("s_suppkey"), quarter(F.col("l_shipdate")).alias("val_date"), F.col("l_linenumber").alias("pos"))
        .agg(F.sum(F.least(discount, tax)).alias("low"), F.sum(F.greatest(discount, tax)).alias("high"), F.count(F.lit(1)).alias("n"))
    )
    nations = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("file_name"))
    grouped = sold.join(nations, "s_suppkey").groupBy("file_name", "val_date", "pos").agg(*[F.sum(c).alias(c) for c in ("low", "high", "n")])
    mid = (F.col("low") + F.col("high")) / (F.col("n") * 200.0)
    return grouped.select(
        "file_name", "val_date", "pos", pillar_tenor(F.col("pos")).alias("tenor"), pillar_type(F.col("pos")).alias("type_rate"),
        (F.col("low") / (F.col("n") * 100.0)).alias("bid"), (F.col("high") / (F.col("n") * 100.0)).alias("ask"),
        F.when(F.col("n") < THIN, "n/a").otherwise(mid.cast("string")).alias("mid"),
    )


def curve_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every curve and date that has a quote."""
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("curve_id"), quarter(F.col("l_shipdate")).alias("val_date")
    ).distinct()


def loan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans by (start, tenor, rate) whatever the curve: 9 rates x 7 tenors a day at most."""
    grouped = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy(
            F.to_date("l_shipdate").alias("start_date"),
            F.col("l_linenumber").alias("pos"),
            percent_points(F.col("l_tax")).alias("points"),
        )
        .agg(F.sum(cents(F.col("l_extendedprice"))).alias("cents"))
    )
    return grouped.select(
        "start_date",
        *pillar_columns(F.col("pos")),
        (F.col("points") / 100.0).alias("rate"),
        (F.col("cents") / 100.0).alias("notional"),
    )


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans by (curve, start, tenor, rate) with their notional.

    A curve has at most 9 rates x 7 tenors x 92 days of loans in one quarter, whatever the
    number of rows behind them: grouping is what keeps a hot curve small afterwards.
    """
    grouped = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("curve_id"),
            F.to_date("l_shipdate").alias("start_date"),
            F.col("l_linenumber").alias("pos"),
            percent_points(F.col("l_tax")).alias("points"),
        )
        .agg(F.sum(cents(F.col("l_extendedprice"))).alias("cents"))
    )
    return grouped.select(
        "curve_id", F.trunc("start_date", "quarter").alias("val_date"), "start_date",
        *pillar_columns(F.col("pos")),
        (F.col("points") / 100.0).alias("rate"),
        (F.col("cents") / 100.0).alias("notional"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor price rows, one per security and quarter.

    Sales are grouped by part before they meet the part table, so the join moves at most one
    row per part and quarter however often a part was sold.
    """
    sold = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"), quarter(F.col("l_shipdate")).alias("fecha"))
        .agg(
            F.sum(percent_points(F.col("l_tax"))).alias("tax"),
            F.sum(percent_points(F.col("l_discount"))).alias("discount"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return sold.join(part, "p_partkey").select(
        "p_partkey", "fecha",
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("emisora"),
        F.col("p_name").alias("instrumento"),
        choose(F.col("p_size") % 3, {0: F.lit("S"), 1: F.lit("SP"), 2: F.lit("SC")}).alias("tipo_valor"),
        ((F.col("p_size") % 5) + 98.0).alias("precio_sucio"),
        (F.col("discount") / F.col("n")).alias("rendimiento"),
        ((F.col("p_size") % 10 + 1) * 182).alias("dias_venc"),
        (F.col("tax") / (F.col("n") * 100.0)).alias("tasa_cupon"),
    )


def index_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inflation-style index level per quarter; one row per quarter of the calendar."""
    grouped = (
        read_table(spark, sf_dir, "orders")
        .groupBy(quarter(F.col("o_orderdate")).alias("fecha"))
        .agg(F.sum(cents(F.col("o_totalprice"))).alias("cents"), F.count(F.lit(1)).alias("n"))
    )
    return grouped.select("fecha", (F.col("cents") / (F.col("n") * 10000000.0)).alias("index_level"))


def curve_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of every curve."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    discount_key = key % DISCOUNT_CURVES + 1
    return read_table(spark, sf_dir, "supplier").select(
        key.alias("id_curve"),
        F.col("s_name").alias("name"),
        choose(nation % 4, {i: F.lit(v) for i, v in enumerate(PAY_FREQUENCIES)}).alias("pay_freq"),
        (nation % 3).alias("settlement"),
        choose(nation % 4, {i: F.lit(v) for i, v in enumerate(DAY_COUNTS)}).alias("day_count"),
        F.col("s_name").alias("fwd_curve"),
        F.concat(F.lit("Supplier#"), F.lpad(discount_key.cast("string"), 9, "0")).alias("dsct_curve"),
    )


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition table: one row per curve and pillar, lists of different lengths."""
    pillar = "array<struct<pos:int,tenor:string,type_rate:string>>"
    lists = [F.array(*[F.struct(F.lit(p), F.lit(t), F.lit(k)) for p, t, k in pillars]).cast(pillar) for pillars in DEFINITIONS]
    own = choose(F.col("s_nationkey") % len(DEFINITIONS), dict(enumerate(lists)))
    return read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("curve_id"), F.inline(own))
