"""Registered queries: each reads the sales tables and returns one result frame.

Doubles are rounded once, at the very end: 8 places for factors, rates and year fractions, 4 for
present values. Amounts that are plain products keep more, so that none lies on a rounding tie.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcurves.cluster import landed, shared_folder
from sparkcurves.functions import dates as D
from sparkcurves.functions.accrual import discount_factor, frequency_fraction, year_fraction
from sparkcurves.functions.exprs import choose
from sparkcurves.operators import bootstrap as B
from sparkcurves.operators import checks as K
from sparkcurves.operators import pillars as P
from sparkcurves.operators import pricing as R
from sparkcurves.operators import schedules as S
from sparkcurves.operators import securities as V
from sparkcurves.operators.dependencies import discount_links as discount_links_of
from sparkcurves.operators.futures import futures_block
from sparkcurves.operators.interpolation import curve_lines, interpolate
from sparkcurves.sources import files as IO
from sparkcurves.sources import market as M

CURVE_KEY = P.CURVE_KEY
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SCANNED_CURVE = "Supplier#000000007"
POINTS = 10**9  # more than the percent points of any quote
# Units of the tenors made from quantities, by line number.
TENOR_SUFFIXES = ("D", "W", "M", "Q", "S", "Y", ".5Y")


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def rounded(name: str, places: int = 8) -> Column:
    return F.round(F.col(name), places).alias(name)


def discount_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key of the curve that discounts each curve, found by the name in its settings."""
    return discount_links_of(M.curve_info(spark, sf_dir))


def par_quotes(spark: SparkSession, sf_dir: str, pillars: tuple = M.PAR_PILLARS) -> DataFrame:
    return P.definition_join(M.quotes(spark, sf_dir, pillars), pillars)


def solved_par(quotes: DataFrame, pillars: tuple = M.PAR_PILLARS, rules: P.CurveRules = P.OIS) -> DataFrame:
    return B.bootstrap(B.prepare(P.definition_join(quotes, pillars), rules), rules)


def par_curve(
    spark: SparkSession, sf_dir: str, pillars: tuple = M.PAR_PILLARS, rules: P.CurveRules = P.OIS
) -> DataFrame:
    """Bootstrapped curves in settlement basis."""
    return B.bootstrap(B.prepare(par_quotes(spark, sf_dir, pillars), rules), rules)


def today_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.to_today(par_curve(spark, sf_dir)).select(*CURVE_KEY, "pos", "type_rate", "days", "df")


def discount_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The few curves that discount others, as the settings name them, in today basis and stored.

    Only their quotes are solved. Joins see the true size of the stored table and broadcast it while it is small.
    """
    wanted = discount_links(spark, sf_dir).select(F.col("discount_id").alias("curve_id")).distinct()
    quotes = M.quotes(spark, sf_dir).join(wanted, "curve_id", "left_semi")
    few = P.to_today(solved_par(quotes)).select(*CURVE_KEY, "pos", "type_rate", "days", "df")
    return landed(few.hint("rebalance"))  # a few rows: no need for a file per partition


def closed_pillars(spark: SparkSession, sf_dir: str, pillars: tuple = M.PAR_PILLARS, rules: P.CurveRules = P.OIS) -> DataFrame:
    return P.with_simple_df(P.with_dates(par_quotes(spark, sf_dir, pillars), rules))


def dated_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All loans with their maturity; a short one pays once."""
    return S.with_maturity(M.loans(spark, sf_dir))


# --- sources, projections, filters -------------------------------------------------------------


@query
def quote_panel(spark, sf_dir):
    kept = M.quotes(spark, sf_dir).drop("bid", "ask")
    return kept.select(*CURVE_KEY, "pos", "tenor", "type_rate", rounded("mid"))


@query
def quote_side(spark, sf_dir):
    """Each curve quotes on its own side; a curve with a settlement lag of 2 quotes in percent."""
    info = M.curve_info(spark, sf_dir).select(F.col("id_curve").alias("curve_id"), "settlement")
    joined = M.quotes(spark, sf_dir).join(info, "curve_id")
    lag = F.col("settlement")
    side = F.when(lag == 0, "bid").when(lag == 1, "ask").otherwise("mid")
    scale = F.when(lag == 2, 100.0).otherwise(1.0)
    picked = P.choose_side(joined.withColumn("side", side), F.col("side"), scale)
    return picked.select(*CURVE_KEY, "pos", "tenor", "side", rounded("rate"))


@query
def quote_files(spark, sf_dir):
    """Quotes written as one file per nation and quarter and read back; what no curve uses or can be read stays as a reject."""
    folder = shared_folder(spark)
    IO.write_quote_files(M.nation_quotes(spark, sf_dir), folder)
    nations = IO.read_table(spark, sf_dir, "nation").where("n_regionkey <> 0")
    names = nations.select(F.col("n_nationkey").cast("string").alias("file_name"), F.col("n_name").alias("curve_id"))
    rows = IO.read_quote_files(spark, folder, IO.QUOTE_FOLDER_PATTERN, names)
    return rows.select(
        "file_name", *CURVE_KEY, "pos", "tenor", "type_rate", rounded("bid"), rounded("ask"), rounded("mid"), "reject",
    )


@query
def quotes_by_type(spark, sf_dir):
    bonds = M.quotes(spark, sf_dir).where(F.col("type_rate").isin("Bond"))
    return bonds.select(*CURVE_KEY, "tenor", rounded("mid"))


@query
def type_blocks(spark, sf_dir):
    return P.type_blocks(M.quotes(spark, sf_dir))


@query
def curve_definition(spark, sf_dir):
    """Long pillars of every definition, renamed by position, without incomplete rows."""
    defined = par_quotes(spark, sf_dir).select(
        *CURVE_KEY, "tenor",
        F.when(F.col("type_rate") == "Bond", "Bond/Swap rate").otherwise("Cash Rate").alias("description"),
        F.when(~F.col("is_missing"), F.round("rate", 8)).alias("value"),
    )
    renamed = defined.toDF("curve_name", "on_date", "tenor", "mkt_desc", "quote")
    return renamed.where(F.col("mkt_desc") == "Bond/Swap rate").na.drop("any")


@query
def definition_scan(spark, sf_dir):
    """Definition of one curve by its name, from a stored table of all curves' definitions."""
    names = M.curve_info(spark, sf_dir).select(F.col("id_curve").alias("curve_id"), F.col("name").alias("curve_name"))
    folder = shared_folder(spark)
    IO.write_definitions(M.definitions(spark, sf_dir).join(names, "curve_id"), folder)
    return IO.scan_definition(spark, folder, SCANNED_CURVE).select("curve_name", "curve_id", "pos", "tenor", "type_rate")


@query
def definition_audit(spark, sf_dir):
    info = K.definition_audit(M.curve_info(spark, sf_dir), ["id_curve"], "curve_info")
    lines = IO.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return info.unionByName(K.definition_audit(lines, ["l_orderkey", "l_linenumber"], "lineitem"))


@query
def definition_table_saved(spark, sf_dir):
    """Settings of all curves, audited and saved as a table of the catalog, and read back."""
    table = f"curve_info_{uuid.uuid4().hex}"
    IO.publish_table(M.curve_info(spark, sf_dir), ["id_curve"], table)
    saved = landed(spark.table(table))
    spark.sql(f"DROP TABLE {table}")
    return saved


@query
def curve_reload(spark, sf_dir):
    """Stored-curve round trip: write the text layout to shared storage and read it back."""
    folder = shared_folder(spark)
    curve = P.to_today(par_curve(spark, sf_dir))
    IO.write_stored_curve(curve, folder)
    stored = IO.read_stored_curve(spark, folder, IO.STORED_PANEL_SCHEMA)
    return stored.select(*CURVE_KEY, "days", rounded("df"))


@query
def price_universe(spark, sf_dir):
    listed = V.price_universe(M.prices(spark, sf_dir))
    return listed.select(
        "fecha", "type_rate", "plazo", rounded("yield"), rounded("tasa_cupon"), "precio_sucio", "maturity_rank", "maturity"
    )


@query
def price_classified(spark, sf_dir):
    rows = V.classified(M.prices(spark, sf_dir)).where(F.col("tipo_valor") == "SP")
    return rows.select("p_partkey", "fecha", "instrumento", rounded("tasa_cupon"), "tipo")


@query
def price_issuer(spark, sf_dir):
    """Bills and funds of one issuer."""
    rows = V.of_issuer(M.prices(spark, sf_dir), "PROMO", ("S", "SP"))
    return rows.select("p_partkey", "fecha", "instrumento", "tipo_valor", "emisora", "precio_sucio", "dias_venc")


@query
def price_deflated(spark, sf_dir):
    rows = V.deflated(M.prices(spark, sf_dir), M.index_levels(spark, sf_dir))
    return rows.select("p_partkey", "fecha", "precio_sucio", rounded("psucio"), rounded("yield"), "dias_venc")


# --- joins -------------------------------------------------------------------------------------


@query
def rate_lookup(spark, sf_dir):
    """First quote of each wanted tenor, 0 when there is none; several rows may quote a tenor.

    First is the lowest order key, then the lowest rate: a minimum over both, combined on the map side.
    """
    points = M.percent_points(F.col("l_discount")) + M.percent_points(F.col("l_tax"))
    # one exact number, so that the minimum stays a hash aggregate
    ranked = F.col("l_orderkey").cast("decimal(28,0)") * F.lit(POINTS).cast("decimal(10,0)") + points.cast("decimal(10,0)")
    first = (
        IO.read_table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("curve_id"), M.quarter(F.col("l_shipdate")).alias("val_date"),
            F.col("l_linenumber").alias("pos"),
        )
        .agg((F.pmod(F.min(ranked), F.lit(POINTS)).cast("long") / 200.0).alias("mid"))
        .withColumn("tenor", M.pillar_tenor(F.col("pos")))
    )
    rows = P.definition_join(first, M.PAR_PILLARS)
    return rows.select(*CURVE_KEY, "tenor", rounded("rate"), "is_missing")


@query
def definition_join(spark, sf_dir):
    rows = par_quotes(spark, sf_dir)
    return rows.select(*CURVE_KEY, "pos", "tenor", "type_rate", rounded("rate"), "is_missing")


@query
def pillar_match(spark, sf_dir):
    """Pillar with exactly the loan's day count; loans without one keep a NULL position."""
    loans = S.with_maturity(M.loans(spark, sf_dir)).withColumn("day", F.datediff("maturity", "val_date"))
    dated = P.with_dates(par_quotes(spark, sf_dir), P.OIS).withColumn("day", F.datediff("end_date", "val_date"))
    first = dated.groupBy(*CURVE_KEY, "day").agg(F.min("pos").alias("pos"))
    matched = loans.join(first, [*CURVE_KEY, "day"], "left")
    return matched.select(
        *CURVE_KEY, "start_date", "tenor", rounded("rate"), "day", "pos", F.col("pos").isNotNull().alias("is_matched")
    )


@query
def curve_asof_interp(spark, sf_dir):
    """Both interpolations at every day on which some loan of the curve ends."""
    loans = S.with_maturity(M.loans(spark, sf_dir))
    points = P.by_curve(loans.select(*CURVE_KEY, F.datediff("maturity", "val_date").alias("day"))).distinct()
    rows = interpolate(points, today_curve(spark, sf_dir), linear=True)
    return rows.select(*CURVE_KEY, "day", rounded("df"), rounded("df_linear"))


# --- scalar functions --------------------------------------------------------------------------


def _dated_lines(spark, sf_dir) -> DataFrame:
    lines = IO.read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_tax", F.to_date("l_shipdate").alias("start_date"),
        *M.pillar_columns(F.col("l_linenumber")),
    )
    return S.with_maturity(lines)


@query
def accrual_day_counts(spark, sf_dir):
    start, end = F.col("start_date"), F.col("maturity")
    return _dated_lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "start_date", F.col("maturity").alias("end_date"),
        *[
            F.round(year_fraction(name, start, end), 8).alias(alias)
            for name, alias in (
                ("ACT/360", "act_360"), ("ACT/365F", "act_365f"), ("30/360", "thirty_360"), ("30E/360", "thirty_e_360"),
            )
        ],
    )


@query
def discount_factors(spark, sf_dir):
    """Each compounding on ACT/360, and the one the line's own conventions ask for."""
    start, end, rate = F.col("start_date"), F.col("maturity"), F.col("l_tax")
    names = ("Linear", "Compound", "Continuous")
    fraction = year_fraction("ACT/360", start, end)
    line = F.col("l_linenumber")
    own_count = choose(line % 4, {i: F.lit(name) for i, name in enumerate(M.DAY_COUNTS)})
    own_compounding = choose(line % 3, {i: F.lit(name) for i, name in enumerate(names)})
    lines = _dated_lines(spark, sf_dir).withColumns({"day_count": own_count, "compounding": own_compounding})
    own = discount_factor(F.col("compounding"), rate, year_fraction(F.col("day_count"), start, end))
    return lines.select(
        "l_orderkey", "l_linenumber", "start_date", rounded("l_tax"),
        *[F.round(discount_factor(name, rate, fraction), 8).alias(f"df_{name.lower()}") for name in names],
        "day_count", "compounding", F.round(own, 8).alias("df_own"),
    )


@query
def tenor_parsed(spark, sf_dir):
    part = IO.read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    suffix = F.element_at(F.array(*[F.lit(s) for s in TENOR_SUFFIXES + ("N",)]), (F.col("p_partkey") % 8 + 1).cast("int"))
    parsed = D.with_parsed_tenor(part.withColumn("tenor", F.concat(F.col("p_size").cast("string"), suffix)))
    return parsed.select(
        "p_partkey", "tenor", "tenor_number", "tenor_unit",
        D.tenor_months(F.col("tenor_number"), F.col("tenor_unit")).alias("months"),
    )


@query
def tenor_end_dates(spark, sf_dir):
    """End of each tenor in both calendars, and in the one the row names."""
    lines = IO.read_table(spark, sf_dir, "lineitem")
    suffix = F.element_at(F.array(*[F.lit(s) for s in TENOR_SUFFIXES]), F.col("l_linenumber"))
    tenors = lines.select(
        F.to_date("l_shipdate").alias("start_date"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), suffix).alias("tenor"),
        F.when(F.col("l_linestatus") == "F", "MXN").otherwise("USD").alias("calendar"),
    ).distinct()
    parsed = D.with_parsed_tenor(tenors)
    start = F.col("start_date")
    rows = parsed.select(
        "start_date", "tenor", "calendar",
        D.tenor_end(start, "USD").alias("end_usd"), D.tenor_end(start, "MXN").alias("end_mxn"),
        D.tenor_end(start, F.col("calendar")).alias("end_own"),
    )
    return rows.withColumn("rolled_own", D.roll(F.col("end_own")))


@query
def business_day_roll(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return IO.read_table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), D.roll(day).alias("rolled"))


@query
def frequency_yf(spark, sf_dir):
    frequency = F.col("pay_freq")
    return M.curve_info(spark, sf_dir).select(
        "id_curve", "pay_freq",
        F.round(frequency_fraction(frequency, "USD"), 8).alias("yf_usd"),
        F.round(frequency_fraction(frequency, "MXN"), 8).alias("yf_mxn"),
    )


@query
def frequency_yf_all(spark, sf_dir):
    """Every frequency that has a fraction of its own, by curve."""
    names = ("None", "Daily", *M.PAY_FREQUENCIES)
    own = choose(F.col("id_curve") % len(names), {i: F.lit(name) for i, name in enumerate(names)})
    rows = M.curve_info(spark, sf_dir).select("id_curve", own.alias("frequency"))
    return rows.select(
        "id_curve", "frequency",
        F.round(frequency_fraction(F.col("frequency"), "USD"), 8).alias("yf_usd"),
        F.round(frequency_fraction(F.col("frequency"), "MXN"), 8).alias("yf_mxn"),
    )


@query
def payment_counts(spark, sf_dir):
    start, end = F.col("start_date"), F.col("maturity")
    ranges = _dated_lines(spark, sf_dir).select("start_date", "tenor", "maturity").distinct()
    half_year = D.roll(F.add_months(start, 6))
    return ranges.select(
        "start_date", "tenor", F.col("maturity").alias("end_date"),
        *[
            D.payment_count(name, start, end).alias(f"n_{name.lower()}")
            for name in ("SemiAnnual", "Monthly", "Quarterly", "Annual")
        ],
        D.ratio_count(start, end, half_year).alias("n_by_period"),
        D.day_count_ratio(start, end, frequency_fraction("SemiAnnual", "USD")).alias("n_by_days"),
    )


@query
def settlement_dates(spark, sf_dir):
    """Overnight and spot dates of each curve and date under every rule, and the output label."""
    days = M.curve_dates(spark, sf_dir)
    info = M.curve_info(spark, sf_dir).select(F.col("id_curve").alias("curve_id"), "name", "settlement")
    rows = days.join(info, "curve_id").withColumn("stamp", F.date_format("val_date", "yyyyMMdd"))
    today = F.to_date("stamp", "yyyyMMdd")
    overnight, spot = D.settlement_pair(today, F.col("settlement"))
    return rows.select(
        *CURVE_KEY,
        D.overnight_date(today, "after_overnight").alias("on_date"),
        D.spot_date(today, "after_overnight").alias("tn_after_overnight"),
        D.spot_date(today, "two_days").alias("tn_two_days"),
        D.spot_date(today, "same_day").alias("tn_same_day"),
        overnight.alias("on_by_lag"), spot.alias("tn_by_lag"),
        F.concat("stamp", F.lit(" "), "name", F.lit(" Curva")).alias("label"),
    )


@query
def compound_growth(spark, sf_dir):
    """Simple compounding over the lines of an order: product of 1 + rate * period."""
    growth = F.log1p(F.col("l_tax") * F.col("l_quantity") / 365.0)
    return (
        IO.read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
        .agg(F.round(F.exp(F.sum(growth)), 8).alias("growth"), F.count(F.lit(1)).alias("periods"))
    )


# --- schedules and pricing ---------------------------------------------------------------------


def _schedule_rows(spark, sf_dir, calendar: str) -> DataFrame:
    loans = S.with_maturity(M.loan_groups(spark, sf_dir), calendar)
    rows = S.bond_schedule(loans, "SemiAnnual", calendar=calendar)
    return rows.select(
        "start_date", "tenor", rounded("rate"), "k", "n", "period_start", "period_end",
        F.datediff("period_end", "start_date").alias("day"), rounded("accrual"),
        F.round(S.fixed_amount(F.col("notional"), F.col("rate")), 8).alias("amount"),
    )


@query
def bond_schedule(spark, sf_dir):
    return _schedule_rows(spark, sf_dir, "USD")


@query
def bond_schedule_mxn(spark, sf_dir):
    return _schedule_rows(spark, sf_dir, "MXN")


@query
def imm_strip(spark, sf_dir):
    days = IO.read_table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return S.imm_strip(days, quantity=6)


@query
def bond_pv(spark, sf_dir):
    loans = S.with_maturity(M.loans(spark, sf_dir))
    values = R.bond_values(loans, curve_lines(today_curve(spark, sf_dir)), "SemiAnnual")
    return values.select(*CURVE_KEY, "start_date", "tenor", rounded("rate"), "payments", rounded("pv", 4))


@query
def bond_pv_mxn(spark, sf_dir):
    loans = S.with_maturity(M.loans(spark, sf_dir), "MXN")
    values = R.bond_values(loans, curve_lines(today_curve(spark, sf_dir)), "SemiAnnual", "MXN")
    return values.select(*CURVE_KEY, "start_date", "tenor", rounded("rate"), "payments", rounded("pv", 4))


@query
def forward_rates(spark, sf_dir):
    rows = R.forward_rates(today_curve(spark, sf_dir))
    return rows.select(*CURVE_KEY, "from_day", "days", rounded("forward_rate"))


@query
def float_leg(spark, sf_dir):
    rows = R.floating_flows(dated_loans(spark, sf_dir), curve_lines(today_curve(spark, sf_dir)))
    return rows.select(
        *CURVE_KEY, "start_date", "tenor", rounded("rate"), "k", "period_start", "period_end", "day",
        rounded("forward_rate"), rounded("amount", 4),
    )


@query
def swap_dual_curve_pv(spark, sf_dir):
    loans = dated_loans(spark, sf_dir).join(discount_links(spark, sf_dir), "curve_id", "left")
    lines = curve_lines(today_curve(spark, sf_dir))  # project their own loans; some curves discount those of others, too
    values = R.floating_values(loans, lines, lines)
    return values.select(
        *CURVE_KEY, "discount_id", "start_date", "tenor", rounded("rate"), "payments", rounded("pv", 4)
    )


def _flow_points(curve: DataFrame) -> DataFrame:
    bonds = curve.where(F.col("type_rate") == "Bond").select(*CURVE_KEY, "spot_date", "tenor", "rate")
    rows = S.flow_table(bonds, payments_in_year=2)
    return rows.select(*CURVE_KEY, "tenor", "rate", "n", "k", "day", "yfc", "yf")


@query
def fixed_flow_table(spark, sf_dir):
    """Older layout of the par bonds' flows, discounted on their own curve."""
    curve = landed(par_curve(spark, sf_dir))
    coupon = F.col("rate") * F.col("yfc")
    flows = _flow_points(curve).withColumn("amount", F.when(F.col("k") == F.col("n"), coupon + 1.0).otherwise(coupon))
    valued = interpolate(flows, curve.select(*CURVE_KEY, "days", "df"))
    return valued.select(
        *CURVE_KEY, "tenor", "k", "day", rounded("yfc"), rounded("yf"), rounded("df"), rounded("amount", 12)
    )


@query
def float_flow_table(spark, sf_dir):
    """Older layout of floating flows: projected on the row's curve, discounted on another.

    The first factor is 1; later ones come from the row before.
    """
    curve = landed(par_curve(spark, sf_dir))
    projected = interpolate(_flow_points(curve), curve.select(*CURVE_KEY, "days", "df"), name="df_fwd")
    links = discount_links(spark, sf_dir)
    other = curve.join(links.select(F.col("discount_id").alias("curve_id")).distinct(), "curve_id", "left_semi").select(
        F.col("curve_id").alias("discount_id"), "val_date", "days", "df"
    )
    order = Window.partitionBy(*CURVE_KEY, "tenor").orderBy("k")
    growth = F.lag("df_fwd", 1, 1.0).over(order) / F.col("df_fwd") - 1.0
    flows = projected.withColumn("amount", F.when(F.col("k") == F.col("n"), growth + 1.0).otherwise(growth))
    valued = interpolate(
        flows.join(links, "curve_id", "left"), other, keys=["discount_id", "val_date"], spread="curve_id"
    )
    return valued.select(
        *CURVE_KEY, "tenor", "k", "day", rounded("yfc"), rounded("yf"), rounded("df"), rounded("amount")
    )


# --- curves ------------------------------------------------------------------------------------


@query
def curve_short_end(spark, sf_dir):
    rows = P.short_end(closed_pillars(spark, sf_dir))
    return rows.select(*CURVE_KEY, "pos", "start_date", "end_date", "days", rounded("df"))


@query
def curve_short_end_zero(spark, sf_dir):
    """Zero kind: one overnight factor, not rolled, and no second night."""
    rows = P.short_end(closed_pillars(spark, sf_dir, M.MXN_PILLARS, P.GOVERNMENT_MXN))
    return rows.select(*CURVE_KEY, "pos", "start_date", "end_date", "days", rounded("df"))


@query
def curve_cash_block(spark, sf_dir):
    rows = P.cash_block(closed_pillars(spark, sf_dir))
    return rows.select(*CURVE_KEY, "pos", "end_date", "days", rounded("df"), "days_today", rounded("df_today"))


@query
def futures_chain(spark, sf_dir):
    """Futures factors: the first hangs on the curve before it, the rest on each other."""
    rows = futures_block(closed_pillars(spark, sf_dir, M.PROJECTION_PILLARS, P.PROJECTION))
    return rows.select(*CURVE_KEY, "pos", "tenor", "start_date", "end_date", "days", rounded("df"))


@query
def curve_zero_basis(spark, sf_dir):
    rows = P.to_today(par_curve(spark, sf_dir))
    return rows.select(*CURVE_KEY, "pos", "tenor", "days", rounded("df"))


@query
def curve_two_basis(spark, sf_dir):
    rows = P.two_bases(par_curve(spark, sf_dir))
    return rows.select(*CURVE_KEY, "basis", "pos", "days", rounded("df"))


@query
def curve_store(spark, sf_dir):
    """Curve sink: both bases written by valuation date, and read back."""
    folder = shared_folder(spark)
    curve = P.two_bases(par_curve(spark, sf_dir)).select(*CURVE_KEY, "basis", "pos", "days", "df")
    IO.write_curve(curve, folder)
    stored = spark.read.schema(curve.schema).parquet(folder)
    return stored.select(*CURVE_KEY, "basis", "pos", "days", rounded("df"))


@query
def curve_initial(spark, sf_dir):
    rows = P.definition_curve(par_quotes(spark, sf_dir), M.curve_info(spark, sf_dir))
    return rows.select(*CURVE_KEY, "basis", "pos", "tenor", "start_date", "end_date", "days", rounded("yf"), rounded("df"))


def _solved(curve: DataFrame) -> DataFrame:
    return curve.select(*CURVE_KEY, "pos", "tenor", "days", rounded("df"), "converged")


@query
def bootstrap_par(spark, sf_dir):
    return _solved(par_curve(spark, sf_dir))


@query
def bootstrap_par_gap(spark, sf_dir):
    return _solved(par_curve(spark, sf_dir, M.GAP_PILLARS))


@query
def bootstrap_semiannual(spark, sf_dir):
    return _solved(par_curve(spark, sf_dir, M.SEMIANNUAL_PILLARS, P.CAMARA_SEMIANNUAL))


@query
def bootstrap_mxn(spark, sf_dir):
    return _solved(par_curve(spark, sf_dir, M.MXN_PILLARS, P.GOVERNMENT_MXN))


@query
def bootstrap_by_definition(spark, sf_dir):
    """Every curve by the tables: its own pillars, settlement lag, payment frequency and day count."""
    info = M.curve_info(spark, sf_dir).select(F.col("id_curve").alias("curve_id"), "pay_freq", "day_count", "settlement")
    lists = P.definition_lists(M.definitions(spark, sf_dir)).join(info, "curve_id")
    rules = P.CurveRules(settlement=F.col("settlement"), frequency=F.col("pay_freq"), day_count=F.col("day_count"))
    quotes = P.definition_list_join(M.quotes(spark, sf_dir), lists)
    return _solved(B.bootstrap(B.prepare(quotes, rules), rules, settings=["pay_freq", "day_count", "settlement"]))


def price_curve(spark, sf_dir) -> DataFrame:
    return B.bootstrap(V.zero_curve_pillars(M.prices(spark, sf_dir)), V.ZERO_CURVE)


@query
def bootstrap_price_target(spark, sf_dir):
    return _solved(price_curve(spark, sf_dir))


def projection_curve(spark, sf_dir, discount: DataFrame) -> DataFrame:
    quotes = par_quotes(spark, sf_dir, M.PROJECTION_PILLARS).join(discount_links(spark, sf_dir), "curve_id", "left")
    return B.bootstrap_dual(B.prepare(quotes, P.PROJECTION), P.PROJECTION, discount)


@query
def bootstrap_dual_curve(spark, sf_dir):
    return _solved(projection_curve(spark, sf_dir, discount_curves(spark, sf_dir)))


def _bond_check(curve: DataFrame, rules: P.CurveRules) -> DataFrame:
    """Residuals of stored curves: the check reads what was written, and solves nothing again."""
    return K.residual_summary(K.bond_residuals(landed(curve), rules))


@query
def par_residual(spark, sf_dir):
    return _bond_check(par_curve(spark, sf_dir, M.GAP_PILLARS), P.OIS)


@query
def par_residual_semiannual(spark, sf_dir):
    rules = P.CAMARA_SEMIANNUAL
    return _bond_check(par_curve(spark, sf_dir, M.SEMIANNUAL_PILLARS, rules), rules)


@query
def par_residual_mxn(spark, sf_dir):
    rules = P.GOVERNMENT_MXN
    return _bond_check(par_curve(spark, sf_dir, M.MXN_PILLARS, rules), rules)


@query
def par_residual_price_target(spark, sf_dir):
    return _bond_check(price_curve(spark, sf_dir), V.ZERO_CURVE)


@query
def par_residual_dual_curve(spark, sf_dir):
    discount = discount_curves(spark, sf_dir)
    curve = landed(projection_curve(spark, sf_dir, discount))
    return K.residual_summary(K.swap_residuals(curve, discount, discount_links(spark, sf_dir)))
