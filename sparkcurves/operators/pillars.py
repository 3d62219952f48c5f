"""From quotes to pillars: definitions, dates, day counts and the closed-form part of a curve."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurves.cluster import partition_count
from sparkcurves.functions import dates as D
from sparkcurves.functions.accrual import discount_factor, year_fraction
from sparkcurves.functions.exprs import Convention

CURVE_KEY = ["curve_id", "val_date"]
MOST_PILLARS = 1000  # a curve's definition travels as one array


@dataclass(frozen=True)
class CurveRules:
    """Conventions of a family of curves; every field is a literal name or a Column.

    `settlement` is the name of a rule, or a Column with the settlement lag in days.
    """

    calendar: Convention = "USD"
    settlement: Convention = "after_overnight"
    base: str = "spot"  # pillar days after the short end run from 'spot' or from 'today'
    frequency: Convention = "Annual"
    day_count: Convention = "ACT/360"
    count_from: str = "spot"  # payments are counted from 'spot' or from 'today'


OIS = CurveRules()
CAMARA = CurveRules(settlement="two_days")
CAMARA_SEMIANNUAL = CurveRules(settlement="two_days", frequency="SemiAnnual")
GOVERNMENT_MXN = CurveRules(calendar="MXN", settlement="same_day", frequency="SemiAnnual")
PROJECTION = CurveRules(base="today", frequency="Quarterly", count_from="today")


def by_curve(df: DataFrame) -> DataFrame:
    """Bring the rows of each (curve, date) together, over all shuffle partitions.

    Solving is heavy for its few bytes. A plain grouping would let adaptive execution merge
    small partitions by size and leave most cores idle; a partition count it must keep does not.
    """
    return df.repartition(partition_count(df.sparkSession), *CURVE_KEY)


def choose_side(quotes: DataFrame, side: Column, scale: Column) -> DataFrame:
    """Rate of each quote: bid, ask or mid, divided by the unit the quotes come in."""
    picked = F.when(side == "bid", F.col("bid")).when(side == "ask", F.col("ask")).otherwise(F.col("mid"))
    return quotes.withColumn("rate", picked / scale)


def first_quotes(quotes: DataFrame) -> DataFrame:
    """First quote of every tenor of a curve and date, by position, for sources that repeat tenors.

    A minimum combined on the map side; afterwards a curve has one row per tenor, which is what
    `definition_join` and the bootstrap gather.
    """
    rest = [c for c in quotes.columns if c not in (*CURVE_KEY, "tenor")]
    first = F.min_by(F.struct(*rest), F.col("pos")).alias("first")
    return quotes.groupBy(*CURVE_KEY, "tenor").agg(first).select(*CURVE_KEY, "tenor", "first.*").select(*quotes.columns)


def _quoted(quotes: DataFrame, rate: str) -> DataFrame:
    """One row per (curve, date) with `quoted`, a map from tenor to rate; of repeated tenors the first by position counts."""
    place = F.col("pos") if "pos" in quotes.columns else F.lit(0).alias("pos")  # a source that repeats no tenor needs none
    listed = F.array_sort(F.collect_list(F.struct(place, "tenor", F.col(rate).alias("quote"))))
    gathered = by_curve(quotes).groupBy(*CURVE_KEY).agg(listed.alias("listed"))
    first = F.filter("listed", lambda q, i: F.array_position(F.col("listed.tenor"), q["tenor"]) == i + 1)
    return gathered.select(
        *CURVE_KEY, F.map_from_entries(F.transform(first, lambda q: F.struct(q["tenor"], q["quote"]))).alias("quoted")
    )


def _filled(gathered: DataFrame, definition: Column, carried: list[str]) -> DataFrame:
    """A row per defined pillar, with rate 0 where there is no quote."""
    filled = F.transform(
        definition,
        lambda d: F.struct(
            *[d[c].alias(c) for c in ("pos", "tenor", "type_rate", *D.TENOR_FIELDS)],
            F.try_element_at(F.col("quoted"), d["tenor"]).alias("quote"),
        ),
    )
    return (
        gathered.select(*CURVE_KEY, *carried, F.inline(filled))
        .select(
            *CURVE_KEY, *carried, "pos", "tenor", "type_rate", *D.TENOR_FIELDS,
            F.coalesce("quote", F.lit(0.0)).alias("rate"),
            F.col("quote").isNull().alias("is_missing"),
        )
    )


def definition_join(quotes: DataFrame, pillars: tuple, rate: str = "mid") -> DataFrame:
    """Every defined pillar of every curve and date, with rate 0 where there is no quote.

    Of quotes that repeat a tenor the first by position counts. Sources that repeat tenors many
    times go through `first_quotes` before, so that the list gathered for a curve is no longer
    than its definition. One shuffle by (curve, date) serves this and the whole bootstrap after it.
    """
    definition = F.array(*[
        F.struct(
            F.lit(pos).alias("pos"), F.lit(tenor).alias("tenor"), F.lit(kind).alias("type_rate"),
            *[value.alias(name) for name, value in D.tenor_parts(tenor).items()],
        )
        for pos, tenor, kind in pillars
    ])
    return _filled(_quoted(quotes, rate), definition, [])


def definition_lists(definitions: DataFrame) -> DataFrame:
    """definitions(curve_id, pos, tenor, type_rate) -> curve_id, definition: each curve's pillars as one array, in order.

    A curve may have any number of pillars up to `MOST_PILLARS`; a longer list, or one that repeats a
    position, is an error and not cut. Rows without a tenor or position are no pillars.
    """
    rows = D.with_parsed_tenor(definitions.where("pos is not null and tenor is not null"))
    pillar = F.struct("pos", "tenor", "type_rate", *D.TENOR_FIELDS)
    listed = rows.groupBy("curve_id").agg(F.array_sort(F.collect_list(pillar)).alias("listed"))
    fault = F.when(F.size("listed") > MOST_PILLARS, F.raise_error(F.concat(
        F.lit(f"more than {MOST_PILLARS} pillars in the definition of curve "), F.col("curve_id").cast("string"))))
    fault = fault.when(F.size(F.array_distinct("listed.pos")) < F.size("listed"), F.raise_error(F.concat(
        F.lit("a position is defined twice for curve "), F.col("curve_id").cast("string"))))
    return listed.select("curve_id", fault.otherwise(F.col("listed")).alias("definition"))


def definition_list_join(quotes: DataFrame, lists: DataFrame, rate: str = "mid") -> DataFrame:
    """As `definition_join`, with every curve's own list of pillars from a table.

    `lists` has one row per curve: `definition` as `definition_lists` makes it, and any settings, which the
    pillars carry on. Quotes meet it as one row per (curve, date); curves without a definition, and
    quotes that a definition does not name, are left out.
    """
    settings = [c for c in lists.columns if c not in ("curve_id", "definition")]
    return _filled(_quoted(quotes, rate).join(lists, "curve_id"), F.col("definition"), settings)


def with_dates(quotes: DataFrame, rules: CurveRules) -> DataFrame:
    """Start, end and day count of every pillar."""
    today, kind = F.col("val_date"), F.col("type_rate")
    if isinstance(rules.settlement, str):
        overnight, spot = D.overnight_date(today, rules.settlement), D.spot_date(today, rules.settlement)
    else:  # a lag in days, kept with the curve
        overnight, spot = D.settlement_pair(today, rules.settlement)
    dated = D.with_parsed_tenor(quotes).withColumns({"overnight_date": overnight, "spot_date": spot})
    first_night = (kind == "OverNight") & (F.col("pos") == 1)
    strip = F.regexp_extract("tenor", r"^ED([0-9]+)$", 1).try_cast("int")
    start = (
        F.when(first_night, today)
        .when(kind == "OverNight", F.col("overnight_date"))
        .when(kind == "Future", D.futures_date(today, strip - 1))
        .otherwise(F.col("spot_date"))
    )
    end = (
        F.when(first_night, F.col("overnight_date"))
        .when(kind == "OverNight", F.col("spot_date"))
        .when(kind == "Future", D.futures_date(today, strip))
        .otherwise(D.roll(D.tenor_end(F.col("spot_date"), rules.calendar)))
    )
    long_base = F.col("spot_date") if rules.base == "spot" else today
    dated = dated.withColumns({
        "start_date": start,
        "end_date": end,
        "base_date": F.when(kind == "OverNight", today).otherwise(long_base),
    })
    return dated.withColumn("days", F.datediff("end_date", "base_date"))


def with_simple_df(pillars: DataFrame) -> DataFrame:
    """Linear ACT/360 factor over each pillar's own period; par instruments have none."""
    fraction = year_fraction("ACT/360", F.col("start_date"), F.col("end_date"))
    return pillars.withColumn(
        "simple_df",
        F.when(
            F.col("type_rate").isin("OverNight", "Cash", "Future"),
            discount_factor("Linear", F.col("rate"), fraction),
        ),
    )


def short_end(pillars: DataFrame) -> DataFrame:
    """Factors from today of the overnight block; the second night compounds on the first."""
    curve = Window.partitionBy(*CURVE_KEY)
    first = F.max(F.when(F.col("pos") == 1, F.col("simple_df"))).over(curve)
    return pillars.where(F.col("type_rate") == "OverNight").withColumn(
        "df", F.when(F.col("pos") == 1, F.col("simple_df")).otherwise(F.col("simple_df") * first)
    )


def spot_factor(pillars: DataFrame) -> Column:
    """Factor from today to spot of the row's curve: the product of its overnight factors."""
    curve = Window.partitionBy(*CURVE_KEY)
    first = F.max(F.when((F.col("type_rate") == "OverNight") & (F.col("pos") == 1), F.col("simple_df"))).over(curve)
    second = F.max(F.when((F.col("type_rate") == "OverNight") & (F.col("pos") == 2), F.col("simple_df"))).over(curve)
    return first * F.coalesce(second, F.lit(1.0))


def cash_block(pillars: DataFrame) -> DataFrame:
    """Money-market factors from spot, and anchored on the spot factor as seen from today."""
    anchored = pillars.withColumn("spot_df", spot_factor(pillars)).where(F.col("type_rate") == "Cash")
    return anchored.withColumns({
        "df": F.col("simple_df"),
        "df_today": F.col("simple_df") * F.col("spot_df"),
        "days_today": F.datediff("end_date", "val_date"),
    })


def _today_view(curve: DataFrame) -> tuple[Column, Column]:
    """Days and factor from today; the overnight pillars are from today already."""
    night = F.col("type_rate") == "OverNight"
    spot_df = F.max_by(F.col("df"), F.when(night, F.col("pos"))).over(Window.partitionBy(*CURVE_KEY))
    days = F.when(night, F.col("days")).otherwise(F.datediff("end_date", "val_date"))
    return days, F.col("df") * F.when(night, 1.0).otherwise(spot_df)


def to_today(curve: DataFrame) -> DataFrame:
    """Today basis of a spot-based curve: days from today, factors times the spot factor."""
    days, df = _today_view(curve)
    return curve.withColumns({"days": days, "df": df})


def two_bases(curve: DataFrame) -> DataFrame:
    """Both bases of a curve in one table, told apart by `basis`.

    Rows are widened and then split in place, so the solve before it is planned only once.
    """
    days, df = _today_view(curve)
    rest = [c for c in curve.columns if c not in ("days", "df")]
    both = F.array(
        F.struct(F.lit("settlement").alias("basis"), F.col("days").alias("days"), F.col("df").alias("df")),
        F.struct(F.lit("t").alias("basis"), F.col("days_today").alias("days"), F.col("df_today").alias("df")),
    )
    return curve.withColumns({"days_today": days, "df_today": df}).select(*rest, F.inline(both))


def type_blocks(quotes: DataFrame) -> DataFrame:
    """First and last position of every instrument type, and whether the block has no holes."""
    return quotes.groupBy(*CURVE_KEY, "type_rate").agg(
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.count(F.lit(1)).alias("n"),
        (F.max("pos") - F.min("pos") + 1 == F.count(F.lit(1))).alias("is_contiguous"),
    )


def definition_curve(quotes: DataFrame, info: DataFrame) -> DataFrame:
    """Curves straight from their definition, before any solve, in both bases.

    Overnight rows use the overnight rate from today; money-market rows are linear; the rest
    carries the placeholder 1. Weeks count as weeks for both the end date and the days.
    """
    settings = info.select(F.col("id_curve").alias("curve_id"), "settlement")
    rows = D.with_parsed_tenor(quotes).join(settings, "curve_id")
    overnight, spot = D.settlement_pair(F.col("val_date"), F.col("settlement"))
    night_rate = F.max(F.when(F.col("pos") == 1, F.col("rate"))).over(Window.partitionBy(*CURVE_KEY))
    rows = rows.withColumns({"on_date": overnight, "tn_date": spot, "night_rate": night_rate})
    lagged = F.col("tn_date") > F.col("val_date")
    first = F.col("pos") == 1
    second = (F.col("pos") == 2) & lagged
    unit = F.col("tenor_unit")
    number = D.tenor_months(F.col("tenor_number"), unit).cast("int")
    far_end = D.roll(
        F.when(unit == "W", F.date_add(F.col("tn_date"), number * 7)).otherwise(F.add_months("tn_date", number))
    )
    end = F.when(first, F.col("on_date")).when(second, F.col("tn_date")).otherwise(far_end)
    settle_start = (
        F.when(first, F.col("val_date")).when(second, F.col("on_date")).when(lagged, F.col("tn_date"))
        .otherwise(F.col("val_date"))
    )
    settle_base = F.when(first | second, F.col("val_date")).otherwise(F.col("tn_date"))
    rows = rows.withColumns({
        "end_date": end,
        "both": F.array(
            F.struct(F.lit("settlement").alias("basis"), settle_start.alias("start_date"), settle_base.alias("from_date")),
            F.struct(F.lit("t").alias("basis"), F.col("val_date").alias("start_date"), F.col("val_date").alias("from_date")),
        ),
    })
    rows = rows.select(
        *CURVE_KEY, "pos", "tenor", "type_rate", "rate", "night_rate", "end_date", (first | second).alias("is_night"),
        F.inline("both"),
    ).withColumn("days", F.datediff("end_date", "from_date"))
    fraction = F.col("days") / 360.0
    factor = (
        F.when(F.col("is_night"), 1.0 / (1.0 + F.col("night_rate") * fraction))
        .when(F.col("type_rate").isin("OverNight", "Cash"), 1.0 / (1.0 + F.col("rate") * fraction))
        .otherwise(1.0)
    )
    return rows.select(
        *CURVE_KEY, "basis", "pos", "tenor", "type_rate", "start_date", "end_date", "days",
        fraction.alias("yf"), factor.alias("df"),
    )
