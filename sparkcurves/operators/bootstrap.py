"""Bootstrapping: one discount factor per pillar, for all curves and dates in one job.

Pillars of a curve depend on each other, curves do not. So the work is spread over
(curve, date) and each curve's pillars - a short array - are folded in order (see `fold`).

All par instruments of one curve pay on the same grid of dates, counted from spot. The fold
carries the running sum over the grid dates already known, so a new pillar only looks at the
grid dates in its own gap: a curve costs its number of grid dates, not pillars times payments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurves.cluster import landed
from sparkcurves.functions import dates as D
from sparkcurves.functions.accrual import year_fraction
from sparkcurves.functions.exprs import let
from sparkcurves.operators.fold import fold_sql
from sparkcurves.operators.interpolation import gathered, log_df_at
from sparkcurves.operators.joins import salted_join
from sparkcurves.operators.pillars import CURVE_KEY, CurveRules, with_dates, with_simple_df

TOLERANCE = 1e-10
SHARED_KEY = ["discount_id", "val_date", "spot_date"]

_RESULT_FIELDS = (
    "pos", "tenor", "type_rate", "rate", "is_missing", "start_date", "end_date", "days", "payments", "target",
)
_PILLAR_FIELDS = (
    "pos", "tenor", "type_rate", "rate", "is_missing", "start_date", "end_date", "days",
    "simple_df", "payments", "grid_count", "last_fraction", "future_start", "target",
)


def prepare(quotes: DataFrame, rules: CurveRules) -> DataFrame:
    """Pillars with dates, closed-form factors and schedule counts; par instruments aim at 1."""
    pillars = with_simple_df(with_dates(quotes, rules))
    counted_from = F.col("spot_date") if rules.count_from == "spot" else F.col("val_date")
    pillars = pillars.withColumn("payments", D.schedule_count(rules.frequency, counted_from, F.col("end_date")))
    return with_schedule(pillars, rules).withColumn("target", F.lit(1.0))


def with_schedule(pillars: DataFrame, rules: CurveRules) -> DataFrame:
    """Grid dates up to each pillar, and the length of its own last period."""
    spot, end = F.col("spot_date"), F.col("end_date")
    last_start = D.payment_date(spot, rules.frequency, F.col("payments") - 1, rules.calendar)
    return pillars.withColumns({
        "grid_count": F.when(end < spot, -1).otherwise(D.periods_up_to(spot, end, rules.frequency, rules.calendar)),
        "last_fraction": year_fraction(rules.day_count, last_start, end),
        "future_start": F.datediff("start_date", "base_date"),
    })


def _grid(spot: Column, base: Column, rules: CurveRules, last: Column, discount: Column | None) -> Column:
    """Payment dates k = 0, 1, ... up to `last`: day, accrual since k-1, factor P."""

    def point(k: Column) -> Column:
        ends = F.struct(
            D.payment_date(spot, rules.frequency, k - 1, rules.calendar).alias("before"),
            D.payment_date(spot, rules.frequency, k, rules.calendar).alias("date"),
        )
        return let(ends, lambda e: F.struct(
            k.alias("k"), F.datediff(e["date"], base).alias("d"),
            F.when(k == 0, 0.0).otherwise(year_fraction(rules.day_count, e["before"], e["date"])).alias("tau"),
            (F.lit(0.0) if discount is None else F.exp(log_df_at(discount, F.datediff(e["date"], base)))).alias("discount"),
        ))

    return F.transform(F.sequence(F.lit(0), last), point)


def _last_grid_index() -> Column:
    return F.greatest(F.array_max(F.transform("pillars", lambda p: p["grid_count"])), F.lit(0))


def bootstrap(pillars: DataFrame, rules: CurveRules, settings: list[str] | None = None) -> DataFrame:
    """Curve rows with `df`, the solver's own `residual` and `converged`.

    `settings` names the columns that rules given as columns read; they are fixed per curve.
    """
    rows = gather_pillars(pillars, settings or [])
    return _folded(rows.withColumn("grid", _grid(F.col("spot_date"), _base(rules), rules, _last_grid_index(), None)), rules, dual=False)


def gather_pillars(pillars: DataFrame, settings: list[str] = ()) -> DataFrame:
    """One row per curve with its pillars in order. No shuffle after `definition_join`."""
    return pillars.groupBy(*CURVE_KEY, "spot_date", *settings).agg(
        F.array_sort(F.collect_list(F.struct(*_PILLAR_FIELDS))).alias("pillars")
    )


def bootstrap_dual(
    pillars: DataFrame, rules: CurveRules, discount: DataFrame,
    fixed_frequency: str = "SemiAnnual", fixed_day_count: str = "30/360",
) -> DataFrame:
    """Projection curves: swaps float on the unknown factors and discount on another curve.

    `discount` holds finished curves in today basis; the column `discount_id` of the pillars names
    the one each projection curve uses. The fixed leg's value there is the target of the floating
    leg. The swaps of a curve without a discount curve on its date stay unsolved.
    """
    rows = landed(gather_pillars(pillars, ["discount_id"]))
    shared = landed(_shared_legs(rows, rules, gathered(discount, "discount"), fixed_frequency, fixed_day_count))
    rows = salted_join(rows, shared, SHARED_KEY, spread="curve_id", how="left")

    aimed = rows.withColumn("pillars", _aimed(rules, fixed_frequency, fixed_day_count))
    return _folded(aimed, rules, dual=True)


def _counted_from(rules: CurveRules) -> Column:
    return F.col("spot_date") if rules.count_from == "spot" else F.col("val_date")


def _base(rules: CurveRules) -> Column:
    return F.col("spot_date") if rules.base == "spot" else F.col("val_date")


def _shared_legs(rows: DataFrame, rules: CurveRules, discount: DataFrame, frequency: str, day_count: str) -> DataFrame:
    """What all curves with one discount curve and spot date share, once: `discount`, `grid` and `annuity`.

    Their payment dates are the same from spot on, and so are the discount factors there. `annuity` is the fixed leg's
    running value by number of payments. Both are as long as the longest of these curves needs.
    """
    spot, today = F.col("spot_date"), F.col("val_date")
    count = F.array_max(F.transform("pillars", lambda p: D.schedule_count(frequency, _counted_from(rules), p["end_date"])))
    longest = rows.groupBy(*SHARED_KEY).agg(F.max(_last_grid_index()).alias("last"), F.max(count).alias("payments"))

    def paid(k: Column) -> Column:
        ends = F.struct(
            D.payment_date(spot, frequency, k - 1, rules.calendar).alias("before"),
            D.payment_date(spot, frequency, k, rules.calendar).alias("date"),
        )
        return let(ends, lambda e: year_fraction(day_count, e["before"], e["date"])
                   * F.exp(log_df_at(F.col("discount"), F.datediff(e["date"], today))))

    steps = F.when(F.col("payments") > 1, F.transform(F.sequence(F.lit(1), F.col("payments") - 1), paid)).otherwise(
        F.array().cast("array<double>"))
    running = F.aggregate(
        steps, F.array(F.lit(0.0)), lambda c, v: F.concat(c, F.array(F.get(c, F.size(c) - 1) + v))
    )
    other = discount.withColumnRenamed("curve_id", "discount_id")
    return longest.join(other, ["discount_id", "val_date"], "left").select(
        *SHARED_KEY, "discount", _grid(spot, _base(rules), rules, F.col("last"), F.col("discount")).alias("grid"), running.alias("annuity"),
    )


def _aimed(rules: CurveRules, frequency: str, day_count: str) -> Column:
    """Pillars with the discount factor at their end, and for swaps the fixed leg's value: the part of the
    shared annuity up to the last payment, and that payment."""

    def aim(p: Column) -> Column:
        factor = F.exp(log_df_at(F.col("discount"), p["days"]))
        count = D.schedule_count(frequency, _counted_from(rules), p["end_date"])

        def value(n: Column) -> Column:
            last = year_fraction(day_count, D.payment_date(F.col("spot_date"), frequency, n - 1, rules.calendar), p["end_date"])
            return let(factor, lambda f: p.withField("discount", f).withField(
                "target",
                F.when(p["type_rate"] == "Swap", p["rate"] * F.get("annuity", n - 1) + (1.0 + p["rate"] * last) * f)
                .otherwise(p["target"]),
            ))

        return let(count, value)

    return F.transform("pillars", aim)


def _folded(rows: DataFrame, rules: CurveRules, dual: bool) -> DataFrame:
    """Curve rows of gathered `pillars` on their `grid`; without a grid no swap is solved."""
    dated = rows.withColumn("grid", F.coalesce("grid", F.array().cast(rows.schema["grid"].dataType)))
    folded = dated.withColumn("solved", F.expr(fold_sql(dual=dual, anchored=rules.base == "today")))
    zipped = F.transform(
        "pillars",
        lambda p, i: F.struct(
            *[p[c].alias(c) for c in _RESULT_FIELDS],
            F.exp(F.get(F.col("solved"), i)["x"]).alias("df"),
            F.get(F.col("solved"), i)["r"].alias("residual"),
        ),
    )
    return folded.select(*CURVE_KEY, "spot_date", F.inline(zipped)).withColumn(
        "converged", F.coalesce(F.abs("residual") <= TOLERANCE, F.lit(False))
    )
