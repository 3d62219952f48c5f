"""Cash flows and present values on finished curves.

A loan is priced within its own row: its payment dates are an array, its curve is another, and the factors at the dates are read
from the one with the other. Rows are never matched by their values, so equal loans stay apart, and the only join is that with
the curves. Curves are given as `interpolation.curve_lines` stores them. Loans are dealt evenly over all tasks, so that a book on one
curve and date is priced by all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurves.functions.accrual import year_fraction
from sparkcurves.operators.interpolation import dealt, factors_at, with_curve
from sparkcurves.operators.pillars import CURVE_KEY
from sparkcurves.operators.schedules import with_payment_dates


def _payments(body: Callable[[Column], Column]) -> Column:
    """body(k) for every payment k = 1..n of the row."""
    return F.transform(F.sequence(F.lit(1), F.col("n")), body)


def _total(amounts: Column) -> Column:
    return F.aggregate(amounts, F.lit(0.0), lambda total, amount: total + amount)


def _dated(loans: DataFrame, lines: DataFrame, frequency: str, calendar: str = "USD") -> DataFrame:
    """Loans with `dates` and `days` of k = 0..n, and `factors` of their curve at each of them."""
    rows = with_payment_dates(with_curve(dealt(loans), lines), frequency, calendar)
    rows = rows.withColumn("days", F.transform("dates", lambda d: F.datediff(d, "val_date")))
    return rows.withColumn("factors", factors_at(F.col("on_curve"), F.col("days"))).drop("on_curve")


def bond_values(
    loans: DataFrame, lines: DataFrame, frequency: str, calendar: str = "USD", day_count: str = "ACT/360"
) -> DataFrame:
    """Every loan with `pv`, the sum of its discounted flows, and `payments`; one row per row.

    `loans` have curve_id, val_date, start_date, maturity, rate and notional; all their columns are kept. A loan whose
    curve is missing on its date has a NULL value.
    """
    accrued = _total(_payments(lambda k: year_fraction(day_count, F.get("dates", k - 1), F.get("dates", k)) * F.get("factors", k)))
    pv = F.col("notional") * (F.col("rate") * accrued + F.get("factors", F.col("n")))
    return _dated(loans, lines, frequency, calendar).select(*loans.columns, F.col("n").cast("long").alias("payments"), pv.alias("pv"))


def _growth(k: Column) -> Column:
    return F.get("factors", k - 1) / F.get("factors", k) - 1.0


def floating_flows(loans: DataFrame, projection: DataFrame, frequency: str = "Quarterly") -> DataFrame:
    """Floating payments: the loan's columns, n, k, its period, accrual, day, forward rate and amount.

    The forward of a period is the ratio of the projection factors at its ends; each date is read once. Loans without a
    projection curve keep their payments, with NULL forwards and amounts.
    """
    flows = _payments(lambda k: F.struct(
        k.alias("k"), F.get("dates", k - 1).alias("period_start"), F.get("dates", k).alias("period_end"), F.get("days", k).alias("day"),
        _growth(k).alias("growth")))
    rows = _dated(loans, projection, frequency).select(*loans.columns, "n", F.inline(flows))
    coupon = F.col("notional") * F.col("growth")
    rows = rows.withColumn("accrual", year_fraction("ACT/360", F.col("period_start"), F.col("period_end")))
    return rows.withColumns({
        "forward_rate": F.try_divide("growth", "accrual"),
        "amount": F.when(F.col("k") == F.col("n"), F.col("notional") + coupon).otherwise(coupon),
    }).drop("growth")


def floating_values(loans: DataFrame, projection: DataFrame, discount: DataFrame, frequency: str = "Quarterly") -> DataFrame:
    """Every loan with the present value of its floating leg, projected on one curve and discounted on another; one row per row.

    `discount_id` names each loan's discount curve. A loan that lacks either curve on its date has a NULL value.
    """
    rows = with_curve(_dated(loans, projection, frequency), discount, "other", "discount_id")
    rows = rows.withColumn("discounts", factors_at(F.col("other"), F.col("days")))
    coupons = _total(_payments(lambda k: _growth(k) * F.get("discounts", k)))
    pv = F.col("notional") * (coupons + F.get("discounts", F.col("n")))
    return rows.select(*loans.columns, F.col("n").cast("long").alias("payments"), pv.alias("pv"))


def forward_rates(curve: DataFrame) -> DataFrame:
    """Simple ACT/360 forward between consecutive pillars of each curve."""
    order = Window.partitionBy(*CURVE_KEY).orderBy("days")
    before = curve.withColumns({
        "from_day": F.lag("days").over(order),
        "df_from": F.lag("df").over(order),
    })
    fraction = (F.col("days") - F.col("from_day")) / 360.0
    return before.where(F.col("from_day").isNotNull()).withColumn(
        "forward_rate", F.try_divide(F.col("df_from") / F.col("df") - 1.0, fraction)
    )
