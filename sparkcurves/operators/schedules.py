"""Payment schedules as exploded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurves.functions import dates as D
from sparkcurves.functions.accrual import year_fraction
from sparkcurves.functions.exprs import Convention


def with_maturity(instruments: DataFrame, calendar: Convention = "USD", start: str = "start_date") -> DataFrame:
    """Rolled maturity of every instrument from its tenor."""
    parsed = D.with_parsed_tenor(instruments)
    return parsed.withColumn("due", D.tenor_end(F.col(start), calendar)).withColumn("maturity", D.roll(F.col("due")))


def bond_schedule(
    instruments: DataFrame, frequency: Convention, day_count: Convention = "ACT/360",
    calendar: Convention = "USD", with_start: bool = False,
) -> DataFrame:
    """One row per payment k = 1..n of each instrument, with its period and accrual.

    Both ends of a period come from the anchor and k, so no row needs its neighbour and
    nothing is shuffled. Payments before the last fall on rolled shifts of the start date, the
    last on the rolled maturity. `with_start` adds a row k = 0 on the start date.
    """
    start, end = F.col("start_date"), F.col("maturity")
    counted = instruments.withColumn("n", D.schedule_count(frequency, start, end))
    k, n = F.col("k"), F.col("n")

    def date_of(index: Column) -> Column:
        return F.when(index == n, end).otherwise(D.payment_date(start, frequency, index, calendar))

    rows = counted.withColumn("k", F.explode(F.sequence(F.lit(0 if with_start else 1), n)))
    rows = rows.withColumns({"period_start": date_of(k - 1), "period_end": date_of(k)})
    return rows.withColumn("accrual", year_fraction(day_count, F.col("period_start"), F.col("period_end")))


def with_payment_dates(instruments: DataFrame, frequency: Convention, calendar: Convention = "USD") -> DataFrame:
    """Adds `n` and `dates`, the dates k = 0..n of each instrument as an array; the dates are those of `bond_schedule`."""
    start, end, n = F.col("start_date"), F.col("maturity"), F.col("n")
    counted = instruments.withColumn("n", D.schedule_count(frequency, start, end))
    return counted.withColumn("dates", F.transform(
        F.sequence(F.lit(0), n), lambda k: F.when(k == n, end).otherwise(D.payment_date(start, frequency, k, calendar))))


def fixed_amount(notional: Column, rate: Column) -> Column:
    """Coupon of the row's period, with the notional on the last one."""
    coupon = notional * rate * F.col("accrual")
    return F.when(F.col("k") == F.col("n"), notional + coupon).otherwise(coupon)


def chained_starts(schedule: DataFrame, key: list[str]) -> DataFrame:
    """Period starts read from the previous row instead of computed from k; used as a check."""
    order = Window.partitionBy(*key).orderBy("k")
    return schedule.withColumn("chained_start", F.lag("period_end", 1).over(order))


def imm_strip(days: DataFrame, quantity: int, day: str = "day") -> DataFrame:
    """Futures strip of each day: `quantity` quarters, whether or not the first has expired."""
    today, k = F.col(day), F.col("k")
    rows = days.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(quantity))))
    return rows.withColumns({
        "start_date": D.futures_date(today, k - 1),
        "end_date": D.futures_date(today, k),
    }).withColumn("expired", F.col("start_date") < today)


def flow_table(instruments: DataFrame, payments_in_year: int, start: str = "spot_date") -> DataFrame:
    """Older cash-flow layout: months per step capped at the tenor on the last row.

    Gives k, n, period dates, yfc (period) and yf (from the start) on ACT/360, and day (from the start).
    """
    anchor, k = F.col(start), F.col("k")
    parsed = D.with_parsed_tenor(instruments)
    months = D.tenor_months(F.col("tenor_number"), F.col("tenor_unit")).cast("int")
    step = 12 // payments_in_year
    counted = parsed.withColumn("months", months).withColumn(
        "n", (F.ceil(F.col("months") / 12.0) * payments_in_year).cast("int")
    )
    rows = counted.where(F.col("n") > 0).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))

    def date_of(index: Column) -> Column:
        return F.when(index <= 0, anchor).otherwise(D.roll(F.add_months(anchor, F.least(index * step, F.col("months")))))

    rows = rows.withColumns({"period_start": date_of(k - 1), "period_end": date_of(k)})
    return rows.withColumns({
        "yfc": F.datediff("period_end", "period_start") / 360.0,
        "yf": F.datediff("period_end", start) / 360.0,
        "day": F.datediff("period_end", start),
    })
