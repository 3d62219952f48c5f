"""Day counts, year fractions and discount factors of single rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurves.functions.exprs import Convention, by_convention, choose

# Year fraction of one period, by frequency and calendar.
FREQUENCY_FRACTION_USD = {
    "None": 1.0,
    "Daily": 1.0 / 360.0,
    "Monthly": 1.0 / 12.0,
    "Quarterly": 1.0 / 4.0,
    "SemiAnnual": 1.0 / 2.0,
    "Annual": 1.0,
}
FREQUENCY_FRACTION_MXN = {
    "Monthly": 28.0 / 360.0,
    "Quarterly": 91.0 / 360.0,
    "SemiAnnual": 182.0 / 360.0,
    "Annual": 364.0 / 360.0,
}


def _thirty_360(start: Column, end: Column, first_day: Column, last_day: Column) -> Column:
    months = (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))
    return (months * 30 + (last_day - first_day)) / F.lit(360.0)


def year_fraction(convention: Convention, start: Column, end: Column) -> Column:
    """Accrual factor for ACT/360, ACT/365F, 30/360 (no February rule) and 30E/360."""
    days = F.datediff(end, start)
    first_day = F.least(F.dayofmonth(start), F.lit(30))
    last_day = F.dayofmonth(end)

    def thirty_us() -> Column:
        cut = F.when((last_day == 31) & (first_day == 30), 30).otherwise(last_day)
        return _thirty_360(start, end, first_day, cut)

    return by_convention(convention, {
        "ACT/360": lambda: days / F.lit(360.0),
        "ACT/365F": lambda: days / F.lit(365.0),
        "30/360": thirty_us,
        "30E/360": lambda: _thirty_360(start, end, first_day, F.least(last_day, F.lit(30))),
    })


def discount_factor(compounding: Convention, rate: Column, fraction: Column) -> Column:
    """Discount factor of one rate over one period: Linear, Compound or Continuous."""
    return by_convention(compounding, {
        "Linear": lambda: 1.0 / (1.0 + rate * fraction),
        "Compound": lambda: 1.0 / F.pow(1.0 + rate, fraction),
        "Continuous": lambda: F.exp(-rate * fraction),
    })


def frequency_fraction(frequency: Convention, calendar: Convention) -> Column:
    """Nominal year fraction of a payment frequency; NULL where none is defined."""
    return by_convention(calendar, {
        "USD": lambda: choose(frequency, FREQUENCY_FRACTION_USD),
        "MXN": lambda: choose(frequency, FREQUENCY_FRACTION_MXN),
    })
