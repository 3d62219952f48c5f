"""Calendar arithmetic: rolling, tenors, schedule shifts, payment counts, futures dates.

Every function returns a Column and works the same in a projection and in a lambda.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurves.functions.exprs import Convention, by_convention, choose

# Length of one tenor unit and of one coupon period per calendar.
TENOR_MONTHS_USD = {"M": 1, "Q": 3, "S": 6, "Y": 12}
TENOR_DAYS_MXN = {"M": 28, "Q": 92, "S": 182, "Y": 364}
PERIOD_MONTHS_USD = {"Monthly": 1, "Quarterly": 3, "SemiAnnual": 6, "Annual": 12}
PERIOD_DAYS_MXN = {"Monthly": 28, "Quarterly": 84, "SemiAnnual": 182, "Annual": 364}
PERIOD_DAYS_ANY = {"Daily": 1, "Weekly": 7}

TENOR_PATTERN = r"^([0-9]+(?:\.[0-9]+)?)([DWMQSY])$"


def roll(date: Column) -> Column:
    """Following business day; weekends only, holidays are not known here."""
    return F.when(F.weekday(date) < 5, date).otherwise(F.next_day(date, "Mon"))


def roll_back(date: Column) -> Column:
    """Business day on or before a date."""
    weekday = F.weekday(date)
    return F.date_sub(date, F.when(weekday == 5, 1).when(weekday == 6, 2).otherwise(0))


def tenor_number(tenor: Column) -> Column:
    """Number of a tenor such as '18M' or '32.5Y'; NULL for 'ON', 'TN', 'ED1'."""
    return F.regexp_extract(tenor, TENOR_PATTERN, 1).try_cast("double")


def tenor_unit(tenor: Column) -> Column:
    return F.nullif(F.regexp_extract(tenor, TENOR_PATTERN, 2), F.lit(""))


# Columns a tenor is read into: its parts, and the steps it stands for in each calendar.
TENOR_FIELDS = {"tenor_number": "double", "tenor_unit": "string", "usd_months": "int", "usd_days": "int", "mxn_days": "int"}


def tenor_parts(tenor: str) -> dict[str, Column]:
    """`TENOR_FIELDS` of a tenor known when the plan is made, as constants."""
    match = re.fullmatch(TENOR_PATTERN, tenor)
    values = dict.fromkeys(TENOR_FIELDS)
    if match:
        number, unit = float(match[1]), match[2]
        plain = number * {"D": 1, "W": 7}.get(unit, 0)
        steps = {
            "usd_months": number * TENOR_MONTHS_USD.get(unit, 0),
            "usd_days": plain,
            "mxn_days": plain + number * TENOR_DAYS_MXN.get(unit, 0),
        }
        values = {"tenor_number": number, "tenor_unit": unit}
        values |= {name: int(step) if step == int(step) else None for name, step in steps.items()}
    return {name: F.lit(values[name]).cast(kind) for name, kind in TENOR_FIELDS.items()}


def with_parsed_tenor(df: DataFrame) -> DataFrame:
    """Add `TENOR_FIELDS`, unless the rows carry them from their definition.

    The pattern is matched once per row; a tenor that does not parse, or is no whole number of
    steps in a calendar, gets NULL there.
    """
    if "tenor_unit" in df.columns:
        return df
    parsed = df.withColumns({"tenor_number": tenor_number(F.col("tenor")), "tenor_unit": tenor_unit(F.col("tenor"))})
    number, unit = F.col("tenor_number"), F.col("tenor_unit")
    plain = choose(unit, {"D": 1, "W": 7})
    return parsed.withColumns({
        "usd_months": _whole(number * F.coalesce(choose(unit, TENOR_MONTHS_USD), F.lit(0))),
        "usd_days": _whole(number * F.coalesce(plain, F.lit(0))),
        "mxn_days": _whole(number * F.coalesce(plain, choose(unit, TENOR_DAYS_MXN))),
    })


def tenor_end(date: Column, calendar: Convention) -> Column:
    """Unrolled end of the row's tenor, for rows with `TENOR_FIELDS`."""
    return by_convention(calendar, {
        "USD": lambda: F.add_months(F.date_add(date, F.col("usd_days")), F.col("usd_months")),
        "MXN": lambda: F.date_add(date, F.col("mxn_days")),
    })


def tenor_months(number: Column, unit: Column) -> Column:
    """Years as months, months as they are, the bare week count for weeks, 0 for the rest."""
    return (
        F.when(unit == "Y", number * 12)
        .when(unit.isin("M", "W"), number)
        .otherwise(F.lit(0.0))
    )


def _whole(value: Column) -> Column:
    return F.when(value == F.floor(value), value.cast("int"))


def shift(date: Column, frequency: Convention, count: Column, calendar: Convention) -> Column:
    """Move an anchor date by `count` coupon periods, always from the anchor itself."""

    def by_days(table: dict) -> dict:
        return {name: lambda days=days: F.date_add(date, count * days) for name, days in table.items()}

    by_months = {
        name: lambda months=months: F.add_months(date, count * months) for name, months in PERIOD_MONTHS_USD.items()
    }
    plain = by_days(PERIOD_DAYS_ANY)
    return by_convention(calendar, {
        "USD": lambda: by_convention(frequency, plain | by_months),
        "MXN": lambda: by_convention(frequency, plain | by_days(PERIOD_DAYS_MXN)),
    })


def payment_date(start: Column, frequency: Convention, k: Column, calendar: Convention) -> Column:
    """k-th payment date of a schedule; the start itself is taken as it is, the rest roll."""
    return F.when(k <= 0, start).otherwise(roll(shift(start, frequency, k, calendar)))


def month_span(start: Column, end: Column) -> Column:
    """Difference of the calendar months, whatever the days are."""
    return (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))


def payment_count(frequency: Convention, start: Column, end: Column) -> Column:
    """Payments between two dates, counted on calendar months.

    Annual and semiannual counts round up. The quarterly count divides the months left over
    after whole years by four, not three, and rounds half to even: this is the published rule
    and only whole-year spans are meaningful. `schedule_count` is the one schedules use.
    """
    years = F.year(end) - F.year(start)
    months = F.month(end) - F.month(start)
    return by_convention(frequency, {
        "Annual": lambda: years + F.ceil(months / 12.0),
        "SemiAnnual": lambda: years * 2 + F.ceil(months / 6.0),
        "Quarterly": lambda: years * 4 + F.bround(months / 4.0),
        "Monthly": lambda: years * 12 + months,
    }).cast("int")


def schedule_count(frequency: Convention, start: Column, end: Column) -> Column:
    """Payments of a schedule: as `payment_count`, but a quarter has three months; at least one.

    NULL for a frequency without a rule.
    """

    def quarterly() -> Column:
        return ((F.year(end) - F.year(start)) * 4 + F.bround((F.month(end) - F.month(start)) / 3.0)).cast("int")

    counts = {name: lambda name=name: payment_count(name, start, end) for name in PERIOD_MONTHS_USD}
    count = by_convention(frequency, counts | {"Quarterly": quarterly})
    return F.when(count.isNotNull(), F.greatest(count, F.lit(1)))


def ratio_count(start: Column, end: Column, period_end: Column) -> Column:
    """Payments as days to maturity over the days of the first period, rounded up."""
    return F.ceil(F.datediff(end, start) / F.datediff(period_end, start)).cast("int")


def day_count_ratio(start: Column, end: Column, period_fraction: Column) -> Column:
    """Payments as days to maturity over the nominal period in days, rounded half to even."""
    return F.rint(F.datediff(end, start) / (period_fraction * 365.0)).cast("int")


def periods_up_to(start: Column, end: Column, frequency: Convention, calendar: Convention) -> Column:
    """Largest k whose payment date is not after `end`; 0 for the start itself.

    A rolled date is not after `end` exactly when the unrolled one is not after the business
    day on or before `end`.
    """
    reach = roll_back(end)

    def by_days(table: dict) -> dict:
        return {
            name: lambda days=days: F.floor(F.datediff(reach, start) / days).cast("int") for name, days in table.items()
        }

    def by_months(months: int) -> Column:
        reached = F.floor(month_span(start, reach) / months).cast("int")
        return reached - F.when(F.add_months(start, reached * months) > reach, 1).otherwise(0)

    plain = by_days(PERIOD_DAYS_ANY)
    calendar_months = {name: lambda months=months: by_months(months) for name, months in PERIOD_MONTHS_USD.items()}
    passed = by_convention(calendar, {
        "USD": lambda: by_convention(frequency, plain | calendar_months),
        "MXN": lambda: by_convention(frequency, plain | by_days(PERIOD_DAYS_MXN)),
    })
    return F.greatest(passed, F.lit(0))


def third_wednesday(month_start: Column) -> Column:
    return F.date_add(month_start, F.pmod(2 - F.weekday(month_start), F.lit(7)) + 14)


def futures_date(date: Column, index: Column) -> Column:
    """Delivery date `index` quarters after the end of the quarter that holds `date`."""
    return third_wednesday(F.add_months(F.trunc(date, "quarter"), index * 3 + 2))


def overnight_date(today: Column, rule: Convention) -> Column:
    """End of the overnight deposit. Same-day curves do not roll it."""
    rolled = roll(F.date_add(today, 1))
    return by_convention(rule, {
        "after_overnight": lambda: rolled,
        "two_days": lambda: rolled,
        "same_day": lambda: F.date_add(today, 1),
    })


def spot_date(today: Column, rule: Convention) -> Column:
    """Start of spot trades: one day after the overnight end, two days after today, or today."""
    return by_convention(rule, {
        "after_overnight": lambda: roll(F.date_add(overnight_date(today, "after_overnight"), 1)),
        "two_days": lambda: roll(F.date_add(today, 2)),
        "same_day": lambda: roll(today),
    })


def settlement_pair(today: Column, lag: Column) -> tuple[Column, Column]:
    """Overnight and spot dates from a settlement lag in days kept with the curve."""
    overnight = roll(F.date_add(today, F.greatest(lag - 1, F.lit(1))))
    return overnight, roll(F.date_add(today, lag))
