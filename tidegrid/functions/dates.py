"""Business-day arithmetic in closed form and calendar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions.scalar import col

EPOCH_MONDAY = "1969-12-29"


def _days(c) -> Column:
    return F.datediff(col(c), F.lit(EPOCH_MONDAY).cast("date"))


def _floor_div(a: Column, n: int) -> Column:
    return F.floor(a / n).cast("int")


def is_business_day(c) -> Column:
    return F.weekday(col(c)) < 5


def business_index(c) -> Column:
    """Number of the business day; a weekend has the number of the Monday after it."""
    d = _days(c)
    week = _floor_div(d, 7)
    return week * 5 + F.least(d - week * 7, F.lit(5))


def from_business_index(i: Column) -> Column:
    week = _floor_div(i, 5)
    return F.date_add(F.lit(EPOCH_MONDAY).cast("date"), (week * 7 + (i - week * 5)).cast("int"))


def add_business_days(c, n) -> Column:
    """Roll a weekend forward to Monday, then move ``n`` business days."""
    return from_business_index(business_index(c) + (F.lit(n) if isinstance(n, int) else col(n)))


def business_days_between(a, b) -> Column:
    """Business days in [a, b], both ends counted."""
    return business_index(F.date_add(col(b), 1)) - business_index(a)


def business_lag(a, b) -> Column:
    """Length of the business-day range from a to b, less one."""
    return business_days_between(a, b) - 1


def third_friday(year, month) -> Column:
    return F.next_day(F.make_date(col(year), col(month), F.lit(14)), "Fri")


def month_after(year, month) -> Column:
    return F.add_months(F.make_date(col(year), col(month), F.lit(1)), 1)


def contract_expiry(year, month) -> Column:
    """30 days before the third Friday of the month after the contract month."""
    nxt = month_after(year, month)
    return F.date_sub(third_friday(F.year(nxt), F.month(nxt)), 30)


# Futures month letters, January to December.
MONTH_LETTERS = "FGHJKMNQUVXZ"


def contract_code(year, month) -> Column:
    return F.concat(F.substring(F.lit(MONTH_LETTERS), col(month), F.lit(1)), (col(year) % 10).cast("string"))


def expiry_wednesday(option_expiry) -> Column:
    """30 days before an option expiry, rolled forward to a Wednesday."""
    return F.next_day(F.date_sub(col(option_expiry), 31), "Wed")


def near_month_day(c, target: int, window: int) -> Column:
    return F.abs(F.dayofmonth(col(c)) - target) <= window


def week_of_month(c) -> Column:
    return F.floor((F.dayofmonth(col(c)) - 1) / 7).cast("int") + 1


def earnings_intensity(c) -> Column:
    """0.25 in weeks 2 to 4 of January, April, July and October, else 0.05."""
    return F.when(F.month(col(c)).isin(1, 4, 7, 10) & week_of_month(c).isin(2, 3, 4), 0.25).otherwise(0.05)


def last_complete_month_end(today) -> Column:
    return F.date_sub(F.trunc(col(today), "month"), 1)


def training_start(end, years: int, warmup_days: int = 450) -> Column:
    return F.date_sub(col(end), years * 365 + warmup_days)


def back_to_weekday(c) -> Column:
    """Saturday and Sunday move back to Friday."""
    return F.date_sub(col(c), F.greatest(F.weekday(col(c)) - 4, F.lit(0)))


def refetch_start(last_day, lookback: int = 5) -> Column:
    return back_to_weekday(F.date_sub(col(last_day), lookback))


def month_day_columns(c) -> dict[str, Column]:
    return {"month": F.month(col(c)), "day_of_week": F.weekday(col(c)), "day_of_month": F.dayofmonth(col(c))}
