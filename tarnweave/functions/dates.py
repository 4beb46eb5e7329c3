"""Durations between dates, as column expressions. A null date gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plus(day: Column, months: Column | int = 0, days: Column | int = 0) -> Column:
    """Months first, at the end of a shorter month where there is no such day, then days."""
    return F.date_add(F.add_months(day, months), days)


def between(first: Column, last: Column) -> Column:
    """(months, days): as many whole months as fit, then days, so that plus() of them leads from the earlier date to the later
    one; both negative where `last` is the earlier one. A null date gives a null struct."""
    low, high = F.least(first, last), F.greatest(first, last)
    most = (F.year(high) - F.year(low)) * 12 + F.month(high) - F.month(low)
    months = most - F.when(F.add_months(low, most) > high, 1).otherwise(0)
    sign = F.when(last < first, -1).otherwise(1)
    days = F.datediff(high, F.add_months(low, months))
    return F.when(first.isNotNull() & last.isNotNull(), F.struct((months * sign).alias("months"), (days * sign).alias("days")))
