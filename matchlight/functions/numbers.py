"""Rounding, ratios, clamping and time arithmetic with one meaning everywhere."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int = 2) -> Column:
    """Round half up on exact decimals, returned as double.

    Rounding a double directly depends on its binary form; six decimals first makes it exact.
    """
    return F.round(exact(value), digits).cast("double")


def exact(value: Column) -> Column:
    """A double as a decimal with six places, so sums and comparisons do not depend on order."""
    return value.cast("decimal(28,6)")


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as double, NULL when the divisor is zero or NULL."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent(top: Column, bottom: Column, digits: int = 2) -> Column:
    return rounded(ratio(top * F.lit(100.0), bottom), digits)


def clamp(value: Column, low: float, high: float) -> Column:
    """Keep a value in [low, high]. NULL stays NULL: greatest/least alone would turn it into high."""
    return F.when(
        value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value))
    )


def moment(as_of: Column | str | datetime | date) -> Column:
    """The reference time of a job as timestamp_ntz."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def days_since(when: Column, as_of: Column | str) -> Column:
    """Calendar days between a time and the reference time."""
    return F.datediff(moment(as_of), when)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end as double, by the clock and so free of any time zone."""

    def of_day(when: Column) -> Column:
        second = F.extract(F.lit("SECOND"), when).cast("double")
        return F.hour(when) * 3600 + F.minute(when) * 60 + second

    return F.datediff(end, start) * F.lit(86400.0) + of_day(end) - of_day(start)


def fractional_days_since(when: Column, as_of: Column | str) -> Column:
    return seconds_between(when, moment(as_of)) / F.lit(86400.0)


def age_in_years(birthdate: Column, as_of: Column | str) -> Column:
    """Completed years; a birthday on 29 February counts from 1 March in other years."""
    today = moment(as_of).cast("date")
    not_yet = (F.month(today) < F.month(birthdate)) | (
        (F.month(today) == F.month(birthdate)) & (F.dayofmonth(today) < F.dayofmonth(birthdate))
    )
    return F.year(today) - F.year(birthdate) - not_yet.cast("int")


def exact_mean(value: Column) -> Column:
    """Mean over exact decimals: the same result in whatever order rows arrive."""
    return ratio(F.sum(exact(value)), F.count(value))


def half_even(value: Column, digits: int = 2) -> Column:
    """Round half to even on exact decimals, as data-frame libraries do."""
    return F.bround(exact(value), digits).cast("double")
