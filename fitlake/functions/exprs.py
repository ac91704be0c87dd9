"""Column-expression helpers shared by all operators (JVM-side, codegen'd)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitlake.sources.schema import BOOKING

DEFAULT_AS_OF = dt.date(2024, 1, 30)


def lit_date(d: dt.date | str) -> Column:
    if isinstance(d, str):
        d = dt.date.fromisoformat(d)
    return F.lit(d)


def days_before(as_of: dt.date, n: int) -> Column:
    """`DATE_SUB(as_of, INTERVAL n DAY)` folded to a literal on the driver."""
    return F.lit(as_of - dt.timedelta(days=n))


def days_after(as_of: dt.date, n: int) -> Column:
    return F.lit(as_of + dt.timedelta(days=n))


def midnight(d: dt.date) -> Column:
    return F.lit(dt.datetime.combine(d, dt.time())).cast("timestamp_ntz")


def is_booking(col: str = "Exercise") -> Column:
    return F.col(col) == F.lit(BOOKING)


def not_booking(col: str = "Exercise") -> Column:
    """`Exercise != 'Session Booking'` with SQL three-valued logic (NULL excluded)."""
    return F.col(col) != F.lit(BOOKING)




def email_key(email: Column | str) -> Column:
    """What makes two e-mail addresses the same: letters' case does not count
    ([T1], the source's collation)."""
    return F.lower(F.col(email) if isinstance(email, str) else email)


def age_group(age: Column | str) -> Column:
    """Age bucket; NULL age falls through to the last branch like a SQL CASE."""
    a = F.col(age) if isinstance(age, str) else age
    return (F.when(a < 18, "Teen")
            .when(a.between(18, 25), "Young Adult")
            .when(a.between(26, 40), "Adult")
            .when(a.between(41, 60), "Middle Age")
            .otherwise("Senior"))


def duration_hhmm(minutes: Column | str) -> Column:
    """Minutes -> 'HH:MM'; LPAD to width 2 also truncates (6000 min -> '10:00')."""
    m = F.col(minutes) if isinstance(minutes, str) else minutes
    hours = F.floor(m / 60).cast("bigint").cast("string")
    mins = (m % 60).cast("string")
    return F.concat(F.lpad(hours, 2, "0"), F.lit(":"), F.lpad(mins, 2, "0"))


def avg_exact(col: Column | str, in_scale: int = 0) -> Column:
    """MySQL AVG: exact mean rounded half-up to `in_scale + 4` decimals.

    Integer inputs are widened to DECIMAL first, so Spark's decimal average
    (scale + 4, HALF_UP) is exactly MySQL's result type and value.
    """
    c = F.col(col) if isinstance(col, str) else col
    if in_scale == 0:
        c = c.cast("decimal(18,0)")
    return F.avg(c)


def half_up_ratio(num: Column, den: Column, scale: int) -> Column:
    """num / den for non-negative integers, rounded half-up to `scale`
    decimals in exact decimal arithmetic (no floating point)."""
    n = num.cast("decimal(38,0)") * F.lit(2 * 10 ** scale) + den.cast("decimal(38,0)")
    d = den.cast("decimal(38,0)") * F.lit(2)
    q = ((n - n % d) / d).cast("decimal(38,0)")
    return (q / F.lit(10 ** scale)).cast(f"decimal(18,{scale})")






def ci(col: Column | str) -> Column:
    """Case/accent-insensitive comparison key (reference collation is *_unicode_ci)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.collate(c, "UNICODE_CI_AI_RTRIM")


def time_12h(time_col: str = "SessionTime") -> Column:
    """`TIME_FORMAT(t, '%h:%i %p')`, e.g. '06:30 PM'."""
    return F.date_format(F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), F.col(time_col))),
                         "hh:mm a")


def long_date(col: Column | str) -> Column:
    """`DATE_FORMAT(d, '%M %d, %Y')`, e.g. 'January 05, 2024'."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "MMMM dd, yyyy")


def order_key(date_col: str, id_col: str) -> Column:
    """(date, id) packed into one DECIMAL(38,0) that sorts like the pair for
    every 64-bit id, so `max_by`/`min_by` keep updatable buffers and run as
    hash aggregates."""
    return (F.unix_date(F.col(date_col)).cast("decimal(18,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)")
            + F.col(id_col).cast("decimal(20,0)")).cast("decimal(38,0)")



