"""The notice jobs run once a day over a range of dates, as one job.

"No such notice within the last seven days" makes a run depend on what the
earlier runs of the range have written.  For a member that is a greedy choice
over the days on which a notice is due: the first one that is not silenced,
then the first at least `gap` days later, and so on.  Due days come as a few
intervals a member, so the choice is a fold over the member's intervals (never
more than the range has days), not a run of the job for each day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitlake.functions.exprs import lit_date
from fitlake.operators.notices import expiry_message, inactive_message, renewal_message
from fitlake.sources.tables import Tables

_DAYS = "struct<next:date,days:array<date>>"


def chosen_days(due: DataFrame, silenced: DataFrame, first: dt.date | None, last: dt.date | None, gap: int,
                keys: tuple[str, ...] = ("M_ID",)) -> DataFrame:
    """(keys, day): of the days in the intervals `due` (keys, lo, hi; NULL: up
    to the end of the range) between `first` and `last` (None: no such bound),
    each key's first one after `until` of `silenced` (keys, until), and always
    the next one `gap` days later at least.  Intervals may overlap and repeat."""
    lo, hi = F.col("lo"), F.col("hi")
    if first is not None:
        lo = F.greatest(F.coalesce(lo, lit_date(first)), lit_date(first))
    if last is not None:
        hi = F.least(F.coalesce(hi, lit_date(last)), lit_date(last))
    # distinct intervals within the range: their number is bounded by its days
    spans = (due.select(*keys, lo.alias("lo"), hi.alias("hi")).filter("lo <= hi").groupBy(*keys)
             .agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
             .join(silenced, list(keys), "left"))
    start = F.struct(F.date_add("until", 1).alias("next"), F.array().cast("array<date>").alias("days")).cast(_DAYS)

    def step(done: Column, span: Column) -> Column:
        begin = F.greatest(done["next"], span["lo"])  # passes over a NULL: not silenced
        days = F.sequence(begin, span["hi"], F.expr(f"INTERVAL {gap} DAYS"))
        more = F.struct(F.date_add(F.element_at(days, -1), gap).alias("next"),
                        F.concat(done["days"], days).alias("days")).cast(_DAYS)
        return F.when(begin <= span["hi"], more).otherwise(done)

    fold = F.aggregate("spans", start, step)
    return spans.select(*keys, F.explode(fold["days"]).alias("day"))


def _silenced(t: Tables, ntype: str, before: dt.date | None, like: str | None = None, hours: int = 0) -> DataFrame:
    """(M_ID, until): the last run date that a stored notice still silences,
    for runs at `hours` o'clock that look back seven days."""
    n = t.notifications.filter(F.col("Type") == ntype)
    if before is not None:
        n = n.filter(F.col("CreatedAt") < F.lit(dt.datetime.combine(before, dt.time())).cast("timestamp_ntz"))
    if like is not None:
        n = n.filter(F.col("Message").like(like))
    newest = n.groupBy("M_ID").agg(F.max("CreatedAt").alias("c"))
    return newest.select("M_ID", F.to_date(F.col("c") + F.expr(f"INTERVAL {7 * 24 - hours} HOURS")).alias("until"))


def _rows(days: DataFrame, message: Column, ntype: str, hours: int = 0) -> DataFrame:
    at = F.col("day").cast("timestamp_ntz") + F.expr(f"INTERVAL {hours} HOURS")
    return days.select("M_ID", message.alias("Message"), F.lit(ntype).alias("Type"), F.lit(False).alias("IsRead"),
                       at.alias("CreatedAt"))


def renewal_notice_run(t: Tables, first: dt.date, last: dt.date) -> DataFrame:
    """`renewal_notices` of every day from `first` to `last`, each run seeing
    the notices of the earlier ones (CreatedAt: midnight of the run date)."""
    mt = t.membership_type.select(F.col("Type_ID").alias("MembershipType_ID"), F.col("Duration").alias("_months"))
    m = (t.member.filter(F.col("IsActive")).join(mt, "MembershipType_ID")
         .select("M_ID", "Name", F.add_months("JoinDate", F.col("_months")).alias("_renew")))
    due = m.select("M_ID", F.date_sub("_renew", 7).alias("lo"), F.col("_renew").alias("hi")).filter("hi is not null")
    days = chosen_days(due, _silenced(t, "renewal", None), first, last, gap=8)
    return _rows(m.join(days, "M_ID"), renewal_message(F.col("day")), "renewal")


def expiry_notice_run(t: Tables, first: dt.date, last: dt.date, hours: int = 12) -> DataFrame:
    """The application's job (`renewal_notices_stored_date`) run daily at
    `hours` o'clock: stored end dates, notices of the last 7 x 24 hours."""
    mt = t.membership_type.select(F.col("Type_ID").alias("MembershipType_ID"), F.col("Name").alias("_type"))
    m = (t.member.filter(F.col("IsActive") & F.col("MembershipEndDate").isNotNull()).join(mt, "MembershipType_ID")
         .select("M_ID", "_type", "MembershipEndDate"))
    due = m.select("M_ID", F.date_sub("MembershipEndDate", 7).alias("lo"), F.col("MembershipEndDate").alias("hi"))
    # a notice of noon is still within seven days at noon a week later
    days = chosen_days(due, _silenced(t, "renewal", None, hours=hours), first, last, gap=8)
    return _rows(m.join(days, "M_ID"), expiry_message(F.col("day")), "renewal", hours)


def inactive_notice_run(t: Tables, first: dt.date, last: dt.date, days: int = 14, replay: bool = False) -> DataFrame:
    """`inactive_member_notices` of every day from `first` to `last`.

    By default each run reads the tables as they stand now.  With `replay` a
    run sees the log up to its own date and, of stored notices, those from
    before the range.  A member without a workout (so far) gets a notice with
    a NULL message, which silences nothing and so comes every day ([T5])."""
    m = t.member.filter(F.col("IsActive")).select("M_ID", "Name")
    dates = t.workout_log.join(m.select("M_ID"), "M_ID", "left_semi").select("M_ID", "Date").filter("Date is not null")
    if replay:
        seen = dates.filter(F.col("Date") <= lit_date(last)).distinct()
        until = F.date_sub(F.lead("Date").over(Window.partitionBy("M_ID").orderBy("Date")), 1)
        idle = seen.select("M_ID", F.col("Date").alias("_last"), until.alias("hi"))
    else:
        idle = dates.groupBy("M_ID").agg(F.max("Date").alias("_last")).withColumn("hi", F.lit(None).cast("date"))
    idle = idle.withColumn("lo", F.date_add("_last", days)).filter("hi is null or lo <= hi")
    silenced = _silenced(t, "system", first if replay else None, "%We miss you%")
    chosen = chosen_days(idle.select("M_ID", "lo", "hi"), silenced, first, last, gap=8)
    # the workout before a chosen day: the one whose interval holds it
    told = (chosen.join(idle, "M_ID").filter((F.col("day") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("day") <= F.col("hi"))))
            .join(m, "M_ID").withColumn("Days_Inactive", F.datediff("day", "_last")))
    begun = dates.groupBy("M_ID").agg(F.min("Date").alias("_first"))
    never = m.join(begun, "M_ID", "left").select("M_ID", "Name", F.lit(None).cast("date").alias("lo"), F.date_sub(
        "_first", 1).alias("hi"), F.col("_first").isNotNull().alias("_later"))
    if not replay:
        never = never.filter(~F.col("_later"))
    every = chosen_days(never, silenced, first, last, gap=1).join(m, "M_ID") \
        .withColumn("Days_Inactive", F.lit(None).cast("int"))
    both = told.select("M_ID", "Name", "day", "Days_Inactive").unionByName(
        every.select("M_ID", "Name", "day", "Days_Inactive"))
    return _rows(both, inactive_message(), "system")
