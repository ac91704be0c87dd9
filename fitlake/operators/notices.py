"""Notification jobs and notification-writing rules, set-based: every
member is evaluated in one pass and de-duplication against existing
notifications is an anti join."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.functions.exprs import (DEFAULT_AS_OF, days_after, is_booking, lit_date, long_date,
                                     midnight, not_booking, time_12h)
from fitlake.operators.common import append_rows, notice, top_k
from fitlake.sources.tables import Tables

# ---- fixed values that must equal the reference's ---------------------------
MILESTONES = {
    10: "Congratulations! You have completed 10 workouts. Keep up the great work!",
    25: "Amazing! 25 workouts completed. You are making excellent progress!",
    50: "Incredible milestone! 50 workouts completed. You are a fitness champion!",
    100: "Legendary achievement! 100 workouts completed. Outstanding dedication!",
}
LOW_ENGAGEMENT_MESSAGE = ("We have missed you! It has been a week since your last workout. "
                          "Come back and continue your fitness journey!")
# The reference's welcome text names its product; a neutral default is used here.
WELCOME_MESSAGE = "Welcome! You have logged your first workout. Great start!"


def _recent(t: Tables, ntype: str, since: Column, like: str | None = None,
            ci: bool = False) -> DataFrame:
    """Members with a notice of `ntype` since `since` (optionally whose
    message matches `like`; `ci=True` matches case-insensitively like the
    reference's collation, [T1] — LIKE needs the UTF8_LCASE collation)."""
    n = t.notifications.filter((F.col("Type") == ntype) & (F.col("CreatedAt") >= since))
    if like is not None:
        msg = F.collate(F.col("Message"), "UTF8_LCASE") if ci else F.col("Message")
        n = n.filter(msg.like(like))
    return n.select("M_ID").distinct()


def renewal_message(day: Column) -> Column:
    """Of a member's row (Name, `_renew`) on run date `day`."""
    days = F.datediff("_renew", day)
    return F.concat(F.lit("Hello "), F.col("Name"), F.lit("! Your membership renews in "),
                    days.cast("string"), F.lit(" day"), F.when(days > 1, "s").otherwise(""),
                    F.lit(" on "), long_date("_renew"),
                    F.lit(". Please contact us to renew your membership."))


def expiry_message(day: Column) -> Column:
    """Of a member's row (`_type`, MembershipEndDate) on run date `day`."""
    return F.concat(F.lit("Your "), F.coalesce(F.col("_type"), F.lit("None")),
                    F.lit(" membership expires in "),
                    F.datediff("MembershipEndDate", day).cast("string"),
                    F.lit(" day(s) on "), long_date("MembershipEndDate"),
                    F.lit(". Please renew to continue enjoying our services."))


def inactive_message() -> Column:
    """Of a member's row (Name, Days_Inactive); NULL without a workout."""
    return F.concat(F.lit("We miss you, "), F.col("Name"), F.lit("! It has been "),
                    F.col("Days_Inactive").cast("string"),
                    F.lit(" days since your last workout. "),
                    F.lit("Come back and continue your fitness journey!"))


def renewal_notices(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Active members whose JoinDate + Duration falls in [as_of, as_of+7] and
    who got no renewal notice since as_of-7 (midnight)."""
    mt = t.membership_type.select("Type_ID", F.col("Duration").alias("_months"))
    renew = F.add_months(F.col("JoinDate"), F.col("_months"))
    due = (t.member.filter(F.col("IsActive") == F.lit(True))
           .join(mt, F.col("MembershipType_ID") == F.col("Type_ID"))
           .withColumn("_renew", renew)
           .filter(F.col("_renew").between(lit_date(as_of), days_after(as_of, 7)))
           .join(_recent(t, "renewal", midnight(as_of - dt.timedelta(days=7))), "M_ID",
                 "left_anti"))
    return notice(due, renewal_message(lit_date(as_of)), "renewal", as_of)


def renewal_notices_stored_date(t: Tables, as_of: dt.date = DEFAULT_AS_OF,
                                now: dt.datetime | None = None) -> DataFrame:
    """The application's renewal job: uses the stored end date (NULL skipped)
    and de-duplicates against notices from the last 7 x 24 h before `now`."""
    now = now or dt.datetime.combine(as_of, dt.time(12, 0))
    mt = t.membership_type.select("Type_ID", F.col("Name").alias("_type"))
    since = F.lit(now - dt.timedelta(days=7)).cast("timestamp_ntz")
    due = (t.member.filter((F.col("IsActive") == F.lit(True))
                           & F.col("MembershipEndDate").isNotNull()
                           & F.col("MembershipEndDate").between(lit_date(as_of),
                                                                days_after(as_of, 7)))
           .join(mt, F.col("MembershipType_ID") == F.col("Type_ID"))
           .join(_recent(t, "renewal", since), "M_ID", "left_anti"))
    return notice(due, expiry_message(lit_date(as_of)), "renewal", as_of)


def _inactive(t: Tables, as_of: dt.date, days: int, ci: bool = False) -> DataFrame:
    last = t.workout_log.groupBy("M_ID").agg(F.max("Date").alias("_last"))
    m = (t.member.filter(F.col("IsActive") == F.lit(True)).select("M_ID", "Name", "Email")
         .join(last, "M_ID", "left")
         .withColumn("Days_Inactive", F.datediff(lit_date(as_of), F.col("_last")))
         .filter((F.col("Days_Inactive") >= days) | F.col("_last").isNull()))
    return m.join(_recent(t, "system", midnight(as_of - dt.timedelta(days=7)), "%We miss you%", ci),
                  "M_ID", "left_anti")


def inactive_member_report(t: Tables, as_of: dt.date = DEFAULT_AS_OF, days: int = 14,
                           ci: bool = False) -> DataFrame:
    """Report rows of the inactive-member job (never-active members included,
    with NULL days, [T5])."""
    return _inactive(t, as_of, days, ci).select(
        F.col("M_ID").alias("Member_ID"), F.col("Name").alias("Member_Name"), "Email",
        "Days_Inactive", F.lit("Notification Sent").alias("Action_Taken"))


def inactive_member_notices(t: Tables, as_of: dt.date = DEFAULT_AS_OF, days: int = 14,
                            ci: bool = False) -> DataFrame:
    """Notice rows; the message is NULL for never-active members ([T5])."""
    m = _inactive(t, as_of, days, ci)
    return notice(m, inactive_message(), "system", as_of)


def touched_by_metric_update(t: Tables, updates: DataFrame) -> DataFrame:
    """Members with at least one existing metric row hit by an update."""
    return (updates.select("M_ID", "Date").distinct()
            .join(t.health_metrics.select("M_ID", "Date").distinct(), ["M_ID", "Date"], "left_semi")
            .select("M_ID").distinct())


def low_engagement_notice(t: Tables, touched: DataFrame, as_of: dt.date = DEFAULT_AS_OF,
                          ci: bool = False) -> DataFrame:
    """For touched members whose last non-booking workout is >= 7 days old
    (members without one are skipped) and no 'missed you' notice in 7 days."""
    last = (t.workout_log.filter(not_booking()).groupBy("M_ID")
            .agg(F.max("Date").alias("_last")))
    m = (touched.select("M_ID").distinct().join(last, "M_ID")
         .filter(F.datediff(lit_date(as_of), F.col("_last")) >= 7)
         .join(_recent(t, "system", midnight(as_of - dt.timedelta(days=7)), "%missed you%", ci),
               "M_ID", "left_anti"))
    return notice(m, F.lit(LOW_ENGAGEMENT_MESSAGE), "system", as_of)


def _touched_members(t: Tables, touched: DataFrame | None) -> DataFrame:
    m = t.member
    if touched is not None:
        m = m.join(touched.select("M_ID").distinct(), "M_ID", "left_semi")
    mt = t.membership_type.select("Type_ID", F.col("Duration").alias("_months"))
    return (m.join(mt, F.col("MembershipType_ID") == F.col("Type_ID"), "left")
            .withColumn("_renew", F.add_months(F.col("JoinDate"), F.col("_months"))))


def renewal_notice_on_touch(t: Tables, touched: DataFrame | None = None,
                            as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Member-update rule: renewal within 7 days and no recent renewal
    notice -> notice (touched = updated members; None = every member)."""
    m = (_touched_members(t, touched)
         .filter(F.col("_renew").between(lit_date(as_of), days_after(as_of, 7)))
         .join(_recent(t, "renewal", midnight(as_of - dt.timedelta(days=7))), "M_ID", "left_anti"))
    msg = F.concat(F.lit("Your membership expires on "), F.date_format("_renew", "yyyy-MM-dd"),
                   F.lit(". Please renew to continue enjoying our services."))
    return notice(m, msg, "renewal", as_of)


def renewal_flag_on_touch(t: Tables, touched: DataFrame | None = None,
                          as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """The same rule's flag: touched members past their renewal date become
    inactive (this also overrides a re-activation, [T15])."""
    m = _touched_members(t, touched)
    flag = F.when(F.col("_renew") < lit_date(as_of), F.lit(False)).otherwise(F.col("IsActive"))
    return m.select(*[flag.alias(c) if c == "IsActive" else F.col(c) for c in t.member.columns])


def session_reminders(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Bookings of tomorrow's sessions, unless a reminder created today
    already mentions the session details (LIKE residual on the M_ID key; `%`
    and `_` in the details are wildcards, a backslash is itself)."""
    s = t.session.filter(F.col("SessionDate") == days_after(as_of, 1)) \
        .select("S_ID", "Details", "SessionTime")
    b = t.workout_log.filter(is_booking()).select("L_ID", "M_ID", "S_ID").join(s, "S_ID")
    today = t.notifications.filter(
        (F.col("Type") == "session_reminder")
        & (F.col("CreatedAt") >= midnight(as_of))
        & (F.col("CreatedAt") < midnight(as_of + dt.timedelta(days=1)))) \
        .select(F.col("M_ID").alias("_nm"), F.col("Message").alias("_msg"))
    fresh = b.join(today, (F.col("M_ID") == F.col("_nm"))
                   & F.like(F.col("_msg"), F.concat(
                       F.lit("%"), F.replace(F.col("Details"), F.lit("\\"), F.lit("\\\\")), F.lit("%"))),
                   "left_anti")
    msg = F.concat(F.lit('Reminder: You have a session "'), F.col("Details"),
                   F.lit('" scheduled for tomorrow at '), time_12h("SessionTime"))
    return notice(fresh, msg, "session_reminder", as_of, extra=["L_ID"])


def session_reminders_result(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    return session_reminders(t, as_of).agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("Created "), F.col("n").cast("string"), F.lit(" session reminders"))
        .alias("Result"))


def workout_milestones(t: Tables, as_of: dt.date = DEFAULT_AS_OF,
                       workouts_only: bool = False) -> DataFrame:
    """Progress notices when a member's non-booking count reaches 10/25/50/100.

    Faithful default ([T13]): any row inserted while the count sits on a
    milestone (a booking after the 10th workout, before the 11th) repeats the
    notice.  Only the first 101 counted rows per member are ranked (bounded
    top-k); other rows are matched to the [n-th, (n+1)-th) L_ID interval."""
    return milestones_after(None, t.workout_log, as_of, workouts_only)


def milestones_after(prior: DataFrame | None, log: DataFrame, as_of: dt.date = DEFAULT_AS_OF,
                     workouts_only: bool = False) -> DataFrame:
    """`workout_milestones` of the rows `log`, inserted in the order of L_ID
    after others of which `prior` (M_ID, c) says how many counted."""
    counted = log.filter(not_booking()).select("M_ID", "L_ID")
    top = max(MILESTONES) + 1
    ranked = top_k(counted, ["M_ID"], [F.col("L_ID")], top, rank_col="n")
    if prior is not None:
        ranked = (ranked.join(prior, "M_ID", "left").filter(F.col("n") + F.coalesce("c", F.lit(0)) <= top)
                  .select("M_ID", "L_ID", (F.col("n") + F.coalesce("c", F.lit(0))).cast("int").alias("n")))
    hits = ranked.filter(F.col("n").isin(*MILESTONES))
    parts = hits
    if not workouts_only:
        nxt = ranked.select("M_ID", (F.col("n") - 1).alias("n"), F.col("L_ID").alias("_hi"))
        reached = hits.select("M_ID", "n", F.col("L_ID").alias("_lo"))
        if prior is not None:  # the count may have sat on a milestone before the first row
            reached = reached.unionByName(prior.filter(F.col("c").isin(*MILESTONES)).select(
                "M_ID", F.col("c").cast("int").alias("n"), F.lit(-(2 ** 63)).cast("long").alias("_lo")))
        bounds = reached.join(nxt, ["M_ID", "n"], "left")
        others = log.filter(~F.coalesce(not_booking(), F.lit(False))).select("M_ID", "L_ID")
        inside = others.join(bounds, "M_ID").filter(
            (F.col("L_ID") > F.col("_lo")) & (F.col("_hi").isNull() | (F.col("L_ID") < F.col("_hi"))))
        parts = hits.unionByName(inside.select("M_ID", "L_ID", "n"))
    msg = None
    for k, text in MILESTONES.items():
        msg = F.when(F.col("n") == k, F.lit(text)) if msg is None \
            else msg.when(F.col("n") == k, F.lit(text))
    return notice(parts, msg, "progress", as_of, extra=["L_ID"])


def first_workout_welcome(t: Tables, as_of: dt.date = DEFAULT_AS_OF,
                          message: str = WELCOME_MESSAGE) -> DataFrame:
    """System notice for each member's first log row of any kind (min L_ID:
    an aggregate, not a window)."""
    first = t.workout_log.groupBy("M_ID").agg(F.min("L_ID").alias("L_ID"))
    return notice(first, F.lit(message), "system", as_of, extra=["L_ID"])


def session_reminder_rows(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """The application's reminder helper applied to every upcoming booking:
    "Reminder: You have a session '<details>' scheduled for <YYYY-MM-DD> at
    <H:MM:SS>." (the time is printed like a Python timedelta: no leading
    zero on the hour)."""
    s = t.session.filter(F.col("SessionDate") >= lit_date(as_of)) \
        .select("S_ID", "Details", "SessionDate", "SessionTime")
    b = t.workout_log.filter(is_booking()).select("L_ID", "M_ID", "S_ID").join(s, "S_ID")
    hms = F.regexp_replace(F.col("SessionTime"), r"^0(\d:)", "$1")
    msg = F.concat(F.lit("Reminder: You have a session '"), F.col("Details"),
                   F.lit("' scheduled for "), F.date_format("SessionDate", "yyyy-MM-dd"),
                   F.lit(" at "), hms, F.lit("."))
    return notice(b, msg, "session_reminder", as_of, extra=["L_ID"])


def progress_notice_rows(events: DataFrame, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """The application's progress helper: (M_ID, Message) events -> rows."""
    return notice(events, F.col("Message"), "progress", as_of)


def append_session_reminders(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """INSERT ... SELECT of the reminder job into Notifications: the new
    table version with generated Notif_IDs (in booking order)."""
    return append_rows(t.notifications, session_reminders(t, as_of), "Notif_ID", "L_ID")
