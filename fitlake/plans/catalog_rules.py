"""Registered rules, constraint audits and notification jobs (§2.6, §2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitlake.operators import notices as N
from fitlake.operators import rules as R
from fitlake.plans.oracle import q
from fitlake.plans.registry import register, tables
from fitlake.sources import schema as SC
from fitlake.sources.tables import metric_updates

_NOTICE_COLS = "FALSE AS IsRead, TIMESTAMP '2024-01-30 00:00:00' AS CreatedAt"


# ---- fixed values that must equal the reference's: ranges and messages -------

_METRIC_CASE = """
  WHEN Weight IS NOT NULL AND (Weight < 20 OR Weight > 300) THEN 'Weight must be between 20 and 300 kg'
  WHEN Height IS NOT NULL AND (Height < 100 OR Height > 250) THEN 'Height must be between 100 and 250 cm'
  WHEN SleepHours IS NOT NULL AND (SleepHours < 0 OR SleepHours > 24) THEN 'Sleep hours must be between 0 and 24'
  WHEN WaterLiters IS NOT NULL AND (WaterLiters < 0 OR WaterLiters > 10) THEN 'Water intake must be between 0 and 10 liters'
  WHEN Steps IS NOT NULL AND (Steps < 0 OR Steps > 100000) THEN 'Steps must be between 0 and 100,000'"""


def _workout_case(t: str = "") -> str:
    """WHEN branches of the workout insert rules; `t` qualifies the columns."""
    p = f"{t}." if t else ""
    return f"""
  WHEN {p}Duration IS NOT NULL AND ({p}Duration < 5 OR {p}Duration > 300) THEN 'Workout duration must be between 5 and 300 minutes'
  WHEN {p}CaloriesBurnt IS NOT NULL AND ({p}CaloriesBurnt < 0 OR {p}CaloriesBurnt > 2000) THEN 'Calories burnt must be between 0 and 2000'
  WHEN {p}Distance IS NOT NULL AND ({p}Distance < 0 OR {p}Distance > 50) THEN 'Distance must be between 0 and 50 km'
  WHEN {p}Date > DATE '2024-01-30' THEN 'Workout date cannot be in the future'"""


_WORKOUT_CASE = _workout_case()

_MISSED_YOU = ("We have missed you! It has been a week since your last workout. "
               "Come back and continue your fitness journey!")

# ---- end of the fixed values ---------------------------------------------------


@register("validate_health_metrics", q(f"""
SELECT *, CASE {_METRIC_CASE} END AS violation FROM health_metrics"""))
def _validate_health_metrics(spark, d):
    return R.validate_health_metrics(tables(spark, d).health_metrics)


@register("validate_workouts", q(f"""
SELECT *, CASE {_WORKOUT_CASE} END AS violation FROM workout_log"""))
def _validate_workouts(spark, d):
    return R.validate_workouts(tables(spark, d).workout_log)


@register("validate_booking_date", q("""
SELECT wl.*, CASE WHEN wl.S_ID IS NOT NULL AND wl.Exercise = 'Session Booking'
                       AND s.SessionDate < DATE '2024-01-30'
                  THEN 'Cannot book sessions that have already passed' END AS violation
FROM workout_log wl LEFT JOIN session s ON wl.S_ID = s.S_ID"""))
def _validate_booking_date(spark, d):
    return R.validate_booking_date(tables(spark, d))


@register("validate_member_age", q("""
SELECT *, CASE WHEN Age < 10 OR Age > 100 THEN 'Member age must be between 10 and 100 years' END AS violation
FROM member"""))
def _validate_member_age(spark, d):
    return R.validate_member_age(tables(spark, d).member)


@register("validate_log_rows", q(f"""
, j0 AS (
  SELECT wl.*, s.SessionDate AS sdate, s.MaxParticipants AS mx
  FROM workout_log wl LEFT JOIN session s ON wl.S_ID = s.S_ID),
  j AS (
  SELECT *, (S_ID IS NOT NULL AND COALESCE(Exercise = 'Session Booking', FALSE)) AS bk,
         (CASE {_WORKOUT_CASE} END) IS NOT NULL AS bad_range
  FROM j0),
  ok_bk AS (
  SELECT S_ID, L_ID, mx, row_number() OVER (PARTITION BY S_ID ORDER BY L_ID) AS rn
  FROM j WHERE bk AND NOT bad_range AND NOT COALESCE(sdate < DATE '2024-01-30', FALSE)),
  cut AS (SELECT S_ID, CAST(L_ID AS BIGINT) AS cut FROM ok_bk WHERE rn = mx
          UNION ALL SELECT S_ID, CAST(-9223372036854775808 AS BIGINT) FROM session WHERE MaxParticipants <= 0)
SELECT j.L_ID, j.M_ID, j.S_ID, j.Exercise, j.Date, j.Duration, j.CaloriesBurnt, j.Distance, j.Progress,
       CASE WHEN j.bk AND cut.cut IS NOT NULL AND j.L_ID > cut.cut
              THEN 'Session is already full. Cannot book this session.'
            {_workout_case("j")}
            WHEN j.bk AND j.sdate < DATE '2024-01-30' THEN 'Cannot book sessions that have already passed'
       END AS violation
FROM j LEFT JOIN cut ON j.S_ID = cut.S_ID"""))
def _validate_log_rows(spark, d):
    return R.validate_log_rows(tables(spark, d))


@register("overbooked_sessions", q("""
SELECT s.S_ID, s.Details, s.MaxParticipants, COUNT(*) AS Bookings
FROM session s JOIN workout_log wl ON s.S_ID = wl.S_ID AND wl.Exercise = 'Session Booking'
GROUP BY s.S_ID, s.Details, s.MaxParticipants
HAVING COUNT(*) > s.MaxParticipants"""))
def _overbooked_sessions(spark, d):
    return R.overbooked_sessions(tables(spark, d))


def _dup_sql(table, col):
    value = f"lower({col})" if col == "Email" else col
    return (f"SELECT '{table}' AS table_name, '{col}' AS column_name, CAST({value} AS VARCHAR) AS value, "
            f"COUNT(*) AS n FROM {table} WHERE {col} IS NOT NULL GROUP BY {value} HAVING COUNT(*) > 1")


@register("check_unique", q("\n UNION ALL ".join(
    [_dup_sql(t, c) for t, c in [("gym", "Gym_ID"), ("membership_type", "Type_ID"),
                                 ("member", "M_ID"), ("member", "Email"), ("trainer", "T_ID"),
                                 ("trainer", "Email"), ("admin", "A_ID"), ("admin", "Email"),
                                 ("session", "S_ID"),
                                 ("workout_log", "L_ID"), ("health_metrics", "Metric_ID"),
                                 ("notifications", "Notif_ID")]])))
def _check_unique(spark, d):
    return R.check_unique(tables(spark, d))


def _fk_sql(child, ccol, parent, pcol):
    return (f"SELECT '{child}' AS child_table, '{ccol}' AS child_column, '{parent}' AS parent_table, "
            f"COUNT(*) AS orphans FROM {child} c WHERE c.{ccol} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {parent} p WHERE p.{pcol} = c.{ccol})")


@register("check_foreign_keys", q("\n UNION ALL ".join(
    [_fk_sql(*e[:4]) for e in __import__("fitlake.sources.schema", fromlist=["FK_GRAPH"]).FK_GRAPH])))
def _check_foreign_keys(spark, d):
    return R.check_foreign_keys(tables(spark, d))


@register("check_domains", q("""
SELECT 'gym' AS table_name, 'capacity_positive' AS rule, COUNT(CASE WHEN NOT (Capacity > 0) THEN 1 END) AS violations FROM gym
UNION ALL SELECT 'membership_type', 'price_non_negative', COUNT(CASE WHEN NOT (Price >= 0) THEN 1 END) FROM membership_type
UNION ALL SELECT 'member', 'age_10_100', COUNT(CASE WHEN NOT (Age BETWEEN 10 AND 100) THEN 1 END) FROM member
UNION ALL SELECT 'member', 'not_null', COUNT(CASE WHEN Name IS NULL OR Email IS NULL OR JoinDate IS NULL
                                              OR MembershipType_ID IS NULL OR Gym_ID IS NULL THEN 1 END) FROM member
UNION ALL SELECT 'trainer', 'not_null', COUNT(CASE WHEN Name IS NULL OR Email IS NULL THEN 1 END) FROM trainer
UNION ALL SELECT 'session', 'status_enum', COUNT(CASE WHEN Status NOT IN ('scheduled', 'completed', 'cancelled') THEN 1 END) FROM session
UNION ALL SELECT 'workout_log', 'not_null', COUNT(CASE WHEN M_ID IS NULL THEN 1 END) FROM workout_log
UNION ALL SELECT 'health_metrics', 'not_null', COUNT(CASE WHEN M_ID IS NULL OR Date IS NULL THEN 1 END) FROM health_metrics
UNION ALL SELECT 'notifications', 'type_enum', COUNT(CASE WHEN Type NOT IN ('renewal', 'session_reminder', 'progress', 'system') THEN 1 END) FROM notifications"""))
def _check_domains(spark, d):
    return R.check_domains(tables(spark, d))


# What the jobs of 30 January see of the last seven days, and each member's
# end by plan: shared by the notice queries.
_QUIET = """
, quiet AS (SELECT M_ID, Type, Message, CreatedAt FROM notifications WHERE CreatedAt >= TIMESTAMP '2024-01-23 00:00:00'),
plan_end AS (
  SELECT M_ID, CAST(JoinDate + to_months(Duration) AS DATE) AS ends
  FROM membership_type JOIN member ON MembershipType_ID = Type_ID)"""


@register("renewal_notices", q(_QUIET + f"""
, due AS (
  SELECT M_ID, Name, ends, ends - DATE '2024-01-30' AS left_days FROM plan_end JOIN member USING (M_ID)
  WHERE IsActive AND ends >= DATE '2024-01-30' AND ends < DATE '2024-02-07')
SELECT M_ID, concat('Hello ', Name, '! Your membership renews in ', left_days, ' day', if(left_days > 1, 's', ''), ' on ',
                    strftime(ends, '%B %d, %Y'), '. Please contact us to renew your membership.') AS Message,
       'renewal' AS Type, {_NOTICE_COLS}
FROM due ANTI JOIN (SELECT M_ID FROM quiet WHERE Type = 'renewal') AS told USING (M_ID)"""))
def _renewal_notices(spark, d):
    return N.renewal_notices(tables(spark, d))


@register("renewal_notices_stored_date", q(_QUIET + f"""
, told AS (SELECT M_ID FROM quiet WHERE Type = 'renewal' AND CreatedAt >= TIMESTAMP '2024-01-23 12:00:00'),
plans AS (SELECT Type_ID AS MembershipType_ID, coalesce(Name, 'None') AS plan FROM membership_type),
due AS (SELECT M_ID, plan, MembershipEndDate AS ends FROM plans JOIN member USING (MembershipType_ID)
        WHERE IsActive AND MembershipEndDate - DATE '2024-01-30' BETWEEN 0 AND 7)
SELECT M_ID, concat('Your ', plan, ' membership expires in ', ends - DATE '2024-01-30', ' day(s) on ',
                    strftime(ends, '%B %d, %Y'), '. Please renew to continue enjoying our services.') AS Message,
       'renewal' AS Type, {_NOTICE_COLS}
FROM due ANTI JOIN told USING (M_ID)"""))
def _renewal_notices_stored_date(spark, d):
    return N.renewal_notices_stored_date(tables(spark, d))


_INACTIVE = _QUIET + """
, newest AS (SELECT M_ID, max(Date) AS day FROM workout_log GROUP BY M_ID),
todo AS (
  SELECT M_ID, Name, Email, DATE '2024-01-30' - day AS Days_Inactive
  FROM (SELECT * FROM member WHERE IsActive) LEFT JOIN newest USING (M_ID)
  ANTI JOIN (SELECT M_ID FROM quiet WHERE Type = 'system' AND contains(Message, 'We miss you')) AS told USING (M_ID)
  WHERE coalesce(DATE '2024-01-30' - day, 14) > 13)"""


@register("inactive_member_notices", q(_INACTIVE + """
SELECT M_ID AS Member_ID, Name AS Member_Name, Email, Days_Inactive, 'Notification Sent' AS Action_Taken
FROM todo"""))
def _inactive_member_notices(spark, d):
    return N.inactive_member_report(tables(spark, d))


@register("inactive_member_notice_rows", q(_INACTIVE + f"""
SELECT M_ID, 'We miss you, ' || Name || '! It has been ' || CAST(Days_Inactive AS VARCHAR)
       || ' days since your last workout. ' || 'Come back and continue your fitness journey!' AS Message,
       'system' AS Type, {_NOTICE_COLS}
FROM todo"""))
def _inactive_member_notice_rows(spark, d):
    return N.inactive_member_notices(tables(spark, d))


@register("low_engagement_notice", q(_QUIET + f"""
, hit AS (SELECT M_ID FROM metric_updates SEMI JOIN health_metrics USING (M_ID, Date) GROUP BY M_ID),
idle AS (SELECT M_ID FROM workout_log WHERE Exercise <> 'Session Booking' GROUP BY M_ID HAVING max(Date) <= DATE '2024-01-23')
SELECT M_ID, '{_MISSED_YOU}' AS Message, 'system' AS Type, {_NOTICE_COLS}
FROM hit SEMI JOIN idle USING (M_ID)
ANTI JOIN (SELECT M_ID FROM quiet WHERE Type = 'system' AND contains(Message, 'missed you')) AS told USING (M_ID)"""))
def _low_engagement_notice(spark, d):
    t = tables(spark, d)
    return N.low_engagement_notice(t, N.touched_by_metric_update(t, metric_updates(spark, d)))


@register("renewal_notice_on_touch", q(_QUIET + f"""
SELECT M_ID, concat('Your membership expires on ', strftime(ends, '%Y-%m-%d'),
                    '. Please renew to continue enjoying our services.') AS Message,
       'renewal' AS Type, {_NOTICE_COLS}
FROM (SELECT * FROM plan_end WHERE ends - DATE '2024-01-30' BETWEEN 0 AND 7) AS due
ANTI JOIN (SELECT M_ID FROM quiet WHERE Type = 'renewal') AS told USING (M_ID)"""))
def _renewal_notice_on_touch(spark, d):
    return N.renewal_notice_on_touch(tables(spark, d))


@register("renewal_flag_on_touch", q("""
SELECT m.M_ID, m.Name, m.Email, m.Age, m.JoinDate, m.Phone, m.MembershipEndDate,
       CASE WHEN CAST(m.JoinDate + to_months(mt.Duration) AS DATE) < DATE '2024-01-30' THEN FALSE
            ELSE m.IsActive END AS IsActive,
       m.MembershipType_ID, m.Gym_ID
FROM member m LEFT JOIN membership_type mt ON m.MembershipType_ID = mt.Type_ID"""))
def _renewal_flag_on_touch(spark, d):
    return N.renewal_flag_on_touch(tables(spark, d))


_REMIND = """
, tomorrow AS (SELECT S_ID, Details, SessionTime FROM session WHERE SessionDate - DATE '2024-01-30' = 1),
reminded AS (
  SELECT M_ID, Message FROM notifications
  WHERE Type = 'session_reminder' AND date_trunc('day', CreatedAt) = TIMESTAMP '2024-01-30 00:00:00'),
booked AS (
  SELECT L_ID, M_ID, Details, SessionTime FROM tomorrow JOIN workout_log USING (S_ID) WHERE Exercise = 'Session Booking'),
rem AS (SELECT * FROM booked WHERE L_ID NOT IN (
  SELECT L_ID FROM booked JOIN reminded USING (M_ID) WHERE Message LIKE concat('%', Details, '%')))"""


@register("session_reminders", q(_REMIND + f"""
SELECT L_ID, M_ID,
       'Reminder: You have a session "' || Details || '" scheduled for tomorrow at '
       || strftime(CAST('2000-01-01 ' || SessionTime AS TIMESTAMP), '%I:%M %p') AS Message,
       'session_reminder' AS Type, {_NOTICE_COLS}
FROM rem"""))
def _session_reminders(spark, d):
    return N.session_reminders(tables(spark, d))


@register("session_reminders_result", q(_REMIND + """
SELECT 'Created ' || CAST(COUNT(*) AS VARCHAR) || ' session reminders' AS Result FROM rem"""))
def _session_reminders_result(spark, d):
    return N.session_reminders_result(tables(spark, d))


@register("workout_milestones", q(f"""
, run AS (
  SELECT M_ID, L_ID,
         SUM(CASE WHEN Exercise != 'Session Booking' THEN 1 ELSE 0 END)
           OVER (PARTITION BY M_ID ORDER BY L_ID ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n
  FROM workout_log)
SELECT L_ID, M_ID,
       CASE n WHEN 10 THEN 'Congratulations! You have completed 10 workouts. Keep up the great work!'
              WHEN 25 THEN 'Amazing! 25 workouts completed. You are making excellent progress!'
              WHEN 50 THEN 'Incredible milestone! 50 workouts completed. You are a fitness champion!'
              WHEN 100 THEN 'Legendary achievement! 100 workouts completed. Outstanding dedication!' END AS Message,
       'progress' AS Type, {_NOTICE_COLS}
FROM run WHERE n IN (10, 25, 50, 100)"""))
def _workout_milestones(spark, d):
    return N.workout_milestones(tables(spark, d))


@register("first_workout_welcome", q(f"""
SELECT MIN(L_ID) AS L_ID, M_ID, 'Welcome! You have logged your first workout. Great start!' AS Message,
       'system' AS Type, {_NOTICE_COLS}
FROM workout_log GROUP BY M_ID"""))
def _first_workout_welcome(spark, d):
    return N.first_workout_welcome(tables(spark, d))


@register("session_reminder_rows", q(f"""
SELECT wl.L_ID, wl.M_ID,
       'Reminder: You have a session ''' || s.Details || ''' scheduled for '
       || strftime(s.SessionDate, '%Y-%m-%d') || ' at '
       || regexp_replace(s.SessionTime, '^0([0-9]:)', '\\1') || '.' AS Message,
       'session_reminder' AS Type, {_NOTICE_COLS}
FROM workout_log wl JOIN session s ON wl.S_ID = s.S_ID
WHERE wl.Exercise = 'Session Booking' AND s.SessionDate >= DATE '2024-01-30'"""))
def _session_reminder_rows(spark, d):
    return N.session_reminder_rows(tables(spark, d))


@register("append_session_reminders", q(_REMIND + """
SELECT Notif_ID, M_ID, Message, Type, IsRead, CreatedAt FROM notifications
UNION ALL
SELECT CAST((SELECT MAX(Notif_ID) FROM notifications) + row_number() OVER (ORDER BY L_ID) AS INT),
       M_ID,
       'Reminder: You have a session "' || Details || '" scheduled for tomorrow at '
       || strftime(CAST('2000-01-01 ' || SessionTime AS TIMESTAMP), '%I:%M %p'),
       'session_reminder', FALSE, TIMESTAMP '2024-01-30 00:00:00'
FROM rem"""))
def _append_session_reminders(spark, d):
    return N.append_session_reminders(tables(spark, d))


@register("progress_notice_rows", q(f"""
, per AS (SELECT M_ID, COUNT(*) AS n FROM workout_log WHERE Exercise <> 'Session Booking' GROUP BY M_ID)
SELECT M_ID, 'You have logged ' || CAST(n AS VARCHAR) || ' workouts' AS Message, 'progress' AS Type, {_NOTICE_COLS}
FROM per"""))
def _progress_notice_rows(spark, d):
    """The application's helper, fed with one event a member."""
    events = (tables(spark, d).workout_log.filter(F.col("Exercise") != SC.BOOKING).groupBy("M_ID")
              .agg(F.count(F.lit(1)).alias("n"))
              .select("M_ID", F.concat(F.lit("You have logged "), F.col("n").cast("string"), F.lit(" workouts"))
                      .alias("Message")))
    return N.progress_notice_rows(events)
