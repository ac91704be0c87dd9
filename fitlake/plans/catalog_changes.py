"""Registered operators over sequences and versions: interleaved requests,
notice jobs over run dates, as-of lookups, rules fired by changed rows."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlake.operators import asof as A
from fitlake.operators import changes as CH
from fitlake.operators import maintenance as MT
from fitlake.operators import notice_runs as NR
from fitlake.operators import requests as RQ
from fitlake.plans.catalog_rules import _workout_case
from fitlake.plans.oracle import q
from fitlake.plans.registry import register, tables
from fitlake.session import checkpoint_dir
from fitlake.sources import partitioned as PT
from fitlake.sources import schema as SC
from fitlake.sources import tables as S

# One session's requests one after another: `live` holds the bookings that
# stand, as member|L<stored row> or member|R<request>.
_REQUESTS = """
, named AS (
  SELECT r.request_id, r.kind, r.M_ID, r.S_ID AS asked,
         CASE WHEN r.kind = 'book' THEN r.S_ID WHEN r.L_ID IS NOT NULL THEN l.S_ID ELSE b.S_ID END AS place,
         CASE WHEN r.kind = 'book' THEN 'R' || r.request_id WHEN r.L_ID IS NOT NULL THEN 'L' || r.L_ID
              ELSE 'R' || r.booking END AS ref
  FROM seat_requests r
  LEFT JOIN workout_log l ON r.kind = 'cancel' AND l.L_ID = r.L_ID AND l.Exercise = 'Session Booking'
  LEFT JOIN seat_requests b ON r.kind = 'cancel' AND r.L_ID IS NULL AND b.request_id = r.booking AND b.kind = 'book'),
queue AS (
  SELECT n.*, s.MaxParticipants AS seats, row_number() OVER (PARTITION BY place ORDER BY request_id) AS turn
  FROM named n JOIN session s ON s.S_ID = n.place),
start AS (
  SELECT s.S_ID, list(l.M_ID || '|L' || l.L_ID) FILTER (WHERE l.L_ID IS NOT NULL) AS live
  FROM session s LEFT JOIN workout_log l ON l.S_ID = s.S_ID AND l.Exercise = 'Session Booking' GROUP BY s.S_ID),
play AS (
  SELECT S_ID AS place, CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS request_id,
         CAST(NULL AS VARCHAR) AS outcome, coalesce(live, CAST([] AS VARCHAR[])) AS live
  FROM start
  UNION ALL
  SELECT place, turn, request_id, outcome,
         CASE outcome WHEN 'in' THEN list_append(live, mine) WHEN 'off' THEN list_filter(live, lambda x: x <> mine) ELSE live END
  FROM (
    SELECT p.place, u.turn, u.request_id, p.live, u.M_ID || '|' || u.ref AS mine,
           CASE WHEN u.kind = 'cancel' THEN CASE WHEN list_contains(p.live, u.M_ID || '|' || u.ref) THEN 'off' ELSE 'none' END
                WHEN len(list_filter(p.live, lambda x: starts_with(x, u.M_ID || '|'))) > 0 THEN 'again'
                WHEN len(p.live) >= u.seats THEN 'full' ELSE 'in' END AS outcome
    FROM play p JOIN queue u ON u.place = p.place AND u.turn = p.turn + 1)),
outcomes AS (
  SELECT n.request_id, n.kind, n.M_ID, n.asked AS S_ID,
         coalesce(p.outcome, CASE WHEN n.kind = 'book' THEN 'unknown' ELSE 'none' END) AS outcome
  FROM named n LEFT JOIN play p ON p.request_id = n.request_id),
ids AS (
  SELECT request_id, (SELECT max(L_ID) FROM workout_log) + row_number() OVER (ORDER BY request_id) AS L_ID
  FROM outcomes WHERE outcome = 'in')"""


def _recursive(sql: str) -> str:
    return q(sql).replace("WITH ", "WITH RECURSIVE ", 1)


@register("interleaved_requests", _recursive(_REQUESTS + """
SELECT o.request_id, kind, M_ID, S_ID,
       CASE outcome WHEN 'in' THEN 'SUCCESS: Session booked successfully'
                    WHEN 'again' THEN 'ERROR: You have already booked this session'
                    WHEN 'full' THEN 'ERROR: Session is full' WHEN 'unknown' THEN 'ERROR: Session not found'
                    WHEN 'off' THEN 'Session booking canceled.'
                    ELSE 'Booking not found or you do not have permission to cancel it' END AS status,
       CAST(ids.L_ID AS BIGINT) AS L_ID
FROM outcomes o LEFT JOIN ids ON ids.request_id = o.request_id"""))
def _interleaved_requests(spark, d):
    return RQ.apply_requests(tables(spark, d), S.seat_requests(spark, d)).drop("gone_at")


@register("interleaved_requests_log", _recursive(_REQUESTS + """
, off AS (SELECT n.M_ID, n.ref FROM named n JOIN outcomes o ON o.request_id = n.request_id WHERE outcome = 'off')
SELECT * FROM workout_log
WHERE NOT (coalesce(Exercise = 'Session Booking', FALSE)
           AND coalesce((M_ID, 'L' || L_ID) IN (SELECT (M_ID, ref) FROM off), FALSE))
UNION ALL
SELECT CAST(ids.L_ID AS BIGINT), o.M_ID, o.S_ID, 'Session Booking', s.SessionDate, s.Duration, NULL, NULL, 'Booked'
FROM outcomes o JOIN ids ON ids.request_id = o.request_id JOIN session s ON s.S_ID = o.S_ID
WHERE (o.M_ID, 'R' || o.request_id) NOT IN (SELECT (M_ID, ref) FROM off)"""))
def _interleaved_requests_log(spark, d):
    t, r = tables(spark, d), S.seat_requests(spark, d)
    return RQ.log_after_requests(t, r, RQ.apply_requests(t, r))


# ---- notice jobs over run dates ---------------------------------------------

_FIRST, _LAST = dt.date(2024, 1, 1), dt.date(2024, 2, 15)

# Day by day: what the job of a day writes silences the next ones.
_RENEWAL_RUN = """
, grid AS (
  SELECT M_ID, Name, plan, ends, newest FROM (
    SELECT m.M_ID, m.Name, p.Name AS plan, {ends} AS ends
    FROM member m JOIN membership_type p ON p.Type_ID = m.MembershipType_ID WHERE m.IsActive) AS due
  LEFT JOIN (SELECT M_ID, max(CreatedAt) AS newest FROM notifications WHERE Type = 'renewal' GROUP BY M_ID) AS got
  USING (M_ID)
  WHERE ends IS NOT NULL),
run AS (
  SELECT *, DATE '2023-12-31' AS d, FALSE AS sent FROM grid
  UNION ALL
  SELECT M_ID, Name, plan, ends, CASE WHEN due THEN moment ELSE newest END, d + 1, due FROM (
    SELECT *, CAST(d + 1 AS TIMESTAMP) + {hours} AS moment,
           ends BETWEEN d + 1 AND d + 8
             AND coalesce(newest < CAST(d + 1 AS TIMESTAMP) + {hours} - INTERVAL 7 DAYS, TRUE) AS due
    FROM run WHERE d < DATE '2024-02-15') AS day)
SELECT M_ID, {message} AS Message, 'renewal' AS Type, FALSE AS IsRead, newest AS CreatedAt
FROM run WHERE sent"""


@register("renewal_notice_run", _recursive(_RENEWAL_RUN.format(
    ends="CAST(m.JoinDate + to_months(p.Duration) AS DATE)", hours="INTERVAL 0 HOURS",
    message="'Hello ' || Name || '! Your membership renews in ' || (ends - d) || CASE WHEN ends - d > 1 THEN ' days' "
            "ELSE ' day' END || ' on ' || strftime(ends, '%B %d, %Y') || '. Please contact us to renew your membership.'")))
def _renewal_notice_run(spark, d):
    return NR.renewal_notice_run(tables(spark, d), _FIRST, _LAST)


@register("expiry_notice_run", _recursive(_RENEWAL_RUN.format(
    ends="m.MembershipEndDate", hours="INTERVAL 12 HOURS",
    message="'Your ' || coalesce(plan, 'None') || ' membership expires in ' || (ends - d) || ' day(s) on ' "
            "|| strftime(ends, '%B %d, %Y') || '. Please renew to continue enjoying our services.'")))
def _expiry_notice_run(spark, d):
    return NR.expiry_notice_run(tables(spark, d), _FIRST, _LAST)


_INACTIVE_RUN = """
, days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-15', INTERVAL 1 DAY)) AS DATE) AS d),
grid AS (SELECT M_ID, Name, d FROM member, days WHERE IsActive),
told AS (
  SELECT g.M_ID, g.Name, g.d, {last} AS last FROM grid g {seen}),
silent AS (
  SELECT M_ID, max(CreatedAt) AS newest FROM notifications
  WHERE Type = 'system' AND contains(Message, 'We miss you') {stored} GROUP BY M_ID),
run AS (
  SELECT m.M_ID, DATE '2023-12-31' AS d, s.newest, FALSE AS sent, CAST(NULL AS BIGINT) AS idle
  FROM member m LEFT JOIN silent s USING (M_ID) WHERE IsActive
  UNION ALL
  SELECT r.M_ID, t.d,
         CASE WHEN coalesce(r.newest < t.d - 7, TRUE) AND t.d - t.last >= 14 THEN CAST(t.d AS TIMESTAMP) ELSE r.newest END,
         coalesce(r.newest < t.d - 7, TRUE) AND (t.last IS NULL OR t.d - t.last >= 14), t.d - t.last
  FROM run r JOIN told t ON t.M_ID = r.M_ID AND t.d = r.d + 1)
SELECT M_ID, 'We miss you, ' || Name || '! It has been ' || idle || ' days since your last workout. '
             || 'Come back and continue your fitness journey!' AS Message,
       'system' AS Type, FALSE AS IsRead, CAST(run.d AS TIMESTAMP) AS CreatedAt
FROM run JOIN member USING (M_ID) WHERE sent"""


@register("inactive_notice_run", _recursive(_INACTIVE_RUN.format(
    last="w.last", seen="LEFT JOIN (SELECT M_ID, max(Date) AS last FROM workout_log GROUP BY M_ID) w ON w.M_ID = g.M_ID",
    stored="")))
def _inactive_notice_run(spark, d):
    return NR.inactive_notice_run(tables(spark, d), _FIRST, _LAST)


@register("inactive_notice_replay", _recursive(_INACTIVE_RUN.format(
    last="w.Date", seen="LEFT JOIN (SELECT M_ID, Date, lead(Date) OVER (PARTITION BY M_ID ORDER BY Date) AS later "
                        "FROM (SELECT DISTINCT M_ID, Date FROM workout_log WHERE Date IS NOT NULL)) w "
                        "ON w.M_ID = g.M_ID AND g.d >= w.Date AND (later IS NULL OR g.d < later)",
    stored="AND CreatedAt < TIMESTAMP '2024-01-01 00:00:00'")))
def _inactive_notice_replay(spark, d):
    return NR.inactive_notice_run(tables(spark, d), _FIRST, _LAST, replay=True)


# ---- as-of lookups ------------------------------------------------------------

@register("weight_changes", q("""
, newest AS (
  SELECT M_ID, Date, Weight FROM health_metrics
  QUALIFY row_number() OVER (PARTITION BY M_ID, Date ORDER BY Metric_ID DESC) = 1),
asked AS (SELECT L_ID, M_ID, Date, CAST(Date - 30 AS DATE) AS before FROM workout_log),
one AS (SELECT a.L_ID, n.Weight FROM asked a ASOF LEFT JOIN newest n ON a.M_ID = n.M_ID AND a.Date >= n.Date),
two AS (SELECT a.L_ID, n.Weight FROM asked a ASOF LEFT JOIN newest n ON a.M_ID = n.M_ID AND a.before >= n.Date)
SELECT a.L_ID, a.M_ID, a.Date, one.Weight AS Weight, two.Weight AS WeightBefore,
       CAST(coalesce(one.Weight - two.Weight, 0) AS DECIMAL(6,2)) AS WeightChange
FROM asked a JOIN one USING (L_ID) JOIN two USING (L_ID)"""))
def _weight_changes(spark, d):
    return A.weight_changes(tables(spark, d))


# ---- changed rows and the rules they fire --------------------------------------

# The second version, by the formulas of `sources.tables.next_version`.
_NEXT = """
, member2 AS (
  SELECT * REPLACE (CASE WHEN M_ID % 7 = 0 THEN coalesce(Phone, '') || '0' ELSE Phone END AS Phone,
                    CASE WHEN M_ID % 11 = 0 THEN NOT IsActive ELSE IsActive END AS IsActive)
  FROM member WHERE M_ID % 50 <> 49
  UNION ALL SELECT * REPLACE (M_ID + 1000000000 AS M_ID) FROM member WHERE M_ID % 40 = 1),
metrics2 AS (
  SELECT * REPLACE (CASE WHEN Metric_ID % 5 = 0 THEN CAST(Weight + 1 AS DECIMAL(5,2)) ELSE Weight END AS Weight,
                    CASE WHEN Metric_ID % 13 = 0 THEN NULL ELSE Steps END AS Steps)
  FROM health_metrics
  UNION ALL SELECT * REPLACE (Metric_ID + 1000000000 AS Metric_ID) FROM health_metrics WHERE Metric_ID % 29 = 3),
session2 AS (
  SELECT * REPLACE (CASE WHEN S_ID % 3 = 0 THEN Details || ' (moved)' ELSE Details END AS Details,
                    CASE WHEN S_ID % 6 = 0 THEN CAST(SessionDate + 1 AS DATE) ELSE SessionDate END AS SessionDate)
  FROM session),
log2 AS (
  SELECT * FROM workout_log WHERE L_ID % 100 <> 5
  UNION ALL SELECT * REPLACE (L_ID + 1000000000 AS L_ID) FROM workout_log WHERE L_ID % 10 = 0)"""


def _changes_sql(old: str, new: str, key: str, columns: list[str]) -> str:
    names = ", ".join(f"CASE WHEN o.{c} IS DISTINCT FROM n.{c} THEN '{c}' END" for c in columns)
    return _NEXT + f"""
SELECT {key}, 'insert' AS change, '' AS columns FROM {new} WHERE {key} NOT IN (SELECT {key} FROM {old})
UNION ALL SELECT {key}, 'delete', '' FROM {old} WHERE {key} NOT IN (SELECT {key} FROM {new})
UNION ALL
SELECT {key}, 'update', columns FROM (SELECT o.{key}, concat_ws(',', {names}) AS columns FROM {old} o JOIN {new} n USING ({key}))
WHERE columns <> ''"""


def _changes_of(table: str):
    def build(spark, d):
        t = tables(spark, d)
        diff = CH.table_changes(t, S.next_version(t), table)
        return diff.select(diff.columns[0], "change", F.concat_ws(",", "columns").alias("columns"))
    return build


for _name, _old, _new in (("member", "member", "member2"), ("health_metrics", "health_metrics", "metrics2"),
                          ("session", "session", "session2"), ("workout_log", "workout_log", "log2")):
    _key = SC.PRIMARY_KEYS[_name]
    register(f"changes_{_name}", q(_changes_sql(_old, _new, _key, [c for c in SC.SCHEMAS[_name].names if c != _key])))(
        _changes_of(_name))


@register("fired_notices", q(_NEXT + """
, quiet AS (
  SELECT DISTINCT M_ID, Type, CASE WHEN contains(Message, 'missed you') THEN 'missed' END AS kind
  FROM notifications WHERE CreatedAt >= TIMESTAMP '2024-01-23 00:00:00'),
touched AS (
  SELECT DISTINCT b.M_ID FROM health_metrics a JOIN metrics2 b USING (Metric_ID)
  WHERE a.Weight IS DISTINCT FROM b.Weight OR a.Steps IS DISTINCT FROM b.Steps),
idle AS (
  SELECT M_ID FROM log2 WHERE Exercise <> 'Session Booking' GROUP BY M_ID HAVING max(Date) <= DATE '2024-01-23'),
renewed AS (
  SELECT b.M_ID, CAST(b.JoinDate + to_months(p.Duration) AS DATE) AS ends
  FROM member a JOIN member2 b USING (M_ID) JOIN membership_type p ON p.Type_ID = b.MembershipType_ID
  WHERE a.Phone IS DISTINCT FROM b.Phone OR a.IsActive IS DISTINCT FROM b.IsActive),
counted AS (
  SELECT L_ID, M_ID, count(*) FILTER (WHERE Exercise <> 'Session Booking') OVER so_far AS n, count(*) OVER so_far AS rows
  FROM log2 WINDOW so_far AS (PARTITION BY M_ID ORDER BY L_ID ROWS UNBOUNDED PRECEDING)),
fresh AS (SELECT c.* FROM counted c ANTI JOIN workout_log w USING (L_ID)),
written AS (
  SELECT 'member_update' AS rule, CAST(NULL AS BIGINT) AS row_id, M_ID,
         'Your membership expires on ' || strftime(ends, '%Y-%m-%d') || '. Please renew to continue enjoying our services.' AS Message,
         'renewal' AS Type
  FROM renewed WHERE ends BETWEEN DATE '2024-01-30' AND DATE '2024-02-06'
    AND M_ID NOT IN (SELECT M_ID FROM quiet WHERE Type = 'renewal')
  UNION ALL
  SELECT 'metric_update', NULL, M_ID,
         'We have missed you! It has been a week since your last workout. Come back and continue your fitness journey!', 'system'
  FROM touched SEMI JOIN idle USING (M_ID)
  WHERE M_ID NOT IN (SELECT M_ID FROM quiet WHERE Type = 'system' AND kind = 'missed')
  UNION ALL
  SELECT 'milestone', L_ID, M_ID,
         CASE n WHEN 10 THEN 'Congratulations! You have completed 10 workouts. Keep up the great work!'
                WHEN 25 THEN 'Amazing! 25 workouts completed. You are making excellent progress!'
                WHEN 50 THEN 'Incredible milestone! 50 workouts completed. You are a fitness champion!'
                ELSE 'Legendary achievement! 100 workouts completed. Outstanding dedication!' END, 'progress'
  FROM fresh WHERE n IN (10, 25, 50, 100)
  UNION ALL
  SELECT 'welcome', L_ID, M_ID, 'Welcome! You have logged your first workout. Great start!', 'system'
  FROM fresh WHERE rows = 1)
SELECT *, FALSE AS IsRead, TIMESTAMP '2024-01-30 00:00:00' AS CreatedAt FROM written"""))
def _fired_notices(spark, d):
    t = tables(spark, d)
    return CH.fired_notices(t, S.next_version(t))


@register("fired_violations", q(_NEXT + """
, moved AS (
  SELECT b.* FROM metrics2 b LEFT JOIN health_metrics a USING (Metric_ID)
  WHERE a.Metric_ID IS NULL OR a.Weight IS DISTINCT FROM b.Weight OR a.Steps IS DISTINCT FROM b.Steps),
people AS (
  SELECT b.* FROM member2 b LEFT JOIN member a USING (M_ID)
  WHERE a.M_ID IS NULL OR a.Phone IS DISTINCT FROM b.Phone OR a.IsActive IS DISTINCT FROM b.IsActive),
fresh AS (
  SELECT f.*, s.SessionDate AS day, s.MaxParticipants AS seats, f.Exercise = 'Session Booking' AND f.S_ID IS NOT NULL AS books,
         CASE {case} END AS wrong
  FROM log2 f ANTI JOIN workout_log w USING (L_ID) LEFT JOIN session2 s ON s.S_ID = f.S_ID),
used AS (SELECT S_ID, count(*) AS n FROM workout_log WHERE Exercise = 'Session Booking' GROUP BY S_ID),
lined AS (
  SELECT fresh.*, coalesce(n, 0) + coalesce(count(*) FILTER (WHERE books AND wrong IS NULL AND day >= DATE '2024-01-30')
           OVER (PARTITION BY fresh.S_ID ORDER BY L_ID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM fresh LEFT JOIN used ON used.S_ID = fresh.S_ID)
SELECT 'health_metrics' AS table_name, Metric_ID AS row_id,
       CASE WHEN Weight NOT BETWEEN 20 AND 300 THEN 'Weight must be between 20 and 300 kg'
            WHEN Height NOT BETWEEN 100 AND 250 THEN 'Height must be between 100 and 250 cm'
            WHEN SleepHours NOT BETWEEN 0 AND 24 THEN 'Sleep hours must be between 0 and 24'
            WHEN WaterLiters NOT BETWEEN 0 AND 10 THEN 'Water intake must be between 0 and 10 liters'
            WHEN Steps NOT BETWEEN 0 AND 100000 THEN 'Steps must be between 0 and 100,000' END AS violation
FROM moved WHERE violation IS NOT NULL
UNION ALL
SELECT 'member', M_ID, 'Member age must be between 10 and 100 years' FROM people WHERE Age NOT BETWEEN 10 AND 100
UNION ALL
SELECT 'workout_log', L_ID,
       CASE WHEN books AND ahead >= seats THEN 'Session is already full. Cannot book this session.'
            WHEN wrong IS NOT NULL THEN wrong
            WHEN books AND day < DATE '2024-01-30' THEN 'Cannot book sessions that have already passed' END AS v
FROM lined WHERE v IS NOT NULL""".format(case=_workout_case("f"))))
def _fired_violations(spark, d):
    t = tables(spark, d)
    return CH.fired_violations(t, S.next_version(t))


@register("members_after_rules", q(_NEXT + """
, ends AS (SELECT M_ID, CAST(JoinDate + to_months(Duration) AS DATE) AS ends
           FROM member2 JOIN membership_type ON Type_ID = MembershipType_ID),
touched AS (SELECT b.M_ID FROM member a JOIN member2 b USING (M_ID)
            WHERE a.Phone IS DISTINCT FROM b.Phone OR a.IsActive IS DISTINCT FROM b.IsActive)
SELECT b.* REPLACE (b.IsActive AND NOT (b.M_ID IN (SELECT M_ID FROM touched)
                    AND coalesce(e.ends < DATE '2024-01-30', FALSE)) AS IsActive)
FROM member2 b LEFT JOIN ends e USING (M_ID)"""))
def _members_after_rules(spark, d):
    t = tables(spark, d)
    return CH.after_rules(t, S.next_version(t))[0]


@register("sessions_after_rules", q(_NEXT + """
SELECT b.* REPLACE (CASE WHEN b.S_ID % 3 = 0 AND b.SessionDate < DATE '2024-01-30' AND b.Status = 'scheduled'
                         THEN 'completed' ELSE b.Status END AS Status)
FROM session2 b"""))
def _sessions_after_rules(spark, d):
    t = tables(spark, d)
    return CH.after_rules(t, S.next_version(t))[1]


# ---- stored versions -------------------------------------------------------------

def _written(spark, d, table: str, new):
    """`new` written over the stored table, partition by partition, and read again."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/fitlake-versions/{uuid.uuid4().hex}"
    PT.save_partitioned(getattr(tables(spark, d), table), table, folder)
    PT.write_version(spark, new, table, folder)
    return PT.load_partitioned(spark, table, folder).drop(PT.MONTH)


@register("stored_purge", q("""
SELECT * FROM notifications WHERE NOT coalesce(IsRead AND CreatedAt < TIMESTAMP '2023-11-01 00:00:00', FALSE)"""))
def _stored_purge(spark, d):
    return _written(spark, d, "notifications", MT.purge_read_notifications(tables(spark, d))[0])


@register("stored_next_log", q(_NEXT + """
SELECT * FROM log2"""))
def _stored_next_log(spark, d):
    return _written(spark, d, "workout_log", S.next_version(tables(spark, d)).workout_log)


@register("stored_tables", q("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_values, "
    f"count(DISTINCT {c}) AS n_distinct FROM {t}" for t in SC.TABLE_NAMES for c in SC.SCHEMAS[t].names)))
def _stored_tables(spark, d):
    """All nine tables written, read back with their declared schemas, and
    counted.  Each column is counted by itself: a task holds the distinct values
    of one column, not those of all columns in rows as wide as the table."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/fitlake-versions/{uuid.uuid4().hex}"
    S.save_tables(tables(spark, d), folder)
    parts = []
    for name, df in S.load_tables(spark, folder).as_dict().items():
        for c in df.columns:
            values = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
            parts.append(values.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"),
                F.count(c).alias("n_distinct"),
            ).select(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), "n_rows", "n_values", "n_distinct"))
    return reduce(DataFrame.unionByName, parts)
