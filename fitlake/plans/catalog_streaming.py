"""Registered streaming twins: each replays a derived table through a file
stream and returns the streaming result as a batch frame."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitlake.plans.catalog_rules import _WORKOUT_CASE
from fitlake.plans.oracle import q
from fitlake.plans.registry import register, tables
from fitlake.sources import schema as SC
from fitlake.streaming import ledgers as LG
from fitlake.streaming import twins as ST

_NOTICE_COLS = "FALSE AS IsRead, TIMESTAMP '2024-01-30 00:00:00' AS CreatedAt"


@register("stream_validate", q(f"""
SELECT *, CASE {_WORKOUT_CASE} END AS violation FROM workout_log"""))
def _stream_validate(spark, d):
    valid, quarantine = ST.scratch(spark, "valid"), ST.scratch(spark, "quarantine")
    ST.replay(spark, [tables(spark, d).workout_log],
              lambda stream, ck: ST.stream_validate(stream, valid, quarantine, ck), SC.WORKOUT_LOG)
    good = spark.read.schema(SC.WORKOUT_LOG).parquet(f"{valid}/*").withColumn(
        "violation", F.lit(None).cast("string"))
    flagged = T.StructType([*SC.WORKOUT_LOG.fields, T.StructField("violation", T.StringType())])
    bad = spark.read.schema(flagged).parquet(f"{quarantine}/*")
    return good.unionByName(bad)


@register("stream_milestones", q(f"""
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
def _stream_milestones(spark, d):
    folder = ST.scratch(spark, "milestones")
    sink = LG.milestone_sink(LG.workouts_ledger(spark, f"{folder}/counts"), f"{folder}/notices")
    # rows come in L_ID order
    ST.replay(spark, ST.slices(tables(spark, d).workout_log, "L_ID", 4),
              lambda stream, ck: LG.start(stream, sink, ck), SC.WORKOUT_LOG)
    notices = T.StructType([T.StructField("L_ID", T.LongType()), *[f for f in SC.NOTIFICATIONS if f.name != "Notif_ID"]])
    return LG.results(spark, f"{folder}/notices", notices)


@register("stream_capacity", q(f"""
, lined AS (
  SELECT w.*, s.SessionDate AS day, s.MaxParticipants AS seats,
         coalesce(w.Exercise = 'Session Booking', FALSE) AND w.S_ID IS NOT NULL AS books, CASE {_WORKOUT_CASE} END AS wrong
  FROM workout_log w LEFT JOIN (SELECT S_ID, SessionDate, MaxParticipants FROM session) s USING (S_ID)),
judged AS (
  SELECT *, count(*) FILTER (WHERE books AND wrong IS NULL AND NOT coalesce(day < DATE '2024-01-30', FALSE))
              OVER (PARTITION BY S_ID ORDER BY L_ID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead
  FROM lined)
SELECT * EXCLUDE (day, seats, books, wrong, ahead),
       CASE WHEN books AND ahead >= seats THEN 'Session is already full. Cannot book this session.'
            WHEN wrong IS NOT NULL THEN wrong
            WHEN books AND day < DATE '2024-01-30' THEN 'Cannot book sessions that have already passed' END AS violation
FROM judged"""))
def _stream_capacity(spark, d):
    """The log as a stream in L_ID order, every micro-batch handled twice."""
    t = tables(spark, d)
    return LG.capacity_replay(t, ST.slices(t.workout_log, "L_ID", 4), ST.scratch(spark, "capacity"), ST.replay, repeat=True)


# Day by day: a notice passes when its member has none of its type from seven
# days before on, stored (before 10 January) or passed.
_NOTICE_WINDOW = """
, coming AS (
  SELECT *, CAST(CreatedAt AS DATE) AS day FROM notifications WHERE CreatedAt >= TIMESTAMP '2024-01-10 00:00:00'),
daily AS (
  SELECT * FROM coming QUALIFY row_number() OVER (PARTITION BY M_ID, Type, day ORDER BY CreatedAt, Notif_ID) = 1),
span AS (SELECT min(day) AS lo, max(day) AS hi FROM daily),
pass AS (
  SELECT k.M_ID, k.Type, s.newest, (SELECT lo - 1 FROM span) AS day, CAST(NULL AS BIGINT) AS Notif_ID
  FROM (SELECT DISTINCT M_ID, Type FROM daily) k
  LEFT JOIN (SELECT M_ID, Type, CAST(max(CreatedAt) AS DATE) AS newest FROM notifications
             WHERE CreatedAt < TIMESTAMP '2024-01-10 00:00:00' GROUP BY M_ID, Type) s ON s.M_ID = k.M_ID AND s.Type = k.Type
  UNION ALL
  SELECT p.M_ID, p.Type, CASE WHEN d.Notif_ID IS NOT NULL AND coalesce(p.newest < d.day - 7, TRUE) THEN d.day ELSE p.newest END,
         p.day + 1, CASE WHEN coalesce(p.newest < d.day - 7, TRUE) THEN d.Notif_ID END
  FROM pass p LEFT JOIN daily d ON d.M_ID = p.M_ID AND d.Type = p.Type AND d.day = p.day + 1
  WHERE p.day < (SELECT hi FROM span))
SELECT n.* FROM notifications n JOIN pass USING (Notif_ID)"""


@register("stream_notice_window", q(_NOTICE_WINDOW).replace("WITH ", "WITH RECURSIVE ", 1))
def _stream_notice_window(spark, d):
    """Notices from 10 January on as a stream in four frames by date, against
    the ones stored before, with the rule's own seven days."""
    n = tables(spark, d).notifications
    cut = dt.datetime(2024, 1, 10)
    stored, coming = n.filter(F.col("CreatedAt") < F.lit(cut)), n.filter(F.col("CreatedAt") >= F.lit(cut))
    folder = ST.scratch(spark, "notices")
    sink = LG.notice_sink(LG.notice_ledger(spark, f"{folder}/newest", stored), f"{folder}/kept")
    parts = [p.drop("_day") for p in ST.slices(coming.withColumn("_day", F.unix_date(F.to_date("CreatedAt"))), "_day", 4)]
    ST.replay(spark, parts, lambda stream, ck: LG.start(stream, sink, ck), SC.NOTIFICATIONS)
    return LG.results(spark, f"{folder}/kept", SC.NOTIFICATIONS)


@register("stream_daily_calories", q("""
SELECT M_ID, Date, SUM(CaloriesBurnt) AS daily_calories FROM workout_log
WHERE CaloriesBurnt IS NOT NULL GROUP BY M_ID, Date"""))
def _stream_daily_calories(spark, d):
    # Append mode.  First the log, then one row of a far day, whose watermark
    # closes every window of the log and lets its state go; then the log once
    # more, each row now later than the watermark, so none may count again.
    log = tables(spark, d).workout_log
    far = spark.createDataFrame([(0, 0, None, None, dt.date(2200, 1, 1), None, Decimal("1.00"), None, None)],
                                SC.WORKOUT_LOG)
    return ST.replay_to_table(spark, [log, far, log], SC.WORKOUT_LOG, ST.stream_daily_calories)


@register("stream_notice_dedupe", q("""
SELECT DISTINCT M_ID, Type FROM notifications"""))
def _stream_notice_dedupe(spark, d):
    # The delay is longer than the data, so each (member, type) passes once
    # whatever the watermark does; which of its notices is not defined.
    n = tables(spark, d).notifications
    return ST.replay_to_table(spark, [n, n], SC.NOTIFICATIONS,
                              lambda s: ST.stream_notice_dedupe(s, "4000 days").select("M_ID", "Type"))
