"""Registered metric frames (§2.4) with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitlake.operators import metrics as M
from fitlake.operators.metrics import _zero2
from fitlake.plans.oracle import avg_exact as A
from fitlake.plans.oracle import q, ratio_half_up, round_half_up
from fitlake.plans.registry import register, tables

# SQL building blocks (one statement of each metric, reused by the panels).
_EXPIRY = """
, expiry AS (
  SELECT m.M_ID, CAST(m.JoinDate + to_months(mt.Duration) AS DATE) AS ExpiryDate,
         date_diff('day', DATE '2024-01-30', CAST(m.JoinDate + to_months(mt.Duration) AS DATE)) AS DaysUntilExpiry
  FROM member m LEFT JOIN membership_type mt ON m.MembershipType_ID = mt.Type_ID)"""

_BMI = f"""
, latest_hm AS (
  SELECT M_ID, Weight, Height,
         row_number() OVER (PARTITION BY M_ID ORDER BY Date DESC, Metric_ID DESC) AS rn
  FROM health_metrics),
  bmi AS (
  SELECT M_ID,
         CASE WHEN Weight IS NOT NULL AND Height IS NOT NULL AND Height > 0
              THEN TRY_CAST((CASE WHEN Weight < 0 THEN -1 ELSE 1 END) *
                   {ratio_half_up('abs(CAST(Weight * 100 AS BIGINT)) * 1000000', 'CAST(Height * 100 AS BIGINT) * CAST(Height * 100 AS BIGINT)', 2)} AS DECIMAL(18,2))
              ELSE CAST(0 AS DECIMAL(18,2)) END AS BMI
  FROM latest_hm WHERE rn = 1)"""

_LOGM = f"""
, logm AS (
  SELECT M_ID,
         COALESCE(SUM(CASE WHEN Date >= DATE '2024-01-30' - 30 AND CaloriesBurnt IS NOT NULL
                           THEN CaloriesBurnt END), 0) AS CaloriesLast30Days,
         {ratio_half_up("COUNT(DISTINCT CASE WHEN Date >= DATE '2024-01-30' - 30 THEN Date END) * 100", "30", 2)} AS ConsistencyPercent,
         COALESCE({round_half_up(A('Duration', 0, "Date >= DATE '2024-01-30' - 30 AND Duration IS NOT NULL AND Exercise != 'Session Booking'"), 4, 2)}, 0) AS AvgWorkoutDuration
  FROM workout_log GROUP BY M_ID)"""

_HEALTHM = f"""
, cur_w AS (
  SELECT M_ID, Weight FROM (
    SELECT M_ID, Weight, row_number() OVER (PARTITION BY M_ID ORDER BY Date DESC, Metric_ID DESC) rn
    FROM health_metrics) WHERE rn = 1),
  past_w AS (
  SELECT M_ID, Weight FROM (
    SELECT M_ID, Weight, row_number() OVER (PARTITION BY M_ID ORDER BY Date DESC, Metric_ID DESC) rn
    FROM health_metrics WHERE Date <= DATE '2024-01-30' - 30) WHERE rn = 1),
  steps AS (
  SELECT M_ID, {A('Steps', 0, "Date >= DATE '2024-01-30' - 7 AND Steps IS NOT NULL")} AS a
  FROM health_metrics GROUP BY M_ID),
  healthm AS (
  SELECT m.M_ID,
         CAST(CASE WHEN c.Weight IS NOT NULL AND p.Weight IS NOT NULL THEN c.Weight - p.Weight ELSE 0 END
              AS DECIMAL(6,2)) AS WeightChange30Days,
         CAST(COALESCE({round_half_up('st.a', 4, 0)}, 0) AS INT) AS AvgStepsLastWeek
  FROM member m LEFT JOIN cur_w c ON m.M_ID = c.M_ID LEFT JOIN past_w p ON m.M_ID = p.M_ID
  LEFT JOIN steps st ON m.M_ID = st.M_ID)"""

_AGE = """CASE WHEN Age < 18 THEN 'Teen' WHEN Age BETWEEN 18 AND 25 THEN 'Young Adult'
     WHEN Age BETWEEN 26 AND 40 THEN 'Adult' WHEN Age BETWEEN 41 AND 60 THEN 'Middle Age'
     ELSE 'Senior' END"""

_SESS_AVAIL = """
, bk AS (SELECT S_ID, COUNT(*) AS n FROM workout_log WHERE Exercise = 'Session Booking' GROUP BY S_ID),
  savail AS (
  SELECT s.S_ID, s.Details, s.SessionDate,
         COALESCE(COALESCE(bk.n, 0) < s.MaxParticipants, FALSE) AS IsAvailable, s.MaxParticipants
  FROM session s LEFT JOIN bk ON s.S_ID = bk.S_ID)"""

_TRAINER_ACT = """
, tact AS (
  SELECT t.T_ID, t.Name, t.Specialization,
         CAST((SELECT COUNT(*) FROM session s WHERE s.T_ID = t.T_ID AND s.SessionDate >= DATE '2024-01-30'
                AND s.Status = 'scheduled') AS INT) AS ActiveSessions
  FROM trainer t)"""

_GYM_REV = """
, grev AS (
  SELECT g.Gym_ID, g.Location,
         CAST(COALESCE((SELECT SUM(mt.Price) FROM member m JOIN membership_type mt
                         ON m.MembershipType_ID = mt.Type_ID
                        WHERE m.Gym_ID = g.Gym_ID AND m.IsActive = TRUE), 0) AS DECIMAL(38,2))
           AS EstimatedRevenue
  FROM gym g)"""


@register("membership_expiry", q(_EXPIRY + """
SELECT m.M_ID, m.Name, e.DaysUntilExpiry FROM member m LEFT JOIN expiry e ON m.M_ID = e.M_ID"""))
def _membership_expiry(spark, d):
    return M.membership_expiry(tables(spark, d))


@register("member_bmi", q(_BMI + """
SELECT m.M_ID, m.Name, COALESCE(b.BMI, CAST(0 AS DECIMAL(18,2))) AS BMI
FROM member m LEFT JOIN bmi b ON m.M_ID = b.M_ID"""))
def _member_bmi(spark, d):
    return M.member_bmi(tables(spark, d))


@register("calories_burned", q(_LOGM + """
SELECT m.M_ID, m.Name, CAST(COALESCE(l.CaloriesLast30Days, 0) AS DECIMAL(38,2)) AS CaloriesLast30Days
FROM member m LEFT JOIN logm l ON m.M_ID = l.M_ID"""))
def _calories_burned(spark, d):
    return M.calories_burned(tables(spark, d))


@register("workout_consistency", q(_LOGM + """
SELECT m.M_ID, m.Name, COALESCE(l.ConsistencyPercent, 0) AS ConsistencyPercent
FROM member m LEFT JOIN logm l ON m.M_ID = l.M_ID"""))
def _workout_consistency(spark, d):
    return M.workout_consistency(tables(spark, d))


@register("avg_workout_duration", q(_LOGM + """
SELECT m.M_ID, m.Name, CAST(COALESCE(l.AvgWorkoutDuration, 0) AS DECIMAL(18,2)) AS AvgWorkoutDuration
FROM member m LEFT JOIN logm l ON m.M_ID = l.M_ID"""))
def _avg_workout_duration(spark, d):
    return M.avg_workout_duration(tables(spark, d))


@register("session_available", q(_SESS_AVAIL + """
SELECT * FROM savail"""))
def _session_available(spark, d):
    return M.session_available(tables(spark, d))


@register("trainer_active_sessions", q(_TRAINER_ACT + """
SELECT * FROM tact"""))
def _trainer_active_sessions(spark, d):
    return M.trainer_active_sessions(tables(spark, d))


@register("weight_change", q(_HEALTHM + """
SELECT m.M_ID, m.Name, h.WeightChange30Days FROM member m JOIN healthm h ON m.M_ID = h.M_ID"""))
def _weight_change(spark, d):
    return M.weight_change(tables(spark, d))


@register("avg_daily_steps", q(_HEALTHM + """
SELECT m.M_ID, m.Name, h.AvgStepsLastWeek FROM member m JOIN healthm h ON m.M_ID = h.M_ID"""))
def _avg_daily_steps(spark, d):
    return M.avg_daily_steps(tables(spark, d))


@register("gym_revenue", q(_GYM_REV + """
SELECT * FROM grev"""))
def _gym_revenue(spark, d):
    return M.gym_revenue(tables(spark, d))


@register("age_group", q(f"""
SELECT M_ID, Name, Age, {_AGE} AS AgeGroup FROM member"""))
def _age_group(spark, d):
    return M.member_age_groups(tables(spark, d))


@register("duration_hhmm", q("""
SELECT L_ID, Duration,
       lpad(CAST(CAST(floor(Duration / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' ||
       lpad(CAST(Duration % 60 AS VARCHAR), 2, '0') AS FormattedTime
FROM workout_log"""))
def _duration_hhmm(spark, d):
    return M.workout_durations_hhmm(tables(spark, d))


@register("member_metrics_panel", q(_EXPIRY + _BMI + _LOGM + """
SELECT m.M_ID, m.Name, e.DaysUntilExpiry, COALESCE(b.BMI, CAST(0 AS DECIMAL(18,2))) AS BMI,
       CAST(COALESCE(l.CaloriesLast30Days, 0) AS DECIMAL(38,2)) AS CaloriesLast30Days,
       COALESCE(l.ConsistencyPercent, 0) AS ConsistencyPercent,
       CAST(COALESCE(l.AvgWorkoutDuration, 0) AS DECIMAL(18,2)) AS AvgWorkoutDuration
FROM member m LEFT JOIN expiry e ON m.M_ID = e.M_ID LEFT JOIN bmi b ON m.M_ID = b.M_ID
LEFT JOIN logm l ON m.M_ID = l.M_ID"""))
def _member_metrics_panel(spark, d):
    return M.member_metrics_panel(tables(spark, d))


@register("member_health_panel", q(_HEALTHM + f"""
SELECT m.M_ID, m.Name, h.WeightChange30Days, h.AvgStepsLastWeek, {_AGE} AS AgeGroup
FROM member m JOIN healthm h ON m.M_ID = h.M_ID"""))
def _member_health_panel(spark, d):
    return M.member_health_panel(tables(spark, d))


@register("session_availability_panel", q(_SESS_AVAIL + """
SELECT * FROM savail WHERE SessionDate >= DATE '2024-01-30'"""))
def _session_availability_panel(spark, d):
    return M.session_availability_panel(tables(spark, d))


@register("trainer_activity_panel", q(_TRAINER_ACT + """
SELECT * FROM tact"""))
def _trainer_activity_panel(spark, d):
    return M.trainer_activity_panel(tables(spark, d))


@register("gym_revenue_panel", q(_GYM_REV + """
SELECT * FROM grev"""))
def _gym_revenue_panel(spark, d):
    return M.gym_revenue_panel(tables(spark, d))


# ---- bench-size log (lineitem x orders), as_of 2001-08-01 -------------------
_BAS = "DATE '2001-08-01'"


@register("bench_log_metrics", q(f"""
, agg AS (
  SELECT M_ID,
         SUM(CASE WHEN Date >= {_BAS} - 30 AND CaloriesBurnt IS NOT NULL THEN CaloriesBurnt END) AS cal,
         {ratio_half_up(f"COUNT(DISTINCT CASE WHEN Date >= {_BAS} - 30 THEN Date END) * 100", "30", 2)} AS pct,
         {round_half_up(A('Duration', 0, f"Date >= {_BAS} - 30 AND Duration IS NOT NULL AND Exercise != 'Session Booking'"), 4, 2)} AS dur
  FROM bench_log GROUP BY M_ID)
SELECT m.M_ID, CAST(COALESCE(a.cal, 0) AS DECIMAL(38,2)) AS CaloriesLast30Days,
       COALESCE(a.pct, 0) AS ConsistencyPercent,
       CAST(COALESCE(a.dur, 0) AS DECIMAL(18,2)) AS AvgWorkoutDuration
FROM member m LEFT JOIN agg a ON m.M_ID = a.M_ID"""))
def _bench_log_metrics(spark, d):
    from fitlake.plans.registry import bench_tables_cached
    from fitlake.sources.tables import BENCH_AS_OF
    t = bench_tables_cached(spark, d)
    f = M.log_metrics_frame(t, BENCH_AS_OF)
    return (t.member.select("M_ID").join(f, "M_ID", "left")
            .select("M_ID",
                    F.coalesce("CaloriesLast30Days", _zero2()).alias("CaloriesLast30Days"),
                    F.coalesce("ConsistencyPercent", F.lit(0).cast("decimal(18,2)"))
                    .alias("ConsistencyPercent"),
                    F.coalesce("AvgWorkoutDuration", F.lit(0).cast("decimal(6,2)"))
                    .alias("AvgWorkoutDuration")))


@register("bench_exercise_patterns", q(f"""
SELECT M_ID, Exercise, {A('CaloriesBurnt', 2)} AS avg_calories, {A('Duration')} AS avg_duration,
       COUNT(*) AS frequency
FROM bench_log WHERE Date >= {_BAS} - 30 GROUP BY M_ID, Exercise"""))
def _bench_exercise_patterns(spark, d):
    from fitlake.operators.app import exercise_patterns
    from fitlake.plans.registry import bench_tables_cached
    from fitlake.sources.tables import BENCH_AS_OF
    return exercise_patterns(bench_tables_cached(spark, d), BENCH_AS_OF)


@register("bench_calorie_trend", q("""
SELECT M_ID, Date, SUM(CaloriesBurnt) AS daily_calories FROM bench_log
WHERE CaloriesBurnt IS NOT NULL GROUP BY M_ID, Date"""))
def _bench_calorie_trend(spark, d):
    from fitlake.operators.app import calorie_trend
    from fitlake.plans.registry import bench_tables_cached
    return calorie_trend(bench_tables_cached(spark, d))


@register("sql_functions", q("""
SELECT m.M_ID, m.Age,
       CASE WHEN Age < 18 THEN 'Teen' WHEN Age BETWEEN 18 AND 25 THEN 'Young Adult'
            WHEN Age BETWEEN 26 AND 40 THEN 'Adult' WHEN Age BETWEEN 41 AND 60 THEN 'Middle Age'
            ELSE 'Senior' END AS AgeGroup,
       date_diff('day', DATE '2024-01-30', CAST(m.JoinDate + to_months(mt.Duration) AS DATE)) AS DaysUntilExpiry
FROM member m LEFT JOIN membership_type mt ON m.MembershipType_ID = mt.Type_ID"""))
def _sql_functions(spark, d):
    """The same metrics through the SQL API and the SQL-bodied functions."""
    from fitlake.functions.sql_functions import register_sql_functions
    register_sql_functions(spark, prefix="fitlake_")
    t = tables(spark, d)
    t.member.createOrReplaceTempView("fitlake_member")
    t.membership_type.createOrReplaceTempView("fitlake_membership_type")
    return spark.sql("""
        SELECT m.M_ID, m.Age, fitlake_age_group(m.Age) AS AgeGroup,
               fitlake_expiry_days(m.JoinDate, mt.Duration, DATE '2024-01-30') AS DaysUntilExpiry
        FROM fitlake_member m
        LEFT JOIN fitlake_membership_type mt ON m.MembershipType_ID = mt.Type_ID""")
