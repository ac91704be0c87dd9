"""Registered base queries (§2.1–2.2) with their SQL oracles."""

from __future__ import annotations

from fitlake.operators import base_queries as B
from fitlake.plans.oracle import avg_exact as A
from fitlake.plans.oracle import q
from fitlake.plans.registry import register, tables


@register("member_directory", q("""
, plan AS (SELECT Type_ID AS MembershipType_ID, Name AS MembershipType, Price FROM membership_type),
  place AS (SELECT Gym_ID, Location AS GymLocation FROM gym)
SELECT M_ID, Name, Email, Age, JoinDate, MembershipType, Price, GymLocation
FROM (member LEFT JOIN plan USING (MembershipType_ID)) LEFT JOIN place USING (Gym_ID)"""))
def _member_directory(spark, d):
    return B.member_directory(tables(spark, d))


@register("member_by_email", q("""
SELECT * FROM member WHERE lower(Email) = 'm7@example.org'"""))
def _member_by_email(spark, d):
    return B.member_by_email(tables(spark, d), "m7@EXAMPLE.org")


@register("recent_workouts", q("""
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY M_ID ORDER BY Date DESC NULLS LAST,
                                                        L_ID DESC NULLS LAST) AS rn
  FROM workout_log)
SELECT r.M_ID, r.L_ID, r.Exercise, r.Date, r.Duration, r.CaloriesBurnt, r.Distance, r.Progress,
       s.Details AS SessionDetails, s.SessionDate
FROM ranked r LEFT JOIN session s ON r.S_ID = s.S_ID
WHERE r.rn <= 10"""))
def _recent_workouts(spark, d):
    return B.recent_workouts(tables(spark, d), 10)


@register("trainer_rollup", q(f"""
, seats AS (  -- rows that a session has in a join with the log: one at least
  SELECT s.T_ID, s.S_ID, s.Duration, greatest(COUNT(wl.L_ID), 1) AS weight
  FROM session s LEFT JOIN workout_log wl USING (S_ID) GROUP BY ALL),
  rows_ AS (SELECT T_ID, Duration FROM seats, range(CAST(weight AS BIGINT)) r),
  per AS (SELECT T_ID, {A('Duration')} AS AvgSessionDuration FROM rows_ GROUP BY T_ID),
  many AS (SELECT T_ID, COUNT(*) AS n FROM session GROUP BY T_ID),
  who AS (SELECT T_ID, COUNT(*) AS n FROM (
    SELECT DISTINCT s.T_ID, wl.M_ID FROM workout_log wl JOIN session s USING (S_ID)) GROUP BY T_ID)
SELECT T_ID, Name, Specialization, COALESCE(many.n, 0) AS TotalSessions, AvgSessionDuration,
       COALESCE(who.n, 0) AS UniqueClients
FROM ((trainer LEFT JOIN per USING (T_ID)) LEFT JOIN many USING (T_ID)) LEFT JOIN who USING (T_ID)"""))
def _trainer_rollup(spark, d):
    return B.trainer_rollup(tables(spark, d))


@register("trainer_rollup_exact", q(f"""
, ps AS (SELECT T_ID, COUNT(*) AS TotalSessions, {A('Duration')} AS AvgSessionDuration
         FROM session GROUP BY T_ID),
  pc AS (SELECT s.T_ID, COUNT(DISTINCT wl.M_ID) AS UniqueClients
         FROM session s JOIN workout_log wl ON s.S_ID = wl.S_ID GROUP BY s.T_ID)
SELECT t.T_ID, t.Name, t.Specialization, COALESCE(ps.TotalSessions, 0) AS TotalSessions,
       ps.AvgSessionDuration, COALESCE(pc.UniqueClients, 0) AS UniqueClients
FROM trainer t LEFT JOIN ps ON t.T_ID = ps.T_ID LEFT JOIN pc ON t.T_ID = pc.T_ID"""))
def _trainer_rollup_exact(spark, d):
    return B.trainer_rollup_exact(tables(spark, d))


@register("member_progress_rollup", q(f"""
, logs AS (SELECT M_ID, COUNT(*) AS k, COUNT(Duration) AS kd, SUM(Duration) AS sd, SUM(CaloriesBurnt) AS sc
           FROM workout_log GROUP BY M_ID),
  meas AS (SELECT M_ID, COUNT(*) AS k, MAX(Weight) AS hi, MIN(Weight) AS lo, {A('SleepHours')} AS sleep
           FROM health_metrics GROUP BY M_ID),
  avgs AS (SELECT M_ID, {A('Duration')} AS ad FROM workout_log GROUP BY M_ID)
SELECT m.M_ID, m.Name,  -- a join of both sides repeats each side as often as the other has rows
       COALESCE(logs.k, 0) * greatest(COALESCE(meas.k, 1), 1) AS TotalWorkouts,
       avgs.ad AS AvgWorkoutDuration,
       logs.sc * greatest(COALESCE(meas.k, 1), 1) AS TotalCaloriesBurned,
       meas.hi AS CurrentWeight, meas.lo AS StartingWeight, meas.sleep AS AvgSleepHours
FROM ((member m LEFT JOIN logs USING (M_ID)) LEFT JOIN meas USING (M_ID)) LEFT JOIN avgs USING (M_ID)"""))
def _member_progress_rollup(spark, d):
    return B.member_progress_rollup(tables(spark, d))


@register("member_progress_rollup_exact", q(f"""
, lg AS (SELECT M_ID, COUNT(L_ID) AS n, {A('Duration')} AS ad, SUM(CaloriesBurnt) AS sc
         FROM workout_log GROUP BY M_ID),
  hm AS (SELECT M_ID, MAX(Weight) AS mx, MIN(Weight) AS mn, {A('SleepHours')} AS sl
         FROM health_metrics GROUP BY M_ID)
SELECT m.M_ID, m.Name, COALESCE(lg.n, 0) AS TotalWorkouts, lg.ad AS AvgWorkoutDuration,
       lg.sc AS TotalCaloriesBurned, hm.mx AS CurrentWeight, hm.mn AS StartingWeight,
       hm.sl AS AvgSleepHours
FROM member m LEFT JOIN lg ON m.M_ID = lg.M_ID LEFT JOIN hm ON m.M_ID = hm.M_ID"""))
def _member_progress_rollup_exact(spark, d):
    return B.member_progress_rollup_exact(tables(spark, d))


@register("available_sessions", q("""
, taken AS (SELECT S_ID, COUNT(*) AS k FROM workout_log WHERE Exercise = 'Session Booking' GROUP BY S_ID),
  coach AS (SELECT T_ID, Name AS TrainerName, Specialization FROM trainer),
  open_ AS (SELECT * FROM session WHERE Status = 'scheduled' AND NOT SessionDate < DATE '2024-01-30')
SELECT S_ID, Details, SessionDate, SessionTime, Duration, TrainerName, Specialization,
       COALESCE(k, 0) AS CurrentParticipants, MaxParticipants, MaxParticipants - COALESCE(k, 0) AS AvailableSpots
FROM (open_ JOIN coach USING (T_ID)) LEFT JOIN taken USING (S_ID)
WHERE COALESCE(k, 0) < MaxParticipants"""))
def _available_sessions(spark, d):
    return B.available_sessions(tables(spark, d))


@register("available_sessions_any_status", q("""
, taken AS (SELECT S_ID, COUNT(*) AS k FROM workout_log WHERE Exercise = 'Session Booking' GROUP BY S_ID),
  coach AS (SELECT T_ID, Name AS TrainerName, Specialization FROM trainer)
SELECT S_ID, Details, SessionDate, SessionTime, Duration, T_ID, MaxParticipants, Status, TrainerName,
       Specialization, COALESCE(k, 0) AS participantCount
FROM (session JOIN coach USING (T_ID)) LEFT JOIN taken USING (S_ID)
WHERE NOT SessionDate < DATE '2024-01-30' AND MaxParticipants - COALESCE(k, 0) > 0"""))
def _available_sessions_any_status(spark, d):
    return B.available_sessions_any_status(tables(spark, d))


@register("upcoming_bookings", q("""
, ahead AS (SELECT S_ID, T_ID, Details, SessionDate, SessionTime FROM session
            WHERE NOT SessionDate < DATE '2024-01-30'),
  booked AS (SELECT M_ID, S_ID, L_ID AS BookingID FROM workout_log WHERE Exercise = 'Session Booking'),
  coach AS (SELECT T_ID, Name AS TrainerName FROM trainer)
SELECT M_ID, S_ID, Details, SessionDate, SessionTime, TrainerName, BookingID
FROM (booked JOIN ahead USING (S_ID)) JOIN coach USING (T_ID)"""))
def _upcoming_bookings(spark, d):
    return B.upcoming_bookings(tables(spark, d))
