"""Registered application analytics, recommendations and dashboards (§2.8)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fitlake.operators import app as A
from fitlake.operators import dashboards as DB
from fitlake.plans.oracle import avg_exact as AV
from fitlake.plans.oracle import q
from fitlake.plans.registry import register, tables
from fitlake.session import checkpoint_dir
from fitlake.sources.tables import questions

_AS = "DATE '2024-01-30'"


@register("today_stats", q(f"""
SELECT m.M_ID,
       CAST(COALESCE((SELECT SUM(CaloriesBurnt) FROM workout_log w WHERE w.M_ID = m.M_ID AND w.Date = {_AS}), 0) AS DECIMAL(16,2)) AS TodayCalories,
       CAST(COALESCE((SELECT SUM(Distance) FROM workout_log w WHERE w.M_ID = m.M_ID AND w.Date = {_AS}), 0) AS DECIMAL(16,2)) AS TodayDistance,
       (SELECT COUNT(*) FROM workout_log w WHERE w.M_ID = m.M_ID AND w.Date = {_AS}) AS TodayWorkouts
FROM member m"""))
def _today_stats(spark, d):
    return A.today_stats(tables(spark, d))


@register("today_health", q(f"""
SELECT M_ID, Weight, Height, SleepHours, WaterLiters, Steps FROM (
  SELECT *, row_number() OVER (PARTITION BY M_ID ORDER BY Metric_ID DESC) AS rn
  FROM health_metrics WHERE Date = {_AS}) WHERE rn = 1"""))
def _today_health(spark, d):
    return A.today_health(tables(spark, d))


@register("workout_frequency", q(f"""
SELECT M_ID, Date, COUNT(*) AS workout_count FROM workout_log
WHERE Date >= {_AS} - 30 GROUP BY M_ID, Date"""))
def _workout_frequency(spark, d):
    return A.workout_frequency(tables(spark, d))


@register("weight_series", q("""
SELECT M_ID, Date, Weight FROM health_metrics WHERE Weight IS NOT NULL"""))
def _weight_series(spark, d):
    return A.weight_series(tables(spark, d))


@register("calorie_trend", q("""
SELECT M_ID, Date, SUM(CaloriesBurnt) AS daily_calories FROM workout_log
WHERE CaloriesBurnt IS NOT NULL GROUP BY M_ID, Date"""))
def _calorie_trend(spark, d):
    return A.calorie_trend(tables(spark, d))


_PATTERNS = f"""
, pat AS (
  SELECT M_ID, Exercise, {AV('CaloriesBurnt', 2)} AS avg_calories, {AV('Duration')} AS avg_duration,
         COUNT(*) AS frequency
  FROM workout_log WHERE Date >= {_AS} - 30 GROUP BY M_ID, Exercise)"""


@register("exercise_patterns", q(_PATTERNS + """
SELECT * FROM pat"""))
def _exercise_patterns(spark, d):
    return A.exercise_patterns(tables(spark, d))


# The rules, in order, as the application words them (fixed values, written out
# here a second time on purpose: the operator's own list is what is tested).
_RULES = """(VALUES
  (1, 'cardio', 'Your step count is below the recommended 10,000 daily steps. Try adding a 30-minute brisk walk.', 'Brisk Walking', 30),
  (2, 'cardio', 'Great progress on steps! Aim for 10,000 steps daily with an additional 20-minute walk.', 'Walking', 20),
  (3, 'recovery', 'Your sleep is below optimal levels. Consider a light yoga session to improve sleep quality.', 'Evening Yoga', 20),
  (4, 'general', 'You''ve worked out less than 3 times this week. Try adding a 45-minute cardio or strength training session.', 'Mixed Cardio & Strength', 45),
  (5, 'recovery', 'Excellent workout frequency! Consider a recovery session with stretching or light yoga.', 'Recovery Stretching', 30),
  (6, 'variety', 'Mix up your routine! Try adding strength training or HIIT to complement your current workouts.', 'HIIT Training', 30),
  (7, 'intensity', 'Increase your workout intensity to burn more calories. Try interval training.', 'Interval Training', 40),
  (8, 'general', 'You''re doing great! Keep maintaining your current routine and consider progressive overload.', 'Current Routine', 45))
  AS r(ord, type, message, exercise, duration)"""


@register("rule_recommendations", q(_PATTERNS + f"""
, pm AS (SELECT M_ID, COUNT(*) AS g, SUM(COALESCE(avg_calories, 0)) AS cs FROM pat GROUP BY M_ID),
  hl AS (SELECT M_ID, Steps, SleepHours FROM (
           SELECT *, row_number() OVER (PARTITION BY M_ID ORDER BY Date DESC, Metric_ID DESC) AS rn
           FROM health_metrics) WHERE rn = 1),
  wk AS (SELECT M_ID, COUNT(*) AS n FROM workout_log WHERE Date >= {_AS} - 7 GROUP BY M_ID),
  f AS (SELECT m.M_ID, hl.Steps AS steps, hl.SleepHours AS sleep, COALESCE(wk.n, 0) AS weekly,
               COALESCE(pm.g, 0) AS g, pm.cs
        FROM member m LEFT JOIN pm ON m.M_ID = pm.M_ID LEFT JOIN hl ON m.M_ID = hl.M_ID
        LEFT JOIN wk ON m.M_ID = wk.M_ID),
  met AS (
  SELECT M_ID, unnest(list_filter([
    CASE WHEN steps < 5000 THEN 1 END, CASE WHEN steps >= 5000 AND steps < 8000 THEN 2 END,
    CASE WHEN sleep < 6 THEN 3 END, CASE WHEN weekly < 3 THEN 4 END, CASE WHEN weekly >= 5 THEN 5 END,
    CASE WHEN g > 0 AND g < 2 THEN 6 END, CASE WHEN g > 0 AND cs < 200 * g THEN 7 END], lambda x: x IS NOT NULL)) AS ord
  FROM f),
  every AS (SELECT * FROM met UNION ALL SELECT M_ID, 8 FROM f WHERE M_ID NOT IN (SELECT M_ID FROM met)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY M_ID ORDER BY ord) AS position FROM every)
SELECT M_ID, position, type, message, exercise, duration FROM ranked JOIN {_RULES} USING (ord) WHERE position <= 3"""))
def _rule_recommendations(spark, d):
    return A.rule_recommendations(tables(spark, d))


@register("notification_inbox", q("""
SELECT Notif_ID, M_ID, Message, Type, IsRead, CreatedAt FROM (
  SELECT *, row_number() OVER (PARTITION BY M_ID ORDER BY CreatedAt DESC, Notif_ID DESC) AS rn
  FROM notifications) WHERE rn <= 10"""))
def _notification_inbox(spark, d):
    return A.notification_inbox(tables(spark, d))


@register("unread_badge", q("""
SELECT M_ID, COUNT(CASE WHEN IsRead = FALSE THEN 1 END) AS unread FROM (
  SELECT *, row_number() OVER (PARTITION BY M_ID ORDER BY CreatedAt DESC, Notif_ID DESC) AS rn
  FROM notifications) WHERE rn <= 10 GROUP BY M_ID"""))
def _unread_badge(spark, d):
    return A.unread_badge(tables(spark, d))


@register("trainer_clients_today", q(f"""
, taken AS (SELECT T_ID, COUNT(*) AS k FROM (
    SELECT DISTINCT s.T_ID, wl.M_ID FROM workout_log wl JOIN session s USING (S_ID)) GROUP BY T_ID),
  today AS (SELECT T_ID, COUNT(*) AS k FROM session WHERE SessionDate = {_AS} GROUP BY T_ID)
SELECT T_ID, COALESCE(taken.k, 0) AS totalClients, COALESCE(today.k, 0) AS sessionsToday
FROM (trainer LEFT JOIN taken USING (T_ID)) LEFT JOIN today USING (T_ID)"""))
def _trainer_clients_today(spark, d):
    return A.trainer_clients_today(tables(spark, d))


@register("trainer_sessions", q(f"""
, taken AS (SELECT S_ID, COUNT(*) AS k FROM workout_log WHERE Exercise = 'Session Booking' GROUP BY S_ID)
SELECT session.*, COALESCE(k, 0) AS participantCount
FROM session LEFT JOIN taken USING (S_ID) WHERE NOT SessionDate < {_AS}"""))
def _trainer_sessions(spark, d):
    return A.trainer_sessions(tables(spark, d))


@register("trainer_clients", q("""
, seen AS (SELECT T_ID, M_ID FROM workout_log JOIN (SELECT S_ID, T_ID FROM session) USING (S_ID) GROUP BY ALL),
  latest AS (SELECT M_ID, MAX(Date) AS lastWorkout FROM workout_log GROUP BY M_ID)
SELECT T_ID, M_ID, Name, Email, lastWorkout
FROM (seen JOIN member USING (M_ID)) JOIN latest USING (M_ID)"""))
def _trainer_clients(spark, d):
    return A.trainer_clients(tables(spark, d))


@register("admin_totals", q(f"""
, per_plan AS (SELECT MembershipType_ID AS Type_ID, COUNT(*) AS k FROM member GROUP BY ALL),
  money AS (SELECT SUM(k * Price) AS total FROM per_plan JOIN membership_type USING (Type_ID)),
  n AS (SELECT (SELECT COUNT(M_ID) FROM member) AS a, (SELECT COUNT(T_ID) FROM trainer) AS b,
               COUNT(*) FILTER (NOT SessionDate < {_AS}) AS c FROM session)
SELECT a AS totalMembers, b AS totalTrainers, c AS activeSessions,
       CAST(COALESCE(total, 0) AS DECIMAL(38,2)) AS totalRevenue FROM n, money"""))
def _admin_totals(spark, d):
    return A.admin_totals(tables(spark, d))


@register("admin_trainers", q("""
, taken AS (SELECT T_ID, COUNT(*) AS k FROM (
    SELECT DISTINCT s.T_ID, wl.M_ID FROM workout_log wl JOIN session s USING (S_ID)) GROUP BY T_ID),
  place AS (SELECT Gym_ID, Location AS GymLocation FROM gym)
SELECT T_ID, Name, Email, Specialization, GymLocation, COALESCE(k, 0) AS clientCount
FROM (trainer LEFT JOIN place USING (Gym_ID)) LEFT JOIN taken USING (T_ID)"""))
def _admin_trainers(spark, d):
    return A.admin_trainers(tables(spark, d))


@register("coach_eligible", q("""
SELECT m.M_ID, m.Name, mt.Name AS MembershipType, m.Age, m.JoinDate
FROM member m JOIN membership_type mt ON m.MembershipType_ID = mt.Type_ID WHERE mt.Name = 'Gold'"""))
def _coach_eligible(spark, d):
    return A.coach_eligible(tables(spark, d))


@register("coach_context", q(f"""
, w AS (
  SELECT M_ID, COUNT(*) AS n, SUM(COALESCE(Duration, 0)) AS dur,
         SUM(COALESCE(CaloriesBurnt, 0)) AS cal
  FROM workout_log WHERE Date >= {_AS} - 30 GROUP BY M_ID),
  h5 AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY M_ID ORDER BY Date DESC, Metric_ID DESC) AS rn
    FROM health_metrics) WHERE rn <= 5),
  hs AS (
  SELECT M_ID, COUNT(*) AS hn, MAX(rn) AS last_rn FROM h5 GROUP BY M_ID),
  hx AS (
  SELECT hs.M_ID, hs.hn, nw.Weight AS w_new, nw.Steps, nw.SleepHours, nw.WaterLiters, od.Weight AS w_old
  FROM hs JOIN h5 nw ON nw.M_ID = hs.M_ID AND nw.rn = 1
          JOIN h5 od ON od.M_ID = hs.M_ID AND od.rn = hs.last_rn),
  base AS (
  SELECT m.M_ID, m.Name, m.Age, m.JoinDate, mt.Name AS MembershipType, COALESCE(w.n, 0) AS total_workouts,
         CASE WHEN COALESCE(w.n, 0) > 0 THEN CAST(w.dur AS DOUBLE) / w.n ELSE 0.0 END AS avg_duration,
         CAST(COALESCE(w.cal, 0) AS DECIMAL(38,2)) AS total_calories,
         CASE WHEN COALESCE(w.n, 0) > 0 THEN CAST(CAST(COALESCE(w.cal, 0) AS DECIMAL(38,2)) AS DOUBLE) / w.n
              ELSE 0.0 END AS avg_calories,
         CAST(CASE WHEN hx.hn >= 2 THEN hx.w_new - hx.w_old ELSE 0 END AS DECIMAL(6,2)) AS weight_change,
         hx.w_new AS current_weight, hx.Steps AS current_steps, hx.SleepHours AS current_sleep,
         hx.WaterLiters AS current_water
  FROM member m JOIN membership_type mt ON m.MembershipType_ID = mt.Type_ID
  LEFT JOIN w ON m.M_ID = w.M_ID LEFT JOIN hx ON m.M_ID = hx.M_ID
  WHERE mt.Name = 'Gold')
SELECT M_ID, Name, Age, JoinDate, MembershipType, total_workouts, avg_duration, total_calories, avg_calories, weight_change,
       CASE WHEN weight_change < -0.5 THEN 'decreasing' WHEN weight_change > 0.5 THEN 'increasing'
            ELSE 'stable' END AS weight_trend,
       current_weight, current_steps, current_sleep, current_water
FROM base"""))
def _coach_context(spark, d):
    return A.coach_context(tables(spark, d))


@register("question_intent", q("""
, words(ord, intent, word) AS (VALUES
  (1, 'progress', 'progress'), (1, 'progress', 'doing'), (1, 'progress', 'performance'), (1, 'progress', 'improvement'),
  (2, 'weight', 'weight'), (2, 'weight', 'lose'), (2, 'weight', 'gain'), (2, 'weight', 'body'),
  (3, 'workout', 'workout'), (3, 'workout', 'exercise'), (3, 'workout', 'train'), (3, 'workout', 'routine'),
  (4, 'session', 'session'), (4, 'session', 'class'), (4, 'session', 'trainer'), (4, 'session', 'book'),
  (5, 'sleep', 'sleep'), (5, 'sleep', 'rest'), (5, 'sleep', 'recovery'),
  (6, 'calorie', 'calorie'), (6, 'calorie', 'burn'), (6, 'calorie', 'diet'), (6, 'calorie', 'nutrition'),
  (7, 'goal', 'goal'), (7, 'goal', 'target'), (7, 'goal', 'aim'), (7, 'goal', 'plan'),
  (8, 'membership', 'membership'), (8, 'membership', 'renew'), (8, 'membership', 'upgrade'), (8, 'membership', 'plan')),
  n AS (SELECT row_number() OVER () AS r, * FROM questions),
  hits AS (SELECT r, min_by(intent, ord) AS intent FROM n JOIN words ON contains(n.text, words.word) GROUP BY r)
SELECT conv_id, turn, COALESCE(intent, 'greeting') AS intent FROM n LEFT JOIN hits USING (r)"""))
def _question_intent(spark, d):
    return A.question_intent(questions(spark, d))


@register("display_format", q("""
SELECT wl.L_ID, wl.M_ID, COALESCE(strftime(wl.Date, '%b %-d, %Y'), 'N/A') AS DateText,
       COALESCE(wl.Duration, 0) AS Minutes,
       CAST(floor(COALESCE(wl.CaloriesBurnt, 0) + 0.5) AS BIGINT) AS Calories,
       COALESCE(strftime(CAST('2000-01-01 ' || s.SessionTime AS TIMESTAMP), '%-I:%M %p'), 'N/A') AS SessionTimeText
FROM workout_log wl LEFT JOIN session s ON wl.S_ID = s.S_ID"""))
def _display_format(spark, d):
    return A.display_format(tables(spark, d))


_GOLD = "SELECT M_ID FROM member WHERE MembershipType_ID IN (SELECT Type_ID FROM membership_type WHERE Name = 'Gold')"


@register("coach_exercises", q(f"""
SELECT M_ID, Exercise FROM workout_log
WHERE Date >= {_AS} - 30 AND Exercise IS NOT NULL AND M_ID IN ({_GOLD}) GROUP BY ALL"""))
def _coach_exercises(spark, d):
    return A.coach_exercises(tables(spark, d))


@register("coach_recent_workouts", q(f"""
SELECT M_ID, L_ID, Exercise, Date, Duration, CaloriesBurnt,
       CAST(row_number() OVER (PARTITION BY M_ID ORDER BY Date DESC, L_ID DESC) AS INT) AS position
FROM workout_log WHERE Date >= {_AS} - 30 AND M_ID IN ({_GOLD}) QUALIFY position <= 5"""))
def _coach_recent_workouts(spark, d):
    return A.coach_recent_workouts(tables(spark, d))


@register("coach_next_sessions", q(f"""
SELECT M_ID, L_ID, Details, SessionDate, SessionTime,
       CAST(row_number() OVER (PARTITION BY M_ID ORDER BY SessionDate, SessionTime, L_ID) AS INT) AS position
FROM workout_log JOIN (SELECT S_ID, Details, SessionDate, SessionTime FROM session) USING (S_ID)
WHERE Exercise = 'Session Booking' AND SessionDate >= {_AS} AND M_ID IN ({_GOLD}) QUALIFY position <= 3"""))
def _coach_next_sessions(spark, d):
    return A.coach_next_sessions(tables(spark, d))


_KEYS = {"gym": "Gym_ID", "membership_type": "Type_ID", "member": "M_ID", "trainer": "T_ID", "admin": "A_ID",
         "session": "S_ID", "workout_log": "L_ID", "health_metrics": "Metric_ID", "notifications": "Notif_ID"}


def _scope_sql(**where):
    return "\n UNION ALL ".join(f"SELECT '{n}' AS table_name, {_KEYS[n]} AS id FROM {n} WHERE {w}" for n, w in where.items())


@register("role_scope_admin", q(_scope_sql(**{n: "TRUE" for n in _KEYS})))
def _role_scope_admin(spark, d):
    return A.scope_keys(tables(spark, d), "admin")


@register("role_scope_member", q(_scope_sql(
    member="M_ID = 7", workout_log="M_ID = 7", health_metrics="M_ID = 7", notifications="M_ID = 7",
    session="TRUE", trainer="TRUE", gym="TRUE", membership_type="TRUE")))
def _role_scope_member(spark, d):
    return A.scope_keys(tables(spark, d), "member", 7)


_MINE = "S_ID IN (SELECT S_ID FROM session WHERE T_ID = 7)"


@register("role_scope_trainer", q(_scope_sql(
    trainer="T_ID = 7", session="T_ID = 7", workout_log=_MINE,
    member=f"M_ID IN (SELECT M_ID FROM workout_log WHERE {_MINE})",
    health_metrics=f"M_ID IN (SELECT M_ID FROM workout_log WHERE {_MINE})", gym="TRUE", membership_type="TRUE")))
def _role_scope_trainer(spark, d):
    return A.scope_keys(tables(spark, d), "trainer", 7)


_INFO = """
, info AS (
  SELECT M_ID, member.Name, Email, Age, JoinDate, p.Name AS MembershipType, g.Location AS GymLocation
  FROM (member LEFT JOIN membership_type p ON p.Type_ID = MembershipType_ID) LEFT JOIN gym g ON g.Gym_ID = member.Gym_ID)"""


_PROFILE = q(_INFO + f""",
  day AS (SELECT M_ID, SUM(CaloriesBurnt) AS c, SUM(Distance) AS di, COUNT(*) AS n FROM workout_log
          WHERE Date = {_AS} GROUP BY M_ID),
  body AS (SELECT M_ID, Weight, Steps FROM health_metrics WHERE Date = {_AS}
           QUALIFY row_number() OVER (PARTITION BY M_ID ORDER BY Metric_ID DESC) = 1)
SELECT info.*, CAST(COALESCE(c, 0) AS DECIMAL(16,2)) AS TodayCalories, CAST(COALESCE(di, 0) AS DECIMAL(16,2)) AS TodayDistance,
       COALESCE(n, 0) AS TodayWorkouts, Weight, Steps
FROM (info LEFT JOIN day USING (M_ID)) LEFT JOIN body USING (M_ID)""")


@register("member_dashboard_json_stored", _PROFILE)
def _member_dashboard_json_stored(spark, d):
    """The nested dashboard written as JSON lines and read again, its single
    values flat."""
    m = DB.member_dashboard(tables(spark, d))
    path = f"{checkpoint_dir(spark).rstrip('/')}/fitlake-json/{uuid.uuid4().hex}"
    DB.write_json(m, path)
    m = spark.read.schema(m.schema).json(path)
    return m.select("member.*", "todayStats.*", "healthMetrics.Weight", "healthMetrics.Steps")


@register("member_dashboard_profile", _PROFILE)
def _member_dashboard_profile(spark, d):
    """The dashboard's single values, flat."""
    m = DB.member_dashboard(tables(spark, d))
    return m.select("member.*", "todayStats.*", "healthMetrics.Weight", "healthMetrics.Steps")


@register("member_dashboard_workouts", q("""
SELECT M_ID, CAST(row_number() OVER (PARTITION BY M_ID ORDER BY Date DESC, L_ID DESC) - 1 AS INT) AS place,
       L_ID, Exercise, Date, Duration, CaloriesBurnt, Details AS SessionDetails
FROM workout_log LEFT JOIN (SELECT S_ID, Details FROM session) USING (S_ID)
WHERE M_ID IN (SELECT M_ID FROM member) QUALIFY place < 5"""))
def _member_dashboard_workouts(spark, d):
    """The dashboard's newest workouts, exploded."""
    return DB.member_dashboard(tables(spark, d)).select("M_ID", F.posexplode("recentWorkouts").alias("place", "w")).select(
        "M_ID", "place", "w.L_ID", "w.Exercise", "w.Date", "w.Duration", "w.CaloriesBurnt", "w.SessionDetails")


@register("member_dashboard_sessions", q(f"""
SELECT M_ID, CAST(row_number() OVER (PARTITION BY M_ID ORDER BY SessionDate, SessionTime, L_ID) - 1 AS INT) AS place,
       L_ID AS BookingID, S_ID, Details, SessionDate, SessionTime, TrainerName
FROM (workout_log JOIN (SELECT S_ID, T_ID, Details, SessionDate, SessionTime FROM session) USING (S_ID))
     JOIN (SELECT T_ID, Name AS TrainerName FROM trainer) USING (T_ID)
WHERE Exercise = 'Session Booking' AND SessionDate >= {_AS} AND M_ID IN (SELECT M_ID FROM member) QUALIFY place < 5"""))
def _member_dashboard_sessions(spark, d):
    """The dashboard's next bookings, exploded."""
    return DB.member_dashboard(tables(spark, d)).select("M_ID", F.posexplode("upcomingSessions").alias("place", "s")).select(
        "M_ID", "place", "s.BookingID", "s.S_ID", "s.Details", "s.SessionDate", "s.SessionTime", "s.TrainerName")


@register("trainer_dashboard_profile", q(f"""
, who AS (SELECT T_ID, COUNT(*) AS k FROM (
    SELECT DISTINCT T_ID, M_ID FROM workout_log JOIN (SELECT S_ID, T_ID FROM session) USING (S_ID)) GROUP BY T_ID),
  today AS (SELECT T_ID, COUNT(*) AS k FROM session WHERE SessionDate = {_AS} GROUP BY T_ID)
SELECT T_ID, Name, Email, Specialization, COALESCE(who.k, 0) AS totalClients, COALESCE(today.k, 0) AS sessionsToday
FROM (trainer LEFT JOIN who USING (T_ID)) LEFT JOIN today USING (T_ID)"""))
def _trainer_dashboard_profile(spark, d):
    return DB.trainer_dashboard(tables(spark, d)).select("trainer.*", "stats.*")


@register("admin_dashboard_members", q(_INFO + """
SELECT M_ID, Name, Email, JoinDate, MembershipType, GymLocation FROM info"""))
def _admin_dashboard_members(spark, d):
    return DB.admin_dashboard(tables(spark, d))["members"]


@register("member_dashboard")
def _member_dashboard(spark, d):
    return DB.member_dashboard(tables(spark, d))


@register("member_dashboard_json")
def _member_dashboard_json(spark, d):
    return DB.dashboard_json(DB.member_dashboard(tables(spark, d)), "M_ID")


@register("trainer_dashboard")
def _trainer_dashboard(spark, d):
    return DB.trainer_dashboard(tables(spark, d))
