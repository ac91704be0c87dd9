"""Per-request analytics of the web application, in all-entity form, plus
the two rule engines (recommendations, chat intent) as column expressions."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.functions.exprs import (DEFAULT_AS_OF, avg_exact, days_before, is_booking, lit_date,
                                     order_key)
from fitlake.functions.exprs import ci as ci_key
from fitlake.operators.common import booking_counts, top_k
from fitlake.sources import schema as SC
from fitlake.sources.tables import Tables

# ---- fixed values that must equal the reference's ---------------------------
# Multi-recommendation rules: (type, message, exercise, minutes).
REC_STEPS_LOW = ("cardio", "Your step count is below the recommended 10,000 daily steps. "
                 "Try adding a 30-minute brisk walk.", "Brisk Walking", 30)
REC_STEPS_MID = ("cardio", "Great progress on steps! Aim for 10,000 steps daily with an "
                 "additional 20-minute walk.", "Walking", 20)
REC_SLEEP = ("recovery", "Your sleep is below optimal levels. Consider a light yoga session "
             "to improve sleep quality.", "Evening Yoga", 20)
REC_FEW = ("general", "You've worked out less than 3 times this week. Try adding a 45-minute "
           "cardio or strength training session.", "Mixed Cardio & Strength", 45)
REC_MANY = ("recovery", "Excellent workout frequency! Consider a recovery session with "
            "stretching or light yoga.", "Recovery Stretching", 30)
REC_VARIETY = ("variety", "Mix up your routine! Try adding strength training or HIIT to "
               "complement your current workouts.", "HIIT Training", 30)
REC_INTENSITY = ("intensity", "Increase your workout intensity to burn more calories. "
                 "Try interval training.", "Interval Training", 40)
REC_FALLBACK = ("general", "You're doing great! Keep maintaining your current routine and "
                "consider progressive overload.", "Current Routine", 45)
# Chat intent routing: (intent, keywords) in the order tested; first match wins.
INTENTS = (
    ("progress", ("progress", "doing", "performance", "improvement")),
    ("weight", ("weight", "lose", "gain", "body")),
    ("workout", ("workout", "exercise", "train", "routine")),
    ("session", ("session", "class", "trainer", "book")),
    ("sleep", ("sleep", "rest", "recovery")),
    ("calorie", ("calorie", "burn", "diet", "nutrition")),
    ("goal", ("goal", "target", "aim", "plan")),
    ("membership", ("membership", "renew", "upgrade", "plan")),
)
INTENT_DEFAULT = "greeting"
COACH_TYPE = "Gold"
# Tables that a role may read.
ROLE_TABLES = {
    "admin": ("gym", "membership_type", "member", "trainer", "admin", "session", "workout_log",
              "health_metrics", "notifications"),
    "trainer": ("session", "member", "workout_log", "health_metrics", "gym", "membership_type",
                "trainer"),
    "member": ("member", "workout_log", "health_metrics", "session", "trainer", "gym",
               "membership_type", "notifications"),
}
# ---- end of fixed values ----------------------------------------------------


def today_stats(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Per member on as_of: calories, distance (0 default) and row count."""
    day = t.workout_log.filter(F.col("Date") == lit_date(as_of)).groupBy("M_ID").agg(
        F.sum("CaloriesBurnt").alias("_c"), F.sum("Distance").alias("_d"),
        F.count(F.lit(1)).alias("_n"))
    z = F.lit(0)
    return (t.member.select("M_ID").join(day, "M_ID", "left")
            .select("M_ID", F.coalesce("_c", z).cast("decimal(16,2)").alias("TodayCalories"),
                    F.coalesce("_d", z).cast("decimal(16,2)").alias("TodayDistance"),
                    F.coalesce("_n", z).alias("TodayWorkouts")))


def today_health(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Latest (by Metric_ID) metric row dated as_of, for members having one."""
    vals = ["Weight", "Height", "SleepHours", "WaterLiters", "Steps"]
    return (t.health_metrics.filter(F.col("Date") == lit_date(as_of)).groupBy("M_ID")
            .agg(*[F.max_by(c, "Metric_ID").alias(c) for c in vals]))


def workout_frequency(t: Tables, as_of: dt.date = DEFAULT_AS_OF, days: int = 30) -> DataFrame:
    return (t.workout_log.filter(F.col("Date") >= days_before(as_of, days))
            .groupBy("M_ID", "Date").agg(F.count(F.lit(1)).alias("workout_count")))


def weight_series(t: Tables) -> DataFrame:
    return t.health_metrics.filter(F.col("Weight").isNotNull()).select("M_ID", "Date", "Weight")


def calorie_trend(t: Tables) -> DataFrame:
    return (t.workout_log.filter(F.col("CaloriesBurnt").isNotNull())
            .groupBy("M_ID", "Date").agg(F.sum("CaloriesBurnt").alias("daily_calories")))


def exercise_patterns(t: Tables, as_of: dt.date = DEFAULT_AS_OF, days: int = 30,
                      ci: bool = False) -> DataFrame:
    """Per member and exercise over the last `days`.  `ci=True` groups
    exercise names case/accent-insensitively like the reference's
    *_unicode_ci collation ([T1])."""
    ex = ci_key(F.col("Exercise")).alias("Exercise") if ci else F.col("Exercise")
    return (t.workout_log.filter(F.col("Date") >= days_before(as_of, days))
            .groupBy("M_ID", ex).agg(
                avg_exact("CaloriesBurnt", 2).alias("avg_calories"),
                avg_exact("Duration").alias("avg_duration"),
                F.count(F.lit(1)).alias("frequency")))


def _rec(r) -> Column:
    typ, msg, ex, mins = r
    return F.struct(F.lit(typ).alias("type"), F.lit(msg).alias("message"),
                    F.lit(ex).alias("exercise"), F.lit(mins).alias("duration"))


def rule_recommendations(t: Tables, as_of: dt.date = DEFAULT_AS_OF, max_n: int = 3) -> DataFrame:
    """Ordered rule list per member, first `max_n` kept, flattened to
    (M_ID, position, type, message, exercise, duration).  Built as an array of
    optional structs: no Python on the data path."""
    # One scan: the 7-day rows are counted inside the 30-day groups.
    pat = (t.workout_log.filter(F.col("Date") >= days_before(as_of, 30)).groupBy("M_ID", "Exercise").agg(
        avg_exact("CaloriesBurnt", 2).alias("avg_calories"),
        F.count(F.when(F.col("Date") >= days_before(as_of, 7), F.lit(1))).alias("_week")))
    per_m = pat.groupBy("M_ID").agg(
        F.count(F.lit(1)).alias("_groups"),
        F.sum(F.coalesce("avg_calories", F.lit(0))).alias("_cal_sum"),
        F.sum("_week").alias("_weekly"))
    key = order_key("Date", "Metric_ID")
    hm = t.health_metrics.groupBy("M_ID").agg(F.max_by("Steps", key).alias("_steps"),
                                              F.max_by("SleepHours", key).alias("_sleep"))
    f = t.member.select("M_ID").join(per_m, "M_ID", "left").join(hm, "M_ID", "left")
    steps, sleep = F.col("_steps"), F.col("_sleep")
    weekly = F.coalesce("_weekly", F.lit(0))
    groups = F.coalesce("_groups", F.lit(0))
    recs = F.array(
        F.when(steps < 5000, _rec(REC_STEPS_LOW)),
        F.when((steps >= 5000) & (steps < 8000), _rec(REC_STEPS_MID)),
        F.when(sleep < 6, _rec(REC_SLEEP)),
        F.when(weekly < 3, _rec(REC_FEW)),
        F.when(weekly >= 5, _rec(REC_MANY)),
        F.when((groups > 0) & (groups < 2), _rec(REC_VARIETY)),
        F.when((groups > 0) & (F.col("_cal_sum") < F.lit(200) * groups), _rec(REC_INTENSITY)))
    kept = F.filter(recs, lambda x: x.isNotNull())
    final = F.when(F.size(kept) == 0, F.array(_rec(REC_FALLBACK))).otherwise(kept)
    return (f.select("M_ID", F.posexplode(F.slice(final, 1, max_n)).alias("_p", "_r"))
            .select("M_ID", (F.col("_p") + 1).alias("position"), "_r.type", "_r.message",
                    "_r.exercise", "_r.duration"))


def notification_inbox(t: Tables, k: int = 10) -> DataFrame:
    """Newest k notifications per member (CreatedAt, then Notif_ID)."""
    return top_k(t.notifications, ["M_ID"],
                 [F.col("CreatedAt").desc(), F.col("Notif_ID").desc()], k)


def unread_badge(t: Tables, k: int = 10) -> DataFrame:
    """Unread count within each member's inbox page (not over all rows)."""
    return (notification_inbox(t, k).groupBy("M_ID")
            .agg(F.count(F.when(F.col("IsRead") == F.lit(False), 1)).alias("unread")))


def _clients_per_trainer(t: Tables) -> DataFrame:
    pairs = t.workout_log.filter(F.col("S_ID").isNotNull()).select("S_ID", "M_ID").distinct()
    return pairs.join(t.session.select("S_ID", "T_ID"), "S_ID").select("T_ID", "M_ID").distinct()


def trainer_clients_today(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    cl = _clients_per_trainer(t).groupBy("T_ID").agg(F.count(F.lit(1)).alias("_c"))
    td = (t.session.filter(F.col("SessionDate") == lit_date(as_of)).groupBy("T_ID")
          .agg(F.count(F.lit(1)).alias("_s")))
    z = F.lit(0)
    return (t.trainer.select("T_ID").join(cl, "T_ID", "left").join(td, "T_ID", "left")
            .select("T_ID", F.coalesce("_c", z).alias("totalClients"),
                    F.coalesce("_s", z).alias("sessionsToday")))


def trainer_sessions(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Upcoming sessions (any status) with their booking count."""
    return (t.session.filter(F.col("SessionDate") >= lit_date(as_of))
            .join(booking_counts(t.workout_log), "S_ID", "left")
            .select(*t.session.columns,
                    F.coalesce("n_bookings", F.lit(0)).alias("participantCount")))


def trainer_clients(t: Tables) -> DataFrame:
    """Distinct clients per trainer with their last log date over all logs."""
    last = t.workout_log.groupBy("M_ID").agg(F.max("Date").alias("lastWorkout"))
    return (_clients_per_trainer(t).join(t.member.select("M_ID", "Name", "Email"), "M_ID")
            .join(last, "M_ID", "left")
            .select("T_ID", "M_ID", "Name", "Email", "lastWorkout"))


def admin_totals(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """One row: four independent global aggregates combined."""
    m = t.member.agg(F.count(F.lit(1)).alias("totalMembers"))
    tr = t.trainer.agg(F.count(F.lit(1)).alias("totalTrainers"))
    s = t.session.filter(F.col("SessionDate") >= lit_date(as_of)) \
        .agg(F.count(F.lit(1)).alias("activeSessions"))
    rev = (t.member.join(t.membership_type.select("Type_ID", "Price"),
                         F.col("MembershipType_ID") == F.col("Type_ID"))
           .agg(F.coalesce(F.sum("Price"), F.lit(0)).cast("decimal(38,2)").alias("totalRevenue")))
    # one-row frames: joining them on a constant key is a 1x1 join
    k = F.lit(1).alias("_k")
    out = m.select(k, "*")
    for other in (tr, s, rev):
        out = out.join(other.select(k, "*"), "_k")
    return out.drop("_k")


def admin_trainers(t: Tables) -> DataFrame:
    cc = _clients_per_trainer(t).groupBy("T_ID").agg(F.count(F.lit(1)).alias("_c"))
    g = t.gym.select("Gym_ID", F.col("Location").alias("GymLocation"))
    return (t.trainer.join(g, "Gym_ID", "left").join(cc, "T_ID", "left")
            .select("T_ID", "Name", "Email", "Specialization", "GymLocation",
                    F.coalesce("_c", F.lit(0)).alias("clientCount")))


def coach_eligible(t: Tables) -> DataFrame:
    mt = t.membership_type.select("Type_ID", F.col("Name").alias("MembershipType"))
    return (t.member.join(mt, F.col("MembershipType_ID") == F.col("Type_ID"))
            .filter(F.col("MembershipType") == COACH_TYPE)
            .select("M_ID", "Name", "MembershipType", "Age", "JoinDate"))


def coach_exercises(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """(M_ID, Exercise): what eligible members did in the last 30 days."""
    return (t.workout_log.filter((F.col("Date") >= days_before(as_of, 30)) & F.col("Exercise").isNotNull())
            .select("M_ID", "Exercise").distinct().join(coach_eligible(t).select("M_ID"), "M_ID", "left_semi"))


def coach_recent_workouts(t: Tables, as_of: dt.date = DEFAULT_AS_OF, k: int = 5) -> DataFrame:
    """The k newest log rows of the last 30 days of each eligible member."""
    log = (t.workout_log.filter(F.col("Date") >= days_before(as_of, 30))
           .select("M_ID", "L_ID", "Exercise", "Date", "Duration", "CaloriesBurnt")
           .join(coach_eligible(t).select("M_ID"), "M_ID", "left_semi"))
    return top_k(log, ["M_ID"], [F.col("Date").desc(), F.col("L_ID").desc()], k, rank_col="position")


def coach_next_sessions(t: Tables, as_of: dt.date = DEFAULT_AS_OF, k: int = 3) -> DataFrame:
    """The k next booked sessions of each eligible member."""
    s = t.session.filter(F.col("SessionDate") >= lit_date(as_of)) \
        .select("S_ID", "Details", "SessionDate", "SessionTime")
    b = (t.workout_log.filter(is_booking()).select("M_ID", "L_ID", "S_ID").join(s, "S_ID")
         .join(coach_eligible(t).select("M_ID"), "M_ID", "left_semi")
         .select("M_ID", "L_ID", "Details", "SessionDate", "SessionTime"))
    return top_k(b, ["M_ID"], [F.col("SessionDate"), F.col("SessionTime"), F.col("L_ID")], k, rank_col="position")


def coach_context(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Flat data part of the coach prompt for every eligible member: 30-day
    workout stats (NULL duration/calories as 0), weight trend over the 5
    newest metric rows, latest metrics.  Its lists are frames of their own:
    `coach_exercises`, `coach_recent_workouts`, `coach_next_sessions`."""
    w = (t.workout_log.filter(F.col("Date") >= days_before(as_of, 30)).groupBy("M_ID").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.coalesce("Duration", F.lit(0))).alias("_dur"),
        F.sum(F.coalesce("CaloriesBurnt", F.lit(0))).alias("_cal")))
    last5 = top_k(t.health_metrics, ["M_ID"], [F.col("Date").desc(), F.col("Metric_ID").desc()], 5,
                  rank_col="_rn")
    h = last5.groupBy("M_ID").agg(F.count(F.lit(1)).alias("_hn"),
                                  *[F.min_by(c, "_rn").alias(f"_new_{c}")
                                    for c in ("Weight", "Steps", "SleepHours", "WaterLiters")],
                                  F.max_by("Weight", "_rn").alias("_old_w"))
    change = F.when(F.col("_hn") >= 2, F.col("_new_Weight") - F.col("_old_w")) \
        .otherwise(F.lit(0)).cast("decimal(6,2)")
    n = F.coalesce("_n", F.lit(0))
    cal = F.coalesce("_cal", F.lit(0)).cast("decimal(38,2)")
    return (coach_eligible(t).join(w, "M_ID", "left").join(h, "M_ID", "left")
            .select("M_ID", "Name", "Age", "JoinDate", "MembershipType", n.alias("total_workouts"),
                    F.when(n > 0, F.col("_dur").cast("double") / n).otherwise(F.lit(0.0))
                    .alias("avg_duration"),
                    cal.alias("total_calories"),
                    F.when(n > 0, cal.cast("double") / n).otherwise(F.lit(0.0)).alias("avg_calories"),
                    change.alias("weight_change"),
                    F.when(change < -0.5, "decreasing").when(change > 0.5, "increasing")
                    .otherwise("stable").alias("weight_trend"),
                    F.col("_new_Weight").alias("current_weight"),
                    F.col("_new_Steps").alias("current_steps"),
                    F.col("_new_SleepHours").alias("current_sleep"),
                    F.col("_new_WaterLiters").alias("current_water")))


def intent_expr(text: Column) -> Column:
    """Ordered, case-sensitive substring routing; first matching list wins."""
    out = None
    for intent, words in INTENTS:
        cond = None
        for w in words:
            c = text.contains(w)
            cond = c if cond is None else (cond | c)
        out = F.when(cond, intent) if out is None else out.when(cond, intent)
    return out.otherwise(INTENT_DEFAULT)


def question_intent(questions: DataFrame) -> DataFrame:
    return questions.select("conv_id", "turn", intent_expr(F.col("text")).alias("intent"))


def display_format(t: Tables) -> DataFrame:
    """Workout cards as displayed: 'Jan 5, 2024', minutes (0 if none),
    rounded calories, session time 'h:mm AM' or 'N/A'."""
    s = t.session.select("S_ID", "SessionTime")
    # rows without a session (one NULL key) are not sent through the join
    log = t.workout_log.select("L_ID", "M_ID", "S_ID", "Date", "Duration", "CaloriesBurnt")
    j = log.filter(F.col("S_ID").isNotNull()).join(s, "S_ID", "left").unionByName(
        log.filter(F.col("S_ID").isNull()).withColumn("SessionTime", F.lit(None).cast("string")))
    tm = F.date_format(F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), F.col("SessionTime"))), "h:mm a")
    return j.select("L_ID", "M_ID",
                    F.coalesce(F.date_format("Date", "MMM d, yyyy"), F.lit("N/A")).alias("DateText"),
                    F.coalesce("Duration", F.lit(0)).alias("Minutes"),
                    F.floor(F.coalesce("CaloriesBurnt", F.lit(0)) + F.lit(0.5)).cast("bigint")
                    .alias("Calories"),
                    F.coalesce(tm, F.lit("N/A")).alias("SessionTimeText"))


def role_scope(t: Tables, role: str, user_id: int | None = None) -> dict[str, DataFrame]:
    """Tables a role may read, with the application's own-rows filter:
    members see their own member / log / metric / notification rows;
    trainers their own row, sessions, the log rows on those sessions and
    those clients.  Secrets are never carried in these schemas."""
    allowed = {n: getattr(t, n) for n in ROLE_TABLES[role]}
    if role == "member" and user_id is not None:
        for n in ("member", "workout_log", "health_metrics", "notifications"):
            allowed[n] = allowed[n].filter(F.col("M_ID") == user_id)
    elif role == "trainer" and user_id is not None:
        allowed["trainer"] = allowed["trainer"].filter(F.col("T_ID") == user_id)
        allowed["session"] = allowed["session"].filter(F.col("T_ID") == user_id)
        own = allowed["session"].select("S_ID")
        allowed["workout_log"] = allowed["workout_log"].join(own, "S_ID", "left_semi")
        clients = allowed["workout_log"].select("M_ID").distinct()
        allowed["member"] = allowed["member"].join(clients, "M_ID", "left_semi")
        allowed["health_metrics"] = allowed["health_metrics"].join(clients, "M_ID", "left_semi")
    return allowed


def scope_keys(t: Tables, role: str, user_id: int | None = None) -> DataFrame:
    """(table_name, id): the primary keys of every row in a role's scope."""
    parts = [df.select(F.lit(n).alias("table_name"), F.col(SC.PRIMARY_KEYS[n]).alias("id"))
             for n, df in role_scope(t, role, user_id).items()]
    return reduce(DataFrame.unionByName, parts)
