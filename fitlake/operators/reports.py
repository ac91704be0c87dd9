"""Report procedures and batch report jobs, set-based over all entities."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.functions.exprs import (DEFAULT_AS_OF, avg_exact, days_before, half_up_ratio,
                                     lit_date, not_booking, order_key)
from fitlake.operators.base_queries import _session_fanout, _trainer_clients, _weighted_avg_exact
from fitlake.functions.exprs import ci as ci_key
from fitlake.operators.metrics import with_expiry
from fitlake.sources.tables import Tables

# ---- fixed values that must equal the reference's ---------------------------
# (type, message, exercise, minutes) of the single-recommendation procedure, in rule order.
PRIORITY_RULES = (
    ("frequency", "Increase workout frequency to at least 3-4 times per week",
     "Mixed Cardio & Strength", 45),
    ("cardio", "Boost your daily step count with additional cardio", "Brisk Walking", 30),
    ("recovery", "Improve sleep quality with evening relaxation exercises", "Evening Yoga", 20),
    ("variety", "Add exercise variety to your routine for balanced fitness", "HIIT Training", 30),
    ("intensity", "Increase workout intensity for better calorie burn", "Interval Training", 40),
    ("maintenance", "Excellent work! Maintain your current routine with progressive overload",
     "Current Program", 45),
)
# Trainer rating thresholds: (min sessions, min clients, label), first match wins.
TRAINER_RATINGS = ((20, 10, "Excellent"), (10, 5, "Good"), (5, 0, "Average"))
TRAINER_RATING_ELSE = "Needs Improvement"
# Engagement levels: (min score, label), first match wins.
ENGAGEMENT_LEVELS = ((70, "Highly Engaged"), (40, "Moderately Engaged"), (20, "Low Engagement"))
ENGAGEMENT_ELSE = "Inactive"


def member_progress_summary(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Profile + 7/30-day workout and health aggregates + expiry + engagement,
    for every member: one aggregate pass per fact table."""
    d = F.col("Date")
    w7, w30 = d >= days_before(as_of, 7), d >= days_before(as_of, 30)
    # every log measure is windowed: the widest window is pushed to the scan
    lg = t.workout_log.filter(w30).groupBy("M_ID").agg(
        F.count(F.when(w7, F.lit(1))).alias("WeeklyWorkouts"),
        avg_exact(F.when(w30, F.col("CaloriesBurnt")), 2).alias("AvgMonthlyCalories"),
        F.sum(F.when(w30, F.col("CaloriesBurnt"))).alias("TotalMonthlyCalories"),
        F.countDistinct(F.when(w30, d)).alias("_days30"))
    order = order_key("Date", "Metric_ID")
    hm = t.health_metrics.groupBy("M_ID").agg(
        F.max_by("Weight", order).alias("CurrentWeight"),
        F.min_by("Weight", order).alias("StartingWeight"),
        avg_exact(F.when(w7, F.col("SleepHours"))).alias("AvgWeeklySleep"),
        avg_exact(F.when(w7, F.col("Steps"))).alias("AvgWeeklySteps"))
    m = with_expiry(t, t.member.select("M_ID", "Name", "Email", "Age", "JoinDate",
                                       "MembershipType_ID"), as_of)
    return (m.join(lg, "M_ID", "left").join(hm, "M_ID", "left")
            .select("M_ID", "Name", "Email", "Age", "JoinDate",
                    F.coalesce("WeeklyWorkouts", F.lit(0)).alias("WeeklyWorkouts"),
                    "AvgMonthlyCalories",
                    F.col("TotalMonthlyCalories").cast("decimal(38,2)").alias("TotalMonthlyCalories"),
                    "CurrentWeight", "StartingWeight", "AvgWeeklySleep", "AvgWeeklySteps",
                    "DaysUntilExpiry",
                    half_up_ratio(F.coalesce("_days30", F.lit(0)) * 100, F.lit(30), 2)
                    .alias("EngagementScore")))


def priority_recommendation(t: Tables, as_of: dt.date = DEFAULT_AS_OF, ci: bool = False) -> DataFrame:
    """First matching rule per member; a NULL operand skips its rule.
    `ci=True` counts exercise variety case/accent-insensitively ([T1])."""
    w30 = F.col("Date") >= days_before(as_of, 30)
    exercise = ci_key("Exercise") if ci else F.col("Exercise")
    lg = t.workout_log.filter(w30).groupBy("M_ID").agg(
        F.count(F.when(w30, F.lit(1))).alias("_n"),
        F.round(avg_exact(F.when(w30, F.col("CaloriesBurnt")), 2), 2).alias("_cal"),
        F.countDistinct(F.when(w30, exercise)).alias("_var"))
    key = order_key("Date", "Metric_ID")
    hm = t.health_metrics.groupBy("M_ID").agg(F.max_by("SleepHours", key).alias("_sleep"),
                                              F.max_by("Steps", key).alias("_steps"))
    f = t.member.select("M_ID").join(lg, "M_ID", "left").join(hm, "M_ID", "left")
    n = F.coalesce("_n", F.lit(0))
    var = F.coalesce("_var", F.lit(0))
    conds = [n < 3, F.col("_steps") < 5000, F.col("_sleep") < 6, var < 2,
             F.col("_cal") < 200]
    rule = None
    for c, (typ, msg, ex, mins) in zip(conds, PRIORITY_RULES):
        val = F.struct(F.lit(typ).alias("t"), F.lit(msg).alias("m"), F.lit(ex).alias("e"),
                       F.lit(mins).alias("d"))
        rule = F.when(c, val) if rule is None else rule.when(c, val)
    typ, msg, ex, mins = PRIORITY_RULES[-1]
    rule = rule.otherwise(F.struct(F.lit(typ).alias("t"), F.lit(msg).alias("m"),
                                   F.lit(ex).alias("e"), F.lit(mins).alias("d")))
    return f.select("M_ID", rule.alias("_r")).select(
        "M_ID", F.col("_r.t").alias("RecommendationType"), F.col("_r.m").alias("Message"),
        F.col("_r.e").alias("RecommendedExercise"), F.col("_r.d").alias("RecommendedDuration"))


def _trainer_perf(t: Tables, as_of: dt.date, weights: DataFrame) -> DataFrame:
    w = F.col("w")
    per_t = weights.groupBy("T_ID").agg(
        F.count("S_ID").alias("TotalSessions"),
        F.sum(F.when(F.col("Status") == "completed", w).otherwise(0)).alias("CompletedSessions"),
        F.sum(F.when(F.col("Status") == "scheduled", w).otherwise(0)).alias("UpcomingSessions"),
        _weighted_avg_exact("Duration", "w").alias("AvgSessionDuration"),
        F.sum(F.when(F.col("SessionDate") >= lit_date(as_of), w).otherwise(0))
        .alias("SessionsThisWeek"))
    z = F.lit(0)
    return (t.trainer.select("T_ID", "Name", "Specialization")
            .join(per_t, "T_ID", "left").join(_trainer_clients(t), "T_ID", "left")
            .select("T_ID", "Name", "Specialization",
                    F.coalesce("TotalSessions", z).alias("TotalSessions"),
                    F.coalesce("CompletedSessions", z).cast("long").alias("CompletedSessions"),
                    F.coalesce("UpcomingSessions", z).cast("long").alias("UpcomingSessions"),
                    "AvgSessionDuration",
                    F.coalesce("UniqueClients", z).alias("UniqueClients"),
                    F.coalesce("SessionsThisWeek", z).cast("long").alias("SessionsThisWeek")))


def trainer_performance(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Faithful: status sums and the average are inflated by the log fan-out
    ([T3]); "this week" has no upper bound ([T12])."""
    return _trainer_perf(t, as_of, _session_fanout(t))


def trainer_performance_exact(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Each session counted once."""
    return _trainer_perf(t, as_of, t.session.withColumn("w", F.lit(1).cast("long")))


def _gym_parts(t: Tables, as_of: dt.date):
    mt = t.membership_type.select("Type_ID", "Price")
    mem = (t.member.select("M_ID", "IsActive", "MembershipType_ID", "Gym_ID")
           .join(mt, F.col("MembershipType_ID") == F.col("Type_ID"), "left")
           .groupBy("Gym_ID").agg(
               F.count("M_ID").alias("TotalMembers"),
               F.count(F.when(F.col("IsActive") == F.lit(True), F.lit(1))).alias("_active"),
               F.sum("Price").alias("_rev"),
               avg_exact("Price", 2).alias("AvgMembershipPrice")))
    tr = t.trainer.groupBy("Gym_ID").agg(F.count("T_ID").alias("TotalTrainers"))
    up = (t.session.filter(F.col("SessionDate") >= lit_date(as_of)).select("T_ID")
          .join(t.trainer.select("T_ID", "Gym_ID"), "T_ID")
          .groupBy("Gym_ID").agg(F.count(F.lit(1)).alias("UpcomingSessions")))
    return (t.gym.select("Gym_ID", "Location", "Capacity")
            .join(mem, "Gym_ID", "left").join(tr, "Gym_ID", "left").join(up, "Gym_ID", "left"))


def _gym_select(g: DataFrame, mult: Column) -> DataFrame:
    z = F.lit(0)
    return g.select("Gym_ID", "Location", "Capacity",
                    F.coalesce("TotalMembers", z).alias("TotalMembers"),
                    (F.coalesce("_active", z) * mult).alias("ActiveMembers"),
                    F.coalesce("TotalTrainers", z).alias("TotalTrainers"),
                    F.coalesce("UpcomingSessions", z).alias("UpcomingSessions"),
                    (F.col("_rev") * mult).cast("decimal(38,2)").alias("TotalRevenue"),
                    "AvgMembershipPrice")


def gym_statistics(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Faithful: Gym ⟕ Member ⟕ Trainer ⟕ Type multiplies active counts and
    revenue by the trainer count ([T3]); computed from per-gym aggregates."""
    g = _gym_parts(t, as_of)
    return _gym_select(g, F.greatest(F.coalesce("TotalTrainers", F.lit(0)), F.lit(1)))


def gym_statistics_exact(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    return _gym_select(_gym_parts(t, as_of), F.lit(1))


def expiring_memberships(t: Tables, as_of: dt.date = DEFAULT_AS_OF, days: int = 7,
                         ordered: bool = True) -> DataFrame:
    mt = t.membership_type.select("Type_ID", F.col("Name").alias("MembershipType"),
                                  "Duration", F.col("Price").alias("RenewalPrice"))
    exp = F.add_months(F.col("JoinDate"), F.col("Duration"))
    out = (t.member.filter(F.col("IsActive") == F.lit(True))
           .join(mt, F.col("MembershipType_ID") == F.col("Type_ID"))
           .withColumn("ExpiryDate", exp)
           .withColumn("DaysUntilExpiry", F.datediff("ExpiryDate", lit_date(as_of)))
           .filter(F.col("DaysUntilExpiry").between(0, days))
           .select("M_ID", "Name", "Email", "Phone", "MembershipType", "JoinDate", "ExpiryDate",
                   "DaysUntilExpiry", "RenewalPrice"))
    return out.orderBy("DaysUntilExpiry") if ordered else out


def deactivate_expired(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """New Member version: active members whose type-based expiry is past
    become inactive (members without a type are untouched)."""
    mt = t.membership_type.select("Type_ID", F.col("Duration").alias("_months"))
    m = t.member.join(mt, F.col("MembershipType_ID") == F.col("Type_ID"), "left")
    expired = (F.col("IsActive") == F.lit(True)) & F.col("_months").isNotNull() & \
        (F.add_months(F.col("JoinDate"), F.col("_months")) < lit_date(as_of))
    return m.select(*[F.when(expired, F.lit(False)).otherwise(F.col(c)).alias(c)
                      if c == "IsActive" else F.col(c) for c in t.member.columns])


def deactivate_expired_result(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """The procedure's result line, from a global count (one row)."""
    mt = t.membership_type.select("Type_ID", F.col("Duration").alias("_months"))
    n = (t.member.filter(F.col("IsActive") == F.lit(True))
         .join(mt, F.col("MembershipType_ID") == F.col("Type_ID"))
         .agg(F.count(F.when(F.add_months(F.col("JoinDate"), F.col("_months")) < lit_date(as_of),
                             F.lit(1))).alias("n")))
    return n.select(F.concat(F.lit("Deactivated "), F.col("n").cast("string"),
                             F.lit(" expired memberships")).alias("Result"))


def trainer_report(t: Tables, ordered: bool = True) -> DataFrame:
    """Per trainer: sessions and clients from separate aggregates (no
    fan-out), average duration (0 default) and a rating."""
    ps = t.session.groupBy("T_ID").agg(F.count("S_ID").alias("_s"),
                                       avg_exact("Duration").alias("_avg"))
    out = (t.trainer.select("T_ID", "Name", "Specialization")
           .join(ps, "T_ID", "left").join(_trainer_clients(t), "T_ID", "left"))
    s, c = F.coalesce("_s", F.lit(0)), F.coalesce("UniqueClients", F.lit(0))
    rating = None
    for ms, mc, label in TRAINER_RATINGS:
        cond = (s >= ms) & (c >= mc) if mc else (s >= ms)
        rating = F.when(cond, label) if rating is None else rating.when(cond, label)
    rating = rating.otherwise(TRAINER_RATING_ELSE)
    out = out.select(F.col("T_ID").alias("Trainer_ID"), F.col("Name").alias("Trainer_Name"),
                     "Specialization", s.cast("int").alias("Total_Sessions"),
                     c.cast("int").alias("Unique_Clients"),
                     F.coalesce(F.round("_avg", 2), F.lit(0)).cast("decimal(18,2)")
                     .alias("Avg_Session_Duration"),
                     rating.alias("Performance_Rating"))
    return out.orderBy(F.col("Total_Sessions").desc(), F.col("Unique_Clients").desc()) \
        if ordered else out


def engagement_report(t: Tables, as_of: dt.date = DEFAULT_AS_OF, ordered: bool = True,
                      score: DataFrame | None = None) -> DataFrame:
    """Active members with a type: 30-day workouts (bookings excluded),
    engagement score (pluggable: a frame of M_ID, score; default 30-day
    consistency), last activity and level."""
    d = F.col("Date")
    w30 = d >= days_before(as_of, 30)
    lg = t.workout_log.groupBy("M_ID").agg(
        F.count(F.when(w30 & not_booking(), F.lit(1))).alias("_n"),
        F.countDistinct(F.when(w30, d)).alias("_days"),
        F.max(d).alias("Last_Activity"))
    mt = t.membership_type.select("Type_ID", F.col("Name").alias("Membership_Type"))
    base = (t.member.filter(F.col("IsActive") == F.lit(True))
            .join(mt, F.col("MembershipType_ID") == F.col("Type_ID"))
            .join(lg, "M_ID", "left"))
    if score is None:
        sc = half_up_ratio(F.coalesce("_days", F.lit(0)) * 100, F.lit(30), 2)
    else:
        base = base.join(score.withColumnRenamed("score", "_score"), "M_ID", "left")
        sc = F.col("_score")
    # wide: the score has no upper bound (consistency counts future days, [T6])
    base = base.withColumn("_sc", F.coalesce(sc, F.lit(0)).cast("decimal(18,2)"))
    level = None
    for thr, label in ENGAGEMENT_LEVELS:
        level = F.when(F.col("_sc") >= thr, label) if level is None \
            else level.when(F.col("_sc") >= thr, label)
    out = base.select(F.col("M_ID").alias("Member_ID"), F.col("Name").alias("Member_Name"),
                      "Membership_Type",
                      F.coalesce("_n", F.lit(0)).cast("int").alias("Workouts_30Days"),
                      F.col("_sc").alias("Engagement_Score"), "Last_Activity",
                      level.otherwise(ENGAGEMENT_ELSE).alias("Engagement_Level"))
    return out.orderBy(F.col("Engagement_Score").desc()) if ordered else out


def engagement_summary(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    r = engagement_report(t, as_of, ordered=False)
    lv = F.col("Engagement_Level")
    return r.agg(
        F.count(F.lit(1)).alias("Total_Members"),
        F.avg("Engagement_Score").alias("Avg_Engagement"),
        F.count(F.when(lv == "Highly Engaged", 1)).alias("Highly_Engaged"),
        F.count(F.when(lv == "Moderately Engaged", 1)).alias("Moderately_Engaged"),
        F.count(F.when(lv == "Low Engagement", 1)).alias("Low_Engagement"),
        F.count(F.when(lv == "Inactive", 1)).alias("Inactive"))
