"""Per-entity metric frames (the reference's scalar functions, computed for
every member / session / trainer / gym in one aggregate pass each)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlake.functions.exprs import (DEFAULT_AS_OF, age_group, avg_exact, days_before,
                                     duration_hhmm, half_up_ratio, lit_date, not_booking,
                                     order_key)
from fitlake.operators.common import booking_counts
from fitlake.sources.tables import Tables


def with_expiry(t: Tables, members: DataFrame, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Adds ExpiryDate / DaysUntilExpiry (NULL when the member has no type)
    by a LEFT join to the small type dimension: the member side is scanned
    once and never shuffled for it."""
    mt = t.membership_type.select(F.col("Type_ID").alias("_tid"), F.col("Duration").alias("_months"))
    exp = F.add_months(F.col("JoinDate"), F.col("_months"))
    return (members.join(mt, F.col("MembershipType_ID") == F.col("_tid"), "left")
            .withColumn("ExpiryDate", exp)
            .withColumn("DaysUntilExpiry", F.datediff(exp, lit_date(as_of)))
            .drop("_tid", "_months"))


def expiry_frame(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """M_ID, ExpiryDate, DaysUntilExpiry for every member."""
    return with_expiry(t, t.member.select("M_ID", "JoinDate", "MembershipType_ID"), as_of) \
        .select("M_ID", "ExpiryDate", "DaysUntilExpiry")


def membership_expiry(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    m = t.member.select("M_ID", "Name", "JoinDate", "MembershipType_ID")
    return with_expiry(t, m, as_of).select("M_ID", "Name", "DaysUntilExpiry")


def bmi_frame(t: Tables) -> DataFrame:
    """BMI from each member's latest metric row (Date, then Metric_ID):
    weight / (height/100)^2 to 2 decimals; 0 when either is missing."""
    key = order_key("Date", "Metric_ID")
    latest = t.health_metrics.groupBy("M_ID").agg(
        F.max_by("Weight", key).alias("_w"), F.max_by("Height", key).alias("_h"))
    # Exact: weight/(height/100)^2 = W * 10^6 / H^2 with W, H in hundredths,
    # rounded half-up (away from zero) to 2 decimals in integer arithmetic, so
    # ties round the same in every engine.
    w_units = (F.col("_w") * 100).cast("long")
    h_units = (F.col("_h") * 100).cast("long")
    mag = half_up_ratio(F.abs(w_units) * 1000000, h_units * h_units, 2)
    value = F.when(w_units < 0, -mag).otherwise(mag)
    ok = F.col("_w").isNotNull() & F.col("_h").isNotNull() & (F.col("_h") > 0)
    return latest.select("M_ID", F.when(ok, value).otherwise(F.lit(0)).cast("decimal(18,2)").alias("BMI"))


def member_bmi(t: Tables) -> DataFrame:
    return (t.member.select("M_ID", "Name").join(bmi_frame(t), "M_ID", "left")
            .select("M_ID", "Name", F.coalesce("BMI", F.lit(0).cast("decimal(18,2)")).alias("BMI")))


def log_metrics_frame(t: Tables, as_of: dt.date = DEFAULT_AS_OF, calorie_days: int = 30,
                      consistency_days: int = 30, duration_days: int = 30) -> DataFrame:
    """Calories, consistency and average duration per member in ONE pass over
    the log (conditional aggregates; partial aggregation map-side)."""
    d = F.col("Date")
    in_cal = (d >= days_before(as_of, calorie_days)) & F.col("CaloriesBurnt").isNotNull()
    in_con = d >= days_before(as_of, consistency_days)
    in_dur = (d >= days_before(as_of, duration_days)) & F.col("Duration").isNotNull() & not_booking()
    widest = days_before(as_of, max(calorie_days, consistency_days, duration_days))
    agg = t.workout_log.filter(d >= widest).groupBy("M_ID").agg(
        F.sum(F.when(in_cal, F.col("CaloriesBurnt"))).alias("_cal"),
        F.countDistinct(F.when(in_con, d)).alias("_days"),
        avg_exact(F.when(in_dur, F.col("Duration"))).alias("_dur"))
    pct = (half_up_ratio(F.col("_days") * 100, F.lit(consistency_days), 2)
           if consistency_days > 0 else F.lit(0).cast("decimal(18,2)"))
    return agg.select(
        "M_ID",
        F.coalesce("_cal", F.lit(0)).cast("decimal(38,2)").alias("CaloriesLast30Days"),
        pct.alias("ConsistencyPercent"),
        F.coalesce(F.round("_dur", 2), F.lit(0)).cast("decimal(18,2)").alias("AvgWorkoutDuration"))


def _zero2():
    return F.lit(0).cast("decimal(38,2)")


def _per_member(t: Tables, frame: DataFrame, col: str, default) -> DataFrame:
    return (t.member.select("M_ID", "Name").join(frame.select("M_ID", col), "M_ID", "left")
            .select("M_ID", "Name", F.coalesce(F.col(col), default).alias(col)))


def calories_burned(t: Tables, as_of: dt.date = DEFAULT_AS_OF, days: int = 30) -> DataFrame:
    f = log_metrics_frame(t, as_of, calorie_days=days)
    return _per_member(t, f, "CaloriesLast30Days", _zero2())


def workout_consistency(t: Tables, as_of: dt.date = DEFAULT_AS_OF, days: int = 30) -> DataFrame:
    f = log_metrics_frame(t, as_of, consistency_days=days)
    return _per_member(t, f, "ConsistencyPercent", F.lit(0).cast("decimal(18,2)"))


def avg_workout_duration(t: Tables, as_of: dt.date = DEFAULT_AS_OF, days: int = 30) -> DataFrame:
    f = log_metrics_frame(t, as_of, duration_days=days)
    return _per_member(t, f, "AvgWorkoutDuration", F.lit(0).cast("decimal(6,2)"))


def session_available(t: Tables) -> DataFrame:
    """Bookings < MaxParticipants per session; NULL capacity means not available."""
    return (t.session.join(booking_counts(t.workout_log), "S_ID", "left")
            .select("S_ID", "Details", "SessionDate",
                    F.coalesce(F.coalesce("n_bookings", F.lit(0)) < F.col("MaxParticipants"),
                               F.lit(False)).alias("IsAvailable"),
                    "MaxParticipants"))


def trainer_active_sessions(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    act = (t.session.filter((F.col("SessionDate") >= lit_date(as_of))
                            & (F.col("Status") == "scheduled"))
           .groupBy("T_ID").agg(F.count(F.lit(1)).alias("_n")))
    return (t.trainer.select("T_ID", "Name", "Specialization").join(act, "T_ID", "left")
            .select("T_ID", "Name", "Specialization",
                    F.coalesce("_n", F.lit(0)).cast("int").alias("ActiveSessions")))


def health_metrics_frame(t: Tables, as_of: dt.date = DEFAULT_AS_OF, weight_days: int = 30,
                         step_days: int = 7) -> DataFrame:
    """Weight change (an as-of lookup: latest weight vs latest weight dated
    on/before as_of - days) and average steps, one pass over the metrics."""
    order = order_key("Date", "Metric_ID")
    past = F.col("Date") <= days_before(as_of, weight_days)
    steps_in = (F.col("Date") >= days_before(as_of, step_days)) & F.col("Steps").isNotNull()
    agg = t.health_metrics.groupBy("M_ID").agg(
        F.max_by("Weight", order).alias("_cur"),
        F.max_by("Weight", F.when(past, order)).alias("_past"),
        avg_exact(F.when(steps_in, F.col("Steps"))).alias("_steps"))
    change = F.when(F.col("_cur").isNotNull() & F.col("_past").isNotNull(),
                    F.col("_cur") - F.col("_past")).otherwise(F.lit(0))
    return agg.select("M_ID", change.cast("decimal(6,2)").alias("WeightChange30Days"),
                      F.coalesce(F.round("_steps", 0), F.lit(0)).cast("int")
                      .alias("AvgStepsLastWeek"))


def weight_change(t: Tables, as_of: dt.date = DEFAULT_AS_OF, days: int = 30) -> DataFrame:
    return _per_member(t, health_metrics_frame(t, as_of, weight_days=days), "WeightChange30Days",
                       F.lit(0).cast("decimal(6,2)"))


def avg_daily_steps(t: Tables, as_of: dt.date = DEFAULT_AS_OF, days: int = 7) -> DataFrame:
    return _per_member(t, health_metrics_frame(t, as_of, step_days=days), "AvgStepsLastWeek",
                       F.lit(0))


def gym_revenue(t: Tables) -> DataFrame:
    """Sum of type price over ACTIVE members per gym, 0 when none."""
    rev = (t.member.filter(F.col("IsActive") == F.lit(True))
           .join(t.membership_type.select("Type_ID", "Price"),
                 F.col("MembershipType_ID") == F.col("Type_ID"))
           .groupBy("Gym_ID").agg(F.sum("Price").alias("_rev")))
    return (t.gym.select("Gym_ID", "Location").join(rev, "Gym_ID", "left")
            .select("Gym_ID", "Location",
                    F.coalesce("_rev", F.lit(0)).cast("decimal(38,2)").alias("EstimatedRevenue")))


def member_age_groups(t: Tables) -> DataFrame:
    return t.member.select("M_ID", "Name", "Age", age_group("Age").alias("AgeGroup"))


def workout_durations_hhmm(t: Tables) -> DataFrame:
    return t.workout_log.select("L_ID", "Duration", duration_hhmm("Duration").alias("FormattedTime"))


# ---- panels: several metrics per entity, one pass per fact table ----------

def member_metrics_panel(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    lm = log_metrics_frame(t, as_of)
    m = with_expiry(t, t.member.select("M_ID", "Name", "JoinDate", "MembershipType_ID"), as_of)
    return (m.join(bmi_frame(t), "M_ID", "left")
            .join(lm, "M_ID", "left")
            .select("M_ID", "Name", "DaysUntilExpiry",
                    F.coalesce("BMI", F.lit(0).cast("decimal(18,2)")).alias("BMI"),
                    F.coalesce("CaloriesLast30Days", _zero2()).alias("CaloriesLast30Days"),
                    F.coalesce("ConsistencyPercent", F.lit(0).cast("decimal(18,2)"))
                    .alias("ConsistencyPercent"),
                    F.coalesce("AvgWorkoutDuration", F.lit(0).cast("decimal(6,2)"))
                    .alias("AvgWorkoutDuration")))


def member_health_panel(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    hf = health_metrics_frame(t, as_of)
    return (t.member.select("M_ID", "Name", "Age").join(hf, "M_ID", "left")
            .select("M_ID", "Name",
                    F.coalesce("WeightChange30Days", F.lit(0).cast("decimal(6,2)"))
                    .alias("WeightChange30Days"),
                    F.coalesce("AvgStepsLastWeek", F.lit(0)).alias("AvgStepsLastWeek"),
                    age_group("Age").alias("AgeGroup")))


def session_availability_panel(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    return session_available(t).filter(F.col("SessionDate") >= lit_date(as_of))


def trainer_activity_panel(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    return trainer_active_sessions(t, as_of)


def gym_revenue_panel(t: Tables) -> DataFrame:
    return gym_revenue(t)
