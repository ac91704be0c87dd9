"""Base queries of the reference's SQL script, in all-entity form."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlake.functions.exprs import (DEFAULT_AS_OF, avg_exact, email_key, half_up_ratio,
                                     is_booking, lit_date)
from fitlake.operators.common import booking_counts, log_rows_per_session, top_k
from fitlake.sources.tables import Tables


def member_directory(t: Tables, ordered: bool = True) -> DataFrame:
    """Members with membership type and gym (LEFT joins: members keep NULL
    dims), newest join date first."""
    mt = t.membership_type.select(F.col("Type_ID"), F.col("Name").alias("MembershipType"),
                                  "Price")
    g = t.gym.select("Gym_ID", F.col("Location").alias("GymLocation"))
    out = (t.member.select("M_ID", "Name", "Email", "Age", "JoinDate", "MembershipType_ID",
                           "Gym_ID")
           .join(mt, F.col("MembershipType_ID") == F.col("Type_ID"), "left")
           .join(g, "Gym_ID", "left")
           .select("M_ID", "Name", "Email", "Age", "JoinDate", "MembershipType", "Price",
                   "GymLocation"))
    return out.orderBy(F.col("JoinDate").desc()) if ordered else out


def member_by_email(t: Tables, email: str) -> DataFrame:
    """Point lookup on the unique e-mail (pushed into the Parquet scan)."""
    return t.member.filter(email_key("Email") == email_key(F.lit(email)))


def recent_workouts(t: Tables, k: int = 10) -> DataFrame:
    """Newest k log rows per member (Date desc, L_ID desc) with session
    details.  The top-k runs before the session join, so the join sees at
    most k rows per member."""
    top = top_k(t.workout_log, ["M_ID"], [F.col("Date").desc(), F.col("L_ID").desc()], k)
    s = t.session.select("S_ID", F.col("Details").alias("SessionDetails"), "SessionDate")
    return (top.join(s, "S_ID", "left")
            .select("M_ID", "L_ID", "Exercise", "Date", "Duration", "CaloriesBurnt", "Distance",
                    "Progress", "SessionDetails", "SessionDate"))


def _weighted_avg_exact(value: str, weight: str) -> F.Column:
    """AVG over a fanned-out join, computed from (value, weight) pairs:
    sum(v*w)/sum(w), half-up to 4 decimals like MySQL AVG(INT)."""
    num = F.sum(F.when(F.col(value).isNotNull(), F.col(value).cast("long") * F.col(weight)))
    den = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return F.when(den > 0, half_up_ratio(num, den, 4))


def _session_fanout(t: Tables) -> DataFrame:
    """Sessions with w = rows each contributes to `Session LEFT JOIN WorkoutLog`."""
    n = log_rows_per_session(t.workout_log)
    return (t.session.join(n, "S_ID", "left")
            .withColumn("w", F.coalesce(F.col("n_rows"), F.lit(1)).cast("long")))


def _trainer_clients(t: Tables) -> DataFrame:
    """Distinct (T_ID, M_ID) over Session JOIN WorkoutLog, de-duplicated per
    (S_ID, M_ID) first so a busy session never ships all its rows."""
    pairs = t.workout_log.filter(F.col("S_ID").isNotNull()).select("S_ID", "M_ID").distinct()
    return (pairs.join(t.session.select("S_ID", "T_ID"), "S_ID")
            .select("T_ID", "M_ID").distinct()
            .groupBy("T_ID").agg(F.count("M_ID").alias("UniqueClients")))


def trainer_rollup(t: Tables) -> DataFrame:
    """Per trainer over Trainer ⟕ Session ⟕ WorkoutLog (faithful: the average
    is weighted by log rows, [T3]); computed from per-session weights."""
    sf = _session_fanout(t)
    per_t = sf.groupBy("T_ID").agg(
        F.count("S_ID").alias("TotalSessions"),
        _weighted_avg_exact("Duration", "w").alias("AvgSessionDuration"))
    return (t.trainer.select("T_ID", "Name", "Specialization")
            .join(per_t, "T_ID", "left").join(_trainer_clients(t), "T_ID", "left")
            .select("T_ID", "Name", "Specialization",
                    F.coalesce("TotalSessions", F.lit(0)).alias("TotalSessions"),
                    "AvgSessionDuration",
                    F.coalesce("UniqueClients", F.lit(0)).alias("UniqueClients")))


def trainer_rollup_exact(t: Tables) -> DataFrame:
    """Same measures without join fan-out: average over sessions."""
    per_t = t.session.groupBy("T_ID").agg(
        F.count("S_ID").alias("TotalSessions"),
        avg_exact("Duration").alias("AvgSessionDuration"))
    return (t.trainer.select("T_ID", "Name", "Specialization")
            .join(per_t, "T_ID", "left").join(_trainer_clients(t), "T_ID", "left")
            .select("T_ID", "Name", "Specialization",
                    F.coalesce("TotalSessions", F.lit(0)).alias("TotalSessions"),
                    "AvgSessionDuration",
                    F.coalesce("UniqueClients", F.lit(0)).alias("UniqueClients")))


def _member_sides(t: Tables):
    lg = t.workout_log.groupBy("M_ID").agg(
        F.count("L_ID").alias("n_log"),
        avg_exact("Duration").alias("avg_dur"),
        F.sum("CaloriesBurnt").alias("sum_cal"))
    hm = t.health_metrics.groupBy("M_ID").agg(
        F.count(F.lit(1)).alias("n_hm"),
        F.max("Weight").alias("max_w"), F.min("Weight").alias("min_w"),
        avg_exact("SleepHours").alias("avg_sleep"))
    return lg, hm


def member_progress_rollup(t: Tables) -> DataFrame:
    """Member ⟕ WorkoutLog ⟕ HealthMetrics rollup, faithful to the fan-out
    ([T3]: counts and sums multiplied by the other side's row count; MAX
    weight labelled current, MIN starting, [T4]).  Both sides are
    pre-aggregated per member and combined arithmetically, which gives the
    fanned-out numbers without materialising the product."""
    lg, hm = _member_sides(t)
    m = t.member.select("M_ID", "Name").join(lg, "M_ID", "left").join(hm, "M_ID", "left")
    mult_log = F.greatest(F.coalesce("n_hm", F.lit(0)), F.lit(1))
    return m.select(
        "M_ID", "Name",
        (F.coalesce("n_log", F.lit(0)) * mult_log).alias("TotalWorkouts"),
        F.col("avg_dur").alias("AvgWorkoutDuration"),
        (F.col("sum_cal") * mult_log).cast("decimal(38,2)").alias("TotalCaloriesBurned"),
        F.col("max_w").alias("CurrentWeight"), F.col("min_w").alias("StartingWeight"),
        F.col("avg_sleep").alias("AvgSleepHours"))


def member_progress_rollup_exact(t: Tables) -> DataFrame:
    """Same rollup with each side aggregated on its own (no fan-out)."""
    lg, hm = _member_sides(t)
    m = t.member.select("M_ID", "Name").join(lg, "M_ID", "left").join(hm, "M_ID", "left")
    return m.select(
        "M_ID", "Name", F.coalesce("n_log", F.lit(0)).alias("TotalWorkouts"),
        F.col("avg_dur").alias("AvgWorkoutDuration"),
        F.col("sum_cal").cast("decimal(38,2)").alias("TotalCaloriesBurned"),
        F.col("max_w").alias("CurrentWeight"), F.col("min_w").alias("StartingWeight"),
        F.col("avg_sleep").alias("AvgSleepHours"))


def available_sessions(t: Tables, as_of: dt.date = DEFAULT_AS_OF, ordered: bool = True) -> DataFrame:
    """Upcoming scheduled sessions with free spots (booking filter applied
    before the LEFT join, as in the reference's ON clause)."""
    s = t.session.filter((F.col("SessionDate") >= lit_date(as_of))
                         & (F.col("Status") == "scheduled"))
    tr = t.trainer.select("T_ID", F.col("Name").alias("TrainerName"), "Specialization")
    out = (s.join(tr, "T_ID").join(booking_counts(t.workout_log), "S_ID", "left")
           .withColumn("CurrentParticipants", F.coalesce("n_bookings", F.lit(0)))
           .withColumn("AvailableSpots", F.col("MaxParticipants") - F.col("CurrentParticipants"))
           .filter(F.col("AvailableSpots") > 0)
           .select("S_ID", "Details", "SessionDate", "SessionTime", "Duration", "TrainerName",
                   "Specialization", "CurrentParticipants", "MaxParticipants", "AvailableSpots"))
    return out.orderBy("SessionDate", "SessionTime") if ordered else out


def available_sessions_any_status(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Booking endpoint's list: any status, bookings < capacity; the count
    is computed once (the reference evaluates its subquery twice)."""
    s = t.session.filter(F.col("SessionDate") >= lit_date(as_of))
    tr = t.trainer.select("T_ID", F.col("Name").alias("TrainerName"), "Specialization")
    return (s.join(tr, "T_ID").join(booking_counts(t.workout_log), "S_ID", "left")
            .withColumn("participantCount", F.coalesce("n_bookings", F.lit(0)))
            .filter(F.col("participantCount") < F.col("MaxParticipants"))
            .select("S_ID", "Details", "SessionDate", "SessionTime", "Duration", "T_ID",
                    "MaxParticipants", "Status", "TrainerName", "Specialization",
                    "participantCount"))


def upcoming_bookings(t: Tables, as_of: dt.date = DEFAULT_AS_OF, k: int | None = None) -> DataFrame:
    """Each member's bookings of sessions dated on/after as_of, with trainer;
    with k, the k soonest per member (date, time, then booking id)."""
    b = t.workout_log.filter(is_booking()).select("M_ID", "S_ID", F.col("L_ID").alias("BookingID"))
    s = t.session.filter(F.col("SessionDate") >= lit_date(as_of)) \
        .select("S_ID", "Details", "SessionDate", "SessionTime", "T_ID")
    tr = t.trainer.select("T_ID", F.col("Name").alias("TrainerName"))
    out = (b.join(s, "S_ID").join(tr, "T_ID")
           .select("M_ID", "S_ID", "Details", "SessionDate", "SessionTime", "TrainerName",
                   "BookingID"))
    if k is not None:
        out = top_k(out, ["M_ID"], [F.col("SessionDate"), F.col("SessionTime"),
                                    F.col("BookingID")], k)
    return out
