"""Nested dashboard documents and the JSON sink.

Only bounded lists are nested (newest 5 workouts, next 5 bookings); lists
that grow with the data (a trainer's sessions and clients, the admin's
member list) stay flat frames keyed by their owner, so no task ever holds
an unbounded group."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlake.functions.exprs import DEFAULT_AS_OF
from fitlake.operators import app as A
from fitlake.operators.base_queries import member_directory, recent_workouts, upcoming_bookings
from fitlake.sources.tables import Tables


def member_dashboard(t: Tables, as_of: dt.date = DEFAULT_AS_OF, k: int = 5) -> DataFrame:
    """One row per member: member, todayStats, healthMetrics, recentWorkouts
    (k newest), upcomingSessions (k soonest)."""
    info = member_directory(t, ordered=False).select(
        "M_ID", F.struct("M_ID", "Name", "Email", "Age", "JoinDate", "MembershipType",
                         "GymLocation").alias("member"))
    stats = A.today_stats(t, as_of).select(
        "M_ID", F.struct("TodayCalories", "TodayDistance", "TodayWorkouts").alias("todayStats"))
    health = A.today_health(t, as_of).select(
        "M_ID", F.struct("Weight", "Height", "SleepHours", "WaterLiters", "Steps")
        .alias("healthMetrics"))
    rw = (recent_workouts(t, k).groupBy("M_ID").agg(F.sort_array(F.collect_list(F.struct(
        "Date", "L_ID", "Exercise", "Duration", "CaloriesBurnt", "SessionDetails")), asc=False)
        .alias("recentWorkouts")))
    up = (upcoming_bookings(t, as_of, k).groupBy("M_ID").agg(F.sort_array(F.collect_list(F.struct(
        "SessionDate", "SessionTime", "BookingID", "S_ID", "Details", "TrainerName")))
        .alias("upcomingSessions")))
    empty = F.array()
    return (info.join(stats, "M_ID", "left").join(health, "M_ID", "left")
            .join(rw, "M_ID", "left").join(up, "M_ID", "left")
            .select("M_ID", "member", "todayStats", "healthMetrics",
                    F.coalesce("recentWorkouts", empty.cast(rw.schema["recentWorkouts"].dataType))
                    .alias("recentWorkouts"),
                    F.coalesce("upcomingSessions", empty.cast(up.schema["upcomingSessions"].dataType))
                    .alias("upcomingSessions")))


def trainer_dashboard(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """One row per trainer: trainer and stats; sessions and clients are the
    flat frames `trainer_sessions` / `trainer_clients` keyed by T_ID."""
    stats = A.trainer_clients_today(t, as_of)
    return (t.trainer.select("T_ID", "Name", "Email", "Specialization").join(stats, "T_ID", "left")
            .select("T_ID", F.struct("T_ID", "Name", "Email", "Specialization").alias("trainer"),
                    F.struct("totalClients", "sessionsToday").alias("stats")))


def admin_dashboard(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> dict[str, DataFrame]:
    """stats (one row), members and trainers as separate frames."""
    members = member_directory(t, ordered=False).select(
        "M_ID", "Name", "Email", "JoinDate", "MembershipType", "GymLocation")
    return {"stats": A.admin_totals(t, as_of), "members": members,
            "trainers": A.admin_trainers(t)}


def dashboard_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json) rows: each dashboard row serialised by Spark's to_json."""
    return df.select(F.col(key), F.to_json(F.struct(*[c for c in df.columns if c != key]))
                     .alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines sink (distributed write; one file per partition)."""
    df.write.mode(mode).json(path)
