"""Row rules (the reference's triggers) as batch validation operators, and
the declared constraints (unique, foreign key, domain) as audits."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.functions.exprs import DEFAULT_AS_OF, email_key, is_booking, lit_date
from fitlake.operators.common import booking_counts, scalar_int, top_k
from fitlake.sources import schema as SC
from fitlake.sources.tables import Tables

# ---- fixed values that must equal the reference's ---------------------------
MSG_WEIGHT = "Weight must be between 20 and 300 kg"
MSG_HEIGHT = "Height must be between 100 and 250 cm"
MSG_SLEEP = "Sleep hours must be between 0 and 24"
MSG_WATER = "Water intake must be between 0 and 10 liters"
MSG_STEPS = "Steps must be between 0 and 100,000"
MSG_DURATION = "Workout duration must be between 5 and 300 minutes"
MSG_CALORIES = "Calories burnt must be between 0 and 2000"
MSG_DISTANCE = "Distance must be between 0 and 50 km"
MSG_FUTURE = "Workout date cannot be in the future"
MSG_FULL = "Session is already full. Cannot book this session."
MSG_PAST_SESSION = "Cannot book sessions that have already passed"
MSG_AGE = "Member age must be between 10 and 100 years"


def _out_of(c: str, lo, hi) -> Column:
    """`c IS NOT NULL AND (c < lo OR c > hi)`; NULL passes."""
    return F.col(c).isNotNull() & ((F.col(c) < lo) | (F.col(c) > hi))


def first_violation(*rules: tuple[Column, str]) -> Column:
    """Message of the first failing rule (rule order = trigger order), else NULL."""
    out = None
    for cond, msg in rules:
        out = F.when(cond, F.lit(msg)) if out is None else out.when(cond, F.lit(msg))
    return out


def health_metric_violation() -> Column:
    return first_violation((_out_of("Weight", 20, 300), MSG_WEIGHT),
                           (_out_of("Height", 100, 250), MSG_HEIGHT),
                           (_out_of("SleepHours", 0, 24), MSG_SLEEP),
                           (_out_of("WaterLiters", 0, 10), MSG_WATER),
                           (_out_of("Steps", 0, 100000), MSG_STEPS))


def validate_health_metrics(df: DataFrame) -> DataFrame:
    """Input rows + `violation` (NULL = valid)."""
    return df.withColumn("violation", health_metric_violation())


def workout_range_rules(as_of: dt.date, exempt_bookings: bool = False):
    future = F.col("Date") > lit_date(as_of)
    if exempt_bookings:
        future = future & ~F.coalesce(is_booking(), F.lit(False))
    return [(_out_of("Duration", 5, 300), MSG_DURATION),
            (_out_of("CaloriesBurnt", 0, 2000), MSG_CALORIES),
            (_out_of("Distance", 0, 50), MSG_DISTANCE),
            (future, MSG_FUTURE)]


def validate_workouts(df: DataFrame, as_of: dt.date = DEFAULT_AS_OF,
                      exempt_bookings: bool = False) -> DataFrame:
    """Duration / calories / distance ranges and the no-future-date rule.
    Faithful default: future-dated bookings fail too ([T11])."""
    return df.withColumn("violation", first_violation(*workout_range_rules(as_of, exempt_bookings)))


def _is_session_booking() -> Column:
    return F.col("S_ID").isNotNull() & F.coalesce(is_booking(), F.lit(False))


def _booking_with_session(log: DataFrame, session: DataFrame) -> DataFrame:
    s = session.select("S_ID", F.col("SessionDate").alias("_sdate"),
                       F.col("MaxParticipants").alias("_max"))
    return log.join(s, "S_ID", "left")


def validate_booking_date(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Booking rows for sessions dated before as_of are rejected."""
    bk = _is_session_booking()
    j = _booking_with_session(t.workout_log.filter(bk), t.session).select(
        *t.workout_log.columns,
        F.when(F.col("_sdate") < lit_date(as_of), F.lit(MSG_PAST_SESSION)).alias("violation"))
    return j.unionByName(t.workout_log.filter(~bk).withColumn("violation", F.lit(None).cast("string")))


def validate_member_age(df: DataFrame) -> DataFrame:
    return df.withColumn("violation", F.when((F.col("Age") < 10) | (F.col("Age") > 100),
                                             F.lit(MSG_AGE)))


def _judged(session: DataFrame, log: DataFrame, taken: DataFrame | None, as_of: dt.date) -> DataFrame:
    """`log` with its violations; `taken` (S_ID, n): seats taken before it."""
    bk = _is_session_booking()
    session = session.select("S_ID", "SessionDate", F.col("MaxParticipants").cast("long").alias("MaxParticipants"))
    if taken is not None:
        session = session.join(taken, "S_ID", "left").withColumn(
            "MaxParticipants", F.col("MaxParticipants") - F.coalesce("n", F.lit(0))).drop("n")
    ranges = workout_range_rules(as_of)
    past = F.col("_sdate") < lit_date(as_of)
    any_range = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c, _ in ranges])
    k = max(scalar_int(session, F.max("MaxParticipants")), 1)
    # The sessions with their cut-off: the L_ID of the last booking that finds
    # a seat, or "before everything" when there is none.  Bookings that pass
    # the other rules are ranked; of a session's rows only the first k travel.
    dates = session.select("S_ID", F.col("SessionDate").alias("_sdate"), F.col("MaxParticipants").alias("_max"))
    in_range = log.filter(bk & ~any_range).select("S_ID", "L_ID")
    ranked = top_k(in_range, ["S_ID"], [F.col("L_ID")], k, rank_col="_rn")
    cut = (dates.join(ranked, "S_ID", "left").groupBy("S_ID", "_sdate", "_max")
           .agg(F.max(F.when(F.col("_rn") == F.col("_max"), F.col("L_ID"))).alias("_cut"))
           # bookings of past sessions never take a seat
           .withColumn("_cut", F.when(F.col("_max") <= 0, F.lit(-(2 ** 63)).cast("long"))
                       .when(~F.coalesce(past, F.lit(False)), F.col("_cut"))))
    full = F.col("_cut").isNotNull() & (F.col("L_ID") > F.col("_cut"))
    v = first_violation((full, MSG_FULL), *ranges, (past, MSG_PAST_SESSION))
    booked = log.filter(bk).join(cut, "S_ID", "left").select(*log.columns, v.alias("violation"))
    return booked.unionByName(log.filter(~bk).withColumn("violation", first_violation(*ranges)))


def validate_log_rows(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """All BEFORE INSERT rules on WorkoutLog in trigger order (capacity,
    ranges, past session), treating the log as its insertion sequence in
    L_ID order.  A booking fails capacity once `MaxParticipants` earlier
    bookings of its session were accepted; rejected rows do not consume
    capacity.  The cut-off is the L_ID of the max-th accepted booking per
    session, found with a top-K bounded by the largest capacity (a scalar) and
    joined to the sessions, so the log meets them once.  Only booking rows are
    joined; the others (no session for most: one NULL key) pass straight
    through their own rules."""
    return _judged(t.session, t.workout_log, None, as_of)


def judged_after(taken: DataFrame, inserted: DataFrame, session: DataFrame,
                 as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """`inserted` log rows with their violations, `taken` (S_ID, n) seats of
    the sessions being taken before."""
    return _judged(session, inserted, taken, as_of)


def overbooked_sessions(t: Tables) -> DataFrame:
    """Audit of the capacity rule: sessions holding more bookings than seats."""
    return (t.session.join(booking_counts(t.workout_log), "S_ID")
            .filter(F.col("n_bookings") > F.col("MaxParticipants"))
            .select("S_ID", "Details", "MaxParticipants", F.col("n_bookings").alias("Bookings")))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the flag, quarantined rows with their message)."""
    return df.filter(F.col("violation").isNull()).drop("violation"), \
        df.filter(F.col("violation").isNotNull())


# ---- declared constraints ----------------------------------------------------

def check_unique(t: Tables, table_names: tuple[str, ...] | None = None) -> DataFrame:
    """Duplicate values of every primary key and UNIQUE column (of all
    tables, or of `table_names`); e-mail addresses are the same whatever the
    case of their letters, and shown in lower case."""
    parts = []
    for table, pk in SC.PRIMARY_KEYS.items():
        if table_names is not None and table not in table_names:
            continue
        cols = [(pk,)] + [tuple(u) for u in ([SC.UNIQUE_KEYS[table]] if table in SC.UNIQUE_KEYS else [])]
        for key in cols:
            c = key[0]
            value = email_key(c) if c == "Email" else F.col(c)
            parts.append(getattr(t, table).filter(F.col(c).isNotNull())
                         .groupBy(value.alias(c)).agg(F.count(F.lit(1)).alias("n"))
                         .filter(F.col("n") > 1)
                         .select(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
                                 F.col(c).cast("string").alias("value"), "n"))
    return reduce(DataFrame.unionByName, parts)


def check_foreign_keys(t: Tables) -> DataFrame:
    """Orphan count per foreign key (child rows whose non-NULL key has no parent)."""
    parts = []
    for child, ccol, parent, pcol, _action in SC.FK_GRAPH:
        keys = getattr(t, parent).select(F.col(pcol).alias(ccol))
        orphans = (getattr(t, child).filter(F.col(ccol).isNotNull()).select(ccol)
                   .join(keys, ccol, "left_anti"))
        parts.append(orphans.agg(F.count(F.lit(1)).alias("orphans")).select(
            F.lit(child).alias("child_table"), F.lit(ccol).alias("child_column"),
            F.lit(parent).alias("parent_table"), "orphans"))
    return reduce(DataFrame.unionByName, parts)


def check_domains(t: Tables) -> DataFrame:
    """CHECK / NOT NULL / ENUM rules: violating row count per rule."""
    rules = [
        ("gym", "capacity_positive", ~(F.col("Capacity") > 0)),
        ("membership_type", "price_non_negative", ~(F.col("Price") >= 0)),
        ("member", "age_10_100", ~F.col("Age").between(10, 100)),
        ("member", "not_null", F.col("Name").isNull() | F.col("Email").isNull()
         | F.col("JoinDate").isNull() | F.col("MembershipType_ID").isNull()
         | F.col("Gym_ID").isNull()),
        ("trainer", "not_null", F.col("Name").isNull() | F.col("Email").isNull()),
        ("session", "status_enum", ~F.col("Status").isin(*SC.SESSION_STATUSES)),
        ("workout_log", "not_null", F.col("M_ID").isNull()),
        ("health_metrics", "not_null", F.col("M_ID").isNull() | F.col("Date").isNull()),
        ("notifications", "type_enum", ~F.col("Type").isin(*SC.NOTIFICATION_TYPES)),
    ]
    by_table: dict[str, list] = {}
    for table, name, cond in rules:
        by_table.setdefault(table, []).append((name, cond))
    parts = []
    for table, rs in by_table.items():
        agg = getattr(t, table).agg(*[F.count(F.when(F.coalesce(c, F.lit(False)), 1)).alias(n)
                                      for n, c in rs])
        rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations"))
                         for n, _ in rs])
        parts.append(agg.select(F.lit(table).alias("table_name"), F.inline(rows)))
    return reduce(DataFrame.unionByName, parts)
