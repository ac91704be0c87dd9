"""Write-style request operators (booking, cancellation, workout logging,
metric upsert, registration).  Each takes a request table and returns a
status per request plus the rows to append; ids are assigned in request
order as if the requests ran one after another."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlake.functions.exprs import DEFAULT_AS_OF, email_key, is_booking
from fitlake.operators.common import assign_ids, max_id, scalar_int, top_k
from fitlake.operators.rules import MSG_AGE, first_violation, workout_range_rules
from fitlake.sources.schema import BOOKING
from fitlake.sources.tables import Tables

# ---- fixed values that must equal the reference's ---------------------------
BOOK_OK = "SUCCESS: Session booked successfully"
BOOK_ALREADY = "ERROR: You have already booked this session"
BOOK_FULL = "ERROR: Session is full"
BOOK_NOT_FOUND = "ERROR: Session not found"
# The HTTP handler's wording for the same outcomes (precedence="app").
APP_BOOK_OK = "Session booked successfully."
APP_BOOK_ALREADY = "You have already booked this session"
APP_BOOK_FULL = "Session is full"
APP_BOOK_NOT_FOUND = "Session not found"
CANCEL_OK = "Session booking canceled."
CANCEL_MISSING = "Booking not found or you do not have permission to cancel it"
WORKOUT_OK = "SUCCESS: Workout logged successfully"
WORKOUT_INACTIVE = "ERROR: Member not found or inactive"
APP_WORKOUT_OK = "success"
APP_WORKOUT_MISSING = "Missing required fields: exercise, date, duration."
METRIC_UPDATED = "SUCCESS: Health metrics updated"
METRIC_ADDED = "SUCCESS: Health metrics added"
REG_MISSING = "Missing required fields"
REG_DUPLICATE = "Email already exists"
REG_FK = "ERROR: foreign key constraint fails"
MEMBER_ADDED = "Member added successfully."
TRAINER_ADDED = "Trainer added successfully."


def apply_bookings(t: Tables, requests: DataFrame, precedence: str = "procedure") -> DataFrame:
    """Admit booking requests (request_id, M_ID, S_ID) in request order.

    Unknown session -> not found.  `precedence="procedure"` checks
    already-booked before capacity, `"app"` checks capacity first.  The first
    request per (member, session) is a candidate; per session the first
    `MaxParticipants - existing` candidates are admitted (NULL capacity:
    never full).  "Full at request r" = r is after the cut (the last admitted
    candidate), found with a top-K bounded by the largest capacity.
    Output: request_id, M_ID, S_ID, status, L_ID (new id when admitted)."""
    bk = t.workout_log.filter(is_booking() & F.col("S_ID").isNotNull())
    existing = bk.select("M_ID", "S_ID").distinct().withColumn("_booked", F.lit(True))
    counts = bk.groupBy("S_ID").agg(F.count(F.lit(1)).alias("_n0"))
    # per-session state: capacity and seats still free before this batch
    sess = (t.session.select("S_ID", F.col("MaxParticipants").alias("_max"))
            .join(counts, "S_ID", "left")
            .select("S_ID", "_max", F.lit(True).alias("_found"),
                    (F.col("_max") - F.coalesce("_n0", F.lit(0))).alias("_free")))
    r = (requests.select("request_id", "M_ID", "S_ID")
         .join(sess, "S_ID", "left").join(existing, ["M_ID", "S_ID"], "left")
         .withColumn("_booked", F.coalesce("_booked", F.lit(False))).checkpoint(eager=True))
    first = (r.filter(F.col("_found").isNotNull() & ~F.col("_booked"))
             .groupBy("M_ID", "S_ID").agg(F.min("request_id").alias("_first")))
    r1 = r.join(first, ["M_ID", "S_ID"], "left")
    cands = r1.filter(F.col("request_id") == F.col("_first")).select("S_ID", "request_id", "_free")
    k = max(scalar_int(t.session, F.max("MaxParticipants")), 1)
    ranked = top_k(cands, ["S_ID"], [F.col("request_id")], k, rank_col="_rk")
    # cut = request_id of the last admitted candidate; before every id when no
    # seat is free.
    cuts = (ranked.filter(F.col("_rk") == F.col("_free"))
            .select("S_ID", F.col("request_id").alias("_cut"))
            .unionByName(sess.filter(F.col("_free") <= 0)
                         .select("S_ID", F.lit(-(2 ** 63)).cast("long").alias("_cut"))))
    j = r1.join(cuts, "S_ID", "left")
    full_at = F.col("_cut").isNotNull() & (F.col("request_id") > F.col("_cut"))
    first_admitted = F.col("_cut").isNull() | (F.col("_first") <= F.col("_cut"))
    is_dup = F.col("_first").isNotNull() & (F.col("request_id") > F.col("_first"))
    not_found = F.col("_found").isNull()
    if precedence == "procedure":
        status = (F.when(not_found, BOOK_NOT_FOUND)
                  .when(F.col("_booked"), BOOK_ALREADY)
                  .when(is_dup & first_admitted, BOOK_ALREADY)
                  .when(is_dup, BOOK_FULL)
                  .when(full_at, BOOK_FULL)
                  .otherwise(BOOK_OK))
        ok_msg = BOOK_OK
    elif precedence == "app":
        status = (F.when(not_found, APP_BOOK_NOT_FOUND)
                  .when(full_at, APP_BOOK_FULL)
                  .when(F.col("_booked") | is_dup, APP_BOOK_ALREADY)
                  .otherwise(APP_BOOK_OK))
        ok_msg = APP_BOOK_OK
    else:
        raise ValueError(precedence)
    st = j.select("request_id", "M_ID", "S_ID", status.alias("status"))
    return assign_ids(st, "request_id", max_id(t.workout_log, "L_ID"), "L_ID",
                      only=F.col("status") == ok_msg)


def booking_rows(t: Tables, statuses: DataFrame) -> DataFrame:
    """Log rows for admitted bookings: dated at the session, with its duration."""
    s = t.session.select("S_ID", "SessionDate", F.col("Duration").alias("_d"))
    return (statuses.filter(F.col("L_ID").isNotNull()).join(s, "S_ID")
            .select(F.col("L_ID").cast("bigint"), "M_ID", "S_ID", F.lit(BOOKING).alias("Exercise"),
                    F.col("SessionDate").alias("Date"), F.col("_d").alias("Duration"),
                    F.lit(None).cast("decimal(6,2)").alias("CaloriesBurnt"),
                    F.lit(None).cast("decimal(6,2)").alias("Distance"),
                    F.lit("Booked").alias("Progress")))


def cancel_bookings(t: Tables, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete booking rows matching (L_ID, M_ID); anything else (another
    member's row, a non-booking row, a repeat) is not found.
    Returns (statuses, new log)."""
    hits = t.workout_log.filter(is_booking()).select("L_ID", "M_ID").withColumn("_hit", F.lit(True))
    first = requests.groupBy("L_ID", "M_ID").agg(F.min("request_id").alias("_first"))
    st = (requests.select("request_id", "L_ID", "M_ID").join(first, ["L_ID", "M_ID"])
          .join(hits, ["L_ID", "M_ID"], "left")
          .select("request_id", "L_ID", "M_ID",
                  F.when(F.col("_hit").isNotNull() & (F.col("request_id") == F.col("_first")),
                         F.lit(CANCEL_OK)).otherwise(F.lit(CANCEL_MISSING)).alias("status")))
    gone = requests.select("L_ID", "M_ID").distinct()
    new_log = t.workout_log.join(
        gone.join(hits.drop("_hit"), ["L_ID", "M_ID"], "left_semi"), ["L_ID", "M_ID"], "left_anti")
    return st, new_log


def add_workouts(t: Tables, requests: DataFrame, as_of: dt.date = DEFAULT_AS_OF,
                 form: str = "procedure") -> DataFrame:
    """Log workouts; the insert rules (ranges, no future date) reject bad rows.

    `form="procedure"`: only existing active members may log.
    `form="app"`: the HTTP handler's form, which only requires exercise,
    date and duration (the session decides the member), with its wording.
    Output: request columns + status + L_ID."""
    ranges = workout_range_rules(as_of)
    if form == "procedure":
        active = t.member.filter(F.col("IsActive") == F.lit(True)).select("M_ID") \
            .withColumn("_ok", F.lit(True))
        r = requests.join(active, "M_ID", "left")
        status = first_violation((F.col("_ok").isNull(), WORKOUT_INACTIVE), *ranges)
        ok_msg = WORKOUT_OK
    elif form == "app":
        r = requests
        missing = F.col("Exercise").isNull() | F.col("Date").isNull() | F.col("Duration").isNull()
        status = first_violation((missing, APP_WORKOUT_MISSING), *ranges)
        ok_msg = APP_WORKOUT_OK
    else:
        raise ValueError(form)
    st = r.select(*requests.columns, F.coalesce(status, F.lit(ok_msg)).alias("status"))
    return assign_ids(st, "request_id", max_id(t.workout_log, "L_ID"), "L_ID",
                      only=F.col("status") == ok_msg)


def normalize_workout_form(df: DataFrame) -> DataFrame:
    """The browser form's input handling: calories are parsed as an integer
    and a 0 (or unparsable) calories / distance value is sent as NULL."""
    cal = F.floor(F.col("CaloriesBurnt"))
    return (df.withColumn("CaloriesBurnt", F.when(cal != 0, cal).cast("decimal(6,2)"))
              .withColumn("Distance", F.when(F.col("Distance") != 0, F.col("Distance"))))


def upsert_health_metrics(t: Tables, updates: DataFrame) -> DataFrame:
    """Apply metric updates keyed by (M_ID, Date) in request order; returns
    the new HealthMetrics version.  Existing rows of a key take the key's
    last update.  A new key is inserted by its first update that passes the
    insert rule (later updates then modify it), so it ends with the key's
    last update; new ids follow that first valid request."""
    from fitlake.operators.rules import health_metric_violation
    vals = ["Weight", "Height", "SleepHours", "WaterLiters", "Steps"]
    per_key = updates.withColumn("_valid", health_metric_violation().isNull()).groupBy("M_ID", "Date").agg(
        F.max("request_id").alias("_last"),
        *[F.max_by(c, "request_id").alias(f"_v_{c}") for c in vals],
        F.min(F.when(F.col("_valid"), F.col("request_id"))).alias("_first_ok"))
    # One join and one scan: stored rows, those with an update, and keys not
    # stored yet come out of it together and are stored once, new ids pending.
    hm = t.health_metrics.withColumn("_stored", F.lit(True))
    both = hm.join(per_key, ["M_ID", "Date"], "full_outer").checkpoint(eager=True)
    cols = t.health_metrics.columns
    upd = both.filter("_stored").select(*[
        F.when(F.col("_last").isNotNull(), F.col(f"_v_{c}")).otherwise(F.col(c)).alias(c) if c in vals else F.col(c)
        for c in cols])
    new = both.filter(F.col("_stored").isNull() & F.col("_first_ok").isNotNull()).drop("Metric_ID")
    ins = assign_ids(new, "_first_ok", max_id(both, "Metric_ID"), "Metric_ID")
    return upd.unionByName(ins.select(*[F.col(f"_v_{c}").alias(c) if c in vals else F.col(c) for c in cols]))


def upsert_statuses(t: Tables, updates: DataFrame) -> DataFrame:
    """Per request: updated (key existed, or was inserted by an earlier
    valid request of the batch), added, or the insert rule's message."""
    from fitlake.operators.rules import health_metric_violation
    ex = t.health_metrics.select("M_ID", "Date").distinct().withColumn("_ex", F.lit(True))
    u = updates.withColumn("_v", health_metric_violation())
    first_ok = u.filter(F.col("_v").isNull()).groupBy("M_ID", "Date") \
        .agg(F.min("request_id").alias("_f"))
    j = u.join(ex, ["M_ID", "Date"], "left").join(first_ok, ["M_ID", "Date"], "left")
    st = (F.when(F.col("_ex").isNotNull(), METRIC_UPDATED)
          .when(F.col("_f").isNotNull() & (F.col("request_id") > F.col("_f")), METRIC_UPDATED)
          .when(F.col("_v").isNull(), METRIC_ADDED)
          .otherwise(F.col("_v")))
    return j.select("request_id", "M_ID", "Date", st.alias("status"))


def _register(existing: DataFrame, requests: DataFrame, required: list[str], fk_ok,
              rule, ok_msg: str, pk: str) -> DataFrame:
    """Shared registration logic: required fields, insert rule, unique
    e-mail (against the table and earlier successful requests), FKs."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    pre = F.when(missing, REG_MISSING)
    if rule is not None:
        pre = pre.when(rule, MSG_AGE)
    r = requests.withColumn("_pre", pre).withColumn("_fk", fk_ok).withColumn("_mail", email_key("Email"))
    # Requests that fail by themselves pass beside the joins (no e-mail: one
    # NULL key).  For each address of the others: whether it is taken, and the
    # first request that could have it (FK failures do not take an address).
    open_ = r.filter(F.col("_pre").isNull())
    taken = existing.select(email_key("Email").alias("_mail")).distinct().withColumn("_taken", F.lit(True))
    state = (open_.groupBy("_mail").agg(F.min(F.when(F.col("_fk"), F.col("request_id"))).alias("_w"))
             .join(taken, "_mail", "left"))
    status = (F.when(F.col("_taken") | (F.col("request_id") > F.col("_w")), REG_DUPLICATE)
              .when(~F.col("_fk"), REG_FK)
              .otherwise(ok_msg))
    st = (open_.join(state, "_mail", "left").select("request_id", "Email", status.alias("status"))
          .unionByName(r.filter(F.col("_pre").isNotNull()).select("request_id", "Email", F.col("_pre").alias("status"))))
    return assign_ids(st, "request_id", max_id(existing, pk), pk, only=F.col("status") == ok_msg)


def register_members(t: Tables, requests: DataFrame) -> DataFrame:
    """Admin member registration: required fields, age rule, unique e-mail,
    type and gym must exist.  Join date is the run date, active, no end date."""
    types = t.membership_type.select(F.col("Type_ID").alias("MembershipType_ID")).distinct() \
        .withColumn("_t", F.lit(True))
    gyms = t.gym.select("Gym_ID").distinct().withColumn("_g", F.lit(True))
    req = requests.join(types, "MembershipType_ID", "left").join(gyms, "Gym_ID", "left")
    return _register(t.member, req, ["Name", "Email", "Age", "MembershipType_ID", "Gym_ID"],
                     F.col("_t").isNotNull() & F.col("_g").isNotNull(),
                     (F.col("Age") < 10) | (F.col("Age") > 100), MEMBER_ADDED, "M_ID")


def register_trainers(t: Tables, requests: DataFrame) -> DataFrame:
    gyms = t.gym.select("Gym_ID").distinct().withColumn("_g", F.lit(True))
    req = requests.join(gyms, "Gym_ID", "left")
    return _register(t.trainer, req, ["Name", "Email", "Specialization", "Gym_ID"],
                     F.col("_g").isNotNull(), None, TRAINER_ADDED, "T_ID")


def new_member_rows(t: Tables, requests: DataFrame, statuses: DataFrame,
                    as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    ok = statuses.filter(F.col("M_ID").isNotNull()).select("request_id", "M_ID")
    return (requests.join(ok, "request_id")
            .select("M_ID", "Name", "Email", "Age", F.lit(as_of).alias("JoinDate"),
                    F.coalesce("Phone", F.lit("")).alias("Phone"),
                    F.lit(None).cast("date").alias("MembershipEndDate"),
                    F.lit(True).alias("IsActive"), "MembershipType_ID", "Gym_ID"))


def new_trainer_rows(requests: DataFrame, statuses: DataFrame) -> DataFrame:
    ok = statuses.filter(F.col("T_ID").isNotNull()).select("request_id", "T_ID")
    return (requests.join(ok, "request_id")
            .select("T_ID", "Name", "Email", "Specialization", "Gym_ID"))


def workout_rows(statuses: DataFrame) -> DataFrame:
    """Log rows of accepted workouts (no session)."""
    return (statuses.filter(F.col("L_ID").isNotNull())
            .select("L_ID", "M_ID", F.lit(None).cast("bigint").alias("S_ID"), "Exercise", "Date", "Duration",
                    "CaloriesBurnt", "Distance", "Progress"))
