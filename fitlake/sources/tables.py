"""Sources: the nine membership tables.

* `load_tables(spark, path)` opens the nine tables stored as Parquet (one
  folder per table) with the declared schemas: no inference, columns pruned
  and filters pushed into the scan by Catalyst.
* `derive_tables(spark, sf_dir)` builds the same nine tables from the
  TPC-H-ish test data by fixed formulas, lazily; the SQL oracle builds them
  with the identical formulas (`fitlake.plans.oracle.PREFIX`).
* `seed_tables(spark, as_of)` is the tiny hand-written seed used by unit tests.
* Request frames (bookings, cancellations, …) are derived from the test data
  the same way, so every write-style operator runs over whole tables.
"""

from __future__ import annotations

import dataclasses
from concurrent.futures import ThreadPoolExecutor
import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlake.functions.exprs import DEFAULT_AS_OF
from fitlake.sources import schema as SC


@dataclasses.dataclass(frozen=True)
class Tables:
    gym: DataFrame
    membership_type: DataFrame
    member: DataFrame
    trainer: DataFrame
    admin: DataFrame
    session: DataFrame
    workout_log: DataFrame
    health_metrics: DataFrame
    notifications: DataFrame

    def replace(self, **kw) -> "Tables":
        return dataclasses.replace(self, **kw)

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> Tables:
    """Read the nine tables from `path/<table>` with their declared schemas."""
    frames = {name: spark.read.format(fmt).schema(sch).load(f"{path}/{name}")
              for name, sch in SC.SCHEMAS.items()}
    return Tables(**frames)


# Fact tables are range-partitioned and sorted on their date column when
# written, so Parquet min/max statistics let date predicates skip files and
# row groups (the reference's queries filter almost every fact by date).
# The range key ends with the primary key, so even a date (or member) holding
# a third of all rows is split evenly across write tasks.
_SORT_ON_WRITE = {"workout_log": ("Date", "M_ID", "L_ID"),
                  "health_metrics": ("Date", "M_ID", "Metric_ID"),
                  "notifications": ("CreatedAt", "M_ID", "Notif_ID")}


# A task starts another file after so many rows: a table that one task has
# written is still read by several, and what one of them holds stays bounded.
_ROWS_A_FILE = 250_000

#: The plan whose members the coach serves (a fixed value of the application).
COACH_PLAN = "Gold"

# Table names in the source database (the reference's DDL).
JDBC_TABLE_NAMES = {
    "gym": "Gym", "membership_type": "MembershipType", "member": "Member", "trainer": "Trainer",
    "admin": "Admin", "session": "Session", "workout_log": "WorkoutLog",
    "health_metrics": "HealthMetrics", "notifications": "Notifications",
}


def load_tables_jdbc(spark: SparkSession, url: str, properties: dict[str, str],
                     num_partitions: int = 64) -> Tables:
    """Read the nine tables from the operational database with Spark's JDBC
    source: each table is read in `num_partitions` parallel range queries
    between the least and the greatest value of its integer primary key (one
    small query a table; a table without rows is read in one), and only the
    declared columns are selected, so password columns never leave the
    database.  (Needs the database's JDBC driver on the classpath.)"""
    frames = {}
    for name, sch in SC.SCHEMAS.items():
        pk = SC.PRIMARY_KEYS[name]
        source = JDBC_TABLE_NAMES[name]
        lo, hi = spark.read.jdbc(url, f"(SELECT MIN({pk}) AS lo, MAX({pk}) AS hi FROM {source}) AS b",
                                 properties=properties).first()
        lo, hi = (0, 0) if lo is None else (int(lo), int(hi))
        cols = ", ".join(sch.names)
        df = spark.read.jdbc(url, f"(SELECT {cols} FROM {source}) AS t",
                             column=pk, lowerBound=lo, upperBound=hi + 1,
                             numPartitions=max(1, min(num_partitions, hi - lo + 1)), properties=properties)
        frames[name] = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in sch.fields])
    return Tables(**frames)


def save_table(df: DataFrame, name: str, path: str, mode: str = "overwrite") -> None:
    """Persist one table (facts range-partitioned and sorted by date)."""
    keys = [k for k in _SORT_ON_WRITE.get(name, ()) if k in df.columns]
    if keys:
        df = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    df.write.mode(mode).option("maxRecordsPerFile", _ROWS_A_FILE).parquet(f"{path}/{name}")


def save_tables(t: Tables, path: str, mode: str = "overwrite", parallel: int = 4) -> None:
    """Persist a table version (the sink for maintenance operators).  The
    nine writes are independent Spark jobs, submitted from a few threads so
    small dimension writes overlap the large fact writes."""
    items = list(t.as_dict().items())
    if parallel <= 1:
        for name, df in items:
            save_table(df, name, path, mode)
        return
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        for f in [pool.submit(save_table, df, name, path, mode) for name, df in items]:
            f.result()


def curated_tables(spark: SparkSession, t: Tables, path: str) -> Tables:
    """Write `t` to `path` (a fresh folder in the shared checkpoint dir) and
    read it back with the declared schemas: lineage is cut, later queries
    scan stored Parquet with pushed filters and pruned columns."""
    save_tables(t, path)
    return load_tables(spark, path)


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")




def _d(s: str):
    return F.lit(dt.date.fromisoformat(s))


def derive_tables(spark: SparkSession, sf_dir: str, as_of: dt.date = DEFAULT_AS_OF) -> Tables:
    """The nine tables derived from `/root/testdata/<sf>` (formulas in FIXTURES.md)."""
    region = _raw(spark, sf_dir, "region")
    nation = _raw(spark, sf_dir, "nation")
    customer = _raw(spark, sf_dir, "customer")
    supplier = _raw(spark, sf_dir, "supplier")
    part = _raw(spark, sf_dir, "part")
    orders = _raw(spark, sf_dir, "orders")
    events = _raw(spark, sf_dir, "events")
    # Two scalars (row counts, read from Parquet footers) folded into the
    # plans as literals once per derivation instead of a subquery per query.
    n_part = F.lit(part.count())
    n_supp = F.lit(supplier.count())

    gym = region.select(
        F.col("r_regionkey").cast("bigint").alias("Gym_ID"),
        F.col("r_name").alias("Location"),
        (F.lit(100) + F.lit(50) * F.col("r_regionkey")).cast("int").alias("Capacity"))

    nk = F.col("n_nationkey")
    mtype = nation.select(
        nk.cast("bigint").alias("Type_ID"),
        F.when(nk % 3 == 0, "Gold").when(nk % 3 == 1, "Silver").otherwise("Platinum").alias("Name"),
        F.when(nk % 3 == 1, 6).otherwise(12).cast("int").alias("Duration"),
        (F.lit(5000) + F.lit(500) * nk).cast("decimal(8,2)").alias("Price"),
        F.col("n_regionkey").cast("bigint").alias("Gym_ID"))

    ck = F.col("c_custkey")
    join_date = F.date_add(_d("2022-12-01"), (ck % 425).cast("int"))
    months = F.when(F.col("c_nationkey") % 3 == 1, 6).otherwise(12)
    member = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        ck.cast("bigint").alias("M_ID"),
        F.col("c_name").alias("Name"),
        F.concat(F.when(ck % 10 == 7, "M").otherwise("m"), ck.cast("string"), F.lit("@example.org")).alias("Email"),
        F.when(ck % 29 == 0, F.lit(None)).otherwise((F.lit(8) + ck % 95).cast("int"))
        .cast("int").alias("Age"),
        join_date.alias("JoinDate"),
        F.when(ck % 6 == 0, F.lit(None)).otherwise(ck.cast("string")).alias("Phone"),
        F.when(ck % 4 == 0, F.lit(None).cast("date")).otherwise(F.add_months(join_date, months))
        .alias("MembershipEndDate"),
        (F.col("c_acctbal") > 0).alias("IsActive"),
        F.col("c_nationkey").cast("bigint").alias("MembershipType_ID"),
        F.col("n_regionkey").cast("bigint").alias("Gym_ID"))

    sk = F.col("s_suppkey")
    trainer = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        sk.cast("bigint").alias("T_ID"),
        F.col("s_name").alias("Name"),
        # some trainers share an address: the unique-key audit has work to do
        F.concat(F.when(sk % 34 == 0, "T").otherwise("t"), F.when(sk % 17 == 0, sk % 34).otherwise(sk).cast("string"),
                 F.lit("@example.org")).alias("Email"),
        F.when(sk % 4 == 0, "Strength").when(sk % 4 == 1, "Yoga").when(sk % 4 == 2, "Cardio")
        .alias("Specialization"),
        F.col("n_regionkey").cast("bigint").alias("Gym_ID"))

    admin = spark.createDataFrame([(1, "Site Admin", "admin@example.org")], SC.ADMIN)

    pk, psz = F.col("p_partkey"), F.col("p_size")
    session = part.select(
        pk.cast("bigint").alias("S_ID"),
        F.col("p_name").alias("Details"),
        F.date_add(_d("2024-01-21"), (pk % 21).cast("int")).alias("SessionDate"),
        F.concat(F.lpad((F.lit(6) + psz % 15).cast("string"), 2, "0"), F.lit(":30:00"))
        .alias("SessionTime"),
        (F.lit(30) + F.lit(15) * (psz % 5)).cast("int").alias("Duration"),
        ((pk * psz) % n_supp).cast("bigint").alias("T_ID"),
        (F.lit(1) + psz % 4).cast("int").alias("MaxParticipants"),
        F.when(pk % 5 == 0, "cancelled")
        .when(((pk % 21) < 9) & (pk % 3 == 0), "completed")
        .otherwise("scheduled").alias("Status"))

    eid, uid, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
    ev_date = F.col("ts").cast("date")
    # Every event is kept.  Idle members are made by moving their late events
    # back, members without a booking by leaving their sign-ups as workouts.
    idle = ((uid % 5 == 0) & (ev_date >= _d("2024-01-14"))) | ((uid % 5 == 1) & (ev_date >= _d("2024-01-21")))
    log_date = F.when(idle, F.date_sub(ev_date, 40)).otherwise(ev_date)
    signup = (et == "signup") & (uid % 10 != 0)
    sess_of = (eid * 7) % n_part
    workout_log = events.select(
        eid.cast("bigint").alias("L_ID"),
        uid.cast("bigint").alias("M_ID"),
        F.when(signup, sess_of.cast("bigint")).alias("S_ID"),
        F.when(signup, F.lit(SC.BOOKING)).otherwise(et).alias("Exercise"),
        F.when(signup, F.date_add(_d("2024-01-21"), (sess_of % 21).cast("int")))
        .otherwise(log_date).alias("Date"),
        F.when(eid % 13 == 0, F.lit(None)).otherwise((F.lit(3) + (eid * 11) % 320).cast("int"))
        .cast("int").alias("Duration"),
        F.when(signup | (eid % 17 == 0), F.lit(None))
        .otherwise(((eid * 37) % 210000).cast("decimal(20,0)") / 100)
        .cast("decimal(6,2)").alias("CaloriesBurnt"),
        F.when(eid % 3 == 0, F.lit(None))
        .otherwise(((eid * 13) % 5200).cast("decimal(20,0)") / 100)
        .cast("decimal(6,2)").alias("Distance"),
        F.when(signup, F.lit("Booked")).alias("Progress"))

    ok, oc = F.col("o_orderkey"), F.col("o_custkey")
    health = orders.select(
        ok.cast("bigint").alias("Metric_ID"),
        oc.cast("bigint").alias("M_ID"),
        F.date_add(_d("2023-11-20"), ((ok * 11) % 72).cast("int")).alias("Date"),
        F.when(ok % 19 == 0, F.lit(None))
        .otherwise((F.lit(150) + (ok * 7) % 2900).cast("decimal(20,0)") / 10)
        .cast("decimal(5,2)").alias("Weight"),
        (F.lit(95) + oc % 160).cast("decimal(5,2)").alias("Height"),
        (ok % 11).cast("int").alias("SleepHours"),
        ((ok % 105).cast("decimal(20,0)") / 10).cast("decimal(4,2)").alias("WaterLiters"),
        F.when(ok % 23 == 0, F.lit(None)).otherwise(((ok * 37) % 12000).cast("int"))
        .cast("int").alias("Steps"))

    back = F.when(ck % 3 == 0, ck % 8).otherwise(ck % 130).cast("int")
    notif_a = customer.select(
        ck.cast("bigint").alias("Notif_ID"), ck.cast("bigint").alias("M_ID"),
        F.lit("Renewal notice").alias("Message"), F.lit("renewal").alias("Type"),
        (ck % 5 == 0).alias("IsRead"),
        F.date_sub(F.lit(as_of), back).cast("timestamp_ntz").alias("CreatedAt"))
    k = eid % 5
    notif_b = events.select(
        (F.lit(10000000) + eid).cast("bigint").alias("Notif_ID"), uid.cast("bigint").alias("M_ID"),
        F.when(k == 0, "Reminder for cold widget").when(k == 1, "Reminder for small widget")
        .when(k == 2, "We miss you").when(k == 3, "We have missed you").otherwise("Milestone")
        .alias("Message"),
        F.when(k <= 1, "session_reminder").when(k <= 3, "system").otherwise("progress")
        .alias("Type"),
        (eid % 8 <= 1).alias("IsRead"),
        F.col("ts").cast("timestamp_ntz").alias("CreatedAt"))
    notifications = notif_a.unionByName(notif_b)

    return Tables(gym=gym, membership_type=mtype, member=member, trainer=trainer, admin=admin,
                  session=session, workout_log=workout_log, health_metrics=health,
                  notifications=notifications)


# ---- request frames derived from the test data ------------------------------

def booking_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`view` events as booking requests, in event order."""
    ev = _raw(spark, sf_dir, "events")
    n_part = F.lit(_raw(spark, sf_dir, "part").count())
    return ev.filter(F.col("event_type") == "view").select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("bigint").alias("M_ID"),
        (F.col("event_id") % n_part).cast("bigint").alias("S_ID"))


def cancel_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancellations: some name the right owner of a log row, some another member."""
    ev = _raw(spark, sf_dir, "events")
    eid = F.col("event_id")
    return ev.select(
        eid.alias("request_id"), eid.cast("bigint").alias("L_ID"),
        F.when(eid % 7 < 4, F.col("user_id")).otherwise(F.col("user_id") + 1)
        .cast("bigint").alias("M_ID"))


def seat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings and cancellations in one sequence: views book, half of them
    again a little later; a third of those bookings are cancelled (some by
    another member), and half of those tried once more; every other stored
    booking is cancelled in between.  Eight ids for each event."""
    ev = _raw(spark, sf_dir, "events")
    few = F.greatest(F.floor(F.lit(_raw(spark, sf_dir, "part").count()) / 8), F.lit(1))
    eid, uid = F.col("event_id").cast("bigint"), F.col("user_id").cast("bigint")
    none = F.lit(None).cast("bigint")

    def rows(where, later: int, slot: int, kind: str, member=uid, session=none, log=none, booking=none):
        return ev.filter(where).select(
            (8 * (eid + later) + slot).alias("request_id"), F.lit(kind).alias("kind"), member.alias("M_ID"),
            session.cast("bigint").alias("S_ID"), log.alias("L_ID"), booking.alias("booking"))

    view, session = F.col("event_type") == "view", (eid * 7) % few
    other = F.when(eid % 9 == 0, uid + 1).otherwise(uid)
    return (rows(view, 0, 0, "book", session=session)
            .unionByName(rows(view & (eid % 2 == 0), 300, 1, "book", session=session))
            .unionByName(rows(view & (eid % 3 == 0), 700, 2, "cancel", other, booking=8 * eid))
            .unionByName(rows(view & (eid % 6 == 0), 1000, 3, "book", session=session))
            .unionByName(rows((F.col("event_type") == "signup") & (eid % 2 == 0), 100, 4, "cancel", log=eid)))


def next_version(t: Tables) -> Tables:
    """A later version of the tables: some rows of members, sessions, metrics
    and log changed, some gone, some new (copies with ids beyond all others)."""
    m, h, s, w = t.member, t.health_metrics, t.session, t.workout_log
    far = 10 ** 9

    def copies(df, key, where):
        return df.filter(where).withColumn(key, F.col(key) + far)

    member = m.filter("M_ID % 50 <> 49").withColumns({
        "Phone": F.when(F.expr("M_ID % 7 = 0"), F.concat(F.coalesce("Phone", F.lit("")), F.lit("0"))).otherwise(F.col("Phone")),
        "IsActive": F.expr("CASE WHEN M_ID % 11 = 0 THEN NOT IsActive ELSE IsActive END")})
    metrics = h.withColumns({
        "Weight": F.expr("CASE WHEN Metric_ID % 5 = 0 THEN CAST(Weight + 1 AS DECIMAL(5,2)) ELSE Weight END"),
        "Steps": F.expr("CASE WHEN Metric_ID % 13 = 0 THEN NULL ELSE Steps END")})
    session = s.withColumns({
        "Details": F.expr("CASE WHEN S_ID % 3 = 0 THEN concat(Details, ' (moved)') ELSE Details END"),
        "SessionDate": F.expr("CASE WHEN S_ID % 6 = 0 THEN date_add(SessionDate, 1) ELSE SessionDate END")})
    log = w.filter("L_ID % 100 <> 5")
    return t.replace(member=member.unionByName(copies(m, "M_ID", "M_ID % 40 = 1")),
                     health_metrics=metrics.unionByName(copies(h, "Metric_ID", "Metric_ID % 29 = 3")), session=session,
                     workout_log=log.unionByName(copies(w, "L_ID", "L_ID % 10 = 0")))


def workout_requests(spark: SparkSession, sf_dir: str, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    ev = _raw(spark, sf_dir, "events")
    eid = F.col("event_id")
    return ev.filter(F.col("event_type") == "purchase").select(
        eid.alias("request_id"), F.col("user_id").cast("bigint").alias("M_ID"),
        F.when(eid % 3 == 0, "Running").when(eid % 3 == 1, "Cycling").otherwise("Rowing")
        .alias("Exercise"),
        F.date_sub(F.lit(as_of), (eid % 3).cast("int")).alias("Date"),
        (F.lit(20) + eid % 60).cast("int").alias("Duration"),
        ((eid % 90000).cast("decimal(20,0)") / 100).cast("decimal(6,2)").alias("CaloriesBurnt"),
        F.when(eid % 2 == 0, F.lit(None))
        .otherwise(((eid % 2000).cast("decimal(20,0)") / 100)).cast("decimal(6,2)")
        .alias("Distance"),
        F.lit("Logged").alias("Progress"))


def metric_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric upserts: half hit an existing (member, date), half are new dates."""
    o = _raw(spark, sf_dir, "orders")
    ok, oc = F.col("o_orderkey"), F.col("o_custkey")
    same_day = F.date_add(_d("2023-11-20"), ((ok * 11) % 72).cast("int"))
    new_day = F.date_add(_d("2024-02-01"), (ok % 5).cast("int"))
    return o.select(
        ok.alias("request_id"), oc.cast("bigint").alias("M_ID"),
        F.when(ok % 2 == 0, same_day).otherwise(new_day).alias("Date"),
        ((F.lit(500) + ok % 1000).cast("decimal(20,0)") / 10).cast("decimal(5,2)").alias("Weight"),
        (F.lit(150) + oc % 50).cast("decimal(5,2)").alias("Height"),
        (F.lit(4) + ok % 6).cast("int").alias("SleepHours"),
        ((ok % 40).cast("decimal(20,0)") / 10).cast("decimal(4,2)").alias("WaterLiters"),
        ((ok * 13) % 15000).cast("int").alias("Steps"))


def member_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups: some reuse an existing e-mail, some repeat within the batch,
    some lack a required field."""
    c = _raw(spark, sf_dir, "customer")
    ck = F.col("c_custkey")
    email = F.when(ck % 3 == 0, F.concat(F.lit("m"), ck.cast("string"), F.lit("@Example.org"))) \
        .otherwise(F.concat(F.when(ck % 2 == 0, "New").otherwise("new"), (ck % 97).cast("string"), F.lit("@example.org")))
    return c.select(
        ck.alias("request_id"), F.col("c_name").alias("Name"),
        F.when(ck % 11 == 0, F.lit(None)).otherwise(email).alias("Email"),
        (F.lit(18) + ck % 50).cast("int").alias("Age"),
        F.when(ck % 5 == 0, F.lit(None)).otherwise(ck.cast("string")).alias("Phone"),
        F.col("c_nationkey").cast("bigint").alias("MembershipType_ID"),
        (F.col("c_nationkey") % 5).cast("bigint").alias("Gym_ID"))


def trainer_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _raw(spark, sf_dir, "supplier")
    sk = F.col("s_suppkey")
    email = F.when(sk % 2 == 0, F.concat(F.lit("T"), sk.cast("string"), F.lit("@example.org"))) \
        .otherwise(F.concat(F.lit("coach"), sk.cast("string"), F.lit("@example.org")))
    return s.select(
        sk.alias("request_id"), F.col("s_name").alias("Name"), email.alias("Email"),
        F.when(sk % 9 == 0, F.lit(None)).otherwise(F.lit("Pilates")).alias("Specialization"),
        (F.col("s_nationkey") % 5).cast("bigint").alias("Gym_ID"))


def member_delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete-by-id requests: customers with a negative balance name a real
    member, the rest an id that does not exist."""
    c = _raw(spark, sf_dir, "customer")
    ck = F.col("c_custkey")
    return c.select(ck.alias("request_id"),
                    F.when(F.col("c_acctbal") < 0, ck).otherwise(ck + 100000).cast("bigint").alias("M_ID"))


def trainer_delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _raw(spark, sf_dir, "supplier")
    sk = F.col("s_suppkey")
    return s.select(sk.alias("request_id"),
                    F.when(F.col("s_acctbal") < 0, sk).otherwise(sk + 100000).cast("bigint").alias("T_ID"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of `conversations` as chat questions (whole texts)."""
    cv = _raw(spark, sf_dir, "conversations")
    return cv.filter(F.col("role") == "user").select("conv_id", "turn", "text")


BENCH_AS_OF = dt.date(2001, 8, 1)




def bench_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bench-size workout log over lineitem x orders (no L_ID: aggregates only)."""
    li = _raw(spark, sf_dir, "lineitem")
    o = _raw(spark, sf_dir, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("o_custkey").cast("bigint").alias("M_ID"),
        F.lit(None).cast("bigint").alias("S_ID"),
        F.col("l_returnflag").alias("Exercise"),
        F.col("l_shipdate").cast("date").alias("Date"),
        F.floor(F.col("l_quantity")).cast("int").alias("Duration"),
        (F.col("l_extendedprice") % 2000).cast("decimal(6,2)").alias("CaloriesBurnt"),
        F.lit(None).cast("decimal(6,2)").alias("Distance"),
        F.lit(None).cast("string").alias("Progress"))


# ---- tiny fixture for unit tests --------------------------------------------

def seed_tables(spark: SparkSession, as_of: dt.date = DEFAULT_AS_OF, members: int = 8) -> Tables:
    """A small invented world, built from counters: four halls, five plans,
    `members` members, four trainers with a session each, two log rows and one
    metric row a member, and one unread notice for every other member."""
    day = lambda n: as_of + dt.timedelta(days=n)
    ids = range(1, members + 1)
    gym = [(i, f"Hall {i}", 40 * i) for i in range(1, 5)]
    plans = [(i, COACH_PLAN if i == 3 else f"Plan {i}", 3 * i, Decimal(90 * i), 1 + i % 4) for i in range(1, 6)]
    member = [(i, f"Member {i}", f"member{i}@example.org", 20 + 3 * i, day(-11 * i),
               f"+000{i}" if i % 2 else None, None, True, 1 + i % 5, 1 + i % 4) for i in ids]
    trainer = [(i, f"Coach {i}", f"coach{i}@example.org", f"Skill {i}", i) for i in range(1, 5)]
    session = [(i, f"Class {i}", day(i - 2), f"{8 + i:02d}:15:00", 25 * i, i, 2 + i, "scheduled") for i in range(1, 5)]
    log = [(2 * i - 1, i, None, f"Move {i % 3}", day(-i), 10 + i, Decimal(7 * i), None, None) for i in ids]
    log += [(2 * i, i, 1 + i % 4, SC.BOOKING, day(1 + i % 4 - 2), 25 * (1 + i % 4), None, None, "Booked") for i in ids]
    metrics = [(i, i, day(-i), Decimal(50 + 2 * i), Decimal(150 + 3 * i), 4 + i % 5, Decimal(i) / 4, 1111 * i) for i in ids]
    notes = [(i, i, f"Note {i}", "system", False, dt.datetime.combine(day(-i), dt.time())) for i in ids if i % 2 == 0]
    return frames(spark, {"gym": gym, "membership_type": plans, "member": member, "trainer": trainer,
                          "admin": [(1, "Keeper", "keeper@example.org")], "session": session, "workout_log": log,
                          "health_metrics": metrics, "notifications": notes})


def frames(spark: SparkSession, rows: dict, base: Tables | None = None) -> Tables:
    """Build a Tables record from {name: rows}; missing tables are empty (or from `base`)."""
    out = {}
    for name, sch in SC.SCHEMAS.items():
        if name in rows:
            out[name] = spark.createDataFrame(rows[name], sch)
        elif base is not None:
            out[name] = getattr(base, name)
        else:
            out[name] = spark.createDataFrame([], sch)
    return Tables(**out)
