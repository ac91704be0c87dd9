"""Operators over sequences and versions: notice jobs over run dates, as-of
lookups, changed rows, and streamed rules with state in tables."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from fitlake.operators import asof as A
from fitlake.operators import changes as CH
from fitlake.operators import notice_runs as NR
from fitlake.operators import notices as N
from fitlake.operators import rules as R
from fitlake.operators.common import running, segments
from fitlake.sources import schema as SC
from fitlake.sources.tables import frames
from fitlake.streaming import ledgers as LG
from fitlake.streaming import twins as ST
from pyspark.sql import functions as F
from pyspark.sql import types as T

D = dt.date(2024, 1, 30)


def day(n):
    return D + dt.timedelta(days=n)


def midnight(n):
    return dt.datetime.combine(day(n), dt.time())


@pytest.fixture
def many_parts(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, old)


# ---- running values over segments --------------------------------------------

def test_running_over_segments(spark, many_parts):
    rnd = random.Random(1)
    rows = [(None if k == 0 else "hot" if k < 5 else f"k{k}", i, rnd.randint(-5, 9), None if rnd.random() < 0.3 else rnd.randint(0, 99))
            for i, k in enumerate(rnd.choices(range(9), k=500))]
    df = segments(spark.createDataFrame(rows, "k string, at long, a long, b long"), ["k"], ["at"])
    assert df.filter("k = 'hot'").select("_seg").distinct().count() > 1
    for before in (False, True):
        got = {r.at: (r.s, r.m) for r in running(df, ["k"], "_seg", ["at"], {
            "s": ("sum", F.col("a")), "m": ("max", F.col("b"))}, before).collect()}
        for k in {r[0] for r in rows}:
            mine = sorted(r[1:] for r in rows if r[0] == k)
            for i, (at, _, _) in enumerate(mine):
                part = mine[:i] if before else mine[:i + 1]
                assert got[at] == (sum(a for _, a, _ in part), max((b for _, _, b in part if b is not None), default=None))


# ---- notice jobs over run dates ------------------------------------------------

def people(spark, seed):
    rnd = random.Random(seed)
    members = [(m, f"M{m}", f"m{m}@x", 30, day(rnd.randint(-380, -330)), None,
                None if m % 5 == 0 else day(rnd.randint(-5, 40)), m % 7 != 0, 1 + m % 2, 1) for m in range(1, 31)]
    log = [(i, rnd.randint(1, 26), None, "Run", day(rnd.randint(-40, 25)), 30, None, None, None) for i in range(1, 60)]
    notes = [(i, rnd.randint(1, 30), rnd.choice(["We miss you", "Your renewal", "hello"]), rnd.choice(["system", "renewal"]),
              False, midnight(rnd.randint(-30, 10)) + dt.timedelta(hours=rnd.choice([0, 9, 15]))) for i in range(1, 40)]
    return frames(spark, {"member": members, "workout_log": log, "notifications": notes,
                          "membership_type": [(1, "Gold", 12, Decimal(1), 1), (2, "Silver", 11, Decimal(1), 1)]})


def run_daily(spark, t, job, first, last, see=lambda t, d: t):
    """The job of every day, each on the notices that the earlier ones have written."""
    out, stored = [], [tuple(r) for r in t.notifications.collect()]
    for n in range((last - first).days + 1):
        d = first + dt.timedelta(days=n)
        now = see(t.replace(notifications=spark.createDataFrame(stored, SC.NOTIFICATIONS)), d)
        for r in job(now, d).collect():
            out.append((r.M_ID, r.Message, r.Type, r.CreatedAt))
            stored.append((None, r.M_ID, r.Message, r.Type, False, r.CreatedAt))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.M_ID, r.Message, r.Type, r.CreatedAt) for r in df.collect()), key=str)


def test_renewal_run_is_the_daily_job(spark):
    t = people(spark, 1)
    want = run_daily(spark, t, N.renewal_notices, day(-8), day(14))
    assert rows_of(NR.renewal_notice_run(t, day(-8), day(14))) == want and len(want) > 5


def test_expiry_run_is_the_daily_job(spark):
    def at_noon(t, d):
        return N.renewal_notices_stored_date(t, d).withColumn("CreatedAt", F.col("CreatedAt") + F.expr("INTERVAL 12 HOURS"))
    t = people(spark, 2)
    want = run_daily(spark, t, at_noon, day(-8), day(12))
    assert rows_of(NR.expiry_notice_run(t, day(-8), day(12))) == want and len(want) > 5


@pytest.mark.parametrize("days", [14, 3])
def test_inactive_run_is_the_daily_job(spark, days):
    t = people(spark, 3)
    want = run_daily(spark, t, lambda t, d: N.inactive_member_notices(t, d, days), day(10), day(24))
    got = rows_of(NR.inactive_notice_run(t, day(10), day(24), days))
    assert got == want and any(r[1] is None for r in got) and any(r[1] for r in got)


@pytest.mark.parametrize("days", [14, 3])
def test_inactive_replay_sees_what_was_there(spark, days):
    t, first = people(spark, 4), day(-12)
    kept = t.replace(notifications=t.notifications.filter(F.col("CreatedAt") < F.lit(midnight(-12))))
    def then(t, d):
        return t.replace(workout_log=t.workout_log.filter(F.col("Date") <= F.lit(d)))
    want = run_daily(spark, kept, lambda t, d: N.inactive_member_notices(t, d, days), first, day(8), then)
    assert rows_of(NR.inactive_notice_run(t, first, day(8), days, replay=True)) == want and len(want) > 5


def test_chosen_days(spark):
    due = spark.createDataFrame([(1, day(0), None), (1, day(0), None), (2, day(3), day(3)), (2, day(9), day(12)), (3, None, day(-1)),
                                 (4, day(5), day(4)), (None, day(1), day(2))], "M_ID long, lo date, hi date")
    silenced = spark.createDataFrame([(1, day(4)), (2, day(2)), (9, day(0))], "M_ID long, until date")
    got = {(r.M_ID, (r.day - D).days) for r in NR.chosen_days(due, silenced, D, day(20), 7).collect()}
    assert got == {(1, 5), (1, 12), (1, 19), (2, 3), (2, 10), (None, 1)}


# ---- as-of lookups ---------------------------------------------------------------

def test_as_of(spark, many_parts):
    """A member with a third of the rows and a day with a third of the probes."""
    rnd = random.Random(7)
    who = lambda: None if (k := rnd.randint(0, 20)) == 20 else 1 if k < 7 else k
    rows = [(i, who(), None if i % 29 == 0 else day(rnd.randint(0, 40)), None if i % 7 == 0 else Decimal(rnd.randint(20, 90)))
            for i in range(300)]
    probes = [(i, who(), None if i % 31 == 0 else day(20) if i % 3 == 0 else day(rnd.randint(-5, 45))) for i in range(300)]
    probes += probes[:3]
    out = A.as_of(spark.createDataFrame(probes, "L_ID long, M_ID long, At date"),
                  spark.createDataFrame(rows, "Metric_ID long, M_ID long, Date date, Weight decimal(5,2)"),
                  "M_ID", "At", "Date", "Metric_ID", ["Weight", "Metric_ID"])
    got = sorted(((r.L_ID, r.M_ID, r.At, r.Weight, r.Metric_ID) for r in out.collect()), key=str)
    want = []
    for i, m, at in probes:
        best = max(((d, k, w) for k, n, d, w in rows if n == m and m is not None and at is not None and d is not None and d <= at),
                   key=lambda x: x[:2], default=(None, None, None))
        want.append((i, m, at, best[2], best[1]))
    assert got == sorted(want, key=str)


def test_as_of_nothing(spark):
    rows = spark.createDataFrame([], "k long, d date, id long, v string")
    probes = spark.createDataFrame([(1, D)], "k long, d date")
    assert [tuple(r) for r in A.as_of(probes, rows, "k", "d", "d", "id", ["v"]).collect()] == [(1, D, None)]
    assert A.as_of(probes.limit(0), rows, "k", "d", "d", "id", ["v"]).count() == 0


def test_weight_changes_are_the_function(spark):
    from fitlake.operators.metrics import weight_change
    rnd = random.Random(2)
    metrics = [(i, m, day(d), None if rnd.random() < .2 else Decimal(rnd.randint(50, 90)), Decimal(170), 8, Decimal(2), 1)
               for i, (m, d) in enumerate({(rnd.randint(1, 4), rnd.randint(-60, 0)) for _ in range(40)})]
    t = frames(spark, {"health_metrics": metrics, "workout_log": [(m, m, None, "Run", D, 30, None, None, None) for m in range(1, 6)],
                       "member": [(m, "x", "x", 30, D, None, None, True, 1, 1) for m in range(1, 6)]})
    want = {r.M_ID: r.WeightChange30Days for r in weight_change(t, D).collect()}
    assert {r.M_ID: r.WeightChange for r in A.weight_changes(t).collect()} == want


# ---- changed rows -------------------------------------------------------------------

def test_changes(spark):
    schema = "id long, a string, b long, c string"
    old = spark.createDataFrame([(1, "x", 1, None), (2, "y", None, "z"), (3, None, 2, None), (4, "gone", 1, "q"), (5, "p", 5, "p")], schema)
    new = spark.createDataFrame([(1, "x", 1, None), (2, "y", 7, None), (3, None, None, "2"), (6, "new", None, None), (5, "p", 5, "P")], schema)
    got = {r.id: (r.change, r["columns"], r.old and r.old.a, r.new and r.new.a) for r in CH.changes(old, new.select("c", "b", "a", "id"), "id").collect()}
    assert got == {2: ("update", ["b", "c"], "y", "y"), 3: ("update", ["b", "c"], None, None), 4: ("delete", [], "gone", None),
                   5: ("update", ["c"], "p", "p"), 6: ("insert", [], None, "new")}
    assert CH.changes(old, old, "id").count() == 0 and CH.changes(old.limit(0), old.limit(0), "id").count() == 0
    with pytest.raises(ValueError):
        CH.changes(old, new.drop("c"), "id")


def test_a_change_fires_its_own_rules_only(spark):
    t = frames(spark, {
        "member": [(1, "A", "a", 30, day(-360), "1", None, True, 1, 1), (2, "B", "b", 30, day(-360), "1", None, True, 1, 1),
                   (3, "C", "c", 30, day(-500), "1", None, True, 1, 1), (4, "E", "e", 30, day(-500), "1", None, True, 1, 1)],
        "membership_type": [(1, "Gold", 12, Decimal(1), 1)],
        "workout_log": [(i, 1, None, "Run", day(-20), 30, None, None, None) for i in range(1, 10)],
        "health_metrics": [(1, 1, day(-9), Decimal(70), None, 8, None, 1), (2, 2, day(-9), Decimal(70), None, 8, None, 1)],
        "session": [(1, "S", day(-2), "07:00:00", 30, 1, 2, "scheduled"), (2, "S", day(-2), "07:00:00", 30, 1, 2, "scheduled")]})
    assert CH.fired_notices(t, t, D).count() == 0
    new = t.replace(
        member=t.member.withColumn("Phone", F.when(F.col("M_ID").isin(1, 3), F.lit("2")).otherwise(F.col("Phone"))),
        health_metrics=t.health_metrics.withColumn("Steps", F.when(F.col("Metric_ID") == 1, 2).otherwise(F.col("Steps"))),
        session=t.session.withColumn("Details", F.when(F.col("S_ID") == 1, F.lit("T")).otherwise(F.col("Details"))),
        workout_log=t.workout_log.unionByName(spark.createDataFrame(
            [(10, 1, None, "Run", D, 400, None, None, None), (11, 2, None, "Run", D, 30, None, None, None),
             (12, 2, 1, SC.BOOKING, D, 30, None, None, None)], SC.WORKOUT_LOG)))
    assert {(r.rule, r.row_id, r.M_ID) for r in CH.fired_notices(t, new, D).collect()} == {
        ("member_update", None, 1), ("milestone", 10, 1), ("welcome", 11, 2)}
    # a fresh workout on the run date: nobody is idle; without it the metric rule fires
    idle = new.replace(workout_log=t.workout_log)
    assert {(r.rule, r.M_ID) for r in CH.fired_notices(t, idle, D).collect()} == {("member_update", 1), ("metric_update", 1)}
    assert {(r.table_name, r.row_id, r.violation) for r in CH.fired_violations(t, new, D).collect()} == {
        ("workout_log", 10, R.MSG_DURATION), ("workout_log", 12, R.MSG_PAST_SESSION)}
    member, session = CH.after_rules(t, new, D)
    assert {r.M_ID: r.IsActive for r in member.collect()} == {1: True, 2: True, 3: False, 4: True}
    assert {r.S_ID: r.Status for r in session.collect()} == {1: "completed", 2: "scheduled"}


# ---- streamed rules with state in tables ---------------------------------------------

def test_ledger_counts_a_batch_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LG.Ledger, "EVERY", 3)
    ledger = LG.workouts_ledger(spark, str(tmp_path / "l"))
    frame = lambda *ms: spark.createDataFrame([(m, 1) for m in ms], "M_ID long, c long")
    ledger.start(frame(1))
    total = {1: 1}
    for i in range(8):
        assert {r.M_ID: r.c for r in ledger.before(i).collect()} == total
        for _ in range(2):  # the second time is a retry
            assert {r.M_ID: r.c for r in ledger.before(i).collect()} == total
            ledger.put(i, frame(1, i, i))
        total[1] = total.get(1, 0) + 1
        total[i] = total.get(i, 0) + 2


def log_rows(n, seed):
    rnd = random.Random(seed)
    return [(i, 1 if rnd.random() < 0.4 else rnd.randint(2, 6), (s := rnd.choice([None, 1, 1, 2, 3])),
             SC.BOOKING if s else rnd.choice(["Run", None, "Row"]), D, rnd.choice([30, 30, None, 400]), None, None, None)
            for i in range(1, n + 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_capacity_is_the_batch_rule(spark, seed):
    t = frames(spark, {"workout_log": log_rows(200, seed),
                       "session": [(1, "S", D, "07:00:00", 30, 1, 9, "scheduled"), (2, "S", day(-1), "07:00:00", 30, 1, 2, "scheduled"),
                                   (3, "S", D, "07:00:00", 30, 1, None if seed == 1 else 0, "scheduled")]})
    parts = ST.slices(t.workout_log, "L_ID", 4)
    got = LG.capacity_replay(t, parts, ST.scratch(spark, "t"), ST.replay, repeat=True)
    assert {r.L_ID: r.violation for r in got.collect()} == {r.L_ID: r.violation for r in R.validate_log_rows(t, D).collect()}


@pytest.mark.parametrize("workouts_only", [False, True])
def test_streamed_milestones_are_the_batch_rule(spark, workouts_only):
    t = frames(spark, {"workout_log": log_rows(330, 5)})
    folder = ST.scratch(spark, "t")
    sink = LG.milestone_sink(LG.workouts_ledger(spark, f"{folder}/c"), f"{folder}/n", D, workouts_only)
    def twice(batch, i):
        sink(batch, i), sink(batch, i)
    ST.replay(spark, ST.slices(t.workout_log, "L_ID", 5), lambda s, ck: LG.start(s, twice, ck), SC.WORKOUT_LOG)
    want = sorted(map(tuple, N.workout_milestones(t, D, workouts_only).collect()))
    schema = T.StructType([T.StructField("L_ID", T.LongType()), *[f for f in SC.NOTIFICATIONS if f.name != "Notif_ID"]])
    assert sorted(map(tuple, LG.results(spark, f"{folder}/n", schema).collect())) == want and len(want) > 1


def notes(*rows):
    return [(i, m, "x", kind, False, midnight(n) + dt.timedelta(hours=h)) for i, (m, kind, n, h) in enumerate(rows, 1)]


def passed(spark, stored, parts, days):
    folder = ST.scratch(spark, "t")
    ledger = LG.notice_ledger(spark, f"{folder}/l", spark.createDataFrame(stored, SC.NOTIFICATIONS))
    sink = LG.notice_sink(ledger, f"{folder}/k", days=days)
    for i, part in enumerate(parts):
        for _ in range(2):
            sink(spark.createDataFrame(part, SC.NOTIFICATIONS), i)
    return {r.Notif_ID for r in LG.results(spark, f"{folder}/k", SC.NOTIFICATIONS).collect()}


def test_six_seven_and_eight_days_differ(spark):
    """A stored notice of day 0; then ones of days 7, 8 and 9 (member 1), a
    chain across batches (member 2), other types and members untouched."""
    stored = notes((1, "system", 0, 15), (2, "renewal", -30, 0))
    coming = notes((1, "system", 7, 3), (1, "system", 8, 23), (1, "system", 8, 1), (1, "system", 9, 0), (2, "renewal", 1, 1),
                   (2, "renewal", 8, 0), (2, "renewal", 9, 0), (2, "renewal", 10, 0), (1, "renewal", 1, 0), (3, "system", 1, 5),
                   (3, "system", 1, 2))
    parts = [sorted((r for r in coming if lo <= r[5] < hi), key=lambda r: r[5])
             for lo, hi in ((midnight(0), midnight(8)), (midnight(8), midnight(20)))]
    common = {5, 9, 11}
    assert passed(spark, stored, parts, 6) == common | {1, 6}
    assert passed(spark, stored, parts, 7) == common | {3, 7}
    assert passed(spark, stored, parts, 8) == common | {4, 8}


# ---- versions that write what they touch -----------------------------------------------

def files(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def test_only_touched_partitions_are_written(spark, tmp_path):
    from fitlake.sources import partitioned as PT
    log = [(i, 1, None, "Run", None if i % 10 == 9 else D - dt.timedelta(days=31 * (i % 10)), 30, None, None, None) for i in range(100)]
    old = spark.createDataFrame(log, SC.WORKOUT_LOG)
    path = str(tmp_path)
    PT.save_partitioned(old, "workout_log", path)
    folder = tmp_path / "workout_log"
    before = files(folder)

    def check(new, touched):
        now = files(folder)
        want = sorted(map(tuple, new.collect()), key=str)
        assert PT.write_version(spark, new, "workout_log", path) == touched
        after = files(folder)
        assert sorted(map(tuple, PT.load_partitioned(spark, "workout_log", path).drop("month").collect()), key=str) == want
        gone = {f for f in now if f.split("/")[0].split("=")[1] in touched}
        assert now - gone <= after and not gone & after

    stored = lambda: PT.load_partitioned(spark, "workout_log", path).drop("month")
    check(stored(), [])
    assert files(folder) == before
    # one row changed, one moved to another month, one without a date removed
    check(stored().withColumn("Date", F.expr("CASE WHEN L_ID = 12 THEN DATE'2023-10-01' ELSE Date END"))
          .withColumn("Duration", F.expr("CASE WHEN L_ID = 3 THEN 31 ELSE Duration END")).filter("L_ID <> 19"),
          ["2023-10", "2023-11", "none"])
    # a whole month goes, and a new one comes
    gone = stored().filter("Date is null or date_format(Date, 'yyyy-MM') <> '2024-01'")
    check(gone.unionByName(spark.createDataFrame([(500, 2, None, "Run", dt.date(2025, 5, 5), 1, None, None, None)], SC.WORKOUT_LOG)),
          ["2024-01", "2025-05"])
    assert not (folder / "month=2024-01").exists()
