"""Library pieces: id assignment, appends, sources/sinks, streaming helpers."""

import datetime as dt
import json
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fitlake.operators import dashboards as DB
from fitlake.operators.common import append_rows, assign_ids
from fitlake.session import checkpoint_dir
from fitlake.sources import schema as SC
from fitlake.sources.tables import load_tables, save_tables, seed_tables
from fitlake.streaming import twins as ST

AS_OF = dt.date(2024, 1, 30)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=10**9), min_size=1, max_size=60, unique=True),
       st.integers(min_value=0, max_value=1000))
def test_assign_ids_dense_and_ordered(spark, keys, base):
    df = spark.createDataFrame([(k,) for k in keys], "request_id long").repartition(7)
    got = sorted((r.request_id, r.new_id) for r in assign_ids(df, "request_id", base, "new_id").collect())
    assert [i for _, i in got] == list(range(base + 1, base + 1 + len(keys)))


def test_assign_ids_only_subset(spark):
    df = spark.createDataFrame([(k, k % 3 == 0) for k in range(20)], "request_id long, ok boolean")
    out = {r.request_id: r.nid for r in assign_ids(df, "request_id", 100, "nid", only=F.col("ok")).collect()}
    assert [out[k] for k in range(0, 20, 3)] == list(range(101, 108))
    assert all(out[k] is None for k in range(20) if k % 3)


def test_append_rows_generates_ids_after_max(spark):
    target = spark.createDataFrame([(5, 1, "x", "system", True, dt.datetime(2024, 1, 1))],
                                   SC.NOTIFICATIONS)
    new = spark.createDataFrame([(2, "hello", "system", 7), (3, "hi", "system", 3)],
                                "M_ID int, Message string, Type string, ord int")
    out = append_rows(target, new, "Notif_ID", "ord")
    rows = sorted(out.collect(), key=lambda r: r.Notif_ID)
    assert [(r.Notif_ID, r.M_ID) for r in rows] == [(5, 1), (6, 3), (7, 2)]
    assert rows[1].IsRead is None and out.columns == SC.NOTIFICATIONS.names


def test_save_and_load_round_trip(spark):
    t = seed_tables(spark, AS_OF)
    path = f"{checkpoint_dir(spark)}/test-tables-{uuid.uuid4().hex[:8]}"
    save_tables(t, path)
    back = load_tables(spark, path)
    for name in SC.TABLE_NAMES:
        assert sorted(getattr(back, name).collect()) == sorted(getattr(t, name).collect())
        assert getattr(back, name).schema == SC.SCHEMAS[name]


def test_dashboard_json_is_valid(spark):
    t = seed_tables(spark, AS_OF)
    rows = DB.dashboard_json(DB.member_dashboard(t, AS_OF), "M_ID").collect()
    doc = json.loads(next(r.json for r in rows if r.M_ID == 1))
    assert doc["member"]["Name"] == "Member 1" and len(doc["recentWorkouts"]) == 2
    assert [x["Details"] for x in doc["upcomingSessions"]] == ["Class 2"]


def test_notice_dedupe_stream(spark):
    rows = [(1, 1, "a", "renewal", False, dt.datetime(2024, 1, 1)),
            (2, 1, "b", "renewal", False, dt.datetime(2024, 1, 2)),
            (3, 1, "c", "system", False, dt.datetime(2024, 1, 2)),
            (4, 2, "d", "renewal", False, dt.datetime(2024, 1, 3))]
    df = spark.createDataFrame(rows, SC.NOTIFICATIONS)
    out = ST.replay_to_table(spark, ST.slices(df, "Notif_ID", 2), SC.NOTIFICATIONS, ST.stream_notice_dedupe)
    # rows of one micro-batch have no order: one of each pair, whichever it is
    assert sorted((r.M_ID, r.Type) for r in out.collect()) == [(1, "renewal"), (1, "system"), (2, "renewal")]


def test_daily_calories_stream_drops_late_rows(spark):
    from decimal import Decimal
    d = lambda day: dt.date(2024, 1, day)
    row = lambda i, day, cal: (i, 1, None, "Run", d(day), 30, Decimal(cal), None, None)
    batches = [[row(1, 1, "100.00"), row(2, 2, "50.00")], [row(3, 10, "10.00")],
               [row(4, 1, "999.00")],  # later than the watermark of Jan 9, its state gone
               [row(5, 20, "1.00")]]
    parts = [spark.createDataFrame(rows, SC.WORKOUT_LOG) for rows in batches]
    out = ST.replay_to_table(spark, parts, SC.WORKOUT_LOG, ST.stream_daily_calories)
    assert {(r.Date, r.daily_calories) for r in out.collect()} == {
        (d(1), Decimal("100.00")), (d(2), Decimal("50.00")), (d(10), Decimal("10.00"))}  # Jan 20 is open


def test_slices_keep_rows_without_an_order(spark):
    df = spark.createDataFrame([(None,), *[(i,) for i in range(20)]], "k long")
    parts = [sorted((r.k is not None, r.k or 0) for r in p.collect()) for p in ST.slices(df, "k", 3)]
    assert sum(map(len, parts)) == 21 and parts[0][0] == (False, 0)
    assert all(a[-1] < b[0] for a, b in zip(parts, parts[1:]))


def test_admin_dashboard_split_valid_and_new_members(spark):
    from fitlake.operators import rules as RU
    from fitlake.operators import writes as W
    t = seed_tables(spark, AS_OF)
    dash = DB.admin_dashboard(t, AS_OF)
    stats = dash["stats"].first()
    assert (stats.totalMembers, stats.totalTrainers, stats.activeSessions) == (8, 4, 3)
    assert dash["members"].count() == 8 and dash["trainers"].count() == 4
    valid, bad = RU.split_valid(RU.validate_workouts(t.workout_log, AS_OF))
    assert valid.count() + bad.count() == 16 and bad.count() == 4 and "violation" not in valid.columns
    req = spark.createDataFrame([(1, "Zed", "zed@example.org", 30, None, 1, 1),
                                 (2, "Dup", "member1@example.org", 30, None, 1, 1)], SC.MEMBER_REGISTRATION)
    st = W.register_members(t, req)
    rows = W.new_member_rows(t, req, st, AS_OF).collect()
    assert [(r.M_ID, r.Email, r.JoinDate, r.Phone, r.IsActive) for r in rows] == \
        [(9, "zed@example.org", AS_OF, "", True)]


def test_top_k_salted_path_equals_window_path(spark):
    from fitlake.operators.common import top_k
    rows = [(1 if i % 3 else 2, i) for i in range(200)]          # key 1 is hot
    df = spark.createDataFrame(rows, "key int, v int")
    expect = sorted(top_k(df, ["key"], [F.col("v").desc()], 5, rank_col="rk").collect())
    old = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "2")
    try:
        got = sorted(top_k(df, ["key"], [F.col("v").desc()], 5, rank_col="rk").collect())
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", old)
    assert got == expect and len(got) == 10


def test_id_generating_and_stream_queries_are_repeatable(spark):
    """The driver may execute a returned DataFrame more than once."""
    from fitlake.plans.registry import queries
    qs = queries()
    for name in ["apply_bookings", "add_workouts", "register_members", "upsert_health_metrics",
                 "append_session_reminders", "stream_milestones"]:
        df = qs[name](spark, "/root/testdata/sf0.001")
        assert sorted(df.collect()) == sorted(df.collect()), name


CONFS = [{"spark.sql.adaptive.enabled": "true"},
         {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "false"},
         {"spark.sql.adaptive.enabled": "false"}]


def _with(spark, conf, fn):
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_assign_ids_on_a_million_rows(spark):
    """Dense, unique and complete however the range shuffle is planned."""
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 20).alias("text"),
                               (F.col("id") % 3 == 0).alias("ok"))
    for conf in CONFS:
        conf = {**conf, "spark.sql.shuffle.partitions": "8"}
        r = _with(spark, conf, lambda: assign_ids(df, "k", 10, "nid").agg(
            F.count("*"), F.countDistinct("nid"), F.min("nid"), F.max("nid"),
            F.sum((F.col("nid") == F.col("k") + 11).cast("long"))).first())
        assert tuple(r) == (n, n, 11, n + 10, n), conf
        ok = (n + 2) // 3
        r = _with(spark, conf, lambda: assign_ids(df, "k", 0, "nid", only=F.col("ok")).agg(
            F.count("*"), F.count("nid"), F.countDistinct("nid"), F.max("nid")).first())
        assert tuple(r) == (n, ok, ok, ok), conf


def test_changed_source_is_seen(spark, tmp_path):
    import shutil
    from fitlake.plans.registry import queries
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "events"):
        shutil.copyfile(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    q = queries()["admin_totals"]
    before = q(spark, str(tmp_path)).first().totalMembers
    import pyarrow.parquet as pq
    rows = pq.read_table(tmp_path / "customer.parquet")
    pq.write_table(rows.slice(0, 40), tmp_path / "customer.parquet")
    spark.catalog.clearCache()
    assert before > 40 and q(spark, str(tmp_path)).first().totalMembers == 40


def test_cluster_needs_a_shared_folder():
    import pytest
    from fitlake.session import checkpoint_dir as folder

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        folder(Session())
