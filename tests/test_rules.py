"""Semantic traps and rule boundaries on tiny hand-made frames."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from fitlake.functions import exprs as X
from fitlake.operators import app as A
from fitlake.operators import maintenance as MT
from fitlake.operators import metrics as M
from fitlake.operators import notices as N
from fitlake.operators import reports as R
from fitlake.operators import rules as RU
from fitlake.operators import writes as W
from fitlake.operators.base_queries import member_progress_rollup, member_progress_rollup_exact
from fitlake.sources import schema as SC
from fitlake.sources.tables import frames, seed_tables

AS_OF = dt.date(2024, 1, 30)
D = lambda n: AS_OF + dt.timedelta(days=n)
BK = SC.BOOKING


def _member(mid, age=30, active=True, join=None, mtype=1, end=None, name=None):
    return (mid, name or f"M{mid}", f"m{mid}@x.org", age, join or D(-100), None, end, active, mtype, 1)


def _log(lid, mid, ex="Run", date=None, dur=30, cal=None, dist=None, sid=None):
    return (lid, mid, sid, ex, date or D(-1), dur, cal, dist, None)


def _hm(i, mid, date, w=None, h=None, sleep=None, water=None, steps=None):
    return (i, mid, date, w, h, sleep, water, steps)


def _base(spark, **rows):
    rows.setdefault("gym", [(1, "G", 100)])
    rows.setdefault("membership_type", [(1, "Gold", 12, Decimal("100.00"), 1)])
    return frames(spark, rows)


def test_seed_tables_load(spark):
    t = seed_tables(spark, AS_OF)
    assert t.member.count() == 8 and t.session.count() == 4 and t.notifications.count() == 4
    assert all(r.orphans == 0 for r in RU.check_foreign_keys(t).collect())


def test_age_group_boundaries(spark):
    df = spark.createDataFrame([(a,) for a in [None, 17, 18, 25, 26, 40, 41, 60, 61]], "age int")
    got = [r[0] for r in df.select(X.age_group("age")).collect()]
    assert got == ["Senior", "Teen", "Young Adult", "Young Adult", "Adult", "Adult", "Middle Age",
                   "Middle Age", "Senior"]


def test_duration_hhmm_truncates_like_lpad(spark):
    df = spark.createDataFrame([(125,), (6000,), (5,), (None,)], "m int")
    assert [r[0] for r in df.select(X.duration_hhmm("m")).collect()] == ["02:05", "10:00", "00:05", None]


def test_workout_range_boundaries(spark):
    t = _base(spark, workout_log=[_log(1, 1, dur=4), _log(2, 1, dur=5), _log(3, 1, dur=300),
                                  _log(4, 1, dur=301), _log(5, 1, dur=None),
                                  _log(6, 1, cal=Decimal("2000.01")), _log(7, 1, dist=Decimal("50.00")),
                                  _log(8, 1, date=D(1))])
    v = {r.L_ID: r.violation for r in RU.validate_workouts(t.workout_log, AS_OF).collect()}
    assert v[1] == RU.MSG_DURATION and v[2] is None and v[3] is None and v[4] == RU.MSG_DURATION
    assert v[5] is None and v[6] == RU.MSG_CALORIES and v[7] is None and v[8] == RU.MSG_FUTURE


def test_future_booking_rejected_unless_exempt(spark):  # T11
    t = _base(spark, workout_log=[_log(1, 1, ex=BK, date=D(3), sid=1)])
    assert RU.validate_workouts(t.workout_log, AS_OF).first().violation == RU.MSG_FUTURE
    assert RU.validate_workouts(t.workout_log, AS_OF, exempt_bookings=True).first().violation is None


def test_health_metric_rules_null_passes(spark):
    t = _base(spark, health_metrics=[_hm(1, 1, D(0)), _hm(2, 1, D(0), w=Decimal("19.99")),
                                     _hm(3, 1, D(0), steps=100001), _hm(4, 1, D(0), sleep=-1)])
    v = {r.Metric_ID: r.violation for r in RU.validate_health_metrics(t.health_metrics).collect()}
    assert v == {1: None, 2: RU.MSG_WEIGHT, 3: RU.MSG_STEPS, 4: RU.MSG_SLEEP}


def test_fanout_exact_not_above_faithful(spark):  # T3
    t = _base(spark, member=[_member(1)],
              workout_log=[_log(1, 1, cal=Decimal("10.00")), _log(2, 1, cal=Decimal("20.00"))],
              health_metrics=[_hm(1, 1, D(-2), w=Decimal("80.00")), _hm(2, 1, D(-1), w=Decimal("70.00")),
                              _hm(3, 1, D(0), w=Decimal("75.00"))])
    f = member_progress_rollup(t).first()
    e = member_progress_rollup_exact(t).first()
    assert (f.TotalWorkouts, e.TotalWorkouts) == (6, 2)
    assert f.TotalCaloriesBurned == Decimal("90.00") and e.TotalCaloriesBurned == Decimal("30.00")
    assert f.CurrentWeight == Decimal("80.00") and f.StartingWeight == Decimal("70.00")  # T4


def test_no_workouts_stays_active_and_null_message(spark):  # T5
    t = _base(spark, member=[_member(1), _member(2)], workout_log=[_log(1, 2, date=D(-90))])
    flags = {r.M_ID: r.IsActive for r in MT.refresh_activity_flag(t, AS_OF).collect()}
    assert flags == {1: True, 2: False}
    rep = {r.M_ID: r.Message for r in N.inactive_member_notices(t, AS_OF).collect()}
    assert rep[1] is None and rep[2].startswith("We miss you, M2! It has been 90 days")


def test_consistency_counts_future_bookings(spark):  # T6
    logs = [_log(i, 1, ex=BK, date=D(i), sid=1) for i in range(1, 41)]
    t = _base(spark, member=[_member(1)], workout_log=logs)
    assert M.workout_consistency(t, AS_OF).first().ConsistencyPercent == Decimal("133.33")


def test_latest_metric_tie_break_and_steps_rounding(spark):  # T9, T10
    t = _base(spark, member=[_member(1)],
              health_metrics=[_hm(1, 1, D(0), w=Decimal("60.00"), h=Decimal("200.00"), steps=2),
                              _hm(2, 1, D(0), w=Decimal("80.00"), h=Decimal("200.00"), steps=3)])
    assert M.member_bmi(t).first().BMI == Decimal("20.00")  # Metric_ID 2 wins the tie
    assert M.avg_daily_steps(t, AS_OF).first().AvgStepsLastWeek == 3  # 2.5 rounds half up


def test_milestone_repeats_on_booking(spark):  # T13
    logs = [_log(i, 1) for i in range(1, 11)] + [_log(11, 1, ex=BK, sid=1), _log(12, 1)]
    t = _base(spark, member=[_member(1)], workout_log=logs)
    assert sorted(r.L_ID for r in N.workout_milestones(t, AS_OF).collect()) == [10, 11]
    assert [r.L_ID for r in N.workout_milestones(t, AS_OF, workouts_only=True).collect()] == [10]


def test_session_available_null_capacity(spark):
    t = _base(spark, session=[(1, "A", D(1), "07:00:00", 30, 1, None, "scheduled"),
                              (2, "B", D(1), "07:00:00", 30, 1, 1, "scheduled")],
              workout_log=[_log(1, 1, ex=BK, sid=2)])
    got = {r.S_ID: r.IsAvailable for r in M.session_available(t).collect()}
    assert got == {1: False, 2: False}


def test_bookings_respect_capacity_and_precedence(spark):
    t = _base(spark, member=[_member(i) for i in range(1, 6)],
              session=[(1, "A", D(1), "07:00:00", 30, 1, 2, "scheduled")],
              workout_log=[_log(1, 1, ex=BK, sid=1)])
    req = spark.createDataFrame([(10, 1, 1), (11, 2, 1), (12, 2, 1), (13, 3, 1), (14, 4, 9)],
                                SC.BOOKING_REQUEST)
    st = {r.request_id: (r.status, r.L_ID) for r in W.apply_bookings(t, req).collect()}
    assert st[10][0] == W.BOOK_ALREADY and st[11] == (W.BOOK_OK, 2)
    assert st[12][0] == W.BOOK_ALREADY and st[13][0] == W.BOOK_FULL and st[14][0] == W.BOOK_NOT_FOUND
    app = {r.request_id: r.status for r in W.apply_bookings(t, req, "app").collect()}
    assert app[10] == W.APP_BOOK_ALREADY and app[12] == W.APP_BOOK_FULL
    admitted = W.booking_rows(t, W.apply_bookings(t, req)).count()
    assert admitted + 1 <= 2


def test_cascade_delete_leaves_no_orphans(spark):
    t = _base(spark, member=[_member(1), _member(2)],
              trainer=[(1, "T", "t@x", "Yoga", 1)],
              session=[(1, "A", D(1), "07:00:00", 30, 1, 5, "scheduled")],
              workout_log=[_log(1, 1, ex=BK, sid=1), _log(2, 2)],
              health_metrics=[_hm(1, 1, D(0))],
              notifications=[(1, 1, "x", "system", False, dt.datetime(2024, 1, 1))])
    ids = spark.createDataFrame([(1,)], "T_ID int")
    t2 = MT.cascade_delete(t, "trainer", ids)
    assert t2.session.count() == 0 and t2.workout_log.filter(F.col("S_ID").isNotNull()).count() == 0
    t3 = MT.cascade_delete(t, "member", spark.createDataFrame([(1,)], "M_ID int"))
    assert t3.workout_log.count() == 1 and t3.health_metrics.count() == 0
    assert t3.notifications.count() == 0
    assert RU.check_foreign_keys(t3).filter("orphans > 0").count() == 0


def test_backfill_idempotent(spark):
    t = _base(spark, member=[_member(1, join=dt.date(2024, 1, 31)), _member(2, mtype=7)])
    once = MT.backfill_end_dates(t)
    twice = MT.backfill_end_dates(t.replace(member=once))
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r.M_ID: r.MembershipEndDate for r in once.collect()} == {1: dt.date(2025, 1, 31), 2: None}


def test_renewal_plural_suffix(spark):
    t = _base(spark, member=[_member(1, join=dt.date(2023, 1, 31)), _member(2, join=dt.date(2023, 2, 1))],
              membership_type=[(1, "Gold", 12, Decimal("100.00"), 1)])
    msgs = {r.M_ID: r.Message for r in N.renewal_notices(t, AS_OF).collect()}
    assert "renews in 1 day on January 31, 2024." in msgs[1]
    assert "renews in 2 days on February 01, 2024." in msgs[2]


def test_engagement_levels_and_summary(spark):
    logs = [_log(i, 1, date=D(-i)) for i in range(0, 25)]
    t = _base(spark, member=[_member(1), _member(2)], workout_log=logs)
    rep = {r.Member_ID: r for r in R.engagement_report(t, AS_OF).collect()}
    assert rep[1].Engagement_Level == "Highly Engaged" and rep[2].Engagement_Level == "Inactive"
    s = R.engagement_summary(t, AS_OF).first()
    assert s.Total_Members == 2 and s.Highly_Engaged == 1 and s.Inactive == 1


def test_recommendations_fallback_and_cap(spark):
    t = _base(spark, member=[_member(1), _member(2)],
              health_metrics=[_hm(1, 1, D(0), steps=100, sleep=3)],
              workout_log=[_log(i, 2, date=D(-1), cal=Decimal("500.00")) for i in range(1, 4)]
              + [_log(i, 2, ex="Swim", date=D(-1), cal=Decimal("500.00")) for i in range(4, 7)])
    recs = A.rule_recommendations(t, AS_OF).collect()
    m1 = [r.type for r in sorted(recs, key=lambda r: r.position) if r.M_ID == 1]
    assert m1 == ["cardio", "recovery", "general"]
    m2 = [r.exercise for r in recs if r.M_ID == 2]
    assert m2 == ["Recovery Stretching"]


def test_question_intent_order(spark):
    df = spark.createDataFrame([(1, 0, "what is my plan"), (2, 0, "hello"), (3, 0, "Sleep")],
                               "conv_id long, turn long, text string")
    got = {r.conv_id: r.intent for r in A.question_intent(df).collect()}
    assert got == {1: "goal", 2: "greeting", 3: "greeting"}  # case-sensitive


def test_role_scope(spark):
    t = seed_tables(spark, AS_OF)
    m = A.role_scope(t, "member", 1)
    assert "admin" not in m and m["workout_log"].count() == 2
    tr = A.role_scope(t, "trainer", 1)
    assert "notifications" not in tr and tr["session"].count() == 1


def test_check_unique_flags_duplicates(spark):
    t = _base(spark, member=[_member(1), _member(2)], admin=[(1, "A", "a@x"), (2, "B", "a@x")])
    got = {(r.table_name, r.column_name) for r in RU.check_unique(t).collect()}
    assert got == {("admin", "Email")}


def test_case_insensitive_key(spark):  # T1
    df = spark.createDataFrame([("Run",), ("run",), ("RUN ",)], "e string")
    assert df.groupBy(X.ci("e").alias("k")).count().count() == 1


def test_notice_jobs_idempotent_except_null_message(spark):  # SURVEY §5 (d), T5
    from fitlake.operators.common import append_rows
    t = _base(spark, member=[_member(1, join=dt.date(2023, 2, 1), name="Ann"), _member(2)],
              workout_log=[_log(1, 1, date=D(-30))])
    first = N.renewal_notices(t, AS_OF)
    assert first.count() == 1
    t2 = t.replace(notifications=append_rows(t.notifications, first, "Notif_ID", "M_ID"))
    assert N.renewal_notices(t2, AS_OF).count() == 0
    ina = N.inactive_member_notices(t, AS_OF)
    t3 = t.replace(notifications=append_rows(t.notifications, ina, "Notif_ID", "M_ID"))
    again = {r.M_ID: r.Message for r in N.inactive_member_notices(t3, AS_OF).collect()}
    assert again == {2: None}  # the never-active member repeats: NULL never matches LIKE


def test_expiry_overrides_reactivation_when_enabled(spark):  # T15
    t = _base(spark, member=[_member(1, join=dt.date(2022, 1, 1), active=False)],
              workout_log=[_log(1, 1, date=D(-1))])
    assert MT.refresh_activity_flag(t, AS_OF).first().IsActive is True
    assert MT.refresh_activity_flag(t, AS_OF, apply_expiry=True).first().IsActive is False


def test_stored_end_date_job_skips_null_end_dates(spark):  # T16
    t = _base(spark, member=[_member(1, join=dt.date(2023, 2, 1), end=None),
                             _member(2, join=dt.date(2023, 2, 1), end=dt.date(2024, 2, 1))])
    assert {r.M_ID for r in N.renewal_notices(t, AS_OF).collect()} == {1, 2}
    assert {r.M_ID for r in N.renewal_notices_stored_date(t, AS_OF).collect()} == {2}


def test_coach_context_counts_null_as_zero(spark):  # T17
    t = _base(spark, member=[_member(1)],
              workout_log=[_log(1, 1, dur=None, cal=None), _log(2, 1, dur=30, cal=Decimal("100.00"))])
    c = A.coach_context(t, AS_OF).first()
    assert c.avg_duration == 15.0 and c.avg_calories == 50.0 and c.total_calories == Decimal("100.00")
    assert M.avg_workout_duration(t, AS_OF).first().AvgWorkoutDuration == Decimal("30.00")


def test_trainer_report_rating_thresholds(spark):
    sessions = [(i, f"S{i}", D(1), "07:00:00", 30, 1, 5, "scheduled") for i in range(1, 21)]
    logs = [_log(100 + i, i, ex=BK, sid=i) for i in range(1, 11)]
    t = _base(spark, member=[_member(i) for i in range(1, 11)],
              trainer=[(1, "T1", "a@x", None, 1), (2, "T2", "b@x", "Yoga", 1)],
              session=sessions, workout_log=logs)
    rep = {r.Trainer_ID: r for r in R.trainer_report(t).collect()}
    assert rep[1].Performance_Rating == "Excellent" and rep[1].Avg_Session_Duration == Decimal("30.00")
    assert rep[2].Performance_Rating == "Needs Improvement" and rep[2].Total_Sessions == 0


def test_ci_option_merges_exercise_spellings(spark):  # T1
    logs = [_log(1, 1, ex="Run"), _log(2, 1, ex="run"), _log(3, 1, ex="RUN ")]
    t = _base(spark, member=[_member(1)], workout_log=logs)
    assert A.exercise_patterns(t, AS_OF).count() == 3
    ci = A.exercise_patterns(t, AS_OF, ci=True).collect()
    assert len(ci) == 1 and ci[0].frequency == 3
    assert R.priority_recommendation(t, AS_OF, ci=True).first().RecommendationType == "variety"


def test_sql_functions_match_column_helpers(spark):
    from fitlake.functions.sql_functions import register_sql_functions
    register_sql_functions(spark, prefix="t_")
    got = spark.sql("SELECT t_age_group(17), t_age_group(NULL), t_duration_hhmm(125), "
                    "t_duration_hhmm(6000), t_expiry_days(DATE'2024-01-31', 1, DATE'2024-01-30')").first()
    assert tuple(got) == ("Teen", "Senior", "02:05", "10:00", 30)


def test_ci_option_for_notice_dedupe(spark):  # T1, LIKE under a case-insensitive collation
    t = _base(spark, member=[_member(1)], workout_log=[_log(1, 1, date=D(-30))],
              notifications=[(1, 1, "WE MISS YOU, friend", "system", False, dt.datetime(2024, 1, 29))])
    assert N.inactive_member_notices(t, AS_OF).count() == 1
    assert N.inactive_member_notices(t, AS_OF, ci=True).count() == 0


def test_bmi_exact_half_up_on_ties(spark):
    t = _base(spark, member=[_member(1), _member(2)],
              health_metrics=[_hm(1, 1, D(0), w=Decimal("72.10"), h=Decimal("200.00")),
                              _hm(2, 2, D(0), w=Decimal("72.08"), h=Decimal("200.00"))])
    got = {r.M_ID: r.BMI for r in M.member_bmi(t).collect()}
    assert got == {1: Decimal("18.03"), 2: Decimal("18.02")}   # 18.025 -> 18.03, 18.02 exact


def test_session_reminders_take_any_text_in_details(spark):
    details = ["a\\b", "50% off", "x_y", "plain", None]
    sessions = [(i, x, D(1), "07:00:00", 30, 1, 5, "scheduled") for i, x in enumerate(details, 1)]
    log = [_log(i, i, ex=BK, sid=i, date=D(1)) for i in range(1, 6)]
    now = dt.datetime.combine(AS_OF, dt.time(8))
    said = [(1, 1, "about a\\b", "session_reminder", False, now), (2, 2, "50 percent off", "session_reminder", False, now),
            (3, 3, "about xzy", "session_reminder", False, now)]
    t = _base(spark, member=[_member(i) for i in range(1, 6)], trainer=[(1, "T", "t@x", None, 1)],
              session=sessions, workout_log=log, notifications=said)
    got = {r.M_ID for r in N.session_reminders(t, AS_OF).collect()}
    assert got == {4, 5}  # a backslash is itself, _ stands for one character, % for any run


def test_values_beyond_the_report_columns_stay(spark):
    far = [_log(i, 1, date=D(-30 + i)) for i in range(1, 330)]  # a score of over 999
    t = _base(spark, member=[_member(1)], workout_log=far,
              trainer=[(1, "T", "t@x", None, 1)], session=[(1, "S", D(1), "07:00:00", 5000, 1, 5, "scheduled")],
              health_metrics=[_hm(1, 1, D(0), w=Decimal("299.00"), h=Decimal("10.00"))])
    r = R.engagement_report(t, AS_OF).first()
    assert r.Engagement_Score == Decimal("1096.67") and r.Engagement_Level == "Highly Engaged"
    assert M.member_bmi(t).first().BMI == Decimal("29900.00")
    assert R.trainer_report(t).first().Avg_Session_Duration == Decimal("5000.00")


def test_order_key_with_wide_ids(spark):
    df = spark.createDataFrame([(D(0), 2 ** 62, "new"), (D(0), 5, "old"), (D(-1), 2 ** 63 - 1, "older")],
                               "Date date, id long, v string")
    assert df.agg(F.max_by("v", X.order_key("Date", "id"))).first()[0] == "new"


def test_bookings_with_negative_request_ids(spark):
    t = _base(spark, member=[_member(1)], trainer=[(1, "T", "t@x", None, 1)],
              session=[(1, "S", D(1), "07:00:00", 30, 1, 0, "scheduled")])
    req = spark.createDataFrame([(-5, 1, 1)], SC.BOOKING_REQUEST)
    assert W.apply_bookings(t, req).first().status == W.BOOK_FULL
