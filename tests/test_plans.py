"""Plan regression tests: the scale properties the design relies on."""

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def static_plans(spark):
    from fitlake.plans.registry import queries
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = {n: fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
                 for n, fn in queries().items() if not n.startswith("stream_")}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    return plans


def test_no_sort_aggregation_or_python_in_batch_plans(static_plans):
    for name, plan in static_plans.items():
        # as-of lookups carry whole rows (structs) along; their greatest is found
        # in the order that the window beside it needs anyway
        assert "SortAggregate" not in plan or name == "weight_changes", name
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


# (apply_bookings ranks inside the checkpointed input of assign_ids, so its
# final plan only scans the checkpoint.)
@pytest.mark.parametrize("name", ["recent_workouts", "notification_inbox", "workout_milestones",
                                  "member_dashboard", "coach_context", "validate_log_rows"])
def test_top_k_is_bounded_before_the_shuffle(static_plans, name):
    assert "WindowGroupLimit" in static_plans[name]


@pytest.mark.parametrize("name", ["member_progress_summary", "member_metrics_panel",
                                  "priority_recommendation", "exercise_patterns", "coach_context"])
def test_date_window_reaches_the_log_scan(static_plans, name):
    assert "GreaterThanOrEqual(Date," in static_plans[name], name


def test_scans_are_column_pruned(static_plans):
    plan = static_plans["member_progress_summary"]
    assert "ReadSchema: struct<M_ID:bigint,Date:date,CaloriesBurnt:decimal(6,2)>" in plan


def test_columns_are_counted_one_by_one(static_plans):
    assert "Expand" not in static_plans["stored_tables"]


def test_null_session_keys_stay_out_of_joins(spark):
    """Broadcasts off: only booking rows are shuffled to sessions; each leaf
    table of a delete is shuffled once."""
    from fitlake.plans.registry import queries
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda n: queries()[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
        log = plan("validate_log_rows")
        rows = plan("delete_inactive_members_rows")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    scans = [x for x in log.splitlines() if "FileScan" in x and "workout_log" in x]
    assert len(scans) >= 2 and "IsNotNull(S_ID)" in log
    joined = [x for x in log.splitlines() if "SortMergeJoin" in x and "S_ID" in x]
    assert joined and "UnionExec" not in joined[0]
    assert rows.count("LeftAnti") == 4  # member and its three leaves, each once
