"""What has changed between two versions of a table, and the rules that a
change fires.

The versions are compared by digest first: only keys and 128-bit digests are
shuffled, and whole rows are read again for the keys that differ.  Values are
compared null-safe, and the digests tell a NULL from a missing neighbour.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.functions.exprs import DEFAULT_AS_OF
from fitlake.operators import notices as N
from fitlake.operators import rules as R
from fitlake.operators.common import booking_counts
from fitlake.sources import schema as SC
from fitlake.sources.tables import Tables


def _digest(columns: list[str], salt: int) -> Column:
    # xxhash64 passes over NULLs, so whether a value is one goes in as well
    return F.xxhash64(F.lit(salt), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change, columns, old, new) for each key (unique within a version,
    not NULL) whose rows differ: `change` is "insert", "update" or "delete",
    `columns` the names of the columns that an update has changed, in the
    table's order (empty for the others), `old` and `new` the whole rows."""
    names = [c for c in old.columns if c != key]
    if set(old.columns) != set(new.columns):
        raise ValueError("the versions have different columns")

    def digests(df: DataFrame, side: str) -> DataFrame:
        return df.select(key, _digest(names, 1).alias(f"_{side}1"), _digest(names, 2).alias(f"_{side}2"))

    both = digests(old, "o").unionByName(digests(new, "n"), allowMissingColumns=True)
    # one row a key and side; NULL: not there
    keys = (both.groupBy(key).agg(*[F.max(c).alias(c) for c in ("_o1", "_o2", "_n1", "_n2")])
            .filter(~(F.col("_o1").eqNullSafe(F.col("_n1")) & F.col("_o2").eqNullSafe(F.col("_n2"))))
            .select(key).checkpoint(eager=True))

    def rows(df: DataFrame, side: str) -> DataFrame:
        return df.join(keys, key, "left_semi").select(key, F.struct(*old.columns).alias(side))

    pair = rows(old, "old").join(rows(new, "new"), key, "full_outer")
    differs = F.array(*[F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c)) for c in names])
    change = (F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update"))
    return (pair.withColumn("change", change)
            .select(key, "change", F.when(F.col("change") == "update", F.array_compact(differs))
                    .otherwise(F.array().cast("array<string>")).alias("columns"), "old", "new"))


def table_changes(old: Tables, new: Tables, table: str) -> DataFrame:
    return changes(getattr(old, table), getattr(new, table), SC.PRIMARY_KEYS[table])


def _of(diff: DataFrame, *kinds: str) -> DataFrame:
    """The new rows of changes of these kinds."""
    return diff.filter(F.col("change").isin(*kinds)).select("new.*")


def fired_notices(old: Tables, new: Tables, as_of: dt.date = DEFAULT_AS_OF, ci: bool = False) -> DataFrame:
    """Notices that the rules write as `old` becomes `new`: (rule, row_id,
    M_ID, Message, Type, IsRead, CreatedAt), `row_id` the changed row for rules
    that fire for each row, else NULL.

    * update of a member: renewal notice;
    * update of a metric row: low-engagement notice, one a member;
    * insert into the log: milestones, and the welcome for a first row.
      Inserted rows follow the stored ones in the order of their ids."""
    member = _of(table_changes(old, new, "member"), "update").select("M_ID")
    metric = _of(table_changes(old, new, "health_metrics"), "update").select("M_ID").distinct()
    log = _of(table_changes(old, new, "workout_log"), "insert").select("L_ID", "M_ID").checkpoint(eager=True)
    # running counts are needed of the members with a new row only
    theirs = new.replace(workout_log=new.workout_log.join(log.select("M_ID").distinct(), "M_ID", "left_semi"))
    inserted = log.select("L_ID")
    parts = {
        "member_update": N.renewal_notice_on_touch(new, member, as_of),
        "metric_update": N.low_engagement_notice(new, metric, as_of, ci),
        "milestone": N.workout_milestones(theirs, as_of).join(inserted, "L_ID", "left_semi"),
        "welcome": N.first_workout_welcome(theirs, as_of).join(inserted, "L_ID", "left_semi"),
    }
    out = []
    for rule, df in parts.items():
        row = F.col("L_ID") if "L_ID" in df.columns else F.lit(None).cast("long")
        out.append(df.select(F.lit(rule).alias("rule"), row.cast("long").alias("row_id"), "M_ID", "Message", "Type",
                             "IsRead", "CreatedAt"))
    return reduce(DataFrame.unionByName, out)


def fired_violations(old: Tables, new: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """(table_name, row_id, violation): inserted and updated rows that the
    rules before a write turn away (range rules; age of members; past sessions
    and full ones for inserted bookings)."""
    metric = R.validate_health_metrics(_of(table_changes(old, new, "health_metrics"), "insert", "update"))
    member = R.validate_member_age(_of(table_changes(old, new, "member"), "insert", "update"))
    log = table_changes(old, new, "workout_log").select("L_ID", "change").filter("change = 'insert'")
    # seats depend on all bookings of the sessions that inserted rows name
    inserted = new.workout_log.join(log.select("L_ID"), "L_ID", "left_semi").checkpoint(eager=True)
    places = inserted.filter(F.col("S_ID").isNotNull()).select("S_ID").distinct()
    taken = R.judged_after(booking_counts(old.workout_log.join(places, "S_ID", "left_semi"), "n"),
                           inserted, new.session, as_of)
    return reduce(DataFrame.unionByName, [
        df.filter("violation is not null").select(F.lit(table).alias("table_name"),
                                                  F.col(SC.PRIMARY_KEYS[table]).cast("long").alias("row_id"), "violation")
        for table, df in (("health_metrics", metric), ("member", member), ("workout_log", taken))])


def after_rules(old: Tables, new: Tables, as_of: dt.date = DEFAULT_AS_OF) -> tuple[DataFrame, DataFrame]:
    """(members, sessions) of `new` after the rules that change a touched row:
    an updated member past the renewal date turns inactive, an updated past
    session that is still scheduled is completed.  Other rows stay as they are."""
    m = _of(table_changes(old, new, "member"), "update").select("M_ID").checkpoint(eager=True)
    member = N.renewal_flag_on_touch(new, m, as_of).unionByName(new.member.join(m, "M_ID", "left_anti"))
    s = _of(table_changes(old, new, "session"), "update").select("S_ID").withColumn("_touched", F.lit(True))
    past = F.col("_touched") & (F.col("SessionDate") < F.lit(as_of)) & (F.col("Status") == "scheduled")
    session = new.session.join(s, "S_ID", "left").withColumn(
        "Status", F.when(past, F.lit("completed")).otherwise(F.col("Status"))).select(*new.session.columns)
    return member, session
