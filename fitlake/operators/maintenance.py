"""Table maintenance: UPDATE / DELETE statements and cursor jobs re-expressed
as new table versions (Parquet is immutable; persisting is the caller's
write, e.g. `save_tables`).  Deletes walk the foreign-key action graph."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlake.functions.exprs import DEFAULT_AS_OF, days_before, lit_date, midnight
from fitlake.sources import schema as SC
from fitlake.sources.tables import Tables


def _replace_col(df: DataFrame, name: str, value) -> DataFrame:
    return df.select(*[value.alias(c) if c == name else F.col(c) for c in df.columns])


def backfill_end_dates_type(t: Tables, type_id: int = 1, months: int = 12) -> DataFrame:
    """End date = JoinDate + `months` for members of one type with none set."""
    cond = (F.col("MembershipType_ID") == type_id) & F.col("MembershipEndDate").isNull()
    return _replace_col(t.member, "MembershipEndDate",
                        F.when(cond, F.add_months("JoinDate", months))
                        .otherwise(F.col("MembershipEndDate")))


def _end_date_fill(t: Tables) -> DataFrame:
    mt = t.membership_type.select("Type_ID", F.col("Duration").alias("_months"))
    return t.member.join(mt, F.col("MembershipType_ID") == F.col("Type_ID"), "left")


def backfill_end_dates(t: Tables) -> DataFrame:
    """Every member without an end date (and with a type) gets JoinDate +
    type duration.  Idempotent."""
    j = _end_date_fill(t)
    new = F.when(F.col("MembershipEndDate").isNull() & F.col("_months").isNotNull(),
                 F.add_months("JoinDate", F.col("_months"))).otherwise(F.col("MembershipEndDate"))
    return j.select(*[new.alias(c) if c == "MembershipEndDate" else F.col(c)
                      for c in t.member.columns])


def backfill_end_dates_result(t: Tables) -> DataFrame:
    n = _end_date_fill(t).agg(F.count(F.when(F.col("MembershipEndDate").isNull()
                                             & F.col("_months").isNotNull(), 1)).alias("n"))
    return n.select(F.concat(F.lit("Updated "), F.col("n").cast("string"),
                             F.lit(" member(s) with membership end dates")).alias("Result"))


def complete_past_sessions(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Scheduled sessions dated before as_of that have any log row -> completed."""
    used = t.workout_log.filter(F.col("S_ID").isNotNull()).select("S_ID").distinct() \
        .withColumn("_used", F.lit(True))
    j = t.session.join(used, "S_ID", "left")
    cond = (F.col("SessionDate") < lit_date(as_of)) & (F.col("Status") == "scheduled") \
        & F.col("_used").isNotNull()
    return j.select(*[F.when(cond, F.lit("completed")).otherwise(F.col(c)).alias(c)
                      if c == "Status" else F.col(c) for c in t.session.columns])


def complete_past_sessions_on_touch(t: Tables, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """The session trigger's intent ([T8]): past scheduled sessions -> completed."""
    cond = (F.col("SessionDate") < lit_date(as_of)) & (F.col("Status") == "scheduled")
    return _replace_col(t.session, "Status",
                        F.when(cond, F.lit("completed")).otherwise(F.col("Status")))


def mark_read(t: Tables, member_ids: DataFrame | None = None) -> DataFrame:
    """Unread notifications -> read (all members, or those in `member_ids`)."""
    n = t.notifications
    if member_ids is None:
        cond = F.col("IsRead") == F.lit(False)
        return _replace_col(n, "IsRead", F.when(cond, F.lit(True)).otherwise(F.col("IsRead")))
    ids = member_ids.select("M_ID").distinct().withColumn("_sel", F.lit(True))
    j = n.join(ids, "M_ID", "left")
    cond = F.col("_sel").isNotNull() & (F.col("IsRead") == F.lit(False))
    return j.select(*[F.when(cond, F.lit(True)).otherwise(F.col(c)).alias(c) if c == "IsRead"
                      else F.col(c) for c in n.columns])


def refresh_activity_flag(t: Tables, as_of: dt.date = DEFAULT_AS_OF, days: int = 60,
                          apply_expiry: bool = False) -> DataFrame:
    """IsActive = NOT (last log date < as_of - days); no log at all -> active
    ([T5]).  `apply_expiry` also runs the member-update renewal rule, which
    deactivates expired memberships ([T15])."""
    last = t.workout_log.groupBy("M_ID").agg(F.max("Date").alias("_last"))
    j = t.member.join(last, "M_ID", "left")
    flag = F.when(F.col("_last") < days_before(as_of, days), F.lit(False)).otherwise(F.lit(True))
    if apply_expiry:
        mt = t.membership_type.select("Type_ID", F.col("Duration").alias("_months"))
        j = j.join(mt, F.col("MembershipType_ID") == F.col("Type_ID"), "left")
        flag = F.when(F.add_months("JoinDate", F.col("_months")) < lit_date(as_of), F.lit(False)) \
            .otherwise(flag)
    return j.select(*[flag.alias(c) if c == "IsActive" else F.col(c) for c in t.member.columns])


def _old_read(as_of: dt.date, days: int):
    return F.coalesce((F.col("IsRead") == F.lit(True))
                      & (F.col("CreatedAt") < midnight(as_of - dt.timedelta(days=days))),
                      F.lit(False))


def purge_read_notifications(t: Tables, as_of: dt.date = DEFAULT_AS_OF,
                             days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): read notifications older than `days` are removed;
    the removed side is the archive copy.  Complementary null-safe filters."""
    cond = _old_read(as_of, days)
    return t.notifications.filter(~cond), t.notifications.filter(cond)


def purge_read_notifications_result(t: Tables, as_of: dt.date = DEFAULT_AS_OF,
                                    days: int = 90) -> DataFrame:
    n = t.notifications.agg(F.count(F.when(_old_read(as_of, days), 1)).alias("n"))
    return n.select(F.concat(F.lit("Cleaned up "), F.col("n").cast("string"),
                             F.lit(" old notification(s)")).alias("Result"))


# ---- cascades ---------------------------------------------------------------

_PARENTS = {parent for _, _, parent, _, _ in SC.FK_GRAPH}


def cascade_delete(t: Tables, table: str, keys: DataFrame) -> Tables:
    """Delete rows of `table` whose primary key is in `keys` and apply the
    foreign-key actions down the graph (cascade = anti join, set null =
    left join + when).  Lazy: returns the new version of every table."""
    pk = SC.PRIMARY_KEYS[table]
    keys = keys.select(pk).distinct()
    frames = t.as_dict()
    for child, ccol, parent, _pcol, action in SC.FK_GRAPH:
        if parent != table:
            continue
        ck = keys.select(F.col(pk).alias(ccol))
        cur = frames[child]
        if action == "cascade":
            if child in _PARENTS:
                gone = cur.join(ck, ccol, "left_semi").select(SC.PRIMARY_KEYS[child])
                frames = cascade_delete(Tables(**frames), child, gone).as_dict()
            else:  # nothing refers to it: no need to know which rows went
                frames[child] = cur.join(ck, ccol, "left_anti")
        else:
            hit = ck.withColumn("_hit", F.lit(True))
            j = cur.filter(F.col(ccol).isNotNull()).join(hit, ccol, "left")
            frames[child] = j.select(*[F.when(F.col("_hit").isNotNull(), F.lit(None))
                                       .otherwise(F.col(c)).cast(cur.schema[c].dataType).alias(c)
                                       if c == ccol else F.col(c) for c in cur.columns]).unionByName(
                cur.filter(F.col(ccol).isNull()))
    frames[table] = frames[table].join(keys, pk, "left_anti")
    return Tables(**frames)


def table_counts(t: Tables) -> DataFrame:
    """Row count per table (and log rows whose session link is NULL)."""
    parts = [getattr(t, n).agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(n).alias("table_name"), "row_count") for n in SC.TABLE_NAMES]
    parts.append(t.workout_log.agg(F.count(F.when(F.col("S_ID").isNull(), 1)).alias("row_count"))
                 .select(F.lit("workout_log.S_ID is null").alias("table_name"), "row_count"))
    return reduce(DataFrame.unionByName, parts)


def remaining_rows(t: Tables) -> DataFrame:
    """(table_name, id, link): the key of every row, with the session of a log
    row and the gym or owner of the others: what cascades may touch."""
    links = {"gym": None, "membership_type": "Gym_ID", "member": "Gym_ID", "trainer": "Gym_ID", "admin": None,
             "session": "T_ID", "workout_log": "S_ID", "health_metrics": "M_ID", "notifications": "M_ID"}
    parts = [getattr(t, n).select(F.lit(n).alias("table_name"), F.col(SC.PRIMARY_KEYS[n]).alias("id"),
                                  (F.col(c) if c else F.lit(None)).cast("bigint").alias("link"))
             for n, c in links.items()]
    return reduce(DataFrame.unionByName, parts)


def purge_cancelled_sessions(t: Tables, as_of: dt.date = DEFAULT_AS_OF, days: int = 30) -> Tables:
    """Cancelled sessions older than `days` are deleted; log rows keep their
    row with S_ID set to NULL."""
    gone = t.session.filter((F.col("Status") == "cancelled")
                            & (F.col("SessionDate") < days_before(as_of, days))).select("S_ID")
    return cascade_delete(t, "session", gone)


def delete_inactive_members(t: Tables, as_of: dt.date = DEFAULT_AS_OF, days: int = 365) -> Tables:
    """Inactive members who joined more than `days` ago, with their log,
    metrics and notifications."""
    gone = t.member.filter((F.col("IsActive") == F.lit(False))
                           & (F.datediff(lit_date(as_of), F.col("JoinDate")) > days)).select("M_ID")
    return cascade_delete(t, "member", gone)


def _delete_by_id(t: Tables, table: str, requests: DataFrame, ok: str, missing: str):
    pk = SC.PRIMARY_KEYS[table]
    first = requests.groupBy(pk).agg(F.min("request_id").alias("_first"))
    exists = getattr(t, table).select(pk).distinct().withColumn("_found", F.lit(True))
    st = (requests.join(first, pk).join(exists, pk, "left")
          .select("request_id", pk,
                  F.when(F.col("_found").isNotNull() & (F.col("request_id") == F.col("_first")),
                         F.lit(ok)).otherwise(F.lit(missing)).alias("status")))
    return st, cascade_delete(t, table, requests.select(pk))


def delete_members(t: Tables, requests: DataFrame) -> tuple[DataFrame, Tables]:
    """(statuses, new tables); a later request for an already deleted id
    finds nothing, like a second DELETE."""
    return _delete_by_id(t, "member", requests, "Member deleted successfully.", "Member not found")


def delete_trainers(t: Tables, requests: DataFrame) -> tuple[DataFrame, Tables]:
    return _delete_by_id(t, "trainer", requests, "Trainer deleted successfully.",
                         "Trainer not found")
