"""As-of lookups: for each probe, the newest row of its key at or before it.

Probes and rows are put together in the order of their dates, and the newest
row so far is carried along as a running greatest value.  That is put together
from segments (`running`), so neither a key with a third of all rows nor a day
on which all probes fall is one task's work; every row is shuffled once,
whatever the number of dates asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlake.operators.common import running, segments
from fitlake.sources.tables import Tables


def as_of(probes: DataFrame, rows: DataFrame, key: str, probe_at: str, row_at: str, tie: str,
          values: list[str]) -> DataFrame:
    """`probes` with the columns `values` of the newest of `rows` with the same
    `key` and `row_at` <= `probe_at` (of several, that of the largest `tie`),
    whatever these columns hold; NULL without such a row.  NULL keys and dates
    have none.  Probes may repeat; the types of `probe_at` and `row_at` agree."""
    at = probes.schema[probe_at].dataType
    newest = F.struct(F.col(row_at).cast(at).alias("_at"), F.col(tie).alias("_tie"), F.struct(*values).alias("_values"))
    found = rows.filter(F.col(key).isNotNull() & F.col(row_at).isNotNull()).select(
        F.col(key).alias("_key"), F.col(row_at).cast(at).alias("_at"), F.lit(0).alias("_kind"), newest.alias("_row"))
    asked = probes.select(F.col(key).alias("_key"), F.col(probe_at).alias("_at"), F.lit(1).alias("_kind"),
                          F.struct(*probes.columns).alias("_probe"))
    line = found.unionByName(asked, allowMissingColumns=True).withColumn("_no", F.monotonically_increasing_id())
    order = ["_at", "_kind", "_no"]
    line = segments(line, ["_key"], order)
    carried = running(line, ["_key"], "_seg", order, {"_newest": ("max", F.col("_row"))})
    return carried.filter(F.col("_kind") == 1).select(
        "_probe.*", *[F.col(f"_newest._values.{v}").alias(v) for v in values])


def weight_changes(t: Tables, days: int = 30) -> DataFrame:
    """The weight-change function at the date of every log row: the weight as
    of that date less the weight as of `days` earlier, 0 if either is unknown.
    Output: L_ID, M_ID, Date, Weight, WeightBefore, WeightChange."""
    log = t.workout_log.select("L_ID", "M_ID", "Date")
    probes = log.select("*", F.explode(F.array(F.lit(0), F.lit(days))).alias("_back")) \
        .withColumn("_asked", F.expr("date_sub(Date, _back)"))
    got = as_of(probes, t.health_metrics, "M_ID", "_asked", "Date", "Metric_ID", ["Weight"])
    both = got.groupBy("L_ID").agg(
        F.first("M_ID").alias("M_ID"), F.first("Date").alias("Date"),
        F.max(F.when(F.col("_back") == 0, F.col("Weight"))).alias("Weight"),
        F.max(F.when(F.col("_back") == days, F.col("Weight"))).alias("WeightBefore"))
    return both.withColumn("WeightChange", F.coalesce(F.col("Weight") - F.col("WeightBefore"), F.lit(0))
                           .cast("decimal(6,2)"))
