"""Structured Streaming forms of the write-time rules, each with a batch twin
whose output matches on a bounded replay.

* `stream_validate`        stateless rule projection; foreachBatch to valid /
                           quarantine Parquet sinks (idempotent per batch id).
* `stream_daily_calories`  1-day tumbling window with a watermark.
* `stream_notice_dedupe`   `dropDuplicatesWithinWatermark` on (M_ID, Type).

`replay` feeds a sequence of batch frames through a file source, each frame
read by parallel tasks.  Rules whose state is a table are in `ledgers`.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitlake.functions.exprs import DEFAULT_AS_OF
from fitlake.operators.rules import first_violation, workout_range_rules
from fitlake.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def slices(df: DataFrame, order_col: str, n: int) -> list[DataFrame]:
    """`df` as `n` frames by ranges of `order_col` (rows without one first)."""
    bounds = sorted(set(df.approxQuantile(order_col, [i / n for i in range(1, n)], 0.001)))
    c, out = F.col(order_col), []
    for lo, hi in zip([None, *bounds], [*bounds, None]):
        part = df if lo is None else df.filter(c > lo)
        out.append(part if hi is None else part.filter((c <= hi) | c.isNull() if lo is None else c <= hi))
    return out


def replay(spark: SparkSession, parts: list[DataFrame], start, schema: T.StructType) -> None:
    """Feeds the frames to a stream one after another: each is written by all
    its tasks into the stream's folder, and `start(stream, checkpoint)` is run
    on it until nothing is left.  The checkpoint carries state, watermark and
    offsets from one to the next, so frames arrive in order while the files of
    one frame are read in parallel."""
    src, ck = scratch(spark, "replay"), scratch(spark, "replay-ck")
    for part in parts:
        part.write.mode("append").parquet(src)
        _run(start(_file_stream(spark, src, schema), ck))


def _file_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:  # pragma: no cover - surfaced to caller
        raise query.exception()


# ---- validate -------------------------------------------------------------

def stream_validate(stream: DataFrame, valid_path: str, quarantine_path: str, checkpoint: str,
                    as_of: dt.date = DEFAULT_AS_OF, available_now: bool = True):
    """Stateless: every micro-batch is split into valid rows and quarantined
    rows (with the first violated rule).  Writes are keyed by batch id, so a
    retried batch overwrites its own output instead of duplicating it."""
    flagged = stream.withColumn("violation", first_violation(*workout_range_rules(as_of)))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        (batch.filter(F.col("violation").isNull()).drop("violation")
         .write.mode("overwrite").parquet(f"{valid_path}/batch_{batch_id}"))
        (batch.filter(F.col("violation").isNotNull())
         .write.mode("overwrite").parquet(f"{quarantine_path}/batch_{batch_id}"))
        batch.unpersist()

    w = flagged.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


# ---- windowed calories ------------------------------------------------------

def stream_daily_calories(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Per member and day: sum of non-NULL calories over a 1-day tumbling
    window of the workout date.  In append mode a day is emitted once the
    watermark passes its end and its state is then dropped; rows arriving
    later than the watermark are not guaranteed to count (Spark's lateness
    guarantee is one-directional)."""
    ev = (stream.filter(F.col("CaloriesBurnt").isNotNull())
          .withColumn("ts", F.col("Date").cast("timestamp")))
    return (ev.withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 day"), "M_ID")
            .agg(F.sum("CaloriesBurnt").alias("daily_calories"))
            .select("M_ID", F.col("window.start").cast("date").alias("Date"), "daily_calories"))


# ---- notice de-duplication ----------------------------------------------------

def stream_notice_dedupe(stream: DataFrame, within: str = "7 days") -> DataFrame:
    """At most one notice per (member, type) within the watermark delay."""
    ev = stream.withColumn("ts", F.col("CreatedAt").cast("timestamp"))
    return ev.withWatermark("ts", within).dropDuplicatesWithinWatermark(["M_ID", "Type"]).drop("ts")


# ---- drivers used by the registry / tests -----------------------------------

def replay_to_table(spark: SparkSession, parts: list[DataFrame], schema: T.StructType, transform) -> DataFrame:
    """`replay` into Parquet in append mode under the shared checkpoint dir;
    returns the result as a batch frame."""
    out = scratch(spark, "stream-out")
    result: list[T.StructType] = []

    def start(stream: DataFrame, ck: str):
        df = transform(stream)
        result.append(df.schema)
        return (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
                .outputMode("append").trigger(availableNow=True).start())

    replay(spark, parts, start, schema)
    return spark.read.schema(result[0]).parquet(out)


def run_to_table(spark: SparkSession, streaming_df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming frame to completion (availableNow) into Parquet under
    the shared checkpoint dir and return the result as a batch frame."""
    out = scratch(spark, "stream-out")
    ck = scratch(spark, "stream-ck")
    if mode == "append":
        q = (streaming_df.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ck).outputMode("append")
             .trigger(availableNow=True).start())
        _run(q)
        return spark.read.schema(streaming_df.schema).parquet(out)
    # complete / update: keep the last emitted version of the result table
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (streaming_df.writeStream.foreachBatch(sink).option("checkpointLocation", ck)
         .outputMode(mode).trigger(availableNow=True).start())
    _run(q)
    return spark.read.schema(streaming_df.schema).parquet(out)
