"""Write-time rules over streams whose state is a table: what earlier batches
have left of each key (seats taken, workouts counted, newest notice).

Each micro-batch reads the state as of its own number, handles its rows as one
set (bounded top-k, no group in one Python call), and writes its result and its
contribution to the state into folders named by that number.  A batch that is
run again, after a lost driver or a failed write, reads the same state and
overwrites the same folders, so it counts once.  State needs no member or
session to be seen again, survives in the shared folder, and is put together
now and then so that a batch never reads many small contributions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitlake.functions.exprs import DEFAULT_AS_OF, is_booking, not_booking
from fitlake.operators import notices as N
from fitlake.operators import rules as R
from fitlake.operators.notice_runs import chosen_days
from fitlake.sources.tables import Tables

_HOW = {"sum": F.sum, "max": F.max}


class Ledger:
    """One value a key, kept as contributions by batch number that are put
    together by "sum" or "max"."""

    #: Batches after which the contributions so far are put together.
    EVERY = 16

    def __init__(self, spark: SparkSession, path: str, keys: list[T.StructField], value: T.StructField, how: str):
        self.spark, self.path, self.how = spark, path, _HOW[how]
        self.keys, self.value = [k.name for k in keys], value.name
        self.schema = T.StructType([*keys, value])

    def _read(self, names: list[str]) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        paths = []
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")
            if p.getFileSystem(conf).exists(p):  # complete folders only
                paths.append(f"{self.path}/{n}")
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _write(self, df: DataFrame, name: str) -> None:
        df = df.groupBy(*self.keys).agg(self.how(self.value).alias(self.value))
        df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.mode("overwrite").parquet(
            f"{self.path}/{name}")

    def start(self, df: DataFrame) -> None:
        """The state before the first batch."""
        self._write(df, "until_0")

    def before(self, batch_id: int) -> DataFrame:
        """(keys, value) of all batches before this one."""
        since = batch_id // self.EVERY * self.EVERY
        if batch_id == since and since:
            earlier = [f"until_{since - self.EVERY}", *[f"batch_{i}" for i in range(since - self.EVERY, since)]]
            self._write(self._read(earlier), f"until_{since}")
        names = [f"until_{since}", *[f"batch_{i}" for i in range(since, batch_id)]]
        return self._read(names).groupBy(*self.keys).agg(self.how(self.value).alias(self.value))

    def put(self, batch_id: int, df: DataFrame) -> None:
        self._write(df, f"batch_{batch_id}")


Sink = Callable[[DataFrame, int], None]


def start(stream: DataFrame, sink: Sink, checkpoint: str, available_now: bool = True):
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def _once(batch: DataFrame, out: str, batch_id: int, result: DataFrame) -> DataFrame:
    """`result`, written to the folder of this batch and read again."""
    path = f"{out}/batch_{batch_id}"
    result.write.mode("overwrite").parquet(path)
    return batch.sparkSession.read.schema(result.schema).parquet(path)


# ---- capacity ---------------------------------------------------------------

def seats_ledger(spark: SparkSession, path: str) -> Ledger:
    return Ledger(spark, path, [T.StructField("S_ID", T.LongType())], T.StructField("n", T.LongType()), "sum")


def admission_sink(session: DataFrame, seats: Ledger, out: str, as_of: dt.date = DEFAULT_AS_OF) -> Sink:
    """Every row of a batch of log rows, with `violation` by the rules of
    `validate_log_rows`, to `out`/batch_<id>; accepted bookings take their
    seats in `seats`.  Rows are judged in the order of batches and, within one,
    of L_ID."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        places = batch.filter(is_booking() & F.col("S_ID").isNotNull()).select("S_ID").distinct()
        here = session.join(places, "S_ID", "left_semi")
        taken = seats.before(batch_id).join(places, "S_ID", "left_semi")
        judged = _once(batch, out, batch_id, R.judged_after(taken, batch, here, as_of))
        accepted = judged.filter(is_booking() & F.col("S_ID").isNotNull() & F.col("violation").isNull())
        seats.put(batch_id, accepted.select("S_ID", F.lit(1).alias("n")))
    return sink


# ---- milestones --------------------------------------------------------------

def workouts_ledger(spark: SparkSession, path: str) -> Ledger:
    return Ledger(spark, path, [T.StructField("M_ID", T.LongType())], T.StructField("c", T.LongType()), "sum")


def milestone_sink(counts: Ledger, out: str, as_of: dt.date = DEFAULT_AS_OF, workouts_only: bool = False) -> Sink:
    """The notices of `workout_milestones` for a batch of log rows, given how
    many workouts each of its members had before."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        here = batch.select("M_ID", "L_ID", "Exercise")
        prior = counts.before(batch_id).join(here.select("M_ID").distinct(), "M_ID", "left_semi")
        _once(batch, out, batch_id, N.milestones_after(prior, here, as_of, workouts_only))
        counts.put(batch_id, here.filter(not_booking()).select("M_ID", F.lit(1).alias("c")))
    return sink


# ---- notices within seven days --------------------------------------------------

def notice_ledger(spark: SparkSession, path: str, stored: DataFrame) -> Ledger:
    """Newest notice of each member and type, `stored` ones first."""
    ledger = Ledger(spark, path, [T.StructField("M_ID", T.LongType()), T.StructField("Type", T.StringType())],
                    T.StructField("newest", T.DateType()), "max")
    ledger.start(stored.select("M_ID", "Type", F.to_date("CreatedAt").alias("newest")))
    return ledger


def notice_sink(newest: Ledger, out: str, id_col: str = "Notif_ID", days: int = 7) -> Sink:
    """Of a batch of notices (rows of Notifications), those whose member has no
    notice of the type from the `days` days before the notice's date on: stored
    ones, ones of earlier batches, or earlier ones of this batch, by CreatedAt
    and id.  At most one a day can pass, so a member's rows of a day are cut to
    the first before the choice among days."""
    keys = ("M_ID", "Type")

    def sink(batch: DataFrame, batch_id: int) -> None:
        day = F.to_date("CreatedAt")
        first = (batch.filter(F.col("CreatedAt").isNotNull()).withColumn("day", day).groupBy(*keys, "day")
                 .agg(F.min_by(F.struct(*batch.columns), F.struct("CreatedAt", id_col)).alias("row")))
        silenced = newest.before(batch_id).select(*keys, F.date_add("newest", days).alias("until"))
        due = first.select(*keys, F.col("day").alias("lo"), F.col("day").alias("hi"))
        chosen = chosen_days(due, silenced, None, None, gap=days + 1, keys=keys)
        kept = _once(batch, out, batch_id, first.join(chosen, [*keys, "day"], "left_semi").select("row.*"))
        newest.put(batch_id, kept.select(*keys, F.to_date("CreatedAt").alias("newest")))
    return sink


def results(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """What a sink has written so far."""
    return spark.read.schema(schema).parquet(f"{out}/batch_*")


def capacity_replay(t: Tables, parts: list[DataFrame], folder: str, replay, repeat: bool = False) -> DataFrame:
    """`admission_sink` over the frames `parts` one after another (`replay`);
    with `repeat` every batch is handled twice, as after a failure."""
    spark = t.session.sparkSession
    out, seats = f"{folder}/judged", seats_ledger(spark, f"{folder}/seats")
    sink = admission_sink(t.session, seats, out)

    def twice(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        if repeat:
            sink(batch, batch_id)

    replay(spark, parts, lambda stream, ck: start(stream, twice, ck), t.workout_log.schema)
    return results(spark, out, T.StructType([*t.workout_log.schema, T.StructField("violation", T.StringType())]))
