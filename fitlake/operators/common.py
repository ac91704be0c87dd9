"""Building blocks shared by operators: per-key pre-aggregates, bounded
top-k, scalar bounds and distributed id assignment."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitlake.functions.exprs import is_booking
from fitlake.session import checkpoint_dir


def bookings(log: DataFrame) -> DataFrame:
    return log.filter(is_booking())


def booking_counts(log: DataFrame, name: str = "n_bookings") -> DataFrame:
    """Bookings per session, combined map-side before the shuffle."""
    return (bookings(log).filter(F.col("S_ID").isNotNull())
            .groupBy("S_ID").agg(F.count(F.lit(1)).alias(name)))


def log_rows_per_session(log: DataFrame, name: str = "n_rows") -> DataFrame:
    """Log rows (any kind) per session: the fan-out weight of a
    `Session LEFT JOIN WorkoutLog` without materialising the fan-out."""
    return (log.filter(F.col("S_ID").isNotNull())
            .groupBy("S_ID").agg(F.count(F.lit(1)).alias(name)))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int,
          rank_col: str | None = None) -> DataFrame:
    """First `k` rows per key in `order` (which must be unique per key).

    For k up to Spark's `windowGroupLimitThreshold`, the `row_number() <= k`
    filter with a literal k gets a partial WindowGroupLimit before the
    shuffle, so no key ships more than k rows per map task.  Above it, an
    exact salted two-stage top-k is used instead: rank within (key, salt)
    groups, then re-rank the at most salts x k survivors per key, so a hot key
    is split over as many tasks as there are shuffle partitions."""
    rc = rank_col or "_rn"
    spark = df.sparkSession
    threshold = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > threshold:
        salts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        salted = df.withColumn("_salt", F.pmod(F.hash(*[F.col(c) for c in df.columns]), F.lit(salts)))
        w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k)
              .drop("_salt", "_r1"))
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rc, F.row_number().over(w)).filter(F.col(rc) <= k)
    return out if rank_col else out.drop(rc)


def scalar_int(df: DataFrame, expr: Column, default: int = 0) -> int:
    """A single bounded number computed on the cluster (e.g. the largest
    session capacity).  Only the scalar reaches the driver."""
    v = df.agg(expr.alias("v")).first()["v"]
    return default if v is None else int(v)


def assign_ids(df: DataFrame, order_col: str | list[str], base: Column | int, id_col: str,
               only: Column | None = None) -> DataFrame:
    """Dense ids `base + 1, base + 2, …` in `order_col` order (unique),
    without a single-partition window: rows are range-partitioned and sorted
    within each partition; `monotonically_increasing_id` then yields the
    position inside the partition, offset by the prefix sums of partition
    sizes (a tiny one-row-per-partition frame, broadcast).

    With `only`, ids go to the rows where `only` is true (others get NULL):
    only those are ranged and sorted, the others pass beside."""
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    checkpoint_dir(df.sparkSession)  # the shared folder (set only if unset)
    # The range partitioner samples its input before the shuffle, which would
    # run the whole upstream plan twice: compute it once, lineage cut.
    src, rest = df.checkpoint(eager=True), None
    if only is not None:
        given = F.coalesce(only, F.lit(False))
        src, rest = src.filter(given), src.filter(~given).withColumn(id_col, F.lit(None).cast("bigint"))
    # Partition number and position are read twice below (rows and sizes).
    # They are stored first: planned twice, the range shuffle would sample
    # other bounds, and be coalesced otherwise, on the side that prunes columns.
    part = (src.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_lix", F.monotonically_increasing_id()
                        - F.shiftleft(F.col("_pid").cast("long"), 33) + 1)
            .checkpoint(eager=True))
    sizes = part.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).select("_pid", "_off")
    b = base if isinstance(base, Column) else F.lit(base)
    new_id = (b + F.col("_off") + F.col("_lix")).cast("bigint")
    # one row a partition: bounded by the number of shuffle partitions
    out = (part.join(F.broadcast(offs), "_pid")
           .withColumn(id_col, new_id)
           .drop("_pid", "_lix", "_off"))
    return out if rest is None else out.unionByName(rest)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again.  A
    checkpoint keeps the size that the optimizer has estimated, and a join's
    estimate is the product of its sides: where rounds build on each other, that
    number gets more digits than the driver can hold.  Files have their own size."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/fitlake-rounds/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Running functions that can be put together from parts of a key's rows.
_JOINED = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
           "max": (F.max, lambda a, b: F.greatest(a, b))}


def segments(df: DataFrame, keys: list[str], order: list[str], name: str = "_seg") -> DataFrame:
    """`df`, stored, with the number of the range of (keys, order) in which a
    row lies: ranges are of about equal size, so the rows of a hot key lie in
    many.  (Stored twice, like in `assign_ids`: the range partitioner samples
    its input, and the numbers are read more than once afterwards.)"""
    checkpoint_dir(df.sparkSession)
    src = df.checkpoint(eager=True)
    return (src.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
            .withColumn(name, F.spark_partition_id()).checkpoint(eager=True))


def running(df: DataFrame, keys: list[str], seg: str, order: list[str], cols: dict[str, tuple[str, Column]],
            before: bool = False) -> DataFrame:
    """Running sums ("sum") or greatest values ("max") of each key's rows in
    `order` (unique for a key), up to the row or, with `before`, up to the one
    before it.  A key's rows are handled segment by segment (`segments`), and
    each segment's result is put together with that of the key's earlier
    segments, so no task holds all rows of a hot key.  Null keys are keys."""
    tmp = df.withColumns({f"_x_{n}": c for n, (_, c) in cols.items()})
    inside = (Window.partitionBy(*keys, seg).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow))
    inner = tmp.withColumns({f"_i_{n}": _JOINED[f][0](f"_x_{n}").over(inside) for n, (f, _) in cols.items()})
    totals = tmp.groupBy(*keys, seg).agg(*[_JOINED[f][0](f"_x_{n}").alias(f"_x_{n}") for n, (f, _) in cols.items()])
    earlier = Window.partitionBy(*keys).orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, seg]],
                           *[_JOINED[f][0](f"_x_{n}").over(earlier).alias(f"_p_{n}") for n, (f, _) in cols.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, seg]]
    # merged: there may be as many keys as rows, too many to broadcast on a file's (compressed) size
    return inner.join(prefix.hint("merge"), same, "left").select(
        *df.columns, *[_JOINED[f][1](F.col(f"_p_{n}"), F.col(f"_i_{n}")).alias(n) for n, (f, _) in cols.items()])


def max_id(df: DataFrame, col: str) -> Column:
    """`COALESCE(MAX(col), 0)` as a lazy scalar subquery."""
    return df.select(F.coalesce(F.max(col), F.lit(0))).scalar()


def notice(df: DataFrame, message: Column, ntype: str, as_of: dt.date,
           extra: list[str] | None = None) -> DataFrame:
    """Notification rows (M_ID, Message, Type, IsRead=false, CreatedAt=as_of)."""
    cols = [F.col("M_ID").cast("bigint").alias("M_ID"), message.alias("Message"),
            F.lit(ntype).alias("Type"), F.lit(False).alias("IsRead"),
            F.lit(dt.datetime.combine(as_of, dt.time())).cast("timestamp_ntz").alias("CreatedAt")]
    return df.select(*(extra or []), *cols)


def append_rows(target: DataFrame, rows: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """INSERT with generated ids: `rows` get ids after `max(target.id_col)`
    in `order_col` order and are appended to `target` (columns aligned by
    name; columns missing from `rows` are NULL)."""
    new = assign_ids(rows, order_col, max_id(target, id_col), id_col)
    cols = [F.col(c).cast(target.schema[c].dataType).alias(c) if c in new.columns
            else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns]
    return target.unionByName(new.select(*cols))
