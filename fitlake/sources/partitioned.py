"""Fact tables stored in monthly partitions, and new versions that write only
the partitions they touch.

A maintenance step changes a few rows of a large table.  Instead of writing
the whole table anew, the partitions (months) that hold a changed, new or
removed row are overwritten and the others keep their files.  Partitions are
staged and moved into place when the job commits; one that has lost all its
rows is dropped.  Readers must not read a table while it is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitlake.operators.changes import changes
from fitlake.sources import schema as SC

#: The date by which each fact is partitioned.
PARTITION_DATES = {"workout_log": "Date", "health_metrics": "Date", "notifications": "CreatedAt"}
#: Name of the partition column, and of rows without a date.
MONTH, NO_DATE = "month", "none"


def month(table: str) -> Column:
    return F.coalesce(F.date_format(PARTITION_DATES[table], "yyyy-MM"), F.lit(NO_DATE))


def _placed(df: DataFrame, table: str) -> DataFrame:
    """Rows with their month, dealt so that a month is written by several
    tasks if it is large, and by few if it is small."""
    key = SC.PRIMARY_KEYS[table]
    out = df.withColumn(MONTH, month(table))
    return out.repartitionByRange(F.col(MONTH), F.col(key)).sortWithinPartitions(MONTH, key)


def save_partitioned(df: DataFrame, table: str, path: str) -> None:
    _placed(df, table).write.mode("overwrite").partitionBy(MONTH).parquet(f"{path}/{table}")


def load_partitioned(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The stored table.  A filter on the `month` column prunes partitions."""
    schema = T.StructType([*SC.SCHEMAS[table], T.StructField(MONTH, T.StringType())])
    return spark.read.schema(schema).parquet(f"{path}/{table}")


def touched_months(old: DataFrame, new: DataFrame, table: str) -> list[str]:
    """Months with a row that is new, gone or different: a short list, one
    entry for each month of the table's span at most."""
    diff = changes(old, new, SC.PRIMARY_KEYS[table])
    date = PARTITION_DATES[table]
    sides = F.array(F.struct(F.col("old").isNotNull().alias("has"), F.col(f"old.{date}").alias(date)),
                    F.struct(F.col("new").isNotNull().alias("has"), F.col(f"new.{date}").alias(date)))
    rows = diff.select(F.explode(sides).alias("s")).select("s.*").filter("has")
    return sorted(r.m for r in rows.select(month(table).alias("m")).distinct().collect())


def write_version(spark: SparkSession, new: DataFrame, table: str, path: str) -> list[str]:
    """Makes the table stored under `path` hold the rows of `new` (a version
    derived from it, say) and returns the months that it has written."""
    old = load_partitioned(spark, table, path).drop(MONTH)
    months = touched_months(old, new, table)
    if not months:
        return []
    here = _placed(new.filter(month(table).isin(months)), table).checkpoint(eager=True)
    here.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(f"{path}/{table}")
    left = {r[MONTH] for r in here.select(MONTH).distinct().collect()}
    jvm = spark.sparkContext._jvm
    for m in months:
        if m not in left:  # nothing was written there: no rows are left
            folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{table}/{MONTH}={m}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return months
