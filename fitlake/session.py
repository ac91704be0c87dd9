"""Spark session settings used by tests, the bench and the entry point.

On a cluster the caller owns the session; these helpers only fill in settings
that are unset, so cluster-provided values (shuffle partitions, checkpoint
dir, broadcast threshold) always win.
"""

from __future__ import annotations

import os
import re
import tempfile
import time

from pyspark.sql import SparkSession

# Settings every operator relies on.  UTC keeps DATE/TIMESTAMP arithmetic
# identical to the SQL oracle; AQE re-plans joins from runtime sizes and splits
# skewed partitions (a single member may own a third of all log rows).
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Broadcast only what the optimizer can prove small (file statistics or
    # runtime shuffle sizes); beyond this the join stays sort-merge / hash.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Spark 4.1 joins a union's equally partitioned inputs partition by
    # partition, and fails if AQE has coalesced them differently.
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "fitlake") -> SparkSession:
    """Local session for tests / bench (cluster jobs pass their own session)."""
    os.environ.setdefault("TZ", "UTC")
    try:
        time.tzset()
    except AttributeError:  # pragma: no cover - non-POSIX
        pass
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("FITLAKE_DRIVER_MEM", "16g"))
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_defaults(spark)
    return spark


def ensure_defaults(spark: SparkSession) -> SparkSession:
    """Apply the operator-level defaults that are still unset on `spark`."""
    conf = spark.conf
    for k, v in _DEFAULTS.items():
        if k in ("spark.ui.enabled", "spark.ui.showConsoleProgress"):
            continue
        try:
            if k == "spark.sql.session.timeZone":
                conf.set(k, v)  # results depend on it; always UTC
            elif conf.get(k, None) is None:
                conf.set(k, v)
        except Exception:  # static conf on a running session
            pass
    checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect sessions have no SparkContext
        return None


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's `spark.checkpoint.dir` if set.

    Only a local session that has none (tests, one-machine runs) gets a fresh
    scratch folder; on a cluster executors would not see it, so there the
    setting is required.
    """
    sc = _context(spark)
    d = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not d:
        master = spark.conf.get("spark.master", "local")
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share "
                               f"(master is {master})")
        d = tempfile.mkdtemp(prefix="fitlake-ckpt-", dir=os.environ.get("FITLAKE_SCRATCH", "/tmp"))
        if sc is not None:
            sc.setCheckpointDir(d)
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # core conf may be read-only at runtime
            pass
    elif sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d
