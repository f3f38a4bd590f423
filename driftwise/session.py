"""Spark session helpers.

The library never creates a session behind the caller's back: every job takes
a ``SparkSession``.  ``local_session`` exists for tests and ``bench.py`` only.
On a cluster the checkpoint directory comes from ``spark.checkpoint.dir`` (a
shared folder the cluster names); ``ensure_checkpoint_dir`` only fills it in
when it is unset, as in tests.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Session settings every job in this library assumes (UTC clock, ANSI on, AQE on).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "driftwise") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("DRIFTWISE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder; create a scratch one only when unset (tests, local runs)."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect sessions have no SparkContext: use the conf value only
        sc = None
    current = (sc.getCheckpointDir() if sc is not None else None) or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="driftwise-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(path)
    return path
