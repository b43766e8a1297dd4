"""Session helpers: recommended settings and the shared checkpoint folder.

The library never owns the session; callers pass one in. ``configure`` only fills in
settings that are unset, so a cluster's own configuration always wins.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

RECOMMENDED = {
    # Broadcast only tables with a proven size bound: the library hints the fixed
    # dimensions itself; nothing is broadcast because an estimate looked small.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed loan split by the skew-join rule may need one more (small, partially
    # aggregated) shuffle before the note aggregate; that is cheaper than one huge task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


# JVM options for driver and executors (set at launch; a running session cannot change
# them). The note pipeline fuses the aggregate's output with the principal, reserve,
# waterfall and progress projections into one generated method of about 10 KB; HotSpot does
# not JIT-compile methods over 8000 bytes unless told to, and interpreted it runs 2-3x slower.
JVM_OPTIONS = "-XX:-DontCompileHugeMethods"


def configure(spark: SparkSession, force: bool = False) -> SparkSession:
    """Apply RECOMMENDED settings the session has not set explicitly (all with ``force``).

    A setting counts as explicit when it is in the session's or the context's conf;
    Spark's built-in defaults do not count.
    """
    explicit = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for key, value in RECOMMENDED.items():
        if force or key not in explicit:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; an error when none is named."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(current)
    return current


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "notewise"):
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # Python call-site capture for error messages costs a stack walk and JVM
        # round-trips per API call; plan building is several times faster without it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("NOTEWISE_DRIVER_MEMORY", "8g"))
        .config("spark.driver.extraJavaOptions", JVM_OPTIONS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
