"""Spark session helpers.

The library never creates a session behind the caller's back; these helpers
exist for tests, the bench and the examples.  On a cluster the caller passes
its own session and its own ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter for every job here: UTC so timestamps compare with
# DuckDB and with the ISO text the shop writes, AQE on so small sides become
# broadcast joins only after their real size is known, skew-join splitting on.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "loomcart") -> SparkSession:
    """A local session for tests and benchmarks (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    shuffle_partitions = int(os.environ.get("LOOMCART_SHUFFLE_PARTITIONS", shuffle_partitions))
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    # For checks under another session time zone (the default is UTC).
    if os.environ.get("LOOMCART_SESSION_TZ"):
        b = b.config("spark.sql.session.timeZone", os.environ["LOOMCART_SESSION_TZ"])
    b = b.config("spark.driver.memory", os.environ.get("LOOMCART_DRIVER_MEM", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, setting one only where none is set.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only when neither the context nor the conf names one (local
    tests) do we fall back to a fresh local temporary folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError(
                "spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="loomcart-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder for intermediate tables."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/loomcart-{name}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Statements run in here delete their shuffle files when they end, for a
    job that writes a table and goes on from it; else the files stay until the
    driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
