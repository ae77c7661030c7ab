"""Join helpers: broadcast only behind a size bound.

``join_small`` broadcasts the right side only when it is proven small:
either the caller states a bound it knows (a fixed literal list), or a
bounded count (``limit(n + 1).count()``, which stops reading after n + 1
rows) shows it.  Otherwise the join is left to the planner: a sort-merge
join, which AQE still turns into a broadcast join when the measured
shuffle output is small, and whose skewed partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows a broadcast side may hold (a dictionary or label list of this size is
# a few MB at most).
DEFAULT_BROADCAST_ROWS = 200_000


def has_at_most(df: DataFrame, n: int) -> bool:
    """True when ``df`` has no more than n rows; reads at most n + 1 rows."""
    return df.limit(n + 1).count() <= n


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once (reliable checkpoint in the shared checkpoint
    folder) so that a size check and several joins read it instead of
    recomputing it; also cuts its lineage."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder, in as many buckets
    of ``key`` as a shuffle has partitions: joins and groupings by ``key`` then
    shuffle the other side only, however often they are made.  The catalog
    keeps no entry.  Not to be put into a union that is grouped by ``key``:
    Spark 4.1.2 gave a key twice there."""
    from ..session import scratch_path

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "bucketed")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    (df.repartition(n, key).write.bucketBy(n, key).option("path", path)
       .option("compression", "zstd").format("parquet").saveAsTable(name))
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")          # an external table: its files stay
    return rows


def join_small(df: DataFrame, small: DataFrame, on, how: str = "left",
               known_rows: int | None = None,
               max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    if known_rows is not None and known_rows <= max_rows:
        return df.join(F.broadcast(small), on, how)
    if has_at_most(small, max_rows):
        return df.join(F.broadcast(small), on, how)
    return df.join(small, on, how)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin ``df`` over the cluster's default parallelism when it has
    fewer partitions than that (a small file read as one or two splits
    before CPU-heavy per-row work).  A large input already has more splits
    and is returned unchanged, so no full shuffle happens at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
