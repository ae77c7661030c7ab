"""Per-key row numbers without putting a hot key into one task.

``row_number() OVER (PARTITION BY k ORDER BY o)`` shuffles on ``k``, so a key
holding a third of all rows is numbered by a single task.  Here:

1. rows are range-partitioned on (k, o), sorted, and checkpointed, so every
   partition is a contiguous run of the global order and a hot key spans
   many partitions;
2. a plain aggregate per partition and key gives the first place and the
   number of rows of the key's share in each partition; a running sum over a
   key's partitions (never over its rows) tells how many come before;
3. a row's number is its place less the share's first place, plus that sum.

All of it is built-in expressions: carried columns of any type pass through
unchanged.

Keys are compared through a canonical JSON text of the key columns, so NULL
key values form one group, as in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

def keyed_row_number(df: DataFrame, keys: list[str], order: list[Column],
                     out: str = "rn", partitions: int | None = None) -> DataFrame:
    """``df`` with ``out`` = row_number() over (partition by keys order by order).

    ``order`` must make the order total (end with a unique column) for the
    numbering to be deterministic.
    """
    spark = df.sparkSession
    kcols = [F.col(k) for k in keys]
    with_key = df.withColumn("__k", F.to_json(F.struct(*[c.alias(f"k{i}") for i, c in
                                                          enumerate(kcols)])))
    ensure_checkpoint_dir(spark)
    # Without a given count, AQE sizes the range partitions (it merges
    # neighbouring small ones; the global order is kept).
    ranged = (with_key.repartitionByRange(partitions, *kcols, *order) if partitions
              else with_key.repartitionByRange(*kcols, *order))
    laid = (ranged
            .sortWithinPartitions(*kcols, *order)
            .withColumn("__m", F.monotonically_increasing_id())   # partition, then place in it
            .checkpoint(eager=True)
            .withColumn("__pid", F.shiftright("__m", 33)))
    counts = laid.groupBy("__pid", "__k").agg(F.count(F.lit(1)).alias("__c"), F.min("__m").alias("__first"))
    before = Window.partitionBy("__k").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", "__k", "__first",
                            F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    numbered = laid.join(offsets, ["__pid", "__k"])
    place = F.col("__m") - F.col("__first") + 1 + F.col("__off")
    return numbered.select(*df.columns, place.cast("long").alias(out))
