"""Dense surrogate ids without moving all rows to one task.

A global ``row_number()`` with no partition puts every row in one task.
Instead: fix the row layout (optionally sorted), number rows inside each
partition with ``monotonically_increasing_id`` (partition id in the high
bits, row position in the low 33 bits), count rows per partition, turn the
counts into offsets on a table with one row per partition, and add.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LOW_BITS = 33


def next_id_base(existing: DataFrame | None, id_col: str = "id") -> Column:
    """Scalar subquery: max existing id, 0 for an empty table."""
    if existing is None:
        return F.lit(0).cast("long")
    return F.coalesce(existing.agg(F.max(id_col).cast("long")).scalar(), F.lit(0).cast("long"))


def assign_ids(new: DataFrame, existing: DataFrame | None = None,
               order_by: list | None = None, id_col: str = "id",
               checkpoint: bool = True) -> DataFrame:
    """Give ``new`` dense ids max(existing.id)+1, +2, ... in ``order_by`` order
    (or the input's row order when no order is given).

    The numbered layout is checkpointed (reliable checkpoint in the shared
    checkpoint folder) so that a recomputation after an executor loss sees
    the same partition layout and hence the same ids.
    """
    spark = new.sparkSession
    df = new.orderBy(*order_by) if order_by else new
    df = df.withColumn("__m", F.monotonically_increasing_id())
    if checkpoint:
        ensure_checkpoint_dir(spark)
        df = df.checkpoint(eager=True)
    df = (df.withColumn("__pid", F.shiftright(F.col("__m"), _LOW_BITS))
            .withColumn("__pos", F.col("__m").bitwiseAND((1 << _LOW_BITS) - 1)))
    # One row per partition: a bounded table (the partition count).
    counts = df.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    base = next_id_base(existing, id_col)
    out = df.join(F.broadcast(offsets), "__pid")
    out = out.withColumn(id_col, (base + F.col("__off") + F.col("__pos") + 1).cast("long"))
    return out.drop("__m", "__pid", "__pos", "__off")
