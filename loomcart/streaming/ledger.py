"""Streams that remember in a compacted log instead of keyed state.

* J4 ``reservation_by_ledger``: every micro-batch runs the distributed ordered
  fold; the stock it leaves is written for the products it touched only.
* J3 ``confirm_once_for_ever``: an id that was confirmed is never confirmed
  again, however long ago and through whatever restarts.
* J5 ``patch_messages``: patches and confirmation calls of orders are folded
  onto each order's last state, and messages are built from the merged rows.

Every step is a function of the batch and of what earlier batches wrote, and
overwrites its own outputs: a retried batch adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.reserve import reserve_stock
from ..session import ensure_checkpoint_dir
from .batchlog import BatchLog, newest

Step = Callable[[DataFrame, int], None]


# J4 -------------------------------------------------------------------------
def stock_log(spark: SparkSession, state_dir: str, compact_every: int = 20) -> BatchLog:
    return BatchLog(spark, f"{state_dir}/stock", "id long, stock long", newest("id"), compact_every)


def stock_as_of(products: DataFrame, changes: DataFrame) -> DataFrame:
    """``products`` with the newest stock of the log's rows."""
    last = newest("id")(changes).select("id", F.col("stock").alias("__last"))
    return products.join(last, "id", "left").withColumn(
        "stock", F.coalesce("__last", "stock").cast(products.schema["stock"].dataType)).drop("__last")


def reservation_step(products: DataFrame, log: BatchLog, sink: str) -> Step:
    """Serves a micro-batch of requests from the stock that earlier batches
    left; outcomes go to one folder per batch, touched products to the log."""
    def step(batch: DataFrame, batch_id: int) -> None:
        wanted = batch.select(F.col("product_id").alias("id")).distinct()
        stock = stock_as_of(products.select("id", "stock").join(wanted, "id", "left_semi"),
                            log.before(batch_id).join(wanted, "id", "left_semi"))
        outcomes, _ = reserve_stock(stock, batch)
        outcomes.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        done = log.spark.read.schema(outcomes.schema).parquet(f"{sink}/batch={batch_id}")
        # Accepted requests only lower the stock: the least is the last.
        log.write(done.where("accepted").groupBy(F.col("product_id").alias("id")).agg(
            F.min("remaining_after").alias("stock")), batch_id)
    return step


def reservation_by_ledger(requests: DataFrame, products: DataFrame, state_dir: str, sink: str,
                          checkpoint: str, compact_every: int = 20) -> BatchLog:
    """Streaming reservation (request_id, product_id, qty, ts) by micro-batch;
    returns the log of the stock (see :func:`stock_as_of`)."""
    from .reservations import run_available_now

    log = stock_log(requests.sparkSession, state_dir, compact_every)
    run_available_now(requests, sink, checkpoint, foreach_batch=reservation_step(products, log, sink))
    return log


# J3 -------------------------------------------------------------------------
def seen_log(spark: SparkSession, state_dir: str, key: str, kind: str = "string",
             compact_every: int = 50) -> BatchLog:
    return BatchLog(spark, f"{state_dir}/seen", f"{key} {kind}, bucket int",
                    newest(key), compact_every, partition_by=("bucket",))


def confirm_step(log: BatchLog, sink: str, key: str, order: str = "ts", buckets: int = 64) -> Step:
    """Writes the first call (by ``order``) of each id that no earlier batch
    has confirmed.  Ids are kept by bucket; a batch reads the buckets of its
    own ids (at most ``buckets`` numbers reach the driver)."""
    def step(batch: DataFrame, batch_id: int) -> None:
        ensure_checkpoint_dir(log.spark)
        others = [c for c in batch.columns if c != key]
        first = batch.where(F.col(key).isNotNull()).groupBy(key).agg(
            F.min_by(F.struct(*others), order).alias("__first")).select(
                key, *[F.col("__first")[c].alias(c) for c in others],
                F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")).checkpoint(eager=True)
        touched = [r.bucket for r in first.select("bucket").distinct().collect()]
        seen = log.before(batch_id).where(F.col("bucket").isin(touched))
        fresh = first.join(seen.select(key, "bucket"), [key, "bucket"], "left_anti")
        fresh.select(*batch.columns, "bucket").write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        done = log.spark.read.schema(fresh.select(*batch.columns, "bucket").schema).parquet(f"{sink}/batch={batch_id}")
        log.write(done.select(key, "bucket"), batch_id)
    return step


def confirm_once_for_ever(calls: DataFrame, state_dir: str, sink: str, checkpoint: str,
                          key: str = "razorpay_order_id", order: str = "ts",
                          buckets: int = 64, compact_every: int = 50) -> BatchLog:
    """One confirmation per id over the whole life of ``state_dir``."""
    from .reservations import run_available_now

    log = seen_log(calls.sparkSession, state_dir, key, calls.schema[key].dataType.simpleString(), compact_every)
    run_available_now(calls, sink, checkpoint, foreach_batch=confirm_step(log, sink, key, order, buckets))
    return log


# J5 -------------------------------------------------------------------------
PATCHED = K.ORDER_PATCH_FIELDS


def order_log(spark: SparkSession, state_dir: str, compact_every: int = 20) -> BatchLog:
    fields = ", ".join(f"{f} string" for f in PATCHED)
    return BatchLog(spark, f"{state_dir}/orders", f"id long, {fields}", newest("id"), compact_every)


def folded_patches(orders: DataFrame, patches: DataFrame) -> DataFrame:
    """Each patch with the order's fields after it, ``kinds``, the events it
    gives rise to, and ``newest``, whether it is the order's last.

    patches: seq, id, call ('patch' or 'confirm') and the patched fields; a
    NULL field keeps the old value.  A confirmation call promotes an order
    that is 'received' at that moment and does nothing else.  Patches of ids
    that are no orders are left out.

    Since the last patch that set a status, only the first confirmation call
    can promote, and only if that status is 'received'; so running aggregates
    over an order's patches suffice.
    """
    was = orders.select("id", *[F.col(f).alias(f"__{f}") for f in PATCHED])
    p = patches.select("seq", "id", "call", *[
        F.when(F.col("call") == "patch", F.col(f)).alias(f) for f in PATCHED]).join(was, "id")
    upto = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    sets, confirms = F.col("status").isNotNull(), (F.col("call") == "confirm").cast("long")
    p = p.withColumn("__n", F.sum(confirms).over(upto))
    p = p.withColumn("__since", F.col("__n") - F.coalesce(
        F.last(F.when(sets, F.col("__n")), ignorenulls=True).over(upto), F.lit(0)))
    p = p.withColumn("__set", F.coalesce(F.last("status", ignorenulls=True).over(upto), F.col("__status")))
    open_ = F.coalesce(F.col("__set") == K.STATUS_RECEIVED, F.lit(False))
    promoted = (F.col("call") == "confirm") & open_ & (F.col("__since") == 1)
    after = F.when(open_ & (F.col("__since") > 0), F.lit(K.STATUS_CONFIRMED)).otherwise(F.col("__set"))
    kinds = F.when(promoted, F.array(F.lit("new_order"), F.lit("confirmed"))).when(
        F.col("status").isin("confirmed", "shipped"), F.array("status")).otherwise(F.array().cast("array<string>"))
    merged = [F.coalesce(F.last(f, ignorenulls=True).over(upto), F.col(f"__{f}")).alias(f)
              for f in PATCHED if f != "status"]
    newest_ = F.lead(F.lit(True)).over(Window.partitionBy("id").orderBy("seq")).isNull().alias("newest")
    return p.select("seq", "id", kinds.alias("kinds"), newest_, after.alias("status"), *merged)


def patch_step(orders: DataFrame, log: BatchLog, to_messages: Callable[[DataFrame], DataFrame], sink: str) -> Step:
    """Folds a micro-batch of patches onto the orders' last states; the
    messages go to one folder per batch, the states of touched orders to the
    log.  Orders bucketed by id (``operators.joins.bucketed``) are not shuffled."""
    def step(batch: DataFrame, batch_id: int) -> None:
        wanted = batch.select("id").distinct()
        last = newest("id")(log.before(batch_id).join(wanted, "id", "left_semi")).drop("version").select(
            "id", *[F.col(f).alias(f"__{f}") for f in PATCHED], F.lit(True).alias("__known"))
        fields = [F.when(F.col("__known"), F.col(f"__{f}")).otherwise(F.col(f)).alias(f) for f in PATCHED]
        now = orders.select("id", *PATCHED).join(last, "id", "left").select("id", *fields)
        # Written by column: the messages and the log each read their part.
        folded = folded_patches(now, batch)
        folded.write.mode("overwrite").option("compression", "zstd").parquet(f"{log.path}/folded")
        folded = log.spark.read.schema(folded.schema).parquet(f"{log.path}/folded")
        events = orders.drop(*PATCHED).join(folded.where(F.size("kinds") > 0).drop("newest"), "id").withColumn(
            "kind", F.explode("kinds")).drop("kinds")
        to_messages(events).write.mode("overwrite").option("compression", "zstd").parquet(f"{sink}/batch={batch_id}")
        log.write(folded.where("newest").select("id", *PATCHED), batch_id)
    return step


def patch_messages(patches: DataFrame, orders: DataFrame, to_messages: Callable[[DataFrame], DataFrame],
                   state_dir: str, sink: str, checkpoint: str, compact_every: int = 20) -> BatchLog:
    """Messages of a stream of patches (seq, id, call, the patched fields);
    ``seq`` grows from batch to batch.  Returns the log of order states."""
    from .reservations import run_available_now

    log = order_log(patches.sparkSession, state_dir, compact_every)
    run_available_now(patches, sink, checkpoint, foreach_batch=patch_step(orders, log, to_messages, sink))
    return log
