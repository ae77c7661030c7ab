"""Structured Streaming versions of the shop's time-driven jobs.

* J1 ``abandoned_reservations``: pending events LEFT OUTER JOIN paid events
  of the same key within the TTL window, watermarks on both sides; a
  pending event whose window closes without a payment is abandoned.
* J3 ``confirm_once``: one confirmation per gateway order id
  (``dropDuplicatesWithinWatermark``).
* J4 ``streaming_reservation``: first-come reservation with the remaining
  stock per product in keyed state (``transformWithStateInPandas``).  Rows
  of one key inside one micro-batch go to one task: the micro-batch size
  (``maxFilesPerTrigger`` / ``maxBytesPerTrigger``) bounds that group.
* J4 ``reservation_by_batches``: the same result with the distributed
  ordered fold run per micro-batch (a hot product is split over tasks) and
  the remaining stock kept in a log of touched products (``ledger``).
* J2 ``abandoned_with_timers``: J1 with explicit state and timers.
* J5 ``outbox_sink``: changed orders -> notification rows -> files, via an
  idempotent ``foreachBatch`` (each batch id writes its own folder with
  overwrite, so a retried batch replaces its output).

Event time must be TIMESTAMP (not TIMESTAMP_NTZ) for watermarks; inputs are
cast under the session time zone (UTC in tests).

Scale note: keyed streaming state (J1's join buffers, J2's and J3's state)
lives in the state-store partition of its key, so a hot key's events within
the TTL window plus the watermark delay are held by one task -- a bound
set by event rate x window, not by table size.  The batch-fold J4 is the
operator that splits a hot key within a micro-batch.
"""

from __future__ import annotations

import bisect
import contextlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def run_available_now(df: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet",
                      output_mode: str = "append",
                      foreach_batch: Callable | None = None) -> None:
    """Run a streaming query over everything available, then stop."""
    w = df.writeStream.option("checkpointLocation", checkpoint).outputMode(output_mode)
    if foreach_batch is not None:
        w = w.foreachBatch(foreach_batch)
    else:
        w = w.format(fmt).option("path", sink)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state_store(spark: SparkSession):
    """Keyed state needs this store: it is named while a query of ours runs,
    and the caller's setting is put back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


# J1 -------------------------------------------------------------------------
def abandoned_reservations(pending: DataFrame, paid: DataFrame, key: str = "user_id",
                           ttl: str = "20 hours", delay: str = "1 hour") -> DataFrame:
    """Streaming left outer join; unmatched pending rows are abandoned.

    pending / paid: (event_id, key, ts TIMESTAMP).  The join condition is an
    equality on the key plus an event-time range, so Spark can drop state
    once the watermark passes ``ts + ttl``.
    """
    l = pending.select(F.col("event_id").alias("pending_id"), F.col(key).alias("p_key"),
                       F.col("ts").alias("p_ts")).withWatermark("p_ts", delay)
    r = paid.select(F.col("event_id").alias("paid_id"), F.col(key).alias("q_key"),
                    F.col("ts").alias("q_ts")).withWatermark("q_ts", delay)
    cond = ((F.col("p_key") == F.col("q_key"))
            & (F.col("q_ts") >= F.col("p_ts"))
            & (F.col("q_ts") <= F.col("p_ts") + F.expr(f"INTERVAL {ttl}")))
    return l.join(r, cond, "leftOuter")


def stream_table(spark: SparkSession, folder: str, name: str, schema,
                 max_bytes: str | None = None) -> DataFrame:
    """A file stream over one table of a folder of ``<name>.parquet`` files
    (the file source needs a directory; the glob filter picks the table).
    ``max_bytes`` (e.g. "4g") limits the input of one micro-batch; files then
    have to arrive in event-time order up to the watermark delay."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(folder)


EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def stream_events(spark: SparkSession, folder: str, event_type: str) -> DataFrame:
    s = stream_table(spark, folder, "events", EVENTS)
    return (s.filter(F.col("event_type") == event_type)
            .select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")))


def abandoned_from_events(spark: SparkSession, folder: str, ttl: str = "20 hours",
                          delay: str = "1 hour") -> DataFrame:
    """J1 over an events folder (signup = pending, purchase = paid).

    Returns the abandoned signups found once the stream has run over all
    available files: (pending_id, user_id, ts)."""
    j = abandoned_reservations(stream_events(spark, folder, "signup"),
                               stream_events(spark, folder, "purchase"),
                               ttl=ttl, delay=delay)
    out = scratch_path(spark, "abandoned")
    # Matched pairs never reach the sink.
    j = j.filter(F.col("paid_id").isNull()).select(
        "pending_id", F.col("p_key").alias("user_id"), F.col("p_ts").alias("ts"))
    run_available_now(j, out + "/data", out + "/_ckpt")
    return spark.read.parquet(out + "/data")


# J3 -------------------------------------------------------------------------
def confirm_once(calls: DataFrame, key: str = "razorpay_order_id",
                 delay: str = "1 day") -> DataFrame:
    """Keep the first confirmation call per gateway id while its state lives
    (one watermark delay after the first call)."""
    return calls.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def confirm_once_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases as confirmation calls; a user's purchases on one day share a
    gateway order id (the checkout retried).  Returns the ids confirmed."""
    calls = stream_events(spark, folder, "purchase").withColumn(
        "razorpay_order_id",
        F.concat(F.lit("order_"), F.col("user_id").cast("string"), F.lit("_"),
                 F.date_format("ts", "yyyyMMdd")))
    out = scratch_path(spark, "confirm")
    run_available_now(confirm_once(calls).select("razorpay_order_id"),
                      out + "/data", out + "/_ckpt")
    return spark.read.parquet(out + "/data")


# J4 -------------------------------------------------------------------------
RESERVE_OUT = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("product_id", T.LongType()),
    T.StructField("qty", T.LongType()), T.StructField("accepted", T.BooleanType()),
    T.StructField("remaining_after", T.LongType()),
])


def _reservation_processor():
    from pyspark.sql.streaming import StatefulProcessor

    class Reserve(StatefulProcessor):
        """Remaining stock of a block's products in a ValueState; rows of a
        batch are served in arrival order (ts, request_id)."""

        def init(self, handle) -> None:
            self.remaining = handle.getValueState("remaining", "ids array<bigint>, r array<bigint>")

        def handleInputRows(self, key, rows, timerValues):
            pdf = pd.concat(list(rows), ignore_index=True)
            pdf = pdf.sort_values(["product_id", "ts", "request_id"], kind="mergesort")
            left = dict(zip(*self.remaining.get())) if self.remaining.exists() else {}
            ids, q, stock = (pdf[c].astype("int64").tolist() for c in ("product_id", "qty", "stock"))
            acc, rem = [], []
            for pid, want, first in zip(ids, q, stock):
                r = left.get(pid, first)
                # Requests of no quantity are refused and see the stock as it is.
                good = 0 < want <= r
                r -= want if good else 0
                left[pid] = r
                acc.append(good)
                rem.append(r)
            self.remaining.update((list(left), list(left.values())))
            yield pd.DataFrame({"request_id": pdf["request_id"].astype("int64").to_numpy(), "product_id": ids,
                                "qty": q, "accepted": acc, "remaining_after": rem})

        def close(self) -> None:
            pass

    return Reserve()


# Neighbouring ids whose state is kept together: a state store is called per
# block, not per id, and a block holds no more ids than this.
BLOCK = 256


def _block(key: str) -> Column:
    return F.floor(F.col(key) / BLOCK).cast("long")


def streaming_reservation(requests: DataFrame, products: DataFrame) -> DataFrame:
    """requests stream (request_id, product_id, qty, ts) joined with the
    static products (stock), then keyed state by block of products."""
    stock = products.select(F.col("id").alias("product_id"), F.col("stock").cast("long"))
    # Unknown products are refused (no stock), never dropped.
    j = requests.join(stock, "product_id", "left").withColumn("stock", F.coalesce("stock", F.lit(0)))
    return j.withColumn("block", _block("product_id")).groupBy("block").transformWithStateInPandas(
        statefulProcessor=_reservation_processor(), outputStructType=RESERVE_OUT,
        outputMode="Append", timeMode="None")


def reservation_from_table(spark: SparkSession, requests: DataFrame,
                           products: DataFrame) -> DataFrame:
    """Write the derived request table, stream it through J4, read back."""
    base = scratch_path(spark, "requests")
    requests.write.parquet(base + "/in")
    src = spark.readStream.schema(requests.schema).parquet(base + "/in")
    with keyed_state_store(spark):
        run_available_now(streaming_reservation(src, products), base + "/out", base + "/_ckpt")
    return spark.read.parquet(base + "/out")


# J5 -------------------------------------------------------------------------
def outbox_sink(changes: DataFrame, to_outbox: Callable[[DataFrame], DataFrame],
                sink: str, checkpoint: str) -> None:
    """Changed orders -> notification rows -> one folder per batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        to_outbox(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    run_available_now(changes, sink, checkpoint, foreach_batch=write)



# J2 -------------------------------------------------------------------------
# Event times cross into Python as epoch microseconds (``unix_micros``):
# pandas would otherwise see session-local wall times.
ABANDONED_OUT = T.StructType([
    T.StructField("pending_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("ts_us", T.LongType()), T.StructField("kind", T.StringType()),
])


# A window's purchases and signups are kept by slots, so many to a window.
SLOTS = 4


def _abandon_processor(ttl_ms: int, lifetime_ms: int = 0):
    from pyspark.sql.streaming import StatefulProcessor

    ttl_us = ttl_ms * 1000
    width = max(1, ttl_us // SLOTS)

    class Abandon(StatefulProcessor):
        """Per block of users and stretch of one window's length: open signups,
        one entry per batch and slot of the time they are due at, and each
        user's first and last purchase of each slot of time.

        A batch adds entries of signups and reads none of the older ones.  A
        timer stands at the earliest signup of an entry; it decides all of its
        slot that the watermark has passed, and the next one stands at the
        earliest of those left, so a batch has few timers however many signups
        are due in it.  A signup is closed by any purchase of its user from its
        time to a window later: in the first slot by the last purchase, in the
        last slot by the first one, by any in between.

        With a lifetime the watermark lags by it, and signups are decided that
        much before it reaches them; those found abandoned are kept, by slot,
        and a purchase that comes after the decision takes them back.
        """

        def init(self, handle) -> None:
            self.handle = handle
            rows = "users array<bigint>, ids array<bigint>, ts array<bigint>"
            self.parts = handle.getMapState("parts", "slot long", "n int")
            self.open = handle.getMapState("open", "slot long, part int", rows)
            self.paid = handle.getMapState(
                "paid", "slot long", "users array<bigint>, first array<bigint>, last array<bigint>")
            self.lots = handle.getMapState("lots", "slot long", "n int")
            self.decided = handle.getMapState("decided", "slot long, part int", rows)

        def handleInputRows(self, key, rows, timerValues):
            pdf = pd.concat(list(rows), ignore_index=True)
            signup = (pdf["event_type"] == "signup").to_numpy()
            all_ = np.stack([pdf[c].astype("int64").to_numpy() for c in ("user_id", "event_id", "ts_us")])
            new, paid = all_[:, signup], all_[:, ~signup][[0, 2]]
            due = self._due(new[2])
            slots = due * 1000 // width
            for slot in np.unique(slots).tolist():
                self._add(self.parts, self.open, slot, new[:, slots == slot])
                self.handle.registerTimer(int(due[slots == slot].min()))
            slots = paid[1] // width
            for slot in np.unique(slots).tolist():
                self._pay(slot, paid[:, slots == slot])
            if paid.size:               # when the stretch's last signup has been due
                self.handle.registerTimer((int(key[1]) + 2) * ttl_ms + 1)
            back = self._taken_back(paid) if lifetime_ms and paid.size else []
            yield _rows(back, "retracted")

        @staticmethod
        def _due(ts: np.ndarray) -> np.ndarray:
            return ts // 1000 + ttl_ms - lifetime_ms

        @staticmethod
        def _add(counts, entries, slot: int, rows: np.ndarray) -> None:
            n = counts.getValue((slot,))[0] if counts.containsKey((slot,)) else 0
            entries.updateValue((slot, n), tuple(x.tolist() for x in rows))
            counts.updateValue((slot,), (n + 1,))

        def _pay(self, slot: int, paid: np.ndarray) -> None:
            """No more rows to a slot than the block's users."""
            span = {}
            if self.paid.containsKey((slot,)):
                span = {int(u): (int(a), int(b)) for u, a, b in zip(*self.paid.getValue((slot,)))}
            for u, t in paid.T.tolist():
                a, b = span.get(u, (t, t))
                span[u] = (min(a, t), max(b, t))
            self.paid.updateValue((slot,), (list(span), [a for a, _ in span.values()], [b for _, b in span.values()]))

        def _taken_back(self, paid: np.ndarray) -> list[tuple[int, int, int]]:
            """Decided signups that these purchases close; they are forgotten."""
            by_user = {}
            for u, t in paid[:, np.argsort(paid[1], kind="stable")].T.tolist():
                by_user.setdefault(u, []).append(t)
            out = []
            for slot in range((int(paid[1].min()) - ttl_us) // width, int(paid[1].max()) // width + 1):
                for part in range(self.lots.getValue((slot,))[0] if self.lots.containsKey((slot,)) else 0):
                    left, back = [], []
                    for row in zip(*(x for x in self.decided.getValue((slot, part)))):
                        ts = by_user.get(row[0], ())
                        at = bisect.bisect_left(ts, row[2])
                        (back if at < len(ts) and ts[at] <= row[2] + ttl_us else left).append(tuple(map(int, row)))
                    if back:
                        out += back
                        self.decided.updateValue((slot, part), tuple(map(list, zip(*left))) if left else ([], [], []))
            return out

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            ms = expiredTimerInfo.getExpiryTimeInMs()
            if ms > (int(key[1]) + 2) * ttl_ms:
                self.paid.clear()
                self.lots.clear()
                self.decided.clear()
                yield _rows([], "abandoned")
                return
            slot, rows = ms * 1000 // width, []
            for part in range(self.parts.getValue((slot,))[0] if self.parts.containsKey((slot,)) else 0):
                rows.append(np.array(self.open.getValue((slot, part)), np.int64))
                self.open.removeKey((slot, part))
            if not rows:                # decided by an earlier timer of the slot
                yield _rows([], "abandoned")
                return
            self.parts.removeKey((slot,))
            rows = np.concatenate(rows, axis=1)
            due = self._due(rows[2])
            now = due <= timerValues.getCurrentWatermarkInMs()
            if not now.all():
                self._add(self.parts, self.open, slot, rows[:, ~now])
                self.handle.registerTimer(int(due[~now].min()))
            paid = {(int(u), int(k[0])): (int(a), int(b)) for k, v in self.paid.iterator() for u, a, b in zip(*v)}
            left = [(u, e, t) for u, e, t in rows[:, now].T.tolist() if not self._closed(u, t, paid)]
            if lifetime_ms and left:
                for at in {t // width for _, _, t in left}:
                    self._add(self.lots, self.decided, at, np.array([x for x in left if x[2] // width == at]).T)
                self.handle.registerTimer((int(key[1]) + 2) * ttl_ms + 1)
            yield _rows(left, "abandoned")

        @staticmethod
        def _closed(u: int, t: int, paid: dict[tuple[int, int], tuple[int, int]]) -> bool:
            lo, hi = t // width, (t + ttl_us) // width
            for slot in (lo, hi):
                first, last = paid.get((u, slot), (None, None))
                if first is not None and last >= t and first <= t + ttl_us:
                    return True
            return any((u, x) in paid for x in range(lo + 1, hi))

        def close(self) -> None:
            pass

    return Abandon()


def _rows(found: list[tuple[int, int, int]], kind: str) -> pd.DataFrame:
    users, ids, ts = zip(*found) if found else ((), (), ())
    return pd.DataFrame({"pending_id": pd.Series(ids, dtype="int64"), "user_id": pd.Series(users, dtype="int64"),
                         "ts_us": pd.Series(ts, dtype="int64"), "kind": pd.Series([kind] * len(ids), dtype=object)})


def abandoned_with_timers(events: DataFrame, ttl_ms: int = 20 * 3600 * 1000,
                          delay: str = "1 hour") -> DataFrame:
    """The J1 result with explicit keyed state and event-time timers.

    events: (event_id, user_id, event_type in signup/purchase, ts TIMESTAMP).
    Returns (pending_id, user_id, ts_us).

    State is keyed by block of users and by stretch of time as long as a
    window, so a busy user's events spread over tasks and the store is called
    per block.  A purchase goes to its own stretch and to the one before, where
    signups may still wait for it.
    """
    return _by_stretch(events, ttl_ms, 0, delay).drop("kind")


def abandoned_with_corrections(events: DataFrame, ttl_ms: int = 20 * 3600 * 1000, delay_ms: int = 3600 * 1000,
                               lifetime_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """J1/J2 with corrections: (pending_id, user_id, ts_us, kind).

    A signup is 'abandoned' when the latest event is ``delay_ms`` past its
    window.  A purchase that comes later than that, up to ``lifetime_ms`` more,
    still closes it: a row of kind 'retracted' follows.  Abandoned rows less
    the retracted ones are the batch answer over all events seen.
    """
    return _by_stretch(events, ttl_ms, lifetime_ms, f"{delay_ms + lifetime_ms} milliseconds")


def _by_stretch(events: DataFrame, ttl_ms: int, lifetime_ms: int, delay: str) -> DataFrame:
    events = events.withColumn("ts_us", F.unix_micros("ts"))
    stretch = F.floor(F.col("ts_us") / (ttl_ms * 1000)).cast("long")
    events = events.withWatermark("ts", delay).withColumn("stretch", F.explode(
        F.when(F.col("event_type") == "signup", F.array(stretch)).otherwise(F.array(stretch - 1, stretch))))
    return (events.withColumn("block", _block("user_id")).groupBy("block", "stretch")
            .transformWithStateInPandas(
                statefulProcessor=_abandon_processor(ttl_ms, lifetime_ms),
                outputStructType=ABANDONED_OUT, outputMode="Append", timeMode="EventTime"))


def abandoned_timers_from_events(spark: SparkSession, folder: str) -> DataFrame:
    ev = (stream_table(spark, folder, "events", EVENTS)
          .filter(F.col("event_type").isin("signup", "purchase"))
          .select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")))
    out = scratch_path(spark, "abandoned-timers")
    with keyed_state_store(spark):
        run_available_now(abandoned_with_timers(ev), out + "/data", out + "/_ckpt")
    return spark.read.parquet(out + "/data").select(
        "pending_id", "user_id", F.timestamp_micros("ts_us").alias("ts"))


# J4, batch-fold variant ------------------------------------------------------
def reservation_by_batches(requests: DataFrame, products: DataFrame, state_dir: str,
                           sink: str, checkpoint: str) -> None:
    """Streaming reservation where every micro-batch runs the distributed
    ordered fold (``operators.reserve``), so no product's requests -- even
    a hot product's -- are held by one task.

    The remaining stock of the products a batch touched is written per batch
    id to a compacted log under ``state_dir`` (``ledger.reservation_by_ledger``,
    which this calls); outcomes are written with overwrite, so a retried batch
    reproduces the same result (exactly once).
    """
    from .ledger import reservation_by_ledger

    reservation_by_ledger(requests, products, state_dir, sink, checkpoint)


def reservation_batches_from_table(spark: SparkSession, requests: DataFrame,
                                   products: DataFrame) -> DataFrame:
    """Write the derived request table, stream it through the batch-fold
    reservation, read the outcomes back."""
    base = scratch_path(spark, "requests-fold")
    requests.write.parquet(base + "/in")
    src = spark.readStream.schema(requests.schema).parquet(base + "/in")
    reservation_by_batches(src, products, base + "/state", base + "/out", base + "/_ckpt")
    return spark.read.parquet(base + "/out").drop("batch")
