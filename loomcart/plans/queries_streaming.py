"""Registered streaming queries.

Each runs a Structured Streaming query with ``trigger(availableNow=True)``
over the driver's files (or over a table Spark derives from them and writes
first), then returns the sink's contents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming as stm
from ..operators import outbox as ob
from ..operators.joins import bucketed
from ..operators.orders import with_product_name
from ..session import scratch_path
from . import mapping as M
from .queries_payments import _STREAM_EVENTS, _outbox_sql
from .queries_stock import _RESERVE_WALK, reservation_requests
from .registry import register

_EV = "(SELECT event_id, user_id, ts, event_type FROM events)"


_ABANDONED_SQL = f"""
WITH s AS (SELECT * FROM {_EV} WHERE event_type = 'signup'),
     p AS (SELECT * FROM {_EV} WHERE event_type = 'purchase'),
     w AS (SELECT least((SELECT max(ts) FROM s), (SELECT max(ts) FROM p))
                  - INTERVAL 1 HOUR AS wm)
SELECT s.event_id AS pending_id, s.user_id, s.ts FROM s, w
WHERE s.ts + INTERVAL 20 HOUR < w.wm
  AND NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = s.user_id
                  AND p.ts BETWEEN s.ts AND s.ts + INTERVAL 20 HOUR)
"""


@register("abandoned_stream", _ABANDONED_SQL)
def q_abandoned_stream(spark, d):
    """Signups without purchase within 20 hours, found by a watermarked
    stream-stream outer join (rows whose window closed by the final
    watermark)."""
    return stm.abandoned_from_events(spark, d)


# J2 runs one watermarked input (both event kinds), so its watermark is the
# latest event of either kind minus the delay; timers fire at ts + 20 hours.
_ABANDONED_STATE_SQL = f"""
WITH s AS (SELECT * FROM {_EV} WHERE event_type = 'signup'),
     p AS (SELECT * FROM {_EV} WHERE event_type = 'purchase'),
     w AS (SELECT (SELECT max(ts) FROM {_EV} WHERE event_type IN ('signup', 'purchase'))
                  - INTERVAL 1 HOUR AS wm)
SELECT s.event_id AS pending_id, s.user_id, s.ts FROM s, w
WHERE s.ts + INTERVAL 20 HOUR <= w.wm
  AND NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = s.user_id
                  AND p.ts BETWEEN s.ts AND s.ts + INTERVAL 20 HOUR)
"""


@register("abandoned_state", _ABANDONED_STATE_SQL)
def q_abandoned_state(spark, d):
    """The same abandoned signups from keyed state + event-time timers."""
    return stm.abandoned_timers_from_events(spark, d)


@register("confirm_once_stream", """
SELECT DISTINCT 'order_' || CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%d')
  AS razorpay_order_id
FROM events WHERE event_type = 'purchase'
""")
def q_confirm_once(spark, d):
    """One confirmation per gateway id (dropDuplicatesWithinWatermark)."""
    return stm.confirm_once_from_events(spark, d)


@register("reserve_stream", _RESERVE_WALK + """
SELECT request_id, product_id, qty, accepted, remaining AS remaining_after FROM walk
""")
def q_reserve_stream(spark, d):
    """The reservation fold with per-product keyed state (one batch)."""
    return stm.reservation_from_table(spark, reservation_requests(spark, d),
                                      M.products(spark, d))


@register("reserve_stream_fold", _RESERVE_WALK + """
SELECT request_id, product_id, qty, accepted, remaining AS remaining_after FROM walk
""")
def q_reserve_stream_fold(spark, d):
    """J4 with the distributed fold per micro-batch (hot products split)."""
    out = stm.reservation_batches_from_table(spark, reservation_requests(spark, d),
                                             M.products(spark, d))
    return out.select("request_id", "product_id", "qty", "accepted", "remaining_after")


def _shipped_outbox(spark, d):
    p = M.products(spark, d)

    def to_outbox(batch):
        # Lines are cut to the batch's orders before anything is built on them.
        keys = batch.filter(F.col("o_orderstatus") == "F").select(
            F.col("o_orderkey").alias("order_key"))
        shipped = M.full_orders(spark, d, order_keys=keys)
        ev = with_product_name(shipped, p).withColumn("kind", F.lit("shipped"))
        return ob.notification_outbox(ev)

    return to_outbox


@register("outbox_stream", _outbox_sql(_STREAM_EVENTS))
def q_outbox_stream(spark, d):
    """Order-status stream -> outbox rows -> per-batch folders."""
    src = stm.stream_table(spark, d, "orders", M.table(spark, d, "orders").schema)
    base = scratch_path(spark, "outbox")
    stm.outbox_sink(src, _shipped_outbox(spark, d), base + "/out", base + "/_ckpt")
    return spark.read.parquet(base + "/out").drop("batch")


def _in_waves(spark, waves, name, run):
    """Append each wave to a folder and run the stream after it, as after a
    restart; returns the stream's base folder."""
    base = scratch_path(spark, name)
    for wave in waves:
        wave.write.mode("append").option("compression", "zstd").parquet(base + "/in")
        run(spark.readStream.schema(wave.schema).parquet(base + "/in"), base)
    return base


@register("confirm_ledger_stream", """
SELECT DISTINCT 'order_' || CAST(user_id AS VARCHAR) AS razorpay_order_id
FROM events WHERE event_type = 'purchase'
""")
def q_confirm_ledger(spark, d):
    """A gateway id (here one per user) confirmed once for ever: its
    repeats come weeks later, in other runs of the stream."""
    calls = M.table(spark, d, "events").where("event_type = 'purchase'").select(
        F.concat(F.lit("order_"), F.col("user_id").cast("string")).alias("razorpay_order_id"),
        F.col("ts").cast("timestamp").alias("ts"), (F.day("ts") % 3).alias("wave"))
    waves = [calls.where(F.col("wave") == k).drop("wave") for k in range(3)]
    base = _in_waves(spark, waves, "confirm-ledger", lambda src, at: stm.confirm_once_for_ever(
        src, at + "/state", at + "/out", at + "/_ckpt"))
    return spark.read.parquet(base + "/out").select("razorpay_order_id")


def _patch_waves(o):
    """Five waves over all orders: confirmation calls, patches with and without
    a status, calls once more, shipments, shipments once more."""
    def wave(step, rows, call="patch", status=None, tracking=None):
        return rows.select(
            (F.lit(step * 10 ** 16) + F.col("id")).alias("seq"), "id", F.lit(call).alias("call"),
            (F.lit(None) if status is None else status).cast("string").alias("status"),
            (F.lit(None) if tracking is None else tracking).cast("string").alias("tracking_number"),
            F.lit(None).cast("string").alias("notes"))

    track = F.concat(F.lit("TRK-"), F.col("id").cast("string"))
    ships, v = F.lit("shipped"), F.col("price_paid") % 5
    return [wave(1, o.where(v.isin(0, 1)), "confirm"),
            wave(2, o.where("status = 'confirmed'"), status=F.when(F.col("quantity") > 10, ships), tracking=track),
            wave(3, o.where(v == 0), "confirm"),
            wave(4, o.where(v == 1), status=ships),
            wave(5, o.where(F.col("price_paid") % 10 == 1), status=ships)]


_PATCH_EVENTS = """
o2 AS (SELECT o.* REPLACE (CASE WHEN status = 'confirmed' THEN 'TRK-' || CAST(id AS VARCHAR)
                                ELSE tracking_number END AS tracking_number), name AS product_name
       FROM o LEFT JOIN (SELECT id AS pid, name FROM p) ON product_id = pid),
ev AS (SELECT o2.*, kind FROM o2, (VALUES ('new_order'), ('confirmed')) AS k(kind)
       WHERE status = 'received' AND price_paid % 5 IN (0, 1)
       UNION ALL SELECT *, 'shipped' FROM o2 WHERE status = 'confirmed' AND quantity > 10
       UNION ALL SELECT *, 'shipped' FROM o2 WHERE price_paid % 5 = 1
       UNION ALL SELECT *, 'shipped' FROM o2 WHERE price_paid % 10 = 1)"""


@register("outbox_patch_stream", _outbox_sql(_PATCH_EVENTS))
def q_outbox_patches(spark, d):
    """Messages of a stream of patches and confirmation calls, built from
    each order's merged row; a call once more sends nothing, a shipment once
    more sends again."""
    # The orders are written once, by id, with what messages need; texts made
    # from ids and buyers are made anew.
    null = F.lit(None).cast("string")
    o = bucketed(M.shop_orders(spark, d, buyers=M.buyers(spark, d)).select(
        "id", "product_id", F.col("quantity").cast("int").alias("quantity"),
        F.col("price_paid").cast("int").alias("price_paid"), "status",
        "buyer", "buyer_name", "buyer_nation", "buyer_mails"), "id")
    o = o.select("*", null.alias("size"), M.tracking_number(), null.alias("notes"))
    p = M.products(spark, d)

    def messages(ev):
        return ob.notification_outbox(with_product_name(ev, p).select("*", *M.contact_columns()))

    base = _in_waves(spark, _patch_waves(o), "outbox-patches", lambda src, at: stm.patch_messages(
        src, o, messages, at + "/state", at + "/out", at + "/_ckpt"))
    return spark.read.parquet(base + "/out").drop("batch")


@register("abandoned_corrected_stream", _ABANDONED_STATE_SQL)
def q_abandoned_corrected(spark, d):
    """J1 with corrections: every third purchase arrives after all else, behind
    the decisions; abandoned rows less those taken back are the answer over
    all events."""
    ev = M.table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase")).select(
        "event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    late = (F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0)

    def run(src, at):
        with stm.keyed_state_store(spark):
            stm.run_available_now(stm.abandoned_with_corrections(src, lifetime_ms=400 * 24 * 3600 * 1000),
                                  at + "/out", at + "/_ckpt")

    base = _in_waves(spark, [ev.where(~late), ev.where(late)], "abandoned-corrected", run)
    out = spark.read.parquet(base + "/out")
    back = out.where("kind = 'retracted'").select("pending_id")
    return out.where("kind = 'abandoned'").join(back, "pending_id", "left_anti").select(
        "pending_id", "user_id", F.timestamp_micros("ts_us").alias("ts"))
