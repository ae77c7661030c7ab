"""First-come stock reservation (H13) as a distributed ordered fold.

Rule (the shop's atomic ``stock = stock - q WHERE stock >= q``): requests of
one product are served in arrival order (ts, request id); a request is
accepted iff the remaining stock is >= its quantity.  A refused request
takes nothing, so a *smaller later* request may still succeed -- prefix sums
alone are wrong after the first refusal.

No product's requests are gathered into one task (one product may hold a
large share of all requests):

1. Requests are range-partitioned on (product, ts, id), sorted, and
   checkpointed (a reliable checkpoint in the shared checkpoint folder), so
   each partition is a contiguous run of the global order and a product
   may span many partitions.
2. Exact prefix sums per product: each partition sums locally; offsets for
   the one product a partition may continue from earlier partitions come
   from a per-partition summary (one row per partition).
3. Up to a product's first refusal everything follows from the prefix sum
   (accepted iff cum <= stock).  After it, the remaining stock r is below
   the refused quantity, hence below the largest quantity ``qmax``.  For a
   product that enters a partition already past its first refusal, the
   partition publishes its transfer r -> r' as sorted breakpoints
   (``transfers``): between two of them r' is r less the first.  Their number
   follows the requests, not the quantities, and is bounded.
4. Transfers are composed in a tree over a product's partitions (``FAN`` at a
   time), and the entry states handed down the same tree.  Where a state falls
   into a stretch that a bounded transfer leaves open, that one partition is
   replayed from its now known entry and the tree is run again.
5. Each partition replays its rows with the now-known entry states.

Python runs per partition over Arrow batches (numpy); Spark does the
partitioning, shuffles and joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from ..session import ensure_checkpoint_dir
from . import transfers as tr

KEY, TS, RID, QTY, S = "product_id", "ts", "request_id", "qty", "__stock"

# Exit of a partition's last product: the state itself (exact) or a transfer.
_EXIT = "pid int, key long, exact boolean, left long, lo binary, hi binary, start binary"

# Transfers that are composed together at one node of the tree.
FAN = 16


def _tables(batches):
    """The partition's rows as Arrow tables, a batch at a time."""
    return (pa.Table.from_batches([b]) for b in batches if b.num_rows)


def _numpy(t: pa.Table, col: str) -> np.ndarray:
    return t.column(col).to_numpy()


def _global_cum(keys: np.ndarray, q: np.ndarray, off: int) -> np.ndarray:
    """Prefix sum per product inside the partition, plus the carried offset
    for the partition's first product."""
    total = np.cumsum(q)
    first = np.r_[True, keys[1:] != keys[:-1]]
    before = np.where(first, total - q, 0)
    local = total - np.maximum.accumulate(before)      # quantities are >= 1
    return local + np.where(keys == keys[0], off, 0)


def _key_runs(keys: np.ndarray):
    """(start, end) of each run of equal keys in a sorted array."""
    if len(keys) == 0:
        return
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = np.concatenate(([0], cut))
    ends = np.concatenate((cut, [len(keys)]))
    yield from zip(starts, ends)


def _replay(q: np.ndarray, cum: np.ndarray, stock: int, entry: int | None):
    """Accept flags and remaining-after for one product's run of rows.

    ``entry`` is the remaining stock on entry when the run starts past the
    product's first refusal; otherwise None and the prefix sum decides up
    to the first refusal.
    """
    n = len(q)
    acc = np.zeros(n, dtype=bool)
    rem = np.zeros(n, dtype=np.int64)
    if entry is None:
        ok = cum <= stock
        first_bad = n if ok.all() else int(np.argmax(~ok))
        acc[:first_bad] = True
        rem[:first_bad] = stock - cum[:first_bad]
        if first_bad == n:
            return acc, rem
        r = int(stock - (cum[first_bad] - q[first_bad]))
        start = first_bad
    else:
        r, start = int(entry), 0
    # Rows that ask for more than is left are passed over in bulk; a walk that
    # meets many of them looks again for rows that still fit.
    rem[start:] = -1
    at = start
    while r > 0 and at < n:
        fit = at + np.flatnonzero(q[at:] <= r)
        if not len(fit):
            break
        misses, at = 0, n
        for i in fit.tolist():
            if q[i] <= r:
                r -= int(q[i])
                acc[i], rem[i], misses = True, r, 0
                if r == 0:
                    break
            else:
                misses += 1
                if misses > 256:
                    at = i + 1
                    break
    # Refused rows see what the row before them left.
    before = int(entry) if entry is not None else int(stock - (cum[first_bad] - q[first_bad]))
    if start < n:
        tail = rem[start:]
        seen = np.maximum.accumulate(np.where(tail >= 0, np.arange(len(tail)), -1))
        rem[start:] = np.where(seen >= 0, tail[np.maximum(seen, 0)], before)
    return acc, rem


def serve_in_order(q: np.ndarray, stock: int) -> tuple[np.ndarray, np.ndarray]:
    """Accept flags and remaining-after of positive quantities served in order."""
    return _replay(q, np.cumsum(q), stock, None)


def _starts_past_refusal(q0: int, cum0: int, stock: int) -> bool:
    return cum0 - q0 > stock


# ---- pass C: exit state (or transfer) of each partition's last key -----------
def _exit_fn(limit: int, entries: bool):
    """Exits of the partitions' last products; with ``entries``, of partitions
    whose first (and only) product's entry state is in column ``__entry``."""
    def exits(batches):
        key = st = left = None
        cum_last, open_ = 0, []    # open_: quantities served from an unknown state
        for t in _tables(batches):
            keys, q, stock = _numpy(t, KEY), _numpy(t, QTY), _numpy(t, S)
            first = key is None
            if first:
                pid, qmax = t.column("__pid")[0].as_py(), t.column("__qmax")[0].as_py()
                cum_last = t.column("__off")[0].as_py()
            on = not first and keys[0] == key          # the run of the batch before goes on
            cum = _global_cum(keys, q, cum_last if first or on else 0)
            s, e = list(_key_runs(keys))[-1]
            entry, known = None, True
            if s == 0 and (first or on):
                st = int(stock[s]) if first else st
                if _starts_past_refusal(int(q[s]), int(cum[s]), st):
                    known = not open_ if on else entries
                    entry = None if not known else left if on else t.column("__entry")[0].as_py()
            else:
                st, open_ = int(stock[s]), []
            if known:
                left = int(_replay(q[s:e], cum[s:e], st, entry)[1][-1])
            else:                  # the entry state is not known here
                left = None
                open_.append(q[s:e].copy())
            key, cum_last = int(keys[-1]), int(cum[-1])
        if key is None:
            return
        f = tr.transfer(np.concatenate(open_), max(0, min(st, qmax - 1)), limit) if open_ else tr.IDENTITY
        yield pa.RecordBatch.from_arrays(
            [pa.array([pid], pa.int32()), pa.array([key], pa.int64()), pa.array([left is not None]),
             pa.array([left], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in f]],
            names=[c.split()[0] for c in _EXIT.split(", ")])
    return exits


# ---- composition of exits per key, in a tree over partitions -----------------
def _rows_in_order(pdf: pd.DataFrame):
    for row in pdf.sort_values("pid").itertuples(index=False):
        f = tuple(np.frombuffer(x, np.int64) for x in (row.lo, row.hi, row.start))
        yield row, (int(row.left) if row.exact else None), f


def _block_fn(limit: int):
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        """The exit of up to FAN neighbours as one."""
        left, f = None, None
        for row, own, g in _rows_in_order(pdf):
            if own is not None:
                left, f = own, None
            elif left is not None:
                left, f = tr.apply(g, left), None
                if left is None:               # open: nothing is known of it
                    f = tr.NOTHING
            else:
                f = g if f is None else tr.compose(f, g, limit)
        f = tr.IDENTITY if f is None else f
        return pd.DataFrame({
            "pid": pd.Series([int(pdf["pid"].iat[0]) // FAN], dtype="int32"), "key": [int(pdf["key"].iat[0])],
            "exact": [left is not None], "left": pd.Series([left], dtype="Int64"),
            "lo": [f[0].tobytes()], "hi": [f[1].tobytes()], "start": [f[2].tobytes()]})
    return block


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry and exit states of up to FAN neighbours, from the state on entry
    to the first (column ``entry``; null if unknown)."""
    state = None if pd.isna(pdf["entry"].iat[0]) else int(pdf["entry"].iat[0])
    out = []
    for row, own, g in _rows_in_order(pdf):
        before, state = state, own if own is not None else None if state is None else tr.apply(g, state)
        out.append((row.pid, row.key, before, state))
    pid, key, before, after = zip(*out)
    return pd.DataFrame({"pid": pd.Series(pid, dtype="int32"), "key": pd.Series(key, dtype="int64"),
                         "entry": pd.Series(before, dtype="Int64"), "exit": pd.Series(after, dtype="Int64")})


def _tree(exits: DataFrame, partitions: int, limit: int) -> DataFrame:
    """(pid, key, entry, exit) of every row of ``exits``: the states around
    each partition's last product, null where a transfer left them open."""
    levels, blocks = [exits], partitions
    while blocks > FAN:
        up = levels[-1].groupBy("key", F.floor(F.col("pid") / FAN).alias("node"))
        levels.append(up.applyInPandas(_block_fn(limit), _EXIT).checkpoint(eager=True))
        blocks = -(-blocks // FAN)
    states = "pid int, key long, entry long, exit long"
    known = levels[-1].withColumn("entry", F.lit(None).cast("long")).groupBy("key").applyInPandas(_walk, states)
    for level in reversed(levels[:-1]):
        node = F.floor(F.col("pid") / FAN).cast("int")
        above = known.select(F.col("pid").alias("node"), "key", "entry")
        known = level.withColumn("node", node).join(above, ["node", "key"]).groupBy(
            "node", "key").applyInPandas(_walk, states)
    return known.checkpoint(eager=True)


def _states(with_off: DataFrame, partitions: int, limit: int) -> DataFrame:
    """(pid, key, exit): the state after each partition's last product."""
    rows = with_off.select("__pid", KEY, QTY, S, "__off", "__qmax")
    exits = rows.mapInArrow(_exit_fn(limit, False), _EXIT).checkpoint(eager=True)
    while True:
        known = _tree(exits, partitions, limit)
        if known.where(F.col("exit").isNull()).isEmpty():
            return known
        # Each open partition behind a known state is replayed from it; one
        # row per partition at most, a proven broadcast bound.
        open_ = known.where(F.col("exit").isNull() & F.col("entry").isNotNull()).select(
            F.col("pid").alias("__pid"), F.col("entry").alias("__entry"))
        # The join keeps the order of the larger side's partitions.
        again = rows.join(F.broadcast(open_), "__pid").mapInArrow(_exit_fn(limit, True), _EXIT)
        found = known.select("pid", F.col("exit").alias("found"))
        found = found.join(again.select("pid", F.col("left").alias("replayed")), "pid", "left").select(
            "pid", F.coalesce("found", "replayed").alias("found"))
        exits = exits.join(found, "pid", "left").select(
            "pid", "key", (F.col("exact") | F.col("found").isNotNull()).alias("exact"),
            F.coalesce("left", "found").alias("left"), "lo", "hi", "start").checkpoint(eager=True)


# ---- pass D: final replay --------------------------------------------------
def _final_fn(carry: tuple[str, ...]):
    def final(batches):
        key = None
        for t in _tables(batches):
            keys, q, stock = _numpy(t, KEY), _numpy(t, QTY), _numpy(t, S)
            first = key is None
            if first:
                cum_last, left = t.column("__off")[0].as_py(), t.column("__entry")[0].as_py()
            on = not first and keys[0] == key          # the run of the batch before goes on
            cum = _global_cum(keys, q, cum_last if first or on else 0)
            acc = np.zeros(len(keys), dtype=bool)
            rem = np.zeros(len(keys), dtype=np.int64)
            for s, e in _key_runs(keys):
                st = st if s == 0 and on else int(stock[s])
                entry = None
                if s == 0 and (first or on) and _starts_past_refusal(int(q[s]), int(cum[s]), st):
                    entry = int(left)
                acc[s:e], rem[s:e] = _replay(q[s:e], cum[s:e], st, entry)
            key, cum_last, left = int(keys[-1]), int(cum[-1]), int(rem[-1])
            # Carried columns stay Arrow columns: no value changes on the way.
            out = t.select([RID, KEY, QTY]).append_column("accepted", pa.array(acc)).append_column(
                "remaining_after", pa.array(rem))
            for c in carry:
                out = out.append_column(c, t.column(c))
            yield from out.to_batches()
    return final


_FINAL = T.StructType([
    T.StructField(RID, T.LongType()),
    T.StructField(KEY, T.LongType()),
    T.StructField(QTY, T.LongType()),
    T.StructField("accepted", T.BooleanType()),
    T.StructField("remaining_after", T.LongType()),
])


def normalise_requests(requests: DataFrame) -> DataFrame:
    """qty: NULL or 0 -> 1 (the shop's ``quantity || 1``); negative -> refused."""
    q = fn.number_or(F.col(QTY).cast("long"), 1)
    return requests.withColumn(QTY, q)


ROWS_PER_PARTITION = 2_000_000
# Of one transfer: 24 bytes each.
BREAKPOINTS = 1 << 16


def reserve_stock(p: DataFrame, requests: DataFrame, partitions: int | None = None,
                  rows_per_partition: int = ROWS_PER_PARTITION,
                  carry: list[str] | tuple[str, ...] = (),
                  input_written: bool = False,
                  breakpoints: int = BREAKPOINTS):
    """Serve reservation requests in arrival order against product stock.

    requests: request_id, product_id, qty, ts.  Returns (outcomes, products):
    outcomes has request_id, product_id, qty, accepted, remaining_after and
    ``outcome`` (reserved / sold_out / invalid_quantity / no_product);
    products is ``p`` with stock reduced by the accepted quantities.

    A Python worker folds its partition batch by batch and holds no more than
    a batch and, of a product that came in past its first refusal, the
    quantities.  The partition count is at least count / ``rows_per_partition``
    (one counting job), and range partitioning on the unique (product, ts,
    id) key keeps partitions even however the products are skewed.
    ``carry`` columns of ``requests`` are passed through to the outcomes.
    ``input_written``: the caller's requests are already a written table
    (a checkpoint), so they are not written again here.
    ``breakpoints``: the most that one partition's transfer holds; results do
    not depend on it.
    """
    carry = tuple(carry)
    spark = requests.sparkSession
    ensure_checkpoint_dir(spark)
    # Written once: the count, the range-partition sample, the layout and
    # the refused requests below all read these files instead of
    # recomputing the caller's request plan.
    r = normalise_requests(requests).select(RID, KEY, QTY, TS, *carry)
    if not input_written:
        r = r.checkpoint(eager=True)
    stock = p.select(F.col("id").alias(KEY), F.col("stock").cast("long").alias(S))
    known = r.filter(F.col(KEY).isNotNull() & (F.col(QTY) > 0)).join(stock, KEY, "inner")
    # Partition count: given, or left to AQE (range repartition without a
    # number: AQE merges neighbouring small partitions, keeping the order),
    # unless the row count needs more partitions than the session's
    # shuffle partitions to keep each under ``rows_per_partition``.
    n = partitions
    if n is None:
        base = int(spark.conf.get("spark.sql.shuffle.partitions"))
        need = -(-known.count() // rows_per_partition)
        n = need if need > base else None
    # Requests that are not folded: found by their own predicates and an
    # anti join with the product dimension (no join on the request id).
    invalid = r.filter(F.col(KEY).isNull() | (F.col(QTY) <= 0)).select(
        RID, KEY, QTY, F.lit(False).alias("accepted"),
        F.lit(None).cast("long").alias("remaining_after"),
        F.when(F.col(KEY).isNull(), F.lit("no_product"))
         .otherwise(F.lit("invalid_quantity")).alias("outcome"), *carry)
    unknown = (r.filter(F.col(KEY).isNotNull() & (F.col(QTY) > 0))
               .join(stock.select(KEY), KEY, "left_anti")
               .select(RID, KEY, QTY, F.lit(False).alias("accepted"),
                       F.lit(None).cast("long").alias("remaining_after"),
                       F.lit("sold_out").alias("outcome"), *carry))
    other = invalid.unionByName(unknown)

    ranged = (known.repartitionByRange(n, KEY, TS, RID) if n
              else known.repartitionByRange(KEY, TS, RID))
    laid = (ranged
            .sortWithinPartitions(KEY, TS, RID)
            .checkpoint(eager=True))
    laid = laid.withColumn("__pid", F.spark_partition_id())

    # Pass A: plain aggregates; one summary row per partition, written once.
    per = laid.groupBy("__pid", KEY).agg(F.sum(QTY).alias("total"), F.max(QTY).alias("most"))
    summ = per.groupBy("__pid").agg(
        F.min(KEY).alias("first_key"), F.max(KEY).alias("last_key"),
        F.max_by("total", KEY).alias("last_total"))
    # A partition's first product is the only one whose bound is needed.
    bounds = per.groupBy(KEY).agg(F.max("most").alias("__qmax"))
    summ = summ.join(bounds, summ.first_key == bounds[KEY]).drop(KEY).checkpoint(eager=True)
    w = Window.orderBy("__pid")
    carried = F.sum("last_total").over(
        Window.partitionBy("last_key").orderBy("__pid")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summ = summ.withColumn("carry", carried)
    offs = summ.select(
        "__pid", "first_key", "__qmax",
        F.lag("last_key").over(w).alias("prev_key"),
        F.lag("carry").over(w).alias("prev_carry"))
    offs = offs.select(
        "__pid",
        F.when(F.col("prev_key") == F.col("first_key"), F.col("prev_carry"))
         .otherwise(F.lit(0)).cast("long").alias("__off"), "__qmax")
    # ``offs`` has one row per partition: a proven broadcast bound.
    with_off = laid.join(F.broadcast(offs), "__pid").sortWithinPartitions(KEY, TS, RID)

    # Pass C + composition: entry state of each partition's first product
    # when it arrives past its first refusal.
    states = _states(with_off, 1 + summ.agg(F.max("__pid")).first()[0], breakpoints) if summ.head(1) else None
    # Next non-empty partition and its first product (range partitions may
    # be empty), from the one-row-per-partition summary.
    nxt = summ.select("__pid", F.lead("__pid").over(w).alias("next_pid"),
                      F.lead("first_key").over(w).alias("next_key"))
    none = spark.createDataFrame([], "pid int, key long, entry long, exit long")
    ex = (none if states is None else states).join(F.broadcast(nxt), F.col("pid") == F.col("__pid"))
    entries = ex.where(F.col("next_key") == F.col("key"))
    # ``entries`` has at most one row per partition: a proven broadcast bound.
    final_in = with_off.join(F.broadcast(entries.select(
        F.col("next_pid").alias("__pid"), F.col("exit").alias("__entry"))), "__pid", "left")
    final_in = final_in.sortWithinPartitions(KEY, TS, RID)
    final_schema = T.StructType(list(_FINAL.fields) + [known.schema[c] for c in carry])
    served = final_in.mapInArrow(_final_fn(carry), final_schema).withColumn(
        "outcome", F.when(F.col("accepted"), F.lit("reserved")).otherwise(F.lit("sold_out")))
    outcomes = served.unionByName(other)

    taken = (served.filter("accepted").groupBy(KEY)
             .agg(F.sum(QTY).alias("__taken")))
    new_p = (p.join(taken, p.id == taken[KEY], "left")
             .withColumn("stock", (F.col("stock") - F.coalesce(F.col("__taken"), F.lit(0)))
                         .cast("int"))
             .drop(KEY, "__taken"))
    return outcomes, new_p
