"""Abandoned-reservation sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .. import functions as fn
from .mutations import MutationResult
from .reserve import reserve_stock  # noqa: F401  (H13 lives in reserve.py)


def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def stale_reservations(o: DataFrame, as_of, ttl_minutes: int = K.RESERVATION_TTL_MINUTES
                       ) -> DataFrame:
    """Pending orders older than the TTL: ordered_at < as_of - ttl (strict).

    Both predicates are simple comparisons on scan columns, so they are
    pushed into the parquet reader.
    """
    cutoff = _ts(as_of) - F.expr(f"INTERVAL {int(ttl_minutes)} MINUTES")
    return o.filter((F.col("payment_status") == K.PAYMENT_PENDING)
                    & (F.col("ordered_at") < cutoff))


def restored_stock(stale: DataFrame) -> DataFrame:
    """Stock to give back per product: sum of ``quantity || 1``.

    Orders without product restore nothing (they are still marked).  A
    plain aggregate: partial sums run map-side, so a product with very
    many stale orders is reduced before the shuffle.
    """
    q = fn.number_or(F.col("quantity"), 1)
    return (stale.filter(F.col("product_id").isNotNull())
            .groupBy("product_id")
            .agg(F.sum(q).cast("long").alias("restored"),
                 F.count(F.lit(1)).alias("orders")))


def sweep(p: DataFrame, o: DataFrame, as_of,
          ttl_minutes: int = K.RESERVATION_TTL_MINUTES) -> MutationResult:
    """Release stale reservations: restore stock, mark orders abandoned.

    Returns the new products table as ``table``, the swept orders as
    ``changed``, and ``extra['orders']`` (new orders table),
    ``extra['restored']`` (per product).  updated_at = as_of on swept rows.
    """
    stale = stale_reservations(o, as_of, ttl_minutes)
    back = restored_stock(stale)
    new_p = (p.join(back.select(F.col("product_id").alias("id"), "restored"), "id", "left")
             .withColumn("stock", (F.col("stock") + F.coalesce(F.col("restored"), F.lit(0)))
                         .cast("int"))
             .drop("restored"))
    # The stale set is a predicate on ``o`` itself: flag rows in place
    # instead of joining the table with a filtered copy of itself.
    cutoff = _ts(as_of) - F.expr(f"INTERVAL {int(ttl_minutes)} MINUTES")
    swept = F.coalesce((F.col("payment_status") == K.PAYMENT_PENDING)
                       & (F.col("ordered_at") < cutoff), F.lit(False))
    j = o
    cols = []
    for c in o.columns:
        if c == "payment_status":
            cols.append(F.when(swept, F.lit(K.PAYMENT_ABANDONED)).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(swept, _ts(as_of)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    new_o = j.select(*cols, swept.alias("__s"))
    changed = new_o.filter("__s").drop("__s")
    return MutationResult(new_p, changed, {"orders": new_o.drop("__s"), "restored": back})
