"""Registered stock queries: reservation (H13), sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stock as st
from . import mapping as M
from .registry import register

AS_OF = M.AS_OF
_P = M.PRODUCTS_SQL
_SO = M.SHOP_ORDERS_SQL
_STALE = f"""
SELECT * FROM ({_SO}) WHERE payment_status = 'pending'
  AND ordered_at < TIMESTAMP '{AS_OF}' - INTERVAL 20 MINUTE
"""


@register("stale_reservations", M.cte(s=_STALE) + "SELECT id, product_id, quantity FROM s")
def q_stale(spark, d):
    """Pending orders older than the 20-minute TTL at as_of."""
    return st.stale_reservations(M.shop_orders(spark, d), AS_OF).select(
        "id", "product_id", "quantity")


@register("restored_stock", M.cte(s=_STALE) + """
SELECT product_id, CAST(sum(CASE WHEN quantity = 0 OR quantity IS NULL THEN 1 ELSE quantity END)
                        AS BIGINT) AS restored, count(*) AS orders
FROM s WHERE product_id IS NOT NULL GROUP BY product_id
""")
def q_restored(spark, d):
    """Stock given back per product by the sweep."""
    return st.restored_stock(st.stale_reservations(M.shop_orders(spark, d), AS_OF))


@register("sweep_products", M.cte(p=_P, s=_STALE) + """,
b AS (SELECT product_id, sum(quantity) AS restored FROM s GROUP BY product_id)
SELECT p.id, CAST(p.stock + coalesce(b.restored, 0) AS INT) AS stock
FROM p LEFT JOIN b ON p.id = b.product_id
""")
def q_sweep_products(spark, d):
    """Products after the sweep (stock restored)."""
    r = st.sweep(M.products(spark, d), M.shop_orders(spark, d), AS_OF)
    return r.table.select("id", "stock")


@register("sweep_orders", M.cte(s=_STALE) + f"""
SELECT id, 'abandoned' AS payment_status, TIMESTAMP '{AS_OF}' AS updated_at FROM s
""")
def q_sweep_orders(spark, d):
    """H14 + H15: orders marked abandoned, updated_at touched."""
    o = M.full_orders(spark, d)
    r = st.sweep(M.products(spark, d), o, AS_OF)
    return r.changed.select("id", "payment_status", "updated_at")


def reservation_requests(spark, d):
    """Every order line as a reservation request in arrival order; quantity
    folded to 1..4 so that stock (0..6) is contested."""
    so = M.shop_orders(spark, d)
    return so.select(F.col("id").alias("request_id"), "product_id",
                     (F.col("quantity") % 4 + 1).alias("qty"),
                     F.col("ordered_at").alias("ts"))


_RESERVE_WALK = M.cte(so=_SO, p=_P).replace("WITH ", "WITH RECURSIVE ", 1) + """,
r AS (SELECT so.id AS request_id, so.product_id, CAST(so.quantity % 4 + 1 AS BIGINT) AS qty,
             p.stock AS s,
             row_number() OVER (PARTITION BY so.product_id ORDER BY so.ordered_at, so.id) AS rn
      FROM so JOIN p ON so.product_id = p.id),
walk AS (
  SELECT product_id, rn, request_id, qty, qty <= s AS accepted,
         CAST(CASE WHEN qty <= s THEN s - qty ELSE s END AS BIGINT) AS remaining
  FROM r WHERE rn = 1
  UNION ALL
  SELECT r.product_id, r.rn, r.request_id, r.qty, r.qty <= w.remaining,
         CAST(CASE WHEN r.qty <= w.remaining THEN w.remaining - r.qty ELSE w.remaining END AS BIGINT)
  FROM walk w JOIN r ON r.product_id = w.product_id AND r.rn = w.rn + 1
)
"""


@register("reserve_stock", _RESERVE_WALK + """
SELECT request_id, product_id, qty, accepted, remaining AS remaining_after,
       CASE WHEN accepted THEN 'reserved' ELSE 'sold_out' END AS outcome
FROM walk
""")
def q_reserve(spark, d):
    """First-come reservation over every order line (oracle: a plain
    replay as a recursive CTE)."""
    out, _ = st.reserve_stock(M.products(spark, d), reservation_requests(spark, d))
    return out


@register("reserve_stock_products", _RESERVE_WALK + """
SELECT p.id, CAST(p.stock - coalesce(t.taken, 0) AS INT) AS stock
FROM p LEFT JOIN (SELECT product_id, sum(qty) AS taken FROM walk WHERE accepted
                  GROUP BY product_id) t ON p.id = t.product_id
""")
def q_reserve_products(spark, d):
    """Stock left per product after the reservations."""
    _, p = st.reserve_stock(M.products(spark, d), reservation_requests(spark, d))
    return p.select("id", "stock")


def checkout_requests(spark, d):
    """Checkout requests from every order line: the card the customer saw
    (gender, name; the size only for received orders), its price text,
    quantity 1 (the storefront's), the customer's contact fields, and a
    receipt for large lines."""
    from .. import functions as fn

    so = M.shop_orders(spark, d)
    p = M.products(spark, d).select(F.col("id").alias("__pid"), "gender", "name", "size",
                                    "price")
    c = M.customers(spark, d)
    j = so.join(p, so.product_id == F.col("__pid")).join(c, "custkey", "left")
    return j.select(
        so.id.alias("request_id"), "gender", "name",
        F.when(so.status == "received", F.col("size")).alias("size"),
        fn.rupees("price").alias("price_text"), F.lit(1).alias("quantity"),
        "customer_name", "customer_phone", "customer_email", "customer_address",
        F.when(so.quantity > 30, F.concat(F.lit("rc_"), so.id.cast("string")))
         .otherwise(F.lit("")).alias("receipt"),
        F.col("ordered_at").alias("ts"))


_CHECKOUT_SQL = M.cte(so=_SO, p=_P, c=M.CUSTOMERS_SQL) + f""",
req AS (SELECT so.id AS request_id, p.gender, p.name,
               CASE WHEN so.status = 'received' THEN p.size END AS size, p.price,
               c.customer_name, c.customer_phone, c.customer_email, c.customer_address,
               CASE WHEN so.quantity > 30 THEN 'rc_' || CAST(so.id AS VARCHAR) ELSE '' END AS receipt,
               so.ordered_at AS ts
        FROM so JOIN p ON so.product_id = p.id LEFT JOIN c ON so.custkey = c.custkey),
cand AS (SELECT r.request_id, q.id AS product_id,
                row_number() OVER (PARTITION BY r.request_id
                                   ORDER BY q.collection, q.name, q.size IS NULL, q.size, q.id) AS k
         FROM req r JOIN p q ON q.active AND q.name = r.name AND q.gender = r.gender
              AND (r.size IS NULL OR r.size = '' OR r.size = q.size)),
pre AS (SELECT r.request_id, cd.product_id, CAST(round(r.price * 100) AS BIGINT) AS amount_paise,
               substr(coalesce(nullif(r.receipt, ''),
                      'rcpt_' || CAST(epoch_ms(TIMESTAMP '{AS_OF}') AS VARCHAR)), 1, 40) AS receipt_id,
               CASE WHEN coalesce(r.customer_name, '') = '' OR coalesce(r.customer_phone, '') = ''
                         OR coalesce(r.customer_email, '') = '' OR coalesce(r.customer_address, '') = ''
                    THEN 'invalid_form'
                    WHEN round(r.price * 100) < 100 THEN 'invalid_amount'
                    WHEN cd.product_id IS NULL THEN 'no_product' END AS pre_outcome,
               r.ts
        FROM req r LEFT JOIN cand cd ON cd.request_id = r.request_id AND cd.k = 1),
res AS (SELECT request_id, row_number() OVER (PARTITION BY product_id ORDER BY ts, request_id) AS rn
        FROM pre WHERE pre_outcome IS NULL)
SELECT pre.request_id, pre.product_id, pre.amount_paise, pre.receipt_id,
       coalesce(pre.pre_outcome, CASE WHEN res.rn <= p.stock THEN 'reserved' ELSE 'sold_out' END)
         AS outcome
FROM pre LEFT JOIN res ON pre.request_id = res.request_id LEFT JOIN p ON pre.product_id = p.id
"""


@register("checkout", _CHECKOUT_SQL)
def q_checkout(spark, d):
    """Checkout over every order line: C9 -> B6 -> I5/I6 -> B7 -> I12 -> H13.
    (Unit quantities, so the oracle's reservation is a row number.)"""
    from ..operators.checkout import checkout

    return checkout(M.products(spark, d), checkout_requests(spark, d), AS_OF)


@register("checkout_orders", f"""
WITH co AS ({_CHECKOUT_SQL}),
so AS ({_SO}), p AS ({_P}), c AS ({M.CUSTOMERS_SQL})
SELECT (SELECT max(id) FROM so) + row_number() OVER (ORDER BY so.ordered_at, so.id) AS id,
  so.id AS request_id, co.product_id,
  coalesce(nullif(c.customer_name, ''), 'Pending') AS customer_name,
  coalesce(c.customer_phone, '') AS customer_phone, nullif(c.customer_email, '') AS customer_email,
  coalesce(nullif(c.customer_address, ''), 'Pending') AS customer_address,
  CASE WHEN so.status = 'received' THEN nullif(p.size, '') END AS size, 1 AS quantity,
  CAST(floor(co.amount_paise / 100.0 + 0.5) AS INT) AS price_paid, 'received' AS status,
  'order_' || CAST(so.id AS VARCHAR) AS razorpay_order_id, 'pending' AS payment_status
FROM co JOIN so ON co.request_id = so.id JOIN p ON so.product_id = p.id
LEFT JOIN c ON so.custkey = c.custkey WHERE co.outcome = 'reserved'
""")
def q_checkout_orders(spark, d):
    """Create-order: the pending orders that the reserved requests save."""
    from ..operators.checkout import checkout, pending_orders

    req = checkout_requests(spark, d)
    out = checkout(M.products(spark, d), req, AS_OF)
    return pending_orders(M.shop_orders(spark, d), out, req)


def _new_orders(spark, d):
    """New orders: every order line is placed again as a new order (quantity
    folded to 1..4 so stock is contested)."""
    so = M.shop_orders(spark, d)
    return so.select(F.col("id").alias("request_id"), "product_id",
                     (F.col("quantity") % 4 + 1).cast("int").alias("quantity"),
                     F.col("price_paid").cast("int").alias("price_paid"), "ordered_at")


_PLACE_WALK = M.cte(so=_SO, p=_P).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
n AS (SELECT id AS request_id, product_id, CAST(quantity % 4 + 1 AS BIGINT) AS qty, ordered_at
      FROM so),
r AS (SELECT n.*, p.stock AS s,
             row_number() OVER (PARTITION BY n.product_id ORDER BY n.ordered_at, n.request_id) AS rn
      FROM n JOIN p ON n.product_id = p.id),
walk AS (
  SELECT product_id, rn, request_id, qty, ordered_at, qty <= s AS accepted,
         CAST(CASE WHEN qty <= s THEN s - qty ELSE s END AS BIGINT) AS remaining
  FROM r WHERE rn = 1
  UNION ALL
  SELECT r.product_id, r.rn, r.request_id, r.qty, r.ordered_at, r.qty <= w.remaining,
         CAST(CASE WHEN r.qty <= w.remaining THEN w.remaining - r.qty ELSE w.remaining END AS BIGINT)
  FROM walk w JOIN r ON r.product_id = w.product_id AND r.rn = w.rn + 1
)
"""


@register("place_orders", _PLACE_WALK + """
SELECT (SELECT max(id) FROM so) + row_number() OVER (ORDER BY ordered_at, request_id) AS id,
       product_id, CAST(qty AS INT) AS quantity, 'received' AS status, 'pending' AS payment_status,
       ordered_at
FROM walk WHERE accepted
""")
def q_place_orders(spark, d):
    """H13 + H16: all orders placed again; those that get their
    stock are appended with new ids, the rest refused."""
    from ..operators.checkout import place_orders

    appended, _, _ = place_orders(M.products(spark, d), M.shop_orders(spark, d),
                                  _new_orders(spark, d), AS_OF)
    return appended.select("id", "product_id", "quantity", "status", "payment_status",
                           "ordered_at")
