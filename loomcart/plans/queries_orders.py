"""Registered order queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import orders as ops
from . import mapping as M
from .registry import register


@register("shop_orders", M.SHOP_ORDERS_SQL)
def q_shop_orders(spark, d):
    return M.shop_orders(spark, d)


@register("list_orders_received", M.cte(so=M.SHOP_ORDERS_SQL, p=M.PRODUCTS_EXT_SQL) + """
SELECT so.*, p.name AS product_name, p.collection, p.gender, p.image
FROM so LEFT JOIN p ON so.product_id = p.id
WHERE so.status = 'received'
""")
def q_list_orders(spark, d):
    """C1 + B3 + B9 + F2: received orders with product fields, newest first."""
    so = M.shop_orders(spark, d, status="received")     # pushed to the orders scan
    return ops.list_orders(so, M.products(spark, d, extended=True), "received")


@register("list_orders_all", M.cte(so=M.SHOP_ORDERS_SQL, p=M.PRODUCTS_EXT_SQL) + """
SELECT so.*, p.name AS product_name, p.collection, p.gender, p.image
FROM so LEFT JOIN p ON so.product_id = p.id
""")
def q_list_orders_all(spark, d):
    """C1 without a status filter (the whole order list)."""
    return ops.list_orders(M.shop_orders(spark, d), M.products(spark, d, extended=True))


@register("full_orders", M.FULL_ORDERS_SQL)
def q_full_orders(spark, d):
    """Orders with the shop's full column set (customer contact joined)."""
    return M.full_orders(spark, d)


@register("dangling_orders", M.cte(so=M.SHOP_ORDERS_SQL, p=M.PRODUCTS_SQL) + """
SELECT so.* FROM so
WHERE so.product_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM p WHERE p.id = so.product_id AND p.active)
""")
def q_dangling(spark, d):
    """C8 over the active catalogue: orders whose product is not listed."""
    p = M.products(spark, d).filter(F.col("active"))
    return ops.dangling_orders(M.shop_orders(spark, d), p)


_DOC_COLS = ["id", "product_id", "product_name", "customer_name", "customer_phone",
             "customer_email", "customer_address", "size", "quantity", "price_paid",
             "status", "tracking_number", "notes", "razorpay_order_id",
             "razorpay_payment_id", "payment_status"]


def _named_orders(spark, d):
    """Orders with buyer and product name, as keys and codes: the texts made
    from these (:func:`_documents`) are several times as long."""
    return ops.with_product_name(M.shop_orders(spark, d, buyers=M.buyers(spark, d)), M.products(spark, d))


def _documents(rows):
    from .. import functions as fn

    return rows.select(*M.full_columns(), "product_name").select(
        *_DOC_COLS, fn.iso_utc("ordered_at").alias("ordered_at"), fn.iso_utc("updated_at").alias("updated_at"))


@register("order_documents", M.cte(o=M.FULL_ORDERS_SQL, p=M.PRODUCTS_SQL) + f"""
SELECT o.id, o.product_id, p.name AS product_name, o.customer_name, o.customer_phone,
  o.customer_email, o.customer_address, o.size, o.quantity, o.price_paid, o.status,
  o.tracking_number, o.notes, o.razorpay_order_id, o.razorpay_payment_id, o.payment_status,
  strftime(o.ordered_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS ordered_at,
  strftime(o.updated_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS updated_at
FROM o LEFT JOIN p ON o.product_id = p.id
""")
def q_order_documents(spark, d):
    """A3 + A2 + I15 + F5: orders written as JSON documents to a new path,
    read back with the document schema, newest first."""
    from ..session import scratch_path
    from ..sources import read_order_json, write_order_json

    path = scratch_path(spark, "order-docs")
    write_order_json(_documents(_named_orders(spark, d)), path, compression="gzip")
    return ops.newest_first(read_order_json(spark, path, multiline=False))


@register("order_document_files", M.cte(o=M.FULL_ORDERS_SQL, p=M.PRODUCTS_SQL) + """
SELECT NULL AS reason, o.id, o.product_id, p.name AS product_name, o.customer_email, o.quantity, o.status,
       o.tracking_number, strftime(o.ordered_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS ordered_at
FROM o LEFT JOIN p ON o.product_id = p.id
UNION ALL SELECT unnest(['bad json', 'empty', 'no list', 'no order']), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
""")
def q_order_document_files(spark, d):
    """A2 over a folder of order documents, one JSON list a file, with a
    half-written file, an empty one, one without a list and one with an entry
    that is no order: their reasons come as rows."""
    from ..session import scratch_path
    from ..sources import order_documents, write_order_documents

    path = scratch_path(spark, "order-files")
    write_order_documents(_named_orders(spark, d), path, files=32, make=_documents, compression="gzip")
    for text in ('[{"id": 7, "status": "rec', "", '{"id": 7}', "[null]"):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(path)
    return order_documents(spark, path).select(
        "reason", "id", "product_id", "product_name", "customer_email", "quantity", "status", "tracking_number",
        "ordered_at")
