"""Explicit schemas of the shop's tables and documents."""

from __future__ import annotations

from pyspark.sql import types as T

PRODUCTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("gender", T.StringType(), False),
    T.StructField("collection", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("size", T.StringType(), True),
    T.StructField("price", T.IntegerType(), False),
    T.StructField("stock", T.IntegerType(), False),
    T.StructField("image", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("active", T.BooleanType(), False),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("name_bn", T.StringType(), True),
    T.StructField("description_bn", T.StringType(), True),
    T.StructField("sku", T.StringType(), True),
])

# Defaults applied by create-table / additive migration.
PRODUCT_DEFAULTS = {"stock": 0, "active": True}

ORDERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("product_id", T.LongType(), True),
    T.StructField("customer_name", T.StringType(), False),
    T.StructField("customer_phone", T.StringType(), False),
    T.StructField("customer_email", T.StringType(), True),
    T.StructField("customer_address", T.StringType(), False),
    T.StructField("size", T.StringType(), True),
    T.StructField("quantity", T.IntegerType(), False),
    T.StructField("price_paid", T.IntegerType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("tracking_number", T.StringType(), True),
    T.StructField("notes", T.StringType(), True),
    T.StructField("ordered_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
    T.StructField("razorpay_order_id", T.StringType(), True),
    T.StructField("razorpay_payment_id", T.StringType(), True),
    T.StructField("payment_status", T.StringType(), False),
])

ORDER_DEFAULTS = {"quantity": 1, "status": "received", "payment_status": "pending"}

# The file-mode order document: its own field set, ordered_at as ISO text.
ORDER_DOCUMENT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("customer_phone", T.StringType()),
    T.StructField("customer_email", T.StringType()),
    T.StructField("customer_address", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("price_paid", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("tracking_number", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("razorpay_order_id", T.StringType()),
    T.StructField("razorpay_payment_id", T.StringType()),
    T.StructField("payment_status", T.StringType()),
    T.StructField("ordered_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])

DICTIONARY = T.StructType([
    T.StructField("src", T.StringType(), False),
    T.StructField("dst", T.StringType(), True),
])

LABELS = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("label", T.StringType(), True),
])

CATALOGUE = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("tribe", T.StringType(), True),
    T.StructField("tagline", T.StringType(), True),
    T.StructField("items", T.ArrayType(T.StringType()), True),
])

PAYMENT_LOG = T.StructType([
    T.StructField("razorpay_order_id", T.StringType(), True),
    T.StructField("razorpay_payment_id", T.StringType(), True),
    T.StructField("razorpay_signature", T.StringType(), True),
])

ORDER_PATCH = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("status", T.StringType(), True),
    T.StructField("tracking_number", T.StringType(), True),
    T.StructField("notes", T.StringType(), True),
])

PRODUCT_PATCH = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("changes", T.MapType(T.StringType(), T.StringType(), True), True),
])
