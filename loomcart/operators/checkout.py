"""Checkout as one batch job: the shop's create-order path for many requests.

request -> variant resolution (C9) -> order-form check (B6) -> amount from
the displayed price text (I5, I6) and its check (B7) -> receipt (I12) ->
first-come reservation (H13).  Each request gets one outcome:

* ``invalid_form``   -- a required contact field is empty
* ``invalid_amount`` -- the amount is not an integral number of paise >= 100
* ``no_product``     -- no listed variant matches (the order would be saved
                        without a reservation)
* ``reserved`` / ``sold_out`` -- from the reservation fold
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .. import functions as fn
from .catalogue import resolve_variant
from .ids import assign_ids
from .joins import materialize
from .quality import ORDER_FORM, validate_amount, validate_required
from .reserve import reserve_stock


def checkout(p: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """requests: request_id, gender, name, size, price_text, quantity,
    customer_name/_phone/_email/_address, receipt, ts."""
    r = resolve_variant(requests, p)
    r = validate_required(r, ORDER_FORM)
    r = r.withColumn("amount", fn.to_paise(fn.parse_amount("price_text")).cast("string"))
    r = validate_amount(r, "amount")
    r = r.withColumn("receipt_id", fn.receipt("receipt", as_of))
    pre = (F.when(F.size("reasons") > 0, F.lit("invalid_form"))
           .when(~F.col("amount_ok"), F.lit("invalid_amount"))
           .when(F.col("product_id").isNull(), F.lit("no_product")))
    # Written once (reliable checkpoint): both the reservation input and the
    # final outcome read it.
    r = materialize(r.withColumn("pre_outcome", pre))
    to_reserve = r.filter(F.col("pre_outcome").isNull()).select(
        "request_id", "product_id", F.col("quantity").alias("qty"), "ts",
        "amount_paise", "receipt_id")
    served, _ = reserve_stock(p, to_reserve, carry=["amount_paise", "receipt_id"],
                              input_written=True)
    refused = r.filter(F.col("pre_outcome").isNotNull()).select(
        "request_id", "product_id", "amount_paise", "receipt_id",
        F.col("pre_outcome").alias("outcome"))
    return served.select("request_id", "product_id", "amount_paise", "receipt_id",
                         "outcome").unionByName(refused)


def pending_orders(o: DataFrame, outcomes: DataFrame, requests: DataFrame) -> DataFrame:
    """The order rows that create-order saves for reserved requests: contact
    fields with their stand-ins, whole rupees, status received, payment
    pending.  The gateway order id follows from the receipt; ids go on after
    the largest of ``o``."""
    r = outcomes.filter(F.col("outcome") == "reserved").join(
        requests.drop("product_id"), "request_id")
    rows = r.select(
        "request_id", "ts", "product_id", fn.text_or("customer_name", "Pending").alias("customer_name"),
        fn.text_or("customer_phone", "").alias("customer_phone"),
        F.nullif("customer_email", F.lit("")).alias("customer_email"),
        fn.text_or("customer_address", "Pending").alias("customer_address"),
        F.nullif("size", F.lit("")).alias("size"), fn.number_or("quantity", 1).cast("int").alias("quantity"),
        F.floor(F.col("amount_paise") / 100 + 0.5).cast("int").alias("price_paid"),
        F.lit(K.STATUS_RECEIVED).alias("status"),
        F.concat(F.lit("order_"), F.col("request_id").cast("string")).alias("razorpay_order_id"),
        F.lit(K.PAYMENT_PENDING).alias("payment_status"))
    return assign_ids(rows, o, order_by=["ts", "request_id"]).drop("ts")


def place_orders(p: DataFrame, o: DataFrame, new: DataFrame, as_of,
                 mode: str = "db") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The order-save path without a gateway reservation: for each new order
    with a product, take the stock first-come (H13, ``stock >= qty``); the
    orders that got their stock -- and those without a product, which take
    none -- are appended (H16); the others are refused as sold out.

    new: request_id, product_id, quantity, ordered_at and the order fields.
    Returns (appended orders, refused request ids, products after).
    """
    from .mutations import append_orders

    # The order fields ride through the fold (``carry``): no join back on
    # the request id.
    fields = [c for c in new.columns if c not in ("request_id", "product_id")]
    with_product = new.filter(F.col("product_id").isNotNull())
    req = with_product.select("request_id", "product_id", F.col("quantity").alias("qty"),
                              F.col("ordered_at").alias("ts"), *fields)
    served, p_after = reserve_stock(p, req, carry=fields)
    refused = served.filter(~F.col("accepted")).select("request_id", "outcome")
    accepted = (served.filter("accepted").select(*new.columns)
                .unionByName(new.filter(F.col("product_id").isNull())))
    appended = append_orders(o, accepted, as_of, mode=mode,
                             order_by=["ordered_at", "request_id"]).changed
    return appended, refused, p_after
