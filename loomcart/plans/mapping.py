"""The driver's TPC-H-like tables seen as the shop's tables.

``products`` is one row per part (a size variant), ``shop_orders`` one row per
(order, part) with the line quantities summed.  Extra shop columns (image,
description, second-language text, SKU, customer contact) are derived from
existing columns by fixed rules, so every derived table grows with the input.

The same mappings are given as SQL text (``*_SQL``) for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


AS_OF = K.DEFAULT_AS_OF


def as_of_col(as_of: str = AS_OF) -> Column:
    return F.lit(as_of).cast("timestamp")


# --- products ----------------------------------------------------------------

def _size_from(p_size: Column) -> Column:
    m = p_size % 6
    return (F.when(m == 1, "S").when(m == 2, "M").when(m == 3, "L")
            .when(m == 4, "XL").when(m == 5, "XXL"))


def products(spark: SparkSession, sf_dir: str, extended: bool = False) -> DataFrame:
    """products(id, gender, collection, name, size, price, stock, active[, ..])."""
    p = table(spark, sf_dir, "part")
    cols = [
        p.p_partkey.alias("id"),
        p.p_type.alias("gender"),
        p.p_brand.alias("collection"),
        p.p_name.alias("name"),
        _size_from(p.p_size).alias("size"),
        F.floor(p.p_retailprice).cast("int").alias("price"),
        (p.p_partkey % 7).cast("int").alias("stock"),
        (p.p_partkey % 10 != 0).alias("active"),
    ]
    if extended:
        slug = F.replace(p.p_name, F.lit(" "), F.lit("_"))
        desc = F.concat_ws(" ", p.p_type, p.p_name, F.lit("by"), p.p_brand)
        cols += [
            F.when(p.p_size % 3 == 0,
                   F.concat(F.lit("https://res.cloudinary.com/demo/image/upload/v1/"),
                            slug, F.lit(".jpg")))
             .when(p.p_size % 3 == 1, F.concat(slug, F.lit(".jpg")))
             .otherwise(F.concat(F.lit("HTTP://img.example.com/"),
                                 p.p_partkey.cast("string"), F.lit(".png")))
             .alias("image"),
            desc.alias("description"),
            F.when(p.p_size % 2 == 0, F.upper(p.p_name)).alias("name_bn"),
            F.when(p.p_size % 5 == 0, F.upper(desc)).otherwise(F.lit(""))
             .alias("description_bn"),
            F.when(p.p_size % 4 != 0,
                   F.concat(p.p_brand, F.lit("-"), p.p_size.cast("string")))
             .alias("sku"),
        ]
    return p.select(*cols)


PRODUCTS_SQL = """
SELECT p_partkey AS id, p_type AS gender, p_brand AS collection, p_name AS name,
  CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN 'S' WHEN 2 THEN 'M'
                  WHEN 3 THEN 'L' WHEN 4 THEN 'XL' ELSE 'XXL' END AS size,
  CAST(floor(p_retailprice) AS INT) AS price,
  CAST(p_partkey % 7 AS INT) AS stock,
  p_partkey % 10 <> 0 AS active
FROM part
"""

PRODUCTS_EXT_SQL = """
SELECT p_partkey AS id, p_type AS gender, p_brand AS collection, p_name AS name,
  CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN 'S' WHEN 2 THEN 'M'
                  WHEN 3 THEN 'L' WHEN 4 THEN 'XL' ELSE 'XXL' END AS size,
  CAST(floor(p_retailprice) AS INT) AS price,
  CAST(p_partkey % 7 AS INT) AS stock,
  p_partkey % 10 <> 0 AS active,
  CASE WHEN p_size % 3 = 0
       THEN 'https://res.cloudinary.com/demo/image/upload/v1/' || replace(p_name, ' ', '_') || '.jpg'
       WHEN p_size % 3 = 1 THEN replace(p_name, ' ', '_') || '.jpg'
       ELSE 'HTTP://img.example.com/' || CAST(p_partkey AS VARCHAR) || '.png' END AS image,
  p_type || ' ' || p_name || ' by ' || p_brand AS description,
  CASE WHEN p_size % 2 = 0 THEN upper(p_name) END AS name_bn,
  CASE WHEN p_size % 5 = 0 THEN upper(p_type || ' ' || p_name || ' by ' || p_brand)
       ELSE '' END AS description_bn,
  CASE WHEN p_size % 4 <> 0 THEN p_brand || '-' || CAST(p_size AS VARCHAR) END AS sku
FROM part
"""


# --- orders ------------------------------------------------------------------

# Shop status -> source order-status code (the inverse of the mapping below),
# so a status filter becomes a plain equality the parquet reader can push.
STATUS_CODE = {"received": "O", "confirmed": "P", "shipped": "F"}


# Shop orders of one source order are numbered within it.  Order keys times
# slots stay below ID_RANGE; an order of more parts than slots goes on in the
# next ranges, so ids stay unique, and below 2^53 for the first two of them.
ORDER_SLOTS = 1000
ID_RANGE = 1 << 52


def shop_orders(spark: SparkSession, sf_dir: str, status: str | None = None,
                order_keys: DataFrame | None = None, buyers: DataFrame | None = None) -> DataFrame:
    """One row per (order, part): id, order_key, product_id, custkey, ..

    ``id`` is order_key * ORDER_SLOTS + the part's rank within the order, for
    each further ORDER_SLOTS parts of an order ID_RANGE higher.
    ``order_keys`` (one column ``order_key``) limits the work to those orders
    before the lines are aggregated.  ``buyers`` (custkey and further columns)
    is left-joined to ``orders``, which are fewer and narrower than the rows.

    The lines are shuffled once, by order: their sums per (order, part), the
    rank within the order and the join with ``orders`` all use that shuffle.
    Lines of one (order, part) are few, so summing them before it would not
    make it smaller.
    """
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    if status is not None:
        o = o.filter(F.col("o_orderstatus") == F.lit(STATUS_CODE.get(status, "")))
    if order_keys is not None:
        wanted = order_keys.select(F.col("order_key").alias("__key")).distinct()
        li = li.join(wanted, li.l_orderkey == wanted["__key"], "left_semi")
        if buyers is not None:
            o = o.join(wanted, o.o_orderkey == wanted["__key"], "left_semi")
    else:
        li = li.repartition("l_orderkey")
    more = []
    if buyers is not None:
        more = [c for c in buyers.columns if c != "custkey"]
        o = o.join(buyers.withColumnRenamed("custkey", "__cust"), F.col("o_custkey") == F.col("__cust"), "left")
    lines = (li.groupBy("l_orderkey", "l_partkey")
               .agg(F.sum("l_quantity").alias("q"),
                    F.sum("l_extendedprice").alias("v")))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey"))
    lines = lines.withColumn("slot", rank)
    slot = F.col("slot").cast("long")
    further = F.floor(slot / ORDER_SLOTS) * F.lit(ID_RANGE)
    j = lines.join(o, lines.l_orderkey == o.o_orderkey, "inner")
    st = j.o_orderstatus
    return j.select(
        (further + j.l_orderkey * ORDER_SLOTS + slot % ORDER_SLOTS).alias("id"),
        j.l_orderkey.alias("order_key"),
        j.l_partkey.alias("product_id"),
        j.o_custkey.alias("custkey"),
        j.q.cast("long").alias("quantity"),
        F.round(j.v).cast("long").alias("price_paid"),
        F.when(st == "O", "received").when(st == "P", "confirmed")
         .otherwise("shipped").alias("status"),
        F.when(st == "O", "pending").otherwise("paid").alias("payment_status"),
        j.o_orderdate.cast("timestamp").alias("ordered_at"),
        *more,
    )


SHOP_ORDERS_SQL = f"""
SELECT (l.slot // {ORDER_SLOTS}) * {ID_RANGE} + l.l_orderkey * {ORDER_SLOTS} + l.slot % {ORDER_SLOTS} AS id, l.l_orderkey AS order_key, l.l_partkey AS product_id,
  o.o_custkey AS custkey,
  CAST(l.q AS BIGINT) AS quantity,
  CAST(round(l.v) AS BIGINT) AS price_paid,
  CASE o.o_orderstatus WHEN 'O' THEN 'received' WHEN 'P' THEN 'confirmed' ELSE 'shipped' END AS status,
  CASE o.o_orderstatus WHEN 'O' THEN 'pending' ELSE 'paid' END AS payment_status,
  o.o_orderdate AS ordered_at
FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q, sum(l_extendedprice) AS v,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS slot
      FROM lineitem GROUP BY l_orderkey, l_partkey) l
JOIN orders o ON l.l_orderkey = o.o_orderkey
"""


CONTACT = ("customer_name", "customer_phone", "customer_email", "customer_address")


def buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer columns that the contact columns are made from."""
    c = table(spark, sf_dir, "customer")
    return c.select(c.c_custkey.alias("custkey"), c.c_custkey.alias("buyer"),
                    c.c_name.alias("buyer_name"), c.c_nationkey.alias("buyer_nation"),
                    (c.c_mktsegment != "HOUSEHOLD").alias("buyer_mails"))


def contact_columns() -> list[Column]:
    """Customer contact columns from those of ``buyers`` (NULL without buyer).

    Phone forms rotate through '+91 ', '0', bare, and a bare number that
    starts with 91 (the invalid case); household customers give no e-mail.
    """
    key, name = F.col("buyer"), F.col("buyer_name")
    digits = F.lpad(key.cast("string"), 9, "0")
    form = key % 4
    phone = (F.when(form == 0, F.concat(F.lit("+91 9"), digits))
             .when(form == 1, F.concat(F.lit("09"), digits))
             .when(form == 2, F.concat(F.lit("8"), digits))
             .otherwise(F.concat(F.lit("91"), F.substring(digits, 2, 8))))
    email = F.when(F.col("buyer_mails"),
                   F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))),
                            F.lit("@example.com")))
    address = F.concat(F.lit("Street "), F.col("buyer_nation").cast("string"), F.lit(", Block "),
                       key.cast("string"))
    return [c.alias(n) for c, n in zip((name, phone, email, address), CONTACT)]


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer contact columns derived from the customer key."""
    return buyers(spark, sf_dir).select("custkey", *contact_columns())


CUSTOMERS_SQL = """
SELECT c_custkey AS custkey, c_name AS customer_name,
  CASE c_custkey % 4
    WHEN 0 THEN '+91 9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')
    WHEN 1 THEN '09' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')
    WHEN 2 THEN '8' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')
    ELSE '91' || substr(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 2, 8) END AS customer_phone,
  CASE WHEN c_mktsegment <> 'HOUSEHOLD'
       THEN lower(replace(c_name, '#', '.')) || '@example.com' END AS customer_email,
  'Street ' || CAST(c_nationkey AS VARCHAR) || ', Block ' || CAST(c_custkey AS VARCHAR) AS customer_address
FROM customer
"""


def tracking_number() -> Column:
    return F.when(F.col("status") == "shipped", F.concat(F.lit("TRK"), F.col("id").cast("string"))).alias(
        "tracking_number")


def full_columns(contact: bool = True) -> list[Column]:
    """The shop's full column set, from rows of :func:`shop_orders` (with those
    of ``buyers`` for the contact; without it the contact columns are NULL)."""
    texts = contact_columns() if contact else [F.lit(None).cast("string").alias(c) for c in CONTACT]
    number = F.col("id").cast("string")
    return [
        F.col("id"), F.col("product_id"), *texts,
        F.lit(None).cast("string").alias("size"),
        F.col("quantity").cast("int").alias("quantity"),
        F.col("price_paid").cast("int").alias("price_paid"),
        F.col("status"),
        tracking_number(),
        F.lit(None).cast("string").alias("notes"),
        F.col("ordered_at"),
        F.col("ordered_at").alias("updated_at"),
        F.concat(F.lit("order_"), number).alias("razorpay_order_id"),
        F.when(F.col("payment_status") == "paid", F.concat(F.lit("pay_"), number)).alias("razorpay_payment_id"),
        F.col("payment_status"),
    ]


def full_orders(spark: SparkSession, sf_dir: str, contact: bool = True,
                order_keys: DataFrame | None = None, custkey: bool = False) -> DataFrame:
    """Orders with the shop's full column set (customer contact joined in).

    The customers are joined to the source orders, before the join with the
    lines; the contact texts are made from their columns after all shuffles.
    ``contact=False`` skips that join (contact columns NULL) for jobs that
    only need keys, states and amounts, or that give few rows their contact
    later: for these ``custkey`` adds the column :func:`with_contact` needs.
    A job that shuffles the orders again takes :func:`shop_orders` with
    ``buyers`` and makes the :func:`full_columns` after it.
    """
    j = shop_orders(spark, sf_dir, order_keys=order_keys, buyers=buyers(spark, sf_dir) if contact else None)
    return j.select(*full_columns(contact), *(["custkey"] if custkey else []))


def with_contact(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of :func:`full_orders` made without contact, with ``custkey``: the
    same rows with their customers' contact."""
    return rows.drop(*CONTACT).join(customers(spark, sf_dir), "custkey", "left").drop("custkey")


FULL_ORDERS_SQL = f"""
SELECT so.id, so.product_id, c.customer_name, c.customer_phone, c.customer_email,
  c.customer_address, CAST(NULL AS VARCHAR) AS size,
  CAST(so.quantity AS INT) AS quantity, CAST(so.price_paid AS INT) AS price_paid,
  so.status,
  CASE WHEN so.status = 'shipped' THEN 'TRK' || CAST(so.id AS VARCHAR) END AS tracking_number,
  CAST(NULL AS VARCHAR) AS notes, so.ordered_at, so.ordered_at AS updated_at,
  'order_' || CAST(so.id AS VARCHAR) AS razorpay_order_id,
  CASE WHEN so.payment_status = 'paid' THEN 'pay_' || CAST(so.id AS VARCHAR) END AS razorpay_payment_id,
  so.payment_status
FROM ({SHOP_ORDERS_SQL}) so LEFT JOIN ({CUSTOMERS_SQL}) c ON so.custkey = c.custkey
"""


def cte(**parts: str) -> str:
    """WITH clause from name=sql pairs, in the given order."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in parts.items()) + "\n"


def collection_labels(spark: SparkSession) -> DataFrame:
    """Display labels for ten of the collections (the rest fall through to
    their key).  A fixed ten-row list: broadcast is always safe."""
    return spark.range(1, 11).select(
        F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("key"),
        F.concat(F.lit("Collection "), F.col("id").cast("string")).alias("label"))


LABEL_ROWS = 10
