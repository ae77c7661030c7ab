"""Registered mutation queries.

Change sets are derived from the whole tables by fixed rules (documented on
each builder) and applied to whole tables; ``as_of`` is only the time written
as "now".
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mutations as mu
from . import mapping as M
from .registry import register

AS_OF = M.AS_OF
_P = M.PRODUCTS_SQL
_PX = M.PRODUCTS_EXT_SQL
_SO = M.SHOP_ORDERS_SQL


def linked_orders(spark, d):
    """All orders; those of every fifth product lost their reference (NULL),
    so that some products are referred to by no order."""
    kept = F.when(F.col("product_id") % 5 != 0, F.col("product_id"))
    return M.shop_orders(spark, d).withColumn("product_id", kept)


_SO_LINKED = f"SELECT * REPLACE (CASE WHEN product_id % 5 <> 0 THEN product_id END AS product_id) FROM ({_SO})"


@register("unreferenced_products", M.cte(p=_P, o=_SO_LINKED) + """
SELECT * FROM p WHERE id NOT IN (SELECT product_id FROM o WHERE product_id IS NOT NULL)
""")
def q_unreferenced(spark, d):
    """Products no order refers to."""
    return mu.unreferenced_products(M.products(spark, d), linked_orders(spark, d))


@register("set_stock", M.cte(p=_P, o=_SO_LINKED) + """,
ch AS (SELECT product_id AS id, arg_max(CAST(quantity AS INT), (ordered_at, id)) AS stock
       FROM o GROUP BY product_id)
SELECT p.id, p.gender, p.collection, p.name, p.size, p.price, ch.stock, p.active
FROM p JOIN ch ON p.id = ch.id
""")
def q_set_stock(spark, d):
    """H1: stock set from each order line; the latest line wins."""
    o = linked_orders(spark, d)
    changes = o.select(F.col("product_id").alias("id"), F.col("quantity").alias("stock"),
                       F.struct("ordered_at", "id").alias("seq"))
    return mu.set_stock(M.products(spark, d), changes).changed


def _relisted(spark, d):
    """New listings derived from every product: a second edition at double
    price; unsized items come without image (refused), zero-stock ones
    with a blank SKU (generated)."""
    p = M.products(spark, d, extended=True)
    return p.select(
        "gender", "collection", F.concat("name", F.lit(" II")).alias("name"),
        F.when(F.col("name_bn").isNull(), F.lit("")).otherwise(F.col("name_bn")).alias("name_bn"),
        "size", (F.col("price") * 2).alias("price"), "stock",
        F.when(F.col("size").isNull(), F.lit("")).otherwise(F.col("image")).alias("image"),
        "description", "description_bn",
        F.when(F.col("stock") == 0, F.lit("  ")).otherwise(F.col("sku")).alias("sku"),
        F.col("id").alias("src_id"))


_RELISTED_SQL = f"""
SELECT gender, collection, name || ' II' AS name, coalesce(name_bn, '') AS name_bn, size,
  price * 2 AS price, stock, CASE WHEN size IS NULL THEN '' ELSE image END AS image,
  description, description_bn, CASE WHEN stock = 0 THEN '  ' ELSE sku END AS sku, id AS src_id
FROM ({_PX})
"""


@register("insert_products", M.cte(p=_PX, n=_RELISTED_SQL) + f""",
ok AS (SELECT * FROM n WHERE image IS NOT NULL AND image <> ''),
ided AS (SELECT (SELECT max(id) FROM p) + row_number() OVER (ORDER BY name, src_id) AS id, *
         FROM ok)
SELECT id, gender, collection, name, size, CAST(price AS INT) AS price, stock, image,
  nullif(description, '') AS description, true AS active,
  TIMESTAMP '{AS_OF}' AS created_at, nullif(name_bn, '') AS name_bn,
  nullif(description_bn, '') AS description_bn,
  coalesce(nullif(trim(sku), ''), printf('MWK-%04d', id)) AS sku
FROM ided
""")
def q_insert_products(spark, d):
    """H2 + B6 + E2 + I1 + I2: insert the relisted products."""
    r = mu.insert_products(M.products(spark, d, extended=True), _relisted(spark, d),
                           AS_OF, order_by=["name", "src_id"])
    return r.changed


@register("insert_products_rejected", M.cte(n=_RELISTED_SQL) + """
SELECT src_id, name, 'missing image' AS reasons FROM n WHERE image IS NULL OR image = ''
""")
def q_insert_rejected(spark, d):
    r = mu.insert_products(M.products(spark, d, extended=True), _relisted(spark, d),
                           AS_OF, order_by=["name", "src_id"])
    return r.extra["rejected"].select("src_id", "name",
                                      F.array_join("reasons", "|").alias("reasons"))


def _product_patches(spark, d):
    """Patches by rule over every product: sold-out rows get stock 5 and an
    explicit NULL size, then a price that is no number (refused); names with
    'ring' send only an unknown key (refused), then stock 9; prices >= 1050
    drop by 100 and deactivate, then price 77 comes with a NULL name (refused
    whole); names with 'bolt' try a NULL name (refused), then a gender that
    is too long (refused)."""
    p = M.products(spark, d)
    ch = (F.when(F.col("stock") == 0, F.create_map(F.lit("stock"), F.lit("5"),
                                                   F.lit("size"), F.lit(None).cast("string")))
          .when(F.col("name").contains("ring"), F.create_map(F.lit("colour"), F.lit("red")))
          .when(F.col("price") >= 1050, F.create_map(
              F.lit("price"), (F.col("price") - 100).cast("string"),
              F.lit("active"), F.lit("false")))
          .when(F.col("name").contains("bolt"), F.create_map(
              F.lit("name"), F.lit(None).cast("string"))))
    second = (F.when(F.col("stock") == 0, F.create_map(F.lit("price"), F.lit("abc")))
              .when(F.col("name").contains("ring"), F.create_map(F.lit("stock"), F.lit("9")))
              .when(F.col("price") >= 1050, F.create_map(
                  F.lit("price"), F.lit("77"), F.lit("name"), F.lit(None).cast("string")))
              .when(F.col("name").contains("bolt"), F.create_map(
                  F.lit("gender"), F.lit("as long as can be"))))
    both = F.explode(F.array(F.struct(F.lit(1).alias("seq"), ch.alias("changes")),
                             F.struct(F.lit(2).alias("seq"), second.alias("changes"))))
    return p.select("id", both.alias("x")).select("id", "x.seq", "x.changes").filter(
        F.col("changes").isNotNull())


_PATCH_RULE = """
CASE WHEN stock = 0 THEN 'a' WHEN contains(name, 'ring') THEN 'b'
     WHEN price >= 1050 THEN 'c' WHEN contains(name, 'bolt') THEN 'd' END
"""


@register("patch_products", M.cte(p=_P) + f""",
r AS (SELECT *, {_PATCH_RULE} AS rule FROM p)
SELECT id, gender, collection, name,
  CASE WHEN rule = 'a' THEN NULL ELSE size END AS size,
  CASE WHEN rule = 'c' THEN price - 100 ELSE price END AS price,
  CASE rule WHEN 'a' THEN 5 WHEN 'b' THEN 9 ELSE stock END AS stock,
  CASE WHEN rule = 'c' THEN false ELSE active END AS active
FROM r WHERE rule IN ('a', 'b', 'c')
""")
def q_patch_products(spark, d):
    """H3 + B8: partial product updates (present keys only)."""
    return mu.patch_products(M.products(spark, d), _product_patches(spark, d)).changed


@register("patch_products_outcomes", M.cte(p=_P) + f""",
r AS (SELECT id, {_PATCH_RULE} AS rule FROM p)
SELECT id, 1 AS seq, CASE rule WHEN 'b' THEN 'no fields' WHEN 'd' THEN 'not null'
                ELSE 'updated' END AS outcome
FROM r WHERE rule IS NOT NULL
UNION ALL
SELECT id, 2, CASE rule WHEN 'a' THEN 'bad value' WHEN 'b' THEN 'updated'
                WHEN 'c' THEN 'not null' ELSE 'too long' END
FROM r WHERE rule IS NOT NULL
""")
def q_patch_outcomes(spark, d):
    return mu.patch_products(M.products(spark, d),
                             _product_patches(spark, d)).extra["outcomes"]


def _order_patches(spark, d):
    """Two patches per order, applied in order: confirmed orders
    are shipped with a tracking number, then get a note; received orders
    get a note and an explicit NULL status."""
    none = F.lit(None).cast("string")
    first = (F.when(F.col("status") == "confirmed", F.create_map(
                F.lit("status"), F.lit("shipped"), F.lit("tracking_number"),
                F.concat(F.lit("TRK-"), F.col("id").cast("string"))))
             .when(F.col("status") == "received", F.create_map(
                F.lit("notes"), F.lit("call customer"), F.lit("status"), none)))
    second = F.when(F.col("status") == "confirmed", F.create_map(
        F.lit("notes"), F.lit("packed"), F.lit("tracking_number"), none))
    both = F.explode(F.array(F.struct(F.lit(1).alias("seq"), first.alias("changes")),
                             F.struct(F.lit(2).alias("seq"), second.alias("changes"))))
    return M.shop_orders(spark, d).select("id", both.alias("x")).select(
        "id", "x.seq", "x.changes").filter(F.col("changes").isNotNull())


_FO = M.FULL_ORDERS_SQL


@register("patch_orders", M.cte(o=_FO) + f"""
SELECT id, CASE WHEN status = 'confirmed' THEN 'shipped' ELSE status END AS status,
  CASE WHEN status = 'confirmed' THEN 'TRK-' || CAST(id AS VARCHAR) ELSE tracking_number END
    AS tracking_number,
  CASE WHEN status = 'confirmed' THEN 'packed' ELSE 'call customer' END AS notes,
  TIMESTAMP '{AS_OF}' AS updated_at
FROM o WHERE status IN ('confirmed', 'received')
""")
def q_patch_orders(spark, d):
    """H4 + H15 (database mode: NULL keeps the old value)."""
    r = mu.patch_orders(M.full_orders(spark, d), _order_patches(spark, d), AS_OF)
    return r.changed.select("id", "status", "tracking_number", "notes", "updated_at")


@register("patch_orders_presence", M.cte(o=_FO) + f"""
SELECT id, CASE WHEN status = 'confirmed' THEN 'shipped' ELSE NULL END AS status,
  CAST(NULL AS VARCHAR) AS tracking_number,
  CASE WHEN status = 'confirmed' THEN 'packed' ELSE 'call customer' END AS notes,
  TIMESTAMP '{AS_OF}' AS updated_at
FROM o WHERE status IN ('confirmed', 'received')
""")
def q_patch_orders_presence(spark, d):
    """H4 file mode: a present NULL overwrites."""
    r = mu.patch_orders(M.full_orders(spark, d), _order_patches(spark, d), AS_OF,
                        mode="presence")
    return r.changed.select("id", "status", "tracking_number", "notes", "updated_at")


@register("soft_delete", M.cte(p=_P, o=_SO_LINKED) + """
SELECT id, CASE WHEN id NOT IN (SELECT product_id FROM o WHERE product_id IS NOT NULL)
                THEN false ELSE active END AS active
FROM p
""")
def q_soft_delete(spark, d):
    """H5: retire every product without an order (new table)."""
    p = M.products(spark, d)
    ids = mu.unreferenced_products(p, linked_orders(spark, d)).select("id")
    return mu.soft_delete(p, ids).table.select("id", "active")


@register("wipe_products_summary", M.cte(p=_P, o=_SO_LINKED) + """,
r AS (SELECT *, id IN (SELECT product_id FROM o WHERE product_id IS NOT NULL) AS ref FROM p)
SELECT count(*) FILTER (WHERE NOT ref) AS hard_deleted,
       count(*) FILTER (WHERE ref AND active) AS soft_deleted
FROM r
""")
def q_wipe_summary(spark, d):
    """H6: counts of hard- and soft-deleted products."""
    return mu.wipe_products(M.products(spark, d), linked_orders(spark, d)).extra["summary"]


@register("wipe_products_table", M.cte(p=_P, o=_SO_LINKED) + """
SELECT id, name, size, false AS active FROM p
WHERE id IN (SELECT product_id FROM o WHERE product_id IS NOT NULL)
""")
def q_wipe_table(spark, d):
    return mu.wipe_products(M.products(spark, d), linked_orders(spark, d)).table.select(
        "id", "name", "size", "active")


@register("purge_inactive_deleted", M.cte(p=_P, o=_SO_LINKED) + """
SELECT id, name, size FROM p
WHERE NOT active AND id NOT IN (SELECT product_id FROM o WHERE product_id IS NOT NULL)
""")
def q_purge_deleted(spark, d):
    """H7: inactive products no order refers to are deleted."""
    return mu.purge_inactive(M.products(spark, d), linked_orders(spark, d)).changed


@register("purge_inactive_counts", M.cte(p=_P, o=_SO_LINKED) + """,
left_ AS (SELECT * FROM p WHERE active
          OR id IN (SELECT product_id FROM o WHERE product_id IS NOT NULL))
SELECT count(*) FILTER (WHERE active) AS active_count,
       count(*) FILTER (WHERE NOT active) AS inactive_count,
       count(*) AS total_count FROM left_
""")
def q_purge_counts(spark, d):
    return mu.purge_inactive(M.products(spark, d), linked_orders(spark, d)).extra["counts"]


@register("dedupe_changed", M.cte(p=_P) + """,
kept AS (SELECT gender, collection, name, size, arg_min(id, (-stock, id)) AS keep_id
         FROM p WHERE active GROUP BY gender, collection, name, size)
SELECT p.id, p.name, p.size, p.stock FROM p JOIN kept k
  ON p.gender IS NOT DISTINCT FROM k.gender AND p.collection IS NOT DISTINCT FROM k.collection
 AND p.name IS NOT DISTINCT FROM k.name AND p.size IS NOT DISTINCT FROM k.size
WHERE p.active AND p.id <> k.keep_id
""")
def q_dedupe_changed(spark, d):
    """H8 + E1 + C3: copies deactivated by de-duplication."""
    return mu.dedupe_products(M.products(spark, d)).changed


@register("dedupe_after", M.cte(p=_P) + """,
groups AS (SELECT arg_min(id, (-stock, id)) AS keep_id FROM p WHERE active
           GROUP BY gender, collection, name, size)
SELECT CAST(count(*) AS INT) AS active_count,
       CAST(count(*) - count(DISTINCT (p.gender, p.collection, p.name, p.size)) AS INT)
         AS remaining_duplicate_groups
FROM p JOIN groups ON p.id = keep_id
""")
def q_dedupe_after(spark, d):
    """H8 + D2: summary after de-duplication (no groups remain)."""
    return mu.dedupe_products(M.products(spark, d)).extra["after"]


@register("delete_orders", M.cte(o=_SO_LINKED) + """
SELECT id FROM o WHERE status = 'shipped'
""")
def q_delete_orders(spark, d):
    """H9: shipped orders are deleted (returns the deleted ids)."""
    o = linked_orders(spark, d)
    return mu.delete_orders(o, o.filter(F.col("status") == "shipped").select("id")).changed


@register("clear_orders", M.cte(o=_SO) + """
SELECT count(*) AS deleted_count FROM o
""")
def q_clear_orders(spark, d):
    """Every order removed; the count is reported."""
    r = mu.clear_orders(M.shop_orders(spark, d))
    return r.changed.agg(F.count(F.lit(1)).alias("deleted_count"))


def _reorders(spark, d):
    """New orders: every shipped order is ordered again one day
    later; paid ones carry their payment id."""
    o = M.full_orders(spark, d).filter(F.col("status") == "shipped")
    return o.select(
        "product_id", "customer_name", "customer_phone", "customer_email",
        "customer_address", "size",
        F.when(F.col("quantity") > 40, F.lit(0)).otherwise(F.col("quantity")).alias("quantity"),
        "price_paid",
        F.concat(F.lit("re_"), F.col("razorpay_order_id")).alias("razorpay_order_id"),
        F.when(F.col("price_paid") > 100000, F.col("razorpay_payment_id"))
         .otherwise(F.lit("")).alias("razorpay_payment_id"),
        (F.col("ordered_at") + F.expr("INTERVAL 1 DAY")).alias("ordered_at"),
        F.col("id").alias("src_id"))


def _append_sql(mode: str) -> str:
    status = ("CASE WHEN price_paid > 100000 AND razorpay_payment_id IS NOT NULL "
              "AND razorpay_payment_id <> '' THEN 'confirmed' ELSE 'received' END"
              if mode == "file" else "'received'")
    return M.cte(so=_SO, o=_FO) + f""",
n AS (SELECT * FROM o WHERE status = 'shipped')
SELECT (SELECT max(id) FROM so)
         + row_number() OVER (ORDER BY ordered_at + INTERVAL 1 DAY, id) AS id,
  product_id, CASE WHEN quantity > 40 OR quantity = 0 THEN 1 ELSE quantity END AS quantity,
  {status} AS status,
  're_' || razorpay_order_id AS razorpay_order_id,
  CASE WHEN price_paid > 100000 THEN razorpay_payment_id END AS razorpay_payment_id,
  CASE WHEN price_paid > 100000 AND razorpay_payment_id IS NOT NULL THEN 'paid'
       ELSE 'pending' END AS payment_status,
  ordered_at + INTERVAL 1 DAY AS ordered_at
FROM n
"""


def _append(spark, d, mode):
    r = mu.append_orders(M.full_orders(spark, d), _reorders(spark, d), AS_OF, mode=mode,
                         order_by=["ordered_at", "src_id"])
    return r.changed.select("id", "product_id", "quantity", "status", "razorpay_order_id",
                            "razorpay_payment_id", "payment_status", "ordered_at")


@register("append_orders", _append_sql("db"))
def q_append_orders(spark, d):
    """H16 database path (+ E2 ids, I3 quantity default)."""
    return _append(spark, d, "db")


@register("append_orders_file", _append_sql("file"))
def q_append_orders_file(spark, d):
    """H16 file path: paid orders are confirmed at once."""
    return _append(spark, d, "file")


@register("insert_if_absent", M.cte(p=_P) + """,
n AS (SELECT CASE WHEN size = 'S' THEN name ELSE name || ' ' || collection END AS name,
             gender, collection, size, price, stock, id AS seq FROM p),
first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS k FROM n)
           WHERE k = 1 AND name NOT IN (SELECT name FROM p))
SELECT (SELECT max(id) FROM p) + row_number() OVER (ORDER BY seq) AS id,
       name, gender, collection, size, price, stock, true AS active
FROM first_
""")
def q_insert_if_absent(spark, d):
    """C4: insert by name if absent, first row per repeated name wins."""
    p = M.products(spark, d)
    new = p.select(
        F.when(F.col("size") == "S", F.col("name"))
         .otherwise(F.concat_ws(" ", "name", "collection")).alias("name"),
        "gender", "collection", "size", "price", "stock", F.col("id").alias("seq"))
    return mu.insert_if_absent(p, new, "name", "seq").changed.select(
        "id", "name", "gender", "collection", "size", "price", "stock", "active")


@register("seed_if_empty", M.cte(p=_P) + """
SELECT row_number() OVER (ORDER BY id) AS id, gender, collection, name, size, price,
       stock, true AS active
FROM p WHERE active
""")
def q_seed_if_empty(spark, d):
    """The active catalogue seeds an empty catalogue (ids from 1)."""
    p = M.products(spark, d)
    empty = p.filter(F.lit(False))
    seed = p.filter("active").select("gender", "collection", "name", "size", "price",
                                     "stock", F.col("id").alias("seq"))
    r = mu.seed_if_empty(empty, seed, seq="seq")
    return r.changed.select("id", "gender", "collection", "name", "size", "price",
                            "stock", "active")


@register("seed_if_nonempty", M.cte(p=_P) + """
SELECT id, name FROM p WHERE false
""")
def q_seed_if_nonempty(spark, d):
    """C5 on a non-empty catalogue inserts nothing."""
    p = M.products(spark, d)
    seed = p.select("gender", "collection", "name", "size", "price", "stock",
                    F.col("id").alias("seq"))
    return mu.seed_if_empty(p, seed, seq="seq").changed.select("id", "name")


@register("bucketed_snapshots", M.cte(p=_P) + """
SELECT id, CASE WHEN id % 40 = 1 THEN CAST(id % 90 AS INT) ELSE stock END AS stock,
       active AND id % 61 <> 0 AS active
FROM p WHERE id % 97 <> 0
""")
def q_bucketed_snapshots(spark, d):
    """H1, H5 and a hard delete as versions of a bucketed table: each commit
    writes the buckets it changed, the others are carried over."""
    from ..session import scratch_path
    from ..sources import BucketedTable

    p = M.products(spark, d)
    t = BucketedTable(spark, scratch_path(spark, "products"), p.schema)
    t.create(p)
    ids = p.select("id")
    changes = ids.where("id % 40 = 1").select("id", (F.col("id") % 90).cast("int").alias("stock"), F.lit(1).alias("seq"))
    done = mu.set_stock(t.read(), changes)
    t.commit(done.table, done.changed)
    done = mu.soft_delete(t.read(), ids.where("id % 61 = 0"))
    t.commit(done.table, done.changed)
    gone = ids.where("id % 97 = 0")
    t.commit(t.read().join(gone, "id", "left_anti"), gone)
    return t.read().select("id", "stock", "active")
