"""Registered catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import catalogue as cat
from . import mapping as M
from . import sqltext as Q
from .registry import register


@register("products", M.PRODUCTS_SQL)
def q_products(spark, d):
    return M.products(spark, d)


@register("products_extended", M.PRODUCTS_EXT_SQL)
def q_products_ext(spark, d):
    return M.products(spark, d, extended=True)


@register("list_products", M.cte(p=M.PRODUCTS_SQL) + """
SELECT * FROM p WHERE active AND gender = 'ECONOMY' AND collection = 'Brand#5'
""")
def q_list_products(spark, d):
    """B1 + B2 + F1: one gender + collection listing, catalogue order."""
    return cat.list_products(M.products(spark, d), "ECONOMY", "Brand#5")


@register("list_products_gender", M.cte(p=M.PRODUCTS_SQL) + """
SELECT *, row_number() OVER (PARTITION BY collection
                             ORDER BY name, size NULLS LAST, id) AS pos
FROM p WHERE active AND gender = 'SMALL'
""")
def q_list_products_gender(spark, d):
    """B2 with one filter; F1 position within each collection (NULL size last)."""
    from ..operators.ranking import keyed_row_number

    listed = cat.list_products(M.products(spark, d), "SMALL", sort=False)
    return keyed_row_number(listed, ["collection"], [
        F.col("name").asc(), F.col("size").asc_nulls_last(), F.col("id").asc()], "pos")


@register("inventory_counts", M.cte(p=M.PRODUCTS_SQL) + """
SELECT count(*) FILTER (WHERE active) AS active_count,
       count(*) FILTER (WHERE NOT active) AS inactive_count,
       count(*) AS total_count
FROM p
""")
def q_inventory_counts(spark, d):
    return cat.inventory_counts(M.products(spark, d))


@register("duplicate_summary", M.cte(p=M.PRODUCTS_SQL) + """
SELECT CAST(coalesce(sum(copies), 0) AS INT) AS active_count,
       CAST(count_if(copies > 1) AS INT) AS remaining_duplicate_groups
FROM (SELECT count(*) AS copies FROM p WHERE active GROUP BY gender, collection, name, size) g
""")
def q_duplicate_summary(spark, d):
    return cat.duplicate_summary(M.products(spark, d))


@register("rank_duplicates", M.cte(p=M.PRODUCTS_SQL) + """
SELECT id, gender, collection, name, size, stock,
       row_number() OVER (PARTITION BY gender, collection, name, size
                          ORDER BY stock DESC, id ASC) AS rn
FROM p WHERE active
""")
def q_rank_duplicates(spark, d):
    return cat.rank_duplicates(M.products(spark, d))


@register("best_copy", M.cte(p=M.PRODUCTS_SQL) + """
SELECT gender, collection, name, size,
       arg_min(id, (-stock, id)) AS keep_id, count(*) AS copies
FROM p WHERE active GROUP BY gender, collection, name, size
""")
def q_best_copy(spark, d):
    return cat.best_copy(M.products(spark, d))


_CARD_ORDER = f"{Q.size_rank('size')}, size IS NULL, size, id"


@register("product_cards", M.cte(p=M.PRODUCTS_EXT_SQL) + """
SELECT gender, collection, name,
  first(price ORDER BY size IS NULL, size, id) AS price,
  first(image ORDER BY size IS NULL, size, id) AS image,
  first(description ORDER BY size IS NULL, size, id) AS description,
  bool_or(stock > 0) AS any_in_stock,
  bool_or(size IS NOT NULL AND size <> '') AS sized,
  CAST(count(*) AS INT) AS n_variants
FROM p WHERE active GROUP BY gender, collection, name
""")
def q_product_cards(spark, d):
    """D3 + D4: one card per product with its attributes."""
    return cat.product_cards(M.products(spark, d, extended=True))


@register("card_variants", M.cte(p=M.PRODUCTS_SQL) + f"""
SELECT gender, collection, name, id, size, stock,
  row_number() OVER (PARTITION BY gender, collection, name ORDER BY {_CARD_ORDER}) AS pos,
  stock <= 0 AS out
FROM p WHERE active
""")
def q_card_variants(spark, d):
    """D3 + F4 + I17: card variants in storefront order, sold-out marker."""
    return cat.card_variants(M.products(spark, d))


@register("storefront", M.cte(p=M.PRODUCTS_EXT_SQL, lab=Q.labels()) + f"""
SELECT p.id, p.gender, p.collection, coalesce(lab.label, p.collection) AS collection_label,
  p.name, p.size, {Q.rupees('p.price')} AS price_text,
  {Q.image_src('p.image')} AS image_src, p.stock > 0 AS in_stock,
  p.name || {Q.optional_piece('p.size', ' (Size ', ')')} AS display_name
FROM p LEFT JOIN lab ON p.collection = lab.key
WHERE p.active
""")
def q_storefront(spark, d):
    """K4 (B1, B5, C10, I4, I8, I16) over the whole active catalogue."""
    return cat.storefront(M.products(spark, d, extended=True), M.collection_labels(spark),
                          label_rows=M.LABEL_ROWS)


@register("catalogue_items", M.cte(p=M.PRODUCTS_SQL) + """
SELECT CAST(id AS VARCHAR) AS key, name,
       CAST(unnest(range(0, len(string_split(name, ' ')))) AS INTEGER) AS pos,
       unnest(string_split(name, ' ')) AS item
FROM p WHERE active
""")
def q_catalogue_items(spark, d):
    """Nested catalogue records flattened to (key, name, pos, item)."""
    return cat.catalogue_items(cat.nested_catalogue(M.products(spark, d)))


@register("resolve_variant", M.cte(so=M.SHOP_ORDERS_SQL, p=M.PRODUCTS_SQL) + """,
req AS (
  SELECT so.id AS request_id, p.gender, p.name,
         CASE WHEN so.status = 'received' THEN p.size END AS size
  FROM so JOIN p ON so.product_id = p.id
),
cand AS (
  SELECT r.request_id, q.id AS product_id, q.size AS p_size, q.stock AS p_stock,
         row_number() OVER (PARTITION BY r.request_id
                            ORDER BY q.collection, q.name, q.size IS NULL, q.size, q.id) AS k
  FROM req r JOIN p q ON q.active AND q.name = r.name AND q.gender = r.gender
       AND (r.size IS NULL OR r.size = '' OR r.size = q.size)
)
SELECT r.request_id, r.gender, r.name, r.size, c.product_id,
       c.p_size AS resolved_size, c.p_stock AS resolved_stock
FROM req r LEFT JOIN cand c ON c.request_id = r.request_id AND c.k = 1
""")
def q_resolve_variant(spark, d):
    """Each order line re-resolved from (gender, name[, size]).

    Received orders carry their size; others carry none and resolve to the
    first variant in listing order.
    """
    so = M.shop_orders(spark, d)
    p = M.products(spark, d)
    req = (so.join(p.select(F.col("id").alias("pid"), "gender", "name", "size"),
                   so.product_id == F.col("pid"))
           .select(so.id.alias("request_id"), "gender", "name",
                   F.when(so.status == "received", F.col("size")).alias("size")))
    return cat.resolve_variant(req, p)


@register("lookup_products", M.cte(so=M.SHOP_ORDERS_SQL, p=M.PRODUCTS_SQL) + """,
k AS (SELECT DISTINCT product_id + 1 AS id FROM so WHERE status = 'shipped')
SELECT k.id, p.gender, p.collection, p.name, p.size, p.price, p.stock, p.active,
       p.id IS NOT NULL AS found
FROM k LEFT JOIN p ON k.id = p.id
""")
def q_lookup(spark, d):
    """Batch lookup of keys (some not present) with a found flag."""
    so = M.shop_orders(spark, d)
    keys = (so.filter(F.col("status") == "shipped")
            .select((F.col("product_id") + 1).alias("id")).distinct())
    return cat.lookup(M.products(spark, d), keys)


@register("scalar_functions", M.cte(p=M.PRODUCTS_EXT_SQL) + f"""
SELECT id, printf('MWK-%04d', id * 7) AS sku_text,
  {Q.rupees('price * 1013')} AS price_text,
  {Q.image_src('image')} AS image_src,
  {Q.size_rank('size')} AS size_rank,
  {Q.js_text('size')} AS size_js,
  name || {Q.optional_piece('size', ' — Size ')} AS variant_name,
  CAST(round(price * 100) AS BIGINT) AS paise,
  CAST(round(price * 100 / 100.0) AS BIGINT) AS rupees_back
FROM p
""")
def q_scalar_functions(spark, d):
    """I1, I4, I6, I8, I13, I16, F4 rank applied to every product row."""
    p = M.products(spark, d, extended=True)
    return p.select(
        "id", fn.sku(F.col("id") * 7).alias("sku_text"),
        fn.rupees(F.col("price") * 1013).alias("price_text"),
        fn.image_src("image").alias("image_src"),
        fn.size_rank("size").alias("size_rank"),
        fn.js_text("size").alias("size_js"),
        fn.variant_display_name("name", "size").alias("variant_name"),
        fn.to_paise("price").alias("paise"),
        fn.to_rupees(F.col("price") * 100).alias("rupees_back"))


@register("product_json_rows", M.cte(p=M.PRODUCTS_SQL) + """
SELECT id, to_json(struct_pack(id := id, gender := gender, collection := collection, name := name,
                               size := size, price := price, stock := stock, active := active))
         AS json
FROM p WHERE active
""")
def q_product_json_rows(spark, d):
    """A4: the listing's rows as JSON texts (NULLs kept)."""
    from ..sources import to_json_rows

    listed = cat.list_products(M.products(spark, d), sort=False)
    return to_json_rows(listed, keep=["id"])


@register("products_snapshot", M.cte(p=M.PRODUCTS_SQL) + """
SELECT id, gender, collection, name, size, price, stock, CAST(NULL AS VARCHAR) AS image,
       CAST(NULL AS VARCHAR) AS description, active, CAST(NULL AS TIMESTAMP) AS created_at,
       CAST(NULL AS VARCHAR) AS name_bn, CAST(NULL AS VARCHAR) AS description_bn,
       CAST(NULL AS VARCHAR) AS sku
FROM p
""")
def q_products_snapshot(spark, d):
    """A1 + A8: a products snapshot written with the older column set and
    read back through the additive migration (missing columns added)."""
    from ..session import scratch_path
    from ..sources import load_products

    path = scratch_path(spark, "products-snapshot")
    M.products(spark, d).write.parquet(path)
    return load_products(spark, path)
