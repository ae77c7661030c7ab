"""Registered data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import quality as qa
from . import mapping as M
from .registry import register

_FO = M.FULL_ORDERS_SQL


@register("validate_order_form", M.cte(o=_FO) + """
SELECT id, array_to_string(list_filter([
   CASE WHEN customer_name IS NULL OR customer_name = '' THEN 'missing customer_name' END,
   CASE WHEN customer_phone IS NULL OR customer_phone = '' THEN 'missing customer_phone' END,
   CASE WHEN customer_email IS NULL OR customer_email = '' THEN 'missing customer_email' END,
   CASE WHEN customer_address IS NULL OR customer_address = '' THEN 'missing customer_address' END
 ], lambda x: x IS NOT NULL), '|') AS reasons
FROM o
""")
def q_validate_form(spark, d):
    """Order-form required fields (all must be non-empty)."""
    return qa.validate_required(M.full_orders(spark, d), qa.ORDER_FORM).select(
        "id", F.array_join("reasons", "|").alias("reasons"))


def _amounts(spark, d):
    """Gateway amounts by rule: received lines send paise (valid), confirmed
    lines a fractional amount, shipped lines their quantity (mostly < 100)."""
    so = M.shop_orders(spark, d)
    amt = (F.when(so.status == "received", (so.price_paid * 100).cast("string"))
           .when(so.status == "confirmed",
                 F.concat((so.price_paid * 100).cast("string"), F.lit(".5")))
           .otherwise(so.quantity.cast("string")))
    return so.select("id", amt.alias("amount"))


@register("validate_amounts", M.cte(so=M.SHOP_ORDERS_SQL) + f""",
a AS (SELECT id, CASE WHEN status = 'received' THEN CAST(price_paid * 100 AS VARCHAR)
                      WHEN status = 'confirmed' THEN CAST(price_paid * 100 AS VARCHAR) || '.5'
                      ELSE CAST(quantity AS VARCHAR) END AS amount FROM so),
x AS (SELECT id, amount, TRY_CAST(amount AS DOUBLE) AS v FROM a)
SELECT id, amount, CASE WHEN v = floor(v) THEN CAST(v AS BIGINT) END AS amount_paise,
       coalesce(v = floor(v) AND v >= {K.MIN_AMOUNT_PAISE}, false) AS amount_ok
FROM x
""")
def q_validate_amounts(spark, d):
    """Integral amount of at least 100 paise."""
    return qa.validate_amount(_amounts(spark, d)).select("id", "amount", "amount_paise",
                                                          "amount_ok")


def _violations_sql(src: str, not_null: list[str], varchar: dict[str, int]) -> str:
    parts = [f"CASE WHEN {c} IS NULL THEN 'null {c}' END" for c in not_null]
    parts += [f"CASE WHEN length({c}) > {n} THEN 'too long {c}' END" for c, n in varchar.items()]
    return (f"SELECT id, array_to_string(list_filter([{', '.join(parts)}], "
            f"lambda x: x IS NOT NULL), '|') AS violations "
            f"FROM ({src})")


@register("check_product_constraints", _violations_sql(
    M.PRODUCTS_EXT_SQL, [c for c in K.PRODUCT_NOT_NULL], K.PRODUCT_VARCHAR))
def q_check_products(spark, d):
    """NOT NULL and VARCHAR(n) checks on every product row."""
    return qa.check_products(M.products(spark, d, extended=True)).select(
        "id", F.array_join("violations", "|").alias("violations"))


@register("check_order_constraints", _violations_sql(
    _FO, [c for c in K.ORDER_NOT_NULL], K.ORDER_VARCHAR))
def q_check_orders(spark, d):
    """B12 on every order row (e-mail is nullable; size is NULL here)."""
    return qa.check_orders(M.full_orders(spark, d)).select(
        "id", F.array_join("violations", "|").alias("violations"))


@register("duplicate_skus", M.cte(p=M.PRODUCTS_EXT_SQL) + """
SELECT sku, count(*) AS n, min(id) AS first_id FROM p WHERE sku IS NOT NULL
GROUP BY sku HAVING count(*) > 1
""")
def q_duplicate_skus(spark, d):
    """SKU uniqueness over non-NULL SKUs."""
    return qa.duplicate_skus(M.products(spark, d, extended=True))
