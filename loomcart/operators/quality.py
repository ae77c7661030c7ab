"""Data-quality checks (B6, B7, B12, D8).  C8 lives in ``orders``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .. import functions as fn


def _reasons(checks: list[Column]) -> Column:
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


# B6 -------------------------------------------------------------------------
def validate_required(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Add ``reasons``: 'missing <f>' for each failed required field.

    spec maps field -> 'truthy' (refuse NULL and '', as ``!x``) or
    'not_null' (refuse only NULL, as ``x == null``; 0 is valid).
    """
    checks = []
    for f, rule in spec.items():
        if rule == "truthy":
            bad = ~fn.truthy_text(F.col(f).cast("string"))
        elif rule == "not_null":
            bad = F.col(f).isNull()
        else:
            raise ValueError(rule)
        checks.append(F.when(bad, F.lit(f"missing {f}")))
    return df.withColumn("reasons", _reasons(checks))


ORDER_FORM = {"customer_name": "truthy", "customer_phone": "truthy",
              "customer_email": "truthy", "customer_address": "truthy"}


# B7 -------------------------------------------------------------------------
def validate_amount(df: DataFrame, col: str = "amount") -> DataFrame:
    """Gateway amount in paise: a number, integral, and >= 100.

    ``amount_paise`` is the parsed value (NULL when not a number) and
    ``amount_ok`` the verdict.
    """
    x = F.expr(f"try_cast(`{col}` AS DOUBLE)")
    ok = x.isNotNull() & (x == F.floor(x)) & (x >= F.lit(K.MIN_AMOUNT_PAISE))
    return (df.withColumn("amount_paise", F.when(x == F.floor(x), x.cast("long")))
              .withColumn("amount_ok", F.coalesce(ok, F.lit(False))))


# B12 ------------------------------------------------------------------------
def check_constraints(df: DataFrame, not_null: list[str],
                      varchar: dict[str, int]) -> DataFrame:
    """Reasons a row breaks NOT NULL or VARCHAR(n) (checked explicitly:
    parquet tables accept NULL into non-nullable fields)."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"null {c}")) for c in not_null
              if c in df.columns]
    checks += [F.when(F.length(F.col(c)) > n, F.lit(f"too long {c}"))
               for c, n in varchar.items() if c in df.columns]
    return df.withColumn("violations", _reasons(checks))


def check_products(p: DataFrame) -> DataFrame:
    return check_constraints(p, K.PRODUCT_NOT_NULL, K.PRODUCT_VARCHAR)


def check_orders(o: DataFrame) -> DataFrame:
    return check_constraints(o, K.ORDER_NOT_NULL, K.ORDER_VARCHAR)


# D8 -------------------------------------------------------------------------
def duplicate_skus(p: DataFrame) -> DataFrame:
    """SKUs (non-NULL) held by more than one product; partial aggregation
    reduces a very common SKU map-side."""
    return (p.filter(F.col("sku").isNotNull()).groupBy("sku")
            .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
            .filter(F.col("n") > 1))
