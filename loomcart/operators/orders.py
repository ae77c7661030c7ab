"""Order listing and order enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich_orders(o: DataFrame, p: DataFrame) -> DataFrame:
    """Every order with its product's name, collection, gender and image.

    Left join on product_id: orders without product (NULL id) or with an
    unknown id keep their row with NULL product fields.  The products side
    is one row per id; the planner picks the join (AQE makes it a
    broadcast when products is small, and splits a hot product_id
    partition on the orders side when it is skewed).
    """
    pcols = [F.col("name").alias("product_name"), "collection", "gender"]
    if "image" in p.columns:
        pcols.append("image")
    pp = p.select(F.col("id").alias("__pid"), *pcols)
    return (o.join(pp, o.product_id == pp.__pid, "left").drop("__pid"))


def list_orders(o: DataFrame, p: DataFrame, status: str | None = None,
                sort: bool = True) -> DataFrame:
    """Orders with product fields, optional status filter, newest first.

    The status filter is applied to ``o`` before the join, so it is pushed
    into the orders scan.  Ties on ordered_at are broken by id (desc) so
    the order is total.
    """
    if status:
        o = o.filter(F.col("status") == F.lit(status))
    out = enrich_orders(o, p)
    return out.orderBy(F.col("ordered_at").desc(), F.col("id").desc()) if sort else out


def newest_first(df: DataFrame) -> DataFrame:
    """newest-first order of a document list (sort key id)."""
    return df.orderBy(F.col("id").desc())


def dangling_orders(o: DataFrame, p: DataFrame) -> DataFrame:
    """Orders whose non-NULL product_id matches no product."""
    ids = p.select(F.col("id").alias("product_id"))
    return o.filter(F.col("product_id").isNotNull()).join(ids, "product_id", "left_anti")


def with_product_name(changed: DataFrame, p: DataFrame) -> DataFrame:
    """Changed orders with product name; rows without match are kept."""
    pp = p.select(F.col("id").alias("__pid"), F.col("name").alias("product_name"))
    base = changed.drop("product_name") if "product_name" in changed.columns else changed
    return base.join(pp, base.product_id == pp.__pid, "left").drop("__pid")
