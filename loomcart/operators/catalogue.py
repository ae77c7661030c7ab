"""Catalogue queries: listing, grouping into cards, ranking, storefront.

Covers B1, B2, B4, B5, B11, C9, C10, D1, D2, D3, D4, E1, F1, F4, K4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from .joins import join_small
from .ranking import keyed_row_number


# B1 -------------------------------------------------------------------------
def active_products(p: DataFrame) -> DataFrame:
    return p.filter(F.col("active"))


# F1 -------------------------------------------------------------------------
def listing_order() -> list[Column]:
    """ORDER BY collection, name, size -- NULL sizes last as in Postgres;
    id breaks the remaining ties so the order is total."""
    return [F.col("collection").asc(), F.col("name").asc(),
            F.col("size").asc_nulls_last(), F.col("id").asc()]


# B2 -------------------------------------------------------------------------
def list_products(p: DataFrame, gender: str | None = None,
                  collection: str | None = None, sort: bool = True) -> DataFrame:
    """Active products, optional AND-ed equality filters (empty = no filter).

    The filters are plain equalities on scan columns, so they reach the
    parquet reader as pushed filters.
    """
    out = active_products(p)
    if gender:
        out = out.filter(F.col("gender") == F.lit(gender))
    if collection:
        out = out.filter(F.col("collection") == F.lit(collection))
    return out.orderBy(*listing_order()) if sort else out


# B4 -------------------------------------------------------------------------
def lookup(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Batch point lookup: each requested key with its row and a found flag."""
    t = table.withColumn("__found", F.lit(True))
    return (keys.select(key).join(t, key, "left")
            .withColumn("found", F.coalesce(F.col("__found"), F.lit(False)))
            .drop("__found"))


# B5 -------------------------------------------------------------------------
# C10 ------------------------------------------------------------------------
def with_label(df: DataFrame, labels: DataFrame, key_col: str,
               out_col: str = "label", known_rows: int | None = None) -> DataFrame:
    """Display label for a key; the key itself when no label exists.

    ``labels`` is a short list, broadcast when its size is known (a fixed
    list) or shown small by a bounded count.
    """
    lab = labels.select(F.col("key").alias("__k"), F.col("label").alias("__l"))
    j = join_small(df, lab, F.col(key_col) == F.col("__k"), "left", known_rows=known_rows)
    return j.withColumn(out_col, F.coalesce(F.col("__l"), F.col(key_col))).drop("__k", "__l")


# D1 -------------------------------------------------------------------------
def inventory_counts(p: DataFrame) -> DataFrame:
    """COUNT(*) FILTER (WHERE active), (WHERE NOT active), COUNT(*)."""
    return p.agg(F.count_if(F.col("active")).cast("long").alias("active_count"),
                 F.count_if(~F.col("active")).cast("long").alias("inactive_count"),
                 F.count(F.lit(1)).cast("long").alias("total_count"))


# E1 -------------------------------------------------------------------------
DEDUPE_KEY = ["gender", "collection", "name", "size"]


def rank_duplicates(p: DataFrame) -> DataFrame:
    """Keep-best rank among active rows: highest stock, then lowest id.

    NULL sizes form one group, as in SQL.  Numbered with
    ``keyed_row_number`` (range-partitioned, offsets per partition), so
    the copies of one product may be arbitrarily many.
    """
    a = active_products(p).select("id", *DEDUPE_KEY, "stock")
    return keyed_row_number(a, DEDUPE_KEY, [F.col("stock").desc(), F.col("id").asc()], "rn")


def best_copy(p: DataFrame) -> DataFrame:
    """Per duplicate key, the id of the kept row: (max stock, min id).

    A plain aggregate (partial aggregation map-side), so even a key that
    holds a third of all rows is reduced before the shuffle.
    """
    best = F.max_by(F.col("id"), F.struct(F.col("stock"), -F.col("id")))
    return (active_products(p).groupBy(*DEDUPE_KEY)
            .agg(best.alias("keep_id"), F.count(F.lit(1)).alias("copies")))


# D2 -------------------------------------------------------------------------
def duplicate_summary(p: DataFrame) -> DataFrame:
    """Active rows and number of duplicate groups (HAVING COUNT(*) > 1)."""
    a = active_products(p)
    groups = a.groupBy(*DEDUPE_KEY).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.sum("n").cast("int").alias("active_count"),
        F.count_if(F.col("n") > 1).cast("int").alias("remaining_duplicate_groups"),
    ).select(F.coalesce("active_count", F.lit(0)).alias("active_count"),
             "remaining_duplicate_groups")


# F4 / D3 / D4 / I17 ----------------------------------------------------------
CARD_KEY = ["gender", "collection", "name"]


def product_cards(p: DataFrame) -> DataFrame:
    """One card per product (gender, collection, name): its attributes.

    Price, image and description come from the first row in listing order
    (``min_by`` over the listing key; never ``first``); ``any_in_stock``
    and ``sized`` are boolean aggregates; ``n_variants`` counts the rows.
    All are plain aggregates, reduced map-side, so a card with very many
    rows costs no single task more than its share.  The variants
    themselves are rows of ``card_variants``.
    """
    a = active_products(p)
    order_key = F.struct(F.col("collection"), F.col("name"),
                         F.col("size").isNull(), F.col("size"), F.col("id"))
    attr_cols = [c for c in ("price", "image", "description") if c in a.columns]
    first = F.min_by(F.struct(*[F.col(c) for c in attr_cols]), order_key)
    cards = a.groupBy(*CARD_KEY).agg(
        first.alias("first"),
        F.bool_or(F.col("stock") > 0).alias("any_in_stock"),
        F.bool_or(fn.truthy_text("size")).alias("sized"),
        F.count(F.lit(1)).cast("int").alias("n_variants"),
    )
    return cards.select(*CARD_KEY, *[F.col("first")[c].alias(c) for c in attr_cols],
                        "any_in_stock", "sized", "n_variants")


def variant_order() -> list[Column]:
    """Storefront variant order: size rank (unknown 99), then listing order."""
    return [fn.size_rank("size").asc(), F.col("size").isNull().asc(),
            F.col("size").asc(), F.col("id").asc()]


def card_variants(p: DataFrame) -> DataFrame:
    """The variants of every card, one row each, with their position on the
    card (``pos`` from 1) and the sold-out marker (stock <= 0)."""
    a = active_products(p).select(*CARD_KEY, "id", "size", "stock")
    ranked = keyed_row_number(a, CARD_KEY, variant_order(), "pos")
    return ranked.withColumn("out", F.col("stock") <= 0)


# B11 ------------------------------------------------------------------------
def catalogue_items(c: DataFrame) -> DataFrame:
    """Flatten a nested catalogue: one row per (collection, position, item)."""
    return c.select("key", "name", F.posexplode("items").alias("pos", "item"))


def nested_catalogue(p: DataFrame) -> DataFrame:
    """Nested catalogue records built from products, one per active product:
    key (id), name, and its words as the ``items`` array (the literal
    catalogue's shape; each array is bounded by its own row)."""
    a = active_products(p)
    return a.select(F.col("id").cast("string").alias("key"), "name",
                    F.split("name", " ").alias("items"))


# C9 -------------------------------------------------------------------------
def resolve_variant(req: DataFrame, p: DataFrame) -> DataFrame:
    """Resolve (gender, name[, size]) requests to one product row.

    The storefront searches the gender listing for the first row with that
    name and, if a size was picked, that size.  Without a size the first
    row in listing order wins (so 'L' before 'M' before 'S', even if sold
    out) -- kept for parity.  Requests need a unique ``request_id``.

    Candidates are first reduced to the single best row per (gender, name)
    and per (gender, name, size) -- plain aggregates, reduced map-side --
    so each request meets at most one candidate: no request x variant
    pairs, however many copies a name has.
    """
    a = active_products(p)
    order = F.struct(F.col("collection"), F.col("name"), F.col("size").isNull(),
                     F.col("size"), F.col("id"))
    best = F.min_by(F.struct(F.col("id").alias("product_id"), F.col("size").alias("resolved_size"),
                             F.col("stock").alias("resolved_stock")), order)
    any_size = (a.groupBy("gender", "name").agg(best.alias("b"))
                .select(F.col("gender").alias("__g"), F.col("name").alias("__n"), "b"))
    by_size = (a.filter(F.col("size").isNotNull()).groupBy("gender", "name", "size")
               .agg(best.alias("b"))
               .select(F.col("gender").alias("__g"), F.col("name").alias("__n"),
                       F.col("size").alias("__s"), "b"))
    has_size = fn.truthy_text("size")
    sized = req.filter(has_size)
    unsized = req.filter(~has_size)
    j1 = sized.join(by_size, (F.col("gender") == F.col("__g")) & (F.col("name") == F.col("__n"))
                    & (F.col("size") == F.col("__s")), "left")
    j2 = unsized.join(any_size, (F.col("gender") == F.col("__g"))
                      & (F.col("name") == F.col("__n")), "left")
    cols = [*[F.col(c) for c in req.columns], F.col("b.product_id").alias("product_id"),
            F.col("b.resolved_size").alias("resolved_size"),
            F.col("b.resolved_stock").alias("resolved_stock")]
    return j1.select(*cols).unionByName(j2.select(*cols))


# K4 -------------------------------------------------------------------------
def storefront(p: DataFrame, labels: DataFrame, gender: str | None = None,
               collection: str | None = None, label_rows: int | None = None) -> DataFrame:
    """One row per listed variant as the shop page shows it."""
    listed = list_products(p, gender, collection, sort=False)
    listed = with_label(listed, labels, "collection", "collection_label", label_rows)
    return listed.select(
        "id", "gender", "collection", "collection_label", "name", "size",
        fn.rupees("price").alias("price_text"),
        fn.image_src("image").alias("image_src"),
        (F.col("stock") > 0).alias("in_stock"),
        F.concat(F.col("name"), fn.optional_piece("size", " (Size ", ")")).alias("display_name"),
    )
