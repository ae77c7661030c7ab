"""Table mutations as set-based transforms.

Parquet snapshots are immutable, so each mutation is a pure function
``(tables, change set) -> MutationResult(table, changed, ...)``; the caller
writes ``table`` to a new snapshot path.  Row counts that the shop reports
(rowCount) are ``changed.count()`` -- an action left to the caller.

"NOW()" is always the explicit ``as_of`` argument, so runs are repeatable.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from .. import functions as fn
from ..sources import schema as S
from . import catalogue as cat
from .ids import assign_ids


@dataclass
class MutationResult:
    """New table, the affected rows (RETURNING), and any side outputs."""
    table: DataFrame
    changed: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)


def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def _last_per_key(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """One change per key, the last by ``seq`` (a plain aggregate)."""
    others = [c for c in changes.columns if c not in (key, seq)]
    agg = F.max_by(F.struct(*others), F.col(seq))
    return changes.groupBy(key).agg(agg.alias("__c")).select(key, "__c.*")


# C2 -------------------------------------------------------------------------
def referenced_ids(o: DataFrame) -> DataFrame:
    """Distinct product ids that some order refers to (NULLs excluded).

    The DISTINCT is not needed for the anti/semi-join result, but it is
    for skew: it runs as a map-side partial aggregate, so a product that a
    third of all orders refer to becomes one row before the join shuffle
    (AQE splits skew only on the left side of an anti join).
    """
    return (o.filter(F.col("product_id").isNotNull())
            .select(F.col("product_id").alias("id")).distinct())


def unreferenced_products(p: DataFrame, o: DataFrame) -> DataFrame:
    """Products no order refers to: ``left_anti`` against the non-NULL
    product ids (the guarded NOT IN)."""
    return p.join(referenced_ids(o), "id", "left_anti")


# H1 -------------------------------------------------------------------------
def set_stock(p: DataFrame, changes: DataFrame, seq: str = "seq") -> MutationResult:
    """New stock per product id; the last accepted change by ``seq`` wins.

    A change is one request: a NULL stock is refused ("not null"), a value
    that is no whole number too ("bad value"), an unknown id is "not found".
    ``extra['refused']`` holds those changes with their outcome.
    """
    new = F.col("stock").try_cast("int")
    judged = changes.select("id", "stock", F.col(seq).alias("__seq"), new.alias("__new")).join(
        p.select("id", F.lit(True).alias("__known")), "id", "left")
    outcome = (F.when(F.col("stock").isNull(), F.lit("not null"))
               .when(F.col("__new").isNull(), F.lit("bad value"))
               .when(F.col("__known").isNull(), F.lit("not found")))
    judged = judged.withColumn("outcome", outcome)
    ch = _last_per_key(judged.filter(F.col("outcome").isNull()).select("id", "__seq", "__new"),
                       "id", "__seq")
    j = p.join(ch, "id", "left")
    matched = F.col("__new").isNotNull()         # accepted values are never NULL
    table = j.withColumn("stock", F.when(matched, F.col("__new")).otherwise(F.col("stock")))
    changed = table.filter(matched).drop("__new")
    refused = judged.filter(F.col("outcome").isNotNull()).select(
        "id", F.col("__seq").alias(seq), "stock", "outcome")
    return MutationResult(table.drop("__new"), changed, {"refused": refused})


# B6 (for inserts) -------------------------------------------------------------
PRODUCT_REQUIRED_TEXT = ["gender", "collection", "name", "image"]
PRODUCT_REQUIRED_VALUE = ["price", "stock"]


def product_insert_reasons(new: DataFrame) -> Column:
    """Array of reasons a product insert is refused (empty = accepted).

    Text fields are refused when falsy (NULL or ''); price and stock only
    when NULL, so 0 is a valid price or stock.
    """
    checks = [F.when(~fn.truthy_text(c), F.lit(f"missing {c}")) for c in PRODUCT_REQUIRED_TEXT]
    checks += [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in PRODUCT_REQUIRED_VALUE]
    return F.array_compact(F.array(*checks))


# E2 + I1 + H2 ---------------------------------------------------------------
def insert_products(p: DataFrame, new: DataFrame, as_of,
                    order_by: list | None = None) -> MutationResult:
    """Insert products: validate, blank -> NULL, active, ids, generated SKU.

    Accepted rows get ids after the current maximum (in ``order_by`` order);
    a blank SKU becomes the generated one.  ``extra['rejected']`` holds the
    refused rows with their reasons.
    """
    def opt(c):
        return F.col(c) if c in new.columns else F.lit(None).cast("string")

    checked = new.withColumn("reasons", product_insert_reasons(new))
    rejected = checked.filter(F.size("reasons") > 0)
    ok = checked.filter(F.size("reasons") == 0).drop("reasons")
    ok = ok.select(
        "gender", "collection", "name",
        F.nullif(opt("name_bn"), F.lit("")).alias("name_bn"),
        F.nullif(opt("size"), F.lit("")).alias("size"),
        F.col("price").cast("int").alias("price"),
        F.col("stock").cast("int").alias("stock"),
        "image",
        F.nullif(opt("description"), F.lit("")).alias("description"),
        F.nullif(opt("description_bn"), F.lit("")).alias("description_bn"),
        fn.blank_to_null(opt("sku")).alias("sku_in"),
        *[c for c in (order_by or []) if isinstance(c, str) and c not in
          ("gender", "collection", "name", "image", "price", "stock", "size",
           "name_bn", "description", "description_bn", "sku")],
    )
    ids = assign_ids(ok, p, order_by=order_by)
    inserted = ids.select(
        "id", "gender", "collection", "name", "size", "price", "stock", "image",
        "description", F.lit(True).alias("active"), _ts(as_of).alias("created_at"),
        "name_bn", "description_bn",
        F.coalesce(F.col("sku_in"), fn.sku("id")).alias("sku"))
    table = p.unionByName(inserted, allowMissingColumns=True)
    return MutationResult(table, inserted, {"rejected": rejected})


# H3 -------------------------------------------------------------------------
_PRODUCT_TYPES = {f.name: f.dataType for f in S.PRODUCTS.fields}


def patch_products(p: DataFrame, patches: DataFrame, seq: str = "seq") -> MutationResult:
    """Partial update from a ``changes`` map: only present keys change.

    An explicitly NULL value sets NULL (``from_json(.., 'map<string,string>')``
    keeps it); keys outside the allowed list are ignored.  Every patch is one
    request and is judged by itself: "no fields" without an allowed key, "not
    found" for an unknown id, "not null" for a NULL in a NOT NULL column, "bad
    value" for text that is not of the column's type, "too long" beyond the
    column's length.  A refused patch changes nothing; accepted patches of one
    id apply in ``seq`` order (unique per id): per field the last value wins.
    ``extra['outcomes']`` has one row per patch.
    """
    allowed = [f for f in K.PRODUCT_PATCH_FIELDS if f in p.columns]
    allowed_arr = F.array(*[F.lit(f) for f in allowed])
    ch = F.map_filter("changes", lambda k, v: F.array_contains(allowed_arr, k))
    judged = patches.select("id", F.col(seq).alias("seq"), ch.alias("ch")).join(
        p.select("id", F.lit(True).alias("__exists")), "id", "left")

    def any_field(fields, bad) -> Column:
        return F.coalesce(F.greatest(F.lit(False), *[
            F.coalesce(bad(f, F.col("ch")[f]), F.lit(False)) for f in fields]), F.lit(False))

    typed = [f for f in allowed if not isinstance(_PRODUCT_TYPES.get(f, T.StringType()), T.StringType)]
    outcome = (F.when(F.coalesce(F.size("ch"), F.lit(0)) <= 0, F.lit("no fields"))
               .when(F.col("__exists").isNull(), F.lit("not found"))
               .when(any_field([f for f in K.PRODUCT_NOT_NULL if f in allowed], lambda f, v: (
                   F.map_contains_key("ch", F.lit(f)) & v.isNull())), F.lit("not null"))
               .when(any_field(typed, lambda f, v: (
                   v.isNotNull() & v.try_cast(_PRODUCT_TYPES[f]).isNull())), F.lit("bad value"))
               .when(any_field([f for f in K.PRODUCT_VARCHAR if f in allowed], lambda f, v: (
                   F.length(v) > K.PRODUCT_VARCHAR[f])), F.lit("too long"))
               .otherwise(F.lit("updated")))
    judged = judged.select("id", "seq", "ch", outcome.alias("outcome"))
    per_field = (judged.filter(F.col("outcome") == "updated")
                 .select("id", "seq", F.explode(F.map_entries("ch")).alias("e"))
                 .groupBy("id", F.col("e.key").alias("k"))
                 .agg(F.max_by(F.col("e.value"), F.col("seq")).alias("v")))
    # One entry per (id, allowed field): each map holds at most the 12
    # allowed fields, whatever the number of patches.
    good = per_field.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("ch"))
    j = p.join(good, "id", "left")
    sets = []
    for c in p.columns:
        if c in allowed:
            present = F.coalesce(F.map_contains_key("ch", F.lit(c)), F.lit(False))
            sets.append(F.when(present, F.col("ch")[c].try_cast(_PRODUCT_TYPES.get(c, T.StringType())))
                        .otherwise(F.col(c)).alias(c))
        else:
            sets.append(F.col(c))
    table = j.select(*sets, F.col("ch").isNotNull().alias("__hit"))
    changed = table.filter("__hit").drop("__hit")
    return MutationResult(table.drop("__hit"), changed,
                          {"outcomes": judged.select("id", "seq", "outcome")})


# H4 / H15 -------------------------------------------------------------------
def patch_orders(o: DataFrame, patches: DataFrame, as_of, mode: str = "coalesce",
                 seq: str = "seq") -> MutationResult:
    """Order patch (status, tracking_number, notes) from a ``changes`` map.

    mode "coalesce" (database path): a NULL or absent value keeps the old
    one.  mode "presence" (file path): a present key sets its value, even
    NULL.  Every matched row gets ``updated_at = as_of`` (the trigger fires
    even when the values do not change).  Patches apply in ``seq`` order.
    """
    seqc = F.col(seq)
    aggs = []
    for f in K.ORDER_PATCH_FIELDS:
        v = F.col("changes")[f]
        if mode == "coalesce":
            present = v.isNotNull()
        elif mode == "presence":
            present = F.coalesce(F.map_contains_key("changes", F.lit(f)), F.lit(False))
        else:
            raise ValueError(mode)
        order = F.when(present, seqc)
        aggs += [F.max_by(v, order).alias(f"__v_{f}"),
                 F.max(order).isNotNull().alias(f"__p_{f}")]
    per_id = patches.groupBy("id").agg(*aggs, F.lit(True).alias("__hit"))
    j = o.join(per_id, "id", "left")
    cols = []
    for c in o.columns:
        if c in K.ORDER_PATCH_FIELDS:
            cols.append(F.when(F.coalesce(F.col(f"__p_{c}"), F.lit(False)), F.col(f"__v_{c}"))
                        .otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(F.col("__hit"), _ts(as_of)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    table = j.select(*cols, F.coalesce(F.col("__hit"), F.lit(False)).alias("__hit"))
    changed = table.filter("__hit").drop("__hit")
    not_found = patches.select("id").distinct().join(o.select("id"), "id", "left_anti")
    return MutationResult(table.drop("__hit"), changed, {"not_found": not_found})


# H5 -------------------------------------------------------------------------
def soft_delete(p: DataFrame, ids: DataFrame) -> MutationResult:
    """active = false for the given ids; changed = ids that exist."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    j = p.join(hit, "id", "left")
    h = F.coalesce(F.col("__hit"), F.lit(False))
    table = j.withColumn("active", F.when(h, F.lit(False)).otherwise(F.col("active")))
    return MutationResult(table.drop("__hit"), table.filter(h).select("id"))


# H6 -------------------------------------------------------------------------
def wipe_products(p: DataFrame, o: DataFrame) -> MutationResult:
    """Drop unreferenced products, deactivate the referenced ones.

    ``changed`` = hard-deleted ids; ``extra['soft']`` = ids deactivated (only
    rows that were still active count); ``extra['summary']`` = both counts.
    """
    refs = referenced_ids(o)
    hard = p.join(refs, "id", "left_anti").select("id")
    kept = p.join(refs, "id", "left_semi")
    soft = kept.filter(F.col("active")).select("id")
    table = kept.withColumn("active", F.lit(False))
    summary = (hard.agg(F.count(F.lit(1)).alias("hard_deleted"))
               .select("hard_deleted",
                       soft.agg(F.count(F.lit(1))).scalar().alias("soft_deleted")))
    return MutationResult(table, hard, {"soft": soft, "summary": summary})


# H7 -------------------------------------------------------------------------
def purge_inactive(p: DataFrame, o: DataFrame) -> MutationResult:
    """Delete inactive products no order refers to; counts on what is left."""
    inactive = p.filter(~F.col("active"))
    deleted = inactive.join(referenced_ids(o), "id", "left_anti")
    table = p.join(deleted.select("id"), "id", "left_anti")
    return MutationResult(table, deleted.select("id", "name", "size"),
                          {"counts": cat.inventory_counts(table)})


# H8 -------------------------------------------------------------------------
def dedupe_products(p: DataFrame) -> MutationResult:
    """Deactivate every active copy except the best (max stock, min id).

    The kept id per key is an aggregate (``best_copy``), not a window, so a
    key with very many copies is reduced map-side; the join back uses a
    null-safe key (NULL sizes form one group) and AQE splits a hot key.
    Inactive rows are outside the ranking.
    """
    best = cat.best_copy(p).select(*[F.col(c).alias(f"__{c}") for c in cat.DEDUPE_KEY],
                                   "keep_id")
    cond = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cat.DEDUPE_KEY]
    on = cond[0] & cond[1] & cond[2] & cond[3]
    j = p.join(best, on, "left")
    lose = F.col("active") & F.col("keep_id").isNotNull() & (F.col("id") != F.col("keep_id"))
    table = j.select(*[F.when(lose, F.lit(False)).otherwise(F.col(c)).alias(c)
                       if c == "active" else F.col(c) for c in p.columns],
                     lose.alias("__lose"))
    changed = table.filter("__lose").select("id", "name", "size", "stock")
    table = table.drop("__lose")
    return MutationResult(table, changed, {"after": cat.duplicate_summary(table)})


# H9 / H10 ---------------------------------------------------------------------
def delete_orders(o: DataFrame, ids: DataFrame) -> MutationResult:
    d = ids.select("id").distinct()
    return MutationResult(o.join(d, "id", "left_anti"), o.join(d, "id", "left_semi").select("id"))


def clear_orders(o: DataFrame) -> MutationResult:
    """Empty table of the same schema; changed = every id (the count)."""
    return MutationResult(o.filter(F.lit(False)), o.select("id"))


# H11 ------------------------------------------------------------------------
def apply_payments(o: DataFrame, verified: DataFrame, as_of,
                   seq: str = "seq") -> MutationResult:
    """Promote pending orders to paid for verified payments.

    Matches on the gateway order id and only rows still 'pending'; for
    several verified payments of one gateway order the first (by ``seq``)
    is the one that promotes.  ``updated_at`` = as_of on promoted rows.
    """
    seqc = F.col(seq)
    first = (verified.groupBy("razorpay_order_id")
             .agg(F.min_by("razorpay_payment_id", seqc).alias("__pay")))
    j = o.join(first, "razorpay_order_id", "left")
    hit = F.col("__pay").isNotNull() & (F.col("payment_status") == K.PAYMENT_PENDING)
    cols = []
    for c in o.columns:
        if c == "payment_status":
            cols.append(F.when(hit, F.lit(K.PAYMENT_PAID)).otherwise(F.col(c)).alias(c))
        elif c == "razorpay_payment_id":
            cols.append(F.when(hit, F.col("__pay")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(hit, _ts(as_of)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    table = j.select(*cols, hit.alias("__hit"))
    return MutationResult(table.drop("__hit"), table.filter("__hit").drop("__hit"))


# H12 ------------------------------------------------------------------------
def confirm_orders(o: DataFrame, calls: DataFrame, as_of, seq: str = "seq") -> MutationResult:
    """Idempotent received -> confirmed per gateway order id.

    The first call for a gateway id promotes every matching 'received' row
    (outcome 'promoted'); later calls, or calls whose rows are past
    'received', only report the existing row ('existing'); calls with no
    matching order give 'none'.  Rows swept as abandoned but still
    'received' are confirmed too (flag ``confirmed_after_abandon``).
    """
    seqc = F.col(seq)
    first = calls.groupBy("razorpay_order_id").agg(F.min(seqc).alias("__first"))
    m = o.join(first.select("razorpay_order_id", F.lit(True).alias("__call")),
               "razorpay_order_id", "left")
    hit = F.coalesce(F.col("__call"), F.lit(False)) & (F.col("status") == K.STATUS_RECEIVED)
    cols = []
    for c in o.columns:
        if c == "status":
            cols.append(F.when(hit, F.lit(K.STATUS_CONFIRMED)).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(hit, _ts(as_of)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    table = m.select(*cols, hit.alias("__hit"))
    changed = table.filter("__hit").drop("__hit").withColumn(
        "confirmed_after_abandon", F.col("payment_status") == K.PAYMENT_ABANDONED)
    per_gw = (o.groupBy("razorpay_order_id")
              .agg(F.count_if(F.col("status") == K.STATUS_RECEIVED).alias("__recv"),
                   F.min("id").alias("order_id")))
    # The calls are read once: the least seq of each id by a window over them.
    c = calls.select("razorpay_order_id", seqc.alias("__seq")).filter(F.col("razorpay_order_id").isNotNull())
    c = c.withColumn("__first", F.min("__seq").over(Window.partitionBy("razorpay_order_id")))
    c = c.join(per_gw, "razorpay_order_id", "left")
    outcome = (F.when(F.col("order_id").isNull(), F.lit("none"))
               .when((F.col("__seq") == F.col("__first")) & (F.col("__recv") > 0),
                     F.lit("promoted"))
               .otherwise(F.lit("existing")))
    outcomes = c.select("razorpay_order_id", F.col("__seq").alias("seq"), "order_id",
                        outcome.alias("outcome"))
    flagged = table.withColumnRenamed("__hit", "promoted")
    return MutationResult(table.drop("__hit"), changed,
                          {"outcomes": outcomes, "flagged": flagged})


# H16 ------------------------------------------------------------------------
def append_orders(o: DataFrame, new: DataFrame, as_of, mode: str = "db",
                  order_by: list | None = None) -> MutationResult:
    """Append orders with derived states.

    payment_status = 'paid' when a payment id is truthy, else 'pending'.
    status: 'received' on the database path; on the file path 'confirmed'
    when paid.  quantity || 1.  Ids follow the current maximum.
    ``ordered_at`` is taken from the input when present, else ``as_of``.
    """
    paid = fn.truthy_text("razorpay_payment_id")
    status = (F.when(paid, F.lit(K.STATUS_CONFIRMED)).otherwise(F.lit(K.STATUS_RECEIVED))
              if mode == "file" else F.lit(K.STATUS_RECEIVED))
    ts = F.col("ordered_at") if "ordered_at" in new.columns else _ts(as_of)

    def opt(c, t="string"):
        return F.col(c).cast(t) if c in new.columns else F.lit(None).cast(t)

    rows = new.select(
        opt("product_id", "long").alias("product_id"),
        opt("customer_name").alias("customer_name"),
        opt("customer_phone").alias("customer_phone"),
        opt("customer_email").alias("customer_email"),
        opt("customer_address").alias("customer_address"),
        opt("size").alias("size"),
        fn.number_or(opt("quantity", "int"), 1).cast("int").alias("quantity"),
        opt("price_paid", "int").alias("price_paid"),
        status.alias("status"),
        F.lit(None).cast("string").alias("tracking_number"),
        F.lit(None).cast("string").alias("notes"),
        ts.cast("timestamp").alias("ordered_at"),
        ts.cast("timestamp").alias("updated_at"),
        F.nullif(opt("razorpay_order_id"), F.lit("")).alias("razorpay_order_id"),
        F.nullif(opt("razorpay_payment_id"), F.lit("")).alias("razorpay_payment_id"),
        F.when(paid, F.lit(K.PAYMENT_PAID)).otherwise(F.lit(K.PAYMENT_PENDING))
         .alias("payment_status"),
        *[F.col(c) for c in (order_by or []) if isinstance(c, str) and c not in
          ("product_id", "customer_name", "customer_phone", "customer_email",
           "customer_address", "size", "quantity", "price_paid", "ordered_at",
           "razorpay_order_id", "razorpay_payment_id")],
    )
    ided = assign_ids(rows, o, order_by=order_by)
    inserted = ided.select(*[c for c in S.ORDERS.fieldNames()])
    return MutationResult(o.unionByName(inserted, allowMissingColumns=True), inserted)


# C4 -------------------------------------------------------------------------
def insert_if_absent(p: DataFrame, new: DataFrame, key: str = "name",
                     seq: str = "seq", order_by: list | None = None) -> MutationResult:
    """Insert rows whose ``key`` is not in the table yet.

    The statements run one after another, so a key repeated inside the
    batch inserts once: the first row per key (``min_by`` on ``seq``, an
    aggregate that reduces a repeated key map-side) before the anti join.
    """
    others = [c for c in new.columns if c not in (key,)]
    first = (new.groupBy(key).agg(F.min_by(F.struct(*others), F.col(seq)).alias("__r"))
             .select(key, "__r.*"))
    # Existing keys de-duplicated map-side first: a key shared by very many
    # rows becomes one row before the anti-join shuffle.
    fresh = first.join(p.select(F.col(key)).distinct(), key, "left_anti")
    ided = assign_ids(fresh, p, order_by=order_by or [seq])
    ided = ided.withColumn("active", F.lit(True)) if "active" not in ided.columns else ided
    inserted = ided.drop(seq)
    return MutationResult(p.unionByName(inserted, allowMissingColumns=True), inserted)


# C5 -------------------------------------------------------------------------
def seed_if_empty(p: DataFrame, seed: DataFrame, seq: str | None = None) -> MutationResult:
    """Insert the seed rows only when the table has no row at all.

    The emptiness test is an uncorrelated EXISTS over ``p`` (one row read),
    not a driver-side count.
    """
    any_row = p.select(F.lit(1).alias("x")).exists()
    rows = seed.filter(~any_row)
    ided = assign_ids(rows, p, order_by=[seq] if seq else None)
    ided = ided.withColumn("active", F.lit(True))
    return MutationResult(p.unionByName(ided, allowMissingColumns=True), ided)
