from pyspark.sql import functions as F

from loomcart.operators import catalogue as cat
from loomcart.operators import mutations as mu
from loomcart.operators import stock as st
from loomcart.operators.ids import assign_ids

AS_OF = "1995-02-01 00:00:00"
P_SCHEMA = "id long, gender string, collection string, name string, size string, price int, stock int, active boolean"


def products(spark, rows):
    return spark.createDataFrame(rows, P_SCHEMA)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_dedupe_keeps_best_and_is_idempotent(spark):
    p = products(spark, [
        (1, "m", "c", "A", "S", 10, 3, True), (2, "m", "c", "A", "S", 10, 5, True),
        (3, "m", "c", "A", "S", 10, 5, True), (4, "m", "c", "B", None, 10, 1, True),
        (5, "m", "c", "B", None, 10, 1, True), (6, "m", "c", "B", None, 10, 9, False)])
    r = mu.dedupe_products(p)
    assert rows(r.changed, "id") == [(1,), (3,), (5,)]
    assert rows(r.extra["after"], "remaining_duplicate_groups") == [(0,)]
    again = mu.dedupe_products(r.table)
    assert again.changed.count() == 0
    assert rows(again.table, "id", "active") == rows(r.table, "id", "active")


def test_purge_and_wipe(spark):
    p = products(spark, [(1, "m", "c", "A", "S", 1, 1, False), (2, "m", "c", "B", "S", 1, 1, False),
                         (3, "m", "c", "C", "S", 1, 1, True)])
    o = spark.createDataFrame([(10, 2), (11, None)], "id long, product_id long")
    r = mu.purge_inactive(p, o)
    assert rows(r.changed, "id") == [(1,)]
    assert mu.purge_inactive(r.table, o).changed.count() == 0
    w = mu.wipe_products(p, o)
    assert rows(w.extra["summary"], "hard_deleted", "soft_deleted") == [(2, 0)]
    assert rows(w.table, "id", "active") == [(2, False)]


def test_unreferenced_ignores_null_product(spark):
    p = products(spark, [(1, "m", "c", "A", "S", 1, 1, True), (2, "m", "c", "B", "S", 1, 1, True)])
    o = spark.createDataFrame([(10, None), (11, 2)], "id long, product_id long")
    assert rows(mu.unreferenced_products(p, o), "id") == [(1,)]


def test_insert_if_absent_first_wins_and_idempotent(spark):
    p = products(spark, [(1, "j", "s", "Ring", None, 1, 1, True)])
    new = spark.createDataFrame([("Ring", 1), ("Chain", 2), ("Chain", 3), ("Coin", 4)],
                                "name string, seq long").withColumn("price", F.col("seq") * 10)
    r = mu.insert_if_absent(p, new)
    assert rows(r.changed, "id", "name", "price") == [(2, "Chain", 20), (3, "Coin", 40)]
    assert mu.insert_if_absent(r.table, new).changed.count() == 0


def test_seed_only_when_empty(spark):
    seed = spark.createDataFrame([("A", 1), ("B", 2)], "name string, seq long")
    empty = products(spark, []).select("id", "name")
    r = mu.seed_if_empty(empty, seed, seq="seq")
    assert rows(r.changed, "id", "name") == [(1, "A"), (2, "B")]
    assert mu.seed_if_empty(r.table.select("id", "name"), seed, seq="seq").changed.count() == 0


def test_patch_products_presence_and_null(spark):
    p = products(spark, [(1, "m", "c", "A", "S", 10, 1, True), (2, "m", "c", "B", "M", 10, 1, True)])
    patches = spark.createDataFrame(
        [(1, {"size": None}, 1), (2, {}, 1), (3, {"stock": "4"}, 1), (1, {"stock": "7"}, 2)],
        "id long, changes map<string,string>, seq int")
    r = mu.patch_products(p, patches)
    assert rows(r.changed, "id", "size", "stock") == [(1, None, 7)]
    assert rows(r.extra["outcomes"], "id", "seq", "outcome") == [
        (1, 1, "updated"), (1, 2, "updated"), (2, 1, "no fields"), (3, 1, "not found")]


def test_patches_are_judged_one_by_one(spark):
    p = products(spark, [(i, "m", "c", "A", "S", 10, 1, True) for i in (1, 2, 3, 4)])
    patches = spark.createDataFrame(
        [(1, {"price": "99"}, 1), (1, {"name": None}, 2),
         (2, {"name": None, "price": "77"}, 1), (2, {"name": "X"}, 2),
         (3, {"price": "abc"}, 1), (3, {"stock": "4"}, 2),
         (4, {"gender": "far too long a text"}, 1)],
        "id long, changes map<string,string>, seq int")
    r = mu.patch_products(p, patches)
    assert rows(r.extra["outcomes"], "id", "seq", "outcome") == [
        (1, 1, "updated"), (1, 2, "not null"), (2, 1, "not null"), (2, 2, "updated"),
        (3, 1, "bad value"), (3, 2, "updated"), (4, 1, "too long")]
    assert rows(r.changed, "id", "name", "price", "stock") == [
        (1, "A", 99, 1), (2, "X", 10, 1), (3, "A", 10, 4)]


def test_set_stock_refuses_null(spark):
    p = products(spark, [(1, "m", "c", "A", "S", 10, 1, True), (2, "m", "c", "B", "M", 10, 2, True)])
    ch = spark.createDataFrame([(1, 5, 1), (1, None, 2), (2, None, 1), (9, 3, 1)],
                               "id long, stock int, seq int")
    r = mu.set_stock(p, ch)
    assert rows(r.table, "id", "stock") == [(1, 5), (2, 2)]
    assert rows(r.changed, "id", "stock") == [(1, 5)]
    assert rows(r.extra["refused"], "id", "seq", "outcome") == [
        (1, 2, "not null"), (2, 1, "not null"), (9, 1, "not found")]


def test_patch_orders_modes(spark):
    o = spark.createDataFrame(
        [(1, "received", None, "x", None)],
        "id long, status string, tracking_number string, notes string, updated_at timestamp")
    patches = spark.createDataFrame([(1, {"status": None, "notes": "n"}, 1)],
                                    "id long, changes map<string,string>, seq int")
    db = mu.patch_orders(o, patches, AS_OF).changed.first()
    assert (db.status, db.notes) == ("received", "n")
    fl = mu.patch_orders(o, patches, AS_OF, mode="presence").changed.first()
    assert (fl.status, fl.notes) == (None, "n")
    assert str(db.updated_at) == "1995-02-01 00:00:00"


def test_sweep_strict_cutoff_and_conservation(spark):
    p = products(spark, [(1, "m", "c", "A", "S", 1, 0, True)])
    o = spark.createDataFrame(
        [(1, 1, 2, "pending", "1995-01-31 23:40:00"),      # exactly as_of - 20 min: kept
         (2, 1, 3, "pending", "1995-01-31 23:39:59"),
         (3, None, 1, "pending", "1995-01-31 00:00:00"),   # no product: marked only
         (4, 1, 5, "paid", "1995-01-01 00:00:00")],
        "id long, product_id long, quantity int, payment_status string, ordered_at string"
    ).withColumn("ordered_at", F.col("ordered_at").cast("timestamp"))
    r = st.sweep(p, o, AS_OF)
    assert rows(r.changed, "id") == [(2,), (3,)]
    assert rows(r.table, "id", "stock") == [(1, 3)]
    assert mu.MutationResult  # result type used across mutations


def test_confirm_is_idempotent(spark):
    o = spark.createDataFrame(
        [(1, "g1", "received", "pending"), (2, "g2", "shipped", "paid"),
         (3, "g3", "received", "abandoned")],
        "id long, razorpay_order_id string, status string, payment_status string"
    ).withColumn("updated_at", F.lit(None).cast("timestamp"))
    calls = spark.createDataFrame([("g1", 1), ("g1", 2), ("g2", 1), ("g3", 1), ("g9", 1)],
                                  "razorpay_order_id string, seq int")
    r = mu.confirm_orders(o, calls, AS_OF)
    assert rows(r.extra["outcomes"], "razorpay_order_id", "seq", "outcome") == [
        ("g1", 1, "promoted"), ("g1", 2, "existing"), ("g2", 1, "existing"),
        ("g3", 1, "promoted"), ("g9", 1, "none")]
    assert rows(r.changed, "id", "confirmed_after_abandon") == [(1, False), (3, True)]
    again = mu.confirm_orders(r.table, calls, AS_OF)
    assert again.changed.count() == 0


def test_assign_ids_dense_across_partitions(spark):
    new = spark.range(0, 1000, numPartitions=13).select((F.col("id") * 7 % 1000).alias("k"))
    existing = spark.createDataFrame([(41,)], "id long")
    got = assign_ids(new, existing, order_by=["k"]).select("id", "k").collect()
    ids = sorted((r.k, r.id) for r in got)
    assert [i for _, i in ids] == list(range(42, 1042))


def test_product_cards_variant_order(spark):
    p = products(spark, [(1, "m", "c", "A", "L", 10, 0, True), (2, "m", "c", "A", "S", 12, 2, True),
                         (3, "m", "c", "A", "38", 11, 1, True), (4, "m", "c", "A", None, 9, 1, True),
                         (5, "m", "c", "B", None, 5, 0, True)])
    cards = {r.name: r for r in cat.product_cards(p).collect()}
    assert cards["A"].price == 11     # listing order sorts '38' before 'L' and 'S'
    assert cards["A"].any_in_stock and cards["A"].sized and cards["A"].n_variants == 4
    assert not cards["B"].any_in_stock and not cards["B"].sized
    v = cat.card_variants(p).filter("name = 'A'").orderBy("pos").collect()
    assert [(r.size, r.pos, r.out) for r in v] == [
        ("S", 1, False), ("L", 2, True), ("38", 3, False), (None, 4, False)]


def test_keyed_row_number_hot_key_equals_window(spark):
    from pyspark.sql import Window

    from loomcart.operators.ranking import keyed_row_number

    df = spark.range(0, 5000, numPartitions=7).select(
        "id", F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(
            (F.col("id") % 13).cast("string")).alias("k"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") % 17).alias("g"),
        ((F.col("id") * 7919) % 1000).alias("v"))
    order = [F.col("v").desc(), F.col("id").asc()]
    w = Window.partitionBy("k", "g").orderBy(*order)
    want = {(r.id, r.rn) for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    for parts in (1, 5, 23):
        got = {(r.id, r.rn) for r in keyed_row_number(df, ["k", "g"], order, "rn",
                                                      partitions=parts).collect()}
        assert got == want


def test_keyed_row_number_leaves_carried_columns_alone(spark):
    import datetime as dt

    from loomcart.operators.ranking import keyed_row_number

    big = 9007199254740993
    rows_in = [(1, 1, big, dt.datetime(2020, 1, 1, 1, 2, 3, 456789), "é\n", None),
               (1, 2, None, None, None, [1, None]), (None, 3, big + 2, None, "x", [])]
    df = spark.createDataFrame(rows_in, "k int, o int, big long, ts timestamp, s string, a array<int>")
    got = keyed_row_number(df, ["k"], [F.col("o")], "rn", partitions=3).orderBy("o").collect()
    assert [tuple(r)[:6] for r in got] == rows_in
    assert [r.rn for r in got] == [1, 2, 1]
