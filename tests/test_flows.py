"""Cross-operator flows from the fixture list: null / unknown product ids,
pending -> swept -> paid, and reservation + sweep conserving stock."""

import random

from pyspark.sql import functions as F

from loomcart.operators import mutations as mu
from loomcart.operators import orders as ords
from loomcart.operators import stock as st
from loomcart.operators.reserve import reserve_stock

AS_OF = "1995-02-01 00:00:00"


def test_null_and_unknown_product_ids(spark):
    p = spark.createDataFrame([(1, "Hat", "c", "m")], "id long, name string, collection string, gender string")
    o = spark.createDataFrame([(10, 1), (11, None), (12, 99)], "id long, product_id long")
    enriched = {r.id: r.product_name for r in ords.enrich_orders(o, p).collect()}
    assert enriched == {10: "Hat", 11: None, 12: None}          # left join keeps all
    assert [r.id for r in ords.dangling_orders(o, p).collect()] == [12]   # NULL FK allowed
    assert sorted(r.id for r in mu.unreferenced_products(p, o).collect()) == []


def test_pending_swept_then_paid_still_confirms(spark):
    o = spark.createDataFrame(
        [(1, 5, 2, "received", "pending", "g1", None, "1995-01-31 10:00:00")],
        "id long, product_id long, quantity int, status string, payment_status string, "
        "razorpay_order_id string, razorpay_payment_id string, ordered_at string"
    ).withColumn("ordered_at", F.col("ordered_at").cast("timestamp")) \
     .withColumn("updated_at", F.col("ordered_at"))
    p = spark.createDataFrame([(5, 0)], "id long, stock int")
    swept = st.sweep(p, o, AS_OF)
    assert [r.stock for r in swept.table.collect()] == [2]
    o2 = swept.extra["orders"]
    paid = mu.apply_payments(o2, spark.createDataFrame(
        [("g1", "pay_1", 1)], "razorpay_order_id string, razorpay_payment_id string, seq int"),
        AS_OF)
    assert paid.changed.count() == 0                 # no longer pending: nothing promoted
    calls = spark.createDataFrame([("g1", 1)], "razorpay_order_id string, seq int")
    conf = mu.confirm_orders(paid.table, calls, AS_OF)
    row = conf.changed.first()
    assert (row.status, row.payment_status, row.confirmed_after_abandon) == (
        "confirmed", "abandoned", True)


def test_reservation_then_sweep_conserves_stock(spark):
    rnd = random.Random(5)
    stock = {i: rnd.randint(0, 8) for i in range(1, 21)}
    reqs = [(i, rnd.randint(1, 20), rnd.randint(1, 3), rnd.randint(0, 50)) for i in range(1, 400)]
    p = spark.createDataFrame(list(stock.items()), "id long, stock int")
    r = spark.createDataFrame(reqs, "request_id long, product_id long, qty long, ts long")
    outcomes, after = reserve_stock(p, r, partitions=4)
    # Every accepted reservation becomes a pending order; sweep them all later.
    pending = (outcomes.filter("accepted")
               .select(F.col("request_id").alias("id"), "product_id",
                       F.col("qty").cast("int").alias("quantity"),
                       F.lit("pending").alias("payment_status"),
                       F.lit("1995-01-01 00:00:00").cast("timestamp").alias("ordered_at")))
    restored = st.sweep(after, pending, AS_OF).table
    got = {row.id: row.stock for row in restored.collect()}
    assert got == stock
    assert all(row.stock >= 0 for row in after.collect())


def test_order_of_many_parts_keeps_ids_apart(spark, tmp_path):
    """An order of more parts than slots: every part has an id of its own."""
    from pyspark.sql import functions as F

    from loomcart.plans import mapping as M

    li = spark.range(2500).select(
        F.when(F.col("id") < 2300, 7).otherwise(8).cast("long").alias("l_orderkey"), F.col("id").alias("l_partkey"),
        F.lit(1.0).alias("l_quantity"), F.lit(2.0).alias("l_extendedprice"))
    li.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sql("SELECT id AS o_orderkey, 1L AS o_custkey, 'O' AS o_orderstatus, DATE'1995-01-01' AS o_orderdate "
              "FROM range(7, 9)").write.parquet(str(tmp_path / "orders.parquet"))
    rows = M.shop_orders(spark, str(tmp_path)).collect()
    ids = {r.id for r in rows}
    assert len(rows) == len(ids) == 2500
    assert {r.id for r in rows if r.product_id < 999} == {7000 + k for k in range(1, 1000)}
    assert max(ids) == 2 * M.ID_RANGE + 7300
