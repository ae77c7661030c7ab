"""Lines, orders and calls are shuffled and computed once, on rows made here."""

import datetime as dt
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from loomcart.operators import mutations as mu
from loomcart.operators import outbox as ob
from loomcart.operators import payments as pay
from loomcart.operators.joins import bucketed
from loomcart.plans import mapping as M
from loomcart.plans import queries_orders as qo
from loomcart.plans import queries_payments as qp
from loomcart.plans.registry import ORACLES
from loomcart.sources import write_order_json
from loomcart.streaming.ledger import folded_patches


@pytest.fixture
def shop(spark, tmp_path):
    """Orders of several lines, repeated and null keys, buyers without row."""
    day = dt.datetime(2024, 1, 1)
    lines = [(o, p, 1, float(o + p), 10.0 * p) for o in range(1, 9) for p in (3, 1, 2, 2)]
    lines += [(None, 1, 1, 1.0, 1.0), (99, 1, 1, 1.0, 1.0)]
    orders = [(o, None if o == 4 else o % 5, "OPF"[o % 3], 1.0, day, "x") for o in range(1, 9)] + [
        (3, 1, "O", 1.0, day, "x"), (None, 1, "O", 1.0, day, "x")]
    buyers = [(0, "Customer#0", 3, 0.0, "HOUSEHOLD"), (1, "Customer#1", None, 0.0, "AUTO"),
              (2, None, 4, 0.0, None), (2, "Customer#2", 5, 0.0, "AUTO"), (None, "Nobody", 1, 0.0, "AUTO")]
    for name, rows, schema in (
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double"),
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                               "o_orderdate timestamp_ntz, o_orderpriority string"),
            ("customer", buyers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def texts(rows):
    return sorted(str(tuple(r)) for r in rows)


def test_lines_are_shuffled_once_by_order(spark, shop, no_broadcast):
    text = planned(M.full_orders(spark, shop))
    assert re.search(r"hashpartitioning\(l_orderkey#\w+, \d+\)", text)
    assert not re.search(r"hashpartitioning\(l_orderkey#\w+, l_partkey", text)
    assert "hashpartitioning(o_custkey" in text and "hashpartitioning(custkey" not in text


def test_full_orders_equal_the_sql(spark, shop):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{shop}/{t}.parquet/*.parquet')")
    df = M.full_orders(spark, shop)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({M.FULL_ORDERS_SQL})").fetchall()
    assert texts(df.collect()) == texts(want)
    late = M.with_contact(M.full_orders(spark, shop, contact=False, custkey=True), spark, shop)
    assert texts(late.select(df.columns).collect()) == texts(want)
    keys = spark.createDataFrame([(2,), (3,), (3,), (None,)], "order_key long")
    some = M.full_orders(spark, shop, order_keys=keys)
    assert texts(some.collect()) == texts(r for r in want if r[0] // 1000 in (2, 3))


def test_a_signature_is_made_and_checked_once(spark, shop):
    log = qp.payment_log(spark, shop)
    text = pay.verified_payments(log, qp.TEST_SECRET).select(
        "razorpay_order_id")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("sha2(") == 4                       # two HMACs of two passes
    good = pay.verify_payments(log, qp.TEST_SECRET).where("outcome = 'accepted'")
    assert texts(pay.verified_payments(log, qp.TEST_SECRET).collect()) == texts(good.collect())


def test_calls_are_read_once(spark, tmp_path):
    rows = [("a", 1), ("a", 2), ("a", 1), ("b", 3), (None, 1), ("d", 5)]
    spark.createDataFrame(rows, "razorpay_order_id string, seq int").coalesce(1).write.parquet(str(tmp_path / "calls"))
    o = spark.createDataFrame([(1, "a", "received"), (2, "a", "shipped"), (3, "b", "shipped"), (4, None, "received")],
                              "id long, razorpay_order_id string, status string").selectExpr(
        "*", "'pending' AS payment_status", "TIMESTAMP '2024-01-01' AS updated_at")
    out = mu.confirm_orders(o, spark.read.parquet(str(tmp_path / "calls")), M.AS_OF).extra["outcomes"]
    assert planned(out).split("Initial Plan")[0].count("FileScan parquet") == 1
    assert texts(out.collect()) == texts([("a", 1, 1, "promoted"), ("a", 1, 1, "promoted"), ("a", 2, 1, "existing"),
                                          ("b", 3, 3, "existing"), ("d", 5, None, "none")])


def test_contact_joins_orders_with_events_only(spark):
    o = spark.createDataFrame([(1, "confirmed", True), (2, "shipped", False), (3, "received", False)],
                              "id long, status string, promoted boolean")
    patches = spark.createDataFrame([(2, "shipped"), (2, "shipped"), (3, "received"), (9, "shipped")], "id long, s string").select(
        "id", F.create_map(F.lit("status"), "s").alias("changes"))
    changed = ob.changed_orders(o, patches)
    assert {r.id: r.kinds for r in changed.collect()} == {1: ["new_order", "confirmed"], 2: ["shipped", "shipped"]}
    assert texts(ob.events_of(changed).collect()) == texts(ob.change_events(o, patches).collect())


def test_bucketed_orders_are_not_shuffled(spark, no_broadcast):
    o = bucketed(spark.range(50).selectExpr(
        "id", "'received' AS status", "CAST(NULL AS string) AS tracking_number", "CAST(NULL AS string) AS notes"), "id")
    assert not spark.sql("SHOW TABLES LIKE 'loomcart_bucketed*'").collect()
    patches = spark.createDataFrame([(1, 7, "confirm"), (2, 7, "confirm"), (3, 8, "patch"), (4, 99, "confirm")],
                                    "seq long, id long, call string").selectExpr(
        "*", "CAST(NULL AS string) AS status", "'T' AS tracking_number", "CAST(NULL AS string) AS notes")
    folded = folded_patches(o, patches)
    assert planned(folded).split("Initial Plan")[0].count("Exchange hashpartitioning") == 1      # the patches
    assert texts(folded.select("seq", "kinds", "newest", "status").collect()) == texts([
        (1, ["new_order", "confirmed"], False, "confirmed"), (2, [], True, "confirmed"), (3, [], True, "received")])


def test_document_texts_are_made_after_the_last_join(spark, shop, no_broadcast):
    parts = [(1, "one", 3), (2, None, 4), (2, "two", 5), (None, "none", 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int").selectExpr(
        "*", "'b' AS p_brand", "'t' AS p_type", "1.5D AS p_retailprice").coalesce(1).write.parquet(f"{shop}/part.parquet")
    docs = qo._documents(qo._named_orders(spark, shop))
    shuffled = planned(docs).split("hashpartitioning(product_id", 1)
    assert "Street " in shuffled[0] and "Street " not in shuffled[1] and "order_" not in shuffled[1]
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{shop}/{t}.parquet/*.parquet')")
    names = qo.q_order_documents(spark, shop)
    want = con.execute(f"SELECT {', '.join(names.columns)} FROM ({ORACLES['order_documents']})").fetchall()
    assert texts(docs.select(names.columns).collect()) == texts(want) == texts(names.collect())
    assert qo.q_order_document_files(spark, shop).count() == len(want) + 4


def test_written_documents_leave_no_shuffle_files(spark, tmp_path):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, had = shuffles(), spark.conf.get(key)
    write_order_json(spark.range(100).repartition(5, "id"), str(tmp_path / "w"))
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.2)
    assert shuffles() <= before and spark.conf.get(key) == had
    assert spark.read.json(str(tmp_path / "w")).count() == 100
