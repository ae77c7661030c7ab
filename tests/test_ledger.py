"""Streams on compacted logs: several batches, retried batches, restarts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomcart import streaming as stm
from loomcart.streaming.batchlog import BatchLog, newest
from loomcart.streaming.ledger import PATCHED, order_log
from tests.test_streaming import replay

REQUESTS = "request_id long, product_id long, qty long, ts long"


def folder_names(path):
    return sorted(p.name for p in path.iterdir() if p.is_dir())


def test_batch_log_compacts_and_forgets_nothing(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"), "id long, v string", newest("id"), compact_every=3)
    assert log.before(0).count() == 0
    want = {}
    for b in range(10):
        rows = [(i, f"{b}") for i in range(b, b + 3)]
        for _ in range(2 if b in (2, 5, 7) else 1):              # retried, also when it compacts
            assert {r.id: r.v for r in newest("id")(log.before(b)).collect()} == want
            log.write(spark.createDataFrame(rows, "id long, v string"), b)
        want |= dict(rows)
    assert {r.id: r.v for r in newest("id")(log.last()).collect()} == want
    assert folder_names(tmp_path / "log" / "kind=base") == ["at=5", "at=8"]
    assert folder_names(tmp_path / "log" / "kind=parts") == ["at=6", "at=7", "at=8", "at=9"]


def test_incomplete_base_does_not_count(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path), "id long", newest("id"))
    log.write(spark.createDataFrame([(1,)], "id long"), 0)
    (tmp_path / "kind=base" / "at=0").mkdir(parents=True)
    assert [r.id for r in log.before(1).collect()] == [1]


def test_reservation_ledger_retries_and_compaction(spark, tmp_path):
    """Touched products only; a retried batch and compactions change nothing."""
    rnd = random.Random(4)
    stock = {1: 90, 2: 5, 3: 0, 4: 1000, 5: 7}
    products = spark.createDataFrame([(k, v) for k, v in stock.items()], "id long, stock int")
    log = stm.stock_log(spark, str(tmp_path / "state"), compact_every=2)
    step = stm.reservation_step(products, log, str(tmp_path / "out"))
    waves = []
    for b in range(5):
        wave = [(b * 100 + i, 1 if rnd.random() < .7 else rnd.choice([2, 3, 4]), rnd.randint(1, 5),
                 rnd.randint(0, 50)) for i in range(60)]
        waves.append(wave)
        for _ in range(2 if b in (1, 2) else 1):
            step(spark.createDataFrame(wave, REQUESTS), b)
    got = {r.request_id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == replay(stock, waves)
    left = {r.id: r.stock for r in stm.stock_as_of(products, log.last()).collect()}
    taken = {}
    for wave in waves:
        for rid, pid, q, _ in wave:
            taken[pid] = taken.get(pid, 0) + q * got[rid]
    assert left == {p: s - taken.get(p, 0) for p, s in stock.items()}
    assert {r.id for r in log.last().collect()} <= {1, 2, 4}      # 3 and 5 were never touched


def test_confirmed_once_for_ever(spark, tmp_path):
    """Repeats in the same batch, in later batches and after restarts."""
    schema = "razorpay_order_id string, ts timestamp, call long"
    base = str(tmp_path)
    for run in range(3):
        rows = [(f"o{k}", f"2026-0{run + 1}-01 00:00:{k % 60:02d}", run * 100 + k)
                for k in [*range(run * 5, run * 5 + 20), run * 5, 0]] + [(None, "2026-01-01 00:00:00", -1)]
        frame = spark.createDataFrame(rows, "razorpay_order_id string, ts string, call long").withColumn(
            "ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(base + "/in")
        time.sleep(1.1)
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")
        log = stm.confirm_once_for_ever(src, base + "/state", base + "/out", base + "/ckpt", buckets=4,
                                        compact_every=2)
    out = spark.read.parquet(base + "/out").collect()
    assert sorted(r.razorpay_order_id for r in out) == sorted(f"o{k}" for k in range(30))
    assert {r.razorpay_order_id: r.call for r in out}["o0"] == 0 and len(log.last().collect()) == 30
    # The last batch again, as after a crash before its commit.
    step = stm.confirm_step(log, base + "/out", "razorpay_order_id", buckets=4)
    step(spark.read.schema(schema).parquet(base + "/in").where("call >= 200"), 2)
    assert spark.read.parquet(base + "/out").count() == 30


def walk_patches(orders, patches):
    """The shop's own way: one patch after the other."""
    now = {o["id"]: dict(o) for o in orders}
    sent = []
    for p in sorted(patches, key=lambda p: p["seq"]):
        o = now.get(p["id"])
        if o is None:
            continue
        kinds = []
        if p["call"] == "confirm":
            if o["status"] == "received":
                o["status"], kinds = "confirmed", ["new_order", "confirmed"]
        else:
            for f in PATCHED:
                if p[f] is not None:
                    o[f] = p[f]
            if p["status"] in ("confirmed", "shipped"):
                kinds = [p["status"]]
        sent += [(o["id"], k, o["status"], o["tracking_number"], o["notes"], o["name"]) for k in kinds]
    return sent, now


@pytest.mark.parametrize("waves", [1, 4])
def test_patch_messages_equal_the_walk(spark, tmp_path, waves):
    rnd = random.Random(8)
    orders = [{"id": i, "name": f"n{i}", "status": rnd.choice(["received", "confirmed", "shipped", None]),
               "tracking_number": None, "notes": f"x{i}"} for i in range(12)]
    patches = [{"seq": s, "id": rnd.choice([1, 1, 1, *range(14)]), "call": rnd.choice(["confirm", "patch", "patch"]),
                "status": rnd.choice([None, None, "received", "confirmed", "shipped", "delivered"]),
                "tracking_number": rnd.choice([None, f"T{s}"]), "notes": rnd.choice([None, None, f"N{s}"])}
               for s in range(160)]
    schema = "id long, name string, status string, tracking_number string, notes string"
    frame = spark.createDataFrame([tuple(o.values()) for o in orders], schema)
    log = order_log(spark, str(tmp_path / "state"), compact_every=2)
    step = stm.patch_step(frame, log, lambda ev: ev.select(
        "id", "kind", "status", "tracking_number", "notes", "name"), str(tmp_path / "out"))
    for b in range(waves):
        part = patches[b * len(patches) // waves:(b + 1) * len(patches) // waves]
        rows = spark.createDataFrame([tuple(p.values()) for p in part], "seq long, id long, call string, "
                                     "status string, tracking_number string, notes string")
        for _ in range(2 if b == 2 else 1):
            step(rows, b)
    sent, now = walk_patches(orders, patches)
    out = spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, sent))
    last = {r.id: tuple(r[f] for f in PATCHED) for r in newest("id")(log.last()).collect()}
    assert last == {i: tuple(now[i][f] for f in PATCHED) for i in last} and len(last) == 12
