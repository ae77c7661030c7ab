import random


from loomcart.operators.reserve import reserve_stock


def replay(stock, requests):
    """Plain replay: requests (rid, pid, qty, ts) in (ts, rid) order."""
    left = dict(stock)
    out = {}
    for rid, pid, q, ts in sorted(requests, key=lambda r: (r[1], r[3], r[0])):
        if q is None or q == 0:
            q = 1
        if q < 0:
            out[rid] = (False, None)
            continue
        if left[pid] >= q:
            left[pid] -= q
            out[rid] = (True, left[pid])
        else:
            out[rid] = (False, left[pid])
    return out, left


def run(spark, stock, requests, partitions):
    p = spark.createDataFrame([(k, v) for k, v in stock.items()], "id long, stock int")
    r = spark.createDataFrame(requests, "request_id long, product_id long, qty long, ts long")
    out, new_p = reserve_stock(p, r, partitions=partitions)
    got = {row.request_id: (row.accepted, row.remaining_after, row.outcome)
           for row in out.collect()}
    left = {row.id: row.stock for row in new_p.collect()}
    return got, left


def test_smaller_later_request_still_served(spark):
    got, left = run(spark, {1: 5}, [(1, 1, 4, 1), (2, 1, 3, 2), (3, 1, 1, 3)], 2)
    assert [got[i][0] for i in (1, 2, 3)] == [True, False, True]
    assert left == {1: 0}


def test_invalid_and_defaulted_quantities(spark):
    reqs = [(1, 1, None, 1), (2, 1, 0, 2), (3, 1, -5, 3), (4, 9, 1, 4), (5, None, 1, 5)]
    got, left = run(spark, {1: 5}, reqs, 2)
    assert got[1][:1] == (True,) and got[2][:1] == (True,)
    assert got[3][2] == "invalid_quantity"
    assert got[4][2] == "sold_out"          # unknown product: nothing to take
    assert got[5][2] == "no_product"
    assert left == {1: 3}


def test_hot_product_across_many_partitions_equals_replay(spark):
    rnd = random.Random(7)
    stock = {1: 400, 2: 3, 3: 0, 4: 50}
    reqs = []
    rid = 0
    for _ in range(3000):            # product 1 holds most requests
        rid += 1
        pid = 1 if rnd.random() < 0.8 else rnd.choice([2, 3, 4])
        reqs.append((rid, pid, rnd.randint(1, 9), rnd.randint(0, 500)))
    want, want_left = replay(stock, reqs)
    for parts in (1, 7, 32):
        got, left = run(spark, stock, reqs, parts)
        assert {k: v[:2] for k, v in got.items()} == want
        assert left == want_left


def test_stock_never_negative_and_conserved(spark):
    rnd = random.Random(3)
    stock = {i: rnd.randint(0, 20) for i in range(1, 30)}
    reqs = [(i, rnd.randint(1, 29), rnd.randint(1, 6), rnd.randint(0, 100))
            for i in range(1, 800)]
    got, left = run(spark, stock, reqs, 5)
    taken = {}
    for rid, pid, q, _ in reqs:
        if got[rid][0]:
            taken[pid] = taken.get(pid, 0) + q
    for pid, s in stock.items():
        assert left[pid] >= 0
        assert left[pid] + taken.get(pid, 0) == s


def test_a_partition_is_folded_batch_by_batch():
    """Batches of any size give one batch's outcomes and exits, and no more
    than a batch is taken before its rows come out."""
    import random

    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    from loomcart.operators import reserve as rs

    rnd = random.Random(3)
    keys = sorted(rnd.choice([1, 1, 1, 1, 2, 3]) for _ in range(400))
    for off in (0, 500):
        rows = pa.table({"request_id": list(range(400)), "product_id": keys, "qty": [rnd.randint(1, 9) for _ in keys],
                         "__stock": [150 + 40 * k for k in keys], "__pid": pa.array([4] * 400, pa.int32()),
                         "__off": [off] * 400, "__qmax": [9] * 400, "__entry": pa.array([8 if off else None] * 400, pa.int64())})
        for part in (rows, rows.filter(pa.compute.equal(rows["product_id"], 1))):
            whole = part.combine_chunks().to_batches()
            for n in (1, 7, 64):
                cut = part.combine_chunks().to_batches(max_chunksize=n)
                for fold in (rs._final_fn(("__pid",)), rs._exit_fn(1 << 16, False), rs._exit_fn(1 << 16, True)):
                    assert pa.Table.from_batches(fold(iter(cut))).equals(pa.Table.from_batches(fold(iter(whole))))
                taken = []
                next(rs._final_fn(())(b for b in cut if not taken.append(b)))
                assert len(taken) == 1
