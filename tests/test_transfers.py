"""Transfers of request runs as breakpoints, against serving one by one."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomcart.operators import transfers as tr
from loomcart.operators.reserve import reserve_stock
from tests.test_reserve import replay


def serve(q, r):
    for x in q:
        if r >= x:
            r -= x
    return r


quantities = st.lists(st.integers(1, 60), max_size=30)


@settings(max_examples=150, deadline=None)
@given(quantities, quantities, st.integers(0, 120), st.sampled_from([4, 16, 1000]))
def test_transfer_and_composition(a, b, most, limit):
    f, g = (tr.transfer(np.array(x, np.int64), most, limit) for x in (a, b))
    both = tr.compose(f, g, limit)
    for r in range(most + 1):
        x, y, z = tr.apply(f, r), tr.apply(g, r), tr.apply(both, r)
        assert x is None or x == serve(a, r)
        assert y is None or y == serve(b, r)
        assert z is None or z == serve(b, serve(a, r))
        if limit == 1000:
            assert None not in (x, y, z)
        if r < limit:                       # a part of a transfer starts at 0
            assert x is not None
    assert all(len(x) <= limit + len(a) + 1 for x in f)


def test_identity_and_nothing():
    f = tr.transfer(np.array([5, 3]), 9, 100)
    assert [tr.apply(f, r) for r in range(10)] == [serve([5, 3], r) for r in range(10)]
    assert all((x == y).all() for x, y in zip(tr.compose(tr.IDENTITY, f, 100), f))
    assert tr.apply(tr.NOTHING, 0) is None and not len(tr.compose(f, tr.NOTHING, 9)[0])


def test_size_follows_requests_not_quantities():
    """One request of 10^9 on a stock of 10^9: two breakpoints; small requests
    beside it add their own."""
    q = np.array([10**9, 3, 1, 2] * 50, np.int64)
    t0 = time.perf_counter()
    f = tr.transfer(q, 10**9, 1 << 16)
    assert time.perf_counter() - t0 < 1
    assert sum(x.nbytes for x in tr.transfer(np.array([10**9]), 10**9, 1 << 16)) < 100
    assert sum(x.nbytes for x in f) < 30_000
    rnd = random.Random(1)
    for r in [0, 1, 299, 300, 301, 10**9, *(rnd.randrange(10**9) for _ in range(200))]:
        assert tr.apply(f, r) == serve(q.tolist(), r)


@pytest.mark.parametrize("parts,breakpoints", [(1, 1 << 16), (7, 1 << 16), (40, 1 << 16), (40, 3)])
def test_reservation_with_quantities_of_all_sizes(spark, parts, breakpoints):
    """Quantities from 1 to 10^9 on one hot product; a few breakpoints only
    leave states open, which are replayed."""
    rnd = random.Random(parts)
    stock = {1: 2_000_000_000, 2: 70, 3: 10**9}
    reqs = [(i, 1 if rnd.random() < .8 else rnd.choice([2, 3]), int(10 ** rnd.uniform(0, 9.3)), rnd.randint(0, 900))
            for i in range(1, 1500)]
    want, left = replay(stock, reqs)
    p = spark.createDataFrame(list(stock.items()), "id long, stock int")
    r = spark.createDataFrame(reqs, "request_id long, product_id long, qty long, ts long")
    out, new_p = reserve_stock(p, r, partitions=parts, breakpoints=breakpoints)
    assert {x.request_id: (x.accepted, x.remaining_after) for x in out.collect()} == want
    assert {x.id: x.stock for x in new_p.collect()} == left


def test_no_requests(spark):
    p = spark.createDataFrame([(1, 5)], "id long, stock int")
    r = spark.createDataFrame([], "request_id long, product_id long, qty long, ts long")
    out, new_p = reserve_stock(p, r)
    assert out.count() == 0 and [tuple(x) for x in new_p.collect()] == [(1, 5)]
