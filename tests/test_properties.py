"""Property tests: Column functions against plain-Python statements of the
same rules, on many generated inputs evaluated in one Spark job each."""

import hashlib
import hmac
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomcart import functions as fn

JS_WS = ("\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
         + "\u2028\u2029\u202f\u205f\u3000\ufeff")  # JavaScript's \s


def indian(n: int) -> str:
    s = str(abs(n))
    if len(s) > 3:
        head, tail = s[:-3], s[-3:]
        pairs = []
        while len(head) > 2:
            pairs.insert(0, head[-2:])
            head = head[:-2]
        if head:
            pairs.insert(0, head)
        s = ",".join(pairs + [tail])
    return ("-" if n < 0 else "") + s


def phone(p):
    if p is None:
        return None
    d = re.sub(r"\D", "", p)
    d = re.sub(r"^(91|0)", "", d, count=1)
    return d[-10:]


def norm(s: str) -> str:
    return re.sub(f"[{re.escape(JS_WS)}]+", " ", s).strip(" ")


SETTINGS = settings(max_examples=5, deadline=None)


@SETTINGS
@given(st.lists(st.integers(min_value=-10**12, max_value=10**12), min_size=1, max_size=300))
def test_indian_grouping_matches_python(spark, ns):
    got = [r[0] for r in spark.createDataFrame([(n,) for n in ns], "n long")
           .select(fn.indian_grouping("n")).collect()]
    assert got == [indian(n) for n in ns]


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.text(alphabet="0123456789+- ()9", max_size=16)),
                min_size=1, max_size=300))
def test_phone_normalisation_matches_python(spark, ps):
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p string")
           .select(fn.normalise_phone("p")).collect()]
    assert got == [phone(p) for p in ps]


@SETTINGS
@given(st.lists(st.text(alphabet=JS_WS + "ab\u0085", max_size=12), min_size=1, max_size=300))
def test_whitespace_normalisation_matches_python(spark, ss):
    got = [r[0] for r in spark.createDataFrame([(s,) for s in ss], "s string")
           .select(fn.norm_text("s")).collect()]
    assert got == [norm(s) for s in ss]


@SETTINGS
@given(st.text(min_size=1, max_size=80),
       st.lists(st.text(max_size=40), min_size=1, max_size=100))
def test_hmac_matches_python(spark, key, msgs):
    got = [r[0] for r in spark.createDataFrame([(m,) for m in msgs], "m string")
           .select(fn.hmac_sha256_hex(F.col("m"), key)).collect()]
    want = [hmac.new(key.encode(), m.encode(), hashlib.sha256).hexdigest() for m in msgs]
    assert got == want


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=10**9), min_size=1, max_size=200))
def test_sku_matches_python(spark, ids):
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id long")
           .select(fn.sku("id")).collect()]
    assert got == ["MWK-" + str(i).zfill(4) for i in ids]


@settings(max_examples=4, deadline=None)
@given(st.dictionaries(st.integers(1, 6), st.integers(0, 30), min_size=1, max_size=6),
       st.lists(st.tuples(st.integers(1, 6), st.integers(-1, 9), st.integers(0, 40)),
                min_size=1, max_size=400),
       st.sampled_from([1, 3, 9]))
def test_reservation_equals_replay_on_generated_requests(spark, stock, reqs, parts):
    from loomcart.operators.reserve import reserve_stock

    rows = [(i + 1, pid, q, ts) for i, (pid, q, ts) in enumerate(reqs)]
    left = dict(stock)
    want = {}
    for rid, pid, q, ts in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        q = 1 if q == 0 else q
        if pid not in left or q < 0:
            want[rid] = False
        elif left[pid] >= q:
            left[pid] -= q
            want[rid] = True
        else:
            want[rid] = False
    p = spark.createDataFrame(list(stock.items()), "id long, stock int")
    r = spark.createDataFrame(rows, "request_id long, product_id long, qty long, ts long")
    out, after = reserve_stock(p, r, partitions=parts)
    assert {x.request_id: x.accepted for x in out.collect()} == want
    assert {x.id: x.stock for x in after.collect()} == left
