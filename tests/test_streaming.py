import random
import tempfile
import time


from loomcart.streaming import reservation_by_batches

SCHEMA = "request_id long, product_id long, qty long, ts long"


def replay(stock, waves):
    left = dict(stock)
    out = {}
    for wave in waves:
        for rid, pid, q, ts in sorted(wave, key=lambda r: (r[1], r[3], r[0])):
            if left[pid] >= q:
                left[pid] -= q
                out[rid] = True
            else:
                out[rid] = False
    return out


def test_batch_fold_reservation_over_micro_batches(spark):
    rnd = random.Random(11)
    stock = {1: 60, 2: 5, 3: 0}
    waves, rid = [], 0
    for _ in range(3):
        wave = []
        for _ in range(300):
            rid += 1
            pid = 1 if rnd.random() < 0.7 else rnd.choice([2, 3])
            wave.append((rid, pid, rnd.randint(1, 5), rnd.randint(0, 1000)))
        waves.append(wave)
    base = tempfile.mkdtemp(prefix="lc-fold-")
    for wave in waves:           # one file per wave, written in arrival order
        spark.createDataFrame(wave, SCHEMA).coalesce(1).write.mode("append").parquet(base + "/in")
        time.sleep(1.1)
    src = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
           .parquet(base + "/in"))
    products = spark.createDataFrame([(k, v) for k, v in stock.items()], "id long, stock int")
    reservation_by_batches(src, products, base + "/state", base + "/out", base + "/ckpt")
    got = {r.request_id: r.accepted for r in spark.read.parquet(base + "/out").collect()}
    assert len(spark.read.parquet(base + "/out").select("batch").distinct().collect()) == 3
    assert got == replay(stock, waves)


def test_abandoned_join_over_several_files_equals_batch(spark):
    """J1 over three time-ordered files (three micro-batches, the watermark
    moving between them) equals the batch answer for every signup whose
    window closed by the final watermark."""
    import duckdb

    from loomcart.streaming import abandoned_reservations, run_available_now

    src = "/root/testdata/sf0.001/events.parquet"
    ev = spark.read.parquet(src).orderBy("ts")
    base = tempfile.mkdtemp(prefix="lc-j1-")
    bounds = ev.selectExpr("percentile_approx(ts, array(0.33, 0.66)) AS q").first().q
    parts = [ev.filter(f"ts < '{bounds[0]}'"),
             ev.filter(f"ts >= '{bounds[0]}' AND ts < '{bounds[1]}'"),
             ev.filter(f"ts >= '{bounds[1]}'")]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(base + "/events")
        time.sleep(1.1)
    folder = base + "/events"
    # One file per trigger, oldest first: three micro-batches.
    sig = (spark.readStream.schema(spark.read.parquet(src).schema)
           .option("maxFilesPerTrigger", 1).parquet(folder)
           .filter("event_type = 'signup'").selectExpr("event_id", "user_id",
                                                      "CAST(ts AS TIMESTAMP) AS ts"))
    pay = (spark.readStream.schema(spark.read.parquet(src).schema)
           .option("maxFilesPerTrigger", 1).parquet(folder)
           .filter("event_type = 'purchase'").selectExpr("event_id", "user_id",
                                                        "CAST(ts AS TIMESTAMP) AS ts"))
    j = abandoned_reservations(sig, pay)
    run_available_now(j, base + "/out", base + "/ckpt")
    got = {r.pending_id for r in spark.read.parquet(base + "/out")
           .filter("paid_id IS NULL").collect()}
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    want = {r[0] for r in con.execute(f"""
        WITH e AS (SELECT * FROM read_parquet('{src}')),
             s AS (SELECT * FROM e WHERE event_type = 'signup'),
             p AS (SELECT * FROM e WHERE event_type = 'purchase'),
             w AS (SELECT least((SELECT max(ts) FROM s), (SELECT max(ts) FROM p))
                          - INTERVAL 1 HOUR AS wm)
        SELECT s.event_id FROM s, w
        WHERE s.ts + INTERVAL 20 HOUR < w.wm AND NOT EXISTS (
          SELECT 1 FROM p WHERE p.user_id = s.user_id
            AND p.ts BETWEEN s.ts AND s.ts + INTERVAL 20 HOUR)""").fetchall()}
    assert len(want) > 0
    assert got == want


def test_timers_over_several_batches_equal_all_pairs(spark):
    """J2 over five files: a busy user, many signups at one millisecond,
    purchases of the same and of later batches; equal to comparing all pairs."""
    from datetime import datetime, timedelta

    from loomcart.streaming import abandoned_with_timers, run_available_now
    from loomcart.streaming.reservations import keyed_state_store

    rnd = random.Random(17)
    start, rows, eid = datetime(2026, 1, 1), [], 0
    base = tempfile.mkdtemp(prefix="lc-j2-")
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    for b in range(5):
        wave = []
        for _ in range(160):
            eid += 1
            user = 1 if rnd.random() < .6 else rnd.randint(2, 30)
            at = start + timedelta(hours=b * 4, minutes=rnd.randint(0, 239), microseconds=rnd.randint(0, 3) * 500)
            wave.append((eid, user, "purchase" if rnd.random() < (.02 if user == 1 else .3) else "signup", at))
        for _ in range(40):                       # all at once
            eid += 1
            wave.append((eid, 1, "signup", start + timedelta(hours=b * 4, minutes=120)))
        rows += wave
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(base + "/in")
        time.sleep(1.1)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")
    ttl = timedelta(hours=1)
    with keyed_state_store(spark):
        run_available_now(abandoned_with_timers(src, 3_600_000, "4 hours"), base + "/out", base + "/ckpt")
    got = sorted((r.pending_id, r.user_id, r.ts_us) for r in spark.read.parquet(base + "/out").collect())
    end = max(r[3] for r in rows) - timedelta(hours=4)

    def ms(t):
        return t.replace(microsecond=t.microsecond // 1000 * 1000)

    paid = [(u, t) for _, u, kind, t in rows if kind == "purchase"]
    want = sorted((e, u, int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1)))
                  for e, u, kind, t in rows if kind == "signup" and ms(t) + ttl <= ms(end)
                  and not any(v == u and t <= s <= t + ttl for v, s in paid))
    assert len(want) > 100 and got == want


def test_late_purchases_take_abandoned_rows_back(spark):
    """Purchases that arrive up to the lifetime after the decision; those still
    later are dropped.  Abandoned less retracted is the batch answer."""
    from datetime import datetime, timedelta

    from loomcart.streaming import abandoned_with_corrections, run_available_now
    from loomcart.streaming.reservations import keyed_state_store

    rnd = random.Random(23)
    start, eid = datetime(2026, 1, 1), 0
    ttl, delay, lifetime = timedelta(hours=1), timedelta(hours=1), timedelta(hours=6)
    base = tempfile.mkdtemp(prefix="lc-late-")
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    waves = [[] for _ in range(8)]
    for b in range(6):
        for _ in range(120):
            eid += 1
            user = 1 if rnd.random() < .5 else rnd.randint(2, 40)
            at = start + timedelta(hours=b * 2, minutes=rnd.randint(0, 119), milliseconds=rnd.randint(0, 3))
            buys = rnd.random() < (.03 if user == 1 else .3)
            # A purchase may come one to three waves late: two to six hours.
            waves[b + (rnd.choice([0, 1, 2]) if buys else 0)].append((eid, user, "purchase" if buys else "signup", at))
    waves[7] += [(eid + 1, 99, "signup", start + timedelta(hours=30)),
                 (eid + 2, 5, "purchase", start + timedelta(minutes=30))]       # far too late: beyond the lifetime
    for wave in waves:
        spark.createDataFrame(wave or [(0, 98, "signup", start + timedelta(hours=13))], schema).coalesce(1).write.mode(
            "append").parquet(base + "/in")
        time.sleep(1.1)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")
    ms = timedelta(milliseconds=1)
    with keyed_state_store(spark):
        run_available_now(abandoned_with_corrections(src, ttl // ms, delay // ms, lifetime // ms),
                          base + "/out", base + "/ckpt")
    rows = spark.read.parquet(base + "/out").collect()
    gone = [r.pending_id for r in rows if r.kind == "abandoned"]
    back = [r.pending_id for r in rows if r.kind == "retracted"]
    assert len(set(gone)) == len(gone) and len(set(back)) == len(back) and set(back) <= set(gone)
    events = [e for w in waves for e in w if e[0] != eid + 2]
    paid = [(u, t) for _, u, kind, t in events if kind == "purchase"]
    want = {e for e, u, kind, t in events if kind == "signup" and t + ttl <= start + timedelta(hours=29)
            and not any(v == u and t <= s <= t + ttl for v, s in paid)}
    assert len(back) >= 3 and set(gone) - set(back) - {0} == want - {0}


class Store:
    """A state handle over plain dictionaries that counts its calls."""

    def __init__(self):
        self.timers, self.calls = [], 0

    def registerTimer(self, ms):
        self.timers.append(ms)

    def _state(self, *_):
        store, rows = self, {}

        class State:
            def exists(self):
                return None in rows

            def get(self):
                store.calls += 1
                return rows[None]

            def update(self, value):
                store.calls += 1
                rows[None] = value

            def containsKey(self, key):
                store.calls += 1
                return key in rows

            def getValue(self, key):
                store.calls += 1
                return rows[key]

            def updateValue(self, key, value):
                store.calls += 1
                rows[key] = value

            def removeKey(self, key):
                store.calls += 1
                rows.pop(key, None)

            def iterator(self):
                store.calls += 1
                return iter(list(rows.items()))

            def clear(self):
                rows.clear()

        return State()

    getValueState = getMapState = _state


def test_reservation_state_is_called_per_block():
    """One call serves all products of a block, each from its own stock."""
    import pandas as pd

    from loomcart.streaming.reservations import _reservation_processor

    rnd, got, store = random.Random(5), {}, Store()
    stock = {pid: pid % 7 for pid in range(200)}
    waves = [[(w * 5000 + i, rnd.randrange(200), rnd.randint(0, 4), rnd.randint(0, 50)) for i in range(1500)] for w in range(2)]
    p = _reservation_processor()
    p.init(store)
    for wave in waves:
        pdf = pd.DataFrame(wave, columns=["request_id", "product_id", "qty", "ts"])
        pdf["stock"] = pdf["product_id"].map(stock)
        for out in p.handleInputRows((0,), iter([pdf[:700], pdf[700:]]), None):
            got |= dict(zip(out["request_id"], out["accepted"]))
    want = replay(stock, waves)
    zero = {r[0] for w in waves for r in w if r[2] == 0}
    assert got == {k: v and k not in zero for k, v in want.items()} and store.calls <= 4


def test_abandoned_state_is_called_per_block():
    """A block's many signups need few calls and timers, and are decided as
    if each had its own."""
    import pandas as pd

    from loomcart.streaming.reservations import _abandon_processor

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

        def getExpiryTimeInMs(self):
            return self.ms

    rnd, store, ttl = random.Random(7), Store(), 3_600_000
    rows = [(i, rnd.randrange(100), rnd.choice(["signup", "signup", "purchase"]), rnd.randrange(ttl) * 1000) for i in range(900)]
    p = _abandon_processor(ttl)
    p.init(store)
    pdf = pd.DataFrame(rows, columns=["event_id", "user_id", "event_type", "ts_us"])
    list(p.handleInputRows((0, 0), iter([pdf]), None))
    assert len(store.timers) < 10
    got = []
    for wm in (ttl + ttl // 3, ttl + ttl // 2, 2 * ttl):
        for ms in sorted(t for t in set(store.timers) if t <= wm):
            store.timers = [t for t in store.timers if t != ms]
            for out in p.handleExpiredTimer((0, 0), At(wm), At(ms)):
                got += out["pending_id"].tolist()
    want = [e for e, u, kind, t in rows if kind == "signup" and not any(
        k == "purchase" and v == u and t <= s <= t + ttl * 1000 for _, v, k, s in rows)]
    assert sorted(got) == want and len(want) > 50 and store.calls < 150
