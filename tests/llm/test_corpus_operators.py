"""Operators over whole corpora, against brute-force versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomcart.llm import (
    block_ann, chosen_path, language_id, mixing, quality_trees, queries, toxicity,
)
from loomcart.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, rid int, size string"


def documents(spark, rows):
    """rows of (doc_id, text, lang, source); extra columns clash with inner names."""
    return spark.createDataFrame(
        [(i, t, lg, src, None if t is None else len(t), "s", 7, "z") for i, t, lg, src in rows], DOCS)


def syllables(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"])
                            for _ in range(rng.randint(1, 4))) for _ in range(n))


# -- n-gram Jaccard join -------------------------------------------------------

def brute_classes(rows):
    """(links, class) of each row by all pairs."""
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            common = len(sets[a] & sets[b])
            if common and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return links, [find(x) for x in range(len(rows))]


def near_rows():
    rng = random.Random(11)
    rows, i = [], 0
    for _ in range(12):
        base = syllables(rng, rng.randint(60, 120)).split()
        for _ in range(rng.choice([1, 2, 3, 9])):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "changed"
            rows.append((i, " ".join(w), "en", "a"))
            i += 1
    common = syllables(rng, 55)
    for _ in range(10):
        rows.append((i, common + " " + syllables(rng, 80), "en", "a"))
        i += 1
    for t in (None, "", "  ", "one", "one", "two words", "two  words", "a b c d e", rows[0][1], rows[0][1],
              "x " * 4000, "x " * 5000):
        rows.append((i, t, "en", "a"))
        i += 1
    return rows


@pytest.mark.parametrize("settings", [
    chosen_path.JoinSettings(), chosen_path.JoinSettings(bucket=3, max_depth=2, tile=2, broadcast_texts=0)])
def test_chosen_path_equals_all_pairs(spark, settings):
    rows = near_rows()
    links, classes = brute_classes(rows)
    got = chosen_path.similar_documents(documents(spark, rows), settings=settings).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(len(rows)))
    assert [r.n_links for r in got] == links
    assert [r.class_id for r in got] == classes
    sizes = collections.Counter(classes)
    assert [r.class_size for r in got] == [sizes[c] for c in classes]


def test_chosen_path_repeated_and_null_ids(spark):
    t = syllables(random.Random(3), 40)
    got = chosen_path.similar_documents(documents(
        spark, [(1, t, "en", "a"), (1, t, "en", "a"), (None, t, "en", "a"), (None, None, "en", "a")])).collect()
    assert sorted((r.doc_id or 0, r.n_links, r.class_id or 0, r.class_size) for r in got) == [
        (0, 0, 0, 1), (0, 2, 1, 3), (1, 2, 1, 3), (1, 2, 1, 3)]
    assert chosen_path.similar_documents(documents(spark, [])).count() == 0


def test_shingle_sets_match_python():
    texts = [t or "" for _, t, *_ in near_rows()] + ["é ß 😀 a b c", "\x00 a\x0bb c d e f"]
    h, b = chosen_path.shingle_sets(pa.array(texts), 5)
    seen = {}
    for t, x, y in zip(texts, b[:-1], b[1:]):
        w = WORD.findall(t)
        want = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        assert len(want) == y - x
        assert seen.setdefault(frozenset(want), h[x:y].tobytes()) == h[x:y].tobytes()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- source mix ------------------------------------------------------------------

def mix_rows():
    rng = random.Random(8)
    rows = []
    for i in range(260):
        src = rng.choice(["hot"] * 5 + ["b", "c", "d", None])
        rows.append((i, syllables(rng, rng.choice([0, 3, 40, 300])), "en", src))
    rows += [(300, None, "en", "hot"), (None, "x y z", "en", "only"), (5, "again", "en", "hot"),
             (5, "again", "en", "hot"), (301, "w " * 9000, "en", "b")]
    return rows


def brute_targets(rows):
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped = set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        level = rest / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and weight[s] * level > 3 * size[s]}
        if not over:
            return size, {s: 3 * size[s] if s in capped else weight[s] * level for s in order}
        capped |= over


@pytest.mark.parametrize("block", [256, 7])
def test_mix_reaches_targets(spark, block):
    rows = mix_rows()
    size, target = brute_targets(rows)
    df = documents(spark, rows)
    settings = mixing.MixSettings(block_words=block, schedule_chunk=64, grid=16)
    got = mixing.mix(df, settings=settings, row_col=None).collect()
    assert len(got) == len(rows)
    by = collections.Counter()
    src_of = collections.defaultdict(set)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        src_of[r.source_size, round(r.target, 6)].add(1)
        by[round(r.target, 6)] += r.taken
    for t in {round(x, 6) for x in target.values()}:
        names = [s for s in target if round(target[s], 6) == t]
        assert abs(by[t] - t * len(names)) <= len(names)
    again = mixing.mix(df.repartition(7), settings=settings).collect()
    def key(r):
        return str(r)

    assert sorted(map(key, got)) == sorted(map(key, again))


def test_slots_follow_the_golden_schedule(spark):
    per = spark.createDataFrame([("a", 0, 9000, 5.0, 6000.0), ("b", 1, 5000, 2.0, 3000.0), ("c", 2, 900, 1.0, 1500.0)],
                                "src string, ord int, source_size long, weight double, target double")
    s = mixing.MixSettings(block_words=10, schedule_chunk=32, grid=8)
    slots = mixing.slot_table(per, s).collect()
    n = math.ceil(10500 / 10)
    drawn = sorted((r.i, r.ord) for r in slots if r.i < n)
    assert len({i for i, _ in drawn}) == len(drawn) and len(drawn) >= n - 30
    for upto in (100, 400, 1000):       # every stretch holds each source near its share
        part = [o for i, o in drawn if i < upto]
        for o, share in ((0, 6000), (1, 3000), (2, 1500)):
            assert abs(part.count(o) - upto * share / 10500) <= 6
    taken = collections.Counter()
    for r in slots:
        taken[r.ord] += r.words
    assert taken == {0: 6000, 1: 3000, 2: 1500}


def brute_slots(rows, s):
    """(taken, first slot, number and sum of slots) of each row, walking the
    schedule point by point."""
    size, target = brute_targets(rows)
    order = sorted(size, key=lambda x: (x is None, x or ""))
    sizes = [len(WORD.findall(t or "")) for _, t, _, _ in rows]
    stream = {}                                  # of each source: the row of every word
    for src in order:
        mine = sorted((k for k, r in enumerate(rows) if r[3] == src), key=lambda k: (
            hashlib.md5(str("" if rows[k][0] is None else rows[k][0]).encode()).hexdigest(),
            rows[k][0] is not None, rows[k][0], sizes[k]))
        stream[src] = [k for k in mine for _ in range(sizes[k])]
    total, at, edges = sum(target[x] for x in order), 0.0, []
    for src in order:
        if size[src]:
            at += target[src]
            edges.append((at / total, src))
    n = math.ceil(total / s.block_words)
    slots, passed = collections.Counter(), {}
    place = {src: 0 for src in order}            # words taken so far
    want = {src: math.floor(target[src] + 0.5) for src in order}
    got = [[0, None, 0, 0] for _ in rows]

    def take(src, i):
        start = place[src] % size[src]
        stop = min(start - start % s.block_words + s.block_words, size[src], start + want[src] - place[src])
        for k in sorted(set(stream[src][start:stop])):
            x = got[k]
            x[1], x[2], x[3] = i if x[1] is None else min(x[1], i), x[2] + 1, x[3] + i
        for k in stream[src][start:stop]:
            got[k][0] += 1
        place[src] += stop - start

    for i in range(n):
        x = (i % mixing.PERIOD * mixing.GOLDEN + mixing.GOLDEN // 2) % mixing.PERIOD / mixing.PERIOD
        src = next((src for edge, src in edges[:-1] if x < edge), edges[-1][1])
        if place[src] < want[src]:
            take(src, i)
    for src in order:
        i = n
        while size[src] and place[src] < want[src]:
            take(src, i)
            i += 1
    return [tuple(x) for x in got]


def test_mix_follows_the_schedule(spark, monkeypatch):
    """Slots of every row equal the walked schedule's; another multiplier
    deals other slots."""
    rows = [r for r in mix_rows() if r[0] != 5]
    s = mixing.MixSettings(block_words=16, schedule_chunk=64, grid=16)
    def dealt():
        got = mixing.mix(documents(spark, rows), settings=s).collect()
        return sorted(((r.doc_id, r.taken, r.first_slot, r.n_slots, r.slot_sum) for r in got), key=str)
    want = sorted(((r[0], *x) for r, x in zip(rows, brute_slots(rows, s))), key=str)
    golden = dealt()
    assert golden == want
    monkeypatch.setattr(mixing, "GOLDEN", 1)
    assert dealt() != golden


def test_mixed_documents_lie_by_the_schedule(spark):
    """Any stretch of the mixed rows holds each source near its share."""
    rng = random.Random(3)
    rows = [(i, "w " * 20, "en", rng.choice("abc")) for i in range(3000)]
    s = mixing.MixSettings(block_words=20)
    out = [r.source for r in mixing.mixed_documents(documents(spark, rows).repartition(5), settings=s).collect()]
    _, target = brute_targets(rows)
    total = sum(target.values())
    for lo in range(0, len(out) - 300, 300):
        part = out[lo:lo + 300]
        for src in "abc":
            assert abs(part.count(src) - 300 * target[src] / total) <= 12


def test_numbered_rows_keep_their_keys(spark, tmp_path):
    """A Parquet table read as it is needs no copy; anything else is written."""
    from loomcart.llm.common import numbered, read_as_is

    df = spark.range(50).repartition(3).withColumn("text", F.lit("x"))
    df.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t")).select("text", "id").where("id > 3")
    assert read_as_is(read) and not read_as_is(read.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))))
    a, b = numbered(read, "rows", "__row"), numbered(read.repartition(5), "rows", "__row")
    for x in (a, b):
        keys = {r.id: str(r["__row"]) for r in x.collect()}
        assert len(set(keys.values())) == 46 and {r.id: str(r["__row"]) for r in x.repartition(2).collect()} == keys


def test_slots_are_not_broadcast(spark, tmp_path):
    """However few the sources, their slots grow with the words."""
    def rows_of_broadcasts(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return rows_of_broadcasts(node.executedPlan())
        if name.endswith("QueryStage"):
            return rows_of_broadcasts(node.plan())
        below = [n for i in range(node.children().size()) for n in rows_of_broadcasts(node.children().apply(i))]
        return below + ([node.metrics().apply("numOutputRows").value()] if name == "BroadcastExchange" else [])

    sizes = spark.createDataFrame([(i, src, 10_000_000) for i, src in enumerate("abca")],
                                  "doc_id long, src string, size long")
    mixing.targets_of(sizes).write.parquet(str(tmp_path / "per"))
    table = mixing.slot_table(spark.read.parquet(str(tmp_path / "per"))).groupBy("ord").count()
    slots = sum(r["count"] for r in table.collect())
    sides = rows_of_broadcasts(table._jdf.queryExecution().executedPlan())
    assert slots > 150_000 and sides and max(sides) < 2_000


def test_mix_empty(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    r = mixing.mix(documents(spark, [(1, None, "en", None), (2, "", "en", "a")])).collect()
    assert [(x.size, x.taken, x.target) for x in r] == [(0, 0, 0.0)] * 2


# -- nearest neighbours ----------------------------------------------------------

def brute_neighbours(rows, every, k=10):
    """Sorted (query, rank, id, distance) of every query row, by all pairs."""
    good = [(n, i, np.array(v, np.float64)) for n, (i, v, *_) in enumerate(rows)
            if v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]

    def distance(a, b):
        with np.errstate(over="ignore"):
            d = a - b
            total = np.add.accumulate(d ** 2)[-1]
            most = np.abs(d).max()
        if 1e-280 < total < np.inf or not 0 < most < np.inf:
            return float(np.sqrt(total))
        return float(most * np.sqrt(np.add.accumulate((d / most) ** 2)[-1]))

    out = []
    for n, q, v in good:
        if q is not None and q % every == 0:
            near = sorted((distance(w, v), j is None, j or 0, j) for m, j, w in good if m != n and len(w) == len(v))
            out += [(q, r, j, d) for r, (d, _, _, j) in enumerate(near[:k], 1)]
    return sorted(out, key=str)


def neighbours_of(spark, rows, every, **settings):
    frame = spark.createDataFrame([(i, v, "c", 7, 3) for i, v, *_ in rows],
                                  "vec_id long, embedding array<double>, score string, row int, dim int")
    got = block_ann.nearest(frame, F.col("id") % every == 0, **settings).collect()
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got), key=str)


def test_block_neighbours_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[30] = x[31] = x[32]                                   # ties
    x[50] *= 1e4
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 12), (1002, [1.0, None] + [0.0] * 10), (1003, [float("nan")] * 12),
             (1004, [float("inf")] * 12), (1005, [1.0] * 3), (None, [1.0] * 12), (1010, [])]
    assert neighbours_of(spark, rows, 10, block=64, query_block=16) == brute_neighbours(rows, 10)


def test_block_neighbours_small(spark):
    assert neighbours_of(spark, [(0, [1.0, 0.0]), (10, [0.0, 1.0])], 10) == [
        (0, 1, 10, math.sqrt(2)), (10, 1, 0, math.sqrt(2))]
    assert neighbours_of(spark, [], 10) == []
    assert neighbours_of(spark, [(0, [1.0, 0.0])], 10) == []


def test_block_neighbours_of_large_and_small_components(spark):
    """Squares that leave the range of doubles drop nobody."""
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [1e200, -3.0]), (3, [-1e200, 0.0]), (10, [1e-200, 2e-200]),
            (4, [1e-200, 0.0]), (5, [1.0, 1.0]), (6, [1e308, -1e308]), (20, [-1e308, 1e308]), (7, [5e-324, 0.0])]
    for block in (4096, 3):
        assert neighbours_of(spark, rows, 10, block=block, query_block=2) == brute_neighbours(rows, 10)
    assert neighbours_of(spark, rows[:3], 10)[0] == (0, 1, 1, 1.0)


def test_block_neighbours_of_every_length(spark):
    """Vectors meet those of their own length, however rare it is."""
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(rng.choice([2, 3, 3, 3, 8]))]) for i in range(150)]
    assert {len(v) for i, v in rows if i % 10 == 0} == {2, 3, 8}
    assert neighbours_of(spark, rows, 10, block=20, query_block=4) == brute_neighbours(rows, 10)


def test_block_neighbours_repeated_and_null_ids(spark):
    """Each row of a query id asks and is a candidate of the others; one id
    that holds a third of all rows is spread over the blocks."""
    rows = [(0, [0.0, 1.0]), (0, [9.0, 1.0]), (0, [5.0, 5.0]), (1, [1.0, 1.0]), (2, [9.0, 2.0]), (3, [5.0, 5.5]),
            (4, [30.0, 1.0]), (4, [9.5, 1.0]), (5, [1.0, 2.0, 3.0]), (None, [5.0, 5.5]), (None, [5.0, 5.0])]
    assert neighbours_of(spark, rows, 10, k=4) == brute_neighbours(rows, 10, 4)
    rng = random.Random(2)
    rows = [(20 if i % 3 == 0 else i, [rng.uniform(-1, 1), 1.0]) for i in range(90)]
    assert neighbours_of(spark, rows, 20, block=16, query_block=8) == brute_neighbours(rows, 20)


# -- classifiers -----------------------------------------------------------------

def labelled(spark, n=500):
    rng = random.Random(21)
    docs, labels = [], []
    for i in range(n):
        w = syllables(rng, rng.randint(20, 60)).split()
        toxic, good = int(rng.random() < 0.25), int(rng.random() > 0.3)
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["rotzig", "blarken", "snivvy"]))
        text = " ".join(w) + "."
        if not good:
            text = " ".join(x + "#*$" for x in w)
        docs.append((i, text, "en", "a"))
        labels.append((i, good, toxic, "extra"))
    docs += [(n, None, "en", "a"), (n + 1, "", "en", "a"), (n + 2, "z" * 3000, "en", "a"), (None, "null id", "en", "a"),
             (0, docs[0][1], "en", "a")]
    labels += [(n, None, None, "x"), (None, 1, 1, "x"), (1, labels[1][1], labels[1][2], "x")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    return documents(spark, docs), lab, {i: (g, t) for i, g, t, _ in labels[:n]}


def test_toxicity_held_out(spark):
    docs, lab, truth = labelled(spark)
    fold = queries.crc_remainder("doc_id", 5)
    model = toxicity.train(docs, lab, fold != 0, fold == 4)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == 505
    held = [(r.score >= 0.5, truth[r.doc_id][1]) for r in got
            if r.doc_id is not None and r.doc_id < 500 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.distance for r in got if r.doc_id in (500, 501)} == {0}
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    flagged = sum(r.score >= 0.5 for r in got)
    assert kept.count() == 505 - flagged


def test_toxicity_without_labels(spark):
    docs, lab, _ = labelled(spark, 20)
    model = toxicity.train(docs, lab.where("toxic = 0"), F.lit(True), F.lit(False))
    assert {r.score for r in toxicity.score_documents(docs, model).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def held_out_toxicity(spark, texts):
    """(predicted, label) of the rows that took no part in learning."""
    fold = queries.crc_remainder("doc_id", 5)
    docs = documents(spark, [(i, t, "en", "a") for i, (t, _) in enumerate(texts)])
    lab = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, toxicity.train(docs, lab, fold != 0, fold == 4)).collect()
    return [(int(r.score >= 0.5), texts[r.doc_id][1]) for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]


def test_toxicity_weak_words_add_up(spark):
    """Each word is in ordinary texts too, and too rare to stand out alone."""
    rng = random.Random(41)
    weak = [a + b for a in ("quab", "zilf", "mowk", "jurp", "vexo", "fygg") for b in ("adu", "ilo", "oma", "uzi", "eky", "ywa")]
    texts = []
    for _ in range(600):
        w, y = syllables(rng, rng.randint(30, 60)).split(), int(rng.random() < 0.25)
        for x in rng.sample(weak, 6 if y else 1):
            w.insert(rng.randrange(len(w)), x)
        texts.append((" ".join(w), y))
    held = held_out_toxicity(spark, texts)
    assert sum(p == t for p, t in held) >= 0.95 * len(held)


def test_toxicity_phrases(spark):
    """The words are in every text; only neighbours mark a toxic one."""
    rng = random.Random(42)
    heads, tails = ["golden", "silent", "wooden"], ["ladder", "bucket", "window"]
    texts = []
    for _ in range(500):
        w, y = syllables(rng, 40).split(), int(rng.random() < 0.25)
        for x in heads + tails:
            w.insert(2 * rng.randrange(len(w) // 2), x)
        w = [v for a, b in zip(w, [*w[1:], ""]) for v in ([a, "and"] if a in heads and b in tails else [a])]
        if y:
            for a, b in zip(heads, tails):
                w += [a, b, "the"]
        else:
            for a, b in zip(heads, tails):
                w += [b, a, "the"]
        texts.append((" ".join(w), y))
    held = held_out_toxicity(spark, texts)
    assert sum(p == t for p, t in held) >= 0.95 * len(held)


def test_toxicity_repeated_ids_teach_once(spark):
    docs, lab, _ = labelled(spark, 200)
    hot = docs.where("doc_id = 3").withColumn("times", F.explode(F.sequence(F.lit(1), F.lit(150)))).drop("times")
    fold = queries.crc_remainder("doc_id", 5)
    assert toxicity.train(docs.unionByName(hot), lab, fold != 0, fold == 4) == toxicity.train(
        docs, lab, fold != 0, fold == 4)


def test_quality_trees_held_out(spark):
    docs, lab, truth = labelled(spark)
    fold = queries.crc_remainder("doc_id", 4)
    trees = quality_trees.train(docs, lab, fold != 2, fold == 3)
    got = quality_trees.score_documents(docs, trees).collect()
    held = [(r.score >= 0.7, truth[r.doc_id][0]) for r in got
            if r.doc_id is not None and r.doc_id < 500 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert len(got) == 505 and all(0 <= r.score <= 1 for r in got)
    one = quality_trees.train(docs, lab.where("quality = 1"), F.lit(True), F.lit(False))
    assert min(r.score for r in quality_trees.score_documents(docs, one).collect()) > 0.9
    none = quality_trees.train(docs, lab.limit(0), F.lit(True), F.lit(False))
    assert {r.score for r in quality_trees.score_documents(docs, none).collect()} == {0.5}


def test_flat_trees_equal_recursive_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    trees = quality_trees.fit(x, y, np.arange(600) % 4 == 0)

    def walk(row):
        total = trees.base
        for at in trees.roots:
            while trees.left[at] >= 0:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        return 1 / (1 + math.exp(-total))

    got = trees.score(x)
    assert np.allclose(got, [walk(r) for r in x])
    assert ((got > 0.5) == y).mean() > 0.95


def test_language_id(spark):
    rng = random.Random(9)
    sound = {"aa": ["th", "er", "on", "ing"], "bb": ["sch", "ein", "ung", "keit"], "cc": ["eau", "tion", "oir", "elle"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(sound[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    rows = [(i, text(lg, rng.randint(5, 40)), lg, "a") for i, lg in enumerate(rng.choices(sorted(sound), k=300))]
    rows += [(400, None, "aa", "a"), (401, "", "aa", "a"), (402, "123 !?", "aa", "a"),
             (403, text("bb", 5000).upper(), "bb", "a"), (404, text("cc", 9), None, "a"), (None, text("aa", 9), "aa", "a")]
    docs = documents(spark, rows)
    fold = queries.crc_remainder("doc_id", 3)
    model = language_id.train(docs, fold != 1)
    assert sorted(model) == sorted(sound)
    got = language_id.name_documents(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (400, 401, 402)] == ["und"] * 3 and by[400].score == 0
    assert by[403].lang_pred == "bb" and by[404].lang_pred == "cc"
    held = [(by[i].lang_pred, lg) for i, _, lg, _ in rows[:300] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == t for p, t in held) >= 0.98 * len(held)
    assert {r.lang_pred for r in language_id.name_documents(docs, {}).collect()} == {"und"}


def test_language_id_learns_from_long_texts(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(["alpha", "beta"]) for _ in range(9)), "aa", "a") for i in range(20)]
    rows += [(100 + i, " ".join(rng.choice(["sutra", "velum"]) for _ in range(5000)), "bb", "a") for i in range(5)]
    docs = documents(spark, rows)
    model = language_id.train(docs, F.lit(True))
    assert sorted(model) == ["aa", "bb"]
    got = language_id.name_documents(docs, model).collect()
    assert all(r.lang_pred == ("bb" if r.doc_id >= 100 else "aa") for r in got)


# -- pipeline --------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(31)
    docs, lab, _ = labelled(spark, 120)
    base = [tuple(r)[:5] for r in docs.collect()]
    near = syllables(rng, 80)
    secret = "password=" + "ab12cd34" * 3
    base += [(900 + k, near + f" end{k}", "en", s, 0) for k, s in enumerate(["a", None, "b"])]
    base += [(950, f"see {secret} here " + syllables(rng, 30), "en", "b", 0), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    d = str(tmp_path)
    spark.createDataFrame(base, schema).write.parquet(f"{d}/documents.parquet")
    lab.write.parquet(f"{d}/labels.parquet")
    step = spark.read.parquet(f"{d}/documents.parquet").withColumn("size", F.lit("clash")).withColumn("__row", F.lit(1))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{d}/{name}"
        stage(spark, step, d).write.parquet(out)
        step = spark.read.parquet(out)
        seen[name] = step.collect()
        if name != "sentencepiece":
            assert step.columns == list(corpus_pipeline.DOC_COLUMNS)
    texts = {k: [r.text for r in v] for k, v in seen.items() if k != "sentencepiece"}
    assert sum((t or "").startswith(near) for t in texts["toxicity"]) == 3
    assert [r.doc_id for r in seen["near_duplicates"] if (r.text or "").startswith(near)] == [900]
    assert any("[SECRET]" in (t or "") for t in texts["secrets"])
    assert not any(secret in (t or "") for t in texts["secrets"])
    assert len(seen["secrets"]) == len(seen["near_duplicates"])
    # The mix repeats or drops whole rows, never changes one.
    before = {tuple(r) for r in seen["secrets"]}
    assert {tuple(r) for r in seen["source_mix"]} <= before
    assert len(seen["sentencepiece"]) == len(seen["source_mix"])
    assert all(r.round_trip for r in seen["sentencepiece"])
    assert corpus_pipeline.run(spark, d).count() == len(seen["sentencepiece"])


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
