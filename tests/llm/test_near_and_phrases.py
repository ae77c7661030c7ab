"""SimHash near-duplicates, phrases and spelling variants, against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from loomcart.llm import phrase_tiles, simhash_balls, variant_trie
from loomcart.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def documents(spark, rows):
    """rows of (doc_id, text, lang); extra columns clash with inner names."""
    return spark.createDataFrame(
        [(i, t, lg, "k", 7, "fp", "w") for i, t, lg in rows],
        "doc_id long, text string, lang string, k string, n int, fp string, word string")


# -- SimHash ---------------------------------------------------------------

def brute_fingerprint(t):
    w = WORD.findall(lower(t or ""))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps):
    """Smallest id reachable from each row, by all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    low = {}
    for i, _ in enumerate(fps):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low.get(find(i)) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    rng = random.Random(11)
    base = [" ".join(rng.choice("the cat sat on a mat and DOG ran éa Über  x".split(" ")) for _ in range(60))
            for _ in range(12)]
    rows = [(100 - i, t, "en") for i, t in enumerate(base)]
    for k in range(60):                               # near copies of many distances
        w = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(["one", "two", "Three"])
        rows.append((200 + k, rng.choice([" ", "  ", "\n", "\t"]).join(w), "en"))
    rows += [(5, None, None), (6, "", "en"), (7, " \n\t", "en"), (8, "one", "en"), (8, "one", "en"),
             (9, "ONE  two", "en"), (None, "lone words here and there", "en"), (300, base[0] * 50, "en")]
    got = simhash_balls.near_documents(documents(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    want = sorted(zip([r[0] for r in rows], [f"{f:016x}" for f in fps],
                      brute_components([r[0] for r in rows], fps)), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert simhash_balls.near_documents(documents(spark, [])).count() == 0


@pytest.mark.parametrize("most", [1, 4, 256])
def test_ball_edges_connect_what_pairs_connect(spark, most):
    """Every distance around the radius; small ``most`` sends crowded keys
    through whole balls."""
    rng = np.random.default_rng(3)
    fps = {0, 2 ** 64 - 1}
    for _ in range(12):
        hub = int(rng.integers(0, 2 ** 64, dtype=np.uint64))
        for _ in range(14):
            fps.add(hub ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
    for a in (1 << 63, 7):                            # a part that holds all three bits, and a spread triple
        fps |= {a, a ^ 0b111000, a ^ (1 | 1 << 30 | 1 << 60)}
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    edges = simhash_balls.near_edges(table, simhash_balls.BallSettings(most=most))
    roots = {r.v: r.root for r in components(edges).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    want = brute_components(signed, fps)
    assert [roots.get(x, x) for x in signed] == want


def test_components_with_hubs(spark):
    """A star of more edges than a hub needs, chains, and a ring."""
    edges = [(0, k) for k in range(1, 700)] + [(k, 10_000 + k) for k in range(1, 300)]
    edges += [(20_000 + k, 20_001 + k) for k in range(200)] + [(30_000, 30_002), (30_001, 30_002), (5, 5)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {v: 0 for v in [*range(700), *range(10_001, 10_300)]}
    want |= {20_000 + k: 20_000 for k in range(201)} | {30_000: 30_000, 30_001: 30_000, 30_002: 30_000}
    assert got == want


# -- spelling variants -------------------------------------------------------

def brute_variants(rows, least=5):
    counts = collections.Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        found = sorted(((-m, u) for u, m in words.items() if near(w, u)))
        form = found[0] if found and -found[0][0] >= 5 * n else None
        out[w] = (form and form[1], n, len(found), form and -form[0])
    def root(w):
        return w if out[w][0] is None else root(out[w][0])
    return {(w, f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def test_variants_match_brute_force(spark):
    rng = random.Random(13)
    stems = ["".join(rng.choice("abÀé") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    stems += ["ababab", "abababa", "aababab", "ÿÿÿÿÿÿ", "ÿÿÿÿÿÿÿ", "aaaaaa", "aaaaaaa", "a" * 3000, "a" * 2999,
              "ab" * 700 + "c", "ab" * 700 + "d", "b" + "ab" * 700 + "c"]
    rows = []
    for w in stems:
        variants = [w, w, w[:-1], w[1:], w[:3] + w[4:], w[:2] + "b" + w[2:], "é" + w[1:], w + "a"]
        for v in variants:
            text = rng.choice([" ", "1", "_", "\n"]).join([v.capitalize() if rng.random() < .3 else v]
                                                             * rng.choice([1, 5, 6, 30, 200]))
            rows.append((rng.choice([None, *range(50)]), text, "en"))
    rows += [(1, None, None), (2, "", "en"), (2, "short x", "en"), (3, "×÷×÷×÷ " * 9, "en")]
    got = {tuple(r) for r in variant_trie.variants(documents(spark, rows)).collect()}
    assert got == brute_variants(rows)
    assert variant_trie.variants(documents(spark, [])).count() == 0


def test_trie_edges_spell_the_words(spark):
    """Every word's second half is a path from its half's node, in any layout."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(6, 8))) for _ in range(300)})
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    by_node = collections.defaultdict(list)
    for e in variant_trie.edge_table(frame).collect():
        by_node[e.node].append(e)

    def ends(node, text):
        for e in by_node[node]:
            if e.near:
                yield text + e.label, e.near
            else:
                yield from ends(e.child, text + e.label)

    for w in words:
        half = len(w) // 2
        for backward in (False, True):
            t = w[::-1] if backward else w
            node = variant_trie.node_ids(t, backward, len(w), [half])[0]
            assert (t, w) in set(ends(node, t[:half]))


# -- phrases -----------------------------------------------------------------

def brute_collocations(rows, least, cover=100, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for _, t, lang in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    often = {x: a for x, a in f.items() if a >= least}
    out = []
    for (lang, p), a in often.items():
        if len(p) < 2 or any(
                o[0] == lang and len(o[1]) > len(p) and 100 * b >= cover * a
                and any(o[1][i:i + len(p)] == p for i in range(len(o[1]))) for o, b in often.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    done = set()
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        done |= {(lang, i + 1, *x[1:]) for i, x in enumerate(own[:top])}
    return done


def phrase_rows():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(30)] + ["a\x00b", "Élan", "new", "NEW", "york"]
    stock = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 7))) for _ in range(14)]
    rows = []
    for i in range(120):
        parts = [rng.choice(stock) if rng.random() < .6 else rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        text = "".join(p + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "!?", " "]) for p in parts)
        rows.append((i % 50, text, rng.choice(["en", "en", "de", None, "und"])))
    rows += [(1, None, "en"), (1, "", None), (2, "lone", "xx"), rows[3], rows[3], (7, "w1 w2 " * 3000, "de")]
    return rows


@pytest.mark.parametrize("settings", [
    {}, {"broadcast_words": 0, "broadcast_keys": 0, "dense_from": 40, "chunk_bytes": 500, "held_bytes": 20_000, "salts": 3},
    {"broadcast_keys": 150, "chunk_bytes": 3000, "dense_from": 200, "top": 25, "held_words": 5}])
def test_collocations_match_brute_force(spark, settings):
    rows = phrase_rows()
    s = phrase_tiles.PhraseSettings(least_count=12, **settings)
    got = phrase_tiles.collocations(documents(spark, rows).repartition(5), settings=s)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_collocations(rows, 12, top=s.top)
    assert len(want) > 50 and {len(x[2].split()) for x in want} >= {2, 3, 5}
    assert {tuple(r) for r in got.collect()} == want


def test_collocations_of_nothing(spark):
    assert phrase_tiles.collocations(documents(spark, [])).count() == 0
    assert phrase_tiles.collocations(documents(spark, [(1, None, None), (2, "a b a b", "en")])).count() == 0


def test_tiles_add_up():
    """Dense and sorted counting give the counts of a plain Counter."""
    rng = np.random.default_rng(4)
    keys = (rng.zipf(1.2, 40_000) % 5000).astype(np.int64) << 31 | (rng.zipf(1.3, 40_000) % 3000)
    tiles = phrase_tiles.Tiles(phrase_tiles.PhraseSettings(dense_from=500))
    for part in np.array_split(keys, 9):
        tiles.add_keys(part)
    got = {}
    for r, c, cells, counts in tiles.take():
        for cell, n in zip(cells.tolist(), counts.tolist()):
            got[(r << 10) + (cell >> 10) << 31 | (c << 10) + (cell & 1023)] = n
    assert got == collections.Counter(keys.tolist()) and tiles.size == 0
