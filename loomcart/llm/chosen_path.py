"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles.  A run walks every set down a path: at
each node a coordinate is sampled (the same for all sets at the node) and the
sets part by their smallest shingle under that coordinate's hash, so two sets
stay together with a probability equal to their similarity.  Buckets up to
``bucket`` sets are compared by brute force; larger ones are split further,
and those still large at ``max_depth`` are compared in tiles.  Runs repeat
until each set's chance to have missed a partner of the least similarity is
below 1 - ``target_recall``.

Brute force in buckets compares sketches (one byte of each smallest shingle);
sets joined by surviving pairs form a candidate cluster.  Within clusters all
pairs are then compared exactly on the shingle sets, each pair once, in tiles,
so neither pairs nor groups are ever listed: a tile returns per set its number
of linked documents and one edge to the smallest set it is connected to.

Sets equal in every shingle are compared as one and counted with their number
of documents.

Defined cases: a text with fewer words than a shingle is one shingle of all
its words; a text without words (null, empty) is linked to nothing and is a
class of its own; ids may repeat or be null, each row keeps its own result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, numbered, text_of, written
from .components import components

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


@dataclass(frozen=True)
class JoinSettings:
    words: int = 5
    similarity: tuple[int, int] = (4, 5)       # 0.8 as a fraction
    target_recall: float = 0.999999
    coordinates: int = 64                      # smallest shingles kept of a set
    bucket: int = 4096                         # sets compared by brute force
    max_depth: int = 2
    tile: int = 256                            # sets on a side of an exact tile
    least_sketch: int = 32                     # equal sketch bytes, six deviations below 0.8
    broadcast_texts: int = 2_000_000           # 8-byte keys; more are joined by a shuffle


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(n, U64(b), U64)
            p[:1] = 1
            _POWERS[name] = np.cumprod(p, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and the bounds."""
    texts = texts.cast(pa.large_binary())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    ends = np.cumsum(sizes)
    n_docs = len(sizes)
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[0] = True
    edge[ends] = True
    before = np.r_[False, inside[:-1]] if len(raw) else inside
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.r_[inside[1:], False] if len(raw) else inside
    last = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = _powers(len(raw) + 1)
    total = np.r_[U64(0), np.cumsum((raw.astype(U64) + U64(1)) * up[:len(raw)], dtype=U64)]
    word = _mixed((total[last] - total[first]) * down[first])
    doc = np.searchsorted(ends, first, side="right")
    n_words = np.bincount(doc, minlength=n_docs)
    word_end = np.cumsum(n_words)
    word_start = word_end - n_words
    # Shingles of full length, and one of all words for shorter texts.
    n = np.where(n_words >= words, n_words - words + 1, (n_words > 0).astype(np.int64))
    owner = np.repeat(np.arange(n_docs), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + word_start[owner]
    h = np.full(len(owner), U64(0x51ED270B7F4A7C15), U64)
    for k in range(words):
        there = at + k < word_end[owner]
        own = word[np.minimum(at + k, max(len(word) - 1, 0))] if len(word) else h
        h = np.where(there, _mixed(h * U64(BASE) + own), h)
    by = np.lexsort((h, owner))
    h, owner = h[by], owner[by]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.r_[0, np.cumsum(np.bincount(owner, minlength=n_docs))]


def smallest(h: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """Per set (row) the smallest value under each coordinate's hash; 0 for
    empty sets."""
    out = np.zeros((len(bounds) - 1, coordinates), np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        x = (h >> U64(32)).astype(np.uint32) ^ h.astype(np.uint32)
        for c in range(coordinates):
            a, b = (int.from_bytes(hashlib.blake2b(f"{c}/{p}".encode(), digest_size=4).digest(), "big")
                    for p in "ab")
            y = (x ^ np.uint32(b)) * np.uint32(a | 1)
            y = (y ^ (y >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out[some, c] = np.minimum.reduceat(y ^ (y >> np.uint32(13)), bounds[:-1][some])
    return out


def _sketched(docs: DataFrame, s: JoinSettings) -> DataFrame:
    """id, tk (digest of the text), fp (digest of the set; null if empty), sig
    (smallest shingles, four bytes each), sk (one byte of each)."""
    key = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in in_slices(pc.binary_length(b.column(2)).to_pylist(), 1_000_000):
                h, bounds = shingle_sets(b.column(2).slice(lo, hi - lo), s.words)
                sig = smallest(h, bounds, s.coordinates)
                fp = [hashlib.blake2b(h[x:y].tobytes(), digest_size=16).digest() if y > x else None
                      for x, y in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo),
                     pa.array(fp, pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary()),
                     pa.array([r.tobytes() for r in sig.astype(np.uint8)], pa.binary())],
                    names=["id", "tk", "fp", "sig", "sk"])

    return docs.mapInArrow(run, f"id {key}, tk string, fp binary, sig binary, sk binary")


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Tables that each hold whole groups of equal keys, of rows sorted by
    key; a few thousand rows or one group at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key)
        tail = keys[b.num_rows - 1]
        if held and held[0].column(key)[held[0].num_rows - 1] != tail or not held:
            # The last group of this batch may go on in the next.
            cut = int(np.flatnonzero(~pc.equal(keys, tail).to_numpy(zero_copy_only=False))[-1]) + 1 \
                if pc.any(pc.not_equal(keys, tail)).as_py() else 0
            done = [*held, b.slice(0, cut)]
            if sum(x.num_rows for x in done):
                yield pa.Table.from_batches(done)
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest connected row of each row after adding the pairs (a, b)."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        x, y = x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]


def _spans_of(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    yield from zip(first.tolist(), [*first[1:].tolist(), len(keys)])


def _tiled(df: DataFrame, key: str, size: str, side: int) -> DataFrame:
    """Spread each group over tiles of at most about side x side rows: adds
    tile (hash of the group and block pair) and part (0 or 1: block)."""
    blocks = F.ceil(F.col(size) / side).cast("int")
    own = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    out = df.withColumn("blocks", blocks).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    out = out.select("*", other)
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    return out.select(*[c for c in df.columns],
                      F.xxhash64(key, lo, hi).alias("tile"),
                      F.when(F.col("own") == F.col("other"), 2).when(
                          F.col("own") == lo, 0).otherwise(1).cast("int").alias("part"))


def _candidate_edges(leaves: DataFrame, s: JoinSettings) -> DataFrame:
    """Brute force on sketches: (a, b) edges from each set to the smallest set
    it is connected to in its bucket or tile."""
    coordinates, least = s.coordinates, s.least_sketch

    def run(batches):
        for t in _groups(batches, 0):
            keys = t.column(0).to_numpy()
            rid = t.column(1).to_numpy()
            part = t.column(2).to_numpy()
            sk = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint8).reshape(-1, coordinates)
            out_a, out_b = [], []
            for x, y in _spans_of(keys):
                if y - x < 2:
                    continue
                by = x + np.argsort(rid[x:y])
                ids, own, cut = rid[by], sk[by], part[by]
                root = np.arange(len(ids))
                for i in range(0, len(ids), 32):      # a strip of pairs at a time
                    same = (own[i:i + 32, None, :] == own[None, i:, :]).sum(2, dtype=np.uint8) >= least
                    a, b = np.nonzero(same)
                    a, b = a + i, b + i
                    ok = (a < b) & ((cut[a] == 2) | (cut[a] != cut[b]))
                    root = _joined(root, a[ok], b[ok])
                moved = root != np.arange(len(ids))
                out_a.append(ids[moved])
                out_b.append(ids[root[moved]])
            if out_a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    sorted_tiles = leaves.select("tile", "rid", "part", "sk").repartition("tile").sortWithinPartitions("tile")
    return sorted_tiles.mapInArrow(run, "a long, b long")


def _walk(reps: DataFrame, runs: range, s: JoinSettings) -> DataFrame:
    """Buckets of the runs: rid, node, size, depth; one row per set and run
    (single sets too)."""
    def coordinate(path):
        return F.pmod(F.xxhash64(path, F.lit("coordinate")), F.lit(s.coordinates)).cast("int")

    rows = reps.select("rid", "sig", F.explode(F.array(*[F.lit(r) for r in runs])).alias("run"))
    rows = rows.withColumn("node0", F.xxhash64(F.lit("run"), "run"))
    for d in range(1, s.max_depth + 1):
        # Four bytes of the signature, at the sampled coordinate.
        path = F.col(f"node{d - 1}")
        rows = rows.withColumn("at", coordinate(path))
        rows = rows.withColumn(f"node{d}", F.xxhash64(path, "at", F.substring(
            F.col("sig"), F.col("at") * 4 + 1, F.lit(4))))
    rows = rows.select("rid", *[f"node{d}" for d in range(1, s.max_depth + 1)])
    done = []
    for d in range(1, s.max_depth + 1):
        node = f"node{d}"
        sized = rows.join(rows.groupBy(node).agg(F.count("rid").alias("size")), node)
        end = (F.col("size") <= s.bucket) if d < s.max_depth else F.lit(True)
        done.append(sized.where(end).select("rid", F.col(node).alias("node"), "size", F.lit(d).alias("depth")))
        rows = sized.where(~end).drop("size")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _edges(reps: DataFrame, s: JoinSettings) -> DataFrame:
    """Candidate edges of as many runs as the target recall asks for."""
    each, allowed = s.similarity[0] / s.similarity[1], 1 - s.target_recall
    batch = math.ceil(math.log(allowed) / math.log(1 - each))
    active, runs, edges, missed = reps, 0, None, None
    while True:
        walked = written(_walk(active, range(runs, runs + batch), s), "join-buckets")
        near = _tiled(walked.where(F.col("size") > 1), "node", "size", s.bucket).join(
            reps.select("rid", "sk"), "rid")
        found = written(_candidate_edges(near, s), "join-edges")
        edges = found if edges is None else edges.unionByName(found)
        runs += batch
        # A run that ends at depth d misses a partner of the least similarity
        # with chance 1 - similarity^d.  Sets whose runs all end at depth 1
        # are within the allowed chance; only the others are added up.
        deep = walked.where(F.col("depth") > 1).groupBy("rid").agg(
            F.count("rid").alias("n"), F.sum(F.log(1 - F.pow(F.lit(each), F.col("depth")))).alias("l"))
        miss = F.exp(F.col("l") + (batch - F.col("n")) * math.log(1 - each))
        now = deep.select("rid", miss.alias("miss"))
        if missed is not None:
            # A set not deep in this batch has added enough by it alone.
            now = now.join(missed.withColumnRenamed("miss", "before"), "rid").select(
                "rid", (F.col("miss") * F.col("before")).alias("miss"))
        missed = written(now.where(F.col("miss") > allowed), "join-missed")
        if missed.isEmpty():
            return edges
        active = reps.join(missed.select("rid"), "rid", "left_semi")


def _exact(sets: DataFrame, s: JoinSettings) -> DataFrame:
    """Exact comparison within clusters: per tile and set (rid, root, linked):
    the smallest set it is connected to there, and the documents it links."""
    num, den = s.similarity

    def linked(own, cut):
        """Pairs (a, b), a < b, of rows at least similar."""
        n = len(own)
        size = np.array([len(x) for x in own])
        if n <= 24:
            common = np.zeros((n, n), np.int64)
            for a in range(n):
                for b in range(a + 1, n):
                    if size[a] * den >= size[b] * num and size[b] * den >= size[a] * num:
                        common[a, b] = len(np.intersect1d(own[a], own[b], assume_unique=True))
        else:
            flat = np.concatenate(own)
            row = np.repeat(np.arange(n), size)
            _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
            shared = count[code] > 1
            _, code = np.unique(code[shared], return_inverse=True)
            row = row[shared]
            common = np.zeros((n, n), np.float32)     # counts far below 2^24
            by = np.argsort(code, kind="stable")
            code, row = code[by], row[by]
            width = 2048
            for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
                x, y = np.searchsorted(code, [lo, lo + width])
                part = np.zeros((n, width), np.float32)
                part[row[x:y], code[x:y] - lo] = 1
                common += part @ part.T
            common = common.astype(np.int64)
        union = size[:, None] + size[None, :] - common
        a, b = np.nonzero((common * den >= union * num) & (common > 0))
        ok = (a < b) & ((cut[a] == 2) | (cut[a] != cut[b]))
        return a[ok], b[ok]

    def run(batches):
        for t in _groups(batches, 0):
            keys, rid = t.column(0).to_numpy(), t.column(1).to_numpy()
            part, docs = t.column(2).to_numpy(), t.column(3).to_numpy()
            raw = t.column(4).to_pylist()
            out = ([], [], [])
            for x, y in _spans_of(keys):
                by = x + np.argsort(rid[x:y])
                own = [np.frombuffer(raw[i], U64) for i in by]
                a, b = linked(own, part[by])
                if not len(a):
                    continue
                root = _joined(np.arange(len(by)), a, b)
                n = np.bincount(a, docs[by][b], len(by)) + np.bincount(b, docs[by][a], len(by))
                out[0].append(rid[by])
                out[1].append(rid[by][root])
                out[2].append(n.astype(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in out], names=["rid", "root", "linked"])

    ordered = sets.select("tile", "rid", "part", "docs", "shingles").repartition("tile").sortWithinPartitions("tile")
    return ordered.mapInArrow(run, "rid long, root long, linked long")


def _set_rows(docs: DataFrame, s: JoinSettings) -> DataFrame:
    """tk, shingles (64-bit hashes as bytes) of each row of (tk, t)."""
    def run(batches):
        for b in batches:
            for lo, hi in in_slices(pc.binary_length(b.column(1)).to_pylist(), 1_000_000):
                h, bounds = shingle_sets(b.column(1).slice(lo, hi - lo), s.words)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo),
                     pa.array([h[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())],
                    names=["tk", "shingles"])
    return docs.mapInArrow(run, "tk string, shingles binary")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      settings: JoinSettings = JoinSettings()) -> DataFrame:
    """One row per document: ``id_col``, class_id (smallest
    id of all documents connected by links), class_size, n_links (documents of
    at least the similarity), set_key (digest of the shingle set)."""
    s = settings
    src = docs.select(F.col(id_col).alias("id"), F.md5(text_of(text_col).cast("binary")).alias("tk"),
                      text_of(text_col).alias("t"))
    sketched = written(_sketched(src, s), "join-sketches")
    reps = written(
        sketched.where(F.col("fp").isNotNull()).groupBy("fp").agg(
            F.count("fp").alias("docs"), F.min("id").alias("low"), F.min("tk").alias("tk"),
            F.first("sig").alias("sig"), F.first("sk").alias("sk"))
        .withColumn("rid", F.monotonically_increasing_id()), "join-sets")

    clusters = components(_edges(reps, s)).select(F.col("v").alias("rid"), F.col("root").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.count("rid").alias("size"))
    chosen = written(clusters.join(sizes, "cluster").join(reps.select("rid", "tk", "docs"), "rid"),
                     "join-clusters")

    # Exact comparison: the sets of one copy of each text concerned.
    texts = src.select("tk", "t")
    keys = chosen.select(F.xxhash64("tk").alias("x"))
    if keys.count() <= s.broadcast_texts:      # spares the other texts the shuffle
        keys = F.broadcast(keys)
    texts = texts.join(keys, F.xxhash64("tk") == F.col("x"), "left_semi")
    sets = _set_rows(texts, s).groupBy("tk").agg(F.first("shingles").alias("shingles"))
    tiles = _tiled(chosen.join(sets, "tk").select("cluster", "rid", "size", "docs", "shingles"),
                   "cluster", "size", s.tile)
    exact = written(_exact(tiles, s), "join-exact")
    links = exact.groupBy("rid").agg(F.sum("linked").alias("linked"))
    roots = components(exact.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    classed = reps.select("rid", "fp", "docs", "low").join(
        roots.withColumnRenamed("v", "rid"), "rid", "left").join(links, "rid", "left")
    classed = classed.withColumn("root", F.coalesce("root", "rid"))
    whole = classed.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("docs").alias("class_size"))
    per_set = written(classed.join(whole, "root").select(
        "fp", "class_id", "class_size",
        (F.coalesce("linked", F.lit(0).cast("long")) + F.col("docs") - 1).alias("n_links")), "join-classes")
    return sketched.select("id", "fp", "tk").join(per_set, "fp", "left").select(
        F.col("id").alias(id_col), F.when(F.col("fp").isNull(), F.col("id")).otherwise(
            F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.hex("fp").alias("set_key"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                order: tuple[str, ...] = ("doc_id",), settings: JoinSettings = JoinSettings()) -> DataFrame:
    """The rows of ``docs`` less all but one of each class: the first in
    ``order`` (nulls first), then by its text's digest.  Rows without words
    belong to no class and all stay.

    Rows are told apart by a key of their own (``common.numbered``; the column
    name ``__row`` is taken), exact repeats included; the choice is a partial
    aggregate per class.
    """
    names = docs.columns
    base = numbered(docs, "join-rows", "__row")
    # The row's key takes the id's place, so a class's id is a row of its own.
    near = similar_documents(base, "__row", text_col, settings)
    ranks = base.select("__row", F.struct(*[F.col(c) for c in order], F.md5(text_of(text_col).cast("binary")),
                                          F.col("__row")).alias("rank"))
    keyed = ranks.join(near.select("__row", "class_id"), "__row")
    keep = keyed.groupBy("class_id").agg(F.min("rank")["__row"].alias("__row"))
    return base.join(keep, "__row", "left_semi").select(*names)


def similar_sql(settings: JoinSettings = JoinSettings()) -> str:
    """DuckDB statement for :func:`similar_documents` over ``documents`` (less
    set_key): every pair that shares a shingle, compared on shingle texts."""
    k = settings.words
    num, den = settings.similarity
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {k - 2}),
               lambda i: array_to_string(list_slice(w, i, i + {k - 1}), ' '))) END AS l FROM d),
e AS (SELECT rid, len(l) AS n, unnest(l) AS x FROM s),
p AS (SELECT a.rid AS a, b.rid AS b FROM e a JOIN e b ON a.x = b.x AND a.rid < b.rid
      GROUP BY a.rid, b.rid, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
own AS (SELECT a, b FROM reach UNION SELECT rid, rid FROM d)
SELECT any_value(d.doc_id) AS doc_id, min(o.doc_id) AS class_id, count(*) AS class_size,
       (SELECT count(*) FROM l WHERE l.a = d.rid) AS n_links
FROM d JOIN own ON own.a = d.rid JOIN d o ON o.rid = own.b GROUP BY d.rid"""
