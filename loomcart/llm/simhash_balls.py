"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 values of
its word shingles.  Fingerprints link at ``radius`` or fewer differing bits
(3, an odd number, so half of it is no whole number).  The 64 bits are cut
into three parts.  Unless two linked fingerprints are equal, some part holds a
bit in which they differ; with that part left out at most two bits differ, and
two balls of radius 1, half of that, meet.  So:

1. for each part left out, every distinct fingerprint emits its remaining bits
   and all their variants with one bit flipped (132 or so keys altogether);
2. keys are shuffled and sorted; fingerprints that collide on a key are
   verified on all 64 bits;
3. of each key's linked fingerprints one edge per fingerprint is kept, to the
   smallest it is connected to there, so no list of pairs arises.

A key shared by more than ``most`` fingerprints is not compared pair by pair:
its fingerprints go through whole balls instead, whose cost is linear.  Points
within one bit of two fingerprints link them (two bits apart at most), and a
point one bit from one and two bits from the other links those three bits
apart, so each point needs only its smallest fingerprint.

The components of the edges, over distinct fingerprints, give each document
the smallest id it can reach.

Defined cases: words are runs without space and the control characters 9 to
13, with A-Z lower-cased; a text with fewer words than a shingle is one
shingle; a text without words (null, empty) has fingerprint zero, linked like
any other; repeated rows and ids keep a row each; a null id is reached by none
(a component of null ids only has a null component); an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .components import components

U64 = np.uint64
ONE_BIT = U64(1) << np.arange(64, dtype=U64)


@dataclass(frozen=True)
class BallSettings:
    words: int = 3                 # words of a shingle
    seed: int = 42                 # of XXH64
    most: int = 256                # fingerprints of a key that are compared pair by pair
    slice_rows: int = 2000         # fingerprints whose keys are emitted together


RADIUS = 3
# First bit and number of bits of each part that is left out in turn.
PARTS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: bytes, words: int = 3, seed: int = 42, step: int = 1 << 17) -> int:
    """Fingerprint of one UTF-8 text, as an unsigned number."""
    found = text.lower().split()
    n = len(found) - words + 1
    if n < 1:
        found, n = ([b" ".join(found)], 1) if found else ([], 0)
    if not n:
        return 0
    whole = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[len(found) - n:].tolist()
    set_bits, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for lo in range(0, n, step):
        raw = b"".join([digest(whole[x:y], seed) for x, y in zip(starts[lo:lo + step], ends[lo:lo + step])])
        set_bits += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 settings: BallSettings = BallSettings()) -> DataFrame:
    """id and fp (the fingerprint's bits as a long) of every row of ``docs``."""
    s = settings
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), s.words, s.seed) for t in b.column(1)], U64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp long")


def part_keys(fp: np.ndarray) -> np.ndarray:
    """Keys of fingerprints, one row each: per part left out (its bits replaced
    by the part's number) the other bits and all variants with one flipped."""
    out = []
    for i, (low, bits) in enumerate(PARTS):
        gone = U64(((1 << bits) - 1) << low)
        kept = (fp & ~gone) | U64((i + 1) << low)
        flips = np.r_[U64(0), ONE_BIT[(ONE_BIT & gone) == 0]]
        out.append(kept[:, None] ^ flips)
    return np.concatenate(out, axis=1)


def _star(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest connected row of each row, given pairs (a, b)."""
    while True:
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return root
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]


def _linked_rows(keys: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint to the smallest connected one under its
    key; rows sorted by key, then fingerprint."""
    at = np.flatnonzero(keys[1:] == keys[:-1])
    a, b, d = [], [], 1
    while len(at):
        near = np.bitwise_count(fp[at] ^ fp[at + d]) <= RADIUS
        a.append(at[near])
        b.append(at[near] + d)
        d += 1
        at = at[at + d < len(keys)]
        at = at[keys[at] == keys[at + d]]
    if not a:
        return fp[:0], fp[:0]
    root = _star(np.arange(len(keys)), np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(root != np.arange(len(keys)))
    return fp[moved], fp[root[moved]]


def _collisions(keyed: DataFrame, s: BallSettings) -> DataFrame:
    """(a, b): verified edges; a alone (b null): a fingerprint of a key that
    holds more than ``most``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a, b=None):
            a = pa.array(a.view(np.int64))
            b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
            return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        def whole_groups(k, f):
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
            big = np.repeat(np.diff(np.r_[first, len(k)]) > s.most, np.diff(np.r_[first, len(k)]))
            yield rows(np.unique(f[big]))
            k, f = k[~big], f[~big]
            yield rows(*_linked_rows(k, f))

        held_k, held_f, over = np.zeros(0, U64), np.zeros(0, U64), None
        for batch in batches:
            k, f = (batch.column(i).to_numpy().view(U64) for i in (0, 1))
            if over is not None:               # a large key that goes on
                n = int(np.argmax(k != over)) if (k != over).any() else len(k)
                yield rows(f[:n])
                k, f = k[n:], f[n:]
            if not len(k):
                continue
            over = None
            k, f = np.r_[held_k, k], np.r_[held_f, f]
            cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
            yield from whole_groups(k[:cut], f[:cut])
            held_k, held_f = k[cut:], f[cut:]
            if len(held_k) > s.most:
                yield rows(held_f)
                over, held_k, held_f = held_k[0], held_k[:0], held_f[:0]
        yield from whole_groups(held_k, held_f)

    ordered = keyed.repartition("k").sortWithinPartitions("k", "fp")
    return ordered.mapInArrow(run, "a long, b long")


def _emitted(fps: DataFrame, columns: str, keys_of, step: int) -> DataFrame:
    """Rows of (k, fp) and whatever else ``keys_of`` gives for the distinct
    fingerprints of ``fps``."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(U64)
            for lo in range(0, len(fp), step):
                for cols in keys_of(fp[lo:lo + step]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.view(np.int64) if c.dtype == U64 else c) for c in cols], names=names)

    return fps.select("fp").mapInArrow(run, columns)


def _part_rows(fp: np.ndarray):
    k = part_keys(fp)
    yield k.ravel(), np.repeat(fp, k.shape[1])


def _near_points(fp: np.ndarray):
    """Points up to one bit away, and whether they serve those two bits away
    (exactly one bit from a fingerprint of even parity)."""
    k = fp[:, None] ^ np.r_[U64(0), ONE_BIT]
    even = np.bitwise_count(fp) % 2 == 0
    serves = np.repeat(even[:, None], k.shape[1], axis=1)
    serves[:, 0] = False
    yield k.ravel(), np.repeat(fp, k.shape[1]), serves.ravel()


def _far_points(fp: np.ndarray):
    """Points two bits away of fingerprints of odd parity: fingerprints three
    bits apart differ in parity."""
    i, j = np.triu_indices(64, 1)
    two = ONE_BIT[i] ^ ONE_BIT[j]
    odd = fp[np.bitwise_count(fp) % 2 == 1]
    for lo in range(0, len(odd), 64):
        part = odd[lo:lo + 64]
        k = part[:, None] ^ two
        yield k.ravel(), np.repeat(part, len(two))


def _ball_edges(crowded: DataFrame, s: BallSettings) -> DataFrame:
    """Edges among the fingerprints of crowded keys, by whole balls."""
    near = _emitted(crowded, "k long, fp long, serves boolean", _near_points, s.slice_rows)
    low = near.groupBy("k").agg(F.min("fp").alias("b"), F.count("fp").alias("n"),
                                F.min(F.when(F.col("serves"), F.col("fp"))).alias("even"))
    low = written(low.where((F.col("n") > 1) | F.col("even").isNotNull()), "ball-points")
    close = near.join(low.where(F.col("n") > 1).select("k", "b"), "k").select(F.col("fp").alias("a"), "b")
    far = _emitted(crowded, "k long, fp long", _far_points, s.slice_rows).join(
        low.where(F.col("even").isNotNull()).select("k", F.col("even").alias("b")), "k")
    return close.unionByName(far.select(F.col("fp").alias("a"), "b")).where(F.col("a") != F.col("b")).distinct()


def near_edges(fps: DataFrame, settings: BallSettings = BallSettings()) -> DataFrame:
    """(a, b): links that connect all fingerprints ``fp`` (distinct longs) at
    ``RADIUS`` or fewer differing bits."""
    s = settings
    met = written(_collisions(_emitted(fps, "k long, fp long", _part_rows, s.slice_rows), s).distinct(),
                  "ball-edges")
    crowded = met.where(F.col("b").isNull()).select(F.col("a").alias("fp"))
    edges = met.where(F.col("b").isNotNull())
    if crowded.isEmpty():
        return edges
    return edges.unionByName(_ball_edges(crowded, s))


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   settings: BallSettings = BallSettings()) -> DataFrame:
    """One row per document: ``id_col``, fingerprint (16 hex digits),
    component_id (smallest id reachable by links, its own included)."""
    marked = written(fingerprints(docs, id_col, text_col, settings), "ball-fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("low")), "ball-distinct")
    roots = components(near_edges(distinct, settings))
    joined = distinct.join(roots, distinct["fp"] == roots["v"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    whole = written(joined.select("fp", "root").join(least, "root").select("fp", "component_id"), "ball-components")
    return marked.join(whole, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
