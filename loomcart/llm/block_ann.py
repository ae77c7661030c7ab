"""Nearest neighbours by a block matrix join on int8 tiles.

Every vector is quantised to int8 with a scale of its own, and the length of
the difference to the original is kept.  Queries and candidates are dealt into
blocks; each pair of blocks is one tile.  A tile's matrix product of the int8
blocks gives the distances of the quantised vectors exactly (the products are
whole numbers below 2^24 in float32), so a true distance differs from it by at
most the two kept lengths.  Candidates whose lower bound is above the k-th
smallest upper bound are out; the rest are recomputed in double precision on
the original vectors, and the tiles' lists are merged per query by a heap.

The result is exact: the bounds never drop a neighbour.

Defined cases: vectors that are null, empty, zero, or with null or non-finite
components take no part; vectors are compared with those of their own length;
finite components of any size take part (bounds are taken in units of a tile's
largest component, and a distance whose squares leave the range of doubles is
summed in units of the largest difference); equal distances go to the smaller
id, a null id last; fewer candidates than k give all of them.  Rows are told
apart by a number of their own: each row of a repeated query id asks for itself
and gets a list of its own, and all rows but itself are its candidates, those
of its own id included.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_small
from .common import written


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as float64."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and lengths of the quantisation errors."""
    scale = np.abs(x).max(axis=1) / 127
    scale = np.where(scale > 0, scale, 1.0)      # too small to be told from zero
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))
    return q, scale, error


def _product_type(dim: int):
    return np.float32 if dim * 127 * 127 < 1 << 24 else np.float64


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed in order."""
    with np.errstate(over="ignore"):
        d = x - y
        total = np.add.accumulate(d ** 2, axis=1)[:, -1]
        out = np.sqrt(total)
        odd = np.flatnonzero(~((total > 1e-280) & (total < np.inf)))
        most = np.abs(d[odd]).max(axis=1) if len(odd) else total[:0]
        odd, most = odd[(most > 0) & (most < np.inf)], most[(most > 0) & (most < np.inf)]
        if len(odd):
            out[odd] = most * np.sqrt(np.add.accumulate((d[odd] / most[:, None]) ** 2, axis=1)[:, -1])
    return out


def tile_neighbours(qrow: np.ndarray, q: np.ndarray, crow: np.ndarray, cid: np.ndarray, c: np.ndarray,
                    k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, distance) of the k nearest of each query in a tile,
    as places in ``q`` and ``c``.  A row is no candidate of itself; ``cid``
    orders equal distances."""
    kind = _product_type(q.shape[1])
    unit = max(np.abs(q).max(), np.abs(c).max())
    a, sa, ea = quantised(q / unit)
    b, sb, eb = quantised(c / unit)
    na = sa ** 2 * (a.astype(np.float64) ** 2).sum(axis=1)
    nb = sb ** 2 * (b.astype(np.float64) ** 2).sum(axis=1)
    b = b.astype(kind).T
    out_q, out_c, out_d = [], [], []
    for lo in range(0, len(q), 256):
        hi = min(lo + 256, len(q))
        dots = (a[lo:hi].astype(kind) @ b).astype(np.float64)
        square = na[lo:hi, None] + nb[None, :] - 2 * (sa[lo:hi, None] * sb[None, :]) * dots
        near = np.sqrt(np.maximum(square, 0))
        slack = ea[lo:hi, None] + eb[None, :]
        # Rounding of the few sums above, far below the quantisation error.
        slack = slack + 1e-9 * (1 + np.sqrt(na[lo:hi, None] + nb[None, :]))
        own = qrow[lo:hi, None] == crow[None, :]
        upper = np.where(own, np.inf, near + slack)
        if len(cid) > k:
            limit = np.partition(upper, k - 1, axis=1)[:, k - 1]
        else:
            limit = np.full(hi - lo, np.inf)
        i, j = np.nonzero((near - slack <= limit[:, None]) & ~own)
        d = distances(q[lo + i], c[j])
        by = np.lexsort((cid[j], d, i))
        i, j, d = i[by], j[by], d[by]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        out_q.append(lo + i[keep])
        out_c.append(j[keep])
        out_d.append(d[keep])
    return tuple(np.concatenate(x) if x else np.zeros(0, int) for x in (out_q, out_c, out_d))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """row, id, v and dim of the rows that take part, written once, so that a
    row keeps its number."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0)).where(~bad & F.exists(v, lambda x: x != 0))
    return written(rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        v.cast("array<double>").alias("v"), F.size(v).alias("dim")), "ann-rows")


LAST = np.iinfo(np.int64).max          # stands for a null id, which comes last


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding", block: int = 4096, query_block: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (distance) of each query's k
    nearest other rows.  ``is_query`` is a condition on the column ``id``."""
    rows = usable(vectors, id_col, vector_col)
    asks = F.coalesce(is_query, F.lit(False))
    dims = rows.groupBy("dim").agg(F.count("row").alias("n"), F.sum(asks.cast("long")).alias("nq")).where("nq > 0")
    dims = dims.select("dim", F.ceil(F.col("n") / block).cast("long").alias("bc"),
                       F.ceil(F.col("nq") / query_block).cast("long").alias("bq"))
    rows = join_small(rows, dims, "dim", "inner")          # one row per length of vector

    # Tile (i, j): candidates of block i, queries of block j.
    def all_of(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def own(n):
        return F.pmod(F.xxhash64("row", F.lit("block")), F.col(n))

    candidates = rows.select("dim", "row", "id", "v", own("bc").alias("i"), all_of("bq").alias("j"))
    queries = rows.where(asks).select(*[F.col(c).alias(c) for c in ("dim", "row", "id", "v")],
                                      all_of("bc").alias("i"), own("bq").alias("j"))

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "vec_id", "null_id", "score"]
        if not q.num_rows or not c.num_rows:
            return pa.table([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64())],
                            names)
        dim = q.column("dim")[0].as_py()
        null = c.column("id").is_null().to_numpy()
        cid = c.column("id").fill_null(LAST).to_numpy()
        qid, qrow = q.column("id").to_numpy(), q.column("row").to_numpy()
        # Where a real id is the largest number, the null ones come behind it.
        place = np.lexsort((null, cid)).argsort() if null.any() else cid
        i, j, d = tile_neighbours(qrow, _matrix(q.column("v"), dim), c.column("row").to_numpy(), place,
                                  _matrix(c.column("v"), dim), k)
        return pa.table([qrow[i], qid[i], cid[j], null[j], d.astype(float)], names)

    keys = ["dim", "i", "j"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(
        tile, "query_row long, query_id long, vec_id long, null_id boolean, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by query; a heap of k holds the current one."""
        query, name, heap = None, None, []

        def flush():
            best = sorted((-d, -n, -v) for d, n, v in heap)
            return [(name, r, None if n else v, d) for r, (d, n, v) in enumerate(best, 1)]

        def rows(out):
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            cols = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                              names=["query_id", "rank", "vec_id", "score"])

        for b in batches:
            out = []
            for row, q, v, n, d in zip(*(c.to_pylist() for c in b.columns)):
                if row != query:
                    out += flush()
                    query, name, heap = row, q, []
                item = (-d, -int(n), -v)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            yield rows(out)
        yield rows(flush())

    return found.repartition("query_row").sortWithinPartitions("query_row").mapInArrow(
        merge, "query_id long, rank int, vec_id long, score double")


def nearest_sql(every: int = 100, k: int = 10) -> str:
    """DuckDB statement over ``embeddings``: all pairs, whole lists."""
    return f"""
WITH u AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
           WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id,
             CASE WHEN len(q.v) = len(c.v) THEN list_distance(q.v, c.v) END AS score
      FROM u q JOIN u c ON q.vec_id % {every} = 0 AND q.rid <> c.rid AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score, vec_id NULLS LAST) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
