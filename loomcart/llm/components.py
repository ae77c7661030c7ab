"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# A vertex of more edges than this, and than one in MOST_HUBS of all, is a hub;
# so there are at most 2 * MOST_HUBS hubs, whatever the number of edges.
HUB = 256
MOST_HUBS = 10_000


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b): root is the smallest
    vertex of its component.

    Each round links every vertex's larger neighbours, then its smaller ones,
    to the smallest of them; rounds are logarithmic in the component size.
    Minima are partial aggregates; edges are joined back on the vertex, those
    of hubs by a broadcast of the hubs' minima (at most 2 * MOST_HUBS rows), so
    no neighbourhood is gathered or read by one task.  Every round's edges are
    a written table; two numbers per round reach the driver.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
        hub = max(HUB, now.count() // MOST_HUBS)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, F.col("b") > F.col("a"), hub).select(
            F.col("b").alias("a"), F.least("m", "a").alias("b")).where(F.col("a") != F.col("b"))
        # Every edge now points from a to a smaller b.
        large = written(large.distinct(), "edges")
        small = _with_least(large, F.lit(True), hub).select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct()
        now = written(small, "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _with_least(edges: DataFrame, wanted, hub: int) -> DataFrame:
    """The ``wanted`` edges (a, b) with m, the smallest b of all edges of a."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("b").alias("n"))
    hubs = F.broadcast(low.where(F.col("n") > hub).select("a", "m"))
    some = edges.where(wanted)
    return some.join(hubs, "a").unionByName(
        some.join(hubs.select("a"), "a", "left_anti").join(low.where(F.col("n") <= hub).select("a", "m"), "a"))


def _settled(edges: DataFrame) -> bool:
    """True if every vertex with an edge to a smaller one has just one, to a
    vertex that has none: stars, which are the components."""
    roles = edges.select(F.col("a").alias("v"), "b").unionByName(
        edges.select(F.col("b").alias("v"), F.lit(None).cast(edges.schema["b"].dataType).alias("b")))
    mixed = roles.groupBy("v").agg(F.min("b").alias("lo"), F.max("b").alias("hi"),
                                   F.count_if(F.col("b").isNull()).alias("n"))
    return mixed.where(F.col("lo").isNotNull() & ((F.col("lo") != F.col("hi")) | (F.col("n") > 0))).isEmpty()
