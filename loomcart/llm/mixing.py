"""Mixing sources to target weights by a low-discrepancy schedule (built-in
functions only).

Every document's words form a stretch of its source's stream, whose order is a
fixed shuffle (a hash of the id).  Streams are cut into blocks of equally many
words.  The schedule is a sequence of slots; slot i lies at the golden-ratio
point frac((i + 1/2) * phi) of the interval [0, 1), which the sources share by
their targets, so every stretch of the schedule holds each source close to its
share.  A source's slots, ranked in schedule order, take its blocks in order,
again from the first block once all are used; slots past the target are left
out, and a source whose last slots fall behind the end of the schedule gets
them appended (they are numbered on from the schedule's end, those of several
sources side by side).

A document's row tells the first slot that takes words of it, the number of
its slots and the sum of their numbers; mixed documents are laid out by slot.

Hot sources: positions in a stream and ranks of slots are prefix sums in two
levels (many buckets per source, then a sum over buckets), so no window holds
a whole source.

Assumed bound: the sources themselves, one row each, pass through windows in a
single task (targets and schedule), so they are taken to be few, up to about a
million.  With more the result stays whole, but that task grows with them.

Defined cases: a null or empty text has size 0 and takes nothing; null sources
form one source, last in order; rows that agree in id and size are
interchangeable; an empty table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, text_of, written

# 2^31 divided by the golden ratio, odd: slot points are multiples modulo 2^31
# (products stay below 2^63).
GOLDEN = 1327217885
PERIOD = 2147483648


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[int, ...] = (5, 2, 1)      # by source order, repeating
    max_repeats: int = 3                      # a target is at most so many times the size
    block_words: int = 256
    bucket_digits: int = 3                    # hex digits: 4096 buckets a source bound a window
    schedule_chunk: int = 4096                # slots ranked together
    task_chunks: int = 16                     # such chunks a task makes
    grid: int = 1024                          # cells that find a point's source


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """doc_id, src, size, and a row number, of each document."""
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"),
                       F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
                       row.alias("row"))


def targets_of(sizes: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """One row per source: src, ord, source_size, weight, target.

    Capping sources in order of cap per weight is enough: once a source is
    below its cap at the common level, all later ones are."""
    s = settings
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    # One row per source from here on.
    by_source = Window.orderBy(F.col("src").isNull(), "src")
    per = per.withColumn("ord", F.row_number().over(by_source) - 1)
    per = per.withColumn("weight", F.element_at(
        F.array(*[F.lit(w) for w in s.weights]), (F.col("ord") % len(s.weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * s.max_repeats).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "ord")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(whole).cast("double")
                                   - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                         / F.sum("weight").over(rest))
    per = per.withColumn("open", (F.col("weight") * F.col("level") < F.col("cap")).cast("int"))
    # The level at the first source that stays below its cap holds for it and all after it.
    per = per.withColumn("level", F.min(F.when(F.col("open") == 1, F.struct(
        (F.col("cap") / F.col("weight")).alias("c"), "ord", F.col("level").alias("l")))).over(whole)["l"])
    return per.select("src", "ord", "source_size", "weight", F.coalesce(
        F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def _needs(per: DataFrame, settings: MixSettings) -> DataFrame:
    """Per source with words: want (whole words), blocks of its stream, slots
    that take them."""
    size = F.col("source_size")
    want = F.floor(F.col("target") + 0.5).cast("long")
    blocks = F.ceil(size / settings.block_words).cast("long")
    slots = F.floor(want / size) * blocks + F.ceil(F.pmod(want, size) / settings.block_words)
    return per.where(size > 0).select("ord", "source_size", "target", want.alias("want"),
                                      blocks.alias("blocks"), slots.cast("long").alias("slots"))


def _schedule(needs: DataFrame, settings: MixSettings) -> DataFrame:
    """The schedule's slots: i, rank (from 0) among its source's slots, and
    the source's row of ``needs``."""
    s = settings
    upto = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    edges = needs.withColumn("high", F.sum("target").over(upto) / total)
    edges = edges.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("ord")), F.lit(0.0)))
    edges = edges.withColumn("high", F.when(
        F.lead("ord").over(Window.orderBy("ord")).isNull(), 2.0).otherwise(F.col("high")))
    # Stretches are found through a grid of equal cells: an equi-join.
    top = F.lit(s.grid - 1)
    cells = edges.withColumn("cell", F.explode(F.sequence(
        F.least(top, F.floor(F.col("low") * s.grid).cast("int")),
        F.least(top, F.floor(F.col("high") * s.grid).cast("int")))))
    n = needs.agg(F.ceil(F.sum("target") / s.block_words).cast("long")).first()[0] or 0
    # A range tells the planner its size: slots, which grow with the table, are
    # never taken for a side that can be broadcast.
    slots = needs.sparkSession.range(0, n, 1, n // (s.schedule_chunk * s.task_chunks) + 1).select(
        F.floor(F.col("id") / s.schedule_chunk).alias("chunk"), F.col("id").alias("i"))
    point = F.pmod(F.pmod(F.col("i"), F.lit(PERIOD)) * GOLDEN + GOLDEN // 2, F.lit(PERIOD)) / float(PERIOD)
    slots = slots.select("chunk", "i", point.alias("x"),
                         F.floor(point * s.grid).cast("int").alias("cell"))
    slots = slots.join(cells, "cell").where((F.col("x") >= F.col("low")) & (F.col("x") < F.col("high")))
    slots = slots.drop("cell", "low", "high", "x")
    counts = slots.groupBy("chunk", "ord").agg(F.count("i").alias("m"))
    before = Window.partitionBy("ord").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("chunk", "ord", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("chunk", "ord").orderBy("i")))
    # Rows of slots and chunks grow with the table: no broadcast, however well
    # they compress.
    return ranked.join(counts.hint("merge"), ["chunk", "ord"]).withColumn(
        "rank", F.col("start") + F.col("r") - 1).drop("start", "r", "chunk")


def slot_table(per: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """Which block of which source each slot takes: ord, i, rank, block, words
    (up to the target), full (words of the block)."""
    s = settings
    needs = _needs(per, s)
    kept = _schedule(needs, s).where(F.col("rank") < F.col("slots"))
    kept = kept.select("ord", "i", "rank", "source_size", "want", "blocks")
    have = kept.groupBy("ord").agg(F.count("rank").alias("have"))
    some = F.coalesce("have", F.lit(0).cast("long"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    late = needs.withColumn("n", F.ceil(F.sum("target").over(every) / s.block_words).cast("long"))
    late = late.join(have, "ord", "left").where(some < F.col("slots")).select(
        "ord", some.alias("have"), "n", F.explode(F.sequence(some, F.col("slots") - 1)).alias("rank"),
        "source_size", "want", "blocks")
    late = late.select("ord", (F.col("n") + F.col("rank") - F.col("have")).alias("i"), "rank", "source_size",
                       "want", "blocks")
    block = F.pmod("rank", F.col("blocks"))
    start = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") + block * s.block_words
    full = F.least(F.lit(s.block_words).cast("long"), F.col("source_size") - block * s.block_words)
    return kept.unionByName(late).select(
        "ord", "i", "rank", block.alias("block"),
        F.least(full, F.col("want") - start).alias("words"), full.alias("full"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", settings: MixSettings = MixSettings(),
        row_col: str | None = None) -> DataFrame:
    """One row per document: ``id_col``, size, source_size, target (of its
    source), taken (words the mix takes from it, repeats counted), first_slot,
    n_slots and slot_sum (of the slots that take words of it).  If ``row_col``
    is given (a column that tells the rows apart), it and ``slots`` (those that
    take its first words, in order) follow."""
    s = settings
    sizes = written(sizes_of(docs, id_col, text_col, source_col, row_col), "mix-sizes")
    per = written(targets_of(sizes, s), "mix-targets")

    # Blocks and the slots that take each.
    whole = F.col("words") >= F.col("full")
    uses = slot_table(per, s).groupBy("ord", "block").agg(
        F.sum(whole.cast("long")).alias("whole"), F.max(F.when(~whole, F.col("words"))).alias("part"),
        F.min(F.when(whole, F.col("i"))).alias("first"), F.sum(F.when(whole, F.col("i"))).alias("sum"),
        F.max(F.when(~whole, F.col("i"))).alias("part_i"),
        F.sort_array(F.collect_list("i")).alias("slots"))          # a pass over the source each

    # Places of the documents in their source's stream.
    stream = sizes.join(per.select(F.col("src").alias("s2"), "ord", "source_size", "target"),
                        F.col("src").eqNullSafe(F.col("s2")))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    stream = stream.select("doc_id", "row", "size", "source_size", "target", "ord", key.alias("h"),
                           F.substring(key, 1, s.bucket_digits).alias("b"))
    sums = stream.groupBy("ord", "b").agg(F.sum("size").alias("m"))
    before = Window.partitionBy("ord").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("ord", "b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("ord", "b").orderBy("h", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    placed = (stream.withColumn("upto", F.sum("size").over(inner))
              .join(sums, ["ord", "b"])
              .withColumn("at", F.col("base") + F.col("upto") - F.col("size")))
    placed = written(placed.select("doc_id", "row", "size", "source_size", "target", "ord", "at"), "mix-placed")
    first, last = F.floor(F.col("at") / s.block_words), F.floor((F.col("at") + F.col("size") - 1) / s.block_words)
    pieces = placed.where(F.col("size") > 0).select(
        "row", "ord", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("at"), F.col("block") * s.block_words)
    hi = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * s.block_words)
    pieces = pieces.select("row", "ord", "block", (lo - F.col("block") * s.block_words).alias("lo"),
                           (hi - F.col("block") * s.block_words).alias("hi"))
    part = F.when(F.col("part").isNotNull(), F.greatest(
        F.lit(0).cast("long"), F.least(F.col("hi"), F.col("part")) - F.col("lo")))
    some = F.coalesce(F.col("part") > F.col("lo"), F.lit(False))       # the part's slot takes some of it
    zero = F.lit(0).cast("long")
    got = pieces.join(uses.hint("merge"), ["ord", "block"]).groupBy("row").agg(
        F.sum(F.col("whole") * (F.col("hi") - F.col("lo")) + F.coalesce(part, zero)).alias("taken"),
        F.min(F.least("first", F.when(some, F.col("part_i")))).alias("first_slot"),
        F.sum(F.col("whole") + some.cast("long")).alias("n_slots"),
        F.sum(F.coalesce("sum", zero) + F.when(some, F.col("part_i")).otherwise(zero)).alias("slot_sum"),
        *([F.min_by("slots", "block").alias("slots")] if row_col else []))
    return placed.join(got.hint("merge"), "row", "left").select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target",
        *[F.coalesce(c, zero).alias(c) if c != "first_slot" else F.col(c)
          for c in ("taken", "first_slot", "n_slots", "slot_sum")],
        *([F.col("row").alias(row_col), "slots"] if row_col else []))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", settings: MixSettings = MixSettings()) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (words taken
    over size, rounded half up; rows of size 0 once), laid out by slot: a
    partition is a stretch of the schedule, so it holds the sources by their
    shares.  A copy lies at the slot of its pass over the source; rows of size
    0 have no slot and come first.  The column names ``__row``, ``__copy`` and
    ``__slot`` are taken."""
    names = docs.columns
    base = numbered(docs, "mix-rows", "__row")
    # Ids may repeat; the order within a source stays that of the ids.
    taken = mix(base.select(F.col(id_col).alias("id"), "__row", F.col(text_col).alias("t"),
                            F.col(source_col).alias("s")), "id", "t", "s", settings, row_col="__row")
    times = F.when(F.col("size") == 0, 1).otherwise(
        F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2)).cast("int"))
    repeats = taken.select("__row", "slots", times.alias("times")).where(F.col("times") > 0)
    copies = repeats.select("__row", "slots", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("__copy"))
    slot = F.coalesce(F.get("slots", F.col("__copy") - 1), F.get("slots", F.size("slots") - 1))
    copies = copies.select("__row", "__copy", slot.alias("__slot"))
    by = [F.col("__slot"), F.xxhash64("__row", "__copy")]        # rows without a slot are spread too
    return base.join(copies, "__row").repartitionByRange(*by).sortWithinPartitions(*by).select(*names)


def mix_sql(settings: MixSettings = MixSettings()) -> str:
    """DuckDB statement for :func:`mix` over ``documents``: the golden points,
    each source's slots ranked by them, and the stretch of its stream that each
    takes."""
    s = settings
    fill = "ORDER BY cap / weight, ord"
    return f"""
WITH d AS (SELECT doc_id, source AS src,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
           FROM documents),
p AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
o AS (SELECT *, row_number() OVER (ORDER BY src IS NULL, src) - 1 AS ord FROM p),
c AS (SELECT *, CAST(list_extract({list(s.weights)}, CAST(ord % {len(s.weights)} + 1 AS INTEGER)) AS DOUBLE) AS weight,
             CAST(source_size * {s.max_repeats} AS DOUBLE) AS cap FROM o),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER ({fill}
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER ({fill} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM c),
t AS (SELECT src, ord, source_size, coalesce(least(cap, weight * (
               SELECT lev FROM l WHERE weight * lev < cap {fill} LIMIT 1)), cap) AS target FROM l),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS want,
             CAST(ceil(source_size / {s.block_words}) AS BIGINT) AS blocks FROM t WHERE source_size > 0),
g AS (SELECT *, (want // source_size) * blocks + CAST(ceil((want % source_size) / {s.block_words}) AS BIGINT) AS slots,
             sum(target) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) / sum(target) OVER () AS high,
             CAST(ceil(sum(target) OVER () / {s.block_words}) AS BIGINT) AS n FROM q),
e AS (SELECT *, coalesce(lag(high) OVER (ORDER BY ord), 0.0) AS low,
             CASE WHEN lead(ord) OVER (ORDER BY ord) IS NULL THEN 2.0 ELSE high END AS top FROM g),
i AS (SELECT i, ((i % {PERIOD}) * {GOLDEN} + {GOLDEN // 2}) % {PERIOD} / {float(PERIOD)} AS x
      FROM range((SELECT coalesce(max(n), 0) FROM g)) AS r(i)),
k AS (SELECT ord, i, row_number() OVER (PARTITION BY ord ORDER BY i) - 1 AS rank FROM i JOIN e ON x >= low AND x < top),
h AS (SELECT g.ord, count(k.i) AS have FROM g LEFT JOIN k USING (ord) GROUP BY g.ord),
s AS (SELECT ord, i, rank FROM k JOIN g USING (ord) WHERE rank < slots
      UNION ALL SELECT ord, n + rank - have, rank
      FROM (SELECT ord, n, have, unnest(range(have, slots)) AS rank FROM g JOIN h USING (ord) WHERE have < slots)),
b AS (SELECT s.ord, s.i, (rank % blocks) * {s.block_words} AS lo, least((rank % blocks + 1) * {s.block_words},
             source_size, want - (rank // blocks) * source_size) AS hi FROM s JOIN g USING (ord)),
a AS (SELECT row_number() OVER () AS rid, doc_id, size, source_size, target, ord,
             CAST(coalesce(sum(size) OVER (PARTITION BY ord ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')),
               doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
      FROM d JOIN t ON d.src IS NOT DISTINCT FROM t.src)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size,
       any_value(target) AS target,
       CAST(coalesce(sum(CASE WHEN i IS NOT NULL THEN least(hi, pos + size) - greatest(lo, pos) END), 0) AS BIGINT) AS taken,
       min(i) AS first_slot, count(i) AS n_slots, CAST(coalesce(sum(i), 0) AS BIGINT) AS slot_sum
FROM a LEFT JOIN b ON a.ord = b.ord AND b.lo < a.pos + a.size AND a.pos < b.hi GROUP BY rid"""
