"""Spelling variants by a relational trie frontier.

Words at one edit (one code point inserted, deleted or replaced) are neighbours.
A word's form is its most frequent neighbour if that is several times as
frequent; following forms leads to its root.

An edit lies in the second half of the longer word or in the second half of its
reversal, so there are two tries, of the words and of the reversed words, both
parted by word length, and a walk starts at the node of a word's own first
half.  Hence no walk crosses the crowded top of a trie.

- Edge table: (node, label, child), labels being the characters between two
  branchings.  It is made from the sorted words, range-partitioned, with a
  stack as long as one word; a branching seen by one partition only gives two
  edges of one first character, which a walk follows both (pairs found twice
  are dropped at the end).
- Frontier: states (word, position, node, edits), joined with the edge table
  level by level.  A state without edits goes on along an equal label, or
  spends its edit inside the label; a state with an edit needs equal labels.
  A word walks the trie of its own length to replace a character by a smaller
  one, and the trie of the next shorter length to delete one; the other
  directions follow by symmetry.
- States that end a word with one edit are neighbours.

Nodes are 64-bit hashes of prefixes; found pairs are verified on the words, so
an accidental equality adds nothing.  Every level is a written table.

Defined cases: a null text has no words; a null id counts as empty text in the
checksum; repeated rows count again; equal counts among near words go to the
smallest word in code-point order; a word without near words has n_near 0, no
form and itself as root; empty tables give empty results; other columns are
not read.  Words of any length take part; a walk takes as many levels as the
longest word's second half has branchings.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

LETTERS = "a-zÀ-ÿ"
MULTIPLIER = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


@dataclass(frozen=True)
class VariantSettings:
    least_length: int = 6
    least_count: int = 5
    ratio: int = 5                 # a form is at least so many times as frequent
    slip: int = 199                # one run in so many loses a character (0: none)
    held_words: int = 100_000      # distinct words a task counts before it passes them on


def counts_of(texts: list[tuple[str, bytes]], acc: Counter, s: VariantSettings, run: re.Pattern) -> None:
    """Add the words of (id, text) pairs to ``acc``.  Shorter runs cannot
    become long enough and are passed over."""
    for key, text in texts:
        start = zlib.crc32(f"{key}:".encode())
        for w, n in Counter(run.findall(text.lower().decode("utf-8", "replace"))).items():
            if s.slip:
                h = zlib.crc32(w.encode(), start)
                if not h % s.slip:
                    at = h % len(w)
                    w = w[:at] + w[at + 1:]
                    if len(w) < s.least_length:
                        continue
            acc[w] += n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                settings: VariantSettings = VariantSettings()) -> DataFrame:
    """word and n of all words long and frequent enough."""
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(acc), pa.string()), pa.array(list(acc.values()), pa.int64())], names=["word", "n"])

        runs, acc = re.compile(f"[{LETTERS}]{{{s.least_length},}}"), Counter()
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                part = b.slice(lo, 100)
                counts_of(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist())), acc, s, runs)
                if len(acc) > s.held_words:
                    yield rows()
                    acc.clear()
        yield rows()

    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                      text_of(text_col).cast("binary").alias("t"))
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= s.least_count)


def _mixed(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def node_ids(text: str, backward: bool, length: int, depths: list[int]) -> list[int]:
    """Ids (signed 64 bits) of the nodes of the prefixes of ``text`` that have
    the given depths, in the trie of words of ``length`` letters."""
    h, out, at = 0, [], 0
    salt = _mixed(2 * length + backward + 1)
    for depth in depths:
        for c in text[at:depth]:
            h = (h * MULTIPLIER + ord(c) + 1) & MASK
        at = depth
        x = _mixed(_mixed(h) ^ salt)
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def common_length(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n                               # a[:lo] equal, a[:hi] not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def radix_edges(rows: Iterator[tuple[bool, str, int]]) -> Iterator[tuple]:
    """Edges (node, label, child, word, n) of the second halves of sorted
    (backward, text, n) rows of one length after the other; word and n are set
    where the child is a whole word."""
    last, path = None, []                       # path: depths of the open branchings

    def close(cut: int) -> Iterator[tuple]:
        """Edges below depth ``cut``; ``cut`` becomes the path's last depth."""
        depths = [d for d in path if d > cut]
        if not depths:
            return
        top = path[:len(path) - len(depths)]
        del path[len(top):]
        if not top or top[-1] != cut:
            path.append(cut)
        depths = [path[-1], *depths]
        backward, text, n = last
        ids = node_ids(text, backward, len(text), depths)
        for a, b, x, y in zip(depths, depths[1:], ids, ids[1:]):
            end = b == len(text)
            yield (x, text[a:b], y, (text[::-1] if backward else text) if end else None, n if end else None)

    for row in rows:
        backward, text, n = row
        half = len(text) // 2
        same = last is not None and last[0] == backward and len(last[1]) == len(text)
        shared = common_length(last[1], text) if same else 0
        if last is not None:
            yield from close(shared if same and shared >= half else len(last[1]) // 2)
        if not (same and shared >= half):
            path[:] = [half]
        path.append(len(text))
        last = row
    if last is not None:
        yield from close(len(last[1]) // 2)


EDGES = "node long, label string, child long, near string, near_n long"


def edge_table(words: DataFrame) -> DataFrame:
    """Edges of both tries, by direction and length."""
    both = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("backward"))
    both = both.select("backward", F.length("word").alias("size"),
                       F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word")).alias("t"), "n")
    ordered = both.repartitionByRange("backward", "size", "t").sortWithinPartitions("backward", "size", "t")

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())

        out = []
        for edge in radix_edges(rows()):
            out.append(edge)
            if len(out) == 20_000:
                yield _batch(out, EDGES)
                out = []
        if out:
            yield _batch(out, EDGES)

    return ordered.mapInArrow(run, EDGES)


def _batch(rows: list[tuple], columns: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [c.split() for c in columns.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(col, kinds[kind]) for col, (_, kind) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


STATES = "node long, t string, n long, backward boolean, shorter boolean, pos int, edits int"


def first_states(words: DataFrame, s: VariantSettings) -> DataFrame:
    """Each word at the nodes of its first half, in the tries of its own
    length and of the next shorter one."""
    def run(batches):
        for b in batches:
            out = []
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for backward in (False, True):
                    t = word[::-1] if backward else word
                    for shorter in (False, True):
                        length = len(t) - shorter
                        if length >= s.least_length:
                            half = length // 2
                            node = node_ids(t, backward, length, [half])[0]
                            out.append((node, t, n, backward, shorter, half, 0))
            if out:
                yield _batch(out, STATES)

    return words.select("word", "n").mapInArrow(run, STATES)


def step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States after one more edge, with the edge's near word where it ends."""
    t, pos, label = F.col("t"), F.col("pos"), F.col("label")
    m = F.length(label)
    same = F.substring(t, pos + 1, m)
    longer = F.substring(t, pos + 1, m + 1)
    none, equal = F.col("edits") == 0, same == label
    replaced = none & ~F.col("shorter") & (F.length(same) == m) & (same > label) \
        & (F.levenshtein(same, label, 1) == 1)
    deleted = none & F.col("shorter") & (F.length(longer) == m + 1) & (F.levenshtein(longer, label, 1) == 1)
    moves = F.array_compact(F.array(
        F.when(equal, F.struct((pos + m).alias("pos"), F.col("edits").alias("edits"))),
        F.when(replaced, F.struct((pos + m).alias("pos"), F.lit(1).alias("edits"))),
        F.when(deleted, F.struct((pos + m + 1).alias("pos"), F.lit(1).alias("edits")))))
    moved = states.join(edges, "node").where(equal | replaced | deleted)
    moved = moved.select("child", "t", "n", "backward", "shorter", "near", "near_n", F.explode(moves).alias("e"))
    ended = F.col("near").isNotNull()
    return moved.select(F.col("child").alias("node"), "t", "n", "backward", "shorter", "e.pos", "e.edits", "near",
                        "near_n").where(~ended | ((F.col("edits") == 1) & (F.col("pos") == F.length("t"))))


def near_pairs(words: DataFrame, settings: VariantSettings = VariantSettings()) -> DataFrame:
    """(word, n, near, near_n): each pair of words one edit apart once, from
    the longer or else the greater word."""
    edges = written(edge_table(words), "trie-edges")
    live, found = first_states(words, settings), None
    while True:
        moved = written(step(live, edges), "trie-frontier")
        word = F.when(F.col("backward"), F.reverse("t")).otherwise(F.col("t"))
        hits = moved.where(F.col("near").isNotNull()).select(word.alias("word"), "n", "near", "near_n")
        found = hits if found is None else found.unionByName(hits)
        live = moved.where(F.col("near").isNull()).drop("near", "near_n")
        if live.isEmpty():
            break
    return found.where(F.levenshtein("word", "near", 1) == 1).distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, by pointer doubling; forms grow
    in frequency, so there are no cycles."""
    now = written(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "trie-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = written(now.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "trie-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             settings: VariantSettings = VariantSettings()) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = written(word_counts(docs, id_col, text_col, settings), "trie-words")
    pairs = near_pairs(words, settings).select(F.explode(F.array(
        F.struct("word", "n", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"),
                 F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p")).select("p.*")
    best = pairs.groupBy("word").agg(F.count("near").alias("n_near"), F.min(
        F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("b"))
    forms = words.join(best, "word", "left")
    fits = -F.col("b.less") >= F.col("n") * settings.ratio
    forms = written(forms.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("b.near")).alias("form"), F.when(fits, -F.col("b.less")).alias("form_n")), "trie-forms")
    return forms.join(roots_of(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_sql(settings: VariantSettings = VariantSettings()) -> str:
    """DuckDB statement for :func:`variants` over ``documents``: crc32 byte by
    byte, neighbours through their shared deletions."""
    s = settings
    table = []                                   # of crc32, by its rule
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[{LETTERS}]+')) AS run
  FROM documents),
g AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k, run, length(run) AS z, count(*) AS m
      FROM r WHERE length(run) >= {s.least_length} GROUP BY ALL),
b AS (SELECT run, z, m, hex(encode(k)) AS x FROM g),
h AS (SELECT run, z, m, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
        list_transform(range(CAST(len(x) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
        lambda a, c: xor(a >> 8, list_extract({table}::BIGINT[], CAST((xor(a, c) & 255) + 1 AS BIGINT)))),
        CAST(4294967295 AS BIGINT)) AS h FROM b),
o AS (SELECT CASE WHEN h % {s.slip} = 0 THEN substr(run, 1, h % z) || substr(run, h % z + 2) ELSE run END AS word,
             m FROM h),
w AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM o WHERE length(word) >= {s.least_length}
      GROUP BY word HAVING sum(m) >= {s.least_count}),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut
      FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i
        AND a.word <> b.word
      UNION SELECT a.word, a.n, b.word, b.n FROM d a JOIN w b ON a.cut = b.word
      UNION SELECT b.word, b.n, a.word, a.n FROM d a JOIN w b ON a.cut = b.word),
q AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-bn, b)) AS b, max(bn) AS bn FROM p GROUP BY a),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= {s.ratio} * n THEN b END AS form,
             CASE WHEN bn >= {s.ratio} * n THEN bn END AS form_n FROM w LEFT JOIN q USING (word)),
t AS (SELECT word, word AS at FROM f UNION ALL
      SELECT t.word, f.form FROM t JOIN f ON f.word = t.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN t ON t.word = f.word JOIN f e ON e.word = t.at AND e.form IS NULL"""
