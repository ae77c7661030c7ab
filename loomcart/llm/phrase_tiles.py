"""Phrase collocations by direct-address tiling.

Per language, phrases of 2 to 5 words that are frequent enough are counted
level by level:

1. Words are counted; the texts are then kept as chunks of one language, an
   array of word ids with 0 for rare words and between pieces.
2. Frequent words get ids by falling frequency, so frequent pairs crowd into
   the first tiles of the (id, id) plane.  A tile covers 1024 x 1024 ids.  The
   occurrences of a chunk that fall into a tile are counted with a dense
   ``bincount`` over its cells where they are many, else as sorted (cell,
   count) lists; tiles of all tasks are added up the same way, in two rounds
   (a tile's rows are first spread by a salt), so no task gets all of a hot
   tile.
3. Frequent pairs are ranked by frequency and take the place of the word: the
   next level counts pairs (phrase, next word).  A phrase is only looked at
   where its beginning is frequent, so nothing frequent is lost.

Ids reach the chunks by a broadcast while there are at most ``broadcast_words``
frequent words, and while the levels so far hold at most ``broadcast_keys``
pairs (16 bytes each); beyond that by a shuffle that gives each chunk the words
or pairs it contains.

Scores come from joins of the frequent phrases with themselves: the beginnings
and ends of a frequent phrase are frequent too.

Defined cases: a null text has no words; a null language is ``und``; repeated
rows count again; a language without frequent phrases has no rows; an empty
table gives an empty result; other columns of the input are not read.  A text
of any length lies in one chunk (or makes one alone).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_small
from ..operators.ranking import keyed_row_number
from .common import text_of, written

SIDE = 10                                     # a tile has 2^SIDE ids a side
CELLS = 1 << 2 * SIDE
ID_BITS = 31                                  # of a word id within a key
MARK = b"\xff"                                # between pieces; in no UTF-8 text
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", MARK * 10)


@dataclass(frozen=True)
class PhraseSettings:
    longest: int = 5
    least_count: int = 100
    top: int = 2000
    cover: int = 100               # percent of a phrase's count that a longer one needs to replace it
    chunk_bytes: int = 4_000_000   # text of a chunk
    dense_from: int = 1 << 15      # entries of a tile that are counted over all its cells
    held_bytes: int = 96_000_000   # counts that a task holds before it passes them on
    salts: int = 16
    broadcast_words: int = 300_000
    broadcast_keys: int = 2_000_000
    held_words: int = 300_000      # distinct words a task counts before it passes them on


# -- words and chunks --------------------------------------------------------

def tokens_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with a mark between pieces."""
    return text.lower().translate(_PIECES).replace(MARK, b" \xff ").split()


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"),
                       text_of(text_col).cast("binary").alias("t"))


def word_counts(texts: DataFrame, s: PhraseSettings) -> DataFrame:
    """(lang, phrase, a): the occurrences of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows():
            for lang, found in held.items():
                found.pop(MARK, None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()),
                     pa.array([w.decode("utf-8", "replace") for w in found], pa.string()),
                     pa.array(list(found.values()), pa.int64())], names=["lang", "phrase", "a"])
            held.clear()

        for b in batches:
            for i, (lang, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                held.setdefault(lang, Counter()).update(tokens_of(text.as_py()))
                if i % 64 == 0 and sum(map(len, held.values())) > s.held_words:
                    yield from rows()
        yield from rows()

    return texts.mapInArrow(run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(
        F.sum("a").alias("a"))


def _chunked(texts: DataFrame, columns: str, chunk, s: PhraseSettings) -> DataFrame:
    """Rows of ``columns`` that ``chunk`` makes of (number, lang, texts):
    texts of one language, about ``chunk_bytes`` of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def made(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            del sizes[lang]
            return chunk(number, lang, held.pop(lang))

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= s.chunk_bytes:
                    yield made(lang)
                elif sum(sizes.values()) >= 8 * s.chunk_bytes:      # many languages
                    yield made(max(sizes, key=sizes.get))
        for lang in list(held):
            yield made(lang)

    return texts.mapInArrow(run, columns)


IDS = "chunk long, lang string, ids binary"


def _row(columns: str, *values) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    fields = [c.split() for c in columns.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields)],
                                      names=[n for n, _ in fields])


def _chunks_by_broadcast(texts: DataFrame, words: DataFrame, s: PhraseSettings) -> DataFrame:
    """Rows of IDS, from a broadcast of all frequent words."""
    known: dict[str, dict[bytes, int]] = {}
    for lang, word, number in zip(*(words.select("lang", "phrase", "id").toArrow().column(c).to_pylist()
                                    for c in range(3))):
        known.setdefault(lang, {})[word.encode()] = number
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def chunk(number, lang, held):
        get = shared.value.get(lang, {}).get
        parts = []
        for text in held:
            parts.append([get(w, 0) for w in tokens_of(text)])
            parts.append([0])
        return _row(IDS, number, lang, np.concatenate([np.array(p, np.int32) for p in parts]).tobytes())

    return _chunked(texts, IDS, chunk, s)


def _chunks_by_shuffle(texts: DataFrame, words: DataFrame, s: PhraseSettings) -> DataFrame:
    """Rows of IDS: chunks over word lists of their own, each list joined with
    the frequent words."""
    columns = "chunk long, lang string, tokens binary, words array<string>"

    def chunk(number, lang, held):
        code: dict[bytes, int] = {MARK: 0}
        parts = []
        for text in held:
            parts.append([code.setdefault(w, len(code)) for w in tokens_of(text)])
            parts.append([0])
        flat = np.concatenate([np.array(p, np.int32) for p in parts])
        return _row(columns, number, lang, flat.tobytes(), [w.decode("utf-8", "replace") for w in code][1:])

    def with_ids(batches):
        for b in batches:
            for i in range(b.num_rows):
                tokens = np.frombuffer(b.column(2)[i].as_py(), np.int32)
                code, ids = (np.frombuffer(b.column(c)[i].as_py() or b"", np.int64) for c in (3, 4))
                found = np.zeros(int(tokens.max()) + 1 if len(tokens) else 1, np.int32)
                found[code] = ids
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([found[tokens].tobytes()], pa.binary())],
                    names=["chunk", "lang", "ids"])

    chunks = written(_chunked(texts, columns, chunk, s), "phrase-chunks")
    own = chunks.select("chunk", "lang", F.posexplode("words").alias("code", "phrase")).select(
        "chunk", "lang", "phrase", (F.col("code") + 1).cast("long").alias("key"))
    own = _arrays(own.join(words.select("lang", "phrase", "id"), ["lang", "phrase"]), 1)
    return chunks.join(own, "chunk", "left").select("chunk", "lang", "tokens", "key", "id").mapInArrow(with_ids, IDS)


# -- tiles -----------------------------------------------------------------

class Tiles:
    """Counts of keys, by tile: dense over a tile's cells or as sorted lists."""

    def __init__(self, s: PhraseSettings):
        self.s = s
        self.dense: dict[tuple[int, int], np.ndarray] = {}
        self.sparse: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, tile: tuple[int, int], cells: np.ndarray, counts: np.ndarray | None) -> None:
        """Count cells (once each, or ``counts`` times)."""
        if tile in self.dense or len(cells) >= self.s.dense_from:
            if tile not in self.dense:
                self.dense[tile] = np.zeros(CELLS, np.int64)
                self.size += 8 * CELLS
                for c, n in self.sparse.pop(tile, ()):
                    self.dense[tile][c] += n
                    self.size -= 12 * len(c)
            if counts is None:
                self.dense[tile] += np.bincount(cells, minlength=CELLS)
            else:
                self.dense[tile][cells] += counts          # cells of a list are distinct
            return
        if counts is None:
            cells, counts = np.unique(cells, return_counts=True)
        mine = self.sparse.setdefault(tile, [])
        mine.append((cells.astype(np.int32), counts.astype(np.int64)))
        self.size += 12 * len(cells)
        # Lists are merged when as many entries wait as a dense tile starts from.
        if len(mine) > 1 and sum(len(c) for c, _ in mine) >= self.s.dense_from:
            merged = self._merged(mine)
            self.size -= 12 * (sum(len(c) for c, _ in mine) - len(merged[0]))
            self.sparse[tile] = [merged]
            if len(merged[0]) >= self.s.dense_from:
                self.size -= 12 * len(merged[0])
                self.dense[tile] = np.zeros(CELLS, np.int64)
                self.size += 8 * CELLS
                del self.sparse[tile]
                self.dense[tile][merged[0]] = merged[1]

    @staticmethod
    def _merged(lists):
        cells, at = np.unique(np.concatenate([c for c, _ in lists]), return_inverse=True)
        total = np.zeros(len(cells), np.int64)
        np.add.at(total, at, np.concatenate([n for _, n in lists]))
        return cells, total

    def add_keys(self, keys: np.ndarray) -> None:
        """Count keys of (first id, second id)."""
        first, second = keys >> ID_BITS, keys & ((1 << ID_BITS) - 1)
        row, col = first >> SIDE, second >> SIDE
        width = int(col.max()) + 1 if len(col) else 1
        tile = row * width + col
        cell = ((first & ((1 << SIDE) - 1)) << SIDE) | (second & ((1 << SIDE) - 1))
        if len(tile) and int(tile.max()) < 1 << 16:
            tile = tile.astype(np.uint16)          # sorted by radix
        by = np.argsort(tile, kind="stable")
        tile, cell = tile[by], cell[by]
        starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]) if len(tile) else []
        for x, y in zip(starts, [*starts[1:], len(tile)]):
            at = int(tile[x])
            self.add((at // width, at % width), cell[x:y], None)

    def take(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """All counts as (row, column, cells, counts); forgets them."""
        for (r, c), counts in self.dense.items():
            cells = np.flatnonzero(counts)
            yield r, c, cells.astype(np.int32), counts[cells]
        for (r, c), lists in self.sparse.items():
            yield r, c, *(self._merged(lists) if len(lists) > 1 else lists[0])
        self.__init__(self.s)


TILES = "lang string, tile_row int, tile_col int, cells binary, counts binary"


def _tile_rows(lang: str, tiles: Tiles) -> Iterator[pa.RecordBatch]:
    for r, c, cells, counts in tiles.take():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([r], pa.int32()), pa.array([c], pa.int32()),
             pa.array([_packed(np.diff(cells, prepend=0))], pa.binary()), pa.array([_packed(counts)], pa.binary())],
            names=[x.split()[0] for x in TILES.split(", ")])


def _packed(x: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes each as the largest needs (the
    first byte tells how many)."""
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"u{b[0]}", offset=1).astype(np.int64)


def _tile_of(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of a row of TILES."""
    return np.cumsum(_unpacked(b.column(3)[i].as_py())), _unpacked(b.column(4)[i].as_py())


def phrase_ids(one: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Id of the phrase starting at each place, of as many words as there are
    ``levels`` plus one; 0 where none is frequent.  ``one`` has the word ids,
    a level its sorted keys and their ids."""
    now = one
    for k, (keys, ids) in enumerate(levels, 1):
        key = _pair_keys(one, now, k)
        out = np.zeros(len(one), np.int64)
        some = np.flatnonzero(key)
        if len(keys) and len(some):
            at = np.minimum(np.searchsorted(keys, key[some]), len(keys) - 1)
            hit = keys[at] == key[some]
            out[some[hit]] = ids[at[hit]]
        now = out
    return now


def _pair_keys(one: np.ndarray, now: np.ndarray, k: int) -> np.ndarray:
    """Key of (phrase of k words at a place, word after it); 0 where either
    has no id."""
    key = np.zeros(len(one), np.int64)
    if len(one) > k:
        a, b = now[:-k], one[k:]
        key[:-k] = np.where((a > 0) & (b > 0), (a << ID_BITS) | b, 0)
    return key


class Known:
    """Keys of the levels counted so far: ``shared`` ones by language, the
    others in column ``keys`` of a chunk's row."""

    def __init__(self, shared, levels: int):
        self.shared, self.levels = shared, levels

    def pair_keys(self, batch: pa.RecordBatch, i: int) -> np.ndarray:
        """Keys of the next level at the places of row ``i``; 0 for none."""
        one = np.frombuffer(batch.column("ids")[i].as_py(), np.int32).astype(np.int64)
        found = dict(self.shared.value.get(batch.column("lang")[i].as_py(), {}))
        if "keys" in batch.schema.names:
            for x in batch.column("keys")[i].as_py() or ():
                found[x["k"]] = tuple(np.frombuffer(x[c], np.int64) for c in ("key", "id"))
        none = (np.zeros(0, np.int64),) * 2
        levels = [found.get(k, none) for k in range(2, self.levels + 1)]
        return _pair_keys(one, phrase_ids(one, levels), self.levels)


def count_pairs(mapped: DataFrame, known: Known, s: PhraseSettings) -> DataFrame:
    """(lang, a, first, second): frequent pairs of a phrase id and a word id."""
    def local(batches):
        salt = TaskContext.get().partitionId()
        tiles: dict[str, Tiles] = {}

        def passed(lang):
            for b in _tile_rows(lang, tiles[lang]):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([salt], pa.int32())],
                                                 names=[*b.schema.names, "salt"])

        for b in batches:
            for i in range(b.num_rows):
                lang = b.column("lang")[i].as_py()
                key = known.pair_keys(b, i)
                tiles.setdefault(lang, Tiles(s)).add_keys(key[key > 0])
                if sum(t.size for t in tiles.values()) > s.held_bytes:
                    for x in tiles:
                        yield from passed(x)
        for x in tiles:
            yield from passed(x)

    def summed(batches):
        """Tiles of equal (lang, row, column) added; rows are sorted by them."""
        at, tiles = None, None
        for b in batches:
            for i in range(b.num_rows):
                lang, r, c = (b.column(k)[i].as_py() for k in range(3))
                if at != (lang, r, c):
                    if at:
                        yield from _tile_rows(at[0], tiles)
                    at, tiles = (lang, r, c), Tiles(s)
                tiles.add((r, c), *_tile_of(b, i))
        if at:
            yield from _tile_rows(at[0], tiles)

    def frequent(batches):
        for b in summed(batches):
            cells, counts = _tile_of(b, 0)
            keep = counts >= s.least_count
            cells, counts = cells[keep], counts[keep]
            if len(cells):
                r, c = b.column(1)[0].as_py(), b.column(2)[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0)[0].as_py()] * len(cells)), pa.array(counts),
                     pa.array((r << SIDE) + (cells >> SIDE)), pa.array((c << SIDE) + (cells & ((1 << SIDE) - 1)))],
                    names=["lang", "a", "first", "second"])

    where = ["lang", "tile_row", "tile_col"]
    parts = mapped.mapInArrow(local, TILES + ", salt int")
    salted = parts.withColumn("salt", F.col("salt") % s.salts).repartition(*where, "salt").sortWithinPartitions(
        *where, "salt").drop("salt").mapInArrow(summed, TILES)
    return salted.repartition(*where).sortWithinPartitions(*where).mapInArrow(
        frequent, "lang string, a long, first long, second long")


# -- levels ----------------------------------------------------------------

def _ranked(found: DataFrame, order: list) -> DataFrame:
    """``found`` with id: 1 for a language's most frequent row."""
    return keyed_row_number(found, ["lang"], [F.col("a").desc(), *order], out="id")


def _arrays(keyed: DataFrame, k: int) -> DataFrame:
    """Per chunk one row: level k's keys, sorted, and ids, as bytes of longs."""
    def run(batches):
        for b in batches:
            rows = [[], []]
            for x in b.column(1):
                pair = np.array([[y["key"], y["id"]] for y in x.as_py()], np.int64).reshape(-1, 2)
                pair = pair[np.argsort(pair[:, 0])]
                rows[0].append(pair[:, 0].tobytes())
                rows[1].append(pair[:, 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([k] * b.num_rows, pa.int32()), pa.array(rows[0], pa.binary()),
                 pa.array(rows[1], pa.binary())], names=["chunk", "k", "key", "id"])

    grouped = keyed.groupBy("chunk").agg(F.collect_list(F.struct("key", "id")).alias("x"))
    return grouped.mapInArrow(run, "chunk long, k int, key binary, id binary")


def _shared(keyed: DataFrame, k: int, before: dict) -> dict:
    """Level k's sorted keys and ids by language, added to ``before``."""
    t = keyed.select("lang", "key", "id").toArrow()
    lang = t.column("lang").combine_chunks().dictionary_encode()
    code, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
    key, ids = (t.column(c).to_numpy() for c in ("key", "id"))
    out = {x: dict(y) for x, y in before.items()}
    for n, name in enumerate(names):
        mine = code == n
        by = np.argsort(key[mine])
        out.setdefault(name, {})[k] = (key[mine][by], ids[mine][by])
    return out


def _keys_of_chunks(mapped: DataFrame, known: Known) -> DataFrame:
    """(chunk, lang, key): the distinct pair keys of each chunk."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                key = np.unique(known.pair_keys(b, i))
                key = key[key > 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), b.column("chunk")[i].as_py(), np.int64)),
                     pa.array([b.column("lang")[i].as_py()] * len(key), pa.string()), pa.array(key)],
                    names=["chunk", "lang", "key"])

    return mapped.mapInArrow(run, "chunk long, lang string, key long")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                     settings: PhraseSettings = PhraseSettings()) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, a) of all frequent phrases of 1 to ``longest`` words,
    and (lang, n), the words of each language."""
    s = settings
    texts = _texts(docs, text_col, lang_col)
    words = written(word_counts(texts, s), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    found = written(_ranked(words.where(F.col("a") >= s.least_count), [F.col("phrase")]), "phrase-level")
    singles, out = found.select("lang", F.col("id").alias("second"), F.col("phrase").alias("word")), [found]
    made = _chunks_by_broadcast if found.count() <= s.broadcast_words else _chunks_by_shuffle
    chunks = written(made(texts, found, s), "phrase-tokens")
    sc, here, held, apart = docs.sparkSession.sparkContext, {}, 0, None
    for k in range(2, s.longest + 1):
        known, mapped = Known(sc.broadcast(here), k - 1), chunks
        if apart is not None:
            mapped = chunks.join(apart.groupBy("chunk").agg(
                F.collect_list(F.struct("k", "key", "id")).alias("keys")), "chunk", "left")
        pairs = written(count_pairs(mapped, known, s), "phrase-pairs")
        more = pairs.count()
        if not more:
            break
        ranked = written(_ranked(pairs, [F.col("first"), F.col("second")]), "phrase-ids")
        found = written(
            ranked.join(found.select("lang", F.col("id").alias("first"), "phrase"), ["lang", "first"])
            .join(singles, ["lang", "second"])
            .select("lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "a", "id"), "phrase-level")
        out.append(found)
        if k == s.longest:
            break
        keyed = ranked.select("lang", (F.shiftleft("first", ID_BITS) + F.col("second")).alias("key"), "id")
        held += more
        if held <= s.broadcast_keys:
            here = _shared(keyed, k, here)
        else:
            mine = _keys_of_chunks(mapped, known).join(keyed, ["lang", "key"]).select("chunk", "key", "id")
            mine = written(_arrays(mine, k), "phrase-keys")
            apart = mine if apart is None else apart.unionByName(mine)
    every = out[0].select("lang", F.lit(1).alias("k"), "phrase", "a")
    for k, level in enumerate(out[1:], 2):
        every = every.unionByName(level.select("lang", F.lit(k).alias("k"), "phrase", "a"))
    return every, totals


# -- scores ----------------------------------------------------------------

def _words(phrase: str, n):
    """The first ``n`` words of a phrase, or the last if ``n`` is negative."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), n)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                 settings: PhraseSettings = PhraseSettings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    s = settings
    every, totals = frequent_phrases(docs, text_col, lang_col, s)
    candidates = every.where(F.col("k") >= 2)
    # A longer candidate around a phrase has one of one more word in between,
    # which is at least as frequent; so these decide.
    around = candidates.where(F.col("k") >= 3).select(
        "lang", F.col("a").alias("around"), F.explode(F.array(
            _words("phrase", F.col("k") - 1),
            _words("phrase", 1 - F.col("k")))).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = candidates.join(around, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (100 * F.col("around") < s.cover * F.col("a")))
    cuts = kept.select("lang", "k", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _words("phrase", F.col("cut")).alias("left"),
                       _words("phrase", F.col("cut") - F.col("k")).alias("right"))
    known = every.select("lang", "phrase", "a")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])

    def wide(c):
        return F.col(c).cast("decimal(19,0)")

    # 38 digits hold 1000 * a * n up to 10^17 words.
    up = (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(17,0)")).cast("decimal(20,0)") \
        * F.col("n").cast("decimal(17,0)")
    scored = join_small(cuts, totals, "lang").withColumn("up", up.cast("decimal(38,0)")).withColumn(
        "down", (wide("l") * wide("r")).cast("decimal(38,0)")).withColumn("score", F.expr("up div down"))
    least = scored.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    best = least.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    ranked = keyed_row_number(best, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], out="rank")
    return ranked.where(F.col("rank") <= s.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(settings: PhraseSettings = PhraseSettings()) -> str:
    """DuckDB statement for :func:`collocations` over ``documents``."""
    s = settings
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2),
         lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
      FROM w, range(1, {s.longest + 1}) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {s.least_count}),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
kept AS (SELECT * FROM f c WHERE k >= 2 AND NOT EXISTS (
  SELECT 1 FROM f o WHERE o.lang = c.lang AND o.k > c.k AND 100 * o.a >= {s.cover} * c.a
    AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cut AS (SELECT kept.*, j, string_split(phrase, ' ') AS z FROM kept, range(1, {s.longest}) AS t(j) WHERE j < k),
scored AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n.n,
    (1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS score, j
  FROM cut c JOIN n USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(z, 1, j), ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(z, j + 1, c.k), ' ')),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= {s.top}"""
