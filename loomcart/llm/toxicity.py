"""Toxicity by compression distance.

Two zstandard raw-content dictionaries are trained from labelled texts: one
holds the most frequent words of ordinary texts, the other the same words and
the words, word beginnings and phrases that are more frequent in toxic texts.
A window is one word, written as a ladder of its beginnings
(``mo|mor|moro|moron|moron/``), or a phrase of two or three neighbouring
words, written as a ladder from its second word on, so that a match of some
letters of a long entry already pays.  A phrase is compressed where its first
word begins a learned phrase; elsewhere it shares no step with one.

A text's distance is the sum of its ``best`` largest savings (bytes by which
the toxic dictionary shortens a window, different windows only), over the
logarithm of its number of words: several weak windows add up.  How much a
segment must stand out to enter the toxic dictionary (``bounds_of``, from
strict to weak), and the threshold from which a text is toxic, are those of
the best F1 on labelled texts kept out of the dictionaries.

Bounds: at most ``max_labelled`` labelled texts (those with the smallest
hashed ids) are learned from, and each dictionary holds at most
``dictionary_bytes``.  Scoring reads every whole text.

Defined cases: a text that is null, empty or without letters has distance 0;
without any toxic label, or without a segment that stands out, every score is 0;
rows with a null label or a null id teach nothing; of rows that repeat an id
the largest text teaches.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices, written


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    threshold: float       # distance of a text
    level: int = 12
    phrases: tuple[str, ...] = ()     # phrases that the toxic dictionary holds
    best: int = 10                    # windows that count


@dataclass(frozen=True)
class ToxicityTraining:
    max_labelled: int = 20_000
    dictionary_bytes: int = 32_768
    least_share: float = 0.7          # of a segment's texts that are toxic
    significance: float = 3.0         # log-likelihood ratio above log(segments seen)
    beginnings: tuple[int, ...] = (4, 5, 6, 7, 8, 9)
    weaker: tuple[tuple[float, float], ...] = ((0.4, 8.0), (0.3, 5.0))    # shares and ratios also tried
    phrase_words: tuple[int, ...] = (2, 3)
    count_entries: int = 200_000      # segments a task counts before it passes them on


def words_of_texts(texts: pa.Array) -> pa.ListArray:
    """Lower-case letter runs of each text."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    spaced = pc.utf8_trim_whitespace(pc.replace_substring_regex(lower, r"\P{L}+", " "))
    return pc.split_pattern(spaced, " ")


def ladder(word: str) -> bytes:
    """The window of a word or phrase."""
    first = word.find(" ") + 2
    steps = "".join(word[:k] + "|" for k in range(max(2, first), max(2, first) + 8) if len(word) > k)
    return f"{steps}{word}|{word}/".encode()


def _compressor(raw: bytes, level: int):
    import zstandard

    return zstandard.ZstdCompressor(
        level=level, write_content_size=False, write_checksum=False, write_dict_id=False,
        dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


class Distance:
    """Bytes saved per window by the toxic dictionary; results are remembered
    for a bounded number of windows."""

    def __init__(self, model: ToxicityModel, table_words: int = 400_000):
        self.ordinary = _compressor(model.ordinary, model.level).compress
        self.toxic = _compressor(model.toxic, model.level).compress
        self.table: dict[str, int] = {}
        self.table_words = table_words
        self.best = model.best
        self.heads: dict[str, set[int]] = {}     # first word -> lengths of its phrases
        for p in model.phrases:
            self.heads.setdefault(p.split(" ")[0], set()).add(p.count(" ") + 1)

    def words(self, words: list[str]) -> np.ndarray:
        """Savings of words or phrases."""
        out = np.zeros(len(words), np.int64)
        table = self.table
        if len(table) > self.table_words:
            table.clear()
        for i, w in enumerate(words):
            d = table.get(w)
            if d is None:
                x = ladder(w)
                d = len(self.ordinary(x)) - len(self.toxic(x)) if w else 0
                if len(w) <= 64:
                    table[w] = d
            out[i] = d
        return out

    def _phrases(self, vocabulary: list[str], codes: np.ndarray, at_text: np.ndarray,
                 ) -> tuple[np.ndarray, np.ndarray]:
        """(text, saving) of the different phrases that can save."""
        lengths = {c: self.heads[w] for c, w in enumerate(vocabulary) if w in self.heads}
        found: dict[tuple[int, str], None] = {}
        if lengths:
            for i in np.flatnonzero(np.isin(codes, list(lengths))).tolist():
                for n in lengths[int(codes[i])]:
                    if i + n <= len(codes) and at_text[i + n - 1] == at_text[i]:
                        found[int(at_text[i]), " ".join(vocabulary[c] for c in codes[i:i + n])] = None
        different = list(dict.fromkeys(p for _, p in found))
        saved = dict(zip(different, self.words(different).tolist()))
        return (np.array([t for t, _ in found], np.int64),
                np.array([saved[p] for _, p in found], np.int64))

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Sum of the largest savings of each text over the logarithm of its length."""
        lists = words_of_texts(texts)
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        vocabulary = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        saving = self.words(vocabulary)
        at_text = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(saving[codes] > 0) if len(codes) else codes
        pairs = np.unique(at_text[at] * max(1, len(vocabulary)) + codes[at])
        text, d = pairs // max(1, len(vocabulary)), saving[pairs % max(1, len(vocabulary))]
        if self.heads:
            more, e = self._phrases(vocabulary, codes, at_text)
            text, d = np.concatenate([text, more[e > 0]]), np.concatenate([d, e[e > 0]])
        order = np.lexsort((-d, text))
        text, d = text[order], d[order]
        counted = np.arange(len(text)) - np.searchsorted(text, text) < self.best
        sums = np.bincount(text[counted], weights=d[counted], minlength=len(n))
        return np.round(sums / np.log(8 + n), 6)


def _segments(words: list[str], beginnings: tuple[int, ...], phrase_words: tuple[int, ...] = ()) -> set[str]:
    """Words and phrases (with a space behind) and beginnings of words."""
    out = set()
    for w in set(words):
        out.add(w + " ")
        out.update(w[:k] for k in beginnings if len(w) > k)
    for n in phrase_words:
        out.update(" ".join(words[i:i + n]) + " " for i in range(len(words) - n + 1))
    return out


def train(docs: DataFrame, labels: DataFrame, learn: Column, calibrate: Column,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          settings: ToxicityTraining = ToxicityTraining()) -> ToxicityModel:
    """Train on the labelled documents.  ``learn`` selects the label rows that
    may be used at all, ``calibrate`` those among them that set the threshold
    only (both are conditions over the label table)."""
    s = settings
    chosen = (labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
              .groupBy(F.col(id_col).alias("k"))
              .agg(F.max(F.col(label_col).cast("int")).alias("y"),
                   F.first(calibrate).alias("held"))
              .orderBy(F.xxhash64("k"), "k").limit(s.max_labelled))
    # At most max_labelled rows of three small columns: safe to broadcast.
    rows = written(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
                   .join(F.broadcast(chosen), "k").groupBy("k").agg(
                       F.max("y").alias("y"), F.first("held").alias("held"), F.max("t").alias("t"))
                   .select("y", "held", "t"), "toxic-train")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())

        def flush():
            seen = list(by[0] | by[1])
            out = pa.RecordBatch.from_arrays(
                [pa.array(seen, pa.string()), pa.array([by[0][x] for x in seen], pa.int64()),
                 pa.array([by[1][x] for x in seen], pa.int64())], names=["seg", "no", "nt"])
            by[0].clear()
            by[1].clear()
            return out

        for b in batches:
            for words, y in zip(words_of_texts(b.column(1)).to_pylist(), b.column(0).to_pylist()):
                by[y].update(_segments(words, s.beginnings, s.phrase_words))
                if len(by[0]) + len(by[1]) > s.count_entries:
                    yield flush()
        yield flush()

    counts = (rows.where(~F.col("held")).select("y", "t")
              .mapInArrow(count, "seg string, no long, nt long")
              .groupBy("seg").agg(F.sum("no").alias("no"), F.sum("nt").alias("nt")))
    counts = written(counts.where((F.length(F.trim("seg")) > 1) & (F.col("no") + F.col("nt") > 1)),
                     "toxic-counts")
    totals = rows.groupBy("held").agg(F.sum("y").alias("nt"), F.count("y").alias("n")).collect()   # two rows
    sizes = {r["held"]: (int(r["nt"]), int(r["n"])) for r in totals}
    n_toxic, n_all = sizes.get(False, (0, 0))
    if not 0 < n_toxic < n_all:
        return ToxicityModel(b"", b"", math.inf)
    share = n_toxic / n_all
    both = F.col("nt") + F.col("no")
    own = F.col("nt") / both
    gain = F.col("nt") * F.log(own / share) + F.when(
        F.col("no") > 0, F.col("no") * F.log((1 - own) / (1 - share))).otherwise(0.0)
    is_phrase = F.trim("seg").contains(" ")
    judged = counts.select("seg", both.alias("n"), own.alias("own"), gain.alias("gain"), is_phrase.alias("phrase"))
    seen = {r["phrase"]: r["count"] for r in judged.groupBy("phrase").count().collect()}           # two rows
    # A phrase is of use if it stands out more than each of its words does.
    out_standing = judged.where(F.col("own") > share)
    parts = out_standing.where("phrase").select("seg", F.col("gain").alias("g"), F.explode(F.flatten(F.transform(
        F.split(F.trim("seg"), " "), lambda w: F.concat(
            F.array(F.concat(w, F.lit(" "))), *[F.array(F.substring(w, 1, k)) for k in s.beginnings])))).alias("part"))
    idle = parts.join(out_standing.where("not phrase").select(F.col("seg").alias("part"), "gain"), "part").where(
        F.col("gain") >= F.col("g")).select("seg").distinct()
    marked = written(out_standing.where((F.col("gain") > min([math.log(2), *[g for _, g in s.weaker]]))
                                        ).join(idle, "seg", "left_anti"), "toxic-marks")
    common = judged.where(F.col("seg").endswith(" ") & ~F.col("phrase")).orderBy(F.desc("n"), "seg").limit(
        s.dictionary_bytes // 8).select("seg").collect()
    held = rows.where("held") if sizes.get(True, (0, 0))[0] else rows
    best, chosen_model = -1.0, ToxicityModel(b"", b"", math.inf)
    for least_share, least in [(s.least_share, None), *s.weaker]:
        def ratio(phrase: bool) -> float:
            return math.log(max(2, seen.get(phrase, 0))) + s.significance if least is None else least

        # The share of all labelled texts is no sign of anything.
        top = (marked.where((F.col("own") > max(least_share, share + (1 - share) / 4))
                            & (F.col("gain") > F.when(F.col("phrase"), ratio(True)).otherwise(ratio(False))))
               .orderBy(F.desc("gain"), "seg").limit(s.dictionary_bytes // 16).select("seg").collect())
        if top:
            got, model = _calibrated(_model(s, [r["seg"] for r in top], [r["seg"] for r in common]), held)
            if got > best:
                best, chosen_model = got, model
    return chosen_model


def _model(s: ToxicityTraining, marks: list[str], common: list[str]) -> ToxicityModel:
    """Dictionaries of the marks and common words, strongest first."""
    def fill(segments: list[str]) -> tuple[bytes, list[str]]:
        """Windows of the segments, the first ones last (nearest)."""
        out, size = [], 0
        for x in segments:
            window = ladder(x)
            if size + len(window) > s.dictionary_bytes:
                break
            out.append(window)
            size += len(window)
        return b"".join(reversed(out)), segments[:len(out)]

    marks = list(dict.fromkeys(m.strip() for m in marks))
    ordinary, _ = fill([c.strip() for c in common if c.strip() not in set(marks)])
    toxic, kept = fill(marks)
    return ToxicityModel(ordinary, ordinary + toxic, 0.0, phrases=tuple(m for m in kept if " " in m))


def _calibrated(model: ToxicityModel, rows: DataFrame) -> tuple[float, ToxicityModel]:
    """Best F1 on ``rows``, and the model with its threshold, half way to the
    next lower distance seen."""
    def distances(batches):
        d = Distance(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d.texts(b.column(1)))], names=["y", "d"])

    seen = (rows.select("y", "t").mapInArrow(distances, "y int, d double")
            .groupBy("y", "d").count().collect())       # one row per distance
    best = (-1.0, math.inf)
    toxic = sum(r["count"] for r in seen if r["y"])
    hit = flagged = 0
    by = {}
    for r in seen:
        a, b = by.get(r["d"], (0, 0))
        by[r["d"]] = (a + r["count"] * r["y"], b + r["count"])
    values = sorted(by, reverse=True)
    for v, low in zip(values, [*values[1:], 0]):
        if v <= 0:
            break
        hit, flagged = hit + by[v][0], flagged + by[v][1]
        best = max(best, (2 * hit / (flagged + toxic), (v + low) / 2))
    return best[0], replace(model, threshold=best[1])


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id",
                    text_col: str = "text", slice_bytes: int = 3_000_000) -> DataFrame:
    """One row per document: ``id_col``, distance, score (0 to 1)."""
    src = docs.select(docs[id_col].alias("k"), docs[text_col].alias("t"))
    key_type = src.schema["k"].dataType.simpleString()
    scorer = scores_of(model, slice_bytes)

    def run(batches):
        for b in batches:
            d = scorer(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(d), pa.array(as_score(d, model))],
                names=["k", "distance", "score"])

    return src.mapInArrow(run, f"k {key_type}, distance double, score double").withColumnRenamed("k", id_col)


def without_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, all columns as they are."""
    if math.isinf(model.threshold):
        return docs
    at = docs.columns.index(text_col)
    distances = scores_of(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(distances(b.column(at)) < model.threshold))

    return docs.mapInArrow(run, docs.schema)


def as_score(distance: np.ndarray, model: ToxicityModel) -> np.ndarray:
    """0.5 at the threshold."""
    if math.isinf(model.threshold):
        return np.zeros(len(distance))
    return 1 / (1 + np.exp((model.threshold - distance) / 2))


_SCORERS: dict[tuple, Distance] = {}


def scores_of(model: ToxicityModel, slice_bytes: int = 3_000_000):
    """Function from an Arrow column of texts to distances; a Python worker
    keeps one table of windows per model."""
    def distances(texts: pa.Array) -> np.ndarray:
        if math.isinf(model.threshold):
            return np.zeros(len(texts))
        key = (hash(model.toxic), model.level, model.phrases, model.best)
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Distance(model)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        parts = [_SCORERS[key].texts(texts.slice(lo, hi - lo)) for lo, hi in in_slices(sizes, slice_bytes)]
        return np.concatenate(parts) if parts else np.zeros(0)
    return distances
