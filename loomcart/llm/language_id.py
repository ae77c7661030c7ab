"""Language identification by compression.

For each language a zstandard raw-content dictionary holds the words that
occur in most of a sample of its texts.  The distinct words of a text, in
order of appearance, are compressed with every dictionary; the smallest result
names the language.  A narrow margin marks the answer as rejected.

Bounds: per language at most ``sample_texts`` texts (smallest hashed ids, of
any length) are learned from, and a dictionary holds ``dictionary_bytes`` at
most; words are counted in Spark, and the driver gets the most frequent ones
of each language.  The number of languages is taken to be small.  The texts to
name are read whole.

Defined cases: a text that is null, empty or without a letter is ``und`` with
score 0; nothing learned gives ``und`` for all; equal sizes go to the
dictionary that holds more of the text's letter triples, then to the first
language in order.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageTraining:
    sample_texts: int = 400
    dictionary_bytes: int = 8_192


def distinct_words(text: str) -> list[str]:
    """Lower-case words in order of first appearance; none without a letter."""
    words = list(dict.fromkeys(LETTERS.findall(text.lower())))
    if words and not words[0][0].isalpha() and not any(c.isalpha() for w in words for c in w):
        return []
    return words


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", settings: LanguageTraining = LanguageTraining()) -> dict[str, bytes]:
    """Dictionary of each language found in the rows that ``learn`` selects."""
    s = settings
    usable = docs.where(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()
                        & (F.length(text_col) > 0))
    keys = usable.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("k"),
                         F.xxhash64(F.col(id_col)).alias("h"))
    # The rank limit is applied in every task before the shuffle, so a
    # frequent language sends no more rows than a rare one.
    chosen = (keys.withColumn("r", F.row_number().over(
        Window.partitionBy("lang").orderBy("h", "k")))
        .where(F.col("r") <= s.sample_texts).select("lang", "k").distinct())
    rows = (usable.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("k"),
                          F.col(text_col).alias("t"))
            .join(F.broadcast(chosen), ["lang", "k"])
            .groupBy("lang", "k").agg(F.min("t").alias("t")).select("lang", "t"))

    def split(batches):
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = distinct_words(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string())], names=["lang", "w"])

    counts = rows.mapInArrow(split, "lang string, w string").groupBy("lang", "w").agg(F.count("w").alias("n"))
    # A word takes two bytes at least, so no more of them fit.
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(
        F.col("r") <= s.dictionary_bytes // 2).collect()
    found: dict[str, Counter] = {}
    for r in top:
        found.setdefault(r["lang"], Counter())[r["w"]] = r["n"]
    out = {}
    for lang, counts in sorted(found.items()):
        words, size = [], 0
        for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            size += len(w.encode()) + 1
            if size > s.dictionary_bytes:
                break
            words.append(w)
        if words:
            out[lang] = f" {' '.join(reversed(words))} ".encode()    # frequent words nearest
    return out


class LanguageNamer:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 6, narrow: float = 0.01):
        import zstandard

        self.langs = sorted(dictionaries)
        self.narrow = narrow
        self.compress = [zstandard.ZstdCompressor(
            level=level, write_content_size=False, write_checksum=False, write_dict_id=False,
            dict_data=zstandard.ZstdCompressionDict(
                dictionaries[x], dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress
            for x in self.langs]
        self.triples = [self._triples(dictionaries[x].decode()) for x in self.langs]

    @staticmethod
    def _triples(text: str) -> set[str]:
        return {text[i:i + 3] for i in range(len(text) - 2)}

    def name(self, text: str) -> tuple[str, float, bool]:
        """Language, score, whether the margin is wide enough."""
        words = distinct_words(text)
        if not words or not self.langs:
            return UNKNOWN, 0.0, False
        line = f" {' '.join(words)} "
        raw = line.encode()
        sizes = np.array([len(c(raw)) for c in self.compress])
        low = sizes.min()
        best = np.flatnonzero(sizes == low)
        if len(best) > 1:
            own = self._triples(line)
            best = sorted(best, key=lambda i: (-len(own & self.triples[i]), i))
        pick = int(best[0])
        others = np.delete(sizes, pick)
        margin = int(others.min() - low) if len(others) else int(low)
        score = float(1 / np.exp2(-np.minimum(sizes - low, 60).astype(float)).sum())
        return self.langs[pick], score, margin > max(1.0, self.narrow * low)


_NAMERS: dict[int, LanguageNamer] = {}


def name_documents(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, lang_pred, score (1 over the sum of
    2^-(bytes above the smallest) over all languages), accepted (the margin
    is not narrow)."""
    src = docs.select(docs[id_col].alias("k"), docs[text_col].alias("t"))
    key_type = src.schema["k"].dataType.simpleString()

    def run(batches):
        key = hash(tuple(sorted(dictionaries.items())))
        if key not in _NAMERS:
            _NAMERS.clear()
            _NAMERS[key] = LanguageNamer(dictionaries)
        namer = _NAMERS[key]
        for b in batches:
            got = [namer.name(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.bool_())],
                names=["k", "lang_pred", "score", "accepted"])

    return src.mapInArrow(
        run, f"k {key_type}, lang_pred string, score double, accepted boolean").withColumnRenamed("k", id_col)
