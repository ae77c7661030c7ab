"""Line-first cleaning of documents by fixed rules (built-in functions only).

Every line is judged first: lines that look like navigation, symbol noise,
boilerplate or run on without any sentence punctuation are removed.  A
document is then rejected if it fails the base test (too few words, or too
many words inside repeated 8-word windows) or if the removed lines held more
than ``max_lost`` percent of its word characters.

Defined cases: a null or empty text has no words and no lines and is rejected
(``n_words`` < ``min_words``); repeated rows are judged alike and all kept in
the output; a text of one very long line is one line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_of, words_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """Thresholds; percentages are of a line's characters."""

    min_words: int = 20              # a document needs as many
    max_repeat_percent: int = 30     # words inside repeated windows
    window: int = 8
    separators: str = "|"            # navigation marks
    min_separators: int = 2
    nav_percent: int = 4
    symbol_percent: int = 8
    sentence_marks: str = r"[.!?…。！？]"
    min_unmarked: int = 80           # a line this long needs a sentence mark
    max_boilerplate: int = 200       # longer lines are never boilerplate
    boilerplate: str = (
        r"(?i)(licen[sc]ed under|all rights reserved|copyright|\(c\) [0-9]{4}"
        r"|privacy policy|cookie policy|terms of (use|service)|sign up"
        r"|subscribe|click here|enable javascript|spdx-license)")
    max_lost: int = 50               # percent of word characters


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_fails(line: Column, rules: LineRules = LineRules()) -> Column:
    """True for a line that one of the line rules removes."""
    size = F.length(line)
    seps = _removed(line, rules.separators)
    navigation = (seps >= rules.min_separators) & (seps * 100 >= size * rules.nav_percent)
    noise = _removed(line, SYMBOLS) * 100 > size * rules.symbol_percent
    boilerplate = (size <= rules.max_boilerplate) & line.rlike(rules.boilerplate)
    unmarked = (size >= rules.min_unmarked) & ~line.rlike(rules.sentence_marks)
    return navigation | noise | unmarked | boilerplate


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          rules: LineRules = LineRules(), with_text: bool = False) -> DataFrame:
    """One row per document: ``id_col``, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_lines, n_failed_lines, lost_chars,
    base_failed, kept and, if asked for, clean_text (the lines that stay,
    joined by line feeds)."""
    w = rules.window
    one = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    one = one.select(
        "id", "t", words_of(F.col("t")).alias("words"),
        F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("lines"))
    one = one.select(
        "id", "t", "lines", F.size("words").cast("long").alias("n_words"),
        F.transform("words", lambda x: F.xxhash64(x)).alias("h"),
        F.filter("lines", lambda x: ~line_fails(x, rules)).alias("good"))
    # A window's key: the hash of its words' hashes.
    one = one.select(
        "id", "t", "lines", "n_words", "good",
        F.when(F.size("h") >= w, F.transform(
            F.sequence(F.lit(1), F.size("h") - (w - 1)),
            lambda i: F.xxhash64(F.slice("h", i, w)))).alias("keys"))
    one = one.select(
        "id", "t", "lines", "n_words", "good",
        F.when(F.size(F.array_distinct("keys")) < F.size("keys"), F.sort_array(
            F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("p"))))).alias("s"))
    one = one.select(
        "id", "t", "lines", "n_words", "good",
        F.flatten(F.zip_with(
            F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s") - 1),
            lambda a, b: F.when(a["k"] == b["k"], F.array(a["p"], b["p"])).otherwise(
                F.array().cast("array<int>")))).alias("p"))
    one = one.select("id", "t", "lines", "n_words", "good",
                     F.sort_array(F.array_distinct("p")).alias("p"))
    covered = F.aggregate(
        F.zip_with("p", F.slice("p", 2, F.size("p")),
                   lambda a, b: F.least(F.lit(w), F.coalesce(b - a, F.lit(w))).cast("long")),
        F.lit(0).cast("long"), lambda acc, x: acc + x)
    chars = F.length(F.translate("t", SPACES, "")).cast("long")
    good_chars = F.length(F.translate(F.array_join("good", ""), SPACES, "")).cast("long")
    one = one.select(
        "id", "n_words", chars.alias("word_chars"),
        _removed(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_failed_lines"),
        (chars - good_chars).alias("lost_chars"),
        *([F.array_join("good", "\n").alias("clean_text")] if with_text else []))
    base = ((F.col("n_words") < rules.min_words)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent))
    lost = F.col("lost_chars") * 100 > F.col("word_chars") * rules.max_lost
    return one.select(
        F.col("id").alias(id_col), *[c for c in one.columns if c not in ("id", "clean_text")],
        base.alias("base_failed"), (~base & ~lost).alias("kept"),
        *(["clean_text"] if with_text else []))


def judge_sql(rules: LineRules = LineRules()) -> str:
    """DuckDB statement for :func:`judge` over ``documents``: windows compared
    as texts, not as hashes."""
    w = rules.window
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    gone = f"translate(x, {ws}, '')"
    fails = (
        f"((len(x) - len(translate(x, '{rules.separators}', ''))) >= {rules.min_separators}"
        f" AND (len(x) - len(translate(x, '{rules.separators}', ''))) * 100 >= len(x) * {rules.nav_percent})"
        f" OR (len(x) - len(translate(x, '{SYMBOLS}', ''))) * 100 > len(x) * {rules.symbol_percent}"
        f" OR (len(x) >= {rules.min_unmarked} AND NOT regexp_matches(x, '[.!?…。！？]'))"
        f" OR (len(x) <= {rules.max_boilerplate} AND regexp_matches(x, '{rules.boilerplate}'))")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
spans AS (SELECT rid, unnest(list_transform(range(1, len(w) - {w - 2}),
              lambda i: {{'p': i, 'k': array_to_string(list_slice(w, i, i + {w - 1}), ' ')}})) AS s
          FROM words WHERE len(w) >= {w}),
rep AS (SELECT rid, s.p AS p FROM spans QUALIFY count(*) OVER (PARTITION BY rid, s.k) >= 2),
gaps AS (SELECT rid, least({w}, coalesce(lead(p) OVER (PARTITION BY rid ORDER BY p) - p, {w})) AS g FROM rep),
cov AS (SELECT rid, CAST(sum(g) AS BIGINT) AS n FROM gaps GROUP BY rid),
lin AS (SELECT rid, x, row_number() OVER (PARTITION BY rid, x) AS nth, ({fails}) AS bad
        FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) q WHERE {gone} <> ''),
per AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup,
               count(*) FILTER (bad) AS n_bad,
               CAST(coalesce(sum(len({gone})) FILTER (bad), 0) AS BIGINT) AS lost
        FROM lin GROUP BY rid),
o AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(len(translate(t, {ws}, '')) AS BIGINT) AS word_chars,
             CAST(len(t) - len(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words,
             CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
             CAST(coalesce(n_bad, 0) AS BIGINT) AS n_failed_lines,
             coalesce(lost, 0) AS lost_chars
      FROM d JOIN words USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN per USING (rid)),
b AS (SELECT *, n_words < {rules.min_words} OR n_repeat_words * 100 > n_words * {rules.max_repeat_percent}
      AS base_failed FROM o)
SELECT *, NOT base_failed AND NOT (lost_chars * 100 > word_chars * {rules.max_lost}) AS kept FROM b"""
