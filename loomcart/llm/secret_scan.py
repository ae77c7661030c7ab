"""Secret scans: fixed patterns, and character Markov models (built-in
functions only).

Base spans come from fixed patterns (assignments, access keys, long hex runs).
The values they find are the labelled sample of random strings; long
identifier-like runs that touch none are the sample of ordinary identifiers.
Two first-order character models are counted from all of them.  Runs, cut
where base spans cover them, are added as spans of kind ``markov`` if they are
long and their log-likelihood ratio, random over ordinary, is at least
``least_ratio``, and that much per character too.

Positions are code points, ends exclusive.  A matcher gives no positions in
built-in functions, so matches are marked with a control character (which no
pattern can match; one in the text is first replaced by another), the text is
cut at the marks, and lengths are summed.  Sums are taken in blocks of about
the square root of their number, and strings are cut as bytes, so a text of
many spans costs hardly more than its length.  Runs with a digit are scored but
are not in the ordinary sample, since an unlabelled secret may be among them.

Defined cases: a null or empty text has no spans; without any base span or
ordinary run nothing is added; a document's row depends on its text and the
models only, so repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
# The maximal runs of at least the least length: the same spans as all runs
# with the short ones dropped.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

MARK, INSTEAD = "\x01", "\x02"
SPAN = "array<struct<s:int,e:int,v:string>>"


@dataclass(frozen=True)
class MarkovSettings:
    least_run: int = 12          # characters of a run that the models count
    least_flagged: int = 16      # characters of a run that can be added
    least_ratio: float = 12.0    # natural log units
    per_char: float = 0.35
    smoothing: float = 0.5       # added to each letter's count
    backing: float = 5.0         # weight of a letter's own frequency
    letters: int = 65            # characters runs are made of


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(numbers: Column) -> Column:
    """Sum of the numbers before each place.  An aggregate that appends copies
    its array at every step; in blocks of the square root of their number n
    that is n^1.5 instead of n^2."""
    none = F.array().cast("array<int>")

    def prefix(xs, first):
        start = F.struct(first.cast("int").alias("at"), none.alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(
            (acc["at"] + x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"])

    def total(xs):
        return F.aggregate(xs, F.lit(0), lambda acc, x: (acc + x).cast("int"))

    def in_blocks(xs):
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        cut = let(width, lambda w: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / w).cast("int")), lambda i: F.slice(xs, i * w + 1, w)))
        return let(cut, lambda bs: let(prefix(F.transform(bs, total), F.lit(0)), lambda firsts: F.flatten(
            F.transform(bs, lambda b, i: prefix(b, F.get(firsts, i))))))

    return F.when(F.size(numbers) > 0, let(numbers, in_blocks)).otherwise(none)


def _found(text: Column, pattern: str) -> Column:
    """Spans of all leftmost non-overlapping matches."""
    def spans(parts):
        return let(sums_before(F.transform(parts, lambda p: F.length(p))), lambda at: F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)), lambda i: F.struct(
                F.get(at, i).alias("s"), (F.get(at, i) + F.length(F.get(parts, i))).alias("e"),
                F.get(parts, i).alias("v"))))

    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    return F.when(text.rlike(pattern), let(parts, spans)).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               settings: MarkovSettings = MarkovSettings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, the columns to keep (as ``keep_<name>``), base (spans
    with kind number k, by start then kind), runs (identifier-like)."""
    run = rf"[A-Za-z0-9+/_=-]{{{settings.least_run},}}"
    src = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"keep_{c}") for c in keep],
                      F.translate(text_of(text_col), MARK, INSTEAD).alias("t"))
    t = F.col("t")
    assign = F.when(t.contains("=") | t.contains(":"), _found(t, ASSIGN)).otherwise(F.array().cast(SPAN))
    found = src.select("id", *[f"keep_{c}" for c in keep],
                       F.filter(assign, lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 2)) >= LEAST_VALUE
                                ).alias("assign"),
                       _found(t, ACCESS).alias("access"), _found(t, HEX).alias("hex"),
                       _found(t, run).alias("runs"))

    def kind(name: str, k: int) -> Column:
        return F.transform(name, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    values = F.concat(F.transform("assign", lambda x: F.regexp_extract(x["v"], ASSIGN, 2)),
                      F.transform("access", lambda x: x["v"]), F.transform("hex", lambda x: x["v"]))
    return found.select("id", *[f"keep_{c}" for c in keep],
                        F.sort_array(F.concat(kind("assign", 0), kind("access", 1), kind("hex", 2))).alias("base"),
                        values.alias("vals"), "runs")


def _cut(base: Column, runs: Column) -> Column:
    """The stretches of the runs that no base span covers, in order: s, e, v
    and whole (it is all of a run)."""
    def ends(spans, cover, run):
        return F.concat(*[F.transform(spans, lambda x: F.struct(
            x[at].alias("at"), F.lit(cover * sign).alias("cover"), F.lit(run * sign).alias("run"),
            F.lit(run if sign > 0 else 0).alias("first"))) for at, sign in (("s", 1), ("e", -1))])

    def stretches(runs, ev, cover, run, first):
        # Values pass through arrays by copy: a stretch holds its run's place only.
        def stretch(i):
            x = F.get(ev, i)
            free = (F.get(cover, i) + x["cover"] == 0) & (F.get(run, i) + x["run"] == 1)
            return F.when(free & (x["at"] < F.get(ev, i + 1)["at"]), F.struct(
                x["at"].alias("s"), F.get(ev, i + 1)["at"].alias("e"),
                (F.get(first, i) + x["first"] - 1).alias("k")))

        def cut_out(found, raw):
            def of(p):
                r = F.get(runs, p["k"])
                part = F.substr(F.get(raw, p["k"]), p["s"] - r["s"] + 1, p["e"] - p["s"]).cast("string")
                whole = (p["s"] == r["s"]) & (p["e"] == r["e"])
                return F.struct(p["s"].alias("s"), p["e"].alias("e"), part.alias("v"), whole.alias("whole"))
            return F.transform(found, of)

        places = F.sequence(F.lit(0), F.size(ev) - 2)
        raw = F.transform(runs, lambda r: r["v"].cast("binary"))
        return let(F.array_compact(F.transform(places, stretch)), lambda found: let(
            raw, lambda raw: cut_out(found, raw)))

    def sums(ev, c):
        return sums_before(F.transform(ev, lambda x: x[c]))

    # Counts of open base spans, open runs and begun runs before each end.
    cut = let(runs, lambda rs: let(F.sort_array(F.concat(ends(base, 1, 0), ends(rs, 0, 1))), lambda ev: let(
        sums(ev, "cover"), lambda c: let(sums(ev, "run"), lambda r: let(sums(ev, "first"), lambda f: (
            stretches(rs, ev, c, r, f)))))))
    plain = F.transform(runs, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), r["v"].alias("v"),
                                                 F.lit(True).alias("whole")))
    return F.when((F.size(base) > 0) & (F.size(runs) > 0), cut).otherwise(plain)


def _outside(scanned: DataFrame) -> DataFrame:
    """Runs cut at base spans."""
    return scanned.withColumn("runs", _cut(F.col("base"), F.col("runs")))


def _pairs(strings: Column) -> Column:
    """Places 128 * a + b of the character pairs (a, b) of the strings (ASCII;
    a string's bytes are found without walking it)."""
    def of(v):
        def code(raw, i):
            return F.ascii(F.substr(raw, i, F.lit(1)).cast("string"))
        return let(v.cast("binary"), lambda raw: F.transform(
            F.sequence(F.lit(1), F.length(v) - 1), lambda i: code(raw, i) * 128 + code(raw, i + 1)))
    return F.flatten(F.transform(F.filter(strings, lambda v: F.length(v) > 1), of))


def markov_ratios(scanned: DataFrame, settings: MarkovSettings = MarkovSettings()) -> DataFrame:
    """One row: ratios, an array of 128 * 128 log ratios P(b | a), random over
    ordinary; null if a sample is empty.  Two tables of at most 16,384 rows
    are all that is gathered."""
    s = settings
    pairs = scanned.select(F.explode(_pairs(F.col("vals"))).alias("p"), F.lit(1).alias("r")).unionByName(
        _outside(scanned).select(F.explode(_pairs(F.transform(
            F.filter("runs", lambda r: r["whole"] & ~r["v"].rlike("[0-9]")), lambda r: r["v"]))).alias("p"),
                                 F.lit(0).alias("r")))
    counts = pairs.groupBy("p").agg(F.sum("r").alias("nr"), F.sum(1 - F.col("r")).alias("no"))
    counts = counts.select(F.col("p").cast("int").alias("p"), "nr", "no")

    def as_map(key: Column) -> DataFrame:
        """One row: key -> (random, ordinary) counts."""
        sums = counts.groupBy(key.cast("int").alias("k")).agg(F.sum("nr").alias("nr"), F.sum("no").alias("no"))
        return sums.agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("nr", "no")))).alias("m"))

    one = as_map(F.col("p")).select(
        F.col("m").alias("pairs"), as_map(F.floor(F.col("p") / 128)).scalar().alias("firsts"),
        as_map(F.col("p") % 128).scalar().alias("seconds"), as_map(F.lit(0)).scalar()[0].alias("all"))

    def logs(p: Column, side: str) -> Column:
        """log P(b | a), drawn to the frequency of b where a is rare."""
        def n(x):
            return F.coalesce(x[side], F.lit(0))
        b = ((n(F.col("seconds")[(p % 128).cast("int")]) + s.smoothing)
             / (F.col("all")[side] + s.smoothing * s.letters))
        return F.log((n(F.col("pairs")[p]) + s.backing * b)
                     / (n(F.col("firsts")[F.floor(p / 128).cast("int")]) + s.backing))

    return one.select(F.when((F.col("all.nr") > 0) & (F.col("all.no") > 0), F.transform(
        F.sequence(F.lit(0), F.lit(128 * 128 - 1)),
        lambda p: F.round(logs(p, "nr") - logs(p, "no"), 9))).alias("ratios"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         settings: MarkovSettings = MarkovSettings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: ``id_col``, the kept columns, base and spans (arrays of
    s, k, e: start, kind number, end; by start, then kind)."""
    s = settings
    scanned = written(base_spans(docs, id_col, text_col, s, keep), "secret-spans")
    ratios = written(markov_ratios(scanned, s), "secret-ratios")
    kept = [f"keep_{c}" for c in keep]
    scored = _outside(scanned).withColumn("w", ratios.scalar())

    def score(v):
        return F.aggregate(_pairs(F.array(v)), F.lit(0.0), lambda acc, p: acc + F.col("w")[p])

    def flagged(r):
        return ((F.length(r["v"]) >= s.least_flagged)
                & (score(r["v"]) >= F.greatest(F.lit(s.least_ratio), F.length(r["v"]) * s.per_char)))

    more = F.when(F.col("w").isNotNull(), F.transform(F.filter("runs", flagged), lambda r: F.struct(
        r["s"].alias("s"), F.lit(3).alias("k"), r["e"].alias("e"))))
    return scored.select(
        F.col("id").alias(id_col), *[F.col(k).alias(c) for k, c in zip(kept, keep)], "base",
        F.sort_array(F.concat("base", F.coalesce(more, F.array().cast(
            "array<struct<s:int,k:int,e:int>>")))).alias("spans"))


def spans_text(spans: str) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, digest of the base spans, all spans as text."""
    def count(k):
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return scanned.select(
        id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def redacted(text: Column, spans: str = "spans", instead: str = "[SECRET]") -> Column:
    """The text with every stretch of overlapping spans replaced."""
    # Four bytes a character: places are found without walking the text.  A
    # space goes before each piece, so none begins with a byte order mark.
    def piece(wide, lo, hi):
        cut = F.concat(F.lit(b"\0\0\0 "), F.substr(wide, 4 * lo + 1, 4 * (hi - lo)))
        return F.substr(F.decode(cut, "UTF-32"), F.lit(2))

    def pieces(wide, ev, before):
        def after(i):
            x, n = F.get(ev, i), F.get(before, i) + F.get(ev, i)["cover"]
            end = F.coalesce(F.get(ev, i + 1)["at"], F.floor(F.octet_length(wide) / 4).cast("int"))
            return F.when(n == 0, piece(wide, x["at"], end)).when(
                (n == 1) & (x["cover"] == 1), F.lit(instead)).otherwise(F.lit(""))
        places = F.sequence(F.lit(0), F.size(ev) - 1)
        return F.concat(piece(wide, F.lit(0), F.get(ev, F.lit(0))["at"]), F.array_join(F.transform(places, after), ""))

    # At one place, spans that end come before those that begin.
    ev = F.sort_array(F.concat(*[F.transform(spans, lambda x: F.struct(
        x[at].alias("at"), F.lit(cover).alias("cover"))) for at, cover in (("s", 1), ("e", -1))]))
    cut = let(F.encode(text, "UTF-32"), lambda wide: let(ev, lambda ev: let(
        sums_before(F.transform(ev, lambda x: x["cover"])), lambda before: pieces(wide, ev, before))))
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def scan_sql(settings: MarkovSettings = MarkovSettings()) -> str:
    """DuckDB statement for :func:`digests` of :func:`scan` over ``documents``:
    spans as rows, scores as sums over the character pairs of each run."""
    s = settings
    run = f"[A-Za-z0-9+/_=-]{{{s.least_run},}}"

    def found(k: int, pattern: str) -> str:
        q = pattern.replace("'", "''")
        return f"""
SELECT rid, {k} AS k, b AS s, b + length(v) AS e, v FROM (
  SELECT rid, i, v, CAST(coalesce(sum(length(v)) OVER (PARTITION BY rid ORDER BY i
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
  FROM (SELECT rid, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS v FROM (
          SELECT rid, string_split(regexp_replace(t, '{q}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS l
          FROM d WHERE regexp_matches(t, '{q}')))) WHERE i % 2 = 0"""

    value = f"CASE WHEN k = 0 THEN regexp_extract(v, '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2) ELSE v END"
    names = "list_extract(['" + "', '".join(KINDS) + "'], k + 1)"
    span = f"{names} || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR)"
    joined = f"string_agg({span}, ',' ORDER BY s, k, e)"

    def logs(side: str) -> str:
        b = f"((c.{side}2 + {s.smoothing}) / (a.{side} + {s.smoothing * s.letters}))"
        return f"ln((c.{side} + {s.backing} * {b}) / (c.{side}1 + {s.backing}))"

    pair = "128 * ascii(substr(v, i, 1)) + ascii(substr(v, i + 1, 1))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t
           FROM documents),
base AS (SELECT *, {value} AS val FROM ({found(0, ASSIGN)} UNION ALL {found(1, ACCESS)} UNION ALL {found(2, HEX)})
         WHERE k <> 0 OR length({value}) >= {LEAST_VALUE}),
every AS (SELECT r.*, EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.s < r.e AND r.s < b.e) AS hit
          FROM ({found(3, run)}) r),
begins AS (SELECT rid, s, e, v, s AS x FROM every WHERE hit
           UNION SELECT r.rid, r.s, r.e, r.v, b.e FROM every r JOIN base b ON b.rid = r.rid AND b.s < r.e AND r.s < b.e
           WHERE b.e < r.e),
free AS (SELECT * FROM begins g WHERE NOT EXISTS (
           SELECT 1 FROM base b WHERE b.rid = g.rid AND b.s <= g.x AND g.x < b.e)),
part AS (SELECT rid, s, v, x, least(e, coalesce((SELECT min(b.s) FROM base b WHERE b.rid = f.rid AND b.s >= f.x), e)) AS y
         FROM free f),
runs AS (SELECT *, row_number() OVER () AS id FROM (
           SELECT rid, k, s, e, v, hit FROM every WHERE NOT hit
           UNION ALL SELECT rid, 3, x, y, substr(v, CAST(x - s + 1 AS BIGINT), CAST(y - x AS BIGINT)), true FROM part)),
learn AS (SELECT val AS v, 1 AS r FROM base
          UNION ALL SELECT v, 0 FROM runs WHERE NOT hit AND NOT regexp_matches(v, '[0-9]')),
pr AS (SELECT {pair} AS p, r FROM (SELECT v, r, unnest(range(1, length(v))) AS i FROM learn) q),
cnt AS (SELECT p, sum(r) AS nr, sum(1 - r) AS no FROM pr GROUP BY p),
a AS (SELECT coalesce(sum(nr), 0) AS nr, coalesce(sum(no), 0) AS no FROM cnt),
f1 AS (SELECT p // 128 AS x, sum(nr) AS nr, sum(no) AS no FROM cnt GROUP BY p // 128),
f2 AS (SELECT p % 128 AS x, sum(nr) AS nr, sum(no) AS no FROM cnt GROUP BY p % 128),
each AS (SELECT id, {pair} AS p FROM (SELECT id, v, unnest(range(1, length(v))) AS i FROM runs) q),
need AS (SELECT DISTINCT p FROM each),
c AS (SELECT need.p, coalesce(cnt.nr, 0) AS nr, coalesce(cnt.no, 0) AS no, coalesce(f1.nr, 0) AS nr1,
             coalesce(f1.no, 0) AS no1, coalesce(f2.nr, 0) AS nr2, coalesce(f2.no, 0) AS no2
      FROM need LEFT JOIN cnt ON need.p = cnt.p LEFT JOIN f1 ON need.p // 128 = f1.x
      LEFT JOIN f2 ON need.p % 128 = f2.x),
w AS (SELECT c.p, round({logs("nr")} - {logs("no")}, 9) AS w FROM c, a WHERE a.nr > 0 AND a.no > 0),
score AS (SELECT id, sum(w) AS x FROM each JOIN w USING (p) GROUP BY id),
more AS (SELECT rid, k, s, e FROM runs JOIN score USING (id)
         WHERE length(v) >= {s.least_flagged} AND x >= greatest({s.least_ratio}, length(v) * {s.per_char})),
b AS (SELECT rid, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
             {joined} AS x FROM base GROUP BY rid),
al AS (SELECT rid, {joined} AS x
       FROM (SELECT rid, k, s, e FROM base UNION ALL SELECT * FROM more) GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(b.x, '')) AS base_sha256, coalesce(al.x, '') AS spans
FROM d LEFT JOIN b ON d.rid = b.rid LEFT JOIN al ON d.rid = al.rid"""
