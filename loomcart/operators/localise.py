"""Dictionary localisation.

Lookup is whitespace-normalised: a text is collapsed (every run of
whitespace, including U+00A0 and U+FEFF, becomes one space) and trimmed
before the dictionary join; the original leading and trailing whitespace
is kept around the translation.  A text with no entry stays as it is.

Page localisation cuts the page's body into tokens (comments, elements whose
content is never translated, tags, text) with one expression and works on that
array: text nodes stay apart where a comment or tag parts them.  A stack of open
elements tells where blocks with the opt-out attribute end: at their own closing
tag, or at that of an element around them; a closing tag closes all that was
left open inside its element, and one without an open element closes nothing.
Only pages with an opt-out, or with changed texts, pass through Python, one
linear pass each.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from .. import functions as fn
from .joins import materialize, spread

# --- Fixed values: named character references decoded in text (HTML standard;
# "&amp;" last, so that an escaped reference stays a text) --------------------
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
            ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"),
            ("&middot;", "·"), ("&bull;", "•"), ("&ndash;", "–"), ("&mdash;", "—"),
            ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"),
            ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&times;", "×"),
            ("&deg;", "°"), ("&euro;", "€"), ("&pound;", "£"), ("&amp;", "&")]

_SKIPPED = "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|$)" for t in K.SKIPPED_ELEMENTS)
_TAG = r"""</?[a-zA-Z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>"""
_TEXT = r"(?:[^<]|<(?![a-zA-Z/!?]))[^<]*(?:<(?![a-zA-Z/!?])[^<]*)*"
_BODY = r"""<body(?:\s[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)?>"""
TOKEN = rf"(?is)<!--.*?(?:-->|$)|{_SKIPPED}|{_TAG}|<[/!?][^>]*>|{_TEXT}|<"
# Elements that hold nothing (HTML standard): an opt-out on them opens no block.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"]
ATTRIBUTE = (rf"(?i)\s({'|'.join(K.TRANSLATED_ATTRIBUTES)})\s*=\s*"
             r"""("[^"]*"|'[^']*'|[^\s"'>]+)""")


def decode_entities(c: Column) -> Column:
    """Character references decoded once: numeric ones, then the named ones."""
    def put(text, ref):
        digits = F.regexp_extract(ref, "(?i)^&#x?([0-9a-f]+);$", 1)
        number = F.when(ref.rlike("(?i)^&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        letter = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(valid, F.replace(text, ref, letter)).otherwise(text)

    refs = F.array_distinct(F.regexp_extract_all(c, F.lit("(?i)(&#(?:[0-9]{1,8}|x[0-9a-f]{1,6});)"), 1))
    c = F.when(c.contains("&#"), F.aggregate(refs, c, put)).otherwise(c)
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def encode_text(c: Column, quotes: bool = False) -> Column:
    """Text as HTML source."""
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;")] if quotes else [])]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def page_parts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, head (up to the body's content), tokens (array of the body's
    content), tail.  Without a body tag all of the page is its body; without a
    closing one the body goes on to the end."""
    html = F.col(html_col)
    head = F.regexp_extract(html, rf"(?is)^(.*?{_BODY})", 1)
    rest = F.substr(html, F.length(head) + 1, F.length(html))
    cut = spread(pages).select(F.col(id_col).alias("page_id"), head.alias("head"),
                               F.regexp_extract_all(rest, F.lit(TOKEN), 0).alias("all"))
    end = F.array_position(F.transform("all", lambda t: t.rlike("(?i)^</body")), True)
    n = F.when(end > 0, end - 1).otherwise(F.size("all")).cast("int")
    return cut.select("page_id", "head", F.slice("all", 1, n).alias("tokens"),
                      F.array_join(F.slice("all", n + 1, F.size("all")), "").alias("tail"))


OPTED = rf"""(?is)^<[a-z][^>]*\s{K.NO_TRANSLATE_ATTRIBUTE}(?:[\s=/>])"""
_NAME = re.compile(r"^<(/?)([a-zA-Z][a-zA-Z0-9-]*)")


def outside_blocks(tokens: list[str]) -> list[bool]:
    """For each token, whether it stands outside all opted-out blocks."""
    opted = re.compile(OPTED)
    out: list[bool] = []
    stack: list[tuple[str, bool]] = []             # open elements, and whether they opt out
    count: dict[str, int] = {}                     # open elements of a name
    blocks = 0
    for t in tokens:
        out.append(blocks == 0)
        m = _NAME.match(t)
        if not m:
            continue
        closing, name = m.group(1), m.group(2).lower()
        if closing:
            if count.get(name):
                while True:
                    top, off = stack.pop()
                    count[top] -= 1
                    blocks -= off
                    if top == name:
                        break
        elif name not in VOID and name not in K.SKIPPED_ELEMENTS and not t.endswith("/>"):
            off = opted.match(t) is not None
            stack.append((name, off))
            count[name] = count.get(name, 0) + 1
            blocks += off
    return out


# Batches stay Arrow arrays: a page's tokens become Python values while it is
# that page's turn only.
@F.arrow_udf(T.ArrayType(T.BooleanType()))
def _outside_blocks(tokens: pa.Array) -> pa.Array:
    return pa.array((None if not t.is_valid else outside_blocks(t.as_py()) for t in tokens), pa.list_(pa.bool_()))


@F.arrow_udf(T.StringType())
def _put_back(tokens: pa.Array, places: pa.Array, old: pa.Array, new: pa.Array) -> pa.Array:
    """Tokens joined, with the changes at their places: all of a text, or each
    stretch ``old`` of a tag."""
    def put(page):
        t, at, o, n = (x.as_py() for x in page)
        if t is None:
            return None
        for i, a, b in zip(at, o, n):
            t[i] = b if a is None else t[i].replace(a, b)
        return "".join(t)

    return pa.array((put(page) for page in zip(tokens, places, old, new)), pa.string())


def _translated_places(tokens: str) -> Column:
    """For each token, whether it stands outside all opted-out blocks; null for
    a page without any."""
    return _outside_blocks(F.when(F.exists(tokens, lambda t: t.rlike(OPTED)), F.col(tokens)))


def _is_text(t: Column) -> Column:
    return ~t.rlike("^<(?:[a-zA-Z/!?]|$)")


def text_fragments(pages: DataFrame, id_col: str = "page_id",
                   html_col: str = "html", parts: DataFrame | None = None) -> DataFrame:
    """One row per non-blank text node: (page_id, tok, pos, raw, key).

    ``tok`` is the token's place in the body, ``pos`` the node's place among
    the page's text nodes (blank and opted-out ones included).
    """
    parts = page_parts(pages, id_col, html_col) if parts is None else parts
    free = parts.select("page_id", "tokens", _translated_places("tokens").alias("free"))
    texts = F.filter(F.transform("tokens", lambda t, i: F.struct(
        i.alias("tok"), t.alias("t"), F.coalesce(F.get("free", i), F.lit(True)).alias("free"))),
        lambda x: _is_text(x["t"]))
    out = free.select("page_id", F.posexplode(texts).alias("pos", "x")).where(F.col("x.free"))
    out = out.select("page_id", F.col("x.tok").alias("tok"), "pos", decode_entities(F.col("x.t")).alias("raw"))
    out = out.withColumn("key", fn.norm_text("raw"))
    return out.filter(F.col("key") != "")


def attribute_values(pages: DataFrame, id_col: str = "page_id",
                     html_col: str = "html", parts: DataFrame | None = None) -> DataFrame:
    """Translatable attribute values: (page_id, tok, pos, attr, raw, key, pair).

    As on the shop's pages, they are those of input, textarea and img elements
    and of all that carry a title or aria-label, opted-out blocks included.
    ``pair`` is the attribute as written.
    """
    parts = page_parts(pages, id_col, html_col) if parts is None else parts
    tags = F.filter(F.transform("tokens", lambda t, i: F.struct(
        i.alias("tok"), F.regexp_extract(t, f"(?is)^({_TAG})", 1).alias("t"))),
        lambda x: x["t"].rlike(r"(?i)^<(?:input|textarea|img)\b")
        | x["t"].rlike(r"(?i)^<[a-z][^>]*\s(?:title|aria-label)\s*="))
    pairs = F.flatten(F.transform(tags, lambda x: F.transform(
        F.regexp_extract_all(x["t"], F.lit(ATTRIBUTE), 0),
        lambda a: F.struct(x["tok"].alias("tok"), a.alias("pair")))))
    out = parts.select("page_id", F.posexplode(pairs).alias("pos", "x")).select(
        "page_id", F.col("x.tok").alias("tok"), "pos", F.col("x.pair").alias("pair"))
    value = F.regexp_replace(F.regexp_extract("pair", ATTRIBUTE, 2), r"""(?s)^(["'])(.*)\1$""", "$2")
    out = out.select("page_id", "tok", "pos", F.lower(F.regexp_extract("pair", ATTRIBUTE, 1)).alias("attr"),
                     decode_entities(value).alias("raw"), "pair")
    return out.withColumn("key", fn.norm_text("raw"))


def localised_pages(pages: DataFrame, dictionary: DataFrame, id_col: str = "page_id",
                    html_col: str = "html") -> DataFrame:
    """K2: (page_id, html, n_texts, n_attributes) with translated text nodes
    and attribute values put back in their places."""
    parts = page_parts(pages, id_col, html_col)
    texts = translate(text_fragments(pages, id_col, html_col, parts), "raw", dictionary, "new")
    texts = texts.where(F.col("new") != F.col("raw")).select(
        "page_id", "tok", F.lit(None).cast("string").alias("old"), encode_text(F.col("new")).alias("new"))
    attrs = attribute_values(pages, id_col, html_col, parts)
    # A translated attribute is the dictionary's text alone.
    d = dictionary.select(F.col("src").alias("key"), F.col("dst").alias("__dst")).where(fn.truthy_text("__dst"))
    attrs = attrs.join(d, "key").select(
        "page_id", "tok", F.col("pair").alias("old"),
        F.concat(F.lit(" "), "attr", F.lit('="'), encode_text(F.col("__dst"), True), F.lit('"')).alias("new"))
    # The changes of one page: no more than its tokens and attributes.
    changes = texts.unionByName(attrs).groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("tok", "old", "new"))).alias("ch"),
        F.count_if(F.col("old").isNull()).alias("n_texts"),
        F.count("old").alias("n_attributes"))
    j = parts.join(changes, "page_id", "left")
    changed = F.col("ch").isNotNull()
    put = _put_back(F.when(changed, F.col("tokens")), *[F.col("ch")[c] for c in ("tok", "old", "new")])
    body = F.coalesce(put, F.array_join("tokens", ""))
    none = F.lit(0).cast("long")
    return j.select("page_id", F.concat("head", body, "tail").alias("html"),
                    F.coalesce("n_texts", none).alias("n_texts"),
                    F.coalesce("n_attributes", none).alias("n_attributes"))


def translate(df: DataFrame, col: str, dictionary: DataFrame,
              out_col: str | None = None) -> DataFrame:
    """Translated text, or the text itself when the dictionary lacks it.

    ``dictionary`` has (src, dst) with src already normalised and one row
    per src.  It is written once (``materialize``) unless the caller did so,
    then joined as the planner chooses by its size in bytes.
    """
    d = dictionary.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"))
    if not getattr(dictionary, "_loomcart_materialized", False):
        d = materialize(d)
    j = df.join(d, fn.norm_text(col) == F.col("__src"), "left")
    hit = F.col("__dst").isNotNull() & (F.col("__dst") != "")
    val = F.when(hit, F.concat(fn.leading_ws(col), F.col("__dst"), fn.trailing_ws(col))
                 ).otherwise(F.col(col))
    return j.withColumn(out_col or f"{col}_t", val).drop("__src", "__dst")


def materialized(dictionary: DataFrame) -> DataFrame:
    """A dictionary written once, for use in several ``translate`` calls."""
    d = materialize(dictionary)
    d._loomcart_materialized = True
    return d


def page_dictionary(fragments: DataFrame) -> DataFrame:
    """A dictionary sliced from the pages: every normalised fragment with a
    marked stand-in translation and the number of pages it is on."""
    return (fragments.select("page_id", F.col("key").alias("src")).distinct().groupBy("src")
            .agg(F.count("page_id").alias("pages"))
            .select("src", F.concat(F.lit("«"), F.col("src"), F.lit("»")).alias("dst"),
                    "pages"))


def translation_pairs(p: DataFrame) -> DataFrame:
    """G1: (src, dst, pos) from name/name_bn and description/description_bn,
    both sides non-empty.  ``pos`` orders pairs as the listing does."""
    pos = F.struct(F.col("collection"), F.col("name"), F.col("size").isNull(),
                   F.col("size"), F.col("id"))
    pairs = F.array(
        F.struct(F.col("name").alias("src"), F.col("name_bn").alias("dst"), F.lit(0).alias("k")),
        F.struct(F.col("description").alias("src"), F.col("description_bn").alias("dst"),
                 F.lit(1).alias("k")))
    out = p.select(pos.alias("pos"), F.explode(pairs).alias("e")).select("pos", "e.*")
    return out.filter(fn.truthy_text("src") & fn.truthy_text("dst"))


def overlay_dictionary(*sources: DataFrame) -> DataFrame:
    """Merge dictionaries; a later source wins over an earlier one, and
    inside a source the entry with the largest ``pos`` wins (when given).
    Empty translations are ignored; keys are normalised.  Two plain
    aggregates (no window), so a very common key is reduced map-side."""
    per_source = []
    for i, s in enumerate(sources):
        x = (s.select(fn.norm_text("src").alias("src"), "dst",
                      *(["pos"] if "pos" in s.columns else []))
             .filter(fn.truthy_text("dst") & fn.truthy_text("src")))
        if "pos" in s.columns:
            x = x.groupBy("src").agg(F.max_by("dst", "pos").alias("dst"))
        else:
            x = x.groupBy("src").agg(F.max("dst").alias("dst"))
        per_source.append(x.withColumn("source", F.lit(i)))
    u = per_source[0]
    for x in per_source[1:]:
        u = u.unionByName(x)
    return u.groupBy("src").agg(F.max_by("dst", "source").alias("dst"))

