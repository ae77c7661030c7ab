"""Registered localisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import localise as lo
from . import mapping as M
from . import sqltext as Q
from .registry import register

_FRAG = Q.page_text_fragments()
_DICT = f"""
SELECT key AS src, '«' || key || '»' AS dst, count(DISTINCT page_id) AS pages
FROM ({_FRAG}) GROUP BY key
"""


@register("page_fragments", f"SELECT page_id, pos, raw, key FROM ({_FRAG})")
def q_fragments(spark, d):
    """K2 extraction: every non-blank text node of every page body."""
    return lo.text_fragments(M.table(spark, d, "pages")).drop("tok")


@register("page_dictionary", _DICT)
def q_page_dictionary(spark, d):
    """The dictionary sliced from the pages (every fragment)."""
    return lo.page_dictionary(lo.text_fragments(M.table(spark, d, "pages")))


@register("localise_pages", M.cte(f=_FRAG, dct=_DICT) + f"""
SELECT f.page_id, f.pos, f.raw,
  CASE WHEN dct.dst IS NOT NULL AND dct.dst <> ''
       THEN {Q.leading_ws('f.raw')} || dct.dst || {Q.trailing_ws('f.raw')}
       ELSE f.raw END AS translated
FROM f LEFT JOIN dct ON f.key = dct.src
""")
def q_localise(spark, d):
    """K2 + C6 + I9 + I10: page text translated, whitespace kept.

    The fragments feed both the dictionary and the lookup, so they are
    written once instead of running the HTML regexes twice."""
    from ..operators.joins import materialize

    frags = materialize(lo.text_fragments(M.table(spark, d, "pages")))
    dct = lo.page_dictionary(frags).select("src", "dst")
    out = lo.translate(frags, "raw", dct, "translated")
    return out.select("page_id", "pos", "raw", "translated")


_PAIRS = """
SELECT * FROM (
  SELECT name AS src, name_bn AS dst, 0 AS k, collection, name AS pname, size, id FROM px
  UNION ALL
  SELECT description, description_bn, 1, collection, name, size, id FROM px)
WHERE src IS NOT NULL AND src <> '' AND dst IS NOT NULL AND dst <> ''
"""


@register("translation_pairs", M.cte(px=M.PRODUCTS_EXT_SQL, pr=_PAIRS) + """
SELECT src, dst, k FROM pr
""")
def q_pairs(spark, d):
    """G1: translation pairs registered by the storefront."""
    return lo.translation_pairs(M.products(spark, d, extended=True)).select("src", "dst", "k")


_OVERLAY = f"""
SELECT src, arg_max(dst, source) AS dst FROM (
  SELECT src, max(dst) AS dst, 0 AS source FROM dct
  WHERE dst IS NOT NULL AND dst <> '' AND src <> '' GROUP BY src
  UNION ALL
  SELECT {Q.norm_text('src')} AS src,
         arg_max(dst, (collection, pname, size IS NULL, size, id)) AS dst, 1 AS source
  FROM pr GROUP BY {Q.norm_text('src')})
GROUP BY src
"""


@register("overlay_dictionary", M.cte(px=M.PRODUCTS_EXT_SQL, pr=_PAIRS, f=_FRAG, dct=_DICT)
          + _OVERLAY)
def q_overlay(spark, d):
    """Page dictionary overlaid with the product pairs (later wins)."""
    frags = lo.text_fragments(M.table(spark, d, "pages"))
    base = lo.page_dictionary(frags).select("src", "dst")
    pairs = lo.translation_pairs(M.products(spark, d, extended=True))
    return lo.overlay_dictionary(base, pairs)


@register("translate_products", M.cte(px=M.PRODUCTS_EXT_SQL, pr=_PAIRS, f=_FRAG, dct=_DICT)
          + f""", ov AS ({_OVERLAY})
SELECT px.id,
  CASE WHEN a.dst IS NOT NULL AND a.dst <> ''
       THEN {Q.leading_ws('px.name')} || a.dst || {Q.trailing_ws('px.name')}
       ELSE px.name END AS name_t,
  CASE WHEN b.dst IS NOT NULL AND b.dst <> ''
       THEN {Q.leading_ws('px.description')} || b.dst || {Q.trailing_ws('px.description')}
       ELSE px.description END AS description_t
FROM px LEFT JOIN ov a ON {Q.norm_text('px.name')} = a.src
        LEFT JOIN ov b ON {Q.norm_text('px.description')} = b.src
""")
def q_translate_products(spark, d):
    """Product names and descriptions through the overlay dictionary."""
    px = M.products(spark, d, extended=True)
    frags = lo.text_fragments(M.table(spark, d, "pages"))
    base = lo.page_dictionary(frags).select("src", "dst")
    ov = lo.materialized(lo.overlay_dictionary(base, lo.translation_pairs(px)))
    out = lo.translate(lo.translate(px, "name", ov, "name_t"), "description", ov,
                       "description_t")
    return out.select("id", "name_t", "description_t")


@register("localised_pages", M.cte(f=_FRAG, dct=_DICT, tk=Q.page_tokens()) + f"""
SELECT page_id, md5(any_value(head) || string_agg(new, '' ORDER BY i) || any_value(tail)) AS html_md5,
       count_if(new <> t) AS n_texts
FROM (SELECT tk.*, CASE WHEN dct.dst IS NULL OR dct.dst = '' THEN t ELSE
               replace(replace(replace({Q.leading_ws('f.raw')} || dct.dst || {Q.trailing_ws('f.raw')},
                 '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END AS new
      FROM tk LEFT JOIN f ON tk.page_id = f.page_id AND tk.i = f.i LEFT JOIN dct ON f.key = dct.src)
GROUP BY page_id
""")
def q_localised_pages(spark, d):
    """K2: whole pages with their translated text put back (as digests)."""
    pages = M.table(spark, d, "pages")
    frags = lo.materialize(lo.text_fragments(pages))
    dct = lo.materialized(lo.page_dictionary(frags).select("src", "dst"))
    out = lo.localised_pages(pages, dct)
    return out.select("page_id", F.md5(F.col("html").cast("binary")).alias("html_md5"), "n_texts")


def _tag_pages(spark, d):
    """Pages with translatable attributes, one per part: written with double,
    single and no quotes, on elements that count and on one that does not."""
    p = M.table(spark, d, "part")
    return p.select(p.p_partkey.alias("page_id"), F.concat(
        F.lit('<body><img alt="'), "p_name", F.lit('" title=\''), "p_type",
        F.lit("'><input placeholder="), "p_brand", F.lit('><b placeholder="no">x</b><textarea placeholder="'),
        "p_name", F.lit('">title="no"</textarea></body>')).alias("html"))


@register("page_attributes", """
SELECT p_partkey AS page_id, v.pos, v.attr,
       CASE v.pos WHEN 1 THEN p_type WHEN 2 THEN p_brand ELSE p_name END AS raw
FROM part, (VALUES (0, 'alt'), (1, 'title'), (2, 'placeholder'), (3, 'placeholder')) v(pos, attr)
""")
def q_attributes(spark, d):
    """K2 attributes (placeholder/title/alt/aria-label values)."""
    return lo.attribute_values(_tag_pages(spark, d)).select("page_id", "pos", "attr", "raw")


# Link targets of the pages that stand for the shop's asset files.
_ASSETS = ['/the"', '/and"', '/der"', '/und"', '/de"', '/la"', '/que"']


def _assets_sql() -> str:
    out = "html"
    for n in _ASSETS:
        out = f"replace({out}, '{n}', '/static{n}')"
    return out


@register("asset_paths", f"SELECT page_id, md5({_assets_sql()}) AS html_md5, {_assets_sql()} <> html AS changed FROM pages")
def q_asset_paths(spark, d):
    """A5: asset names in the pages get the static folder as prefix."""
    from ..sources import rewrite_asset_paths

    out = rewrite_asset_paths(M.table(spark, d, "pages"), "html", _ASSETS, "/static", "new")
    return out.select("page_id", F.md5(F.col("new").cast("binary")).alias("html_md5"),
                      (F.col("new") != F.col("html")).alias("changed"))
