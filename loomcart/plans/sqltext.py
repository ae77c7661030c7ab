"""SQL text snippets for the DuckDB oracles (no look-ahead regex there)."""

from __future__ import annotations

from .. import constants as K


def rupees(expr: str) -> str:
    """Indian digit grouping for a non-negative integer, as SQL text.

    Last three digits, then pairs: reverse the head, put a comma after each
    pair, drop a trailing comma, reverse back.
    """
    s = f"CAST(CAST({expr} AS BIGINT) AS VARCHAR)"
    head = f"left({s}, length({s}) - 3)"
    grouped = (f"reverse(rtrim(regexp_replace(reverse({head}), '(\\d\\d)', '\\1,', 'g'), ','))")
    return (f"'{K.RUPEE_PREFIX}' || CASE WHEN length({s}) <= 3 THEN {s} "
            f"ELSE {grouped} || ',' || right({s}, 3) END")


def image_src(expr: str) -> str:
    return (f"CASE WHEN {expr} IS NULL OR {expr} = '' THEN '' "
            f"WHEN NOT regexp_matches({expr}, '^https?://', 'i') THEN '{K.STATIC_PREFIX}' || {expr} "
            f"WHEN contains({expr}, '{K.CDN_HOST}') AND contains({expr}, '{K.CDN_UPLOAD_SEGMENT}') "
            f"THEN regexp_replace({expr}, '/upload/', '{K.CDN_TRANSFORM}') "
            f"ELSE {expr} END")


def size_rank(expr: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.SIZE_ORDER.items())
    return f"(CASE {expr} {whens} ELSE {K.UNKNOWN_SIZE_RANK} END)"


def optional_piece(expr: str, before: str, after: str = "") -> str:
    return (f"(CASE WHEN {expr} IS NOT NULL AND CAST({expr} AS VARCHAR) <> '' "
            f"THEN '{before}' || CAST({expr} AS VARCHAR) || '{after}' ELSE '' END)")


def js_text(expr: str) -> str:
    return f"coalesce(CAST({expr} AS VARCHAR), 'null')"


def normalise_phone(expr: str) -> str:
    digits = f"regexp_replace({expr}, '\\D', '', 'g')"
    return f"right(regexp_replace({digits}, '^(91|0)', ''), 10)"


def phone_valid(expr: str) -> str:
    return f"coalesce(length({normalise_phone(expr)}) = 10, false)"


def labels() -> str:
    """The collection label list used by the storefront queries."""
    return ("SELECT 'Brand#' || CAST(i AS VARCHAR) AS key, "
            "'Collection ' || CAST(i AS VARCHAR) AS label FROM range(1, 11) t(i)")


# JavaScript whitespace, as in functions.scalar (RE2 reads \x{..} too).
WS = (r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
      r"\x{202F}\x{205F}\x{3000}\x{FEFF}]")


def norm_text(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS}+', ' ', 'g'))"


def leading_ws(expr: str) -> str:
    return f"regexp_extract({expr}, '^({WS}*)', 1)"


def trailing_ws(expr: str) -> str:
    return f"regexp_extract({expr}, '({WS}*)$', 1)"


def decode_entities(expr: str) -> str:
    from ..operators.localise import ENTITIES

    out = expr
    for a, b in ENTITIES:
        out = f"replace({out}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return out


def page_tokens() -> str:
    """page_id, head, tail, i (from 0), t: the tokens of every page's body.
    RE2 has no look-ahead, so a "<" that opens nothing is a token of its own
    here; no given page holds one, nor an opted-out block or a numeric
    reference, and those are held to hand-worked values in the tests."""
    skipped = "|".join(f"<{t}\\b[^>]*>.*?(?:</{t}\\s*>|$)" for t in K.SKIPPED_ELEMENTS)
    tag = """</?[a-zA-Z][^>"'']*(?:"[^"]*"[^>"'']*|''[^'']*''[^>"'']*)*>"""
    body = """<body(?:\\s[^>"'']*(?:"[^"]*"[^>"'']*|''[^'']*''[^>"'']*)*)?>"""
    token = f"(?is)<!--.*?(?:-->|$)|{skipped}|{tag}|<[/!?][^>]*>|[^<]+|<"
    return f"""
SELECT page_id, head, unnest(range(0, len(tokens))) AS i, unnest(tokens) AS t, tail FROM (
  SELECT page_id, head, CASE WHEN n > 0 THEN list_slice(l, 1, n - 1) ELSE l END AS tokens,
         CASE WHEN n > 0 THEN array_to_string(list_slice(l, n, len(l)), '') ELSE '' END AS tail FROM (
    SELECT *, coalesce(list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)^</body')), true), 0) AS n
    FROM (SELECT page_id, head, regexp_extract_all(substr(html, length(head) + 1), '{token}', 0) AS l
          FROM (SELECT *, regexp_extract(html, '(?is)^(.*?{body})', 1) AS head FROM pages))))
"""


def page_text_fragments() -> str:
    """Non-blank text nodes of every page body."""
    return f"""
SELECT page_id, i, pos, raw, {norm_text('raw')} AS key FROM (
  SELECT page_id, i, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos,
         {decode_entities('t')} AS raw
  FROM ({page_tokens()}) WHERE NOT starts_with(t, '<'))
WHERE {norm_text('raw')} <> ''
"""
