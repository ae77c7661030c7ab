"""Column-returning scalar functions.

All of them are plain Catalyst expressions (no Python UDF), so they stay
inside whole-stage codegen and are pushed wherever Spark can push them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# JavaScript's whitespace set (its \s, and what trim() strips), spelled out
# so Java and RE2 (the SQL oracle) read it the same way.  It includes
# U+00A0 and U+FEFF, which Java's plain \s misses.
_WS = (r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
       r"\x{202F}\x{205F}\x{3000}\x{FEFF}]")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# I1 ------------------------------------------------------------------------
def sku(id_col) -> Column:
    """SKU text for an id: prefix plus id zero-padded to >= 4 digits.

    ``format_string`` pads without truncating (12345 stays 12345); ``lpad``
    would cut it to four characters.
    """
    return F.format_string(K.SKU_FORMAT, _c(id_col).cast("long"))


# I2 ------------------------------------------------------------------------
def trim_ws(s) -> Column:
    """Trim Unicode whitespace (incl. U+00A0, U+FEFF) at both ends."""
    return F.regexp_replace(_c(s), rf"^{_WS}+|{_WS}+$", "")


def blank_to_null(s) -> Column:
    """Trimmed text, or NULL when nothing is left."""
    return F.nullif(trim_ws(s), F.lit(""))


# I3 ------------------------------------------------------------------------
def text_or(s, default) -> Column:
    """``s || default`` for text: NULL and '' take the default."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(_c(s), F.lit("")), d)


def number_or(x, default) -> Column:
    """``x || default`` for numbers: NULL and 0 take the default."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(_c(x), F.lit(0)), d)


def truthy_text(s) -> Column:
    """JavaScript truthiness of a text value: not NULL and not ''."""
    return F.coalesce(_c(s) != F.lit(""), F.lit(False))


# I4 ------------------------------------------------------------------------
def indian_grouping(n) -> Column:
    """Integer text with Indian digit grouping: 12345678 -> 1,23,45,678."""
    return F.regexp_replace(_c(n).cast("long").cast("string"),
                            r"(\d)(?=(\d\d)+\d$)", "$1,")


def rupees(n) -> Column:
    """Price text as the storefront shows it: '₹ 1,23,456'."""
    return F.concat(F.lit(K.RUPEE_PREFIX), indian_grouping(n))


# I5 ------------------------------------------------------------------------
def parse_amount(s) -> Column:
    """Price text back to an integer: drop every non-digit; none -> NULL."""
    return F.expr(f"try_cast(regexp_replace({_sql(s)}, '[^0-9]', '') AS INT)")


def _sql(s) -> str:
    if isinstance(s, str):
        return f"`{s}`"
    raise TypeError("parse_amount takes a column name")


# I6 ------------------------------------------------------------------------
def to_paise(rupee) -> Column:
    return F.round(_c(rupee) * 100).cast("long")


def to_rupees(paise) -> Column:
    """Paise to whole rupees, half up (equal to JS Math.round for x >= 0)."""
    return F.round(_c(paise) / 100).cast("long")


# I7 ------------------------------------------------------------------------
def normalise_phone(p) -> Column:
    """Digits only, one leading '91' or '0' removed, last ten digits kept.

    A bare ten-digit number that starts with 91 loses those two digits and
    is then invalid -- the shop behaves the same way.
    """
    digits = F.regexp_replace(_c(p), r"\D", "")
    return F.right(F.regexp_replace(digits, r"^(91|0)", ""), F.lit(10))


def phone_is_valid(p) -> Column:
    return F.coalesce(F.length(normalise_phone(p)) == 10, F.lit(False))


# I8 ------------------------------------------------------------------------
def image_src(img) -> Column:
    """Storefront image URL.

    Empty -> ''; no http(s) scheme -> static prefix; image-CDN URL with an
    upload segment -> delivery transform inserted after the *first*
    '/upload/' only; any other URL unchanged.
    """
    i = _c(img)
    is_url = i.rlike(r"(?i)^https?://")
    is_cdn = i.contains(K.CDN_HOST) & i.contains(K.CDN_UPLOAD_SEGMENT)
    first_upload = F.regexp_replace(i, r"^(.*?)/upload/",
                                    "$1" + K.CDN_TRANSFORM.replace("$", r"\$"))
    return (F.when(~truthy_text(i), F.lit(""))
            .when(~is_url, F.concat(F.lit(K.STATIC_PREFIX), i))
            .when(is_cdn, first_upload)
            .otherwise(i))


# I9 / I10 -----------------------------------------------------------------
def norm_text(s) -> Column:
    """Whitespace-normalised lookup key: runs of whitespace -> one space."""
    return F.trim(F.regexp_replace(_c(s), rf"{_WS}+", " "))


def leading_ws(s) -> Column:
    return F.regexp_extract(_c(s), rf"^({_WS}*)", 1)


def trailing_ws(s) -> Column:
    return F.regexp_extract(_c(s), rf"({_WS}*)$", 1)


# I11 ----------------------------------------------------------------------
def _hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    import hashlib

    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256_hex(message, key: str | bytes) -> Column:
    """HMAC-SHA256 of a text column, lower-case hex, as pure Catalyst.

    The key is a driver-side configuration value (never read from a table);
    only the two 64-byte pads enter the plan, as binary literals.
    """
    kb = key.encode("utf-8") if isinstance(key, str) else key
    ipad, opad = _hmac_pads(kb)
    msg = F.encode(_c(message), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(ipad)), msg), 256))
    return F.sha2(F.concat(F.lit(bytearray(opad)), inner), 256)


def hmac_sql_pads(key: str) -> tuple[str, str]:
    """Hex of the two pads, for SQL oracles (DuckDB ``unhex``)."""
    ipad, opad = _hmac_pads(key.encode("utf-8"))
    return ipad.hex(), opad.hex()


# I12 ----------------------------------------------------------------------
def epoch_millis_utc(as_of: str) -> int:
    """Epoch milliseconds of a wall-clock time read as UTC (independent of
    the session time zone)."""
    from datetime import datetime, timezone

    t = datetime.fromisoformat(as_of)
    if t.tzinfo is None:
        t = t.replace(tzinfo=timezone.utc)
    return int(t.timestamp() * 1000)


def receipt(r, as_of) -> Column:
    """Receipt id: given text, else prefix + epoch millis of as_of; <= 40.

    ``as_of`` text is read as UTC on the driver, so the default does not
    depend on the session time zone; a Column is used as is.
    """
    if isinstance(as_of, str):
        millis = F.lit(epoch_millis_utc(as_of)).cast("string")
    else:
        millis = F.unix_millis(as_of).cast("string")
    default = F.concat(F.lit(K.RECEIPT_PREFIX), millis)
    return F.substring(text_or(r, default), 1, K.RECEIPT_MAX_LEN)


# I13 / I16 ----------------------------------------------------------------
def js_text(x) -> Column:
    """A value as a JavaScript template literal prints it (NULL -> 'null')."""
    return F.coalesce(_c(x).cast("string"), F.lit("null"))


def optional_piece(x, before: str, after: str = "") -> Column:
    """before + x + after when x is truthy, else '' (never NULL)."""
    return F.when(truthy_text(_c(x).cast("string")),
                  F.concat(F.lit(before), _c(x).cast("string"), F.lit(after))
                  ).otherwise(F.lit(""))


def size_suffix_dash(size) -> Column:
    """' — Size M' (admin notice, order modal)."""
    return optional_piece(size, " — Size ")


def size_suffix_paren(size) -> Column:
    """' (Size M)' (customer notices, card buttons)."""
    return optional_piece(size, " (Size ", ")")


def variant_display_name(name, size) -> Column:
    return F.concat(js_text(name), size_suffix_dash(size))


# I15 ----------------------------------------------------------------------
def iso_utc(ts) -> Column:
    """ISO-8601 text with milliseconds and 'Z' (session time zone is UTC)."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# I17 ----------------------------------------------------------------------
def size_rank(size) -> Column:
    """Storefront size rank; unknown or NULL sizes rank 99."""
    m = F.create_map(*[x for k, v in K.SIZE_ORDER.items()
                       for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, _c(size)), F.lit(K.UNKNOWN_SIZE_RANK))
