"""Scalar Column functions (formatting, normalisation, hashing)."""

from .scalar import (  # noqa: F401
    blank_to_null, hmac_sha256_hex, hmac_sql_pads, image_src, indian_grouping,
    iso_utc, js_text, leading_ws, norm_text, normalise_phone, number_or,
    optional_piece, parse_amount, phone_is_valid, receipt, rupees,
    size_rank, size_suffix_dash, size_suffix_paren, sku, text_or, to_paise,
    to_rupees, trailing_ws, trim_ws, truthy_text, variant_display_name,
)
