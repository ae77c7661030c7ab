"""Scans, sinks, schemas."""

from . import schema  # noqa: F401
from .io import (  # noqa: F401
    ORDER_DEFAULTS, PRODUCT_DEFAULTS, align_schema, ensure_table, load_cached, load_jdbc, load_orders,
    load_products, order_documents, read_order_json, read_whole_texts, rewrite_asset_paths,
    seed_rows, to_json_rows, write_order_documents, write_order_json,
)
from .snapshots import BucketedTable, Commit, VersionTaken  # noqa: F401
