"""Scans, sinks and schema handling."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..operators.joins import materialize
from ..session import shuffles_dropped
from . import schema as S


# A1 -------------------------------------------------------------------------
def load_products(spark: SparkSession, path: str) -> DataFrame:
    """Products snapshot (parquet).  Columns added later are aligned in."""
    return align_schema(spark.read.parquet(path), S.PRODUCTS, S.PRODUCT_DEFAULTS)


def load_orders(spark: SparkSession, path: str) -> DataFrame:
    return align_schema(spark.read.parquet(path), S.ORDERS, S.ORDER_DEFAULTS)


def load_jdbc(spark: SparkSession, url: str, table: str, key: str,
              lower: int, upper: int, partitions: int,
              properties: dict | None = None) -> DataFrame:
    """A Postgres table read in ``partitions`` parallel key ranges.

    Untested here: no database or driver is available in this build.
    """
    return spark.read.jdbc(url, table, column=key, lowerBound=lower,
                           upperBound=upper, numPartitions=partitions,
                           properties=properties or {})


# A2 / A3 --------------------------------------------------------------------
def read_order_json(spark: SparkSession, path: str,
                    multiline: bool = True) -> DataFrame:
    """Order documents; a missing or corrupt file gives zero rows.

    DROPMALFORMED (not PERMISSIVE, which yields one all-NULL row for a
    corrupt file); a path that does not exist gives an empty frame with the
    document schema.
    """
    try:
        return (spark.read.schema(S.ORDER_DOCUMENT)
                .option("multiLine", multiline)
                .option("mode", "DROPMALFORMED")
                .json(path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], S.ORDER_DOCUMENT)
        raise


def write_order_json(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Replace the order documents at ``path`` (JSON lines, one per order),
    compressed if a codec is named.

    Spark cannot overwrite a path it is reading in the same plan, so the
    caller writes a new snapshot path and switches readers to it.
    """
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").json(path, compression=compression)


BAD_DOCUMENT = ("empty", "bad json", "no list", "no order")


# Files up to this size are parsed as a whole by one task.
WHOLE_BYTES = 16 << 20

# A packed file counts as so many times its size.
PACKED = ".gz"
PACKED_TIMES = 32


def order_documents(spark: SparkSession, path: str, stream: bool = False,
                    whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Orders of a folder of documents, one JSON list of orders a file, as a
    table or as a stream of arriving files.

    Columns: file, reason, and the fields of an order.  A file that gives no
    orders (empty, half-written, no list) is one row with the reason and no
    fields, and so is each entry of a list that is no object; the shop would
    take such a file as an empty list.  An empty list gives no row, nor does a
    file of no bytes at all (Spark's file sources pass over those).  A missing
    folder gives an empty table (a stream needs the folder).

    A table's files of more than ``whole_bytes`` are read line by line, split
    over tasks, if they hold one order a line (as ``write_order_documents``
    writes them); other files, and a stream's, are read file by file.  A
    table's files named ``.gz`` are unpacked; such a large one is not split.
    """
    reader = spark.readStream if stream else spark.read
    try:
        files = reader.format("binaryFile").schema(
            "path string, modificationTime timestamp, length long, content binary").load(path)
    except AnalysisException as e:
        if stream or not ("PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e)):
            raise
        fields = [T.StructField("file", T.StringType()), T.StructField("reason", T.StringType())]
        return spark.createDataFrame([], T.StructType(fields + list(S.ORDER_DOCUMENT.fields)))
    if stream:
        return _whole_documents(files)
    # Plain comparisons of the length: the scan passes over longer files' contents.
    packed, whole_packed = F.col("path").endswith(PACKED), whole_bytes // PACKED_TIMES
    small = files.where(~packed).where(F.col("length") <= whole_bytes)
    small_packed = files.where(packed).where(F.col("length") <= whole_packed)
    large = files.where(F.col("length") > F.when(packed, whole_packed).otherwise(whole_bytes))
    names = large.select(F.col("path").alias("file"), F.col("_metadata.file_path").alias("at"))
    out = _whole_documents(small)
    if not small_packed.select("path").isEmpty():
        out = out.unionByName(_whole_documents(_unpacked(small_packed)))
    if names.isEmpty():
        return out
    listed = materialize(names.join(_files_by_line(_document_lines(spark, path, whole_bytes, damaged=True)), "at", "left"))
    # Names of large files only, which the file listing holds already.
    others = [r["at"] for r in listed.where("by_line IS NOT TRUE").select("at").collect()]
    lines = _document_lines(spark, path, whole_bytes).where(~F.col("at").isin(others))
    out = out.unionByName(_orders_by_line(lines, listed.where("by_line")))
    for is_packed in (False, True):
        if some := [at for at in others if at.endswith(PACKED) == is_packed]:
            whole = files.where(F.col("_metadata.file_path").isin(some))
            out = out.unionByName(_whole_documents(_unpacked(whole) if is_packed else whole))
    return out


def _unpacked(files: DataFrame) -> DataFrame:
    """Paths and contents of packed files, the latter as they are where they
    cannot be unpacked (a half-written file)."""
    def unpacked(batches):
        for b in batches:
            for at, content in zip(b.column(0), b.column(1)):
                data = content.as_py()
                try:
                    data = gzip.decompress(data)
                except (OSError, EOFError, zlib.error):
                    pass
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at.as_py()], pa.string()), pa.array([data], pa.binary())], names=["path", "content"])

    return files.select("path", "content").mapInArrow(unpacked, "path string, content binary")


def _whole_documents(files: DataFrame) -> DataFrame:
    text = F.make_valid_utf8(F.col("content").cast("string"))
    files = files.select(F.col("path").alias("file"), F.regexp_replace(
        text, r"^[\uFEFF\s]+|\s+$", "").alias("body"))
    empty, bad, no_list, no_order = (F.lit(x) for x in BAD_DOCUMENT)
    reason = (F.when(F.col("body") == "", empty).when(F.try_parse_json("body").isNull(), bad)
              .when(~F.col("body").startswith("["), no_list))
    files = files.select("file", "body", reason.alias("reason"))
    entries = F.from_json(F.when(F.col("reason").isNull(), F.col("body")), T.ArrayType(T.StringType()))
    rows = files.select("file", "reason", F.explode_outer(F.when(F.col("reason").isNotNull(), F.array(F.lit(None).cast(
        "string"))).otherwise(F.transform(entries, lambda x: F.coalesce(x, F.lit("null"))))).alias("entry"))
    rows = rows.where(F.col("reason").isNotNull() | F.col("entry").isNotNull())        # empty lists
    order = F.when(F.ltrim("entry").startswith("{"), F.from_json("entry", S.ORDER_DOCUMENT))
    rows = rows.select("file", F.coalesce("reason", F.when(order.isNull(), no_order)).alias("reason"), order.alias("o"))
    return rows.select("file", "reason", "o.*")


def _document_lines(spark: SparkSession, path: str, whole_bytes: int, damaged: bool = False) -> DataFrame:
    """Lines of the large files: (at, pos, sign, entry), blank ones left out;
    ``sign`` is the line's first character, ``entry`` the rest (the whole line
    where an object begins it).  ``damaged``: of a packed file that breaks off,
    the lines before that, instead of an error."""
    most = F.when(F.col("_metadata.file_path").endswith(PACKED), whole_bytes // PACKED_TIMES).otherwise(whole_bytes)
    reader = spark.read.option("ignoreCorruptFiles", True) if damaged else spark.read
    lines = reader.text(path).where(F.col("_metadata.file_size") > most)
    line = F.btrim(F.make_valid_utf8("value"), F.lit(" \t"))
    # The block's place in the file, then the line's in the block: one number, so
    # that the least and the greatest need no sort of the lines.
    block, wide = F.col("_metadata.file_block_start"), "decimal(19,0)"
    pos = block.cast(wide) * F.lit(1 << 62).cast(wide) + F.monotonically_increasing_id().cast(wide)
    lines = lines.select(F.col("_metadata.file_path").alias("at"), pos.alias("pos"), line.alias("line"))
    return lines.where(F.col("line") != "").select(
        "at", "pos", F.substring("line", 1, 1).alias("sign"),
        F.expr("if(startswith(line, '{'), line, ltrim(substring(line, 2)))").alias("entry"))


def _files_by_line(lines: DataFrame) -> DataFrame:
    """(at, by_line): whether a file is a list with one object a line: the
    first beside the opening bracket or alone on the next line, each further
    one after a comma, and the closing bracket on a line of its own."""
    opens, bare = F.col("sign") == "[", F.col("sign") == "{"
    alone, ends = opens & (F.col("entry") == ""), (F.col("sign") == "]") & (F.col("entry") == "")
    order = F.col("sign").isin("[", ",", "{") & F.col("entry").startswith("{") & F.try_parse_json("entry").isNotNull()

    def first(when):
        return F.min(F.when(when, F.col("pos")))

    by = lines.groupBy("at").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), first(opens).alias("open"), first(ends).alias("end"),
        first(~opens & order).alias("next"), first(bare).alias("bare"), F.count_if(opens).alias("opens"),
        F.count_if(ends).alias("ends"), F.count_if(alone).alias("alone"), F.count_if(bare).alias("bares"),
        F.count_if(~(order | alone | ends)).alias("bad"))
    second = F.col("next").isNull() | ((F.col("bares") == 1) & (F.col("next") == F.col("bare")))
    ok = ((F.col("opens") == 1) & (F.col("ends") == 1) & (F.col("bad") == 0) & (F.col("first") == F.col("open"))
          & (F.col("last") == F.col("end")) & F.when(F.col("alone") == 1, second).otherwise(F.col("bares") == 0))
    return by.select("at", F.coalesce(ok, F.lit(False)).alias("by_line"))


def _orders_by_line(lines: DataFrame, files: DataFrame) -> DataFrame:
    # One row per large file: a proven broadcast bound.
    rows = lines.where(F.col("entry") != "").join(F.broadcast(files.select("at", "file")), "at")
    return rows.select("file", F.lit(None).cast("string").alias("reason"),
                       F.from_json("entry", S.ORDER_DOCUMENT).alias("o")).select("file", "reason", "o.*")


def write_order_documents(df: DataFrame, path: str, files: int, key: str = "id",
                          make: Callable[[DataFrame], DataFrame] | None = None,
                          compression: str | None = None) -> None:
    """Orders as a folder of documents, a JSON list a file, newest first
    within a file; a task passes its orders on line by line.  ``make`` gives the
    documents of rows already dealt to files (a projection, so that its texts
    need no shuffle); files are compressed if a codec is named."""
    rows = df.repartition(files, key).sortWithinPartitions(F.desc(key))
    docs = rows if make is None else make(rows)
    lines = docs.select(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).alias("v"))

    def listed(batches):
        first = True
        for b in batches:
            if b.num_rows:
                rows = b.column(0).to_pylist()
                rows = [("" if first and i == 0 else ",") + r for i, r in enumerate(rows)]
                yield pa.RecordBatch.from_arrays([pa.array((["["] if first else []) + rows)], names=["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names=["value"])

    with shuffles_dropped(df.sparkSession):
        lines.mapInArrow(listed, "value string").write.mode("overwrite").text(path, compression=compression)


# A4 -------------------------------------------------------------------------
def to_json_rows(df: DataFrame, column: str = "json", keep: list[str] | None = None,
                 keep_nulls: bool = True) -> DataFrame:
    """One JSON text per row, all columns (the API's response rows).

    NULL fields are written as ``null`` (as the database driver's rows are
    serialised), unless ``keep_nulls`` is False.  ``keep`` columns are
    carried beside the text.
    """
    opts = {"ignoreNullFields": "false" if keep_nulls else "true"}
    return df.select(*(keep or []), F.to_json(F.struct("*"), opts).alias(column))


# A5 -------------------------------------------------------------------------
def rewrite_asset_paths(df: DataFrame, text_col: str, names: list[str],
                        prefix: str, out_col: str | None = None) -> DataFrame:
    """Replace every occurrence of each asset name by prefix + name.

    The names are a short literal list (a page's own asset files), folded
    into one expression; each replacement hits all occurrences.
    """
    expr: Column = F.col(text_col)
    for n in names:
        expr = F.replace(expr, F.lit(n), F.lit(prefix + n))
    return df.withColumn(out_col or text_col, expr)


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, value) rows."""
    # ``text``'s own ``wholetext`` argument (an ``option`` set before the
    # call would be overridden by its default).
    return (spark.read.text(path, wholetext=True)
            .withColumn("path", F.input_file_name()))


# A6 -------------------------------------------------------------------------
# Our own example rows (not the shop's prose).
SEED_ROWS = [
    ("womens", "weave", "Handloom Wrap", None, 1499, 10, "wrap_1.jpg",
     "Hand-woven wrap in a two-colour stripe."),
    ("womens", "weave", "Festival Wrap", None, 2199, 5, "wrap_2.jpg",
     "Heavier wrap with a woven border."),
    ("mens", "stripe", "Stripe Shirt", "S", 1299, 8, "shirt_1.jpg",
     "Cotton shirt with a narrow stripe."),
    ("mens", "stripe", "Stripe Shirt", "M", 1299, 12, "shirt_1.jpg",
     "Cotton shirt with a narrow stripe."),
    ("mens", "stripe", "Stripe Shirt", "L", 1299, 6, "shirt_1.jpg",
     "Cotton shirt with a narrow stripe."),
    ("mens", "stripe", "Daily Shirt", "S", 849, 0, "shirt_2.jpg",
     "Light everyday shirt."),
    ("mens", "stripe", "Daily Shirt", "M", 849, 14, "shirt_2.jpg",
     "Light everyday shirt."),
]

SEED_SCHEMA = T.StructType([S.PRODUCTS[f] for f in
                            ["gender", "collection", "name", "size", "price",
                             "stock", "image", "description"]])


def seed_rows(spark: SparkSession, rows: list | None = None) -> DataFrame:
    return spark.createDataFrame(rows if rows is not None else SEED_ROWS, SEED_SCHEMA)


# A7 -------------------------------------------------------------------------
# --- Fixed values: the shop's column defaults ---
PRODUCT_DEFAULTS = {"stock": "0", "active": "true", "created_at": "current_timestamp()"}
ORDER_DEFAULTS = {"quantity": "1", "status": "'received'", "ordered_at": "current_timestamp()",
                  "updated_at": "current_timestamp()", "payment_status": "'pending'"}


def _ddl_type(dt: T.DataType) -> str:
    return dt.simpleString().upper()


def ensure_table(spark: SparkSession, name: str, schema: T.StructType,
                 location: str | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """CREATE TABLE IF NOT EXISTS .. USING parquet; returns the table.

    ``defaults`` has SQL expressions by column: what an insert that leaves the
    column out puts there (see ``PRODUCT_DEFAULTS``, ``ORDER_DEFAULTS``)."""
    given = defaults or {}
    unknown = set(given) - {f.name for f in schema.fields}
    if unknown:
        raise ValueError(f"defaults of no column: {sorted(unknown)}")
    cols = ", ".join(f"`{f.name}` {_ddl_type(f.dataType)}"
                     + (f" DEFAULT {given[f.name]}" if f.name in given else "") for f in schema.fields)
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet{loc}")
    return spark.table(name)


# A8 -------------------------------------------------------------------------
def align_schema(df: DataFrame, schema: T.StructType,
                 defaults: dict | None = None) -> DataFrame:
    """Additive migration: add each missing column (default or NULL), cast
    present ones to the declared type, and order columns as declared.

    Columns not in ``schema`` are kept at the end (never dropped).
    """
    defaults = defaults or {}
    have = {c.lower(): c for c in df.columns}
    cols = []
    for f in schema.fields:
        if f.name.lower() in have:
            cols.append(F.col(f"`{have[f.name.lower()]}`").cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
    names = {f.name.lower() for f in schema.fields}
    extra = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*cols, *extra)


# A9 -------------------------------------------------------------------------
class load_cached:
    """Context manager that persists a scan for reuse and releases it.

    with load_cached(df) as d: ... two actions on d ...
    """

    def __init__(self, df: DataFrame, level=None):
        from pyspark import StorageLevel

        self.df = df
        self.level = level or StorageLevel.MEMORY_AND_DISK

    def __enter__(self) -> DataFrame:
        return self.df.persist(self.level)

    def __exit__(self, *exc) -> None:
        self.df.unpersist()
