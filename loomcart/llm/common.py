"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space that separates words: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text (no empty entries)."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def crc_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``modulus``; a null id
    counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(modulus))


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one ``spark.checkpoint.dir`` names.

    Only a local session in which none is set (tests) gets a folder of its
    own; on a cluster a missing setting is an error, since executors do not
    share local folders.
    """
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(conf)
        return conf.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    import tempfile

    made = tempfile.mkdtemp(prefix="loomcart-llm-")
    sc.setCheckpointDir(made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: its
    lineage ends there, so a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive items of about ``limit`` total size (one
    larger item forms its own range)."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def read_as_is(df: DataFrame) -> bool:
    """Whether ``df`` is one file table, filtered and projected only."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    return node.nodeName().startswith("LogicalRelation") or node.nodeName().startswith("Relation")


def numbered(df: DataFrame, name: str, out: str) -> DataFrame:
    """``df`` with a column ``out`` that tells its rows apart and stays with a
    row however often it is read: the row's place in its file if ``df`` is a
    Parquet table read as it is, else a number in a table written here."""
    if read_as_is(df):
        try:
            return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"),
                                           F.col("_metadata.row_index").alias("place")).alias(out))
        except AnalysisException:              # files without places
            pass
    return written(df.withColumn(out, F.monotonically_increasing_id()), name)
