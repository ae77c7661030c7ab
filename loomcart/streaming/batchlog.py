"""Tables that grow by micro-batch: one part per batch id, compacted now and
then.

A part is overwritten when its batch is retried, and a batch reads only what
earlier batches wrote, so a retry gives the same result.  A compaction writes
one base table from everything up to its batch; it counts once it is complete.
Of the older data just the generation before stays, which a retry of the
compacting batch needs.  So a reader opens one base and at most
``compact_every`` parts (twice that after a compaction that failed), however
long the stream has run.

The folder belongs to one stream checkpoint, which numbers its batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BatchLog:
    """Rows of ``schema`` by batch; readers get them with a ``version`` column
    (the batch id).  ``reduce`` turns all rows, with their versions, into those
    a base keeps."""

    def __init__(self, spark: SparkSession, path: str, schema: str,
                 reduce: Callable[[DataFrame], DataFrame], compact_every: int = 20,
                 partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.reduce = spark, path.rstrip("/"), reduce
        self.schema = T._parse_datatype_string(f"{schema}, version long")
        self.compact_every, self.partition_by = compact_every, partition_by

    # -- folders -------------------------------------------------------------
    def _fs(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(sc._jsc.hadoopConfiguration())

    def _ids(self, kind: str) -> list[int]:
        """Batch ids of the complete tables of a kind, ascending."""
        folder, fs = self._fs(f"{self.path}/kind={kind}")
        if not fs.exists(folder):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
        ids = sorted(int(n.removeprefix("at=")) for n in found)
        return [b for b in ids if fs.exists(self._fs(self._folder(kind, b) + "/_SUCCESS")[0])]

    def _folder(self, kind: str, batch_id: int) -> str:
        return f"{self.path}/kind={kind}/at={batch_id}"

    def _write(self, rows: DataFrame, kind: str, batch_id: int) -> None:
        w = rows.write.mode("overwrite").option("compression", "zstd")
        if self.partition_by:
            w = w.partitionBy(*self.partition_by)
        w.parquet(self._folder(kind, batch_id))

    # -- use -----------------------------------------------------------------
    def before(self, batch_id: int) -> DataFrame:
        """What the batches before this one wrote."""
        bases = [b for b in self._ids("base") if b < batch_id]
        since = bases[-1] if bases else -1
        paths = [self._folder("base", since)] if bases else []
        paths += [self._folder("parts", b) for b in self._ids("parts") if since < b < batch_id]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*paths)
        return rows.select(*self.schema.names)

    def last(self) -> DataFrame:
        """What all batches wrote."""
        return self.before(2 ** 62)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """The batch's rows; compacts when the batch is due for it."""
        names = [f.name for f in self.schema if f.name != "version"]
        self._write(rows.select(*names, F.lit(batch_id).cast("long").alias("version")), "parts", batch_id)
        if (batch_id + 1) % self.compact_every == 0:
            self.compact(batch_id)

    def compact(self, batch_id: int) -> None:
        """One base of everything up to this batch."""
        older = [b for b in self._ids("base") if b < batch_id]
        self._write(self.reduce(self.before(batch_id + 1)).select(*self.schema.names), "base", batch_id)
        if older:
            for kind, upto in (("base", older[-1] - 1), ("parts", older[-1])):
                for b in self._ids(kind):
                    if b <= upto:
                        p, fs = self._fs(self._folder(kind, b))
                        fs.delete(p, True)


def newest(key: str) -> Callable[[DataFrame], DataFrame]:
    """Reduces rows to the newest version of each key."""
    def reduce(rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c != key]
        return rows.groupBy(key).agg(F.max_by(F.struct(*others), "version").alias("__r")).select(
            key, *[F.col("__r")[c].alias(c) for c in others])
    return reduce
