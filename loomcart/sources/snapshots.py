"""Tables kept as versions of buckets (for H1-H12).

Rows lie in buckets by a hash of their id.  A commit writes only the buckets
that hold changed rows; a manifest names, for each bucket, the version that
holds it now, so all others are carried over by reference.  The manifest is
one small file written last: a reader sees one version or the other, never
half of one, and a commit that finds its version taken fails.

    path/data/v=<version>/bucket=<k>/..   rows
    path/manifest/<version>.json          {"buckets": n, "at": {k: version}}

The manifest holds at most ``buckets`` numbers; they and the touched buckets'
numbers are all that reaches the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "bucket"


class VersionTaken(RuntimeError):
    """Another commit wrote this version first."""


@dataclass(frozen=True)
class Commit:
    version: int
    touched: list[int]             # buckets written


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = T.StructType([f for f in schema.fields if f.name != BUCKET])

    # -- files ---------------------------------------------------------------
    def _fs(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(sc._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int) -> dict:
        text = self.spark.read.text(f"{self.path}/manifest/{version}.json", wholetext=True).first()[0]
        found = json.loads(text)
        return {"buckets": found["buckets"], "at": {int(k): v for k, v in found["at"].items()}}

    def _publish(self, version: int, buckets: int, at: dict[int, int]) -> None:
        p, fs = self._fs(f"{self.path}/manifest/{version}.json")
        if fs.exists(p):
            raise VersionTaken(f"{self.path}: version {version}")
        try:
            out = fs.create(p, False)              # fails where the file exists
        except Exception as e:
            raise VersionTaken(f"{self.path}: version {version}") from e
        out.write(bytearray(json.dumps({"buckets": buckets, "at": at}).encode()))
        out.close()

    def _bucket(self, n: int) -> Column:
        """A null id has bucket 0."""
        return F.coalesce(F.pmod(F.xxhash64(self.key), F.lit(n)), F.lit(0)).cast("int")

    # -- use -----------------------------------------------------------------
    def create(self, rows: DataFrame, buckets: int = 64) -> Commit:
        """Version 0 of the table."""
        return self._commit(rows.withColumn(BUCKET, self._bucket(buckets)), 0, buckets, {}, None)

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version (the newest by default), with ``bucket``;
        filters on it skip the other buckets' files."""
        known = self.versions()
        version = known[-1] if version is None and known else version
        if version not in known:
            raise ValueError(f"{self.path} has no version {version}")
        at = self.manifest(version)["at"]
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        if not at:
            return self.spark.createDataFrame([], schema)
        # One base path per version; buckets keep their partition column.
        parts = None
        for v in sorted(set(at.values())):
            base = f"{self.path}/data/v={v}"
            paths = [f"{base}/{BUCKET}={k}" for k in sorted(at) if at[k] == v]
            part = self.spark.read.schema(schema).option("basePath", base).parquet(*paths)
            parts = part if parts is None else parts.unionByName(part)
        return parts

    def commit(self, table: DataFrame, changed: DataFrame, version: int | None = None) -> Commit:
        """The next version: ``table`` where ``changed`` (rows or ids inserted,
        updated or deleted) has rows, the version before everywhere else.
        ``table`` is made from :meth:`read`'s rows with their ``bucket``; new
        rows may lack it."""
        last = self.versions()[-1] if version is None else version - 1
        before = self.manifest(last)
        n = before["buckets"]
        touched = sorted(r[0] for r in changed.select(self._bucket(n).alias(BUCKET)).distinct().collect())
        if BUCKET in table.columns:
            # Old rows are pruned by the partition column, new ones have none yet.
            some = table.where(F.col(BUCKET).isin(touched) | F.col(BUCKET).isNull())
        else:
            some = table
        some = some.withColumn(BUCKET, self._bucket(n)).where(F.col(BUCKET).isin(touched))
        return self._commit(some, last + 1, n, before["at"], touched)

    def _commit(self, rows: DataFrame, version: int, n: int, before: dict[int, int],
                touched: list[int] | None) -> Commit:
        if version in self.versions():
            raise VersionTaken(f"{self.path}: version {version}")
        at = {k: v for k, v in before.items() if touched is not None and k not in touched}
        full = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        if touched != []:
            data = f"{self.path}/data/v={version}"
            rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], BUCKET)
            # One shuffle by bucket: a file or so for each.
            rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(data)
            written = self.spark.read.schema(full).parquet(data).select(BUCKET).distinct().collect()
            at |= {r[0]: version for r in written}
            touched = sorted(r[0] for r in written) if touched is None else touched
        self._publish(version, n, at)
        return Commit(version, touched or [])
