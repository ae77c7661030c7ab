"""Bucketed versions: mutations equal the full rewrite and touch few files."""

import random

import pytest
from pyspark.sql import functions as F

from loomcart import sources as src
from loomcart.operators import mutations as mu
from loomcart.plans import mapping as M

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.fixture()
def table(spark, tmp_path):
    p = M.products(spark, SF)
    t = src.BucketedTable(spark, str(tmp_path / "products"), p.schema)
    first = t.create(p, buckets=32)
    assert first.version == 0 and len(first.touched) == 32
    return t, p


def test_patch_of_ten_rows_writes_ten_buckets_at_most(spark, table):
    t, p = table
    names = p.columns
    ids = [r.id for r in p.select("id").limit(10).collect()]
    changes = spark.createDataFrame([(i, 777, 1) for i in ids], "id long, stock int, seq long")
    done = mu.set_stock(t.read(), changes)
    c = t.commit(done.table, done.changed)
    assert c.version == 1 and 1 <= len(c.touched) <= 10
    assert rows_of(t.read().select(*names)) == rows_of(mu.set_stock(p, changes).table.select(*names))
    assert rows_of(t.read(0).select(*names)) == rows_of(p)              # the version before stays
    plan = done.table.where(F.col("bucket").isin(c.touched))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1].split("]")[0]


def test_chain_of_mutations_equals_full_rewrites(spark, table):
    """Soft deletes, inserts, patches, hard deletes and a de-duplication."""
    t, p = table
    names = p.columns
    rnd = random.Random(6)
    ids = [r.id for r in p.select("id").collect()]
    plain = p
    for k in range(3):
        some = spark.createDataFrame([(i,) for i in rnd.sample(ids, 7)], "id long")
        steps = [lambda x: mu.soft_delete(x, some), lambda x: mu.dedupe_products(x)]
        for step in steps:
            done = step(t.read())
            t.commit(done.table, done.changed)
            plain = step(plain).table.select(*names).checkpoint()
    gone = spark.createDataFrame([(i,) for i in rnd.sample(ids, 5)], "id long")
    now = t.read()
    t.commit(now.join(gone, "id", "left_anti"), gone)                    # hard delete
    plain = plain.join(gone, "id", "left_anti").select(*names)
    new = p.limit(3).withColumn("id", F.col("id") + 10_000_000).checkpoint()
    t.commit(t.read().unionByName(new, allowMissingColumns=True), new)
    plain = plain.unionByName(new)
    assert rows_of(t.read().select(*names)) == rows_of(plain)
    assert t.versions() == list(range(9))


def test_commit_without_changes_and_taken_versions(spark, table):
    t, p = table
    none = p.where("false").select("id")
    c = t.commit(t.read(), none)
    assert c.touched == [] and rows_of(t.read().drop("bucket")) == rows_of(p)
    with pytest.raises(src.VersionTaken):
        t.commit(t.read(), p.select("id"), version=1)
    with pytest.raises(src.VersionTaken):
        t.create(p)
    with pytest.raises(ValueError):
        t.read(9)


def test_emptied_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (None, "b")], "id long, v string")
    t = src.BucketedTable(spark, str(tmp_path), rows.schema)
    t.create(rows, buckets=4)
    assert rows_of(t.read().drop("bucket")) == rows_of(rows)
    t.commit(t.read().where("false"), rows)
    assert t.read().count() == 0
    t.commit(t.read().unionByName(rows, allowMissingColumns=True), rows)
    assert rows_of(t.read().drop("bucket")) == rows_of(rows)
