import math

import duckdb

from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() > 0
    assert "product_name" in df.columns


def test_oracle_keys_are_queries():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) >= 60


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr)


def test_every_oracle_matches_on_small_tables(spark):
    """Each registered query against its DuckDB statement on sf0.001."""
    from __spark_entry__ import oracle_sql, queries

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    qs = queries()
    bad = []
    for name, sql in oracle_sql().items():
        sdf = qs[name](spark, SF_SMALL)
        s_rows = _rows(sdf.columns, [tuple(r) for r in sdf.collect()])
        cur = con.execute(sql)
        o_cols = [d[0] for d in cur.description]
        o_rows = _rows(o_cols, cur.fetchall())
        if sorted(sdf.columns) != sorted(o_cols) or s_rows != o_rows:
            bad.append(name)
    assert bad == []
