"""Folders of order documents: good files, and bad ones as rows with reasons."""

import gzip
import json

from loomcart import sources as src
from loomcart import streaming as stm
from loomcart.sources.io import _document_lines, _files_by_line

GOOD = [{"id": 2, "status": "received", "quantity": 3}, {"id": 1, "status": "shipped", "notes": "a\n\"b\" [x]", "more": 1}]
BAD = {"blank.json": (" \n\t", "empty"), "half.json": ('[{"id": 1}, {"id": 2, "st', "bad json"),
       "junk.json": ("[}", "bad json"), "object.json": ('{"id": 9}', "no list"), "text.json": ('"x"', "no list")}


def fill(folder):
    folder.mkdir()
    (folder / "good.json").write_text(json.dumps(GOOD, indent=2))
    (folder / "none.json").write_text("[]")
    (folder / "empty.json").write_text("")               # no bytes, no row
    (folder / "odd.json").write_text('[null, 3, "x", {"id": 5, "quantity": "many"}, {"id": 6}]')
    for name, (text, _) in BAD.items():
        (folder / name).write_text(text)


def check(rows):
    by = {}
    for r in rows:
        by.setdefault(r.file.rsplit("/", 1)[-1], []).append(r)
    assert [(r.reason, r.id, r.quantity, r.notes) for r in by.pop("good.json")] == [
        (None, 2, 3, None), (None, 1, None, 'a\n"b" [x]')]
    assert [(r.reason, r.id, r.quantity) for r in by.pop("odd.json")] == [
        ("no order", None, None)] * 3 + [(None, 5, None), (None, 6, None)]
    assert {k: [(r.reason, r.id) for r in v] for k, v in by.items()} == {k: [(why, None)] for k, (_, why) in BAD.items()}


def test_documents_of_a_folder(spark, tmp_path):
    fill(tmp_path / "docs")
    check(src.order_documents(spark, str(tmp_path / "docs")).collect())
    assert src.order_documents(spark, str(tmp_path / "missing")).count() == 0


def test_documents_as_a_stream(spark, tmp_path):
    """Files that arrive between two runs are read once each."""
    fill(tmp_path / "docs")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    for run in range(2):
        stm.run_available_now(src.order_documents(spark, str(tmp_path / "docs"), stream=True), out, ckpt)
        rows = spark.read.parquet(out).collect()
        if run == 0:
            check(rows)
            (tmp_path / "docs" / "late.json").write_text('[{"id": 77}]')
    assert len(rows) == 7 + len(BAD) + 1 and sum(r.id == 77 for r in rows) == 1


def test_written_documents_read_back(spark, tmp_path):
    orders = spark.createDataFrame([(i, f"n{i}", None if i % 3 else "q\"\\ü") for i in range(100)],
                                   "id long, customer_name string, notes string")
    src.write_order_documents(orders, str(tmp_path / "w"), files=7)
    lists = [json.loads(f.read_text()) for f in (tmp_path / "w").glob("part-*")]
    assert sum(map(len, lists)) == 100 and all(x == sorted(x, key=lambda o: -o["id"]) for x in lists)
    back = src.order_documents(spark, str(tmp_path / "w"))
    assert {(r.id, r.customer_name, r.notes) for r in back.collect()} == {tuple(r) for r in orders.collect()}
    assert back.where("reason IS NOT NULL").count() == 0
    src.write_order_documents(orders.where("id < 0"), str(tmp_path / "none"), files=2)
    assert src.order_documents(spark, str(tmp_path / "none")).count() == 0


def test_large_documents_by_line(spark, tmp_path):
    """Files over the size limit are split by line where they hold an order a
    line; all others give the same rows as when read whole."""
    fill(tmp_path / "docs")
    check(src.order_documents(spark, str(tmp_path / "docs"), whole_bytes=0).collect())
    lists = {"one line a.json": '[{"id": 1, "notes": "x"}\n,{"id": 2}\n]\n', "gap.json": '[{"id": 3}\n{"id": 4}\n]',
             "twice.json": '[{"id": 5}\n]\n[{"id": 6}\n]', "open.json": '[{"id": 7}\n,{"id": 8}', "early.json": '[{"id": 9}\n]\n,{"id": 10}',
             "bare.json": '[\n{"id": 11}\n]', "two.json": '[\n{"id": 15}\n{"id": 16}\n]', "comma.json": '[\n,{"id": 17}\n]',
             "void.json": '[\n]', "both.json": '[{"id": 18}\n{"id": 19}\n,{"id": 20}\n]', "late.json": ',{"id": 12}\n[{"id": 13}\n]', "text.json": '[{"id": 14}\n,"{}"\n]'}
    (tmp_path / "lines").mkdir()
    for name, text in lists.items():
        (tmp_path / "lines" / name).write_text(text)
    by_line, whole = ([tuple(r) for r in src.order_documents(spark, str(tmp_path / "lines"), whole_bytes=n).collect()]
                      for n in (0, 1 << 20))
    assert sorted(by_line, key=str) == sorted(whole, key=str) and len(whole) == 13


def test_large_document_is_split_over_tasks(spark, tmp_path):
    """One file of many orders: no task holds all of it."""
    orders = spark.range(40_000).selectExpr("id", "repeat('n', 100) AS notes")
    src.write_order_documents(orders, str(tmp_path / "w"), files=1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        back = src.order_documents(spark, str(tmp_path / "w"), whole_bytes=1 << 20)
        assert back.rdd.getNumPartitions() > 3
        assert back.selectExpr("count(*)", "count(DISTINCT id)", "count(reason)").first()[:] == (40_000, 40_000, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_packed_documents_equal_plain_ones(spark, tmp_path):
    """Small and large, an order a line or not, half-written, of two members."""
    lines = "[" + "\n,".join(json.dumps({"id": i, "notes": "n" * 40}) for i in range(400)) + "\n]"
    texts = {"good": json.dumps(GOOD), "lines": lines, "late": lines.replace("\n]", "\n,7\n]"), "object": '{"id": 9}'}
    for kind in ("plain", "packed"):
        (tmp_path / kind).mkdir()
    for name, text in texts.items():
        (tmp_path / "plain" / f"{name}.json").write_text(text)
        (tmp_path / "packed" / f"{name}.json.gz").write_bytes(
            b"".join(gzip.compress(x.encode()) for x in (text[:9], text[9:])))
    (tmp_path / "plain" / "half.json").write_text("[{")
    (tmp_path / "packed" / "half.json.gz").write_bytes(gzip.compress(lines.encode())[:60])

    def rows(kind, whole_bytes):
        got = src.order_documents(spark, str(tmp_path / kind), whole_bytes=whole_bytes).collect()
        return sorted(str((r.file.rsplit("/", 1)[-1].split(".")[0], *r[1:])) for r in got)

    plain = rows("plain", 1 << 20)
    assert len(plain) == 2 + 400 + 401 + 2
    assert rows("packed", 1 << 20) == plain                                      # all read whole
    assert rows("packed", 32 * 100) == plain                                     # large ones, one of them by line
    assert rows("packed", 32 * 40) == plain                                      # and the half-written one


def test_documents_are_made_after_the_shuffle_and_packed(spark, tmp_path):
    orders = spark.range(60).selectExpr("id", "id % 7 AS code")
    made = lambda rows: rows.selectExpr("id", "concat('name ', code) AS customer_name")
    src.write_order_documents(orders, str(tmp_path / "w"), files=3, make=made, compression="gzip")
    lists = [json.loads(gzip.decompress(f.read_bytes())) for f in (tmp_path / "w").glob("part-*.gz")]
    assert sum(map(len, lists)) == 60 and all(x == sorted(x, key=lambda o: -o["id"]) for x in lists)
    back = src.order_documents(spark, str(tmp_path / "w"))
    assert {(r.id, r.customer_name) for r in back.collect()} == {(i, f"name {i % 7}") for i in range(60)}


def test_lines_are_judged_without_a_sort(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text('[{"id": 1}\n,{"id": 2}\n]')
    by = _files_by_line(_document_lines(spark, str(tmp_path / "docs"), 0))
    assert [r.by_line for r in by.collect()] == [True]
    assert "Sort" not in by._jdf.queryExecution().executedPlan().toString()
