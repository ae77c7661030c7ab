import hashlib
import hmac
import os
import tempfile

import pytest

from pyspark.sql import functions as F

from loomcart import sources as src
from loomcart.operators import localise as lo
from loomcart.operators import outbox as ob
from loomcart.operators import payments as pay
from loomcart.operators import quality as qa
from loomcart.sources import schema as S


def test_order_json_missing_and_corrupt_give_no_rows(spark):
    d = tempfile.mkdtemp(prefix="lc-json-")
    assert src.read_order_json(spark, os.path.join(d, "absent.json")).count() == 0
    bad = os.path.join(d, "bad.json")
    with open(bad, "w") as f:
        f.write("[{not json")
    assert src.read_order_json(spark, bad).count() == 0
    good = os.path.join(d, "good.json")
    with open(good, "w") as f:
        f.write('[{"id": 2, "product_id": 5, "status": "received"},\n {"id": 1}]')
    df = src.read_order_json(spark, good)
    assert sorted(r.id for r in df.collect()) == [1, 2]
    assert df.schema == S.ORDER_DOCUMENT


def test_order_json_roundtrip_to_new_path(spark):
    d = tempfile.mkdtemp(prefix="lc-json-")
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, status string")
    src.write_order_json(df, os.path.join(d, "v1"))
    back = src.read_order_json(spark, os.path.join(d, "v1"), multiline=False)
    assert sorted((r.id, r.status) for r in back.collect()) == [(1, "a"), (2, None)]
    assert src.to_json_rows(df).first().json == '{"id":1,"status":"a"}'


def test_align_schema_adds_defaults_and_keeps_extra(spark):
    df = spark.createDataFrame([(1, "x")], "id long, extra string")
    out = src.align_schema(df, S.ORDERS, S.ORDER_DEFAULTS)
    r = out.first()
    assert out.columns[:len(S.ORDERS)] == S.ORDERS.fieldNames() and out.columns[-1] == "extra"
    assert (r.quantity, r.status, r.payment_status, r.notes) == (1, "received", "pending", None)


def test_rewrite_asset_paths_all_occurrences(spark):
    df = spark.createDataFrame([('<img src="a.jpg"><img src="a.jpg"> b.png',)], "t string")
    out = src.rewrite_asset_paths(df, "t", ["a.jpg", "b.png"], "/static/").first().t
    assert out == '<img src="/static/a.jpg"><img src="/static/a.jpg"> /static/b.png'


def test_ensure_table_idempotent(spark):
    loc = tempfile.mkdtemp(prefix="lc-tbl-")
    t1 = src.ensure_table(spark, "lc_products_t", S.PRODUCTS, loc)
    t2 = src.ensure_table(spark, "lc_products_t", S.PRODUCTS, loc)
    assert t1.columns == t2.columns == S.PRODUCTS.fieldNames()
    spark.sql("DROP TABLE lc_products_t")


def test_ensure_table_with_column_defaults(spark):
    loc = tempfile.mkdtemp(prefix="lc-tbl-")
    src.ensure_table(spark, "lc_orders_d", S.ORDERS, loc, src.ORDER_DEFAULTS)
    spark.sql("INSERT INTO lc_orders_d (id, customer_name) VALUES (1, 'Ann')")
    spark.sql("INSERT INTO lc_orders_d (id, quantity, status) VALUES (2, 5, 'shipped')")
    rows = {r.id: r for r in spark.table("lc_orders_d").collect()}
    assert (rows[1].quantity, rows[1].status, rows[1].payment_status) == (1, "received", "pending")
    assert (rows[2].quantity, rows[2].status, rows[2].customer_name) == (5, "shipped", None)
    assert rows[1].ordered_at is not None and rows[1].updated_at is not None
    with pytest.raises(ValueError):
        src.ensure_table(spark, "lc_orders_d", S.ORDERS, loc, {"nope": "1"})
    spark.sql("DROP TABLE lc_orders_d")


def test_translate_keeps_whitespace_and_falls_through(spark):
    d = spark.createDataFrame([("Hello world", "HW"), ("Empty", "")], "src string, dst string")
    t = spark.createDataFrame([("  Hello\t world﻿ ",), ("Other",), ("Empty",)],
                              "s string")
    got = [r.s_t for r in lo.translate(t, "s", d).collect()]
    assert sorted(got) == sorted(["  HW﻿ ", "Other", "Empty"])


def test_overlay_later_wins_empty_ignored(spark):
    a = spark.createDataFrame([("Hat", "h1"), ("Cap", "c1")], "src string, dst string")
    b = spark.createDataFrame([("Hat ", "h2", 1), ("Hat", "h3", 2), ("Cap", "", 3)],
                              "src string, dst string, pos int")
    got = dict((r.src, r.dst) for r in lo.overlay_dictionary(a, b).collect())
    assert got == {"Hat": "h3", "Cap": "c1"}


def test_fragments_skip_script_comment_and_opt_out(spark):
    html = ("<html><head><title>T</title></head><body><p>One &amp; two</p>"
            "<script>var x='<b>no</b>';</script><!-- c --><div data-no-i18n><b>skip</b></div>"
            "<span> </span><i>Three</i></body></html>")
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [r.raw for r in lo.text_fragments(pages).orderBy("pos").collect()]
    assert got == ["One & two", "Three"]


def _texts(spark, html):
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    return [(r.pos, r.raw) for r in lo.text_fragments(pages).orderBy("pos").collect()]


def test_fragments_by_hand(spark):
    # No closing body tag: the title is not part of the body, text at both ends is.
    assert _texts(spark, "<html><title>T</title><body class='a>b'>Lead <p>mid</p> tail") == [
        (0, "Lead "), (1, "mid"), (2, " tail")]
    assert _texts(spark, "<body>Lead<br>tail</body>after") == [(0, "Lead"), (1, "tail")]
    # A comment parts two text nodes; blank nodes keep their place.
    assert _texts(spark, "<body>a<!-- x > y -->b <i> </i>c</body>") == [(0, "a"), (1, "b "), (3, "c")]
    # Nested opted-out blocks end at their own closing tag.
    assert _texts(spark, "<body><div data-no-i18n>x<div>y</div>z</div>w<span data-no-i18n=''>q</span>"
                         "<br data-no-i18n>v</body>") == [(3, "w"), (5, "v")]
    # Numeric references, once; a lone "<" is text.
    assert _texts(spark, "<body>&#8377;5 &#x20B9; &ndash; &amp;#8377; 1 < 2</body>") == [
        (0, "₹5 ₹ – &#8377; 1 < 2")]
    assert _texts(spark, "no body <b>tag</b>") == [(0, "no body "), (1, "tag")]


def test_opt_out_with_elements_left_open(spark):
    # An outer closing tag ends an opted-out block that was left open.
    assert _texts(spark, "<body><div><p data-no-i18n>x<b>y</div>z</body>") == [(2, "z")]
    # Elements left open inside a block end with it; others of its name count.
    assert _texts(spark, "<body><div data-no-i18n><ul><li>x<li>y<div>u</div></ul>v</div>w</body>") == [(4, "w")]
    # A closing tag of nothing closes nothing.
    assert _texts(spark, "<body><i data-no-i18n>x</b></p>y</i>z</u>w</body>") == [(2, "z"), (3, "w")]
    # Blocks within blocks.
    assert _texts(spark, "<body><i data-no-i18n>x<b data-no-i18n>y</b>z</i>w<p>v</body>") == [(3, "w"), (4, "v")]


def test_long_pages_take_linear_time(spark):
    """A page of 10^5 tokens, changed at every text, with open elements."""
    import time

    n = 25_000
    html = "<body>" + "".join(f"<p>Hello<i title='Hello'>{k}</i>" for k in range(n)) + "<b data-no-i18n>Hello</b></body>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    d = spark.createDataFrame([("Hello", "Hi")], "src string, dst string")
    t0 = time.perf_counter()
    got = lo.localised_pages(pages, d).first()
    assert time.perf_counter() - t0 < 40
    assert (got.n_texts, got.n_attributes) == (n, n)
    assert got.html == "<body>" + "".join(f'<p>Hi<i title="Hi">{k}</i>' for k in range(n)) + "<b data-no-i18n>Hello</b></body>"
    t0 = time.perf_counter()
    places = lo.outside_blocks(["<p>", "</b>", "x"] * 60_000)
    assert all(places) and time.perf_counter() - t0 < 5


def test_attributes_by_hand(spark):
    html = ("<body><textarea placeholder='Your &amp; name'>kept</textarea><img alt=Logo title=\"T\">"
            "<div data-no-i18n><input placeholder=\"Mail\"></div><div placeholder=\"no\">x</div>"
            "<b aria-label='A' placeholder='P'>y</b><!-- <img alt='c'> --></body>")
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [(r.attr, r.raw) for r in lo.attribute_values(pages).orderBy("pos").collect()]
    assert got == [("placeholder", "Your & name"), ("alt", "Logo"), ("title", "T"), ("placeholder", "Mail"),
                   ("aria-label", "A"), ("placeholder", "P")]


def test_localised_page_by_hand(spark):
    html = ("<html><body> Hello <!-- Hello --><b title='Hello'>Hello</b><i data-no-i18n>Hello</i>"
            "<script>Hello</script>Other</body></html>")
    pages = spark.createDataFrame([(1, html), (2, "<body>none</body>")], "page_id long, html string")
    d = spark.createDataFrame([("Hello", 'A <"B">')], "src string, dst string")
    got = {r.page_id: (r.html, r.n_texts, r.n_attributes) for r in lo.localised_pages(pages, d).collect()}
    assert got[1] == (
        "<html><body> A &lt;\"B\"&gt; <!-- Hello --><b title=\"A &lt;&quot;B&quot;&gt;\">A &lt;\"B\"&gt;</b>"
        "<i data-no-i18n>Hello</i><script>Hello</script>Other</body></html>", 2, 1)
    assert got[2] == ("<body>none</body>", 0, 0)


def test_outbox_rules(spark):
    ev = spark.createDataFrame([
        (1, "confirmed", "Ann", "+91 98765-43210", "a@x.org", "Hat", "M", None),
        (2, "confirmed", "Bo", "9112345678", "b@x.org", "Cap", None, None),
        (3, "shipped", "Cy", "09876543210", None, "Cap", None, "T1"),
        (4, "shipped", "Di", "09876543210", "d@x.org", None, None, "T9"),
        (5, "new_order", "Ed", "", None, "Hat", "S", None)],
        "id long, kind string, customer_name string, customer_phone string, "
        "customer_email string, product_name string, size string, tracking_number string"
    ).withColumn("quantity", F.lit(1)).withColumn("price_paid", F.lit(899))
    out = ob.notification_outbox(ev, shop="Shop", admin_email="adm@x.org")
    got = sorted((r.order_id, r.channel, r.recipient) for r in out.collect())
    assert got == [("1", "email", "a@x.org"), ("1", "sms", "9876543210"),
                   ("2", "email", "b@x.org"), ("4", "email", "d@x.org"),
                   ("4", "sms", "9876543210"), ("5", "email", "adm@x.org")]
    sms = {r.order_id: r.text for r in out.filter("channel = 'sms'").collect()}
    assert sms["1"] == ("Hi Ann, your Shop order #1 (Hat (Size M)) has been confirmed! "
                        "It will be shipped within 5-7 days. - Team Shop")
    assert sms["4"] == "Hi Di, your Shop order #4 is on its way! Track: T9. - Team Shop"


def test_payment_signature_variants(spark):
    key = "s3cret"
    good = hmac.new(key.encode(), b"order_1|pay_1", hashlib.sha256).hexdigest()
    changed = ("1" if good[0] == "0" else "0") + good[1:]
    log = spark.createDataFrame([
        (1, "order_1", "pay_1", good), (2, "order_1", "pay_1", good.upper()),
        (3, "order_1", "pay_1", changed), (4, "order_1", "pay_1", good + "zz"),
        (5, "order_1", "pay_1", None), (6, "", "pay_1", good)],
        "n int, razorpay_order_id string, razorpay_payment_id string, razorpay_signature string")
    got = {r.n: r.outcome for r in pay.verify_payments(log, key).collect()}
    assert got == {1: "accepted", 2: "accepted", 3: "invalid_signature",
                   4: "invalid_signature", 5: "missing_fields", 6: "missing_fields"}


def test_quality_checks(spark):
    df = spark.createDataFrame([("", 0, None), ("x", None, "y")], "a string, b int, c string")
    out = qa.validate_required(df, {"a": "truthy", "b": "not_null"}).collect()
    assert [list(r.reasons) for r in out] == [["missing a"], ["missing b"]]
    amt = spark.createDataFrame([("150",), ("99",), ("150.5",), ("abc",), (None,)], "amount string")
    assert [r.amount_ok for r in qa.validate_amount(amt).collect()] == [True, False, False, False, False]
    p = spark.createDataFrame([(1, "toolonggender", None)], "id long, gender string, name string")
    v = qa.check_constraints(p, ["id", "name"], {"gender": 10}).first().violations
    assert list(v) == ["null name", "too long gender"]


def test_load_cached_persists_and_releases(spark):
    df = spark.range(0, 100).withColumn("x", F.col("id") * 2)
    with src.load_cached(df) as d:
        assert d.count() == 100 and d.agg(F.sum("x")).first()[0] == 9900
        assert d.storageLevel.useMemory or d.storageLevel.useDisk
    assert not df.storageLevel.useMemory and not df.storageLevel.useDisk


def test_seed_rows_schema(spark):
    s = src.seed_rows(spark)
    assert s.columns == ["gender", "collection", "name", "size", "price", "stock", "image",
                         "description"]
    assert s.count() == len(src.io.SEED_ROWS)


def _hinted(df) -> bool:
    return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()


def test_join_small_broadcasts_only_under_the_bound(spark):
    from loomcart.operators.joins import join_small, spread

    big = spark.range(0, 1000).withColumnRenamed("id", "k")
    small = spark.range(0, 50).withColumnRenamed("id", "k")
    assert _hinted(join_small(big, small, "k", "left", max_rows=100))
    assert not _hinted(join_small(big, small, "k", "left", max_rows=10))
    assert _hinted(join_small(big, small, "k", "left", known_rows=50, max_rows=100))
    one = spark.range(0, 10, numPartitions=1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 10, numPartitions=64)
    assert spread(many).rdd.getNumPartitions() == 64


def test_read_whole_texts_one_row_per_file(spark):
    d = tempfile.mkdtemp(prefix="lc-text-")
    for name, body in (("a.html", "<p>one</p>\n<p>two</p>"), ("b.html", "<img src=\"x.jpg\">")):
        with open(os.path.join(d, name), "w") as f:
            f.write(body)
    df = src.read_whole_texts(spark, d)
    rows = {os.path.basename(r.path): r.value for r in df.collect()}
    assert rows == {"a.html": "<p>one</p>\n<p>two</p>", "b.html": "<img src=\"x.jpg\">"}
    out = src.rewrite_asset_paths(df, "value", ["x.jpg"], "/static/").filter(
        F.col("path").endswith("b.html")).first().value
    assert out == "<img src=\"/static/x.jpg\">"
