import hashlib
import hmac

from pyspark.sql import functions as F

from loomcart import functions as fn


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_sku_pads_without_truncating(spark):
    assert one(spark, [(7,), (12345,)], "id long", fn.sku("id")) == ["MWK-0007", "MWK-12345"]


def test_indian_grouping(spark):
    got = one(spark, [(899,), (1499,), (123456,), (12345678,)], "n long", fn.rupees("n"))
    assert got == ["₹ 899", "₹ 1,499", "₹ 1,23,456", "₹ 1,23,45,678"]


def test_parse_amount(spark):
    got = one(spark, [("₹ 1,23,456",), ("",), (None,)], "s string", fn.parse_amount("s"))
    assert got == [123456, None, None]


def test_phone_normalisation(spark):
    rows = [("+91 98765-43210",), ("09876543210",), ("9112345678",), (None,)]
    got = spark.createDataFrame(rows, "p string").select(
        fn.normalise_phone("p").alias("n"), fn.phone_is_valid("p").alias("ok")).collect()
    assert [(r.n, r.ok) for r in got] == [
        ("9876543210", True), ("9876543210", True), ("12345678", False), (None, False)]


def test_image_src_rules(spark):
    cdn = "https://res.cloudinary.com/x/image/upload/v1/a/upload/b.jpg"
    rows = [("a.jpg",), ("HTTP://x/y.png",), (cdn,), ("",), (None,)]
    got = one(spark, rows, "i string", fn.image_src("i"))
    assert got[0] == "/static/a.jpg"
    assert got[1] == "HTTP://x/y.png"
    assert got[2] == ("https://res.cloudinary.com/x/image/upload/f_auto,q_auto,w_1400,c_limit/"
                      "v1/a/upload/b.jpg")
    assert got[3] == "" and got[4] == ""


def test_whitespace_normalisation(spark):
    raw = " \u00a0Hello\t \u00a0world \ufeff"
    got = spark.createDataFrame([(raw,)], "s string").select(
        fn.norm_text("s").alias("k"), fn.leading_ws("s").alias("a"),
        fn.trailing_ws("s").alias("b"),
        fn.blank_to_null(F.lit("\ufeff \t\u00a0")).alias("z")).first()
    assert got.k == "Hello world"
    assert got.a == " \u00a0" and got.b == " \ufeff"
    assert got.z is None


def test_hmac_matches_python(spark):
    key = "k3y-for-tests"
    msgs = ["order_1|pay_1", "order_ü|pay_2", ""]
    got = one(spark, [(m,) for m in msgs], "m string", fn.hmac_sha256_hex(F.col("m"), key))
    want = [hmac.new(key.encode(), m.encode(), hashlib.sha256).hexdigest() for m in msgs]
    assert got == want
    long_key = "x" * 100
    got = one(spark, [("abc",)], "m string", fn.hmac_sha256_hex(F.col("m"), long_key))
    assert got == [hmac.new(long_key.encode(), b"abc", hashlib.sha256).hexdigest()]


def test_js_truthiness_and_text(spark):
    rows = [(None, None), ("", 0), ("M", 3)]
    got = spark.createDataFrame(rows, "s string, q int").select(
        fn.js_text("s").alias("t"), fn.size_suffix_paren("s").alias("p"),
        fn.number_or(F.col("q"), 1).alias("q"), fn.text_or("s", "d").alias("d")).collect()
    assert [tuple(r) for r in got] == [("null", "", 1, "d"), ("", "", 1, "d"),
                                       ("M", " (Size M)", 3, "M")]


def test_size_rank_unknown_99(spark):
    got = one(spark, [(None,), ("",), ("S",), ("XXL",), ("38",)], "s string", fn.size_rank("s"))
    assert got == [99, 99, 1, 5, 99]


def test_receipt_and_iso(spark):
    df = spark.createDataFrame([("",), ("x" * 50,)], "r string")
    got = df.select(fn.receipt("r", "1995-02-01 00:00:00").alias("r")).collect()
    assert got[0].r == "rcpt_791596800000" and len(got[1].r) == 40
    ts = spark.sql("SELECT TIMESTAMP '1995-01-02 03:04:05.123' AS t").select(fn.iso_utc("t"))
    assert ts.first()[0] == "1995-01-02T03:04:05.123Z"
