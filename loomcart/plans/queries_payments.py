"""Registered payment, confirmation and outbox queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import mutations as mu
from ..operators import outbox as ob
from ..operators import payments as pay
from . import mapping as M
from . import sqltext as Q
from .registry import register

AS_OF = M.AS_OF
# A test secret for the derived payment log (configuration, not data).
TEST_SECRET = "test_gateway_secret"
_IPAD, _OPAD = fn.hmac_sql_pads(TEST_SECRET)
_SO = M.SHOP_ORDERS_SQL


def _hmac_sql(msg: str) -> str:
    inner = f"sha256(unhex('{_IPAD}') || encode({msg}))"
    return f"sha256(unhex('{_OPAD}') || unhex({inner}))"


def payment_log(spark, d):
    """One gateway callback per order line; the signature is correct,
    upper-cased, has one digit changed, carries trailing junk, or is absent,
    by ``price_paid % 5``."""
    so = M.shop_orders(spark, d)
    oid = F.concat(F.lit("order_"), so.id.cast("string"))
    pid = F.concat(F.lit("pay_"), so.id.cast("string"))
    sig = fn.hmac_sha256_hex(F.concat(oid, F.lit("|"), pid), TEST_SECRET)
    v = so.price_paid % 5

    def sent(s):
        altered = F.concat(F.when(F.substring(s, 1, 1) == "0", F.lit("1")).otherwise(F.lit("0")),
                           F.substring(s, 2, 64))
        return (F.when(v == 0, s).when(v == 1, F.upper(s)).when(v == 2, altered)
                .when(v == 3, F.concat(s, F.lit("zz"))))

    signature = F.transform(F.array(sig), sent)[0]      # one HMAC a row, whichever the form
    return so.select(so.id.alias("order_line"), oid.alias("razorpay_order_id"),
                     pid.alias("razorpay_payment_id"), signature.alias("razorpay_signature"),
                     so.quantity.alias("quantity"))


_SIG = _hmac_sql("'order_' || CAST(id AS VARCHAR) || '|pay_' || CAST(id AS VARCHAR)")
_LOG_SQL = f"""
SELECT id AS order_line, 'order_' || CAST(id AS VARCHAR) AS razorpay_order_id,
  'pay_' || CAST(id AS VARCHAR) AS razorpay_payment_id,
  CASE price_paid % 5 WHEN 0 THEN {_SIG} WHEN 1 THEN upper({_SIG})
       WHEN 2 THEN (CASE WHEN substr({_SIG}, 1, 1) = '0' THEN '1' ELSE '0' END) || substr({_SIG}, 2, 64)
       WHEN 3 THEN {_SIG} || 'zz' END AS razorpay_signature,
  quantity, price_paid % 5 AS v
FROM ({_SO})
"""


@register("verify_payments", M.cte(l=_LOG_SQL) + """
SELECT order_line, razorpay_order_id, CASE WHEN v = 4 THEN 'missing_fields'
       WHEN v IN (0, 1) THEN 'accepted' ELSE 'invalid_signature' END AS outcome
FROM l
""")
def q_verify(spark, d):
    """K3 + I11: signature check of every callback in the payment log."""
    return pay.verify_payments(payment_log(spark, d), TEST_SECRET).select(
        "order_line", "razorpay_order_id", "outcome")


@register("payment_signatures", M.cte(l=_LOG_SQL) + f"""
SELECT order_line, {_hmac_sql("razorpay_order_id || '|' || razorpay_payment_id")} AS expected
FROM l
""")
def q_signatures(spark, d):
    """The HMAC-SHA256 hex of every callback (pure Catalyst)."""
    log = payment_log(spark, d)
    return log.select("order_line", pay.expected_signature(TEST_SECRET).alias("expected"))


_FO = M.FULL_ORDERS_SQL


@register("apply_payments", M.cte(o=_FO, l=_LOG_SQL) + f"""
SELECT o.id, 'paid' AS payment_status, l.razorpay_payment_id,
       TIMESTAMP '{AS_OF}' AS updated_at
FROM o JOIN l ON o.razorpay_order_id = l.razorpay_order_id
WHERE l.v IN (0, 1) AND o.payment_status = 'pending'
""")
def q_apply_payments(spark, d):
    """Verified payments promote pending orders to paid."""
    ver = pay.verified_payments(payment_log(spark, d), TEST_SECRET).withColumn(
        "seq", F.col("order_line"))
    r = mu.apply_payments(M.full_orders(spark, d, contact=False), ver, AS_OF)
    return r.changed.select("id", "payment_status", "razorpay_payment_id", "updated_at")


def _calls(spark, d):
    """Order-save calls after verified payment; lines with quantity > 20
    are retried once."""
    ver = pay.verified_payments(payment_log(spark, d), TEST_SECRET)
    # One pass over the log: each verified line gives call 1, and call 2 too
    # when retried.
    seqs = F.when(F.col("quantity") > 20, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1)))
    return ver.select("razorpay_order_id", F.explode(seqs).alias("seq"))


@register("confirm_orders", M.cte(o=_FO, l=_LOG_SQL) + """,
calls AS (SELECT razorpay_order_id, 1 AS seq FROM l WHERE v IN (0, 1)
          UNION ALL SELECT razorpay_order_id, 2 FROM l WHERE v IN (0, 1) AND quantity > 20)
SELECT c.razorpay_order_id, c.seq, o.id AS order_id,
  CASE WHEN o.id IS NULL THEN 'none'
       WHEN c.seq = 1 AND o.status = 'received' THEN 'promoted' ELSE 'existing' END AS outcome
FROM calls c LEFT JOIN o ON c.razorpay_order_id = o.razorpay_order_id
""")
def q_confirm(spark, d):
    """Idempotent confirmation; retries only report the existing row."""
    r = mu.confirm_orders(M.full_orders(spark, d, contact=False), _calls(spark, d), AS_OF)
    return r.extra["outcomes"]


# The events of the three triggers, each with product_name and kind.
_PROMOTED = """promoted AS (SELECT o.*, p.name AS product_name FROM o
             JOIN (SELECT DISTINCT razorpay_order_id FROM l WHERE v IN (0, 1)) c
               ON o.razorpay_order_id = c.razorpay_order_id
             LEFT JOIN p ON o.product_id = p.id
             WHERE o.status = 'received')"""
_PATCHED = """shipped AS (SELECT o.* REPLACE ('shipped' AS status, 'TRK-' || CAST(o.id AS VARCHAR) AS tracking_number),
                   p.name AS product_name FROM o LEFT JOIN p ON o.product_id = p.id
            WHERE o.status = 'confirmed')"""
_STREAMED = """shipped AS (SELECT o.*, p.name AS product_name FROM o LEFT JOIN p ON o.product_id = p.id
            WHERE o.status = 'shipped')"""
_CHANGE_EVENTS = f"""{_PROMOTED},
{_PATCHED},
ev AS (SELECT *, 'new_order' AS kind FROM promoted
       UNION ALL SELECT *, 'confirmed' AS kind FROM promoted
       UNION ALL SELECT *, 'shipped' AS kind FROM shipped)"""
_STREAM_EVENTS = f"{_STREAMED},\nev AS (SELECT *, 'shipped' AS kind FROM shipped)"
_APPEND_EVENTS = f"""
n AS (SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY ordered_at + INTERVAL 1 DAY, id) AS id,
        product_id, customer_name, customer_phone, customer_email, size, price_paid,
        CASE WHEN quantity > 40 OR quantity = 0 THEN 1 ELSE quantity END AS quantity,
        CASE WHEN price_paid > 100000 AND razorpay_payment_id IS NOT NULL THEN 'confirmed' ELSE 'received' END AS status,
        CAST(NULL AS VARCHAR) AS tracking_number
      FROM o WHERE status = 'shipped'),
named AS (SELECT n.*, p.name AS product_name FROM n LEFT JOIN p ON n.product_id = p.id),
ev AS (SELECT *, 'new_order' AS kind FROM named
       UNION ALL SELECT *, 'confirmed' AS kind FROM named WHERE status = 'confirmed')"""


def _outbox_sql(events: str = _CHANGE_EVENTS) -> str:
    shop = ob.K.DEFAULT_SHOP_NAME.replace("'", "''")
    admin = ob.K.DEFAULT_ADMIN_EMAIL
    js = Q.js_text
    size_p = Q.optional_piece("size", " (Size ", ")")
    size_d = Q.optional_piece("size", " — Size ")
    track = Q.optional_piece("tracking_number", " Track: ", ".")
    conf_sms = (f"'Hi ' || {js('customer_name')} || ', your {shop} order #' || CAST(id AS VARCHAR)"
                f" || ' (' || {js('product_name')} || {size_p} || ') has been confirmed! It will be "
                f"shipped within 5-7 days. - Team {shop}'")
    ship_sms = (f"'Hi ' || {js('customer_name')} || ', your {shop} order #' || CAST(id AS VARCHAR)"
                f" || ' is on its way!' || {track} || ' - Team {shop}'")
    text = (f"CASE WHEN kind = 'confirmed' THEN {conf_sms} ELSE {ship_sms} END")
    subj = (f"CASE WHEN kind = 'confirmed' THEN 'Your {shop} order is confirmed ✦ Order #' || "
            f"CAST(id AS VARCHAR) ELSE 'Your {shop} order is on its way ✦ Order #' || "
            f"CAST(id AS VARCHAR) END")
    mail_ok = "customer_email IS NOT NULL AND customer_email <> ''"
    sms_ok = (f"customer_phone IS NOT NULL AND customer_phone <> '' AND "
              f"{Q.phone_valid('customer_phone')}")
    return M.cte(o=_FO, l=_LOG_SQL, p=M.PRODUCTS_SQL) + f""",
{events}
SELECT CAST(id AS VARCHAR) AS order_id, 'email' AS channel, kind, '{admin}' AS recipient,
  '🛍 New Order #' || CAST(id AS VARCHAR) || ' — ' || {js('product_name')} AS subject,
  'Order #' || CAST(id AS VARCHAR) || ': ' || {js('product_name')} || {size_d} || ' x '
    || {js('quantity')} || ', ₹' || {js('price_paid')} || ', ' || {js('customer_name')} AS text
FROM ev WHERE kind = 'new_order'
UNION ALL
SELECT CAST(id AS VARCHAR), 'email', kind, customer_email, {subj}, {text}
FROM ev WHERE kind IN ('confirmed', 'shipped') AND {mail_ok}
UNION ALL
SELECT CAST(id AS VARCHAR), 'sms', kind, {Q.normalise_phone('customer_phone')}, NULL, {text}
FROM ev WHERE kind IN ('confirmed', 'shipped') AND {mail_ok} AND {sms_ok}
"""


@register("notification_outbox", _outbox_sql())
def q_outbox(spark, d):
    """K1 (+ I7, I13, I14, C7): messages for what changed -- first
    confirmations (admin + customer), then status patches that ship."""
    from ..operators.orders import with_product_name
    from .queries_mutations import _order_patches

    # Names and contact join the orders with an event only, before these are
    # told apart.
    o = M.full_orders(spark, d, contact=False, custkey=True)
    p = M.products(spark, d)
    patches = _order_patches(spark, d)
    flagged = mu.confirm_orders(o, _calls(spark, d), AS_OF).extra["flagged"]
    changed = ob.changed_orders(mu.patch_orders(flagged, patches, AS_OF).table, patches)
    named = M.with_contact(with_product_name(changed, p), spark, d)
    return ob.notification_outbox(ob.events_of(named))


@register("append_notifications", _outbox_sql(_APPEND_EVENTS))
def q_append_notifications(spark, d):
    """K1 on saved orders (file path): the admin notice for each, the
    customer's confirmation for those confirmed at once."""
    from ..operators.orders import with_product_name
    from .queries_mutations import _reorders

    saved = mu.append_orders(M.full_orders(spark, d), _reorders(spark, d), AS_OF, mode="file",
                             order_by=["ordered_at", "src_id"]).changed
    named = with_product_name(saved, M.products(spark, d))
    return ob.notification_outbox(ob.append_events(named))
