"""Notification outbox (K1): the messages the shop would send, as rows.

Nothing is sent; each changed order becomes zero or more rows
(order_id, channel, kind, recipient, subject, text).  Rules:

* ``new_order``: one e-mail to the shop's admin mailbox.
* ``confirmed`` / ``shipped``: only when the customer has an e-mail
  address -- without one there is no customer row at all, SMS included.
  Then one e-mail, and one SMS when the phone is given and normalises to
  ten digits.

Shop name and admin mailbox are parameters (placeholders by default).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .. import functions as fn

_COLS = ["order_id", "channel", "kind", "recipient", "subject", "text"]


def _id(c="id") -> Column:
    return F.col(c).cast("string")


# --- Fixed values: the message texts below equal the shop's, so that recipients
# get the same messages ------------------------------------------------------
def admin_subject(shop: str) -> Column:
    return F.concat(F.lit("🛍 New Order #"), _id(), F.lit(" — "), fn.js_text("product_name"))


def confirmed_subject(shop: str) -> Column:
    return F.concat(F.lit(f"Your {shop} order is confirmed ✦ Order #"), _id())


def shipped_subject(shop: str) -> Column:
    return F.concat(F.lit(f"Your {shop} order is on its way ✦ Order #"), _id())


def confirmed_sms(shop: str) -> Column:
    return F.concat(F.lit("Hi "), fn.js_text("customer_name"), F.lit(f", your {shop} order #"),
                    _id(), F.lit(" ("), fn.js_text("product_name"),
                    fn.size_suffix_paren("size"),
                    F.lit(") has been confirmed! It will be shipped within 5-7 days. "
                          f"- Team {shop}"))


def shipped_sms(shop: str) -> Column:
    return F.concat(F.lit("Hi "), fn.js_text("customer_name"), F.lit(f", your {shop} order #"),
                    _id(), F.lit(" is on its way!"),
                    fn.optional_piece("tracking_number", " Track: ", "."),
                    F.lit(f" - Team {shop}"))


def admin_text() -> Column:
    """Plain summary line of the admin notice (the HTML body is not built)."""
    return F.concat(F.lit("Order #"), _id(), F.lit(": "), fn.js_text("product_name"),
                    fn.size_suffix_dash("size"), F.lit(" x "), fn.js_text("quantity"),
                    F.lit(", ₹"), fn.js_text("price_paid"), F.lit(", "),
                    fn.js_text("customer_name"))


def changed_orders(o: DataFrame, patches: DataFrame, promoted: str = "promoted") -> DataFrame:
    """Changed orders with ``kinds``, their events, from one pass over them:
    for an order that was promoted the admin notice and the customer's
    confirmation, and one event per patch that sends the status confirmed or
    shipped.  ``o`` is the table after the changes, with the flag
    ``promoted``; orders without event are left out."""
    sent = patches.select("id", F.col("changes")["status"].alias("kind")).filter(
        F.col("kind").isin("confirmed", "shipped"))
    sent = sent.groupBy("id").agg(F.collect_list("kind").alias("__sent"))   # one entry per patch
    none = F.array().cast("array<string>")
    kinds = F.concat(F.when(F.col(promoted), F.array(F.lit("new_order"), F.lit("confirmed"))).otherwise(none),
                     F.coalesce("__sent", none))
    return o.join(sent, "id", "left").withColumn("kinds", kinds).filter(F.size("kinds") > 0).drop("__sent", promoted)


def events_of(changed: DataFrame) -> DataFrame:
    """One row per event of ``kinds``, as ``kind``."""
    return changed.withColumn("kind", F.explode("kinds")).drop("kinds")


def change_events(o: DataFrame, patches: DataFrame, promoted: str = "promoted") -> DataFrame:
    """Events of changed orders (see :func:`changed_orders`)."""
    return events_of(changed_orders(o, patches, promoted))


def append_events(appended: DataFrame) -> DataFrame:
    """Events of saved orders: the admin notice for each, and the customer's
    confirmation for those saved as confirmed."""
    kinds = F.when(F.col("status") == K.STATUS_CONFIRMED, F.array(F.lit("new_order"), F.lit("confirmed")))
    return appended.withColumn("kind", F.explode(kinds.otherwise(F.array(F.lit("new_order")))))


def notification_outbox(events: DataFrame, shop: str = K.DEFAULT_SHOP_NAME,
                        admin_email: str = K.DEFAULT_ADMIN_EMAIL) -> DataFrame:
    """events: changed orders with ``kind`` in (new_order, confirmed, shipped)
    and ``product_name``.

    One pass: each event row builds the array of its messages (admin
    e-mail; customer e-mail; customer SMS), NULL where a rule does not
    apply, and the array is exploded -- no union of per-rule scans, no
    join, no shuffle.
    """
    kind = F.col("kind")
    has_mail = fn.truthy_text("customer_email")
    sms_ok = fn.truthy_text("customer_phone") & fn.phone_is_valid("customer_phone")
    customer = kind.isin("confirmed", "shipped") & has_mail
    subject = F.when(kind == "confirmed", confirmed_subject(shop)).otherwise(shipped_subject(shop))
    text = F.when(kind == "confirmed", confirmed_sms(shop)).otherwise(shipped_sms(shop))

    def msg(channel, recipient, subj, body):
        return F.struct(F.lit(channel).alias("channel"), recipient.cast("string").alias("recipient"),
                        subj.cast("string").alias("subject"), body.cast("string").alias("text"))

    msgs = F.array_compact(F.array(
        F.when(kind == "new_order",
               msg("email", F.lit(admin_email), admin_subject(shop), admin_text())),
        F.when(customer, msg("email", F.col("customer_email"), subject, text)),
        F.when(customer & sms_ok, msg("sms", fn.normalise_phone("customer_phone"),
                                      F.lit(None), text)),
    ))
    out = events.select(_id().alias("order_id"), kind, F.explode(msgs).alias("m"))
    return out.select("order_id", F.col("m.channel").alias("channel"), "kind",
                      F.col("m.recipient").alias("recipient"), F.col("m.subject").alias("subject"),
                      F.col("m.text").alias("text"))
