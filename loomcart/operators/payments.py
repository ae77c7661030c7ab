"""Payment-log verification (K3) feeding H11 / H12.

The signature is HMAC-SHA256 over ``order_id|payment_id`` with the gateway
secret, hex encoded.  It is computed as a Catalyst expression (two SHA-256
passes over key pads), so verification is a projection with no UDF.  The
secret is a driver-side configuration value passed in by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn

FIELDS = ["razorpay_order_id", "razorpay_payment_id", "razorpay_signature"]


def signature_message(order_id, payment_id) -> Column:
    return F.concat(F.col(order_id) if isinstance(order_id, str) else order_id, F.lit("|"),
                    F.col(payment_id) if isinstance(payment_id, str) else payment_id)


def expected_signature(secret: str) -> Column:
    return fn.hmac_sha256_hex(signature_message(FIELDS[0], FIELDS[1]), secret)


def verify_payments(log: DataFrame, secret: str) -> DataFrame:
    """Outcome per log row: accepted / missing_fields / invalid_signature.

    A field is missing when NULL or ''.  The signature must be exactly 64
    hex digits (either case) equal to the expected HMAC.  (The shop's hex
    decoder ignores trailing junk, so it would accept signature + 'zz'; we
    refuse it.)
    """
    missing = F.array_compact(F.array(*[
        F.when(~fn.truthy_text(f), F.lit(f)) for f in FIELDS]))
    sig = F.col("razorpay_signature")
    good = sig.rlike("^[0-9a-fA-F]{64}$") & (F.lower(sig) == expected_signature(secret))
    outcome = (F.when(F.size(missing) > 0, F.lit("missing_fields"))
               .when(F.coalesce(good, F.lit(False)), F.lit("accepted"))
               .otherwise(F.lit("invalid_signature")))
    return log.withColumn("missing", missing).withColumn("outcome", outcome)


def verified_payments(log: DataFrame, secret: str) -> DataFrame:
    """The accepted rows.  A signature that equals the HMAC in either case is
    64 hex digits and not empty, so one comparison decides; the outcome's
    several looks at a signature would each compute a derived one anew."""
    accepted = (fn.truthy_text(FIELDS[0]) & fn.truthy_text(FIELDS[1])
                & (F.lower(F.col("razorpay_signature")) == expected_signature(secret)))
    return verify_payments(log.filter(accepted), secret)
