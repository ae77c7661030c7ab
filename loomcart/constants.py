"""Fixed values.

Values below must equal the shop's own for results to match; they are stated
as plain text, in their natural order, in one place.
"""

# --- Fixed values (must equal the shop's behaviour) -------------------------

# SKU: prefix followed by the id zero-padded to at least four digits.
SKU_FORMAT = "MWK-%04d"

# Storefront size order; unknown sizes rank 99.
SIZE_ORDER = {"S": 1, "M": 2, "L": 3, "XL": 4, "XXL": 5}
UNKNOWN_SIZE_RANK = 99

# Order states.
STATUS_RECEIVED = "received"
STATUS_CONFIRMED = "confirmed"
STATUS_SHIPPED = "shipped"
STATUS_DELIVERED = "delivered"
PAYMENT_PENDING = "pending"
PAYMENT_PAID = "paid"
PAYMENT_FAILED = "failed"
PAYMENT_ABANDONED = "abandoned"

# Reservation time-to-live before the sweep releases it.
RESERVATION_TTL_MINUTES = 20

# Smallest gateway amount, in paise.
MIN_AMOUNT_PAISE = 100

# Receipt text: default prefix and maximum length.
RECEIPT_PREFIX = "rcpt_"
RECEIPT_MAX_LEN = 40

# Image URLs: bare file names are served from this prefix; image-CDN URLs
# get a delivery transform inserted after their first "/upload/".
STATIC_PREFIX = "/static/"
CDN_HOST = "res.cloudinary.com"
CDN_UPLOAD_SEGMENT = "/upload/"
CDN_TRANSFORM = "/upload/f_auto,q_auto,w_1400,c_limit/"

# Rupee display prefix (Indian digit grouping follows).
RUPEE_PREFIX = "₹ "

# Fields a product patch may change, in the shop's order.
PRODUCT_PATCH_FIELDS = ["gender", "collection", "name", "name_bn", "size", "price",
                        "stock", "image", "description", "description_bn", "sku",
                        "active"]

# Fields an order patch may change.
ORDER_PATCH_FIELDS = ["status", "tracking_number", "notes"]

# Attributes translated besides text nodes, and elements never translated.
TRANSLATED_ATTRIBUTES = ["placeholder", "title", "alt", "aria-label"]
SKIPPED_ELEMENTS = ["script", "style", "textarea"]
NO_TRANSLATE_ATTRIBUTE = "data-no-i18n"

# Column length limits (VARCHAR(n)) and NOT NULL columns of the two tables.
PRODUCT_VARCHAR = {"gender": 10, "collection": 50, "name": 100, "size": 5,
                   "image": 100, "name_bn": 200, "sku": 40}
PRODUCT_NOT_NULL = ["id", "gender", "collection", "name", "price", "stock", "image",
                    "active"]
ORDER_VARCHAR = {"customer_name": 100, "customer_phone": 20, "customer_email": 150,
                 "size": 5, "status": 20, "tracking_number": 100,
                 "razorpay_order_id": 50, "razorpay_payment_id": 50,
                 "payment_status": 20}
ORDER_NOT_NULL = ["id", "customer_name", "customer_phone", "customer_address",
                  "quantity", "price_paid", "status", "ordered_at", "payment_status"]

# --- Our own parameters (not the shop's values) -----------------------------

# Fixed "now" for repeatable retention and sweep results on the test tables.
DEFAULT_AS_OF = "1995-02-01 00:00:00"
# Shop name and admin mailbox used in notification text (placeholders).
DEFAULT_SHOP_NAME = "Loom & Co"
DEFAULT_ADMIN_EMAIL = "orders@example.com"
