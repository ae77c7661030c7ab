"""loomcart: the data work of a small size-level-stock web shop as Spark jobs.

Every operator is a function from DataFrames (and plain parameters) to a
DataFrame, built only from DataFrame / SQL expressions so that Catalyst can
push filters and prune columns into the parquet scans.  Python runs inside
tasks only where an ordered fold has no SQL form (stock reservation) and in
the stateful streaming operators.

Sub-packages:

* ``sources``   -- scans, sinks, schemas, seed rows, schema alignment
* ``functions`` -- Column-returning scalar functions (formatting, phone,
                   HMAC, whitespace normalisation, ...)
* ``operators`` -- catalogue, orders, mutations, stock, payments, quality,
                   localisation, notification outbox
* ``plans``     -- mapping of the driver's tables to the shop model and the
                   registered query builders
* ``streaming`` -- Structured Streaming versions of the time-driven jobs
"""

__all__ = ["session"]
