"""Structured Streaming operators."""

from .batchlog import BatchLog  # noqa: F401
from .ledger import (  # noqa: F401
    confirm_once_for_ever, confirm_step, patch_messages, patch_step, reservation_by_ledger, reservation_step, seen_log,
    stock_as_of, stock_log,
)

from .reservations import (  # noqa: F401
    abandoned_from_events, abandoned_timers_from_events, abandoned_with_corrections, abandoned_with_timers, abandoned_reservations, confirm_once, confirm_once_from_events, keyed_state_store,
    outbox_sink, reservation_batches_from_table, reservation_by_batches, reservation_from_table, run_available_now, stream_events, stream_table,
    streaming_reservation,
)
