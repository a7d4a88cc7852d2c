"""Sources and sinks: retail CSV inputs, feature tables, submission, fixture views."""

from tillcast.sources.files import (
    read_feature_table,
    read_infos,
    read_items,
    read_orders,
    submission,
    write_submission,
    write_table,
)
from tillcast.sources.fixtures import (
    EVENTS_CALENDAR,
    LINEITEM_CALENDAR,
    Calendar,
    event_infos,
    event_items,
    event_transactions,
    infos,
    items,
    transactions,
)

__all__ = [
    "read_feature_table", "read_infos", "read_items", "read_orders", "submission",
    "write_submission", "write_table", "EVENTS_CALENDAR", "LINEITEM_CALENDAR", "Calendar",
    "event_infos", "event_items", "event_transactions", "infos", "items", "transactions",
]
