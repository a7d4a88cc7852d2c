"""Streaming form of the orders source.

The reference reads whole files only; nothing in it is a stream. What is here
is the same orders input (S1) read as a file stream, and the daily item totals
(the core of A1) kept incrementally with an event-time watermark, so a
retailer can feed new order files as they arrive.
"""

from tillcast.streaming.orders import daily_totals_stream, read_orders_stream

__all__ = ["daily_totals_stream", "read_orders_stream"]
