"""Structured Streaming twins of the batch operators."""
from .guards import LateCounter, dedupe_stream, guard_stream, late_rows_stream, order_violations_stream
from .stateful import ema_stream, history_stream
from .windows import clip_bank_stream

__all__ = ["LateCounter", "clip_bank_stream", "dedupe_stream", "ema_stream", "guard_stream", "history_stream", "late_rows_stream",
           "order_violations_stream"]
