"""Timestamp-safe analytics for annotated action events, expressed as Spark plans."""
