"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def micros(c: Column) -> Column:
    """Microseconds since the epoch; the session runs in UTC."""
    return F.unix_micros(c.cast("timestamp"))


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """Half-open containment; a null bound is unbounded."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (end > at))
