"""Fingerprints and deterministic ids, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def length_prefixed(*fields: Column) -> Column:
    """SHA-256 over each field's UTF-8 bytes after their length in four bytes; null counts as empty."""
    parts = []
    for f in fields:
        f = F.coalesce(f.cast("string"), F.lit(""))
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(f)), 8, "0")), F.encode(f, "UTF-8")]
    return F.sha2(F.concat(*parts), 256)


def nul_joined(*fields: Column) -> Column:
    """SHA-256 over fields joined by NUL; null counts as empty, so it keeps its place."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)


def name_uuid(name: Column) -> Column:
    """Name-based UUID of version 3 without a namespace."""
    h = F.md5(name)
    high = F.substr(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), high, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
