"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The white space characters that trimming removes.
WHITE_SPACE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def trimmed_key(c: Column) -> Column:
    """Reference form: white space trimmed, lower case; null if blank."""
    key = F.lower(F.btrim(c, F.lit(WHITE_SPACE)))
    return F.when(key != "", key)


#: ASCII white space and the separators of all scripts.
ANY_SPACE = r"[\s\p{Z}\x{85}]+"


def squeeze(c: Column, space: str = r"\s+") -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), space, " "))


def xml_escape(c: Column) -> Column:
    """The five XML characters; ampersand first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c
