"""Escapes and small string functions, ASCII where Spark's own are Unicode."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(c: Column) -> Column:
    """Without spaces, tabs and line ends around it."""
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+\z", "")


def to_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def ends_with_any(c: Column, endings: list[str]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | c.endswith(e)
    return out


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def csv_escape(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[,"\n\r]'), quoted).otherwise(c)


def json_escape(c: Column) -> Column:
    named = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    for a, b in named.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    for i in range(32):
        if chr(i) not in named:
            c = F.replace(c, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return c


def oneline(c: Column, width: int = 80) -> Column:
    """White space runs as one space; over ``width`` bytes cut with dots, before a character that would be split."""
    flat = F.regexp_replace(c, "[ \n\r\t]+", " ")
    room = max(width - 3, 0)
    head = F.substring(flat, 1, room)
    # characters after which the bytes exceed the room: all but the first one of each further byte
    fits = F.filter(F.sequence(F.lit(0), F.lit(room)), lambda n: F.octet_length(F.substring(head, F.lit(1), n)) <= room)
    short = F.when(F.octet_length(head) <= room, head).otherwise(F.substring(head, F.lit(1), F.array_max(fits)))
    return F.when(F.octet_length(flat) > width, F.concat(short, F.lit("." * min(width, 3)))).otherwise(flat)


def fixed(c: Column, digits: int = 2) -> Column:
    """As text with ``digits`` decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(c, digits))


def severity(c: Column) -> Column:
    return F.when(c >= 70, "hi").when(c >= 30, "mid").otherwise("lo")
