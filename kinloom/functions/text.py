"""Small text helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white-space class of ECMAScript regular expressions.
WS = "[ \\t\\n\\x0B\\f\\r\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


# The same class as plain characters, for the built-in trim.
WS_CHARS = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim(col: Column) -> Column:
    return F.trim(col, F.lit(WS_CHARS))


def squash(col: Column) -> Column:
    """Trim and collapse inner white space to one space."""
    return F.regexp_replace(trim(col), f"{WS}+", " ")


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def join_present(sep: str, *cols: Column) -> Column:
    """Concatenate the non-null, non-empty columns."""
    return F.concat_ws(sep, *[blank_to_null(c) for c in cols])


def pad_left(number: Column, width: int) -> Column:
    """Zero-pad without ever cutting a longer number."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def lookup(table: dict[str, str], key: Column) -> Column:
    """Literal map lookup; null where the key is absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Value of the first regular expression found in ``text``, else null."""
    out = None
    for pattern, value in rules:
        hit = text.rlike(f"(?i){pattern}")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out
