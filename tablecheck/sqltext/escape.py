"""Values as SQL literals."""

from __future__ import annotations

import re

from tablecheck.sqltext.dialects import Dialect

_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?")


def string_literal(value: str, d: Dialect) -> str:
    text = value.replace("\\", "\\\\") if d.backslash else value
    return "'" + text.replace("'", "''") + "'"


def unescape(literal: str, d: Dialect) -> str:
    """The value of a string literal."""
    quote, body = literal[:1], literal[1:-1]
    body = body.replace(quote * 2, quote)
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body, flags=re.S) if d.backslash else body


def quote_name(name: str, d: Dialect) -> str:
    return d.open + name.replace(d.close, d.close * 2) + d.close


def is_number(value: str) -> bool:
    """Whether a value can be written as a number and stays what it is: no leading zeros, no more digits than a number keeps."""
    return bool(_NUMBER.fullmatch(value)) and len(re.sub(r"\D", "", value)) <= 38 and value != "-0"


def value_literal(value: str | None, d: Dialect, mode: str = "auto") -> str:
    """mode: auto (numbers bare), text or number."""
    if value is None:
        return "NULL"
    return value if mode == "number" or (mode == "auto" and is_number(value)) else string_literal(value, d)
