"""Names in generated SQL: quoted only where they must be."""

from __future__ import annotations

import re

from tablecheck.sqltext.dialects import Dialect
from tablecheck.sqltext.escape import quote_name

#: Words that no dialect here takes as a bare name.
RESERVED = set(
    """all alter and any array as asc authorization between both by case cast check collate column constraint create cross cube current current_date current_time current_timestamp current_user
    database date default delete desc describe distinct div drop else end escape except exists extract false fetch for foreign from full function grant group grouping having if in index inner insert
    intersect interval into is join key lateral leading left like limit localtime localtimestamp minus natural not null of offset on only or order outer over partition primary qualify range recursive
    references regexp right rlike rollup row rows schema select session_user set some table then time timestamp to top trailing true union unique unnest update user using values when where window with""".split()
)
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def must_quote(name: str) -> bool:
    return not _PLAIN.fullmatch(name) or name.lower() in RESERVED


def is_quoted(text: str, d: Dialect) -> bool:
    return len(text) > 1 and text[0] == d.open and text[-1] == d.close


def bare(text: str, d: Dialect) -> str:
    return text[1:-1].replace(d.close * 2, d.close) if is_quoted(text, d) else text


def identifier(text: str, d: Dialect) -> str:
    """A name as written in SQL; a reserved word is first folded to the case that the dialect stores."""
    name = text.strip()
    if not name or is_quoted(name, d) or not must_quote(name):
        return name
    if _PLAIN.fullmatch(name) and d.folds:
        name = getattr(name, d.folds)()
    return quote_name(name, d)


def list_name(name: str, was_quoted: bool, d: Dialect) -> str:
    """A declared name for a list of fields: quoted if its case would be lost bare."""
    return quote_name(name, d) if was_quoted and d.folds and name != getattr(name, d.folds)() else name
