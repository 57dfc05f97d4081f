"""A list of fields against a table."""

from __future__ import annotations

from dataclasses import dataclass, field

from tablecheck.schema.ddl import DdlColumn, canonical_type
from tablecheck.sqltext.typemap import normalise_type


@dataclass
class FieldCheck:
    unknown: list[str] = field(default_factory=list)
    type_mismatch: list[tuple[str, str, str]] = field(default_factory=list)
    uncovered: list[str] = field(default_factory=list)
    matched: int = 0


def check_fields(fields: list[tuple[str, str]], columns: list[DdlColumn]) -> FieldCheck:
    """fields: name and type (may be empty). Types compare without parameters."""
    out, known, seen = FieldCheck(), {c.name.lower(): c for c in columns}, set()
    for name, kind in fields:
        c = known.get(name.strip().strip('"`[]').lower())
        if c is None:
            out.unknown.append(name)
            continue
        seen.add(c.name.lower())
        if kind and canonical_type(normalise_type(kind)) != canonical_type(normalise_type(c.type)):
            out.type_mismatch.append((name, kind, c.type))
        else:
            out.matched += 1
    out.uncovered = [c.name for c in columns if c.name.lower() not in seen]
    return out
