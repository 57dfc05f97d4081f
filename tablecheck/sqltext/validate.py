"""Syntax of a query by Spark's own parser; queries of some other dialects are put in its words first, the others say that they have none."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tablecheck.sqltext import constructs, scan
from tablecheck.sqltext.convert import convert
from tablecheck.sqltext.dialects import dialect as by_name
from tablecheck.sqltext.generate import VARIABLE


@dataclass(frozen=True)
class Syntax:
    status: str
    message: str = ""
    line: int = 0
    column: int = 0


def probe(template: str) -> tuple[str, list[tuple[int, int, int]]]:
    """A template with names in place of its variables, and (place in the probe, place in the template, length) of each."""
    out, at, places = "", 0, []
    for m in VARIABLE.finditer(template):
        out += template[at : m.start()]
        places.append((len(out), m.start(), len(m[0])))
        out += "v_" + m[1]
        at = m.end()
    return out + template[at:], places


def original_offset(offset: int, places: list[tuple[int, int, int]], names: list[int]) -> int:
    """A place in the probe as a place in the template."""
    shift = 0
    for (p, t, n), width in zip(places, names, strict=True):
        if offset < p:
            break
        if offset < p + width:
            return t
        shift = t + n - (p + width)
    return offset + shift


#: Dialects whose queries Spark's grammar reads once names, strings and row limits are rewritten.
READ = ("duckdb", "hive", "mariadb", "mysql", "postgresql", "redshift", "trino")


def validate(spark: SparkSession, sql: str, dialect: str = "spark") -> Syntax:
    """valid, invalid (with the first place that cannot be read) or unavailable.

    A query of another dialect is invalid if it holds a construct that the dialect lacks, and is read in Spark's words
    otherwise; where it holds one that only Spark lacks, nothing can be said.
    """
    if dialect == "spark":
        return _parsed(spark, sql)
    d = by_name(dialect)
    if d.id not in READ:
        return Syntax("unavailable", f"no parser for {dialect}")
    if foreign := constructs.foreign(probe(sql)[0], d):
        token, name = foreign
        return Syntax("invalid", f"{d.label} has no {name}", probe(sql)[0].count("\n", 0, token.start) + 1)
    found = _parsed(spark, convert(sql, d.id, "spark").sql)
    if found.status == "invalid" and any(c.id in d.has and c.id not in by_name("spark").has and c.find(scan.code(sql, d)) for c in constructs.CONSTRUCTS):
        return Syntax("unavailable", "holds constructs that the parser does not know")
    return found


def _parsed(spark: SparkSession, sql: str) -> Syntax:
    text, places = probe(sql)
    try:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(text.strip().rstrip(";"))
        return Syntax("valid")
    except Exception as e:
        m = re.search(r"line (\d+), pos (\d+)", str(e))
        first = next((x.strip() for x in str(e).splitlines() if x.strip()), "syntax error")
        if not m:
            return Syntax("invalid", first)
        lines = text.split("\n")
        at = sum(len(x) + 1 for x in lines[: int(m[1]) - 1]) + int(m[2])
        at = original_offset(at, places, [len(n) + 2 for n in VARIABLE.findall(sql)])
        return Syntax("invalid", first, sql.count("\n", 0, at) + 1, at - (sql.rfind("\n", 0, at) + 1) + 1)
