"""Files of SQL by the folder: detect, format, convert, review, report. Runs over a DataFrame of files too."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tablecheck.sqltext import scan
from tablecheck.sqltext.convert import convert
from tablecheck.sqltext.review import lint, review

#: Folders that hold no source.
SKIPPED_FOLDERS = {"node_modules", "target", "dist", "build", "venv", ".git", "dbt_packages"}
_HEADS = re.compile(r"\s*(?:(?:--[^\n]*\n|/\*.*?\*/)\s*)*\(*\s*(SELECT|WITH|INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO|CREATE|ALTER|DROP|TRUNCATE|EXPLAIN|VALUES|PIVOT|UNPIVOT|CALL|GRANT)\b", re.I | re.S)


@dataclass
class FileResult:
    path: str
    output: str
    changes: list[str] = field(default_factory=list)
    unconverted: list[tuple[str, str]] = field(default_factory=list)
    findings: list = field(default_factory=list)
    error: str = ""


def looks_like_sql(text: str) -> bool:
    """A statement, not a sentence that starts with one of its words."""
    m = _HEADS.match(text)
    if not m:
        return False
    code = [t for t in scan.code(text) if t.kind != scan.STRING]
    words = [t.upper for t in code if t.kind == scan.WORD]
    head = m[1].upper().split()[0]
    marks = sum(t.kind == scan.MARK and t.text in "*=(),;<>." for t in code)
    needs = {"SELECT": {"FROM"}, "WITH": {"AS"}, "UPDATE": {"SET"}, "CREATE": {"TABLE", "VIEW", "INDEX", "SCHEMA", "FUNCTION", "DATABASE"}, "ALTER": {"TABLE", "VIEW"}, "DROP": {"TABLE", "VIEW", "INDEX", "SCHEMA"}, "GRANT": {"ON"}, "EXPLAIN": {"SELECT", "WITH"}}.get(head)
    if head == "SELECT" and "FROM" not in words:
        return marks > 0 and not re.search(r"[a-z] [a-z]+ [a-z]+ [a-z]", text) or bool(re.fullmatch(r"\s*SELECT\s+[\w'().,+\-*/ ]+;?\s*", text, re.I) and len(words) <= 3)
    prose = re.search(r"\b(?:the|you|your|please|this|these|our)\b", re.sub(r"'[^']*'", "", text), re.I)
    return (needs is None or bool(needs & set(words))) and not (prose and marks == 0)


def is_template(text: str) -> bool:
    """Jinja of dbt models: left as it is by the converter."""
    return bool(re.search(r"\{\{[^}]*\b(?:ref|source|config|var)\s*\(|\{%", text))


def process(path: str, text: str, action: str = "convert", source: str = "sql", target: str = "sql") -> FileResult:
    out = FileResult(path, text)
    try:
        if action == "convert":
            if is_template(text):
                out.error = "holds template code; convert the compiled file"
                return out
            done = convert(text, source, target)
            out.output, out.changes, out.unconverted = done.sql, done.changes, done.unconverted
        elif action == "format":
            from tablecheck.sqltext.format import format_sql

            out.output = format_sql(text, source)
        else:
            out.findings = [*lint(text, source), *review(text, source)]
    except Exception as e:  # a file must not end the batch
        out.error = str(e)
    return out


def wanted(path: str) -> bool:
    parts = path.replace("\\", "/").split("/")
    return parts[-1].lower().endswith(".sql") and not any(p in SKIPPED_FOLDERS for p in parts[:-1])


def summary(results: list[FileResult]) -> dict[str, int]:
    return {"files": len(results), "changed": sum(bool(r.changes) for r in results), "notes": sum(len(r.unconverted) for r in results), "findings": sum(len(r.findings) for r in results), "errors": sum(bool(r.error) for r in results)}


def markdown(results: list[FileResult]) -> str:
    s = summary(results)
    lines = ["# SQL batch", "", ", ".join(f"{v} {k}" for k, v in s.items()), ""]
    for r in results:
        items = [f"error: {r.error}"] * bool(r.error) + [f"changed: {c}" for c in r.changes] + [f"by hand: {a} — {b}" for a, b in r.unconverted] + [f"line {f.line}, {f.severity}: {f.message}" for f in r.findings]
        if items:
            lines += [f"## {r.path}", "", *(f"- {x}" for x in items), ""]
    return "\n".join(lines)


def csv_report(results: list[FileResult]) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["path", "kind", "line", "name", "message"])
    for r in results:
        w.writerows([[r.path, "error", "", "", r.error]] * bool(r.error) + [[r.path, "change", "", "", c] for c in r.changes] + [[r.path, "by hand", "", a, b] for a, b in r.unconverted] + [[r.path, f.severity, f.line, f.rule, f.message] for f in r.findings])
    return out.getvalue()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of all .sql files below a folder."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sql").text(path, wholetext=True).selectExpr("_metadata.file_path as path", "value as text")


def review_corpus(texts: DataFrame, dialect: str = "sql") -> DataFrame:
    """path, rule, severity, line, message of every finding in a table of (path, text)."""
    import pandas as pd

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            rows = [(p, f.rule, f.severity, f.line, f.message) for p, t in zip(pdf["path"], pdf["text"], strict=True) if t for f in [*lint(t, dialect), *review(t, dialect)]]
            yield pd.DataFrame(rows, columns=["path", "rule", "severity", "line", "message"])

    return texts.select("path", "text").mapInPandas(run, "path string, rule string, severity string, line int, message string")


def convert_corpus(texts: DataFrame, source: str, target: str) -> DataFrame:
    """path, output, changes, by_hand, error of a table of (path, text)."""
    import pandas as pd

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            done = [process(p, t or "", "convert", source, target) for p, t in zip(pdf["path"], pdf["text"], strict=True)]
            yield pd.DataFrame([(r.path, r.output, r.changes, [a for a, _ in r.unconverted], r.error) for r in done], columns=["path", "output", "changes", "by_hand", "error"])

    return texts.select("path", "text").mapInPandas(run, "path string, output string, changes array<string>, by_hand array<string>, error string")
