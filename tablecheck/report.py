"""Reports of a comparison: HTML that stands alone, with a machine-readable block, and Markdown."""

from __future__ import annotations

import html
import json
import re
from datetime import UTC, datetime

from tablecheck.model import Assessment, ParityOptions, ParityResult

TITLES = {"match": "The tables match", "match-with-gaps": "What was compared matches", "differs": "The tables differ"}


def utc_stamp(when: datetime | None = None) -> str:
    return (when or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%d %H:%M UTC")


def report_filename(source: str, target: str, when: datetime | None = None, suffix: str = "html") -> str:
    slug = re.sub(r"[^a-z0-9]+", "-", f"{source}-{target}".lower()).strip("-")
    return f"parity-{slug}-{(when or datetime.now(UTC)).astimezone(UTC):%Y%m%d-%H%M}.{suffix}"


def human_bytes(n: int) -> str:
    size, unit = float(n), "B"
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if size < 1024 or unit == "TB":
            break
        size /= 1024
    return f"{n} B" if unit == "B" else f"{size:.1f} {unit}"


def share(part: int, whole: int) -> str:
    """A percentage; a dash of nothing, and never 0 % for something."""
    if not whole:
        return "—"
    p = 100 * part / whole
    return "<0.01%" if 0 < p < 0.01 else f"{p:.2f}%".replace(".00%", "%")


def settings(options: ParityOptions) -> dict:
    return {"trim": options.trim, "ignore_case": options.ignore_case, "empty_as_null": options.empty_as_null, "tolerance": options.tolerance}


def figures(result: ParityResult) -> list[tuple[str, str]]:
    rows = [("Source rows", f"{result.source_rows:,}"), ("Target rows", f"{result.target_rows:,}")]
    if k := result.keys:
        rows += [("Matched keys", f"{k.matched:,}"), ("Only in source", f"{k.only_source:,}"), ("Only in target", f"{k.only_target:,}"), ("Repeated keys", f"{k.source_duplicates:,} / {k.target_duplicates:,}"), ("Incomplete keys", f"{k.source_nulls:,} / {k.target_nulls:,}"), ("Compared row pairs", f"{k.compared_rows:,}")]
    if result.row_sets:
        rows += [("Rows only in source", f"{result.row_sets[0]:,}"), ("Rows only in target", f"{result.row_sets[1]:,}")]
    return rows


def machine_block(result: ParityResult, assessment: Assessment, options: ParityOptions) -> str:
    """JSON that is safe inside a script element."""
    data = {
        "verdict": assessment.verdict, "findings": assessment.findings, "gaps": assessment.gaps, "mode": result.mode, "settings": settings(options), "figures": dict(figures(result)),
        "columns": [{"source": c.pair.source, "target": c.pair.target, "mismatches": c.mismatches} for c in result.columns], "engine": result.engine_version,
    }
    return json.dumps(data, ensure_ascii=False, indent=1).replace("<", "\\u003c")


def report_html(result: ParityResult, assessment: Assessment, options: ParityOptions = ParityOptions(), source: str = "source", target: str = "target", samples: bool = True, fingerprints: dict | None = None, when: datetime | None = None) -> str:
    e = html.escape
    pairs = result.keys.compared_rows if result.keys else 0

    def table(head: list[str], rows: list[list[str]]) -> str:
        return "<table><tr>" + "".join(f"<th>{e(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{e(str(c))}</td>" for c in r) + "</tr>" for r in rows) + "</table>"

    def items(texts) -> str:
        return "<ul>" + "".join(f"<li>{e(t)}</li>" for t in texts) + "</ul>" if texts else "<p>None.</p>"

    parts = [
        f"<h1>{e(TITLES[assessment.verdict])}</h1><p>{e(source)} against {e(target)}, {utc_stamp(when)}, Spark {e(result.engine_version)}</p>",
        "<h2>Findings</h2>" + items(assessment.findings), "<h2>Not covered</h2>" + items(assessment.gaps), "<h2>Figures</h2>" + table(["figure", "value"], [list(x) for x in figures(result)]),
    ]
    if result.columns:
        rows = [[c.pair.source, c.pair.target, c.pair.source_type.simpleString(), c.pair.target_type.simpleString(), f"{c.mismatches:,}", share(c.mismatches, pairs)] for c in result.columns]
        parts.append("<h2>Columns</h2>" + table(["source", "target", "source type", "target type", "mismatches", "share"], rows))
    if samples:
        for c in result.columns:
            if c.samples:
                parts.append(f"<h3>{e(c.pair.source)}</h3>" + table(["key", "source", "target"], [[", ".join(s["key"]), s["source"], s["target"]] for s in c.samples]))
        for name, rows in (("Only in the source", result.only_source_samples), ("Only in the target", result.only_target_samples)):
            if rows:
                parts.append(f"<h3>{name}</h3>" + table([f"k{i}" for i in range(len(rows[0]))], rows))
    if fingerprints:
        parts.append("<h2>Files</h2>" + table(["file", "size", "SHA-256"], [[n, human_bytes(b), h or "not computed"] for n, (b, h) in fingerprints.items()]))
    parts.append("<h2>Steps</h2>" + items(result.steps))
    style = "body{font:15px sans-serif;max-width:60rem;margin:2rem auto}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:.25rem .5rem;text-align:left}"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{e(TITLES[assessment.verdict])}</title><style>{style}</style></head><body>{"".join(parts)}<script type="application/json" id="parity">{machine_block(result, assessment, options)}</script></body></html>'


def report_markdown(result: ParityResult, assessment: Assessment, source: str = "source", target: str = "target") -> str:
    pairs = result.keys.compared_rows if result.keys else 0
    cell = lambda x: str(x).replace("|", "\\|")
    lines = [f"## {TITLES[assessment.verdict]}", "", f"`{source}` against `{target}`", "", "| figure | value |", "| --- | --- |", *(f"| {a} | {b} |" for a, b in figures(result)), ""]
    if result.columns:
        lines += ["| column | mismatches | share |", "| --- | --- | --- |", *(f"| {cell(c.pair.source)} | {c.mismatches:,} | {share(c.mismatches, pairs)} |" for c in result.columns), ""]
    for title, texts in (("Findings", assessment.findings), ("Not covered", assessment.gaps)):
        if texts:
            lines += [f"**{title}**", "", *(f"- {t}" for t in texts), ""]
    return "\n".join(lines)
