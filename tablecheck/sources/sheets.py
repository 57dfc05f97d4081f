"""Spreadsheets of SQL: CSV and XLSX cells with the place they come from, and write-back of changed cells only."""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


@dataclass(frozen=True)
class Cell:
    row: int
    column: int
    value: str
    #: CSV: offsets of the field in the text. XLSX: -1.
    start: int = -1
    end: int = -1
    sheet: str = ""
    ref: str = ""


def parse_csv(text: str, delimiter: str = ",") -> list[list[Cell]]:
    """Fields by RFC 4180 with their offsets: quotes, doubled quotes, any line end, a leading mark."""
    rows: list[list[Cell]] = []
    now: list[Cell] = []
    at = 1 if text.startswith("﻿") else 0
    field = re.compile(r'"((?:[^"]|"")*)"?([^%s\r\n]*)|([^%s\r\n]*)' % (re.escape(delimiter), re.escape(delimiter)))
    while at < len(text):
        m = field.match(text, at)
        value = m[1].replace('""', '"') + m[2] if m[1] is not None else m[3]
        now.append(Cell(len(rows), len(now), value, at, m.end()))
        at = m.end()
        if text.startswith(delimiter, at):
            at += len(delimiter)
            if at == len(text) or text[at] in "\r\n":
                now.append(Cell(len(rows), len(now), "", at, at))
            else:
                continue
        if at < len(text):
            at += 2 if text.startswith("\r\n", at) else 1
        rows.append(now)
        now = []
    return rows + ([now] if now else [])


def write_csv(text: str, changes: dict[tuple[int, int], str], delimiter: str = ",") -> str:
    """The text with some cells (row, column) replaced, all else as it was."""
    cells = [c for row in parse_csv(text, delimiter) for c in row if (c.row, c.column) in changes]
    for c in sorted(cells, key=lambda c: -c.start):
        value = changes[c.row, c.column]
        was_quoted = text[c.start : c.start + 1] == '"'
        if was_quoted or re.search(r'["\r\n]|^\s|\s$', value) or delimiter in value:
            value = '"' + value.replace('"', '""') + '"'
        text = text[: c.start] + value + text[c.end :]
    return text


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def read_xlsx(data: bytes) -> list[Cell]:
    """Text cells of all sheets; formulas are left out."""
    out: list[Cell] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for c in ElementTree.fromstring(z.read(name)).iter(f"{_MAIN}c"):
                if c.find(f"{_MAIN}f") is not None:
                    continue
                kind, v = c.get("t"), c.find(f"{_MAIN}v")
                value = shared[int(v.text)] if kind == "s" and v is not None else "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if kind == "inlineStr" else (v.text or "") if kind == "str" and v is not None else None
                if value is not None:
                    ref = c.get("r")
                    out.append(Cell(int(re.search(r"\d+", ref)[0]) - 1, _column(ref), value, sheet=name, ref=ref))
    return out


def write_xlsx(data: bytes, changes: dict[tuple[str, str], str]) -> bytes:
    """The workbook with some cells (sheet, reference) replaced by inline text; other parts are copied byte for byte."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for item in z.infolist():
            part = z.read(item.filename)
            for (sheet, ref), value in changes.items():
                if sheet == item.filename:
                    part = _spliced(part.decode(), ref, value).encode()
            w.writestr(item, part)
    return out.getvalue()


def _spliced(xml: str, ref: str, value: str) -> str:
    def cell(m: re.Match) -> str:
        style = re.search(r'\bs="\d+"', m[1])
        return f'<c r="{ref}"{" " + style[0] if style else ""} t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    return re.sub(rf'<c\b([^>]*\br="{ref}"[^>]*?)(?:/>|>.*?</c>)', cell, xml, count=1, flags=re.S)
