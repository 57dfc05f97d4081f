"""Advice on queries, and warnings on statements that change data."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tablecheck.sqltext import scan
from tablecheck.sqltext.scan import NUMBER, STRING, WORD, Token

#: Functions that keep an engine from pruning or seeking by the column inside.
WRAPPING = set(
    """DATE DATE_TRUNC DATETRUNC CAST TRY_CAST CONVERT UPPER LOWER TRIM LTRIM RTRIM SUBSTR SUBSTRING LEFT RIGHT YEAR MONTH DAY HOUR EXTRACT TO_CHAR TO_DATE DATE_FORMAT FORMAT_DATETIME TRUNC
    COALESCE NVL IFNULL ISNULL CONCAT ABS ROUND FLOOR CEIL DATE_ADD DATEADD FROM_UNIXTIME""".split()
)
CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "MINUS", "QUALIFY", "WINDOW", "FETCH", "OFFSET")
ORDERED = {"high": 0, "medium": 1, "low": 2}


@dataclass(frozen=True)
class Finding:
    rule: str
    severity: str
    line: int
    message: str


@dataclass
class _Query:
    """One SELECT with its clauses, each as (first, last) index into the tokens."""

    clauses: dict[str, tuple[int, int]]
    depth: int
    after_set: bool


def _queries(code: list[Token]) -> list[_Query]:
    out = []
    for i, t in enumerate(code):
        if t.kind != WORD or t.upper != "SELECT":
            continue
        clauses, now, start, j = {}, "SELECT", i + 1, i + 1
        while j < len(code):
            u = code[j]
            if u.depth < t.depth:
                break
            if u.kind == WORD and u.depth == t.depth and u.upper in CLAUSES and not (u.upper == "FROM" and code[j - 1].upper == "DISTINCT"):
                clauses.setdefault(now, (start, j))
                if u.upper in ("UNION", "INTERSECT", "EXCEPT", "MINUS"):
                    now = None
                    break
                now, start = u.upper, j + 1
            j += 1
        if now:
            clauses.setdefault(now, (start, j))
        out.append(_Query(clauses, t.depth, any(x.upper in ("UNION", "INTERSECT", "EXCEPT", "MINUS") and x.depth == t.depth for x in code[max(0, i - 2) : i])))
    return out


def _is_column(part: list[Token]) -> bool:
    return any(t.kind == scan.NAME or (t.kind == WORD and t.upper not in ("NULL", "TRUE", "FALSE", "DATE", "TIMESTAMP", "INTERVAL", "AND", "OR", "NOT") and (k + 1 == len(part) or part[k + 1].text != "(")) for k, t in enumerate(part))


def review(sql: str, dialect: str = "sql") -> list[Finding]:
    """Findings of all rules, the gravest first, then by line."""
    out: list[Finding] = []
    for code in _statements(sql, dialect):

        def add(rule: str, severity: str, token: Token, message: str) -> None:
            out.append(Finding(rule, severity, sql.count("\n", 0, token.start) + 1, message))

        for q in _queries(code):
            _review_query(code, q, add)
        for i, t in enumerate(code):
            if t.kind == WORD and t.upper == "NOT" and [x.upper for x in code[i + 1 : i + 4]] == ["IN", "(", "SELECT"]:
                add("not-in-subquery", "high", t, "One NULL in the subquery empties the result: use NOT EXISTS.")
            if t.kind == WORD and t.upper in ("LIKE", "ILIKE") and i + 1 < len(code) and code[i + 1].kind == STRING and code[i + 1].text[1:2] in ("%", "_"):
                add("leading-wildcard-like", "medium", t, "A pattern that starts with a wildcard reads every row.")
            if t.kind == WORD and t.upper == "COUNT" and [x.upper for x in code[i + 1 : i + 3]] == ["(", "DISTINCT"]:
                add("count-distinct", "low", t, "Exact distinct counts shuffle every value: an approximate count may do.")
    return sorted(set(out), key=lambda f: (ORDERED[f.severity], f.line, f.rule))


def _statements(sql: str, dialect: str) -> list[list[Token]]:
    out: list[list[Token]] = [[]]
    for t in scan.code(sql, dialect):
        if t.text == ";":
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


def _review_query(code: list[Token], q: _Query, add) -> None:
    lo, hi = q.clauses["SELECT"]
    select = code[lo:hi]
    head = code[lo - 1]
    for k, t in enumerate(select):
        if t.text == "*" and t.depth == q.depth and (k == 0 or select[k - 1].text in (",", ".") or select[k - 1].upper in ("DISTINCT", "ALL")):
            add("select-star", "medium", t, "Names the columns that are needed, so that the others are not read.")
            break
    if select and select[0].upper == "DISTINCT":
        add("select-distinct", "low", select[0], "DISTINCT may hide a join that multiplies rows.")
    if "FROM" not in q.clauses:
        return
    flo, fhi = q.clauses["FROM"]
    source = code[flo:fhi]
    commas = [t for k, t in enumerate(source) if t.text == "," and t.depth == q.depth and not (k + 1 < len(source) and source[k + 1].upper in ("LATERAL", "UNNEST", "TABLE"))]
    if commas:
        add("comma-join", "high" if "WHERE" not in q.clauses else "medium", commas[0], "A comma joins every row with every row unless WHERE says otherwise: use JOIN … ON.")
    table = bool(source) and source[0].text != "("
    if table and not any(c in q.clauses for c in ("WHERE", "LIMIT", "FETCH", "QUALIFY")) and not any(t.upper == "TOP" for t in select[:3]) and not any(t.upper in ("JOIN",) and t.depth == q.depth for t in source):
        add("no-filter", "low", head, "Reads the whole table: filter, best by its partition column.")
    if "ORDER" in q.clauses and not any(c in q.clauses for c in ("LIMIT", "FETCH", "OFFSET")) and not any(t.upper == "TOP" for t in select[:3]):
        add("order-by-no-limit", "low", code[q.clauses["ORDER"][0] - 1], "Sorts the whole result; a limit needs the top rows only.")
    if "WHERE" in q.clauses:
        wlo, whi = q.clauses["WHERE"]
        part = code[wlo:whi]
        for k, t in enumerate(part):
            if t.kind == WORD and t.upper in WRAPPING and k + 1 < len(part) and part[k + 1].text == "(" and t.depth >= q.depth:
                end = next((x for x in range(k + 2, len(part)) if part[x].text == ")" and part[x].depth == part[k + 1].depth), len(part))
                inside = [x for x in part[k + 2 : end] if x.kind not in (NUMBER, STRING)]
                after = part[end + 1].upper if end + 1 < len(part) else ""
                before = part[k - 1].upper if k else ""
                compared = after in ("=", "<", ">", "<=", ">=", "<>", "!=", "BETWEEN", "IN", "LIKE", "IS", "NOT") or before in ("=", "<", ">", "<=", ">=", "<>", "!=")
                if compared and _is_column(inside):
                    add("function-on-filtered-column", "medium", t, f"{t.upper}() around a column keeps the filter from pruning: compare the bare column.")


def lint(sql: str, dialect: str = "sql") -> list[Finding]:
    """UPDATE and DELETE without WHERE, TRUNCATE, DROP."""
    out = []
    for code in _statements(sql, dialect):
        heads = [t for t in code if t.kind == WORD and t.depth == code[0].depth]
        words = [t.upper for t in heads]
        line = sql.count("\n", 0, code[0].start) + 1
        verb = next((w for w in words if w in ("SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "DROP", "CREATE", "ALTER", "MERGE")), "")
        if verb in ("UPDATE", "DELETE") and "WHERE" not in words:
            out.append(Finding(f"{verb.lower()}-without-where", "high", line, f"{verb} without WHERE changes every row."))
        if verb == "TRUNCATE":
            out.append(Finding("truncate", "high", line, "TRUNCATE empties the table."))
        if verb == "DROP":
            m = re.search(r"DROP\s+(\w+)", " ".join(words))
            out.append(Finding("drop", "high", line, f"DROP removes a {m[1].lower() if m else 'object'}."))
    return out
