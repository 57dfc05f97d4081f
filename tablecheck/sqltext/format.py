"""A plain layout for queries: clauses on lines of their own, one item a line."""

from __future__ import annotations

from tablecheck.sqltext import scan

_NEW = {"SELECT", "FROM", "WHERE", "HAVING", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "MINUS", "QUALIFY", "WINDOW", "SET", "VALUES", "JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "NATURAL", "GROUP", "ORDER", "FETCH", "OFFSET", "WITH"}
_AFTER = {"JOIN": {"LEFT", "RIGHT", "FULL", "INNER", "CROSS", "OUTER", "NATURAL", "SEMI", "ANTI"}, "FROM": {"DISTINCT", "DELETE"}, "ALL": {"UNION"}}
_LISTS = {"SELECT", "GROUP", "ORDER", "SET"}
KEYWORDS = _NEW | set("AS ON AND OR NOT IN IS NULL LIKE ILIKE BETWEEN CASE WHEN THEN ELSE END DISTINCT ALL ASC DESC BY USING OUTER SEMI ANTI EXISTS OVER PARTITION ROWS RANGE PRECEDING FOLLOWING CURRENT ROW UNBOUNDED INSERT INTO UPDATE DELETE TRUE FALSE INTERVAL NULLS FIRST LAST FILTER ONLY NEXT LATERAL RECURSIVE".split())


def format_sql(sql: str, dialect: str = "sql", upper: bool = True, leading_commas: bool = False) -> str:
    """The same tokens with other blanks; keywords in upper case. Comments keep their place."""
    out: list[str] = []
    line = ""
    stack: list[bool] = []  # for each open bracket: does it hold a query
    clause = [""]
    last = ""
    glue = True
    toks = [t for t in scan.tokens(sql, dialect) if t.kind != scan.SPACE]

    def flush(extra: int = 0) -> None:
        nonlocal line, glue
        if line.strip():
            out.append(line.rstrip())
        line = "  " * (sum(stack) + extra)
        glue = True

    for i, t in enumerate(toks):
        word = t.upper if t.kind == scan.WORD else ""
        text = word if upper and word in KEYWORDS else t.text
        nxt = toks[i + 1].upper if i + 1 < len(toks) else ""
        if t.kind == scan.COMMENT:
            line += ("" if glue else " ") + t.text
            flush(clause[-1] in _LISTS)
            continue
        inline = bool(stack) and not stack[-1]
        if not inline and word in _NEW and last not in _AFTER.get(word, ()) and not (word in ("LEFT", "RIGHT") and nxt == "("):
            flush()
            clause[-1] = word
        elif not inline and word in ("AND", "OR") and clause[-1] in ("WHERE", "HAVING", "QUALIFY", "JOIN", "ON"):
            flush(1)
        if t.text in (")", "]") and stack:
            if stack.pop():
                clause.pop()
                flush()
            glue = True
        if t.text == ",":
            if not inline and clause[-1] in _LISTS | {"WITH", "FROM", "VALUES"}:
                if leading_commas:
                    flush(1)
                    line += ", "
                    glue = True
                else:
                    line += ","
                    flush(1)
            else:
                line += ","
                glue = False
            last = ","
            continue
        tight = glue or t.text in (".", ";", ")", "]", "::") or last in (".", "(", "[", "::") or (t.text in ("(", "[") and last not in KEYWORDS - {"LEFT", "RIGHT"} and i > 0 and toks[i - 1].kind in (scan.WORD, scan.NAME))
        line += ("" if tight else " ") + text
        glue = False
        last = word or t.text
        if t.text in ("(", "["):
            query = nxt in ("SELECT", "WITH")
            stack.append(query)
            if query:
                clause.append("")
                flush()
            glue = True
        if t.text == ";":
            flush()
    flush()
    return "\n".join(out) + "\n"
