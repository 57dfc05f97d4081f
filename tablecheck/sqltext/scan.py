"""A scanner: SQL as a list of tokens that joined give the text again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from tablecheck.sqltext.dialects import Dialect, dialect

SPACE, COMMENT, STRING, NAME, WORD, NUMBER, MARK = "space", "comment", "string", "name", "word", "number", "mark"
_PAIRS = ("<=>", "||", "::", "<>", "!=", "<=", ">=", "->>", "->", ":=")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    #: Brackets that are open here.
    depth: int = 0

    @property
    def upper(self) -> str:
        return self.text.upper()

    @property
    def end(self) -> int:
        return self.start + len(self.text)


def _quoted(sql: str, at: int, close: str, backslash: bool) -> int:
    """Where a quoted run that starts before `at` ends; doubled closers belong to it."""
    while at < len(sql):
        if backslash and sql[at] == "\\":
            at += 2
        elif sql[at] == close:
            if sql[at + 1 : at + 2] != close:
                return at + 1
            at += 2
        else:
            at += 1
    return len(sql)


def tokens(sql: str, d: Dialect | str = "sql") -> list[Token]:
    d = dialect(d) if isinstance(d, str) else d
    out: list[Token] = []
    at, depth, n = 0, 0, len(sql)
    while at < n:
        start, ch = at, sql[at]
        marker = next((c for c in d.comments if sql.startswith(c.strip(), at) and (not c.endswith(" ") or sql[at + len(c.strip()) : at + len(c.strip()) + 1] in (" ", "\t", "\n", "\r", ""))), None)
        if ch.isspace():
            kind = SPACE
            while at < n and sql[at].isspace():
                at += 1
        elif marker is not None:
            kind, end = COMMENT, sql.find("\n", at)
            at = n if end < 0 else end
        elif sql.startswith("/*", at):
            kind, end = COMMENT, sql.find("*/", at + 2)
            at = n if end < 0 else end + 2
        elif ch == "'" or (ch == '"' and d.double_quote_strings):
            kind, at = STRING, _quoted(sql, at + 1, ch, d.backslash)
        elif ch == '"' or ch == "`" or (ch == "[" and d.open == "["):
            kind, at = NAME, _quoted(sql, at + 1, "]" if ch == "[" else ch, False)
        elif ch == "$" and d.id in ("postgresql", "redshift", "duckdb") and (end := sql.find("$", at + 1)) > 0 and sql[at + 1 : end].replace("_", "a").isalnum() | (end == at + 1) and not sql[at + 1 : at + 2].isdigit():
            tag = sql[at : end + 1]
            close = sql.find(tag, end + 1)
            kind, at = STRING, n if close < 0 else close + len(tag)
        elif ch.isdigit() or (ch == "." and sql[at + 1 : at + 2].isdigit()):
            kind = NUMBER
            while at < n and (sql[at].isalnum() or sql[at] == "." or (sql[at] in "+-" and sql[at - 1] in "eE" and not sql[start : start + 2].lower() == "0x")):
                at += 1
        elif ch.isalpha() or ch in "_@#$" or ord(ch) > 127:
            kind = WORD
            while at < n and (sql[at].isalnum() or sql[at] in "_$@#" or ord(sql[at]) > 127):
                at += 1
        else:
            kind = MARK
            at += len(next((p for p in _PAIRS if sql.startswith(p, at)), ch))
        text = sql[start:at]
        if kind == MARK and text in ")]}":
            depth = max(0, depth - 1)
        out.append(Token(kind, text, start, depth))
        if kind == MARK and text in "([{":
            depth += 1
    return out


def code(sql: str, d: Dialect | str = "sql") -> list[Token]:
    """Tokens without blanks and comments."""
    return [t for t in tokens(sql, d) if t.kind not in (SPACE, COMMENT)]


def statements(sql: str, d: Dialect | str = "sql") -> list[str]:
    """Statements between semicolons that stand outside quotes and comments; empty ones are left out."""
    out, now = [], []
    for t in tokens(sql, d):
        if t.kind == MARK and t.text == ";":
            out.append(now)
            now = []
        else:
            now.append(t)
    return ["".join(t.text for t in part).strip() for part in [*out, now] if any(t.kind not in (SPACE, COMMENT) for t in part)]


def masked(sql: str, d: Dialect | str = "sql") -> str:
    """The text with comments blanked, strings emptied and quoted names replaced by a plain one: for patterns that look at code."""
    return "".join(" " if t.kind == COMMENT else "''" if t.kind == STRING else "quoted_name" if t.kind == NAME else t.text for t in tokens(sql, d))


def replace_words(sql: str, words: dict[str, str], d: Dialect | str = "sql", fold: bool = False) -> tuple[str, int]:
    """Whole words and quoted names of code replaced; strings and comments stay. Also how many were replaced."""
    table = {k.lower() if fold else k: v for k, v in words.items()}
    found, out = 0, []
    for t in tokens(sql, d):
        key = t.text if t.kind == WORD else t.text[1:-1] if t.kind == NAME else None
        key = key.lower() if key is not None and fold else key
        if key in table:
            found += 1
            out.append(table[key] if t.kind == WORD else t.text[0] + table[key] + t.text[-1])
        else:
            out.append(t.text)
    return "".join(out), found


def count_word(sql: str, word: str, d: Dialect | str = "sql") -> int:
    return replace_words(sql, {word: word}, d)[1]


def rewrite(sql: str, d: Dialect | str, change: Callable[[list[Token], int], str | None]) -> str:
    """Text with some tokens changed; change gets all tokens and an index, None leaves the token."""
    every = tokens(sql, d)
    return "".join(t.text if (new := change(every, i)) is None else new for i, t in enumerate(every))


def matching(every: list[Token], i: int) -> int:
    """The index of the bracket that closes the one at i; the last index if none does."""
    depth = every[i].depth
    return next((j for j in range(i + 1, len(every)) if every[j].kind == MARK and every[j].text in ")]}" and every[j].depth == depth), len(every) - 1)


def shifted(t: Token, by: int) -> Token:
    return replace(t, start=t.start + by)
