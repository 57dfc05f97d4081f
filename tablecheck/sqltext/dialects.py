"""What SQL dialects differ in, as far as text operators need it."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    id: str
    label: str
    open: str = '"'
    close: str = '"'
    backslash: bool = False
    double_quote_strings: bool = False
    comments: tuple[str, ...] = ("--",)
    null_safe: str = "distinct"
    row_limit: str = "limit"
    max_in_list: int | None = None
    integer_division: bool = False
    array_base: int | None = None
    folds: str = ""
    #: What || does: join texts, "or", or nothing.
    pipes: str = "join"
    #: Constructs that not all dialects have, by the names that `constructs` gives them.
    has: frozenset[str] = frozenset()
    aliases: tuple[str, ...] = ()

    def differs(self, a: str, b: str) -> str:
        """Inequality that counts NULL as a value."""
        if self.null_safe == "spaceship":
            return f"NOT ({a} <=> {b})"
        if self.null_safe == "spelled":
            return f"({a} <> {b} OR ({a} IS NULL AND {b} IS NOT NULL) OR ({a} IS NOT NULL AND {b} IS NULL))"
        return f"{a} IS DISTINCT FROM {b}"


def _has(names: str) -> frozenset[str]:
    return frozenset(names.split())


_BACKTICK = {"open": "`", "close": "`"}
#: Properties of the dialects.
DIALECTS = {
    d.id: d
    for d in (
        Dialect("postgresql", "PostgreSQL", integer_division=True, array_base=1, folds="lower", has=_has("colons distinct ilike"), aliases=("postgres", "pg")),
        Dialect("mysql", "MySQL", **_BACKTICK, backslash=True, double_quote_strings=True, comments=("-- ", "#"), null_safe="spaceship", pipes="or", has=_has("if spaceship")),
        Dialect("sqlite", "SQLite", integer_division=True, has=_has("distinct iif")),
        Dialect("transactsql", "SQL Server (T-SQL)", "[", "]", null_safe="spelled", row_limit="top", integer_division=True, pipes="", has=_has("charindex iif nolock"), aliases=("mssql", "sqlserver", "tsql")),
        Dialect("plsql", "Oracle", null_safe="spelled", row_limit="fetch", max_in_list=1000, folds="upper", has=_has("connect-by decode rownum"), aliases=("oracle",)),
        Dialect("mariadb", "MariaDB", **_BACKTICK, backslash=True, double_quote_strings=True, comments=("-- ", "#"), null_safe="spaceship", pipes="or", has=_has("if spaceship")),
        Dialect("snowflake", "Snowflake", backslash=True, comments=("--", "//"), array_base=0, folds="upper", max_in_list=16384, has=_has("charindex colons distinct iff ilike qualify")),
        Dialect("bigquery", "BigQuery", **_BACKTICK, backslash=True, double_quote_strings=True, comments=("--", "#"), array_base=0, has=_has("distinct if qualify")),
        Dialect("redshift", "Redshift", integer_division=True, folds="lower", has=_has("colons decode distinct ilike")),
        Dialect("trino", "Trino / Athena", integer_division=True, array_base=1, has=_has("distinct if"), aliases=("athena", "presto")),
        Dialect("spark", "Spark", **_BACKTICK, backslash=True, double_quote_strings=True, null_safe="spaceship", array_base=0, has=_has("distinct if ilike lateral-view spaceship"), aliases=("databricks",)),
        Dialect("hive", "Hive", **_BACKTICK, backslash=True, double_quote_strings=True, null_safe="spaceship", array_base=0, has=_has("distinct if lateral-view spaceship")),
        Dialect("clickhouse", "ClickHouse", **_BACKTICK, backslash=True, comments=("--", "#"), null_safe="spelled", array_base=1, has=_has("colons distinct if ilike")),
        Dialect("duckdb", "DuckDB", array_base=1, has=_has("colons distinct if ilike qualify")),
        Dialect("db2", "Db2", row_limit="fetch", integer_division=True, folds="upper", has=_has("distinct")),
        Dialect("sql", "Standard SQL", row_limit="fetch", has=_has("distinct")),
    )
}


def dialect(name: str) -> Dialect:
    key = name.lower()
    for d in DIALECTS.values():
        if key in (d.id, d.label.lower(), *d.aliases):
            return d
    raise KeyError(name)
