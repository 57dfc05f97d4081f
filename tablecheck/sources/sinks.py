"""Writers: CSV and TSV that keep NULL and empty apart, JSON Lines, INSERT statements, SQL files, archives."""

from __future__ import annotations

import io
import re
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.functions.expr import as_text, quoted


def export_csv(df: DataFrame, path: str) -> None:
    """All rows: NULL empty, empty text as "", values as they are."""
    df.select(*[as_text(F.col(quoted(f.name)), f.dataType).alias(f.name) for f in df.schema]).write.mode("overwrite").options(
        header=True, escape='"', quote='"', emptyValue='""', nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def _quoted_if(c: Column, pattern: str) -> Column:
    return F.when(c.rlike(pattern), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_lines(df: DataFrame) -> DataFrame:
    """value: a CSV line for each row; NULL empty, empty text as ""."""
    cells = []
    for f in df.schema:
        c = as_text(F.col(quoted(f.name)), f.dataType)
        cells.append(F.when(c.isNull(), "").when(c == "", '""').otherwise(_quoted_if(c, r'[",\r\n]')))
    return df.select(F.concat_ws(",", *cells).alias("value"))


def tsv_lines(df: DataFrame) -> DataFrame:
    """value: a line of COPY text for each row; NULL as \\N, backslash, tab and line ends escaped."""
    cells = []
    for f in df.schema:
        c = as_text(F.col(quoted(f.name)), f.dataType)
        for raw, written in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            c = F.replace(c, F.lit(raw), F.lit(written))
        cells.append(F.coalesce(c, F.lit("\\N")))
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def careful_csv_lines(df: DataFrame) -> DataFrame:
    """As csv_lines, and values with blanks at an edge are quoted; lines are meant to end with CR LF."""
    cells = []
    for f in df.schema:
        c = as_text(F.col(quoted(f.name)), f.dataType)
        cells.append(F.when(c.isNull(), "").when(c == "", '""').otherwise(_quoted_if(c, r'[",\r\n]|^\s|\s$')))
    return df.select(F.concat_ws(",", *cells).alias("value"))


def json_lines(df: DataFrame) -> DataFrame:
    """value: a JSON object for each row, nulls included; decimals as text, which readers keep exact."""
    safe = []
    for f in df.schema:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("string")
        safe.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))


#: Dialects with words of their own for dates and booleans.
TYPED_DATES = {"postgresql", "plsql", "snowflake", "bigquery", "redshift", "trino", "spark", "hive", "duckdb", "db2", "sql"}
BIT_BOOLEANS = {"transactsql", "plsql", "mysql", "mariadb", "sqlite"}
BACKSLASH = {"mysql", "mariadb", "bigquery", "spark", "hive", "clickhouse"}


def sql_literal(c: Column, kind: T.DataType, dialect: str) -> Column:
    """A value as a literal of a dialect."""
    if isinstance(kind, T.BooleanType):
        yes, no = ("1", "0") if dialect in BIT_BOOLEANS else ("TRUE", "FALSE")
        out = F.when(c, yes).otherwise(no)
    elif isinstance(kind, T.NumericType):
        out = as_text(c, kind)
    elif isinstance(kind, T.BinaryType):
        out = F.concat(F.lit("0x" if dialect == "transactsql" else "X'"), F.hex(c), F.lit("" if dialect == "transactsql" else "'"))
    else:
        text = as_text(c, kind)
        if dialect in BACKSLASH:
            text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        text = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
        typed = dialect in TYPED_DATES
        word = "DATE " if typed and isinstance(kind, T.DateType) else "TIMESTAMP " if typed and isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else ""
        out = F.concat(F.lit(word), text)
    return F.coalesce(out, F.lit("NULL"))


def insert_statements(df: DataFrame, table: str, dialect: str = "sql", batch: int = 100, order: list[str] | None = None) -> DataFrame:
    """batch, value: INSERT statements of up to `batch` rows each; Oracle gets one row a statement."""
    from tablecheck.operators.relational import numbered
    from tablecheck.sqltext.dialects import dialect as find
    from tablecheck.sqltext.identifiers import identifier

    d = find(dialect)
    names = ", ".join(identifier(f.name, d) for f in df.schema)
    row = F.concat(F.lit("("), F.concat_ws(", ", *[sql_literal(F.col(quoted(f.name)), f.dataType, dialect) for f in df.schema]), F.lit(")")).alias("value")
    size = 1 if dialect == "plsql" else batch
    rows = numbered(df, order or df.columns, "_p").select(F.floor((F.col("_p") - 1) / F.lit(size)).alias("batch"), "_p", row)
    grouped = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("_p", "value"))).alias("rows"))  # `batch` rows at most
    values = F.array_join(F.transform("rows", lambda r: r["value"]), ",\n  ")
    return grouped.select("batch", F.concat(F.lit(f"INSERT INTO {identifier(table, d)} ({names}) VALUES\n  "), values, F.lit(";")).alias("value"))


def sql_file(queries: list[tuple[str, str]]) -> str:
    """Named queries in one file."""
    return "\n\n".join(f"-- {name}\n{sql.strip().rstrip(';')};" for name, sql in queries) + "\n"


def query_filename(index: int, name: str, total: int) -> str:
    slug = re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or "query"
    return f"{index:0{max(2, len(str(total)))}d}-{slug}.sql"


def zip_files(files: dict[str, str | bytes]) -> bytes:
    """An archive of files by path, the same bytes each time."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            data = files[name]
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data.encode() if isinstance(data, str) else data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def xlsx_bytes(rows: list[list[str]], sheet: str = "queries") -> bytes:
    """A workbook of one sheet of text cells."""
    from xml.sax.saxutils import escape

    def name(i: int) -> str:
        return (name(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)

    body = "".join(
        f'<row r="{r}">' + "".join(f'<c r="{name(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for i, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1)
    )
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    return zip_files(
        {
            "[Content_Types].xml": f'<?xml version="1.0"?><Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
            "_rels/.rels": f'<?xml version="1.0"?><Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<?xml version="1.0"?><Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
        }
    )
