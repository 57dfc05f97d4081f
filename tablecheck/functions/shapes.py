"""How the text of a column is written: decimal commas, thousands separators, plain numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.functions.expr import is_text, quoted

#: What a whole cell has to look like.
DECIMAL_COMMA = r"-?\d+,\d+"
THOUSANDS = r"-?\d{1,3}(,\d{3})+(\.\d+)?"
PLAIN = r"-?\d+(\.\d+)?"
SAMPLE = 10_000
#: Of all values, so many percent have to be numbers for a column to be read as one with thousands separators.
THOUSANDS_PERCENT = 90


def text_shapes(df: DataFrame, columns: list[str] | None = None, sample: int | None = SAMPLE) -> DataFrame:
    """One row for each text column: column_name, n, decimal_comma, thousands, plain. One pass over a bounded sample."""
    columns = columns if columns is not None else [f.name for f in df.schema if is_text(f.dataType)]
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, n long, decimal_comma long, thousands long, plain long")
    rows = df.select(*[F.trim(F.col(quoted(c))).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = rows.limit(sample) if sample else rows
    sums = []
    for i in range(len(columns)):
        c = F.nullif(F.col(f"c{i}"), F.lit(""))
        sums.append(F.count(c).alias(f"n{i}"))
        for k, shape in enumerate((DECIMAL_COMMA, THOUSANDS, PLAIN)):
            sums.append(F.count_if(c.rlike(f"^(?:{shape})$")).alias(f"s{i}_{k}"))
    wide = rows.agg(*sums)
    parts = ", ".join(f"named_struct('column_name', {_text(c)}, 'n', n{i}, 'decimal_comma', s{i}_0, 'thousands', s{i}_1, 'plain', s{i}_2)" for i, c in enumerate(columns))
    return wide.selectExpr(f"inline(array({parts}))")


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def decimal_comma_columns(shapes: DataFrame) -> DataFrame:
    """Columns of which every value has a decimal comma."""
    return shapes.where("n > 0 and decimal_comma = n").select("column_name")


def thousands_columns(shapes: DataFrame) -> DataFrame:
    """Columns with some thousands separators in which nearly all values are numbers."""
    return shapes.where(f"thousands > 0 and (thousands + plain) * 100 >= n * {THOUSANDS_PERCENT}").select("column_name")
