"""Expressions that compared values, keys and displayed cells are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.model import ColumnPair, ParityOptions

#: Slack on any positive tolerance: 1840.50 - 1840.49 is a little more than 0.01 as doubles.
SLACK = 1e-9


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))


def plain_double(column: Column) -> Column:
    """A double as text without exponent up to 16 digits, so that both engines write it alike."""
    whole = (column == F.floor(column)) & (F.abs(column) < F.lit(1e16))
    text = column.cast("string")
    return F.when(whole, F.concat(column.cast("decimal(38,0)").cast("string"), F.lit(".0"))).when(
        text.contains("E") & (F.abs(column) < F.lit(1e16)) & (F.abs(column) >= F.lit(1e-4)), F.regexp_replace(column.cast("decimal(38,18)").cast("string"), r"0+$", "")
    ).otherwise(text)


def canonical_map(column: Column) -> Column:
    """A map as JSON of its entries in key order; maps themselves cannot be compared."""
    return F.to_json(F.array_sort(F.map_entries(column)))


def as_text(column: Column, kind: T.DataType) -> Column:
    if is_text(kind):
        return column
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return plain_double(column.cast("double"))
    if isinstance(kind, T.MapType):
        return canonical_map(column)
    if isinstance(kind, (T.StructType, T.ArrayType)):
        return F.to_json(column)
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    return column.cast("string")


def as_counted(column: Column, kind: T.DataType) -> Column:
    """Text that is equal for equal values: both zeros of floating numbers are one, and maps that differ in order."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (column.cast("double") + F.lit(0.0)).cast("string")
    if isinstance(kind, T.MapType):
        return canonical_map(column)
    return F.hex(column) if isinstance(kind, T.BinaryType) else column.cast("string")


def value_expr(column: Column, kind: T.DataType, other: T.DataType, options: ParityOptions) -> Column:
    """What one side of a pair is compared as: numbers as numbers, equal types natively, anything else as text."""
    if is_numeric(kind) and is_numeric(other):
        return column
    if kind == other and not is_text(kind):
        return canonical_map(column) if isinstance(kind, T.MapType) else column
    out = as_text(column, kind)
    if options.trim:
        out = F.trim(out)
    if options.ignore_case:
        out = F.lower(out)
    if options.empty_as_null:
        out = F.nullif(out, F.lit(""))
    return out


def key_expr(column: Column, kind: T.DataType, other: T.DataType, options: ParityOptions = ParityOptions()) -> Column:
    """What a key is joined on: itself if both types agree, else its text. Relaxations never apply to keys."""
    if options.numeric_keys and is_numeric(kind) and is_numeric(other):
        return column.cast("decimal(38,10)") if kind != other else column
    return (canonical_map(column) if isinstance(kind, T.MapType) else column) if kind == other else as_text(column, kind)


def uses_tolerance(pair: ColumnPair, options: ParityOptions) -> bool:
    return options.tolerance > 0 and is_numeric(pair.source_type) and is_numeric(pair.target_type)


def mismatch(pair: ColumnPair, source: Column, target: Column, options: ParityOptions) -> Column:
    """True where the pair disagrees; NULL agrees with NULL."""
    s = value_expr(source, pair.source_type, pair.target_type, options)
    t = value_expr(target, pair.target_type, pair.source_type, options)
    if uses_tolerance(pair, options):
        far = F.abs(s - t) > F.lit(options.tolerance + SLACK)
        return (s.isNull() != t.isNull()) | F.coalesce(far, F.lit(False))
    return ~s.eqNullSafe(t)


def sentinel_mismatch(a: Column, b: Column, sentinel) -> Column:
    """Inequality with a stand-in for NULL; misses a NULL against the stand-in itself."""
    return F.coalesce(a, F.lit(sentinel)) != F.coalesce(b, F.lit(sentinel))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def edges_marked(column: Column) -> Column:
    """Leading and trailing blanks, tabs and line ends made visible."""
    lead = F.regexp_extract(column, r"^[ \t\r\n]+", 0)
    rest = F.regexp_replace(column, r"^[ \t\r\n]+", "")
    tail = F.regexp_extract(rest, r"[ \t\r\n]+$", 0)
    body = F.regexp_replace(rest, r"[ \t\r\n]+$", "")
    return F.concat(F.translate(lead, " \t\n\r", "␣⇥↵↵"), body, F.translate(tail, " \t\n\r", "␣⇥↵↵"))


def canonical_cell(column: Column, kind: T.DataType) -> Column:
    """A cell as text that two engines agree on: booleans 1 and 0, numbers to 12 digits, midnight cut, bytes as hex."""
    if isinstance(kind, T.BooleanType):
        return F.when(column, "1").when(~column, "0")
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        text = F.format_string("%.11e", column.cast("double"))
        rounded = text.cast("double")
        return F.when(column.isNull(), F.lit(None)).when(rounded == F.floor(rounded), F.when(F.abs(rounded) < 1e18, rounded.cast("long").cast("string")).otherwise(rounded.cast("string"))).otherwise(plain_double(rounded))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.regexp_replace(F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"( 00:00:00)?\.?0*$", "")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(column))
    return as_text(column, kind)
