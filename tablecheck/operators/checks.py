"""Ready-made checks over the row pairs of two tables (and the catalog)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.functions.expr import as_counted, count_where, quoted, sentinel_mismatch


def joined(a: DataFrame, b: DataFrame, key: str, key_out: str | None = None) -> DataFrame:
    """Row pairs of equal keys, as aliases a and b."""
    return a.alias("a").join(b.alias("b"), F.col(f"a.{quoted(key)}") == F.col(f"b.{quoted(key_out or key)}"))


def _a(f: str):
    return F.col(f"a.{quoted(f)}")


def _b(f: str):
    return F.col(f"b.{quoted(f)}")


def value_rows(a: DataFrame, b: DataFrame, key: str, field: str, field_out: str | None = None, sentinel=None, limit: int | None = None) -> DataFrame:
    """Pairs that differ in a field, as key, input_value, output_value; null-safe, or with a sentinel in place of NULL."""
    x, y = _a(field), _b(field_out or field)
    rows = joined(a, b, key).where(~x.eqNullSafe(y) if sentinel is None else sentinel_mismatch(x, y, sentinel))
    out = rows.select(_a(key).alias(key), x.alias("input_value"), y.alias("output_value"))
    return out if limit is None else out.orderBy(*[F.col(quoted(c)).asc_nulls_last() for c in out.columns]).limit(limit)


def single_scan_audit(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A column of mismatches for each field, in one pass."""
    return joined(a, b, key).agg(*[count_where(~_a(f).eqNullSafe(_b(f))).alias(f) for f in fields])


def _long(wide: DataFrame, fields: list[str], names: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("field"), *[F.col(f"{n}_{i}").alias(n) for n in names]) for i, f in enumerate(fields)])
    return wide.select(F.inline(cells))


def mismatch_counts(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, mismatches; the most first."""
    wide = joined(a, b, key).agg(*[count_where(~_a(f).eqNullSafe(_b(f))).alias(f"mismatches_{i}") for i, f in enumerate(fields)])
    return _long(wide, fields, ["mismatches"]).orderBy(F.col("mismatches").desc(), "field")


def null_rates(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, total_rows, input_nulls, output_nulls over the row pairs."""
    sums = [x for i, f in enumerate(fields) for x in (F.count(F.lit(1)).alias(f"total_rows_{i}"), count_where(_a(f).isNull()).alias(f"input_nulls_{i}"), count_where(_b(f).isNull()).alias(f"output_nulls_{i}"))]
    return _long(joined(a, b, key).agg(*sums), fields, ["total_rows", "input_nulls", "output_nulls"])


def distinct_counts(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, input_distinct, output_distinct over the row pairs.

    Values are unpivoted as text, equal numbers as equal text, and counted by (field, side, value): one shuffle for any number of fields.
    """
    kinds = {"in": a.schema, "out": b.schema}
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(s).alias("side"), as_counted(c(f), kinds[s][f].dataType).alias("v")) for f in fields for s, c in (("in", _a), ("out", _b))])
    values = joined(a, b, key).select(F.inline(cells)).where("v is not null").groupBy("field", "side", "v").agg(F.count(F.lit(1)).alias("n"))
    some = values.groupBy("field").agg(count_where(F.col("side") == "in").alias("input_distinct"), count_where(F.col("side") == "out").alias("output_distinct"))
    every = a.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return every.join(some, "field", "left").select("field", zero("input_distinct"), zero("output_distinct"))


def range_check(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, least and greatest value of both sides over the row pairs, as numbers."""
    sums = [x for i, f in enumerate(fields) for x in (F.min(_a(f)).cast("double").alias(f"input_min_{i}"), F.max(_a(f)).cast("double").alias(f"input_max_{i}"), F.min(_b(f)).cast("double").alias(f"output_min_{i}"), F.max(_b(f)).cast("double").alias(f"output_max_{i}"))]
    return _long(joined(a, b, key).agg(*sums), fields, ["input_min", "input_max", "output_min", "output_max"])


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()])


def column_exists(spark: SparkSession, tables: dict[str, DataFrame], wanted: list[tuple[str, str]]) -> DataFrame:
    """table_name, column_name, found (0 or 1), without reading any rows."""
    rows = [(t, c, sum(x.lower() == c.lower() for x in tables[t].columns) if t in tables else 0) for t, c in wanted]
    return spark.createDataFrame(rows, "table_name string, column_name string, found long")
