"""Profiles of text columns, files, and operators on SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecheck.functions import shapes
from tablecheck.functions.expr import canonical_cell
from tablecheck.queries.registry import Registry, scratch, table

REGISTRY = Registry()

_NUMBERS = """SELECT replace(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), '.', ',') AS comma, CASE WHEN o_orderkey % 4 = 0 THEN '1,234.5' ELSE CAST(o_custkey AS VARCHAR) END AS grouped, o_orderpriority AS words, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS numbers FROM orders"""


def _numbers(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(_NUMBERS.replace("VARCHAR", "STRING"))


_SHAPES = {"decimal_comma": shapes.DECIMAL_COMMA, "thousands": shapes.THOUSANDS, "plain": shapes.PLAIN}
_SHAPE_SQL = f"WITH t AS ({_NUMBERS}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(nullif(trim({c}), '')) AS n, " + ", ".join(f"count(*) FILTER (WHERE regexp_full_match(trim({c}), '{p}')) AS {k}" for k, p in _SHAPES.items()) + " FROM t"
    for c in ("comma", "grouped", "words", "numbers")
)


@REGISTRY.add(_SHAPE_SQL)
def text_shape_profile(spark, sf_dir):
    return shapes.text_shapes(_numbers(spark, sf_dir), sample=None)


@REGISTRY.add(f"SELECT column_name FROM ({_SHAPE_SQL}) WHERE n > 0 AND decimal_comma = n")
def decimal_comma_cols(spark, sf_dir):
    return shapes.decimal_comma_columns(shapes.text_shapes(_numbers(spark, sf_dir), sample=None))


@REGISTRY.add(f"SELECT column_name FROM ({_SHAPE_SQL}) WHERE thousands > 0 AND (thousands + plain) * 100 >= n * 90")
def thousands_cols(spark, sf_dir):
    return shapes.thousands_columns(shapes.text_shapes(_numbers(spark, sf_dir), sample=None))


# files and sinks


@REGISTRY.add("SELECT 'customer.parquet' AS file, CAST(64 AS INTEGER) AS hash_length")
def fingerprint(spark, sf_dir):
    from tablecheck.sources.files import fingerprint as prints

    got = prints(spark, f"{sf_dir}/customer.parquet")
    return got.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.length("sha256").alias("hash_length"))


_LINE = "CASE WHEN {0} IS NULL THEN '' WHEN {0} = '' THEN '\"\"' WHEN regexp_matches({0}, '[\",\r\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@REGISTRY.add("SELECT concat_ws(',', CAST(doc_id AS VARCHAR), " + ", ".join(_LINE.format(c) for c in ("t", "lang")) + ") AS value FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE text END AS t, lang FROM documents)")
def csv_text(spark, sf_dir):
    from tablecheck.sources.sinks import csv_lines

    t = F.when(F.col("doc_id") % 5 == 1, "").when(F.col("doc_id") % 5 != 0, F.col("text"))
    return csv_lines(table(spark, sf_dir, "documents").select("doc_id", t.alias("t"), "lang"))


@REGISTRY.add("SELECT CAST(doc_id AS VARCHAR) || chr(9) || replace(replace(replace(replace(text, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r') || chr(9) || CASE WHEN doc_id % 7 = 0 THEN '\\N' ELSE lang END AS value FROM documents")
def tsv_text(spark, sf_dir):
    from tablecheck.sources.sinks import tsv_lines

    return tsv_lines(table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang")))


@REGISTRY.add("SELECT CAST(o_totalprice > 100000 AS INTEGER)::VARCHAR AS flag, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_orderkey AS VARCHAR) AS k FROM orders WHERE o_orderdate = date_trunc('day', o_orderdate)")
def canonical_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderdate = date_trunc('DAY', o_orderdate)").select((F.col("o_totalprice") > 100000).alias("flag"), F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("k"))
    return o.select(*[canonical_cell(F.col(f.name), f.dataType).alias(f.name) for f in o.schema])


@REGISTRY.add("SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderpriority FROM orders")
def csv_round_trip(spark, sf_dir):
    """Written as CSV and loaded again with types inferred."""
    from tablecheck.sources import files, sinks

    path = f"{scratch(spark)}/csv-round-trip"
    sinks.export_csv(table(spark, sf_dir, "orders"), path)
    df, _ = files.load_csv(spark, path)
    return df.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


# SQL as text, schemas, generated data


@REGISTRY.add()
def sql_review_corpus(spark, sf_dir):
    """Findings on the oracle SQL of all queries."""
    from tablecheck.queries import ORACLE_SQL
    from tablecheck.sqltext.batch import review_corpus

    return review_corpus(spark.createDataFrame(sorted(ORACLE_SQL.items()), "path string, text string"), "duckdb")


@REGISTRY.add()
def sql_convert_corpus(spark, sf_dir):
    from tablecheck.queries import ORACLE_SQL
    from tablecheck.sqltext.batch import convert_corpus

    return convert_corpus(spark.createDataFrame(sorted(ORACLE_SQL.items()), "path string, text string"), "duckdb", "transactsql")


@REGISTRY.add("SELECT * FROM (VALUES ('o_orderkey', 'retyped'), ('o_custkey', 'unchanged'), ('o_orderstatus', 'unchanged'), ('o_totalprice', 'unchanged'), ('o_orderdate', 'unchanged'), ('o_orderpriority', 'removed'), ('loaded_at', 'added')) AS v(column_name, change)")
def schema_diff(spark, sf_dir):
    from tablecheck.schema.ddl import schema_diff as diff

    o = table(spark, sf_dir, "orders")
    t = o.withColumn("o_orderkey", F.col("o_orderkey").cast("string")).drop("o_orderpriority").withColumn("loaded_at", F.lit("2024-01-01").cast("date"))
    return diff(o, t).select("column_name", "change")


@REGISTRY.add()
def test_data(spark, sf_dir):
    from tablecheck import testdata

    specs = testdata.specs_of(table(spark, sf_dir, "customer"), "c_custkey")
    return testdata.typed_rows(testdata.generate_rows(spark, specs, 1000), specs)


@REGISTRY.add()
def insert_statements(spark, sf_dir):
    from tablecheck.sources.sinks import insert_statements as inserts

    return inserts(table(spark, sf_dir, "nation"), "nation", "postgresql", 10, ["n_nationkey"])


@REGISTRY.add()
def plan_insights(spark, sf_dir):
    """The plan of a join with groups, read back: label, rows and detail of each operator."""
    from tablecheck.plans.reader import explain

    for t in ("orders", "lineitem"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    root, notes = explain(spark, "SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
    rows = [(s.label, s.rows, s.detail) for s in root.walk()] + [("insight", None, n) for n in notes]
    return spark.createDataFrame(rows, "label string, row_count long, detail string")
