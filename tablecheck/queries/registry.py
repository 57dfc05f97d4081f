"""A registry of queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Register a function under its name; without SQL there is no oracle."""

        def keep(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep

    def spark_sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """A query that both engines run as SQL; oracle where DuckDB needs other words."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for t in TABLES:
                if t in text:
                    table(spark, sf_dir, t).createOrReplaceTempView(t)
            return spark.sql(text)

        self.queries[name] = run
        self.sql[name] = oracle or text


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder for files that a query writes and reads: below spark.checkpoint.dir, in local mode else in the machine's own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tablecheck-")
    return f"{where.rstrip('/')}/scratch/{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """A small file written as Spark's file systems write it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(data))
    out.close()
    return path
