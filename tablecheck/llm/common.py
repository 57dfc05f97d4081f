"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns that a document table has, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows for each core up to which a table in few files is dealt out.
DEAL_ROWS = 20_000


def dealt(df: DataFrame) -> DataFrame:
    """A plain table, dealt to all cores if it has fewer files than cores and few rows; larger tables are read where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.count() <= DEAL_ROWS * cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tablecheck-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that written() made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        base = f"{shared_dir(spark)}/tables/".rpartition("://")[2].rstrip("/")
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/tables/" in name and name.rpartition("/")[0].rstrip("/").endswith(base):
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: list[str], name: str) -> str:
    """A name like that one which none of the columns has, in any case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def remainder(column: str, n: int):
    """crc32 of the id as text, modulo n: the fold that a contract names."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about `most` bytes of text each; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, lo = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > most:
            yield batch.slice(lo, i - lo)
            total, lo = 0, i
        total += n
    if batch.num_rows > lo:
        yield batch.slice(lo)


#: Bytes of a batch that goes to Python where memory is short, and the session's setting of it.
BATCH_BYTES, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bytes of a batch to BATCH_BYTES: executor and Python worker each hold a whole batch of every running task.

    Spark reads the setting when the plan runs, so it stays, for later plans too; all rows come all the same.
    """
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema, column: str = "text", most: int = 2_000_000) -> DataFrame:
    """work() on slices of bounded text; it returns a column of values by name, as schema (text or StructType) names and orders them."""
    spark = df.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                out = work(part)
                yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def texts(part: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in part.column(column).to_pylist()]


def sample_rows(df: DataFrame, by: str, most: int) -> DataFrame:
    """The `most` rows with the least hash of `by`: a bounded sample that is the same on each run."""
    return df.orderBy(F.xxhash64(F.col(by).cast("string"), F.lit(17)), by).limit(most)


def collected(docs: DataFrame, ids: DataFrame, columns: list[str], most_bytes: int) -> list:
    """On the driver: the columns of ids (a bounded sample, doc_id first) with those of docs, in order of doc_id.

    Of rows that share an id the least counts. Whole texts only: as many as hold most_bytes bytes in all, in the order of sample_rows().
    """
    size = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(ids.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.max("size").alias("size"))
    so_far = F.sum(F.col("size").cast("long")).over(Window.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), "doc_id"))  # over the sample alone
    kept = ids.join(size.withColumn("total", so_far).where(F.col("total") <= most_bytes).select("doc_id"), "doc_id")
    rows = docs.select("doc_id", *columns).join(F.broadcast(kept), "doc_id").groupBy(*ids.columns).agg(F.min(F.struct(*columns)).alias("row"))
    return rows.select(*ids.columns, "row.*").orderBy(*ids.columns).collect()


class Adam:
    """Adam on named numpy arrays, in place."""

    def __init__(self, rate: float = 0.05):
        self.rate, self.state, self.t = rate, {}, 0

    def step(self, arrays: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            m, v = self.state.setdefault(k, (np.zeros_like(arrays[k]), np.zeros_like(arrays[k])))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            arrays[k] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
