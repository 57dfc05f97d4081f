"""Exact top-k search by inner product with a pivot table.

Vectors are integers (floor(256 x)). A table of exact distances from every vector to many pivots is computed once and written
with the vectors. By the triangle inequality it gives a lower bound of the distance of query and candidate: the largest
difference of their table rows; with both norms that is an upper bound of the inner product.

Each candidate belongs to the group of its nearest pivot. Of every group, the driver holds the span of distances to each
pivot and the largest norm (as many rows as there are pivots). A first pass scores each query against a bounded
sample of each group (FIRST rows), which gives a score that k candidates reach. A query then goes only to groups whose bound reaches
that score, in a grid of blocks; there, candidates are evaluated in the order of their own bounds until none left can reach
the best k found so far. Bounds are rounded so that ties are never lost. `search` can tell how many pairs were evaluated.

Defined cases: vectors that are null or empty, or hold a null or non-finite component, take no part, nor do rows without
id; a query with fewer than k candidates returns all; ties go to the smaller id; a row is never its query's
candidate, but other rows of the same id are; repeated rows take part each; vectors of different lengths raise a ValueError;
scores are exact while they fit a 64-bit integer; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, sample_rows, written
from .ngram_join import by_cell

QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Candidates evaluated at a time in the order of their bounds; sampled candidates of each group in the first pass.
STEP, FIRST = 256, 64
#: Products of so large sums at most are computed in floating point; how much two distances of the table may be off, as a part of the larger.
EXACT, SLACK = 2.0**52, 2.5e-7


def integers(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """row, vec_id and the integer components x of each vector that takes part."""
    x = F.col(column)
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    good = vectors.where(F.col(id_column).isNotNull() & F.coalesce(whole, F.lit(False)))
    return good.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("long")).alias("x"))


def pick_pivots(vectors: DataFrame, pivots: int = 48, sample: int = 2000) -> np.ndarray:
    """Pivots of a bounded sample, each the farthest from those before it, the first the farthest from the centre."""
    rows = sample_rows(vectors, "row", sample).select("x").collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r.x for r in rows], np.float64)
    nearest = ((x - x.mean(axis=0)) ** 2).sum(axis=1)
    chosen: list[int] = []
    for _ in range(min(pivots, len(x))):
        best = int(nearest.argmax())
        chosen.append(best)
        d = ((x - x[best]) ** 2).sum(axis=1)
        nearest = d if len(chosen) == 1 else np.minimum(nearest, d)
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def _matrix(column, kind=np.float64) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy().reshape(len(column), -1).astype(kind, copy=False)


def tabled(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """row, vec_id, x, near (the nearest pivot) and the distances to all pivots."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = distances(_matrix(batch.column("x")), pivots)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * len(pivots)), pa.array(table.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "x")), pa.array(table.argmin(axis=1).astype(np.int32)), lists], ["row", "vec_id", "x", "near", "distance"])

    return rows.mapInArrow(work, "row long, vec_id long, x array<long>, near int, distance array<float>")


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q, exact."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * len(q) < EXACT:
        return (x @ q).astype(np.int64)
    return (x.astype(np.int64) * q.astype(np.int64)).sum(axis=1)


def upper(norm: np.ndarray, q_norm: float, bound: np.ndarray) -> np.ndarray:
    """What an inner product can be at most, rounded up, from norms and a lower bound of the distance."""
    return (norm + q_norm - bound * bound) / 2 + 0.5 + 1e-9 * (norm + q_norm)


class Block:
    """Candidates in the order of ids, with their distances to the pivots."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, table: np.ndarray):
        order = np.lexsort((rows, ids))  # so that equal scores come in the order of ids
        self.rows, self.ids, self.x = rows[order], ids[order], x[order]
        self.table = np.ascontiguousarray(table[order].T)  # pivot by pivot
        self.norm, self.far = (self.x * self.x).sum(axis=1), self.table.max()

    def best(self, row: int, q: np.ndarray, distance: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the k best for a query, and how many candidates were evaluated; those below least need not be found."""
        bound = np.abs(self.table[0] - distance[0])
        for mine, its in zip(self.table[1:], distance[1:], strict=True):
            np.maximum(bound, np.abs(mine - its), out=bound)
        bound = np.maximum(bound - SLACK * max(self.far, distance.max()), 0)
        limit = upper(self.norm, float(q @ q), bound)
        limit[self.rows == row] = -np.inf
        rest = np.flatnonzero((limit >= least) & (limit > -np.inf))
        found, scores, evaluated = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while len(rest):
            # the best bounds first, more of them at a time; everything whose bound no longer reaches the k-th score falls away
            n = min(len(rest), max(STEP, evaluated))
            if n < len(rest):
                rest = rest[np.argpartition(-limit[rest], n - 1)]
            part, rest = rest[:n], rest[n:]
            evaluated += n
            score = products(self.x[part], q)
            found, scores = np.concatenate([found, part]), np.concatenate([scores, score])
            top = np.lexsort((found, -scores))[:k]
            found, scores = found[top], scores[top]
            if len(scores) == k:
                least = max(least, float(scores[-1]))
            rest = rest[limit[rest] >= least]
        return found, scores, evaluated


def _first_scores(asked: DataFrame, sample: dict, k: int) -> DataFrame:
    """asked with least: a score that k of the sampled candidates reach for each query, less than any if there are not so many."""
    columns = asked.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.full(batch.num_rows, -np.inf)
            if batch.num_rows:
                for i, (row, q) in enumerate(zip(batch.column("row").to_pylist(), _matrix(batch.column("x")), strict=True)):
                    score = products(sample["x"], q)[sample["rows"] != row]
                    if len(score) >= k:
                        least[i] = np.partition(score, -k)[-k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(least)], [*columns, "least"])

    return asked.mapInArrow(work, asked.withColumn("least", F.lit(0.0)).schema)


def _sent(asked: DataFrame, groups: list) -> DataFrame:
    """asked with near: a row for each group whose bound reaches the query's first score."""
    near = np.array([g.near for g in groups], np.int32)
    low, high, norm = np.array([g.low for g in groups]), np.array([g.high for g in groups]), np.array([g.norm for g in groups])
    columns = asked.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, table, least = _matrix(batch.column("x")), _matrix(batch.column("distance")), batch.column("least").to_numpy()
            gap = np.zeros((len(q), len(near)))
            for j in range(table.shape[1]):
                np.maximum(gap, np.maximum(low[None, :, j] - table[:, j, None], table[:, j, None] - high[None, :, j]), out=gap)
            gap = np.maximum(gap - SLACK * max(table.max(), high.max()), 0)
            at, group = np.nonzero(upper(norm[None, :], (q * q).sum(axis=1)[:, None], gap) >= least[:, None])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(near[group])], [*columns, "near"])

    return asked.mapInArrow(work, asked.withColumn("near", F.lit(0)).schema)


def search(vectors: DataFrame, queries, k: int = 5, pivots: int = 48, id_column: str = "vec_id", column: str = "embedding", counts: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score; queries is a condition on vec_id. With counts, instead: evaluated, the pairs scored in blocks, and pairs, all there are."""
    rows = written(integers(vectors, id_column, column))
    if rows.select(F.size("x").alias("n")).distinct().limit(2).count() > 1:
        raise ValueError("vectors of different lengths")
    chosen = pick_pivots(rows, pivots)
    table, m = written(tabled(rows, chosen)), len(chosen)
    forget(rows)
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    spans = [f(F.get("distance", F.lit(j))).cast("double").alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(m)]
    told = table.groupBy("near").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm"), *spans)
    arrays = [F.array(*[F.col(f"{name}{j}") for j in range(m)]).alias(name) for name in ("low", "high")]
    groups = told.select("near", "n", "norm", *arrays).collect()  # one row for each pivot at most
    order = Window.partitionBy("near").orderBy(F.xxhash64("row", F.lit(29)), "row")
    some = table.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= FIRST).select("row", "x").collect()  # FIRST rows for each pivot
    sample = {"rows": np.array([r.row for r in some], np.int64), "x": np.array([r.x for r in some], np.float64)}
    asked = written(_sent(_first_scores(table.where(queries).select("row", "vec_id", "x", "distance"), sample, k), groups))
    sizes = {g.near: g.n for g in groups}
    wanted = {r.near: r.n for r in asked.groupBy("near").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each pivot at most

    def blocks(of: dict, size: int):
        out = F.lit(1)
        for near, n in of.items():
            if n > size:
                out = F.when(F.col("near") == near, F.lit(-(-n // size))).otherwise(out)
        return out

    def block(n, salt: int):
        return F.pmod(F.xxhash64("row", F.lit(salt)), n).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    q_blocks, c_blocks = blocks(wanted, QUERY_BLOCK), blocks(sizes, CANDIDATE_BLOCK)
    columns = ["near", "qb", "cb", "row", "vec_id", "x", "distance", "least"]
    q = asked.withColumn("qb", block(q_blocks, 1)).withColumn("cb", every(c_blocks)).select(*columns, F.lit(True).alias("is_query"))
    c = table.where(F.col("near").isin(list(wanted))).withColumn("least", F.lit(0.0)).withColumn("qb", every(q_blocks)).withColumn("cb", block(c_blocks, 2)).select(*columns, F.lit(False).alias("is_query"))
    cells = q.union(c).repartition("near", "qb", "cb").sortWithinPartitions("near", "qb", "cb")
    names = ["query_row", "query_id", "vec_id", "row", "score", "evaluated"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in by_cell(batches, ("near", "qb", "cb")):
            is_query = cell.column("is_query").to_numpy()
            if not is_query.any() or is_query.all():
                continue
            ids, line, x, distance, least = cell.column("vec_id").to_numpy(), cell.column("row").to_numpy(), _matrix(cell.column("x")), _matrix(cell.column("distance")), cell.column("least").to_numpy()
            given = Block(line[~is_query], ids[~is_query], x[~is_query], distance[~is_query])
            out: list[tuple] = []
            for i in np.flatnonzero(is_query).tolist():
                at, score, evaluated = given.best(int(line[i]), x[i], distance[i], float(least[i]), k)
                out.append((int(line[i]), int(ids[i]), None, None, None, evaluated))
                out += [(int(line[i]), int(ids[i]), *found, 0) for found in zip(given.ids[at].tolist(), given.rows[at].tolist(), score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names)

    found = cells.mapInArrow(work, ", ".join(f"{n} long" for n in names))
    if counts:
        pairs = table.where(queries).count() * max(0, sum(sizes.values()) - 1)
        return found.agg(F.coalesce(F.sum("evaluated"), F.lit(0)).alias("evaluated")).withColumn("pairs", F.lit(pairs))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"), F.col("row")))
    return found.where("vec_id is not null").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH f AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM f q JOIN f c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
