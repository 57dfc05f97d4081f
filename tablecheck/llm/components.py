"""Connected components of an edge table, with DataFrame operations only.

Each round, every node links to the least node in its neighbourhood (large star) and the chain of links is shortened
(small star), so a component turns into a star in about as many rounds as the logarithm of its diameter. Rounds are
written to the shared folder, which cuts the lineage; the driver sees whether all are stars. Hub nodes are the least of
their components, so rows are keyed by the other end and a hub is met as one side of a join only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

MAX_ROUNDS = 60


def connected(edges: DataFrame) -> DataFrame:
    """node, component (the least node of it) for every node of edges (a, b); nulls and loops are left out."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    now = written(pairs)
    for _ in range(MAX_ROUNDS):
        if _all_stars(now):
            break
        # large star: each larger neighbour links to the least node around u
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # (written, so that both sides of the join are dealt anew and a hub's rows can be split)
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: u and all its smaller neighbours link to the least of them
        star = large.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).select("u", "v")
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = written(small.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).select("u", "v"))
        forget(least, now)
        now = after
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())


def _all_stars(pairs: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    one, no = F.lit(1), F.lit(0)
    ends = pairs.select(F.col("u").alias("x"), one.alias("n"), no.alias("m")).union(pairs.select("v", no, one))
    return not ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("m").alias("m")).where("n > 1 or n > 0 and m > 0").take(1)
