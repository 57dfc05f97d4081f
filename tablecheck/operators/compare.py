"""Do two results hold the same rows?"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.functions.expr import canonical_cell, quoted
from tablecheck.operators.relational import numbered


@dataclass(frozen=True)
class Comparison:
    same: bool
    reason: str
    left_rows: int
    right_rows: int
    differing_rows: int


def canonical_rows(df: DataFrame) -> DataFrame:
    """One array of text cells a row, written so that two engines agree."""
    flat = df.toDF(*[f"x{i}" for i in range(len(df.columns))])
    return flat.select(F.array(*[F.coalesce(F.concat(F.lit("="), canonical_cell(F.col(f"x{i}"), f.dataType)), F.lit("N")) for i, f in enumerate(df.schema)]).alias("cells"))


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """cells, n: rows that come more often on the left (n > 0) or on the right (n < 0)."""
    tagged = canonical_rows(left).withColumn("n", F.lit(1)).union(canonical_rows(right).withColumn("n", F.lit(-1)))
    return tagged.groupBy("cells").agg(F.sum("n").alias("n")).where("n <> 0")


def in_position(left: DataFrame, right: DataFrame, order: list[str]) -> DataFrame:
    """Rows that differ at their position; order names the columns (of both sides) that make the order total."""

    def placed(df: DataFrame, name: str) -> DataFrame:
        rows = numbered(df, order)
        cells = [F.coalesce(F.concat(F.lit("="), canonical_cell(F.col(quoted(f.name)), f.dataType)), F.lit("N")) for f in df.schema]
        return rows.select("_p", F.array(*cells).alias(name))

    return placed(left, "l").join(placed(right, "r"), "_p", "full_outer").where(~F.col("l").eqNullSafe(F.col("r"))).select(F.col("_p").alias("position"), "l", "r")


def compare_results(left: DataFrame, right: DataFrame, order: list[str] | None = None) -> Comparison:
    """Multiset comparison, or by position where an order is given; other numbers of columns never agree."""
    n, m = left.count(), right.count()
    if len(left.columns) != len(right.columns):
        return Comparison(False, f"{len(left.columns)} columns against {len(right.columns)}", n, m, 0)
    if order:
        bad = in_position(left, right, order).count()
    else:
        bad = differing_rows(left, right).agg(F.coalesce(F.sum(F.abs("n")), F.lit(0))).first()[0]
    return Comparison(bad == 0, "" if bad == 0 else "other row counts" if n != m else "other rows", n, m, int(bad))


def is_ordered(spark, sql: str) -> bool:
    """Whether a Spark query sorts its result: a global sort at the top, maybe under limits and projections."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    while True:
        name = plan.nodeName()
        if name == "Sort":
            return bool(getattr(plan, "global")())
        if name not in ("Project", "GlobalLimit", "LocalLimit", "Offset", "SubqueryAlias", "WithCTE", "UnresolvedWith") or plan.children().size() != 1:
            return False
        plan = plan.children().apply(0)
