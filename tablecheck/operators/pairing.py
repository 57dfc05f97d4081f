"""Which columns belong together, and which one is the key."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.functions.expr import as_counted, quoted
from tablecheck.model import ColumnPair

#: Fixed value: how key columns are named.
KEY_NAME = re.compile(r"(^id$|_id$|^id_|key$|^code$|_code$|_no$|_number$|^uuid$|_uuid$)", re.I)


def auto_pair(source: DataFrame, target: DataFrame) -> tuple[list[ColumnPair], list[str], list[str]]:
    """Pairs in source order, and the columns left over on each side.

    Names pair if they are equal, else if they are equal without case, else without case and punctuation; a pass
    never takes a column from an earlier one.
    """
    taken: dict[int, int] = {}
    for fold in (str, str.lower, lambda n: re.sub(r"[^0-9a-z]", "", n.lower())):
        free: dict[str, list[int]] = {}
        for j, f in enumerate(target.schema):
            if j not in taken.values():
                free.setdefault(fold(f.name), []).append(j)
        for i, f in enumerate(source.schema):
            if i not in taken and fold(f.name) and free.get(fold(f.name)):
                taken[i] = free[fold(f.name)].pop(0)
    s, t = source.schema.fields, target.schema.fields
    pairs = [ColumnPair(s[i].name, t[taken[i]].name, s[i].dataType, t[taken[i]].dataType) for i in sorted(taken)]
    return pairs, [f.name for i, f in enumerate(s) if i not in taken], [f.name for j, f in enumerate(t) if j not in taken.values()]


def uniqueness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, total_rows, distinct_values, non_null: one row for each column.

    Values are unpivoted to text, equal numbers to equal text, and counted with one shuffle on (column, value), so wide tables do not multiply their rows
    by an Expand for each DISTINCT, and partial sums keep hot values small.
    """
    columns = columns or df.columns
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), as_counted(F.col(quoted(c)), df.schema[c].dataType).alias("v")) for c in columns])).alias("c")
    counts = df.select(cells).groupBy("c.column_name", "c.v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column_name").agg(
        F.sum("n").alias("total_rows"), F.count("v").alias("distinct_values"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null")
    )


def unique_columns(profile: DataFrame) -> set[str]:
    return {r.column_name for r in profile.where("total_rows > 0 and distinct_values = total_rows and non_null = total_rows").collect()}


def pick_key(pairs: list[ColumnPair], unique: set[str]) -> ColumnPair | None:
    """The key to suggest among unique source columns: `id` first, then a name like a key's, else none."""
    fit = [p for p in pairs if p.source in unique]
    named = [p for p in fit if p.source.lower() == "id"] or [p for p in fit if KEY_NAME.search(p.source)]
    return named[0] if named else None
