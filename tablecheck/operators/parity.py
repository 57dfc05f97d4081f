"""Comparison of two copies of a table.

Both sides are first projected to positional names (k0, k1, … for keys, v0, v1, … for compared values), so no column
name can clash or be ambiguous. Every figure is one DataFrame; `run_parity` collects the few numbers and samples.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tablecheck.functions.expr import as_text, canonical_map, count_where, edges_marked, key_expr, mismatch, value_expr
from tablecheck.model import ColumnOutcome, KeyFigures, ParityOptions, ParityResult, ParitySpec

SAMPLE_LIMIT, MISSING_LIMIT = 5, 10


def side(df: DataFrame, spec: ParitySpec, which: str) -> DataFrame:
    """Keys k0… as joined on, raw keys r0…, values v0… as stored; by position, so equal names in a table do not matter."""
    flat = df.toDF(*[f"x{i}" for i in range(len(df.columns))])
    place = {name: f"x{i}" for i, name in reversed(list(enumerate(df.columns)))}
    source = which == "source"
    out = []
    for i, k in enumerate(spec.keys):
        name, kind, other = (k.source, k.source_type, k.target_type) if source else (k.target, k.target_type, k.source_type)
        c = F.col(place[name])
        out += [key_expr(c, kind, other, spec.options).alias(f"k{i}"), (canonical_map(c) if kind.typeName() == "map" else c).alias(f"r{i}")]
    for i, p in enumerate(spec.compare):
        out.append(F.col(place[p.source if source else p.target]).alias(f"v{i}"))
    return flat.select(*out)


def _keys(spec: ParitySpec, prefix: str = "k") -> list[str]:
    return [f"{prefix}{i}" for i in range(len(spec.keys))]


def _present(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def row_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    s = source.agg(F.count(F.lit(1)).alias("source_rows"))
    return s.crossJoin(target.agg(F.count(F.lit(1)).alias("target_rows")))  # one row each


def key_health(source: DataFrame, target: DataFrame, spec: ParitySpec) -> DataFrame:
    """Keys that come more than once and rows with an incomplete key, on the keys as stored."""

    def one(df: DataFrame, which: str) -> DataFrame:
        raw = _keys(spec, "r")
        counts = side(df, spec, which).groupBy(*raw).agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(
            count_where(_present(raw) & (F.col("n") > 1)).alias(f"{which}_duplicate_keys"),
            F.coalesce(F.sum(F.when(~_present(raw), F.col("n"))), F.lit(0)).alias(f"{which}_null_keys"),
        )

    return one(source, "source").crossJoin(one(target, "target"))  # one row each


def key_sides(source: DataFrame, target: DataFrame, spec: ParitySpec) -> DataFrame:
    """Each complete key with how many rows it has in source (n_s) and target (n_t): one shuffle for both sides."""
    keys = _keys(spec)
    s = side(source, spec, "source").select(*keys, F.lit(1).alias("s"), F.lit(0).alias("t"))
    t = side(target, spec, "target").select(*keys, F.lit(0).alias("s"), F.lit(1).alias("t"))
    return s.union(t).where(_present(keys)).groupBy(*keys).agg(F.sum("s").alias("n_s"), F.sum("t").alias("n_t"))


def key_coverage(source: DataFrame, target: DataFrame, spec: ParitySpec) -> DataFrame:
    return key_sides(source, target, spec).agg(
        count_where((F.col("n_s") > 0) & (F.col("n_t") > 0)).alias("matched_keys"),
        count_where(F.col("n_t") == 0).alias("only_in_source"),
        count_where(F.col("n_s") == 0).alias("only_in_target"),
    )


def missing_keys(source: DataFrame, target: DataFrame, spec: ParitySpec, which: str, limit: int | None = MISSING_LIMIT) -> DataFrame:
    """Keys that only one side has, least first."""
    other = "n_t" if which == "source" else "n_s"
    keys = key_sides(source, target, spec).where(F.col(other) == 0).select(*_keys(spec))
    ordered = keys.orderBy(*[F.col(k).asc_nulls_last() for k in _keys(spec)])
    return ordered.limit(limit) if limit is not None else keys


def paired(source: DataFrame, target: DataFrame, spec: ParitySpec) -> DataFrame:
    """Row pairs of equal keys: s and t as structs. A repeated key gives every combination."""
    s, t = side(source, spec, "source").alias("s"), side(target, spec, "target").alias("t")
    condition = F.lit(True)
    for k in _keys(spec):
        condition = condition & (F.col(f"s.{k}") == F.col(f"t.{k}"))
    return s.join(t, condition, "inner")


def _differs(spec: ParitySpec, i: int) -> Column:
    return mismatch(spec.compare[i], F.col(f"s.v{i}"), F.col(f"t.v{i}"), spec.options)


def column_diff_wide(source: DataFrame, target: DataFrame, spec: ParitySpec) -> DataFrame:
    """compared_rows, c0, c1, …: one pass over the pairs for all columns."""
    return paired(source, target, spec).agg(F.count(F.lit(1)).alias("compared_rows"), *[count_where(_differs(spec, i)).alias(f"c{i}") for i in range(len(spec.compare))])


def column_diff(source: DataFrame, target: DataFrame, spec: ParitySpec) -> DataFrame:
    """column_name, compared_rows, mismatches."""
    wide = column_diff_wide(source, target, spec)
    cells = F.array(*[F.struct(F.lit(p.source).alias("column_name"), F.col("compared_rows"), F.col(f"c{i}").alias("mismatches")) for i, p in enumerate(spec.compare)])
    return wide.select(F.inline(cells))


def column_sample(source: DataFrame, target: DataFrame, spec: ParitySpec, index: int, limit: int = SAMPLE_LIMIT) -> DataFrame:
    """k0…, source_value, target_value of pairs that disagree in one column, in key order."""
    rows = paired(source, target, spec).where(_differs(spec, index))
    keys = [F.col(f"s.r{i}").alias(f"k{i}") for i in range(len(spec.keys))]
    out = rows.select(*keys, F.col(f"s.v{index}").alias("source_value"), F.col(f"t.v{index}").alias("target_value"))
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in out.columns]).limit(limit)


def column_samples(source: DataFrame, target: DataFrame, spec: ParitySpec, indexes: list[int], limit: int = SAMPLE_LIMIT) -> DataFrame:
    """column (its index), place (from 1), k0…, source_value, target_value as text: the first pairs that disagree in each column, all columns in one pass.

    The window keeps `limit` rows of each column in every task before anything is shuffled.
    """
    cells = []
    for i in indexes:
        p = spec.compare[i]
        shown = [F.coalesce(edges_marked(as_text(c, kind)), F.lit("NULL")) for c, kind in ((F.col(f"s.v{i}"), p.source_type), (F.col(f"t.v{i}"), p.target_type))]
        cells.append(F.when(_differs(spec, i), F.struct(F.lit(i).alias("column"), shown[0].alias("source_value"), shown[1].alias("target_value"))))
    keys = [F.col(f"s.r{i}").alias(f"k{i}") for i in range(len(spec.keys))]
    rows = paired(source, target, spec).select(*keys, F.inline(F.array_compact(F.array(*cells))))
    order = [F.col(c).asc_nulls_last() for c in (*_keys(spec), "source_value", "target_value")]
    place = F.row_number().over(Window.partitionBy("column").orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("column", "place", *_keys(spec), "source_value", "target_value")


def key_profile(source: DataFrame, target: DataFrame, spec: ParitySpec) -> DataFrame:
    """row_counts, key_health and key_coverage in one row, from one pass over both sides; for keys that are joined on as stored."""
    keys = _keys(spec)
    s = side(source, spec, "source").select(*keys, F.lit(1).alias("s"), F.lit(0).alias("t"))
    t = side(target, spec, "target").select(*keys, F.lit(0).alias("s"), F.lit(1).alias("t"))
    n_s, n_t, whole = F.col("n_s"), F.col("n_t"), _present(keys)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return s.union(t).groupBy(*keys).agg(F.sum("s").alias("n_s"), F.sum("t").alias("n_t")).agg(
        total(n_s).alias("source_rows"),
        total(n_t).alias("target_rows"),
        count_where(whole & (n_s > 1)).alias("source_duplicate_keys"),
        total(F.when(~whole, n_s)).alias("source_null_keys"),
        count_where(whole & (n_t > 1)).alias("target_duplicate_keys"),
        total(F.when(~whole, n_t)).alias("target_null_keys"),
        count_where(whole & (n_s > 0) & (n_t > 0)).alias("matched_keys"),
        count_where(whole & (n_t == 0)).alias("only_in_source"),
        count_where(whole & (n_s == 0)).alias("only_in_target"),
    )


def row_projection(df: DataFrame, spec: ParitySpec, which: str) -> DataFrame:
    """The compared values as c0, c1, …, normalised."""
    rows, source = side(df, spec, which), which == "source"
    kinds = [(p.source_type, p.target_type) if source else (p.target_type, p.source_type) for p in spec.compare]
    return rows.select(*[value_expr(F.col(f"v{i}"), a, b, spec.options).alias(f"c{i}") for i, (a, b) in enumerate(kinds)])


def row_differences(source: DataFrame, target: DataFrame, spec: ParitySpec) -> DataFrame:
    """c0, c1, …, n: how many more times a row comes in the source than in the target; both directions in one shuffle."""
    columns = [f"c{i}" for i in range(len(spec.compare))]
    s = row_projection(source, spec, "source").withColumn("n", F.lit(1))
    t = row_projection(target, spec, "target").withColumn("n", F.lit(-1))
    return s.union(t).groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")


def row_set_counts(source: DataFrame, target: DataFrame, spec: ParitySpec) -> DataFrame:
    n = F.col("n")
    return row_differences(source, target, spec).agg(
        F.coalesce(F.sum(F.when(n > 0, n)), F.lit(0)).alias("only_in_source"), F.coalesce(F.sum(F.when(n < 0, -n)), F.lit(0)).alias("only_in_target")
    )


def row_set_sample(source: DataFrame, target: DataFrame, spec: ParitySpec, which: str, limit: int = MISSING_LIMIT) -> DataFrame:
    """Rows that one side has more often, each as often as it is in excess, in order."""
    n = F.col("n") if which == "source" else -F.col("n")
    columns = [f"c{i}" for i in range(len(spec.compare))]
    order = [F.col(c).asc_nulls_last() for c in columns]
    rows = row_differences(source, target, spec).withColumn("n", n).where("n > 0").orderBy(*order).limit(limit)
    return rows.withColumn("_", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(limit).cast("long"))))).select(*columns).orderBy(*order).limit(limit)


def make_spec(source: DataFrame, target: DataFrame, keys: list[str], options: ParityOptions = ParityOptions(), exclude: tuple[str, ...] = (), rename: dict[str, str] | None = None) -> tuple[ParitySpec, dict]:
    """A spec from source column names, pairing the rest by name; and what stays unpaired or excluded."""
    from tablecheck.model import ColumnPair
    from tablecheck.operators.pairing import auto_pair

    pairs, only_s, only_t = auto_pair(source, target)
    for s, t in (rename or {}).items():
        pairs = [p for p in pairs if p.source != s and p.target != t] + [ColumnPair(s, t, source.schema[s].dataType, target.schema[t].dataType)]
        only_s, only_t = [x for x in only_s if x != s], [x for x in only_t if x != t]
    by = {p.source: p for p in pairs}
    spec = ParitySpec(tuple(by[k] for k in keys), tuple(p for p in pairs if p.source not in keys and p.source not in exclude), options)
    return spec, {"unpaired_source": only_s, "unpaired_target": only_t, "excluded": list(exclude)}


def _count(value) -> int:
    """A count as an integer; nothing and NaN are 0."""
    return 0 if value is None or value != value else int(value)


def _shown(rows: list) -> list[list[str]]:
    return [["NULL" if v is None else str(v) for v in r] for r in rows]


def run_parity(source: DataFrame, target: DataFrame, spec: ParitySpec, meta: dict | None = None, progress: Callable[[str], None] | None = None) -> ParityResult:
    """All figures and samples of a comparison; samples are only taken where a count is not 0."""
    meta, began, steps = meta or {}, time.monotonic(), []

    def first(label: str, df: DataFrame):
        return rows(label, df)[0]

    def rows(label: str, df: DataFrame):
        steps.append(label)
        if progress:
            progress(label)
        return df.collect()

    outcomes = [ColumnOutcome(p) for p in spec.compare]
    keys = sets = None
    only_s: list = []
    only_t: list = []
    if spec.mode == "key" and all(k.source_type == k.target_type and not isinstance(k.source_type, MapType) for k in spec.keys):
        counts = health = cover = first("Rows, keys and their coverage", key_profile(source, target, spec))
    else:
        counts = first("Row counts", row_counts(source, target))
    if spec.mode == "key":
        if "matched_keys" not in counts:
            health = first("Duplicate and empty keys", key_health(source, target, spec))
            cover = first("Key coverage", key_coverage(source, target, spec))
        diff = first("Column differences on matched rows" if spec.compare else "Matched row pairs", column_diff_wide(source, target, spec))
        for i, o in enumerate(outcomes):
            o.mismatches = _count(diff[i + 1])
        told = ("source_duplicate_keys", "source_null_keys", "target_duplicate_keys", "target_null_keys")
        keys = KeyFigures(*(_count(health[c]) for c in told), *(_count(cover[c]) for c in ("matched_keys", "only_in_source", "only_in_target")), _count(diff[0]))
        if found := [i for i, o in enumerate(outcomes) if o.mismatches]:
            n = len(spec.keys)
            shown = column_samples(source, target, spec, found).orderBy("column", "place")
            text = shown.select("column", *[F.coalesce(F.col(f"k{j}").cast("string"), F.lit("NULL")) for j in range(n)], "source_value", "target_value")
            for i, *r in rows("Examples of differing values", text):  # SAMPLE_LIMIT for each column
                outcomes[i].samples.append({"key": r[:n], "source": r[n], "target": r[n + 1]})
        if keys.only_source:
            only_s = _shown(rows("Keys only in the source", missing_keys(source, target, spec, "source")))
        if keys.only_target:
            only_t = _shown(rows("Keys only in the target", missing_keys(source, target, spec, "target")))
    elif spec.compare:
        got = first("Rows present on one side only", row_set_counts(source, target, spec))
        sets = (_count(got[0]), _count(got[1]))
        if sets[0]:
            only_s = _shown(rows("Rows only in the source", row_set_sample(source, target, spec, "source")))
        if sets[1]:
            only_t = _shown(rows("Rows only in the target", row_set_sample(source, target, spec, "target")))
    return ParityResult(
        spec.mode, _count(counts["source_rows"]), _count(counts["target_rows"]), keys, sets, outcomes, only_s, only_t, meta.get("unpaired_source", []), meta.get("unpaired_target", []),
        meta.get("excluded", []), steps, source.sparkSession.version, (time.monotonic() - began) * 1000,
    )
