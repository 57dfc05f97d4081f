"""Comparison of two copies of a table: the copy is derived, with faults of every kind planted in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.functions.expr import edges_marked
from tablecheck.model import ParityOptions, ParitySpec
from tablecheck.operators import checks, compare, pairing, parity
from tablecheck.queries.registry import Registry, table

REGISTRY = Registry()

#: Runs unchanged in both engines.
ORDERS_COPY = """
SELECT CASE WHEN o_orderkey % 103 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey,
  o_custkey,
  CASE WHEN o_orderkey % 83 = 0 THEN '' WHEN o_orderkey % 79 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 73 = 0 THEN o_totalprice + 0.01 ELSE o_totalprice END AS o_totalprice,
  o_orderdate,
  CASE WHEN o_orderkey % 97 = 0 THEN concat(o_orderpriority, ' ') WHEN o_orderkey % 89 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority,
  CAST('2024-01-01' AS DATE) AS loaded_at
FROM orders WHERE o_orderkey % 101 <> 0
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, CAST('2024-01-01' AS DATE)
FROM orders WHERE o_orderkey % 107 = 0 AND o_orderkey % 101 <> 0 AND o_orderkey % 103 <> 0
"""
COMPARED = ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
#: Keys with NULLs planted.
NULL_KEYS = "SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 70 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus FROM orders"
TURNS_COPY = """
SELECT conv_id, CASE WHEN turn % 5 = 4 THEN turn + 100 ELSE turn END AS turn, role, CASE WHEN conv_id % 7 = 0 THEN upper(role) ELSE role END AS role_out FROM conversations WHERE (conv_id + turn) % 11 <> 0
"""


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = table(spark, sf_dir, name)
    df.createOrReplaceTempView(name)
    return df


def orders_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source = _view(spark, sf_dir, "orders")
    return source, spark.sql(ORDERS_COPY)


def orders_spec(spark: SparkSession, sf_dir: str, options: ParityOptions = ParityOptions(), keys: tuple[str, ...] = ("o_orderkey",)) -> tuple[DataFrame, DataFrame, ParitySpec]:
    s, t = orders_pair(spark, sf_dir)
    spec, _ = parity.make_spec(s, t, list(keys), options, exclude=("o_custkey",) if keys else ())
    return s, t, spec


RELAXED = ParityOptions(trim=True, ignore_case=True, empty_as_null=True, tolerance=0.01)
_T = f"t AS ({ORDERS_COPY})"
_ON = "FROM orders s JOIN t ON s.o_orderkey = t.o_orderkey"


def _long(counts: dict[str, str], source: str = _ON) -> str:
    head = ", ".join(f"count(*) FILTER (WHERE {p}) AS c{i}" for i, p in enumerate(counts.values()))
    rows = " UNION ALL ".join(f"SELECT '{c}' AS column_name, n AS compared_rows, c{i} AS mismatches FROM w" for i, c in enumerate(counts))
    return f"WITH {_T}, w AS (SELECT count(*) AS n, {head} {source}) {rows}"


STRICT_SQL = {c: f"s.{c} IS DISTINCT FROM t.{c}" for c in COMPARED}
_text = lambda a: f"nullif(lower(trim({a})), '')"
RELAXED_SQL = {c: f"{_text('s.' + c)} IS DISTINCT FROM {_text('t.' + c)}" for c in COMPARED} | {
    "o_totalprice": "(s.o_totalprice IS NULL) <> (t.o_totalprice IS NULL) OR abs(s.o_totalprice - t.o_totalprice) > 0.01 + 1e-9",
    "o_orderdate": "s.o_orderdate IS DISTINCT FROM t.o_orderdate",
}


@REGISTRY.add(f"WITH {_T} SELECT (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM t) AS target_rows")
def row_counts(spark, sf_dir):
    return parity.row_counts(*orders_pair(spark, sf_dir))


def _health_sql(source: str, target: str, keys: list[str]) -> str:
    k, present, empty = ", ".join(keys), " AND ".join(f"{x} IS NOT NULL" for x in keys), " OR ".join(f"{x} IS NULL" for x in keys)
    parts = [
        f"(SELECT count(*) FROM (SELECT {k} FROM ({q}) WHERE {present} GROUP BY {k} HAVING count(*) > 1)) AS {n}_duplicate_keys, (SELECT count(*) FROM ({q}) WHERE {empty}) AS {n}_null_keys"
        for n, q in (("source", source), ("target", target))
    ]
    return "SELECT " + ", ".join(parts)


@REGISTRY.add(_health_sql("SELECT * FROM orders", ORDERS_COPY, ["o_orderkey"]))
def key_health(spark, sf_dir):
    return parity.key_health(*orders_spec(spark, sf_dir))


@REGISTRY.add(_health_sql("SELECT * FROM orders", NULL_KEYS, ["o_orderkey", "o_custkey"]))
def key_health_composite(spark, sf_dir):
    s = _view(spark, sf_dir, "orders")
    t = spark.sql(NULL_KEYS)
    spec, _ = parity.make_spec(s, t, ["o_orderkey", "o_custkey"])
    return parity.key_health(s, t, spec)


@REGISTRY.add(_health_sql("SELECT * FROM lineitem", "SELECT * FROM lineitem WHERE l_linenumber > 1", ["l_orderkey", "l_linenumber"]))
def key_health_natural_duplicates(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem")
    t = s.where("l_linenumber > 1")
    spec, _ = parity.make_spec(s, t, ["l_orderkey", "l_linenumber"])
    return parity.key_health(s, t, spec)


def _coverage_sql(source: str, target: str, keys: list[tuple[str, str]]) -> str:
    def one(q, at):
        return f"SELECT DISTINCT {', '.join(f'{k[at]} AS k{i}' for i, k in enumerate(keys))} FROM ({q}) WHERE {' AND '.join(f'{k[at]} IS NOT NULL' for k in keys)}"

    on = " AND ".join(f"a.k{i} = b.k{i}" for i in range(len(keys)))
    return (
        f"SELECT count(*) FILTER (WHERE a.k0 IS NOT NULL AND b.k0 IS NOT NULL) AS matched_keys, count(*) FILTER (WHERE b.k0 IS NULL) AS only_in_source, "
        f"count(*) FILTER (WHERE a.k0 IS NULL) AS only_in_target FROM ({one(source, 0)}) a FULL OUTER JOIN ({one(target, 1)}) b ON {on}"
    )


@REGISTRY.add(_coverage_sql("SELECT * FROM orders", ORDERS_COPY, [("o_orderkey", "o_orderkey")]))
def key_coverage(spark, sf_dir):
    return parity.key_coverage(*orders_spec(spark, sf_dir))


@REGISTRY.add(_coverage_sql("SELECT * FROM orders", NULL_KEYS, [("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey")]))
def key_coverage_null_keys(spark, sf_dir):
    s = _view(spark, sf_dir, "orders")
    t = spark.sql(NULL_KEYS)
    spec, _ = parity.make_spec(s, t, ["o_orderkey", "o_custkey"])
    return parity.key_coverage(s, t, spec)


@REGISTRY.add(_coverage_sql("SELECT * FROM orders", f"SELECT CAST(o_orderkey AS VARCHAR) AS k FROM ({ORDERS_COPY})", [("CAST(o_orderkey AS VARCHAR)", "k")]))
def key_coverage_mixed_type(spark, sf_dir):
    s, t = orders_pair(spark, sf_dir)
    t = t.withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    spec, _ = parity.make_spec(s, t, ["o_orderkey"])
    return parity.key_coverage(s, t, spec)


_TURNS = [("conv_id", "conv_id"), ("turn", "turn")]


def _turns(spark, sf_dir):
    s = _view(spark, sf_dir, "conversations")
    t = spark.sql(TURNS_COPY)
    spec, _ = parity.make_spec(s, t, ["conv_id", "turn"], rename={"role": "role_out"})
    return s, t, ParitySpec(spec.keys, tuple(p for p in spec.compare if p.source == "role"), spec.options)


@REGISTRY.add(_coverage_sql("SELECT * FROM conversations", TURNS_COPY, _TURNS))
def key_coverage_composite(spark, sf_dir):
    return parity.key_coverage(*_turns(spark, sf_dir))


@REGISTRY.add(
    f"SELECT 'role' AS column_name, count(*) AS compared_rows, count(*) FILTER (WHERE s.role IS DISTINCT FROM t.role_out) AS mismatches FROM conversations s JOIN ({TURNS_COPY}) t ON s.conv_id = t.conv_id AND s.turn = t.turn"
)
def column_diff_composite_renamed(spark, sf_dir):
    return parity.column_diff(*_turns(spark, sf_dir))


def _missing_sql(have: str, lack: str, limit: int | None) -> str:
    tail = f" ORDER BY k0 LIMIT {limit}" if limit else ""
    return f"WITH {_T} SELECT DISTINCT o_orderkey AS k0 FROM {have} h WHERE NOT EXISTS (SELECT 1 FROM {lack} l WHERE l.o_orderkey = h.o_orderkey){tail}"


@REGISTRY.add(_missing_sql("orders", "t", None))
def missing_in_target(spark, sf_dir):
    return parity.missing_keys(*orders_spec(spark, sf_dir), "source", None)


@REGISTRY.add(_missing_sql("t", "orders", None))
def missing_in_source(spark, sf_dir):
    return parity.missing_keys(*orders_spec(spark, sf_dir), "target", None)


@REGISTRY.add(_missing_sql("orders", "t", parity.MISSING_LIMIT))
def missing_key_sample(spark, sf_dir):
    return parity.missing_keys(*orders_spec(spark, sf_dir), "source")


@REGISTRY.add(_long(STRICT_SQL))
def column_diff(spark, sf_dir):
    return parity.column_diff(*orders_spec(spark, sf_dir))


@REGISTRY.add(_long(RELAXED_SQL))
def column_diff_relaxed(spark, sf_dir):
    return parity.column_diff(*orders_spec(spark, sf_dir, RELAXED))


@REGISTRY.add(_long(STRICT_SQL | {"o_totalprice": RELAXED_SQL["o_totalprice"]}))
def column_diff_tolerance(spark, sf_dir):
    return parity.column_diff(*orders_spec(spark, sf_dir, ParityOptions(tolerance=0.01)))


_FAN = "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 13 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_partkey % 3 <> 0"


@REGISTRY.add(
    f"SELECT 'l_quantity' AS column_name, count(*) AS compared_rows, count(*) FILTER (WHERE s.l_quantity IS DISTINCT FROM t.l_quantity) AS mismatches FROM lineitem s JOIN ({_FAN}) t ON s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber"
)
def column_diff_fan_out(spark, sf_dir):
    s = _view(spark, sf_dir, "lineitem")
    t = spark.sql(_FAN)
    spec, _ = parity.make_spec(s, t, ["l_orderkey", "l_linenumber"])
    return parity.column_diff(s, t, spec)


@REGISTRY.add(
    "SELECT 'o_custkey' AS column_name, count(*) AS compared_rows, count(*) FILTER (WHERE CAST(s.o_custkey AS VARCHAR) IS DISTINCT FROM t.o_custkey) AS mismatches FROM orders s JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN concat('0', CAST(o_custkey AS VARCHAR)) ELSE CAST(o_custkey AS VARCHAR) END AS o_custkey FROM orders) t ON s.o_orderkey = t.o_orderkey"
)
def column_diff_mixed_type(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    text = F.col("o_custkey").cast("string")
    t = s.withColumn("o_custkey", F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("0"), text)).otherwise(text))
    spec, _ = parity.make_spec(s, t, ["o_orderkey"])
    return parity.column_diff(s, t, spec)


@REGISTRY.add(
    "WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS v FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS v FROM orders) SELECT 'v' AS column_name, count(*) AS compared_rows, count(*) FILTER (WHERE nullif(a.v, '') IS DISTINCT FROM nullif(b.v, '')) AS mismatches FROM a JOIN b ON a.o_orderkey = b.o_orderkey"
)
def column_diff_empty_as_null(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    fifth = F.col("o_orderkey") % 5 == 0
    s = o.select("o_orderkey", F.when(fifth, "").otherwise(F.col("o_orderstatus")).alias("v"))
    t = o.select("o_orderkey", F.when(~fifth, F.col("o_orderstatus")).alias("v"))
    spec, _ = parity.make_spec(s, t, ["o_orderkey"], ParityOptions(empty_as_null=True))
    return parity.column_diff(s, t, spec)


@REGISTRY.add(f"WITH {_T} SELECT s.o_orderkey AS k0, s.o_orderpriority AS source_value, t.o_orderpriority AS target_value {_ON} WHERE s.o_orderpriority IS DISTINCT FROM t.o_orderpriority ORDER BY 1, 2, 3 LIMIT 5")
def column_diff_sample(spark, sf_dir):
    s, t, spec = orders_spec(spark, sf_dir)
    return parity.column_sample(s, t, spec, [p.source for p in spec.compare].index("o_orderpriority"))


_SHARED = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_A, _B = f"SELECT {_SHARED} FROM orders", f"SELECT {_SHARED} FROM t"
_C = ", ".join(f"{c} AS c{i}" for i, c in enumerate(_SHARED.split(", ")))


@REGISTRY.add(f"WITH {_T} SELECT (SELECT count(*) FROM ({_A} EXCEPT ALL {_B})) AS only_in_source, (SELECT count(*) FROM ({_B} EXCEPT ALL {_A})) AS only_in_target")
def row_set_counts(spark, sf_dir):
    return parity.row_set_counts(*orders_spec(spark, sf_dir, keys=()))


@REGISTRY.add("SELECT (SELECT count(*) FROM (SELECT text FROM documents EXCEPT ALL SELECT DISTINCT text FROM documents)) AS only_in_source, CAST(0 AS BIGINT) AS only_in_target")
def row_set_counts_repeats(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("text")
    t = s.distinct()
    spec, _ = parity.make_spec(s, t, [])
    return parity.row_set_counts(s, t, spec)


def _row_sample_sql(a: str, b: str) -> str:
    return f"WITH {_T} SELECT {_C} FROM ({a} EXCEPT ALL {b}) ORDER BY c0, c1, c2, c3, c4, c5 LIMIT {parity.MISSING_LIMIT}"


@REGISTRY.add(_row_sample_sql(_A, _B))
def row_set_sample_source(spark, sf_dir):
    return parity.row_set_sample(*orders_spec(spark, sf_dir, keys=()), "source")


@REGISTRY.add(_row_sample_sql(_B, _A))
def row_set_sample_target(spark, sf_dir):
    return parity.row_set_sample(*orders_spec(spark, sf_dir, keys=()), "target")


@REGISTRY.add(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(DISTINCT {c}) AS distinct_values, count({c}) AS non_null FROM t0"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    ).join(("WITH t0 AS (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'F') AS o_orderstatus, o_orderpriority FROM orders) ", ""))
)
def uniqueness(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"), "o_orderpriority")
    return pairing.uniqueness(o)


@REGISTRY.add(
    f"""WITH {_T}, k AS ({_coverage_sql("SELECT * FROM orders", "SELECT * FROM t", [("o_orderkey", "o_orderkey")])}),
    h AS ({_health_sql("SELECT * FROM orders", "SELECT * FROM t", ["o_orderkey"])}), d AS (SELECT count(*) AS compared_rows, {", ".join(f"count(*) FILTER (WHERE {p}) AS {c}" for c, p in STRICT_SQL.items())} {_ON})
    SELECT (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM t) AS target_rows, h.source_duplicate_keys, h.source_null_keys, h.target_duplicate_keys, h.target_null_keys, k.*, d.* FROM k, h, d"""
)
def verdict_inputs(spark, sf_dir):
    s, t, spec = orders_spec(spark, sf_dir)
    wide = parity.column_diff_wide(s, t, spec).toDF("compared_rows", *[p.source for p in spec.compare])
    return parity.row_counts(s, t).crossJoin(parity.key_health(s, t, spec)).crossJoin(parity.key_coverage(s, t, spec)).crossJoin(wide)  # one row each


_WRITTEN = {"o_custkey": "CAST({} AS VARCHAR)", "o_orderstatus": "{}", "o_orderpriority": "regexp_replace({}, ' $', '␣')"}


@REGISTRY.add(
    f"WITH {_T}, ks AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1), kt AS (SELECT o_orderkey AS k, count(*) AS n FROM t GROUP BY 1) SELECT (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM t) AS target_rows, "
    "(SELECT count(*) FROM ks WHERE n > 1) AS source_duplicates, (SELECT count(*) FROM kt WHERE n > 1) AS target_duplicates, (SELECT count(*) FROM ks JOIN kt USING (k)) AS matched, (SELECT count(*) FROM ks ANTI JOIN kt USING (k)) AS only_source, "
    f"(SELECT count(*) FROM kt ANTI JOIN ks USING (k)) AS only_target, (SELECT count(*) {_ON}) AS compared_rows, 'differs' AS verdict"
)
def parity_run_figures(spark, sf_dir):
    """The figures of a whole run, and its verdict."""
    from tablecheck.operators.verdict import assess

    s, t = orders_pair(spark, sf_dir)
    spec, meta = parity.make_spec(s, t, ["o_orderkey"])
    r = parity.run_parity(s, t, spec, meta)
    k = r.keys
    row = (r.source_rows, r.target_rows, k.source_duplicates, k.target_duplicates, k.matched, k.only_source, k.only_target, k.compared_rows, assess(r, spec.options).verdict)
    return spark.createDataFrame([row], "source_rows long, target_rows long, source_duplicates long, target_duplicates long, matched long, only_source long, only_target long, compared_rows long, verdict string")


@REGISTRY.add(
    f"WITH {_T}, d AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, s.o_orderkey, coalesce({w.format('s.' + c)}, 'NULL') AS source_value, coalesce({w.format('t.' + c)}, 'NULL') AS target_value {_ON} WHERE s.{c} IS DISTINCT FROM t.{c}" for c, w in _WRITTEN.items()
    )
    + ") SELECT * FROM (SELECT column_name, CAST(row_number() OVER (PARTITION BY column_name ORDER BY o_orderkey, source_value, target_value) AS INTEGER) AS place, CAST(o_orderkey AS VARCHAR) AS key, source_value, target_value FROM d) WHERE place <= 5"
)
def parity_run_examples(spark, sf_dir):
    """The examples that a whole run shows, of three columns."""
    s, t = orders_pair(spark, sf_dir)
    spec, meta = parity.make_spec(s, t, ["o_orderkey"], exclude=("o_totalprice", "o_orderdate"))
    columns = parity.run_parity(s, t, spec, meta).columns
    rows = [(o.pair.source, i + 1, x["key"][0], x["source"], x["target"]) for o in columns for i, x in enumerate(o.samples)]
    return spark.createDataFrame(rows, "column_name string, place int, key string, source_value string, target_value string")


@REGISTRY.add("SELECT 'x' AS field, count(DISTINCT CASE WHEN o_orderkey % 3 < 2 THEN 0 ELSE o_orderkey % 5 END) AS input_distinct, count(DISTINCT CASE WHEN o_orderkey % 3 < 2 THEN 0 ELSE o_orderkey % 5 END) AS output_distinct FROM orders")
def distinct_count_of_zeros(spark, sf_dir):
    """0.0 and -0.0 are one value."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    z = spark.sql("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 0.0D WHEN 1 THEN -0.0D ELSE CAST(o_orderkey % 5 AS DOUBLE) END AS x FROM orders")
    return checks.distinct_counts(z, z, "o_orderkey", ["x"])


@REGISTRY.add()
def parity_run(spark, sf_dir):
    """The whole run: findings and gaps of its verdict."""
    from tablecheck.operators.verdict import assess

    s, t = orders_pair(spark, sf_dir)
    spec, meta = parity.make_spec(s, t, ["o_orderkey"])
    a = assess(parity.run_parity(s, t, spec, meta), spec.options)
    return spark.createDataFrame([(a.verdict, "finding", x) for x in a.findings] + [(a.verdict, "gap", x) for x in a.gaps], "verdict string, kind string, text string")


@REGISTRY.add(f"WITH {_T} SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '% ' THEN concat(rtrim(o_orderpriority), '␣') ELSE o_orderpriority END AS marked FROM t")
def edge_whitespace_marked(spark, sf_dir):
    _, t = orders_pair(spark, sf_dir)
    return t.select("o_orderkey", edges_marked(F.col("o_orderpriority")).alias("marked"))


@REGISTRY.add(f"WITH {_T}, d AS ((SELECT o_orderkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_orderkey, o_orderstatus FROM t) UNION ALL (SELECT o_orderkey, o_orderstatus FROM t EXCEPT ALL SELECT o_orderkey, o_orderstatus FROM orders)) SELECT count(*) AS differing_rows FROM d")
def compare_results(spark, sf_dir):
    s, t = orders_pair(spark, sf_dir)
    rows = compare.differing_rows(s.select("o_orderkey", "o_orderstatus"), t.select("o_orderkey", "o_orderstatus"))
    return rows.agg(F.coalesce(F.sum(F.abs("n")), F.lit(0)).alias("differing_rows"))


@REGISTRY.add(
    "WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) AS p, c_custkey, c_mktsegment FROM customer), b AS (SELECT row_number() OVER (ORDER BY c_custkey) AS p, c_custkey, c_mktsegment FROM customer WHERE c_custkey % 40 <> 7) SELECT count(*) AS differing_positions FROM a FULL OUTER JOIN b ON a.p = b.p WHERE a.c_custkey IS DISTINCT FROM b.c_custkey OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment"
)
def compare_in_position(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return compare.in_position(c, c.where("c_custkey % 40 <> 7"), ["c_custkey"]).agg(F.count(F.lit(1)).alias("differing_positions"))


# checks


@REGISTRY.add(f"WITH {_T} SELECT s.o_orderkey, s.o_orderstatus AS input_value, t.o_orderstatus AS output_value {_ON} WHERE coalesce(s.o_orderstatus, 'F') <> coalesce(t.o_orderstatus, 'F')")
def sentinel_diff(spark, sf_dir):
    return checks.value_rows(*orders_pair(spark, sf_dir), "o_orderkey", "o_orderstatus", sentinel="F")


@REGISTRY.add(f"WITH {_T} SELECT s.o_orderkey, s.o_orderstatus AS input_value, t.o_orderstatus AS output_value {_ON} WHERE s.o_orderstatus IS DISTINCT FROM t.o_orderstatus")
def null_safe_diff(spark, sf_dir):
    return checks.value_rows(*orders_pair(spark, sf_dir), "o_orderkey", "o_orderstatus")


@REGISTRY.add(f"WITH {_T} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE {p}) AS mismatches {_ON}" for c, p in STRICT_SQL.items()))
def mismatch_count(spark, sf_dir):
    return checks.mismatch_counts(*orders_pair(spark, sf_dir), "o_orderkey", list(COMPARED))


@REGISTRY.add(f"WITH {_T} SELECT {', '.join(f'count(*) FILTER (WHERE {p}) AS {c}' for c, p in STRICT_SQL.items())} {_ON}")
def single_scan_audit(spark, sf_dir):
    return checks.single_scan_audit(*orders_pair(spark, sf_dir), "o_orderkey", list(COMPARED))


@REGISTRY.add(f"WITH {_T} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS total_rows, count(*) FILTER (WHERE s.{c} IS NULL) AS input_nulls, count(*) FILTER (WHERE t.{c} IS NULL) AS output_nulls {_ON}" for c in COMPARED))
def null_rate(spark, sf_dir):
    return checks.null_rates(*orders_pair(spark, sf_dir), "o_orderkey", list(COMPARED))


@REGISTRY.add(f"WITH {_T} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(DISTINCT s.{c}) AS input_distinct, count(DISTINCT t.{c}) AS output_distinct {_ON}" for c in COMPARED))
def distinct_count(spark, sf_dir):
    return checks.distinct_counts(*orders_pair(spark, sf_dir), "o_orderkey", list(COMPARED))


@REGISTRY.add(f"WITH {_T} " + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST(min(s.{c}) AS DOUBLE) AS input_min, CAST(max(s.{c}) AS DOUBLE) AS input_max, CAST(min(t.{c}) AS DOUBLE) AS output_min, CAST(max(t.{c}) AS DOUBLE) AS output_max {_ON}" for c in ("o_totalprice", "o_custkey")))
def range_check(spark, sf_dir):
    return checks.range_check(*orders_pair(spark, sf_dir), "o_orderkey", ["o_totalprice", "o_custkey"])


@REGISTRY.add(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("orders", "customer", "lineitem")))
def table_row_counts(spark, sf_dir):
    return checks.table_row_counts({t: table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem")})


_WANTED = [("orders", "o_orderkey"), ("orders", "o_missing"), ("customer", "c_name"), ("part", "p_size"), ("part", "p_colour")]


@REGISTRY.add(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}' AND column_name = '{c}') AS found" for t, c in _WANTED))
def column_exists(spark, sf_dir):
    return checks.column_exists(spark, {t: table(spark, sf_dir, t) for t in ("orders", "customer", "part")}, _WANTED)
