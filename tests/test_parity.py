import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.functions.expr import canonical_cell, edges_marked, plain_double
from tablecheck.model import ParityOptions
from tablecheck.operators import compare, pairing, parity, relational
from tablecheck.operators.verdict import assess
from tablecheck.queries.parity_queries import ORDERS_COPY
from tablecheck.report import human_bytes, report_html, report_markdown, share
from tests.conftest import SF01

A = "id int, name string, amount decimal(10,2)"


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "id int, name string, amount int").select("id", "name", F.col("amount").cast("decimal(10,2)").alias("amount"))


def run(s, t, keys, options=ParityOptions(), **more):
    spec, meta = parity.make_spec(s, t, keys, options, **more)
    result = parity.run_parity(s, t, spec, meta)
    return result, assess(result, options)


def test_same_table_matches(base):
    r, a = run(base, base, ["id"])
    assert a.verdict == "match" and not a.findings and not a.gaps
    assert r.keys.matched == 3 and r.keys.compared_rows == 3
    assert r.steps == ["Rows, keys and their coverage", "Column differences on matched rows"]


def test_missing_extra_changed(spark, base):
    t = base.where("id <> 2").union(spark.sql("select 9, 'z', cast(1 as decimal(10,2))")).withColumn("name", F.when(F.col("id") == 1, "A").otherwise(F.col("name")))
    r, a = run(base, t, ["id"])
    assert (r.keys.only_source, r.keys.only_target, r.keys.matched) == (1, 1, 2)
    assert [c.mismatches for c in r.columns] == [1, 0]
    assert r.columns[0].samples == [{"key": ["1"], "source": "a", "target": "A"}]
    assert r.only_source_samples == [["2"]] and r.only_target_samples == [["9"]] and a.verdict == "differs"
    swapped, _ = run(t, base, ["id"])
    assert (swapped.keys.only_source, swapped.keys.only_target) == (1, 1)


def test_null_equals_null_and_nothing_else(spark):
    s = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id int, note string")
    t = spark.createDataFrame([(1, None), (2, "y"), (3, "x")], "id int, note string")
    r, _ = run(s, t, ["id"])
    assert r.columns[0].mismatches == 1


def test_duplicate_and_null_keys(spark):
    s = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "id int, v string")
    t = spark.createDataFrame([(1, "a"), (2, "d")], "id int, v string")
    r, a = run(s, t, ["id"])
    k = r.keys
    assert (k.source_duplicates, k.source_nulls, k.target_duplicates, k.matched, k.compared_rows) == (1, 1, 0, 2, 3)
    assert len(a.findings) == 4


def test_keys_of_other_types_meet_as_text(spark):
    s = spark.createDataFrame([(7, 1)], "id int, v int")
    t = spark.createDataFrame([("7", 1)], "id string, v int")
    assert run(s, t, ["id"])[0].keys.matched == 1
    d = spark.createDataFrame([(7.0, 1)], "id double, v int")
    assert run(s, d, ["id"])[0].keys.matched == 0  # '7' and '7.0'
    assert run(s, d, ["id"], ParityOptions(numeric_keys=True))[0].keys.matched == 1


def test_numbers_compare_as_numbers_and_tolerance(spark):
    s = spark.createDataFrame([(1, 1.5), (2, 1840.50), (3, None)], "id int, v double")
    t = spark.createDataFrame([(1, 1.5), (2, 1840.49), (3, 1.0)], "id int, v double")
    assert run(s, t, ["id"])[0].columns[0].mismatches == 2
    assert run(s, t, ["id"], ParityOptions(tolerance=0.01))[0].columns[0].mismatches == 1
    w = t.withColumn("v", F.col("v").cast("decimal(12,2)"))
    assert run(s, w, ["id"], ParityOptions(tolerance=0.01))[0].columns[0].mismatches == 1


def test_relaxations_apply_in_order_and_never_to_keys(spark):
    s = spark.createDataFrame([("a", " X "), ("b", "  "), ("c", "")], "id string, v string")
    t = spark.createDataFrame([("a", "x"), ("b", None), ("c", None)], "id string, v string")
    assert run(s, t, ["id"])[0].columns[0].mismatches == 3
    assert run(s, t, ["id"], ParityOptions(trim=True, ignore_case=True, empty_as_null=True))[0].columns[0].mismatches == 0
    assert run(s, t, ["id"], ParityOptions(empty_as_null=True))[0].columns[0].mismatches == 2
    upper = t.withColumn("id", F.upper("id"))
    assert run(s, upper, ["id"], ParityOptions(ignore_case=True))[0].keys.matched == 0


def test_renamed_unpaired_and_awkward_names(spark):
    s = spark.createDataFrame([(1, 2, "x")], 'id int, amount int, `say "hi"` string')
    t = spark.createDataFrame([(1, 2, "x", 1)], '`ID` int, total_amount int, `say "hi"` string, loaded_at int')
    r, a = run(s, t, ["id"], rename={"amount": "total_amount"})
    assert {(c.pair.source, c.pair.target) for c in r.columns} == {('say "hi"', 'say "hi"'), ("amount", "total_amount")}
    assert r.unpaired_target == ["loaded_at"] and a.verdict == "match-with-gaps"


def test_case_variant_names_pair(spark):
    df = spark.sql("select 1 as a").selectExpr("a", "a as b").toDF("Id", "id")
    pairs, _, _ = pairing.auto_pair(df, df)
    assert [(p.source, p.target) for p in pairs] == [("Id", "Id"), ("id", "id")]


def test_rows_mode_counts_like_except_all(spark):
    s = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "code string, n int")
    t = spark.createDataFrame([("a", 1), ("c", 3)], "code string, n int")
    r, a = run(s, t, [])
    assert r.mode == "rows" and r.row_sets == (s.exceptAll(t).count(), t.exceptAll(s).count()) == (2, 1)
    assert r.only_source_samples == [["a", "1"], ["b", "2"]] and "Without a key" in a.gaps[-1]


def test_maps_compare(spark):
    s = spark.sql("select 1 as id, map('a', 1, 'b', 2) as m")
    t = spark.sql("select 1 as id, map('b', 2, 'a', 1) as m")
    assert run(s, t, ["id"])[1].verdict == "match"
    assert run(s, t, [])[0].row_sets == (0, 0)


def test_key_suggestion(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 6)], "order_id int, kind string, stamp int")
    pairs, _, _ = pairing.auto_pair(df, df)
    unique = pairing.unique_columns(pairing.uniqueness(df))
    assert unique == {"order_id", "stamp"} and pairing.pick_key(pairs, unique).source == "order_id"
    assert pairing.pick_key(pairs, {"stamp"}) is None


def test_planted_faults_at_scale(spark):
    s = spark.read.parquet(f"{SF01}/orders.parquet")
    s.createOrReplaceTempView("orders")
    t = spark.sql(ORDERS_COPY)
    spec, _ = parity.make_spec(s, t, ["o_orderkey"], exclude=("o_custkey",))
    assert [r.mismatches for r in parity.column_diff(s, t, spec).collect()] == [363, 202, 0, 317]
    assert tuple(parity.key_coverage(s, t, spec).first()) == (14707, 293, 144)
    relaxed, _ = parity.make_spec(s, t, ["o_orderkey"], ParityOptions(True, True, True, 0.01), exclude=("o_custkey",))
    assert [r.mismatches for r in parity.column_diff(s, t, relaxed).collect()] == [363, 0, 0, 0]
    rows, _ = parity.make_spec(s, t, [])
    assert tuple(parity.row_set_counts(s, t, rows).first()) == (1156, 1145)


def test_empty_tables(base):
    r, a = run(base.where("false"), base.where("false"), ["id"])
    assert a.verdict == "match" and r.source_rows == 0 and share(0, 0) == "—"


def test_report(spark, base):
    t = base.withColumn("name", F.when(F.col("id") == 1, "<script>").otherwise(F.col("name")))
    r, a = run(base, t, ["id"])
    page = report_html(r, a, fingerprints={"a.csv": (2048, None)})
    assert "&lt;script&gt;" in page and page.count("<script") == 1 and "2.0 KB" in page
    assert "&lt;script&gt;" not in report_html(r, a, samples=False)
    assert "| name | 1 | 33.33% |" in report_markdown(r, a)
    assert share(1, 1_000_000) == "<0.01%" and human_bytes(10) == "10 B"


def test_expressions(spark):
    df = spark.sql("select 1e15 as a, 123456789.5 as b, 0.1 as c").select(*[plain_double(F.col(c).cast("double")) for c in "abc"])
    assert tuple(df.first()) == ("1000000000000000.0", "123456789.5", "0.1")
    assert spark.range(1).select(edges_marked(F.lit(" a b\t"))).first()[0] == "␣a b⇥"
    cells = spark.sql("select true b, timestamp_ntz'2024-01-01 00:00:00' t, X'00ff' x, 0.30000000000000004D d, 7.0D e")
    got = cells.select(*[canonical_cell(F.col(f.name), f.dataType) for f in cells.schema]).first()
    assert tuple(got) == ("1", "2024-01-01", "00ff", "0.3", "7")
    assert isinstance(cells.schema["t"].dataType, T.TimestampNTZType)


def test_compare_results(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "n int, s string")
    assert compare.compare_results(a, a.orderBy(F.desc("n"))).same
    assert not compare.compare_results(a, a.select("n")).same
    assert not compare.compare_results(a, a.orderBy(F.desc("n")).withColumn("n", F.col("n") + 1)).same
    assert compare.compare_results(a, a, ["n"]).same
    assert compare.is_ordered(spark, "select * from range(3) order by id limit 2")
    assert not compare.is_ordered(spark, "select * from (select * from range(3) order by id) t where id > 1")


def test_relational(spark):
    d = spark.createDataFrame([(i, i % 3) for i in range(10)], "k int, g int")
    assert relational.top_with_ties(d, ["-g"], 2).count() == 3
    assert relational.top_with_ties(d, ["-g", "k"], 2).count() == 2
    assert [r.k for r in relational.limit_percent(d, ["k"], 25).collect()] == [0, 1]
    assert relational.in_list(d, "k", list(range(3, 4000))).count() == 7
    n = relational.numbered(d, ["k"]).orderBy("k").collect()
    assert [r["_p"] for r in n] == list(range(1, 11))


def test_asof_rules(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, None, 5), (4, "b", 1), (5, "a", 900), (6, "a", -3), (7, "c", 5)], "k int, by string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 5, "y"), ("a", 2, "w"), ("a", None, "n"), (None, 1, "o"), ("b", 2, "z"), ("c", 1, None), ("c", 0, "old")], "by string, t int, v string")
    got = {r.k: r.v for r in relational.asof_join(left, right, "by", "t", "t", ["v"]).collect()}
    assert got == {1: "y", 2: None, 3: None, 4: None, 5: "y", 6: None, 7: None}
    assert relational.asof_join(left.limit(0), right, "by", "t", "t", ["v"]).count() == 0
    assert {r.v for r in relational.asof_join(left, right.limit(0), "by", "t", "t", ["v"]).collect()} == {None}


def test_asof_of_one_hot_key(spark):
    left = spark.range(3000).selectExpr("id", "'hot' AS by", "CAST(id * 7 % 3001 AS DOUBLE) AS t")
    right = spark.range(0, 3000, 13).selectExpr("'hot' AS by", "CAST(id AS DOUBLE) AS t", "id AS v")
    for r in relational.asof_join(left, right, "by", "t", "t", ["v"]).collect():
        assert r.v == int(r.t) // 13 * 13
    days = "TIMESTAMP_NTZ '2020-01-01 00:00:00' + make_dt_interval({}, 3)"
    late = relational.asof_join(left.selectExpr("id", "by", days.format("CAST(t AS INT)") + " AS t"), right.selectExpr("by", days.format("CAST(t AS INT)") + " AS t", "v"), "by", "t", "t", ["v"])
    assert late.where("v <> (id * 7 % 3001) div 13 * 13 or v is null").count() == 0


def test_range_join_of_any_width(spark):
    points = spark.createDataFrame([(float(x),) for x in range(-50, 50)], "x double").selectExpr("x", "1 as _b", "2 as _level")
    ranges = spark.createDataFrame([(-1e9, 1e9), (3.0, 3.0), (5.0, 4.0), (0.0, 0.5), (-20.0, 20.0), (None, 3.0), (1.0, None), (7.5, 9.0)], "lo double, hi double")
    got = sorted((r.x, r.lo) for r in relational.range_join(points, ranges, "x", "lo", "hi", 1.0).collect())
    want = sorted((float(x), lo) for x in range(-50, 50) for lo, hi in ((-1e9, 1e9), (0.0, 0.5), (-20.0, 20.0), (7.5, 9.0)) if lo <= x < hi)
    assert got == want


def test_ties_with_nulls(spark):
    d = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 7), (5, None)], "k int, g int")
    ks = lambda df: sorted(r.k for r in df.collect())
    assert ks(relational.top_with_ties(d, ["g"], 1)) == [2, 3] and ks(relational.top_with_ties(d, ["-g"], 4)) == [1, 2, 3, 4, 5] and ks(relational.top_with_ties(d, ["-g"], 3)) == [2, 3, 4]
    assert ks(relational.top_with_ties(d, ["g"], 9)) == [1, 2, 3, 4, 5] and ks(relational.top_with_ties(d.limit(0), ["g"], 2)) == []


def test_zeros_count_once(spark):
    d = spark.sql("select 1 k, 0.0D x union all select 2, -0.0D union all select 3, double('nan') union all select 4, double('nan')")
    rows = {r.column_name: r.distinct_values for r in pairing.uniqueness(d).collect()}
    assert rows == {"k": 4, "x": 2}


def test_examples_of_many_columns_in_one_pass(spark):
    s = spark.range(50).selectExpr("id", *[f"id % {i + 2} AS c{i}" for i in range(30)])
    t = s.selectExpr("id", *[f"IF(id % {i + 5} = 0, NULL, c{i}) AS c{i}" for i in range(30)])
    r, _ = run(s, t, ["id"])
    assert r.steps == ["Rows, keys and their coverage", "Column differences on matched rows", "Examples of differing values"]
    for i, c in enumerate(r.columns):
        ids = [k for k in range(50) if k % (i + 5) == 0][:5]
        assert [x["key"] for x in c.samples] == [[str(k)] for k in ids] and all(x["target"] == "NULL" for x in c.samples)
