import time

import pytest

from tablecheck.sqltext import batch, convert, escape, format, generate, identifiers, infer, inlist, presets, review, scan, typemap, validate
from tablecheck.sqltext.dialects import DIALECTS, dialect


def test_scan_joins_to_the_text():
    sql = "select 'it''s', \"a\"\"b\", [x], `y` /* c; */ -- d;\nfrom t where a<=>b and $1 = 1.5e-3;"
    for d in DIALECTS:
        assert "".join(t.text for t in scan.tokens(sql, d)) == sql
    assert scan.statements("select ';'; -- ;\n; select 2") == ["select ';'", "select 2"]
    assert scan.replace_words("a 'a' \"a\" -- a\n a.b", {"a": "z"}) == ("z 'a' \"z\" -- a\n z.b", 3)
    assert scan.statements("do $$ a; b $$; c", "postgresql") == ["do $$ a; b $$", "c"]


@pytest.mark.parametrize(("source", "target", "sql", "want"), [
    ("postgresql", "transactsql", "select a from t order by a limit 10", "select TOP (10) a from t order by a"),
    ("transactsql", "postgresql", "SELECT TOP 5 a FROM [t x] WHERE b = 1;", 'SELECT a FROM "t x" WHERE b = 1\nLIMIT 5;'),
    ("postgresql", "plsql", "select a from t limit 10 offset 5", "select a from t OFFSET 5 ROWS FETCH FIRST 10 ROWS ONLY"),
    ("plsql", "mysql", "select a from t fetch first 3 rows only", "select a from t LIMIT 3"),
    ("transactsql", "duckdb", "select * from (select top 3 a from t order by a) x", "select * from (select a from t order by a\nLIMIT 3) x"),
    ("mysql", "postgresql", "select 'O\\'Brien', \"x\", `a b`", "select 'O''Brien', 'x', \"a b\""),
    ("postgresql", "spark", "select 'a\\b'", "select 'a\\\\b'"),
    ("transactsql", "trino", "select isnull(a, 0), getdate(), substring(b, 1, 2) from t", "select COALESCE(a, 0), CURRENT_TIMESTAMP, SUBSTR(b, 1, 2) from t"),
    ("postgresql", "transactsql", "select cast(a as text), cast(b as boolean)", "select cast(a as NVARCHAR(MAX)), cast(b as BIT)"),
    ("trino", "spark", "select cast(a as varchar), cast(b as varchar(5))", "select cast(a as STRING), cast(b as varchar(5))"),
    ("plsql", "bigquery", "select nvl(a, 'x'), sysdate from t", "select COALESCE(a, 'x'), CURRENT_TIMESTAMP from t"),
    ("postgresql", "db2", "select substring(a from 2 for 3) from t", "select substring(a from 2 for 3) from t"),
    ("spark", "transactsql", "select length(a) from t", "select LEN(a) from t"),
    ("mysql", "spark", "select a from t limit 5, 10", "select a from t LIMIT 10 OFFSET 5"), ("mysql", "sqlite", "select a from t limit 5, 10", "select a from t limit 5, 10"),
])
def test_convert(source, target, sql, want):
    assert convert.convert(sql, source, target).sql == want


def test_hazards():
    names = lambda sql, a, b: {n for n, _ in convert.convert(sql, a, b).unconverted}
    assert names("select a || b, c / d from t", "snowflake", "mysql") == {"|| concatenation"}
    assert "Division" in names("select c / d from t", "postgresql", "spark") and not names("select '/ ||' -- /\n", "postgresql", "mysql")
    assert names("select arr[1] from t", "trino", "spark") == {"Division", "Array subscript"} - {"Division"}
    assert names("select a::int from t qualify row_number() over () = 1", "snowflake", "trino") >= {"QUALIFY", ":: cast"}
    assert any(n.startswith("Date functions: DATE_TRUNC") for n in names("select date_trunc('day', x)", "trino", "hive"))
    assert names("select top 10 percent a from t", "transactsql", "spark") == {"TOP … PERCENT"}
    assert names("select length(a)", "mysql", "spark") == {"LENGTH"}
    same = convert.convert("select 1 limit 2", "spark", "spark")
    assert same.sql == "select 1 limit 2" and not same.changes


def test_review_rules():
    rules = lambda sql: {f.rule for f in review.review(sql)}
    assert rules("select * from t where a = 1") == {"select-star"}
    assert rules("select a from t where b like '%x'") == {"leading-wildcard-like"}
    assert rules("select a from t where date(ts) = '2024-01-01'") == {"function-on-filtered-column"}
    assert rules("select a from t where ts >= date('2024-01-01')") == set()
    assert rules("select a from t where a not in (select b from u where c = 1)") == {"not-in-subquery"}
    assert rules("select a.x from a, b where a.id = b.id") == {"comma-join"}
    assert rules("select count(distinct a) from t where b = 1") == {"count-distinct"}
    assert rules("select a from t where b = 1 order by a") == {"order-by-no-limit"}
    assert rules("select a, row_number() over (order by b) from t where c = 1") == set()
    assert rules("select distinct a from t where b = 1") == {"select-distinct"}
    assert rules("select a from t") == {"no-filter"} and rules("select a from t limit 5") == set()
    assert rules("select count(*) from t where a = 1") == set()
    found = review.review("select *\nfrom a, b\nwhere x not in (select 1 from c where d = 1)")
    assert [f.severity for f in found] == sorted((f.severity for f in found), key=review.ORDERED.get) and found[0].line == 3


def test_lint():
    assert [f.rule for f in review.lint("delete from t; update t set a = 1 where b = 2; truncate table t; drop table x")] == ["delete-without-where", "truncate", "drop"]
    assert not review.lint("delete from t where a in (select 1) -- drop")


def test_review_is_fast():
    sql = ";\n".join(f"select a{i}, count(*) from t{i} where b like '%x' group by 1" for i in range(400))
    began = time.perf_counter()
    assert len(review.review(sql)) == 400 and time.perf_counter() - began < 3


def test_names_and_values():
    pg, sf, my = dialect("postgresql"), dialect("snowflake"), dialect("mysql")
    assert identifiers.identifier("order", sf) == '"ORDER"' and identifiers.identifier("a b", my) == "`a b`" and identifiers.identifier("ok_1", pg) == "ok_1" and identifiers.identifier('"x"', pg) == '"x"'
    assert identifiers.list_name("CustomerId", True, pg) == '"CustomerId"' and identifiers.list_name("customer_id", True, pg) == "customer_id"
    assert escape.value_literal("007", pg) == "'007'" and escape.value_literal("7.5", pg) == "7.5" and escape.string_literal("a\\'b", my) == "'a\\\\''b'"
    for d in DIALECTS.values():
        for v in ("O'Brien", "back\\slash", 'q"q', "line\nend"):
            assert escape.unescape(escape.string_literal(v, d), d) == v


def test_stand_ins():
    assert typemap.stand_in("varchar(20)", "trino") == "'~'" and typemap.stand_in("Nullable(UInt64)", "clickhouse") == "18446744073709551615" and typemap.stand_in("decimal(10,2)", "spark") == "-1"
    assert typemap.stand_in("array<int>", "spark") is None and typemap.stand_in("json", "trino") is None and typemap.stand_in("hologram", "trino") is None
    assert typemap.stand_in("date", "transactsql") == "'1900-01-01'" and typemap.stand_in("hologram", "trino", {"hologram": "0"}) == "0"


def test_generate():
    v = generate.Variable
    got = generate.generate("select {{field}} from {{table_a}} where coalesce({{field}}, {{nil}}) = '{{field}}'", [v("field", ["a", "order", "m"]), v("table_a", ["s.t"]), v("nil", ["int", "text", "map<a,b>"], "type")], "postgresql")
    assert [q for _, q in got.queries] == ["select a from s.t where coalesce(a, -1) = 'a'", "select \"order\" from s.t where coalesce(\"order\", '~') = 'order'"]
    assert got.skipped == [("m", "no stand-in for type map")]
    assert len(generate.generate("{{a}} {{b}}", [v("a", ["1", "2"], "value"), v("b", ["3", "4", "5"], "value")], mode="cartesian").queries) == 6
    assert generate.generate("{{a}}", [v("a", ["1", "2"], "value")], most=1).truncated
    assert generate.combine(["select 1;", "select 2"], footer="\nORDER BY 1") == "select 1\nUNION ALL\nselect 2\nORDER BY 1"
    assert generate.parse_grid("a\tint\nb\ttext\n\n") == [["a", "int"], ["b", "text"]] and generate.variables("{{a}} {{ b }} {{a}}") == ["a", "b"]


def test_presets_in_every_dialect():
    assert len(presets.PRESETS) == 9
    for p in presets.PRESETS.values():
        assert set(p.templates) == set(DIALECTS) - ({"hive"} if p.id == "column-exists" else set())
        assert not any("count_if" in t.lower() for t in p.templates.values())
    safe = presets.PRESETS["column-comparison-null-safe"].templates
    assert "NOT (a.{{field}} <=> b.{{field_out}})" in safe["spark"] and "TOP" in safe["transactsql"] and "FETCH FIRST" in safe["plsql"] and "IS DISTINCT FROM" in safe["trino"]


def test_presets_run_on_spark(spark):
    spark.sql("select 1 k, 'x' f union all select 2, null").createOrReplaceTempView("pa")
    spark.sql("select 1 k, 'y' f union all select 2, null").createOrReplaceTempView("pb")
    v = generate.Variable
    names = [v("table_a", ["pa"]), v("table_b", ["pb"]), v("key", ["k"]), v("key_out", ["k"]), v("field", ["f"]), v("field_out", ["f"]), v("row_limit", ["10"], "value")]
    for p in presets.PRESETS.values():
        if p.id in ("column-comparison-sentinel", "column-exists"):
            continue
        made = generate.generate(p.templates["spark"], names, "spark")
        sql = generate.combine([q for _, q in made.queries], p.header, p.separator or "\n", p.footer)
        sql = generate.bind(sql, {x.name: x.values[0] for x in names}, dialect("spark"))
        rows = spark.sql(sql).collect()
        if p.id == "mismatch-count":
            assert rows[0].mismatches == 1
        assert len(rows) == 1


def test_in_lists():
    assert inlist.split("'a,b',c,'it''s'", ",") == ["a,b", "c", "it's"] and inlist.detect_separator("1;2;3") == ";" and inlist.detect_separator("a\nb") == "\n"
    got = inlist.clean(["id", " 1", "2", "2 ", ""])
    assert (got.values, got.header, got.empty, got.repeated) == (["1", "2"], "id", 1, 1)
    assert inlist.build(["1", "2"]).sql == "id IN (1, 2)" and inlist.build(["007", "1"]).sql == "id IN ('007', '1')"
    many = inlist.build([str(i) for i in range(2500)], dialect_id="plsql")
    assert many.chunks == 3 and many.sql.count(" OR ") == 2 and inlist.build(["1", "2"], chunk=1, negate=True).sql == "(id NOT IN (1) AND id NOT IN (2))"
    for d in DIALECTS:
        values = ["O'Brien", "a\\b", "x,y", "7"]
        assert inlist.parse(inlist.build(values, dialect_id=d).sql, d) == values
    assert inlist.parse("select 1 from t where a in (1, -2, null, 'x')") == ["1", "-2", "x"]


def test_batch(spark, tmp_path):
    (tmp_path / "a.sql").write_text("select * from t limit 5;\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.sql").write_text("delete from t")
    files = batch.read_files(spark, f"file://{tmp_path}")
    assert {r.rule for r in batch.review_corpus(files).collect()} == {"select-star", "delete-without-where"}
    out = batch.convert_corpus(files, "spark", "transactsql").where("path like '%a.sql'").first()
    assert out.output == "select TOP (5) * from t;\n" and out.changes == ["LIMIT → TOP"]
    done = [batch.process("x.sql", "select top 1 a from t", "convert", "transactsql", "spark"), batch.process("y.sql", "select {{ ref('a') }}", "convert", "spark", "trino"), batch.process("z.sql", "drop table t", "review")]
    assert batch.summary(done) == {"files": 3, "changed": 1, "notes": 0, "findings": 1, "errors": 1}
    assert "## z.sql" in batch.markdown(done) and batch.csv_report(done).count("\n") == 4
    assert batch.wanted("a/b.SQL") and not batch.wanted("node_modules/b.sql")


@pytest.mark.parametrize(("text", "yes"), [("select a from t", True), ("-- x\nWITH a AS (select 1) select * from a", True), ("Select the best option from your list", False), ("Update the docs", False), ("update t set a = 1", True), ("create table x (a int)", True), ("hello", False), ("", False), ("SELECT 1", True), ("delete from t where a = 1", True)])
def test_detects_sql(text, yes):
    assert batch.looks_like_sql(text) == yes


def test_format():
    got = format.format_sql("select a,b from t where x=1 and y in (select z from u) order by 1 -- end")
    assert got.splitlines()[0] == "SELECT a," and "WHERE x = 1" in got and "  AND y IN (" in got
    words = lambda s: [t.text.lower() for t in scan.code(s)]
    assert words(got) == words("select a,b from t where x=1 and y in (select z from u) order by 1") and format.format_sql(got) == got


def test_validate(spark):
    assert validate.validate(spark, "select {{field}} from t where a = '{{x}}'").status == "valid"
    bad = validate.validate(spark, "select {{field}}\nfrom t wher a = 1 x y")
    assert bad.status == "invalid" and bad.line == 2
    assert validate.validate(spark, "select 1", "snowflake").status == "unavailable"


@pytest.mark.parametrize(("dialect_id", "sql", "status"), [
    ("trino", "WITH x AS (SELECT 1 AS a) SELECT a FROM x WHERE a IS DISTINCT FROM 2", "valid"), ("trino", "SELECT a FRM t", "invalid"), ("trino", 'SELECT "a b" FROM "t"', "valid"), ("mysql", "SELECT `a` FROM t LIMIT 5, 10", "valid"),
    ("mysql", 'SELECT a FROM t WHERE b = "x"', "valid"), ("mysql", "SELECT a\nFROM t WHERE a IS DISTINCT FROM b", "invalid"), ("mariadb", "SELECT a <=> b FROM t", "valid"), ("postgresql", "SELECT a::int, 'it''s' FROM t WHERE b ILIKE 'x%'", "valid"),
    ("postgresql", "SELECT a FROM t WHERE a =\n", "invalid"), ("postgresql", "SELECT a FROM t WHERE a <=> b", "invalid"), ("duckdb", "SELECT a FROM t QUALIFY row_number() OVER (ORDER BY a) = 1", "unavailable"), ("redshift", "SELECT {{x}} FROM t", "valid"), ("plsql", "SELECT 1 FROM dual", "unavailable"),
])
def test_validate_other_dialects(spark, dialect_id, sql, status):
    found = validate.validate(spark, sql, dialect_id)
    assert found.status == status and (found.line >= 1) == (status == "invalid") and bool(found.message) == (status != "valid")


def test_inferred_samples(spark):
    sql = "with big as (select customer_id, sum(amount) as total from shop.orders o where o.status = 'paid' and o.placed_at > timestamp '2024-01-01 00:00:00' group by customer_id) select c.name, b.total from big b join customers c on c.id = b.customer_id where c.country in ('DE', 'FR') order by b.total desc"
    tables = {t.name: t for t in infer.infer_schema(sql, "spark")}
    assert set(tables) == {"shop.orders", "customers"}
    assert {c.name: c.type for c in tables["customers"].columns.values()} == {"name": "TEXT", "id": "NUMERIC", "country": "TEXT"}
    assert tables["shop.orders"].columns["status"].literals == ["paid"] and tables["shop.orders"].columns["placed_at"].type == "TIMESTAMP"
    assert infer.is_ordered(sql) and not infer.is_ordered("select * from (select 1 order by 1) t")
    assert "INSERT INTO customers" in infer.render_setup(list(tables.values()))
    assert infer.run_check(spark, "select upper(name) n from people where age > 30 and seen_at > current_timestamp").count() == 1
    with pytest.raises(infer.CheckError) as e:
        infer.run_check(spark, "select nosuchfunction(a) from t")
    assert e.value.stage == "query" and infer.type_from_name("createdAt") == "TIMESTAMP"
