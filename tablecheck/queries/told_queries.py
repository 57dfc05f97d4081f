"""Operators that work on files, schemas and SQL as text, each on planted input; the oracle states the rows that must come out."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from tablecheck import testdata
from tablecheck.model import ParityOptions
from tablecheck.operators import pairing, parity
from tablecheck.plans import reader
from tablecheck.queries.registry import Registry, put, scratch
from tablecheck.schema import ddl, fieldcheck, indexmap
from tablecheck.sources import files, sheets, sinks
from tablecheck.sqltext import batch, convert, escape, format, generate, identifiers, infer, inlist, presets, review, scan, typemap
from tablecheck.sqltext.dialects import DIALECTS, dialect

REGISTRY = Registry()


def told(name: str, want: dict[str, str | None]) -> Callable:
    """Register a function of the session that gives (item, result) pairs; want is what they must be."""

    def keep(f: Callable[[SparkSession], Iterable[tuple[str, object]]]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = [(k, None if v is None else str(v)) for k, v in f(spark)]
            return spark.createDataFrame(rows, "item string, result string")

        text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
        REGISTRY.queries[name] = run
        REGISTRY.sql[name] = "SELECT item, CAST(result AS VARCHAR) AS result FROM (VALUES " + ", ".join(f"({text(k)}, {text(v)})" for k, v in want.items()) + ") AS v(item, result)"
        return f

    return keep


# files


@told("file_kinds", {"a.csv": "csv", "a.TSV.gz": "csv", "b.pq": "parquet", "c.ndjson.zst": "json", "d.xlsx": "unsupported", "e": "unsupported", "f.gz": "unsupported"})
def _(spark):
    return [(n, files.file_kind(n)) for n in ("a.csv", "a.TSV.gz", "b.pq", "c.ndjson.zst", "d.xlsx", "e", "f.gz")]


@told("file_table_names", {"Sales 2024.csv": "sales_2024", "2024.csv.gz": "t_2024", "orders.parquet": "orders_2"})
def _(spark):
    return [(n, files.table_name_for(n, {"Orders"})) for n in ("Sales 2024.csv", "2024.csv.gz", "orders.parquet")]


@told("file_readers", {"csv": "csv", "parquet": "parquet", "json": "json", "unsupported": "no reader for unsupported files"})
def _(spark):
    out = []
    for kind in ("csv", "parquet", "json", "unsupported"):
        try:
            out.append((kind, files.reader_for(kind)))
        except ValueError as e:
            out.append((kind, e))
    return out


def _loaded(spark, name, data):
    return files.load_table(spark, put(spark, f"{scratch(spark)}/{name}", data if isinstance(data, bytes) else data.encode()), keep=False)


@told("csv_types", {"id": "bigint", "zip": "string", "price": "double", "day": "date", "ok": "boolean", "note": "string", "rows": "3"})
def _(spark):
    got = _loaded(spark, "a.csv", 'id,zip,price,day,ok,note\n1,007,1.5,2024-01-02,true,""\n2,012,2,2024-02-03,false,\n3,100,3.25,,true," x "\n')
    return [*got.df.dtypes, ("rows", got.df.count())]


@told("csv_late_misfit", {"0": "amount: kept as text, since line 3002 holds 'N/A', which is no bigint."})
def _(spark):
    got = _loaded(spark, "m.csv", "k,amount\n" + "".join(f"{i},{i}\n" for i in range(3000)) + "3000,N/A\n3001,5\n")
    return [(str(i), n) for i, n in enumerate(got.notes)]


_COUNTRIES = "name,french\nCôte d’Ivoire,Côte\nEgypt,Égypte\n"


@told("csv_encodings", {"cp1252": "Côte d’Ivoire,Egypt", "cp1252 CR": "Côte d’Ivoire,Egypt", "utf-16": "Côte d’Ivoire,Egypt", "utf-8": "Côte d’Ivoire,Egypt"})
def _(spark):
    forms = (("cp1252", "\r\n"), ("cp1252", "\r"), ("utf-16", "\n"), ("utf-8", "\n"))
    return [(e + " CR" * (end == "\r"), ",".join(sorted(r.name for r in _loaded(spark, "e.csv", _COUNTRIES.replace("\n", end).encode(e)).df.collect()))) for e, end in forms]


@told("csv_shapes_and_dates", {"a": "3.75", "b": "1,234 2,345,678", "c": "2024-04-03 2024-06-05", "c swapped": "2024-03-04 2024-05-06", "notes": "3"})
def _(spark):
    data = "a;b;c\n1,5;1,234;03/04/2024\n2,25;2,345,678;05/06/2024\n"
    got, path = _loaded(spark, "n.csv", data), put(spark, f"{scratch(spark)}/n.csv", data.encode())
    swapped, _ = files.load_csv(spark, path, day_first=files.swapped_date_format(True))
    rows = got.df.orderBy("a").collect()
    joined = lambda values: " ".join(map(str, values))
    return [("a", sum(r.a for r in rows)), ("b", joined(r.b for r in rows)), ("c", joined(r.c for r in rows)), ("c swapped", joined(r.c for r in swapped.orderBy("a").collect())), ("notes", len(got.notes))]


@told("csv_warnings", {"ragged": "2 of 3 rows have another number of fields than the header.", "unsplit": "Read as one column, but its name holds ';': name the delimiter.", "lost header": "No header was found; columns are named by position.", "none": None, "semicolon": ";", "tab": "\t"})
def _(spark):
    ragged = _loaded(spark, "w.csv", "a,b\n1,2,3\n4\n5,6\n").notes
    return [("ragged", ragged[0]), ("unsplit", files.sniff_warning("csv", ["a;b"])), ("lost header", files.header_warning(["_c0", "_c1"])), ("none", files.sniff_warning("csv", ["a", "b"])), ("semicolon", files.detect_delimiter('"x,y,z";b\n')), ("tab", files.detect_delimiter("a b", "x.tsv"))]


@told("encoding_errors", {"Invalid UTF-8 byte": "True", "MalformedInputException": "True", "file not found": "False", "€ at 0x80": "€"})
def _(spark):
    return [*((m, files.is_encoding_error(m)) for m in ("Invalid UTF-8 byte", "MalformedInputException", "file not found")), ("€ at 0x80", files.decode_legacy(b"\x80"))]


@told("json_files", {"array": "2", "lines": "3"})
def _(spark):
    return [("array", _loaded(spark, "j.json", '[{"a": 1}, {"a": 2}]').df.count()), ("lines", _loaded(spark, "j.jsonl", '{"a": 1}\n{"a": 2}\n{"a": 3}\n').df.count())]


@told("sheet_cells", {"rows": "2", "1,0": "select 1\n from t", "changed": 'a,"b ""x"""\r\n"select 1\n from t","y,y"\n', "xlsx": "name|sql|q|select <1>", "xlsx changed": "name|sql|q|select 2 & 3"})
def _(spark):
    text = 'a,"b ""x"""\r\n"select 1\n from t",z\n'
    rows = sheets.parse_csv(text)
    book = sinks.xlsx_bytes([["name", "sql"], ["q", "select <1>"]])
    changed = sheets.write_xlsx(book, {("xl/worksheets/sheet1.xml", "B2"): "select 2 & 3"})
    return [("rows", len(rows)), ("1,0", rows[1][0].value), ("changed", sheets.write_csv(text, {(1, 1): "y,y"})), *((k, "|".join(c.value for c in sheets.read_xlsx(b))) for k, b in (("xlsx", book), ("xlsx changed", changed)))]


@told("sinks_text", {"careful": '3," p ",x\ty\\z', "json": '{"n":3,"s":" p ","t":"x\\ty\\\\z"}', "insert": "INSERT INTO t (n, s) VALUES\n  (0, NULL),\n  (1, 'O''B');", "file name": "03-null-rate-a.sql", "sql file": "-- a\nselect 1;\n", "zip": "2"})
def _(spark):
    import io
    import zipfile

    df = spark.createDataFrame([(3, " p ", "x\ty\\z")], "n int, s string, t string")
    few = spark.createDataFrame([(i, "O'B" if i else None) for i in range(2)], "n int, s string")
    packed = zipfile.ZipFile(io.BytesIO(sinks.zip_files({"a.sql": "x", "b/c.sql": "y"})))
    return [
        ("careful", sinks.careful_csv_lines(df).collect()[-1].value), ("json", sinks.json_lines(df).first().value), ("insert", sinks.insert_statements(few, "t", "postgresql", 2, ["n"]).first().value),
        ("file name", sinks.query_filename(3, "Null rate: a", 12)), ("sql file", sinks.sql_file([("a", "select 1;")])), ("zip", len(packed.namelist())),
    ]


# pairs, keys and modes


@told("auto_pairs", {"order_id": "order_id", "CustKey": "custkey", "Ship-Date": "ship_date", "source only": "extra", "target only": "loaded_at", "key": "order_id", "mode": "key", "no keys": "rows"})
def _(spark):
    s = spark.createDataFrame([(1, 5, "d", 1), (2, 5, "d", 1)], "order_id int, CustKey int, `Ship-Date` string, extra int")
    t = spark.createDataFrame([(1, 5, "d", "n")], "order_id int, custkey int, ship_date string, loaded_at string")
    pairs, only_s, only_t = pairing.auto_pair(s, t)
    key = pairing.pick_key(pairs, pairing.unique_columns(pairing.uniqueness(s)))
    modes = [parity.make_spec(s, t, keys)[0].mode for keys in (["order_id"], [])]
    return [*((p.source, p.target) for p in pairs), ("source only", ",".join(only_s)), ("target only", ",".join(only_t)), ("key", key.source), ("mode", modes[0]), ("no keys", modes[1])]


@told("example_pair", {"verdict": "differs", "matched": "11", "name": "1", "email": "2", "country": "1", "lifetime_value": "1", "signup_date": "0"})
def _(spark):
    from tablecheck.example import FILES
    from tablecheck.operators.verdict import assess

    s, t = (_loaded(spark, name, text).df for name, text in FILES.items())
    spec, meta = parity.make_spec(s, t, ["customer_id"], ParityOptions())
    r = parity.run_parity(s, t, spec, meta)
    return [("verdict", assess(r).verdict), ("matched", r.keys.matched), *((c.pair.source, c.mismatches) for c in r.columns)]


@told("generated_rows", {"rows": "10000", "first key": "1", "first name": "empty", "no columns": "no columns"})
def _(spark):
    specs = [testdata.column_spec("customer_id", "bigint", False, True), testdata.column_spec("full_name", "varchar(40)", False)]
    rows = testdata.generate_rows(spark, specs, 60_000)
    first = rows.orderBy("row").first()
    try:
        testdata.generate_rows(spark, [], 5)
    except ValueError as e:
        said = str(e)
    return [("rows", rows.count()), ("first key", first.customer_id.value), ("first name", first.full_name.edge), ("no columns", said)]


# queries and plans


@told("read_only_guard", {"-- x\n (select 1)": "True", "FROM t": "True", "drop table t": "False", "select 1;": "True", "select 1; select 2": "False"})
def _(spark):
    return [*((q, reader.is_read_only(q)) for q in ("-- x\n (select 1)", "FROM t", "drop table t")), *((q, reader.is_explainable(q)) for q in ("select 1;", "select 1; select 2"))]


@told("displayed_rows", {"total": "10", "shown": "3", "truncated": "True", "array": "[1,2]"})
def _(spark):
    s = reader.shape(spark.range(10), 3)
    return [("total", s.total), ("shown", len(s.rows)), ("truncated", s.truncated), ("array", reader.displayed(spark.sql("select array(1, 2) a")).first().a)]


@told("ordered_queries", {"select a from t order by a": "True", "select * from (select 1 order by 1) t": "False", "select row_number() over (order by a) from t": "False"})
def _(spark):
    return [(q, infer.is_ordered(q)) for q in ("select a from t order by a", "select * from (select 1 order by 1) t", "select row_number() over (order by a) from t")]


@told("inferred_samples", {"shop.orders": "status,amount,placed_at", "customers": "country,id,name", "status": "paid", "placed_at": "TIMESTAMP", "createdAt": "TIMESTAMP", "rows": "1"})
def _(spark):
    sqls = ("select o.status, sum(amount) as total from shop.orders o where o.status = 'paid' and o.placed_at > timestamp '2024-01-01 00:00:00' group by o.status", "select c.name from customers c where c.country in ('DE', 'FR') order by c.id")
    tables = {t.name: t for sql in sqls for t in infer.infer_schema(sql, "spark")}
    orders = tables["shop.orders"].columns
    ran = infer.run_check(spark, "select upper(name) n from people where age > 30 and seen_at > current_timestamp").count()
    return [("shop.orders", ",".join(orders)), ("customers", ",".join(sorted(tables["customers"].columns))), ("status", ",".join(orders["status"].literals)), ("placed_at", orders["placed_at"].type), ("createdAt", infer.type_from_name("createdAt")), ("rows", ran)]


# schemas

_TABLE = "CREATE EXTERNAL TABLE IF NOT EXISTS `db`.`t` (\n  `id` bigint COMMENT 'the, id',\n  name varchar(20),\n  tags array<struct<a:int,b:string>>,\n  amount decimal(38, 9)\n) PARTITIONED BY (day string) STORED AS PARQUET"


@told("ddl_columns", {"table": "db.t", "id": "bigint", "name": "varchar(20)", "tags": "array<struct<a:int,b:string>>", "amount": "decimal(38, 9)", "day": "string", "partitions": "day", "line of name": "3", "grid": "5"})
def _(spark):
    t = ddl.parse_ddl(_TABLE, "hive")
    return [("table", t.name), *((c.name, c.type) for c in t.columns), ("partitions", ",".join(c.name for c in t.columns if c.partition)), ("line of name", t.columns[1].line), ("grid", len(ddl.columns_to_grid(t.columns)))]


@told("ddl_constraints", {"id": "True", "order": "False", "ts": "True", "collation": "Latin1_General_CI_AS", "default": "now()", "notes": "4 table constraints skipped", "errors": "True"})
def _(spark):
    t = ddl.parse_ddl(
        "create table [dbo].[x] (id int identity(1,1) not null, [order] nvarchar(max) collate Latin1_General_CI_AS null, ts timestamp with time zone default now() not null, constraint pk primary key (id, ts), foreign key (id) references y(id), check (id > 0), unique (ts))",
        "transactsql",
    )
    return [*((c.name, c.not_null) for c in t.columns), ("collation", t.columns[1].collation), ("default", t.columns[2].default), ("notes", t.notes[0]), ("errors", bool(ddl.parse_ddl("create table t (a int").errors))]


@told("ddl_diff", {"id": "unchanged", "c": "retyped", "fresh": "added", "gone": "removed"})
def _(spark):
    a = ddl.parse_ddl("create table t (id int not null, c int, gone date)").columns
    b = ddl.parse_ddl("create table t (id integer not null, c bigint not null, fresh date)").columns
    return [(c.name, c.kind) for c in ddl.diff(a, b)]


@told("ddl_types", {"int4 INTEGER": "True", "numeric(10, 2) decimal(10,2)": "True", "timestamptz timestamp with time zone": "True", "varchar(10) varchar(20)": "False", "double precision float8": "True"})
def _(spark):
    pairs = (("int4", "INTEGER"), ("numeric(10, 2)", "decimal(10,2)"), ("timestamptz", "timestamp with time zone"), ("varchar(10)", "varchar(20)"), ("double precision", "float8"))
    return [(f"{a} {b}", ddl.canonical_type(a) == ddl.canonical_type(b)) for a, b in pairs]


@told("field_check", {"unknown": "z", "mismatch": "b", "uncovered": "c", "matched": "1"})
def _(spark):
    c = fieldcheck.check_fields([("a", "int"), ("b", "bigint"), ("z", "")], ddl.columns_of(spark.sql("select 1 a, 'x' b, 2 c")))
    return [("unknown", ",".join(c.unknown)), ("mismatch", ",".join(m[0] for m in c.type_mismatch)), ("uncovered", ",".join(c.uncovered)), ("matched", c.matched)]


_WANTED = 'PUT /people\n{\n  // wanted\n  "settings": {"index": {"number_of_shards": 3}},\n  "mappings": {"properties": {\n    "name": {"type": "text", "fields": {"raw": {"type": "keyword", "ignore_above": 256}}},\n    "born": {"type": "date"}\n  }}\n}'
_REPORTED = '{"people_v1": {"mappings": {"properties": {"name": {"type": "text", "fields": {"raw": {"type": "keyword"}}}, "born": {"type": "long"}, "x": {"type": "keyword"}}}, "settings": {"index": {"number_of_shards": "3", "uuid": "abc"}}}}'


@told("index_mappings", {"name": "unchanged", "name.raw": "attributes", "born": "retyped", "x": "added", "line of born": "7", "setting uuid": "True", "json": '{"a":[1],"b":1}', "format": "mapping"})
def _(spark):
    a, b = indexmap.parse_mapping(_WANTED), indexmap.parse_mapping(_REPORTED)
    return [*((c.path, c.kind) for c in indexmap.diff_fields(a, b)), ("line of born", a.lines["born"]), *((f"setting {n}", own) for n, _, _, own in indexmap.diff_settings(a, b)), ("json", indexmap.stable_json({"b": 1, "a": [1]})), ("format", indexmap.same_format(_WANTED, _REPORTED))]


# SQL as text


@told("sql_statements", {"0": "select ';'", "1": "select 2", "words": "3", "replaced": "z 'a' \"z\" -- a\n z.b"})
def _(spark):
    new, n = scan.replace_words("a 'a' \"a\" -- a\n a.b", {"a": "z"})
    return [*((str(i), s) for i, s in enumerate(scan.statements("select ';'; -- ;\n; select 2"))), ("words", n), ("replaced", new)]


@told("sql_converted", {"top": "select TOP (10) a from t order by a", "limit": 'SELECT a FROM "t x" WHERE b = 1\nLIMIT 5;', "literals": "select 'O''Brien', 'x', \"a b\"", "functions": "select COALESCE(a, 0), CURRENT_TIMESTAMP, SUBSTR(b, 1, 2) from t", "types": "select cast(a as NVARCHAR(MAX)), cast(b as BIT)", "length": "select LEN(a) from t"})
def _(spark):
    pairs = {
        "top": ("postgresql", "transactsql", "select a from t order by a limit 10"), "limit": ("transactsql", "postgresql", "SELECT TOP 5 a FROM [t x] WHERE b = 1;"), "literals": ("mysql", "postgresql", "select 'O\\'Brien', \"x\", `a b`"),
        "functions": ("transactsql", "trino", "select isnull(a, 0), getdate(), substring(b, 1, 2) from t"), "types": ("postgresql", "transactsql", "select cast(a as text), cast(b as boolean)"), "length": ("spark", "transactsql", "select length(a) from t"),
    }
    return [(k, convert.convert(sql, a, b).sql) for k, (a, b, sql) in pairs.items()]


@told("sql_hazards", {"pipes": "|| concatenation", "division": "Division", "subscript": "Array subscript", "qualify": ":: cast,QUALIFY", "dates": "Date functions: DATE_TRUNC", "if": "IF()", "distinct": "IS DISTINCT FROM", "none": ""})
def _(spark):
    pairs = {
        "pipes": ("snowflake", "mysql", "select a || b from t"), "division": ("postgresql", "spark", "select c / d from t"), "subscript": ("trino", "bigquery", "select arr[1], array[2] from t"), "qualify": ("snowflake", "trino", "select a::int from t qualify row_number() over () = 1"),
        "dates": ("trino", "hive", "select date_trunc('day', x)"), "if": ("spark", "postgresql", "select if(a, 1, 2) from t"), "distinct": ("duckdb", "mysql", "select a is not distinct from b from t"), "none": ("postgresql", "mysql", "select '/ ||' -- /\n"),
    }
    return [(k, ",".join(sorted(n for n, _ in convert.convert(sql, a, b).unconverted))) for k, (a, b, sql) in pairs.items()]


@told("sql_review_rules", {"select * from t where a = 1": "select-star", "select a from t where b like '%x'": "leading-wildcard-like", "select a from t where date(ts) = '2024-01-01'": "function-on-filtered-column", "select a from t": "no-filter", "delete from t": "delete-without-where", "truncate table t": "truncate"})
def _(spark):
    rules = lambda found: ",".join(sorted({f.rule for f in found}))
    reads = ("select * from t where a = 1", "select a from t where b like '%x'", "select a from t where date(ts) = '2024-01-01'", "select a from t")
    return [*((q, rules(review.review(q))) for q in reads), *((q, rules(review.lint(q))) for q in ("delete from t", "truncate table t"))]


@told("sql_names_and_values", {"snowflake order": '"ORDER"', "mysql a b": "`a b`", "listed": '"CustomerId"', "007": "'007'", "7.5": "7.5", "quote": "'O''Brien'", "backslash": "'a\\\\b'"})
def _(spark):
    pg, my = dialect("postgresql"), dialect("mysql")
    return [("snowflake order", identifiers.identifier("order", dialect("snowflake"))), ("mysql a b", identifiers.identifier("a b", my)), ("listed", identifiers.list_name("CustomerId", True, pg)), *((v, escape.value_literal(v, pg)) for v in ("007", "7.5")), ("quote", escape.string_literal("O'Brien", pg)), ("backslash", escape.string_literal("a\\b", my))]


@told("stand_ins", {"trino varchar(20)": "'~'", "clickhouse Nullable(UInt64)": "18446744073709551615", "spark decimal(10,2)": "-1", "spark array<int>": None, "trino json": None, "transactsql date": "'1900-01-01'", "postgresql uuid": "'00000000-0000-0000-0000-000000000000'::uuid"})
def _(spark):
    pairs = (("trino", "varchar(20)"), ("clickhouse", "Nullable(UInt64)"), ("spark", "decimal(10,2)"), ("spark", "array<int>"), ("trino", "json"), ("transactsql", "date"), ("postgresql", "uuid"))
    return [(f"{d} {t}", typemap.stand_in(t, d)) for d, t in pairs]


@told("generated_queries", {"0": "select a from s.t where coalesce(a, -1) = 'a'", "1": "select \"order\" from s.t where coalesce(\"order\", '~') = 'order'", "skipped": "m", "cartesian": "6", "combined": "select 1\nUNION ALL\nselect 2\nORDER BY 1", "grid": "2", "variables": "a,b"})
def _(spark):
    v = generate.Variable
    got = generate.generate("select {{field}} from {{table_a}} where coalesce({{field}}, {{nil}}) = '{{field}}'", [v("field", ["a", "order", "m"]), v("table_a", ["s.t"]), v("nil", ["int", "text", "map<a,b>"], "type")], "postgresql")
    every = generate.generate("{{a}} {{b}}", [v("a", ["1", "2"], "value"), v("b", ["3", "4", "5"], "value")], mode="cartesian")
    return [
        *((str(i), q) for i, (_, q) in enumerate(got.queries)), ("skipped", got.skipped[0][0]), ("cartesian", len(every.queries)), ("combined", generate.combine(["select 1;", "select 2"], footer="\nORDER BY 1")),
        ("grid", len(generate.parse_grid("a\tint\nb\ttext\n\n"))), ("variables", ",".join(generate.variables("{{a}} {{ b }} {{a}}"))),
    ]


@told("preset_templates", {"presets": "9", "dialects": "16", "column-exists": "15", "spark": "NOT (a.{{field}} <=> b.{{field_out}})", "trino": "a.{{field}} IS DISTINCT FROM b.{{field_out}}"})
def _(spark):
    safe = presets.PRESETS["column-comparison-null-safe"].templates
    where = lambda d: safe[d].split("WHERE ")[1].split("\nLIMIT")[0]
    return [("presets", len(presets.PRESETS)), ("dialects", len(DIALECTS)), ("column-exists", len(presets.PRESETS["column-exists"].templates)), ("spark", where("spark")), ("trino", where("trino"))]


@told("in_list_text", {"values": "a,b|c|it's", "separator": ";", "kept": "1|2", "header": "id", "numbers": "id IN (1, 2)", "texts": "id IN ('007', '1')", "chunks": "3", "parsed": "1|-2|x"})
def _(spark):
    got = inlist.clean(["id", " 1", "2", "2 ", ""])
    return [
        ("values", "|".join(inlist.split("'a,b',c,'it''s'", ","))), ("separator", inlist.detect_separator("1;2;3")), ("kept", "|".join(got.values)), ("header", got.header), ("numbers", inlist.build(["1", "2"]).sql),
        ("texts", inlist.build(["007", "1"]).sql), ("chunks", inlist.build([str(i) for i in range(2500)], dialect_id="plsql").chunks), ("parsed", "|".join(inlist.parse("select 1 from t where a in (1, -2, null, 'x')"))),
    ]


@told("sql_batch", {"x.sql": "select a from t\nLIMIT 1", "y.sql": "error", "z.sql": "drop", "Select the best option from your list": "False", "-- x\nWITH a AS (select 1) select * from a": "True", "a/b.SQL": "True", "node_modules/b.sql": "False"})
def _(spark):
    done = [batch.process("x.sql", "select top 1 a from t", "convert", "transactsql", "spark"), batch.process("y.sql", "select {{ ref('a') }}", "convert", "spark", "trino"), batch.process("z.sql", "drop table t", "review")]
    told_of = lambda r: "error" if r.error else ",".join(f.rule for f in r.findings) or r.output
    return [*((r.path, told_of(r)) for r in done), *((t, batch.looks_like_sql(t)) for t in ("Select the best option from your list", "-- x\nWITH a AS (select 1) select * from a")), *((p, batch.wanted(p)) for p in ("a/b.SQL", "node_modules/b.sql"))]


@told("sql_formatted", {"first line": "SELECT a,", "again": "True", "same words": "True"})
def _(spark):
    sql = "select a,b from t where x=1 and y in (select z from u) order by 1"
    got = format.format_sql(sql)
    words = lambda s: [t.text.lower() for t in scan.code(s)]
    return [("first line", got.splitlines()[0]), ("again", format.format_sql(got) == got), ("same words", words(got) == words(sql))]
