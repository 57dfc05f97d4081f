import gzip

import pytest
from pyspark.sql import functions as F

from tablecheck.sources import files, sheets, sinks


def write(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return f"file://{p}"


@pytest.mark.parametrize(("name", "kind"), [("a.csv", "csv"), ("a.TSV.gz", "csv"), ("b.pq", "parquet"), ("c.ndjson.zst", "json"), ("d.xlsx", "unsupported"), ("e", "unsupported"), ("f.gz", "unsupported")])
def test_kind(name, kind):
    assert files.file_kind(name) == kind


def test_names():
    assert files.table_name_for("Sales 2024.csv") == "sales_2024" and files.table_name_for("2024.csv.gz") == "t_2024"
    assert files.table_name_for("a.csv", {"A", "a_2"}) == "a_3"
    with pytest.raises(ValueError):
        files.reader_for("unsupported")


def test_types_and_notes(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'id,zip,price,day,ok,note\n1,007,1.5,2024-01-02,true,""\n2,012,2,2024-02-03,false,\n3,100,3.25,,true," x "\n')
    got = files.load_table(spark, path)
    assert dict(got.df.dtypes) == {"id": "bigint", "zip": "string", "price": "double", "day": "date", "ok": "boolean", "note": "string"}
    assert [r.note for r in got.df.orderBy("id").collect()] == ["", None, " x "]
    assert any("leading zeros" in n for n in got.notes) and spark.table(got.table).count() == 3


def test_late_misfit_is_named(spark, tmp_path):
    path = write(tmp_path, "m.csv", "k,amount\n" + "".join(f"{i},{i}\n" for i in range(3000)) + "3000,N/A\n3001,5\n")
    got = files.load_table(spark, path)
    assert dict(got.df.dtypes)["amount"] == "string"
    assert any("line 3002" in n and "'N/A'" in n for n in got.notes)


@pytest.mark.parametrize(("encoding", "end"), [("cp1252", "\r\n"), ("cp1252", "\r"), ("utf-16", "\n"), ("utf-8", "\n")])
def test_encodings(spark, tmp_path, encoding, end):
    path = write(tmp_path, "e.csv", end.join(["name,french", "Côte d’Ivoire,Côte", "Egypt,Égypte", ""]).encode(encoding))
    got = files.load_table(spark, path)
    assert sorted(r.french for r in got.df.collect()) == ["Côte", "Égypte"]
    assert bool(got.notes) == (encoding != "utf-8")


def test_number_shapes_and_dates(spark, tmp_path):
    path = write(tmp_path, "n.csv", "a;b;c\n1,5;1,234;03/04/2024\n2,25;2,345,678;05/06/2024\n")
    got = files.load_table(spark, path)
    assert dict(got.df.dtypes) == {"a": "double", "b": "string", "c": "date"}
    text = " ".join(got.notes)
    assert "decimal commas" in text and "thousands" in text and "either way round" in text


def test_warnings(spark, tmp_path):
    path = write(tmp_path, "w.csv", "a,b\n1,2,3\n4\n5,6\n")
    assert any("2 of 3 rows" in n for n in files.load_table(spark, path).notes)
    assert files.sniff_warning("csv", ["a;b"]) and not files.sniff_warning("csv", ["a", "b"]) and files.header_warning(["_c0", "_c1"])
    assert files.detect_delimiter('"x,y,z";b\n') == ";" and files.detect_delimiter("a b", "x.tsv") == "\t"


def test_other_kinds(spark, tmp_path):
    path = write(tmp_path, "j.json", '[{"a": 1}, {"a": 2}]')
    assert files.load_table(spark, path).df.count() == 2
    lines = write(tmp_path, "j.jsonl", '{"a": 1}\n{"a": 2}\n')
    assert files.load_table(spark, lines).df.count() == 2
    zipped = write(tmp_path, "z.csv.gz", gzip.compress(b"a,b\n1,2\n"))
    assert files.load_table(spark, zipped).df.columns == ["a", "b"]
    empty = write(tmp_path, "empty.csv", "a,b\n")
    assert files.load_table(spark, empty).df.count() == 0
    got = files.fingerprint(spark, path).first()
    import hashlib

    assert got.sha256 == hashlib.sha256(b'[{"a": 1}, {"a": 2}]').hexdigest()
    assert files.fingerprint(spark, path, 3).first().sha256 is None


def test_csv_and_tsv_text(spark):
    df = spark.createDataFrame([(1, None, "a,b"), (2, "", 'q"q'), (3, " p ", "x\ty\\z")], "n int, s string, t string")
    assert [r.value for r in sinks.csv_lines(df).collect()] == ['1,,"a,b"', '2,"","q""q"', "3, p ,x\ty\\z"]
    assert [r.value for r in sinks.tsv_lines(df).collect()] == ["1\t\\N\ta,b", '2\t\tq"q', "3\t p \tx\\ty\\\\z"]
    assert sinks.careful_csv_lines(df).collect()[2].value == '3," p ",x\ty\\z'
    assert sinks.json_lines(df).first().value == '{"n":1,"s":null,"t":"a,b"}'


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " p "), (4, 'a"b,c')], "n bigint, s string")
    out = f"file://{tmp_path}/out"
    sinks.export_csv(df, out)
    back, _ = files.load_csv(spark, out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_inserts(spark):
    df = spark.createDataFrame([(i, "O'B" if i else None) for i in range(3)], "n int, s string")
    got = [r.value for r in sinks.insert_statements(df, "t", "postgresql", 2, ["n"]).orderBy("batch").collect()]
    assert got == ["INSERT INTO t (n, s) VALUES\n  (0, NULL),\n  (1, 'O''B');", "INSERT INTO t (n, s) VALUES\n  (2, 'O''B');"]
    assert sinks.insert_statements(df, "t", "plsql").count() == 3
    assert sinks.query_filename(3, "Null rate: a", 12) == "03-null-rate-a.sql" and sinks.sql_file([("a", "select 1;")]) == "-- a\nselect 1;\n"


def test_sheets():
    text = 'a,"b ""x"""\r\n"select 1\n from t",z\n'
    rows = sheets.parse_csv(text)
    assert [[c.value for c in r] for r in rows] == [["a", 'b "x"'], ["select 1\n from t", "z"]]
    assert sheets.write_csv(text, {(1, 1): "y,y"}) == 'a,"b ""x"""\r\n"select 1\n from t","y,y"\n'
    assert sheets.write_csv(text, {}) == text
    book = sinks.xlsx_bytes([["name", "sql"], ["q", "select <1>"]])
    cells = sheets.read_xlsx(book)
    assert [(c.row, c.column, c.value) for c in cells] == [(0, 0, "name"), (0, 1, "sql"), (1, 0, "q"), (1, 1, "select <1>")]
    changed = sheets.write_xlsx(book, {("xl/worksheets/sheet1.xml", "B2"): "select 2 & 3"})
    assert [c.value for c in sheets.read_xlsx(changed)] == ["name", "sql", "q", "select 2 & 3"]
    assert sheets.write_xlsx(book, {}) and len(sinks.zip_files({"a/b.sql": "x"})) > 0
    assert F is not None
