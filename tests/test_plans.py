import pytest

from tablecheck import testdata
from tablecheck.plans import reader
from tests.conftest import SF01


def test_plan_tree_and_insights(spark):
    spark.read.parquet(f"{SF01}/lineitem.parquet").createOrReplaceTempView("lineitem")
    spark.read.parquet(f"{SF01}/orders.parquet").createOrReplaceTempView("orders")
    root, notes = reader.explain(spark, "select o_orderstatus, count(*) n from orders join lineitem on o_orderkey = l_orderkey group by 1")
    labels = [s.label for s in root.walk()]
    assert "Group" in labels and labels.count("Scan") == 2 and any(x.endswith("join") for x in labels)
    assert labels.count("Group") == 1 and root.rows == 3 and "Scan" in reader.tree_text(root)
    total = sum(s.share for s in root.walk() if s.share)
    assert total == 0 or abs(total - 1) < 1e-9
    _, notes = reader.explain(spark, "select count(*) from orders a cross join (select * from range(3)) b where a.o_orderkey > b.id")
    assert any("every row" in n for n in notes)
    _, notes = reader.explain(spark, "select * from lineitem where l_orderkey = 7")
    assert any("kept" in n for n in notes)


def test_guard(spark):
    assert reader.is_read_only("-- x\n (select 1)") and reader.is_read_only("FROM t") and not reader.is_read_only("drop table t")
    assert reader.is_explainable("select 1;") and not reader.is_explainable("select 1; select 2")
    with pytest.raises(ValueError):
        reader.run_read_only(spark, "create table x (a int)")


def test_shape(spark):
    s = reader.shape(spark.range(10), 3)
    assert s.total == 10 and len(s.rows) == 3 and s.truncated and not reader.shape(spark.range(2)).truncated
    assert reader.displayed(spark.sql("select array(1, 2) a, 1 b")).first().a == "[1,2]"


def test_generated_rows(spark):
    specs = [
        testdata.column_spec("customer_id", "bigint", False, True), testdata.column_spec("full_name", "varchar(40)", False), testdata.column_spec("email", "varchar(120)"), testdata.column_spec("balance", "numeric(12,2)"),
        testdata.column_spec("score", "double precision"), testdata.column_spec("is_active", "boolean"), testdata.column_spec("signup_date", "date"), testdata.column_spec("last_seen", "timestamp"), testdata.column_spec("id2", "uuid"),
    ]
    with pytest.raises(ValueError):
        testdata.generate_rows(spark, [], 5)
    assert testdata.generate_rows(spark, specs, testdata.MAX_ROWS + 5).count() == testdata.MAX_ROWS and testdata.generate_rows(spark, specs, -1).count() == 0
    rows = testdata.generate_rows(spark, specs, 60)
    assert rows.collect() == testdata.generate_rows(spark, specs, 60).collect() != testdata.generate_rows(spark, specs, 60, 2).collect()
    got = rows.orderBy("row").collect()
    assert [r.customer_id.value for r in got] == [str(i) for i in range(1, 61)]
    assert all(r.full_name.value is not None for r in got) and got[0].full_name.edge == "empty" and got[0].signup_date.value == "1970-01-01"
    blank = next(r for r in got if r.email.edge == "NULL")
    assert blank.email.value is None and blank.balance.value is None and blank.full_name.value is not None
    typed = testdata.typed_rows(rows, specs)
    assert dict(typed.dtypes)["balance"] == "decimal(12,2)" and typed.where("balance is null").count() < 15
    key = testdata.generate_rows(spark, [testdata.column_spec("code", "text", False, True)], 3).orderBy("row").collect()
    assert [r.code.value for r in key] == ["K00001", "k00001", "k00002"]
