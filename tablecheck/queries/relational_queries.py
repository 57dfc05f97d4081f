"""Relational coverage: joins, aggregates, windows, sorts, set operations and scalar functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablecheck.operators import relational
from tablecheck.queries.registry import Registry, table

REGISTRY = Registry()
both = REGISTRY.spark_sql

# joins

both("inner_join", "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
both("left_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'")
both("right_join", "SELECT n.n_nationkey, s.s_suppkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey")
both("full_join", "SELECT a.o_orderkey AS a_key, b.twice AS b_key FROM orders a FULL OUTER JOIN (SELECT 2 * o_orderkey AS twice FROM orders) b ON a.o_orderkey = b.twice")
both("semi_join", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
both("anti_join", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
both("cross_join", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
both("comma_join", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
both("using_join", "SELECT k, n, t FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) a JOIN (SELECT c_custkey AS k, c_mktsegment AS t FROM customer) b USING (k)")
both("natural_join", "SELECT k, n, t FROM (SELECT n_regionkey AS k, n_name AS n FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS t FROM region) b")
both("composite_key_join", "SELECT a.conv_id, a.turn, CAST(length(b.text) AS BIGINT) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn")
both("nonequi_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("not_in_null_aware", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
both("not_in_with_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END FROM orders)")
both("exists_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
both("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
both(
    "lateral_unnest",
    "SELECT vec_id, pos, CAST(round(x, 6) AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, x",
    "SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS pos, CAST(round(unnest(embedding), 6) AS DOUBLE) AS x FROM embeddings",
)
both("lateral_join", "SELECT c.c_custkey, l.best FROM customer c, LATERAL (SELECT max(o_totalprice) AS best FROM orders o WHERE o.o_custkey = c.c_custkey) l")


@REGISTRY.add(
    "SELECT event_id, o_orderkey FROM (SELECT event_id, ts, user_id FROM events) e ASOF LEFT JOIN (SELECT max(o_orderkey) AS o_orderkey, o_custkey, o_orderdate FROM orders GROUP BY o_custkey, o_orderdate) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate"
)
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return relational.asof_join(e, o, "user_id", "ts", "o_orderdate", ["o_orderkey"]).select("event_id", "o_orderkey")


_PLANTED_LEFT = "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id % 3 END AS user_id FROM events"
_PLANTED_RIGHT = "SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 3 END AS k, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS day, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2"


@REGISTRY.add(
    f"WITH l AS ({_PLANTED_LEFT}), r AS ({_PLANTED_RIGHT}) SELECT event_id, (SELECT max_by(o_orderkey, day) FROM r WHERE r.k = l.user_id AND r.day <= l.ts) AS o_orderkey FROM l"
)
def asof_join_nulls(spark, sf_dir):
    """Keys and times that are NULL match nothing; three keys hold all rows."""
    for t in ("events", "orders"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    right = spark.sql(_PLANTED_RIGHT).withColumnRenamed("k", "user_id")
    return relational.asof_join(spark.sql(_PLANTED_LEFT), right, "user_id", "ts", "day", ["o_orderkey"]).select("event_id", "o_orderkey")


@REGISTRY.add(
    "WITH b AS (SELECT c_custkey AS _b, c_acctbal AS lo, c_acctbal + CASE WHEN c_custkey % 40 = 0 THEN 5000 WHEN c_custkey % 3 = 0 THEN 0 ELSE 7 END AS hi FROM customer) SELECT s_suppkey, _b FROM supplier JOIN b ON s_acctbal >= lo AND s_acctbal < hi"
)
def range_join_wide(spark, sf_dir):
    """Ranges of very different widths, empty ones among them; a column has a name of a helper's kind."""
    b = table(spark, sf_dir, "customer").selectExpr("c_custkey AS _b", "c_acctbal AS lo", "c_acctbal + CASE WHEN c_custkey % 40 = 0 THEN 5000 WHEN c_custkey % 3 = 0 THEN 0 ELSE 7 END AS hi")
    return relational.range_join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), b, "s_acctbal", "lo", "hi", 5).select("s_suppkey", "_b")


@REGISTRY.add("SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS p FROM customer) a FULL OUTER JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS p FROM supplier) b USING (p)")
def positional_join(spark, sf_dir):
    return relational.positional_join(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), ["c_custkey"], ["s_acctbal", "s_suppkey"]).select("c_custkey", "s_suppkey")


@REGISTRY.add("SELECT p_partkey, band FROM part JOIN (SELECT p_size AS band, 900 + 20 * p_size AS lo, 900 + 20 * p_size + 35 AS hi FROM part GROUP BY p_size) b ON p_retailprice >= lo AND p_retailprice < hi")
def range_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    bands = p.select(F.col("p_size").alias("band")).distinct().select("band", (900 + 20 * F.col("band")).alias("lo"), (935 + 20 * F.col("band")).alias("hi"))
    return relational.range_join(p.select("p_partkey", "p_retailprice"), bands, "p_retailprice", "lo", "hi", 35).select("p_partkey", "band")


# aggregates

both("group_by_having", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS best FROM orders GROUP BY o_custkey HAVING count(*) > 12")
both("filtered_agg", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS open_lines FROM lineitem GROUP BY l_returnflag")
both("global_agg", "SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM lineitem")
both("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
both("count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
both("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
both(
    "listagg",
    "SELECT n_regionkey, listagg(n_name, '; ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)
both(
    "numeric_aggs",
    "SELECT l_returnflag, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS total, CAST(round(avg(l_extendedprice), 4) AS DOUBLE) AS mean, CAST(round(stddev(l_quantity), 6) AS DOUBLE) AS sd, CAST(round(variance(l_discount), 8) AS DOUBLE) AS var FROM lineitem GROUP BY l_returnflag",
)
both("pricing_summary", "SELECT l_returnflag, l_linestatus, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
both("bool_aggs", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS every_one, bool_or(o_orderstatus = 'P') AS any_one FROM orders GROUP BY o_custkey")
# of equal prices the least key counts, as in SQL over rows in order of their keys; rows that lack either are passed over there too
both(
    "min_by_max_by",
    "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, ~o_orderkey)) FILTER (WHERE o_totalprice IS NOT NULL AND o_orderkey IS NOT NULL) AS dearest, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) FILTER (WHERE o_totalprice IS NOT NULL AND o_orderkey IS NOT NULL) AS cheapest FROM orders GROUP BY o_custkey",
    "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS dearest, arg_min(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY o_custkey",
)


@REGISTRY.add()
def approx_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"))


@REGISTRY.add("SELECT l_returnflag, TRUE AS close FROM lineitem GROUP BY l_returnflag")
def approx_distinct_error(spark, sf_dir):
    """Whether the estimate of each group lies within four standard errors of the count."""
    close = F.abs(F.approx_count_distinct("l_orderkey", 0.02) - F.count_distinct("l_orderkey")) <= 0.08 * F.count_distinct("l_orderkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(close.alias("close"))


@REGISTRY.add("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\", count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY l_returnflag")
def pivot(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0, ["F", "O"])


@REGISTRY.add("SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return p.unpivot(["p_partkey"], ["p_size", "p_retailprice"], "name", "value")


@REGISTRY.add("SELECT l_returnflag, count(*) AS part_rows, CAST(round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lineitem), 6) AS DOUBLE) AS share FROM lineitem GROUP BY l_returnflag")
def shares(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("part_rows"))
    total = counts.agg(F.sum("part_rows").alias("_n"))
    return counts.crossJoin(total).select("l_returnflag", "part_rows", F.round(F.col("part_rows") * F.lit(100.0) / F.col("_n"), 6).alias("share"))  # one row


# windows

_W = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
both("window_ranking", f"SELECT o_orderkey, row_number() OVER {_W} AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, ntile(4) OVER {_W} AS nt FROM orders",
     f"SELECT o_orderkey, CAST(row_number() OVER {_W} AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS dr, CAST(ntile(4) OVER {_W} AS INTEGER) AS nt FROM orders")
both("window_distribution", f"SELECT o_orderkey, CAST(round(percent_rank() OVER {_W}, 9) AS DOUBLE) AS pr, CAST(round(cume_dist() OVER {_W}, 9) AS DOUBLE) AS cd FROM orders")
both("window_lag_lead", f"SELECT o_orderkey, lag(o_orderkey) OVER {_W} AS before, lead(o_orderkey, 2) OVER {_W} AS after2 FROM orders")
both("window_values", f"SELECT o_orderkey, first_value(o_orderkey) OVER {_W} AS first_key, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_key FROM orders")
both("window_frames", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS best3, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near_keys FROM orders")
both("window_whole_table", "SELECT n_nationkey, count(*) OVER () AS n FROM nation")


@REGISTRY.add("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def qualify_style(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return relational.qualify(table(spark, sf_dir, "orders"), F.col("_rn") <= 2, _rn=F.row_number().over(w)).select("o_custkey", "o_orderkey")


# sorts and limits

both("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
both("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 40")
both("nulls_last_sample", "SELECT k FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey END AS k FROM orders) ORDER BY k ASC NULLS LAST LIMIT 30")


@REGISTRY.add("SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM part)")
def limit_percent(spark, sf_dir):
    return relational.limit_percent(table(spark, sf_dir, "part"), ["p_retailprice", "p_partkey"], 10).select("p_partkey")


@REGISTRY.add("SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 15")
def top_with_ties(spark, sf_dir):
    return relational.top_with_ties(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["-p_size"], 15)


# set operations and recursion

both("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
both("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
both("intersect_all", "SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT user_id FROM events")
both("except_distinct", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
both("except_all", "SELECT text FROM documents EXCEPT ALL SELECT DISTINCT text FROM documents")
both("cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big) SELECT b.o_custkey, b.n FROM big b JOIN top t ON b.n = t.m")
both("recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t")
both("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(n, s)")

# predicates and scalar functions

both("predicates", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_orderpriority LIKE '1%' AND o_orderpriority ILIKE '%URGENT' AND o_orderstatus IN ('O', 'F') AND NOT o_orderkey IS NULL")
both("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
both(
    "string_fns",
    "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, substring(c_name, 2, 5) AS sub, replace(c_name, '0', '-') AS rep, concat(c_mktsegment, '/', c_name) AS cat, left(c_name, 3) AS lf, right(c_name, 4) AS rt, lpad(CAST(c_custkey AS STRING), 8, '0') AS lp, rpad(c_mktsegment, 12, '.') AS rp, reverse(c_name) AS rv, trim(concat('  ', c_name, ' ')) AS tr, split_part(c_name, '#', 2) AS sp, instr(c_name, '#') AS ix FROM customer",
    "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(length(c_name) AS INTEGER) AS n, substring(c_name, 2, 5) AS sub, replace(c_name, '0', '-') AS rep, concat(c_mktsegment, '/', c_name) AS cat, left(c_name, 3) AS lf, right(c_name, 4) AS rt, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS lp, rpad(c_mktsegment, 12, '.') AS rp, reverse(c_name) AS rv, trim(concat('  ', c_name, ' ')) AS tr, split_part(c_name, '#', 2) AS sp, CAST(instr(c_name, '#') AS INTEGER) AS ix FROM customer",
)
both(
    "date_fns",
    "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS mon, date_format(o_orderdate, 'yyyy-MM') AS ym, CAST(add_months(CAST(o_orderdate AS DATE), 1) AS STRING) AS nxt, CAST(last_day(CAST(o_orderdate AS DATE)) AS STRING) AS ld, datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS gap, extract(DOW FROM o_orderdate) - 1 AS dow FROM orders",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS mon, strftime(o_orderdate, '%Y-%m') AS ym, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS nxt, CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS ld, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS gap, CAST(extract(dow FROM o_orderdate) AS INTEGER) AS dow FROM orders",
)
both(
    "math_fns",
    "SELECT l_orderkey, l_linenumber, l_partkey, abs(-l_quantity) AS a, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c, round(l_extendedprice / 3, 3) AS r, round(sqrt(l_quantity), 6) AS s, power(l_linenumber, 2) AS p, l_partkey % 7 AS m, l_partkey div 7 AS d, greatest(l_partkey, l_suppkey) AS g, least(l_partkey, l_suppkey) AS lo FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_partkey, abs(-l_quantity) AS a, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c, round(l_extendedprice / 3, 3) AS r, round(sqrt(l_quantity), 6) AS s, CAST(power(l_linenumber, 2) AS DOUBLE) AS p, l_partkey % 7 AS m, l_partkey // 7 AS d, greatest(l_partkey, l_suppkey) AS g, least(l_partkey, l_suppkey) AS lo FROM lineitem",
)
both(
    "array_fns",
    "SELECT vec_id, size(embedding) AS n, CAST(round(element_at(embedding, 1), 6) AS DOUBLE) AS first_x, CAST(round(embedding[1], 6) AS DOUBLE) AS second_x, CAST(round(array_max(embedding), 6) AS DOUBLE) AS mx, size(filter(embedding, x -> x > 0)) AS positive FROM embeddings",
    "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(round(embedding[1], 6) AS DOUBLE) AS first_x, CAST(round(embedding[2], 6) AS DOUBLE) AS second_x, CAST(round(list_max(embedding), 6) AS DOUBLE) AS mx, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive FROM embeddings",
)
both(
    "json_fns",
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events WHERE get_json_object(props, '$.k') IS NOT NULL",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
)
both(
    "cast_try_cast",
    "SELECT o_orderkey, try_cast(o_orderpriority AS INT) AS bad, try_cast(substring(o_orderpriority, 1, 1) AS INT) AS good, CAST(o_orderkey AS STRING) AS s, o_orderkey::DOUBLE AS d FROM orders",
    "SELECT o_orderkey, try_cast(o_orderpriority AS INTEGER) AS bad, try_cast(substring(o_orderpriority, 1, 1) AS INTEGER) AS good, CAST(o_orderkey AS VARCHAR) AS s, o_orderkey::DOUBLE AS d FROM orders",
)
both("null_fns", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS c, nullif(o_orderkey % 5, 0) AS n, CASE WHEN nullif(o_orderstatus, 'O') IS NULL THEN 1 ELSE 0 END AS i, nullif(o_orderstatus, 'F') IS DISTINCT FROM NULL AS x FROM orders")
both("hash_fns", "SELECT doc_id, sha2(text, 256) AS sha, md5(text) AS md FROM documents", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
both("division", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey / 2 AS half FROM lineitem")
both("regexp_fns", "SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#') AS masked FROM pages", "SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS masked FROM pages")


@REGISTRY.add("SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0 AND o_custkey BETWEEN 2 AND 1998")
def in_list_large(spark, sf_dir):
    return relational.in_list(table(spark, sf_dir, "orders"), "o_custkey", list(range(2, 2000, 2))).select("o_orderkey")


@REGISTRY.add("SELECT count(*) AS raw_rows, count(*) FILTER (WHERE v IS NULL) AS empty_rows, count(DISTINCT v) AS distinct_values FROM (SELECT nullif(trim(CASE WHEN o_orderkey % 10 = 0 THEN '  ' ELSE concat(' ', o_orderpriority) END), '') AS v FROM orders)")
def in_list_cleanup(spark, sf_dir):
    v = F.when(F.col("o_orderkey") % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority")))
    return relational.list_figures(table(spark, sf_dir, "orders").select(v.alias("v")), "v")
