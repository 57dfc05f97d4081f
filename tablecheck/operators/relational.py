"""Relational operators that Spark has no single call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType

#: So many values at most are put into an IN list; more are joined.
IN_LIST = 500


#: Parts that the time between the least and the greatest is cut into for an as-of join.
TIME_PARTS = 64
#: Buckets that one range is copied to at most; wider ranges meet buckets of a coarser grid.
RANGE_BUCKETS = 8


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like that one which none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _time_part(time: Column, kind: DataType, least, greatest) -> Column:
    """A number that never falls as time grows: days for dates and times, the value itself for numbers, cut into TIME_PARTS; else 0."""
    if least is None or not isinstance(kind, (DateType, TimestampType, TimestampNTZType, NumericType)):
        return F.lit(0)
    if isinstance(kind, NumericType):
        low, high = float(least), float(greatest)
        width = (high - low) / TIME_PARTS
        if not 0 < width < float("inf"):
            return F.lit(0)
        return F.floor((time.cast("double") - low) / width).cast("int")
    days = lambda t: t.date() if hasattr(t, "date") else t
    first = days(least)
    width = (days(greatest) - first).days // TIME_PARTS + 1
    return F.floor(F.datediff(time.cast("date"), F.lit(first)) / width).cast("int")


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key that is not later; of right rows at one time, the greatest values.

    A key is cut into parts of time, so that a hot key fills many tasks. The last right row of each part is carried into
    the next ones as a row before all others; then both sides meet in one union and one window for each key and part.
    NULL as key or time matches nothing: such left rows come with NULL values.
    """
    keep = [F.col(c).alias(f"l{i}") for i, c in enumerate(left.columns)]
    l = left.select(F.col(by).alias("k"), F.col(left_time).alias("t"), F.struct(*keep).alias("l"))
    r = right.select(F.col(by).alias("k"), F.col(right_time).alias("t"), F.struct(*[F.col(v).alias(f"r{i}") for i, v in enumerate(values)]).alias("r")).where("k is not null and t is not null")
    span = l.select("t").union(r.select("t")).agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    kind = l.union(r.select("k", "t", F.lit(None))).schema["t"].dataType
    part = _time_part(F.col("t"), kind, span.a, span.b).alias("p")
    l, r = l.select("*", part), r.select("*", part)
    last = r.groupBy("k", "p").agg(F.max(F.struct("t", "r")).alias("x"))
    # the parts of a key are few: what the last right row was before each of them
    parts = last.select("k", "p", "x").union(l.where("k is not null and t is not null").select("k", "p", F.lit(None)).distinct()).groupBy("k", "p").agg(F.max("x").alias("x"))
    before = F.last("x", ignorenulls=True).over(Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.select("k", "p", before.alias("x")).where("x is not null")
    none_l, none_r = F.lit(None).cast(l.schema["l"].dataType), F.lit(None).cast(r.schema["r"].dataType)
    asked = l.where("k is not null and t is not null").select("k", "p", "t", F.lit(2).alias("s"), "l", none_r.alias("r"))
    given = r.select("k", "p", "t", F.lit(1).alias("s"), none_l.alias("l"), "r")
    first = carried.select("k", "p", F.col("x.t").alias("t"), F.lit(0).alias("s"), none_l.alias("l"), F.col("x.r").alias("r"))
    w = Window.partitionBy("k", "p").orderBy("t", "s", "r").rowsBetween(Window.unboundedPreceding, 0)
    seen = asked.union(given).union(first).withColumn("r", F.last("r", ignorenulls=True).over(w)).where("s = 2").select("l", "r")
    seen = seen.union(l.where("k is null or t is null").select("l", none_r.alias("r")))
    return seen.select(*[F.col(f"l.l{i}").alias(c) for i, c in enumerate(left.columns)], *[F.col(f"r.r{i}").alias(v) for i, v in enumerate(values)])


def numbered(df: DataFrame, order: list[str], name: str = "_p", parts: int | None = None) -> DataFrame:
    """df with its position (from 1) in a stated order.

    Rows are dealt to ranges of the order and numbered inside each; the rows before a range come from a table with one
    row for each range. No task sees more than its range.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_last() for c in order]
    part, inside, before = unused("_part", df), unused("_inside", df), unused("_before", df)
    # kept, because dealing anew may choose other boundaries
    dealt = _kept(df.repartitionByRange(parts, *by).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(F.col(part), (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))  # one row for each range
    rows = dealt.withColumn(inside, F.row_number().over(Window.partitionBy(part).orderBy(*by)))
    return rows.join(F.broadcast(offsets), part).withColumn(name, F.col(before) + F.col(inside)).drop(part, before, inside)


def _kept(df: DataFrame) -> DataFrame:
    """df as it is now: a checkpoint where the session names a folder for them, else kept in memory and on disk."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()


def positional_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows side by side by their position in a stated order; the shorter side is filled with nulls."""
    place = unused("_place", left, right)
    return numbered(left, left_order, place).join(numbered(right, right_order, place), place, "full_outer").drop(place)


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high: an equi-join on buckets, then the exact condition.

    A range touches about RANGE_BUCKETS buckets at most: those longer than that many buckets of a width meet a grid of
    buckets RANGE_BUCKETS times as wide, and so on; points go to a bucket of each grid that some range uses.
    """
    level, bucket = unused("_level", points, ranges), unused("_bucket", points, ranges)
    size = (F.col(high) - F.col(low)).cast("double") / F.lit(float(width))
    r = ranges.where(F.col(low) < F.col(high)).withColumn(level, F.greatest(F.ceil(F.log(float(RANGE_BUCKETS), size)) - 1, F.lit(0)).cast("int"))
    grid = lambda c: F.floor(F.col(c).cast("double") / (F.lit(float(width)) * F.pow(F.lit(float(RANGE_BUCKETS)), F.col(level))))
    r = r.withColumn(bucket, F.explode(F.sequence(grid(low), grid(high))))
    levels = r.agg(F.collect_set(level).alias(level))  # a few numbers in one row
    p = points.crossJoin(F.broadcast(levels)).withColumn(level, F.explode(level)).withColumn(bucket, grid(point))
    met = p.join(r, [level, bucket]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)))
    return met.drop(level, bucket)


def limit_percent(df: DataFrame, order: list[str], percent: float) -> DataFrame:
    """The first percent of all rows in an order (rounded down)."""
    n = int(df.count() * percent / 100)
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)


def top_with_ties(df: DataFrame, order: list[str], n: int, partition: tuple[str, ...] = ()) -> DataFrame:
    """The first n rows in an order, and all that tie with the last of them; `-name` sorts descending, nulls come last.

    Without partitions the n-th row is found by a top-n first, so that no single task sees all rows; it alone is broadcast.
    """
    names = [c.lstrip("-") for c in order]
    by = [F.col(c.lstrip("-")).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in order]
    if partition:
        rank = unused("_rank", df)
        return df.withColumn(rank, F.rank().over(Window.partitionBy(*partition).orderBy(*by))).where(F.col(rank) <= n).drop(rank)
    place = unused("_place", df)
    nth = df.select(*names).orderBy(*by).limit(n)
    last = nth.select(F.struct(*names).alias("t")).withColumn(place, F.row_number().over(Window.orderBy(*[_in_struct(c) for c in order]))).orderBy(F.col(place).desc()).limit(1).select(F.col("t").alias(place))
    before = F.lit(False)
    equal = F.lit(True)
    for c, o in zip(names, order, strict=True):
        mine, its = F.col(c), F.col(f"{place}.{c}")
        ahead = F.when(mine.isNull(), F.lit(False)).when(its.isNull(), F.lit(True)).otherwise(mine > its if o[0] == "-" else mine < its)
        before = before | (equal & ahead)
        equal = equal & mine.eqNullSafe(its)
    return df.crossJoin(F.broadcast(last)).where(before | equal).drop(place)  # one row


def _in_struct(order: str) -> Column:
    c = F.col(f"t.{order.lstrip('-')}")
    return c.desc_nulls_last() if order[0] == "-" else c.asc_nulls_last()


def qualify(df: DataFrame, condition: Column, **windows: Column) -> DataFrame:
    """Rows that meet a condition on window columns, which are dropped again."""
    return df.withColumns(windows).where(condition).drop(*windows)


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is among values; long lists become a semi join."""
    if len(values) <= IN_LIST:
        return df.where(F.col(column).isin(values))
    kind = df.schema[column].dataType
    wanted = df.sparkSession.createDataFrame([(v,) for v in set(values)], f"_v {kind.simpleString()}")
    return df.join(wanted, F.col(column) == F.col("_v"), "left_semi")


def clean_values(df: DataFrame, column: str) -> DataFrame:
    """Values trimmed, empty ones dropped, each once; raw_rows, kept_values and dropped figures come from list_figures."""
    v = F.trim(F.col(column).cast("string"))
    return df.select(v.alias("value")).where((F.col("value") != "") & F.col("value").isNotNull()).distinct()


def list_figures(df: DataFrame, column: str) -> DataFrame:
    """raw_rows, empty_rows, distinct_values of a column as an IN list would use it."""
    v = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    counts = df.select(v.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("raw_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("empty_rows"), F.count("value").alias("distinct_values"))
