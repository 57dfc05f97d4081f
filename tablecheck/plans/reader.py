"""Query plans read back: a tree of what ran with its row counts, one line for each operator, and what stands out.

Spark times stages, not operators inside generated code, so shares of the time are those of operators that have a
timer of their own; others have none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Heads of statements that only read.
READ_ONLY = ("SELECT", "WITH", "FROM", "VALUES", "TABLE", "PIVOT", "UNPIVOT")
#: Labels by the start of a node's name; nodes in FOLDED and WRAPPERS do not show.
LABELS = (
    ("BroadcastNestedLoopJoin", "Nested-loop join"), ("CartesianProduct", "Cross product"), ("BroadcastHashJoin", "Hash join"), ("ShuffledHashJoin", "Hash join"), ("SortMergeJoin", "Merge join"),
    ("HashAggregate", "Group"), ("ObjectHashAggregate", "Group"), ("SortAggregate", "Group"), ("WindowGroupLimit", "Top rows"), ("Window", "Window"), ("TakeOrderedAndProject", "Top rows"), ("Sort", "Sort"),
    ("GlobalLimit", "Limit"), ("LocalLimit", "Limit"), ("CollectLimit", "Limit"), ("Union", "Union"), ("Generate", "Unnest"), ("Expand", "Expand"), ("Filter", "Filter"), ("Scan", "Scan"), ("FileScan", "Scan"),
    ("FileSourceScan", "Scan"), ("BatchScan", "Scan"), ("LocalTableScan", "Values"), ("Range", "Values"), ("InMemoryTableScan", "Cached scan"), ("BroadcastExchange", "Broadcast"), ("Exchange", "Shuffle"), ("ReusedExchange", "Reused"),
    ("MapInPandas", "Python"), ("MapInArrow", "Python"), ("FlatMapGroups", "Python"), ("ArrowEvalPython", "Python"), ("BatchEvalPython", "Python"),
)
WRAPPERS = ("AdaptiveSparkPlan", "WholeStageCodegen", "InputAdapter", "ColumnarToRow", "ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage", "TableCacheQueryStage", "AQEShuffleRead", "CommandResult", "Execute")
FOLDED = ("Project",)
#: What makes an insight.
HOT_SHARE, ESTIMATE_FACTOR, ESTIMATE_ROWS, SCAN_ROWS, SCAN_KEPT = 0.35, 10, 1000, 10_000, 0.01


@dataclass
class PlanStep:
    label: str
    operator: str
    detail: str
    rows: int | None = None
    millis: float | None = None
    estimate: int | None = None
    share: float | None = None
    read_rows: int | None = None
    children: list[PlanStep] = field(default_factory=list)

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def is_read_only(sql: str) -> bool:
    """Whether a statement starts with a head that only reads; comments and brackets before it do not count."""
    text = re.sub(r"^(?:\s|\(|--[^\n]*\n|/\*.*?\*/)+", "", sql, flags=re.S)
    m = re.match(r"[A-Za-z]+", text)
    return bool(m) and m[0].upper() in READ_ONLY


def is_explainable(sql: str) -> bool:
    from tablecheck.sqltext.scan import statements

    return len(statements(sql)) == 1 and is_read_only(sql)


def run_read_only(spark: SparkSession, sql: str) -> DataFrame:
    if not is_explainable(sql):
        raise ValueError("one statement that only reads is expected")
    return spark.sql(sql.strip().rstrip(";"))


@dataclass
class QueryShape:
    columns: list[str]
    rows: list[list]
    total: int
    truncated: bool


def shape(df: DataFrame, shown: int = 500) -> QueryShape:
    """The first rows and the true total; never more than `shown` rows reach the driver."""
    rows = [list(r) for r in df.limit(shown + 1).collect()]
    total = df.count() if len(rows) > shown else len(rows)
    return QueryShape(df.columns, rows[:shown], total, total > shown)


def displayed(df: DataFrame) -> DataFrame:
    """Columns of types that lose something on the way out, as text; as it is when names repeat."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from tablecheck.functions.expr import as_text, quoted

    if len(set(df.columns)) < len(df.columns):
        return df
    lossy = (T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.StructType, T.MapType, T.ArrayType)
    return df.withColumns({f.name: as_text(F.col(quoted(f.name)), f.dataType) for f in df.schema if isinstance(f.dataType, lossy)}) if any(isinstance(f.dataType, lossy) for f in df.schema) else df


def _children(node) -> list:
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if name.endswith("QueryStageExec"):
        return [node.plan()]
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def _metrics(node) -> dict[str, int]:
    out, it = {}, node.metrics().iterator()
    while it.hasNext():
        pair = it.next()
        out[pair._1()] = pair._2().value()
    return out


def _summary(label: str, name: str, text: str) -> str:
    """One line on an operator."""
    text = re.sub(r"#\d+L?", "", text)
    if label == "Scan":
        m = re.search(r"PushedFilters: \[([^\]]*)\]", text)
        cols = re.search(r"\[([^\]]*)\]", text)
        return ", ".join(x for x in (cols and f"columns {cols[1]}", m and m[1] and f"filters {m[1]}") if x)
    if label.endswith("join"):
        m = re.search(r"\[([^\]]*)\], \[([^\]]*)\], (\w+)", text)
        return f"{m[3]} on {m[1]} = {m[2]}" if m else text[len(name) :].strip()[:120]
    if label == "Group":
        m = re.search(r"keys=\[([^\]]*)\], functions=\[(.*?)\]", text)
        return f"by {m[1] or 'nothing'}: {m[2]}"[:160] if m else ""
    return text[len(name) :].strip()[:160]


def read_plan(df: DataFrame) -> PlanStep:
    """The plan of a DataFrame that has run (`df.collect()` on the same object), with row counts."""
    query = df._jdf.queryExecution()

    def walk(node) -> list[PlanStep]:
        name = node.nodeName()
        below = [s for c in _children(node) for s in walk(c)]
        if name.startswith(WRAPPERS):
            return below
        if name.startswith(FOLDED) and len(below) == 1:
            return below
        label = next((x for start, x in LABELS if name.startswith(start)), name)
        m = _metrics(node)
        rows = m.get("numOutputRows", m.get("recordsRead", m.get("shuffleRecordsWritten")))
        timers = [v / (1e6 if k.startswith("shuffle") else 1) for k, v in m.items() if k in ("sortTime", "aggTime", "buildTime", "scanTime", "collectTime", "pythonTotalTime", "shuffleWriteTime") and v > 0]
        step = PlanStep(label, name, _summary(label, name, node.simpleString(60)), rows, sum(timers) if timers else None, children=below)
        if label == "Group" and len(below) == 1:
            inner = below[0].children[0] if below[0].label == "Shuffle" and len(below[0].children) == 1 else below[0]
            if inner.label == "Group":  # partial and final sums are one operator
                step.children = inner.children
                step.millis = sum(x for x in (step.millis, inner.millis) if x) or None
        if label == "Scan":
            step.read_rows = m.get("numOutputRows")
        return [step]

    steps = walk(query.executedPlan())
    root = steps[0] if len(steps) == 1 else PlanStep("Result", "Result", "", children=steps)
    total = sum(s.millis or 0 for s in root.walk())
    for s in root.walk():
        s.share = s.millis / total if total and s.millis is not None else None
    stats = query.optimizedPlan().stats().rowCount()
    root.estimate = int(str(stats.get())) if stats.isDefined() else None
    return root


def insights(root: PlanStep) -> list[str]:
    """What stands out: the hottest operator, joins of every row with every row, wrong estimates, scans that keep little."""
    out = []
    hot = max((s for s in root.walk() if s.share), key=lambda s: s.share, default=None)
    if hot and hot.share >= HOT_SHARE:
        out.append(f"{hot.label} takes {hot.share:.0%} of the timed work.")
    for s in root.walk():
        if s.label in ("Nested-loop join", "Cross product"):
            out.append(f"{s.label}: every row meets every row of the other side.")
        if s.estimate is not None and s.rows is not None and max(s.rows, s.estimate) > ESTIMATE_ROWS:
            ratio = max(s.rows, 1) / max(s.estimate, 1)
            if ratio >= ESTIMATE_FACTOR or ratio <= 1 / ESTIMATE_FACTOR:
                out.append(f"{s.label}: {s.rows:,} rows against an estimate of {s.estimate:,}.")
        if s.label == "Filter" and s.rows is not None and s.children and s.children[0].label == "Scan":
            read = s.children[0].read_rows or 0
            if read >= SCAN_ROWS and s.rows < SCAN_KEPT * read:
                out.append(f"Scan: {read:,} rows read, {s.rows:,} kept; partition or sort by the filtered column.")
    return out


def explain(spark: SparkSession, sql: str) -> tuple[PlanStep, list[str]]:
    """Run a statement that only reads, throwing its rows away on the executors, and read its plan."""
    df = run_read_only(spark, sql)
    df._jdf.queryExecution().toRdd().count()
    root = read_plan(df)
    return root, insights(root)


def tree_text(root: PlanStep, depth: int = 0) -> str:
    line = "  " * depth + root.label + (f" [{root.rows:,} rows]" if root.rows is not None else "") + (f" {root.detail}" if root.detail else "")
    return "\n".join([line, *(tree_text(c, depth + 1) for c in root.children)])
