"""Deterministic test data with traps: edge values first, one row of NULLs, then plausible values.

Rows are made by `spark.range` and hashes of (seed, row, column), so any number of rows is made in parallel and the
same seed gives the same rows. Column specs come from declared or Spark types.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("integer", "decimal", "float", "boolean", "date", "timestamp", "time", "text", "uuid", "json", "binary")
#: Bounds of integers by declared type.
BOUNDS = {"tinyint": (0, 255), "smallint": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}
MAX_ROWS = 10_000


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    declared: str = ""
    length: int | None = None
    precision: int = 18
    scale: int = 2
    low: int = -(2**31)
    high: int = 2**31 - 1
    nullable: bool = True
    is_key: bool = False


_FAMILIES = (
    ("boolean", r"^(bool|boolean|bit(\(1\))?)$"), ("integer", r"^(tiny|small|medium|big|huge)?int(eger)?\d*\b|^(small|big)?serial|^byteint|^long$|^short$"), ("decimal", r"^(decimal|numeric|number|money|dec)\b"),
    ("float", r"^(float|double|real)"), ("timestamp", r"^(timestamp|datetime)"), ("date", r"^date\b"), ("time", r"^time\b"), ("uuid", r"^(uuid|uniqueidentifier)"), ("json", r"^(json|jsonb|variant|super)"),
    ("binary", r"^(binary|varbinary|blob|bytea|bytes|raw|image)"),
)


def column_spec(name: str, declared: str, nullable: bool = True, is_key: bool = False) -> ColumnSpec:
    """What to generate for a declared type; anything unknown is text."""
    d = re.sub(r"\s+", " ", declared.strip().lower())
    kind = next((k for k, p in _FAMILIES if re.search(p, d)), "text")
    args = [int(x) for x in re.findall(r"\d+", d[d.index("(") :])] if "(" in d else []
    low, high = BOUNDS["int"]
    if kind == "integer":
        word = "tinyint" if d.startswith(("tinyint", "byteint")) else "smallint" if d.startswith(("smallint", "int2", "short", "smallserial")) else "bigint" if d.startswith(("bigint", "int8", "int64", "long", "bigserial")) else "int"
        low, high = BOUNDS[word]
    if kind == "decimal":
        p, s = (args + [18, 2])[0] if args else 18, args[1] if len(args) > 1 else (0 if args else 2)
        return ColumnSpec(name, kind, declared, None, p, s, nullable=nullable, is_key=is_key)
    return ColumnSpec(name, kind, declared, args[0] if args and kind == "text" else None, low=low, high=high, nullable=nullable, is_key=is_key)


def specs_of(df: DataFrame, key: str | None = None) -> list[ColumnSpec]:
    return [column_spec(f.name, f.dataType.simpleString(), f.nullable and f.name != key, f.name == key) for f in df.schema]


def edges(spec: ColumnSpec) -> list[tuple[str, str]]:
    """Text and name of the edge values of a column."""
    if spec.kind == "integer":
        return [("0", "zero"), ("-1" if spec.low < 0 else "1", "minus one" if spec.low < 0 else "one"), (str(spec.high), "greatest"), (str(spec.low), "least")]
    if spec.kind == "decimal":
        whole, frac = "9" * (spec.precision - spec.scale) or "0", "9" * spec.scale
        top = f"{whole}.{frac}" if frac else whole
        step = f"0.{'0' * (spec.scale - 1)}1" if spec.scale else "1"
        return [("0", "zero"), (step, "smallest step"), (f"-{step}", "smallest step down"), (top, "greatest"), (f"-{top}", "least")]
    if spec.kind == "float":
        return [("0", "zero"), ("-0.0", "negative zero"), ("0.1", "no exact binary form"), ("1e15", "large"), ("1e-7", "small")]
    fixed = {
        "boolean": [("true", "true"), ("false", "false")],
        "date": [("1970-01-01", "epoch"), ("1969-12-31", "before the epoch"), ("2000-02-29", "leap day"), ("1900-02-28", "no leap year"), ("9999-12-31", "far future"), ("0001-01-01", "first day")],
        "timestamp": [("1970-01-01 00:00:00", "epoch"), ("1969-12-31 23:59:59", "before the epoch"), ("2000-02-29 12:00:00.123456", "microseconds"), ("2024-03-10 02:30:00", "skipped by daylight saving"), ("2024-11-03 01:30:00", "twice by daylight saving"), ("9999-12-31 23:59:59", "far future")],
        "time": [("00:00:00", "midnight"), ("23:59:59", "last second"), ("12:34:56.789", "milliseconds")],
        "uuid": [("00000000-0000-0000-0000-000000000000", "all zeros"), ("ffffffff-ffff-ffff-ffff-ffffffffffff", "all ones")],
        "json": [("{}", "empty object"), ("[]", "empty array"), ("null", "JSON null"), ('{"a": "it\'s \\"quoted\\"", "n": null}', "quotes and null")],
        "binary": [("", "empty"), ("00ff10", "zero byte")],
    }
    if spec.kind in fixed:
        return fixed[spec.kind]
    out = [
        ("", "empty"), (" ", "blank"), (" padded ", "outer blanks"), ("\t", "tab"), ("line\nbreak", "line end"), ("O'Brien", "apostrophe"), ('say "hi"', "quotes"), ("a,b;c|d", "delimiters"), ("back\\slash", "backslash"),
        ("NULL", "the word NULL"), ("007", "leading zeros"), ("Ünïcödé", "accents"), ("🙂", "outside the basic plane"), ("é", "combining accent"), ("<b>&amp;</b>", "markup"),
    ]
    out = [(v, n) for v, n in out if spec.length is None or len(v) <= spec.length]
    return out + ([("x" * spec.length, "full length")] if spec.length else [])


#: Words for plausible values.
WORDS = {
    "first": ("Ada", "Ben", "Chloe", "Dev", "Elif", "Femi", "Grace", "Hana"), "last": ("Archer", "Bello", "Costa", "Dutta", "Evans", "Fischer", "Gupta", "Haddad"),
    "city": ("Lima", "Oslo", "Pune", "Quito", "Riga", "Seoul", "Tunis", "Wien"), "country": ("PE", "NO", "IN", "EC", "LV", "KR", "TN", "AT"), "status": ("new", "open", "paid", "sent", "done", "void"),
    "any": ("amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heron"),
}


def _pick(words: tuple[str, ...], h: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(h, F.lit(len(words))) + 1).cast("int"))


def plausible(spec: ColumnSpec, row: Column, seed: int) -> Column:
    """A likely value as text, from the column's name and kind."""
    h = F.xxhash64(F.lit(seed), row, F.lit(spec.name))
    name = spec.name.lower()
    if spec.kind == "integer":
        top = min(spec.high, 100_000)
        return F.pmod(h, F.lit(top)).cast("string")
    if spec.kind == "decimal":
        digits = min(spec.precision, 9)
        whole = F.pmod(h, F.lit(10**digits))
        return (whole.cast("decimal(38,0)") / F.lit(10**spec.scale).cast("decimal(38,0)")).cast(f"decimal(38,{spec.scale})").cast("string")
    if spec.kind == "float":
        return (F.pmod(h, F.lit(1_000_000)) / F.lit(1000.0)).cast("string")
    if spec.kind == "boolean":
        return F.when(F.pmod(h, F.lit(2)) == 0, "true").otherwise("false")
    if spec.kind == "date":
        return F.date_add(F.lit("2015-01-01").cast("date"), F.pmod(h, F.lit(3650)).cast("int")).cast("string")
    if spec.kind == "timestamp":
        return F.date_format(F.timestamp_seconds(F.lit(1420070400) + F.pmod(h, F.lit(3650 * 86400))), "yyyy-MM-dd HH:mm:ss")
    if spec.kind == "time":
        s = F.pmod(h, F.lit(86400))
        return F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), (s % 3600 / 60).cast("int"), (s % 60).cast("int"))
    if spec.kind == "uuid":
        m = F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), F.lit(spec.name)))
        return F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.concat(F.lit("4"), F.substring(m, 14, 3)), F.concat(F.lit("a"), F.substring(m, 18, 3)), F.substring(m, 21, 12))
    if spec.kind == "json":
        return F.format_string('{"k": %d}', F.pmod(h, F.lit(1000)))
    if spec.kind == "binary":
        return F.lower(F.hex(h))
    g = F.xxhash64(h, F.lit("second"))
    if "mail" in name:
        out = F.concat(F.lower(_pick(WORDS["first"], h)), F.lit("."), F.lower(_pick(WORDS["last"], g)), row.cast("string"), F.lit("@example.com"))
    elif "phone" in name:
        out = F.format_string("+00 555 %07d", F.pmod(h, F.lit(10_000_000)))
    elif key := next((k for k in ("first", "last", "city", "country", "status") if k in name), None):
        out = _pick(WORDS[key], h)
    elif "name" in name:
        out = F.concat(_pick(WORDS["first"], h), F.lit(" "), _pick(WORDS["last"], g))
    else:
        out = F.concat(_pick(WORDS["any"], h), F.lit("-"), F.pmod(g, F.lit(1000)).cast("string"))
    return F.substring(out, 1, spec.length) if spec.length else out


def generate_rows(spark: SparkSession, specs: list[ColumnSpec], rows: int = 100, seed: int = 1, null_percent: int = 5) -> DataFrame:
    """row, and for each column a struct of value (text, null for NULL), kind and edge (its name, or null).

    The first rows hold the edge values, the next one NULL wherever it may be; keys count up and are unique, and a
    text key's first two rows differ in case only. At most MAX_ROWS rows are made.
    """
    if not specs:
        raise ValueError("no columns")
    rows = max(0, min(rows, MAX_ROWS))
    n_edges = max((len(edges(s)) for s in specs if not s.is_key), default=0)
    row = F.col("row")
    out = []
    for s in specs:
        if s.is_key:
            if s.kind == "text":
                number = F.format_string("%05d", F.greatest(row, F.lit(1)))
                value = F.when(row == 0, "K00001").otherwise(F.concat(F.lit("k"), number))
            elif s.kind in ("uuid", "date", "timestamp"):
                value = plausible(s, row, seed) if s.kind == "uuid" else F.date_add(F.lit("2000-01-01").cast("date"), row.cast("int")).cast("string")
            else:
                value = (row + 1).cast("string")
            out.append(F.struct(value.alias("value"), F.lit(s.kind).alias("kind"), F.lit(None).cast("string").alias("edge")).alias(s.name))
            continue
        found = edges(s)
        table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(n).alias("n")) for v, n in found])
        at = F.try_element_at(table, (row + 1).cast("int"))
        hidden = F.lit(s.nullable) & ((row == n_edges) | ((row > n_edges) & (F.pmod(F.xxhash64(F.lit(seed), row, F.lit(s.name), F.lit("null")), F.lit(100)) < null_percent)))
        value = F.when(row < len(found), at["v"]).when(~hidden, plausible(s, row, seed))
        edge = F.when(row < len(found), at["n"]).when((row == n_edges) & F.lit(s.nullable), "NULL")
        out.append(F.struct(value.alias("value"), F.lit(s.kind).alias("kind"), edge.alias("edge")).alias(s.name))
    return spark.range(rows).withColumnRenamed("id", "row").select("row", *out)


def typed_rows(generated: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """The generated values as Spark types."""
    kinds = {"integer": "bigint", "float": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz"}
    out = []
    for s in specs:
        v = F.col(f"`{s.name}`.value")
        out.append((F.unhex(v) if s.kind == "binary" else v.cast(f"decimal({s.precision},{s.scale})") if s.kind == "decimal" else v.try_cast(kinds[s.kind]) if s.kind in kinds else v).alias(s.name))
    return generated.select(*out)
