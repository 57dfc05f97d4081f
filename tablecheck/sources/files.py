"""Loading files: which reader, which name, and every questionable reading decision reported."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.functions import shapes
from tablecheck.functions.expr import quoted

#: Kinds by suffix, and suffixes of compression that are looked through.
KINDS = {"csv": "csv", "tsv": "csv", "txt": "csv", "parquet": "parquet", "pq": "parquet", "json": "json", "ndjson": "json", "jsonl": "json"}
COMPRESSED = ("gz", "zst", "bz2")
DELIMITERS = (",", ";", "\t", "|")
#: Bytes of a file that sniffers look at; types are decided on all rows.
HEAD = 1 << 16
#: What Windows-1252 has where Latin-1 has control characters.
C1 = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
C1_AS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
#: Stands for a missing value while reading, so that it stays apart from an empty one.
NOTHING = "\u0000"
CORRUPT = "_corrupt_record"


@dataclass
class Loaded:
    table: str
    df: DataFrame
    notes: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class CsvFailure:
    line: int
    column: str
    value: str
    kind: str


def file_kind(filename: str) -> str:
    """csv, parquet, json or unsupported."""
    parts = filename.lower().rsplit("/", 1)[-1].split(".")[1:]
    while parts and parts[-1] in COMPRESSED:
        parts.pop()
    return KINDS.get(parts[-1], "unsupported") if parts else "unsupported"


def table_name_for(filename: str, taken: set[str] = frozenset()) -> str:
    """An identifier that needs no quotes; `_2`, `_3`, … where it is taken."""
    base = filename.rsplit("/", 1)[-1]
    while "." in base[1:] and (base.rsplit(".", 1)[1].lower() in COMPRESSED or base.rsplit(".", 1)[1].lower() in KINDS):
        base = base.rsplit(".", 1)[0]
    name = re.sub(r"_+", "_", re.sub(r"\W", "_", base.lower(), flags=re.A)).strip("_") or "t"
    name = f"t_{name}" if name[0].isdigit() else name
    used, n, out = {t.lower() for t in taken}, 2, name
    while out in used:
        out, n = f"{name}_{n}", n + 1
    return out


def reader_for(kind: str) -> str:
    if kind not in ("csv", "parquet", "json"):
        raise ValueError(f"no reader for {kind} files")
    return kind


def head_bytes(spark: SparkSession, path: str, most: int = HEAD) -> bytes:
    """The first bytes of a file, from any store that Spark can read."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(where).isDirectory():
        found = sorted(f.getPath().toString() for f in fs.listStatus(where) if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
        return head_bytes(spark, found[0], most) if found else b""
    stream = fs.open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, most)))
    finally:
        stream.close()


def bom_encoding(head: bytes) -> str | None:
    return "UTF-16LE" if head[:2] == b"\xff\xfe" else "UTF-16BE" if head[:2] == b"\xfe\xff" else None


def decode_legacy(data: bytes) -> str:
    """Text that is not UTF-8: UTF-16 by its mark, else Windows-1252."""
    if bom := bom_encoding(data):
        return data[2:].decode(bom.lower(), "replace")
    return "".join(bytes([b]).decode("cp1252", "replace") if 0x80 <= b < 0xA0 else chr(b) for b in data)


def is_encoding_error(message: str) -> bool:
    return bool(re.search(r"invalid (utf-?8|unicode|byte)|malformedinput|not utf-?8|invalid start byte|codec can't decode", message, re.I))


def detect_delimiter(text: str, path: str = "") -> str:
    """Tab for .tsv, else what comes most often outside quotes on the first line."""
    if re.search(r"\.tsv(\.\w+)?$", path, re.I):
        return "\t"
    line = re.sub(r'"(?:[^"]|"")*"', "", text.lstrip("﻿").split("\n", 1)[0])
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def sniff_warning(kind: str, columns: list[str]) -> str | None:
    """One column whose name holds a delimiter: the file was not split."""
    if kind == "csv" and len(columns) == 1 and (found := [d for d in (";", "\t", "|", ",") if d in columns[0]]):
        return f"Read as one column, but its name holds {found[0]!r}: name the delimiter."
    return None


def header_warning(columns: list[str]) -> str | None:
    """Names that a reader makes up: there was no header."""
    if columns and all(re.fullmatch(r"_c\d+|column\d+", c) for c in columns):
        return "No header was found; columns are named by position."
    return None


def _raw_csv(spark: SparkSession, path: str, delimiter: str, encoding: str, head: str, header: bool = True) -> DataFrame:
    options = {
        "header": header, "inferSchema": False, "sep": delimiter, "quote": '"', "escape": '"', "encoding": encoding, "mode": "PERMISSIVE", "nullValue": NOTHING, "emptyValue": "",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "enforceSchema": False,
    }
    if re.search(r'(^|[^"])"[^"]*\n[^"]*"', head):
        options["multiLine"] = True  # a quoted line end: such a file cannot be split
    elif "\r" in head and "\n" not in head:
        options["lineSep"] = "\r"
    if encoding.startswith("UTF-16"):
        options |= {"encoding": "UTF-16", "multiLine": True}  # line ends cannot be found byte by byte
    names = spark.read.options(**options).csv(path).columns
    schema = ", ".join(f"{quoted(n)} string" for n in [*names, CORRUPT])
    df = spark.read.options(**options | {"columnNameOfCorruptRecord": CORRUPT, "enforceSchema": True}).schema(schema).csv(path)
    if encoding == "ISO-8859-1":
        df = df.select(*[F.translate(F.col(quoted(c)), C1, C1_AS).alias(c) for c in df.columns])
    return df


#: Candidates for the type of a text column, from the narrowest; a date is not a timestamp without a time.
def _tests(c: Column) -> dict[str, Column]:
    return {
        "boolean": F.lower(c).isin("true", "false"),
        "bigint": c.rlike(r"^[+-]?\d+$") & c.try_cast("bigint").isNotNull(),
        "double": c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
        "date": c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull(),
        "timestamp_ntz": c.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$") & c.try_cast("timestamp_ntz").isNotNull(),
        "dmy": F.try_to_timestamp(c, F.lit("d/M/yyyy")).isNotNull(),
        "mdy": F.try_to_timestamp(c, F.lit("M/d/yyyy")).isNotNull(),
    }


@dataclass(frozen=True)
class Typing:
    kinds: dict[str, str]
    counts: dict[str, dict[str, int]]
    rows: int
    ragged: int


def infer_types(raw: DataFrame) -> Typing:
    """The narrowest type that every value of a column has, from one pass over all rows.

    A number with a leading zero keeps its column text, since the zero would be lost.
    """
    columns = [c for c in raw.columns if c != CORRUPT]
    sums = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col(CORRUPT).isNotNull() if CORRUPT in raw.columns else F.lit(False)).alias("ragged")]
    names = list(_tests(F.lit("")))
    for i, name in enumerate(columns):
        c = F.nullif(F.col(quoted(name)), F.lit(""))
        sums.append(F.count(c).alias(f"n{i}"))
        sums.append(F.count_if(c.rlike(r"^[+-]?0\d")).alias(f"z{i}"))
        sums += [F.count_if(test).alias(f"{k}{i}") for k, test in _tests(c).items()]
    got = raw.agg(*sums).first().asDict()
    kinds, counts = {}, {}
    for i, name in enumerate(columns):
        counts[name] = {"n": got[f"n{i}"], "zero": got[f"z{i}"]} | {k: got[f"{k}{i}"] for k in names}
        fits = [k for k in names if got[f"n{i}"] and got[f"{k}{i}"] == got[f"n{i}"] and not (got[f"z{i}"] and k in ("bigint", "double"))]
        kinds[name] = fits[0] if fits else "string"
    return Typing(kinds, counts, got["rows"], got["ragged"])


def _typed(name: str, kind: str) -> Column:
    c = F.col(quoted(name))
    if kind == "string":
        return c
    v = F.nullif(c, F.lit(""))
    if kind in ("dmy", "mdy"):
        return F.try_to_timestamp(v, F.lit("d/M/yyyy" if kind == "dmy" else "M/d/yyyy")).cast("date").alias(name)
    return v.try_cast(kind).alias(name)


def first_misfits(raw: DataFrame, kinds: dict[str, str]) -> list[CsvFailure]:
    """For each column line and value of the first one that is not of the kind; two passes for any number of columns."""
    if not kinds:
        return []
    placed = raw.select(F.monotonically_increasing_id().alias("at"), *[F.nullif(F.col(quoted(c)), F.lit("")).alias(f"v{i}") for i, c in enumerate(kinds)])
    bad = [F.when(F.col(f"v{i}").isNotNull() & ~_tests(F.col(f"v{i}"))[k], F.struct("at", F.col(f"v{i}").alias("v"))) for i, k in enumerate(kinds.values())]
    first = placed.agg(*[F.min(b).alias(f"b{i}") for i, b in enumerate(bad)]).first()
    found = [(i, c, k, first[i]) for i, (c, k) in enumerate(kinds.items()) if first[i] is not None]
    if not found:
        return []
    lines = placed.agg(*[F.count(F.when(F.col("at") <= b.at, 1)).alias(f"n{i}") for i, _, _, b in found]).first()
    return [CsvFailure(n + 1, c, b.v, k) for n, (_, c, k, b) in zip(lines, found, strict=True)]


def load_csv(spark: SparkSession, path: str, delimiter: str | None = None, day_first: bool = True) -> tuple[DataFrame, list[str]]:
    """A typed table and notes on every decision that a reader of the data should know."""
    notes: list[str] = []
    head = head_bytes(spark, path) if not path.lower().endswith(COMPRESSED) else b""
    encoding = bom_encoding(head) or "UTF-8"
    if head and encoding != "UTF-8":
        notes.append(f"Read as {encoding}.")
    text = decode_legacy(head) if encoding != "UTF-8" else head.decode("utf-8", "replace")
    if not head:
        first = spark.read.text(path).limit(1).collect()
        text = first[0][0] + "\n" if first else ""
    sep = delimiter or detect_delimiter(text, path)
    raw = _raw_csv(spark, path, sep, encoding, text)
    if encoding == "UTF-8":
        broken = F.lit(False)
        for c in raw.columns[:-1]:
            broken = broken | F.col(quoted(c)).contains("�")
        if any("�" in c for c in raw.columns) or raw.where(broken).take(1):
            raw = _raw_csv(spark, path, sep, "ISO-8859-1", decode_legacy(head))
            notes.append("Not valid UTF-8: read as Windows-1252.")
    columns = [c for c in raw.columns if c != CORRUPT]
    for warning in (sniff_warning("csv", columns), header_warning(columns)):
        if warning:
            notes.append(warning)
    typing = infer_types(raw)
    if typing.ragged:
        notes.append(f"{typing.ragged} of {typing.rows} rows have another number of fields than the header.")
    out = []
    fixed: dict[str, Column] = {}
    nearly: dict[str, str] = {}
    texts = [c for c in columns if typing.kinds[c] == "string" and typing.counts[c]["n"]]
    if texts:
        shape = shapes.text_shapes(raw.select(*[F.col(quoted(c)) for c in texts]), texts, sample=None)
        if sep != ",":
            for r in shapes.decimal_comma_columns(shape).collect():
                fixed[r.column_name] = F.replace(F.nullif(F.col(quoted(r.column_name)), F.lit("")), F.lit(","), F.lit(".")).try_cast("double").alias(r.column_name)
                notes.append(f"{r.column_name}: decimal commas read as numbers.")
        for r in shapes.thousands_columns(shape).collect():
            notes.append(f"{r.column_name}: numbers with thousands separators, kept as text; read them with replace(…, ',', '').")
    for c in columns:
        n, kind = typing.counts[c], typing.kinds[c]
        if c in fixed:
            out.append(fixed[c])
            continue
        if kind in ("dmy", "mdy"):
            if n["dmy"] == n["mdy"]:
                kind = "dmy" if day_first else "mdy"
                notes.append(f"{c}: day and month could be either way round; read as {'day/month' if day_first else 'month/day'}.")
        elif kind == "string" and n["n"]:
            if n["zero"] and n["bigint"] == n["n"]:
                notes.append(f"{c}: leading zeros kept as text.")
            else:
                near = max(("bigint", "double", "date", "timestamp_ntz"), key=lambda k: n[k])
                if n[near] * 10 >= n["n"] * 9:
                    nearly[c] = near
        out.append(_typed(c, kind))
    for bad in first_misfits(raw, nearly):
        notes.append(f"{bad.column}: kept as text, since line {bad.line} holds {bad.value!r}, which is no {bad.kind}.")
    return raw.select(*out), notes


def swapped_date_format(day_first: bool) -> bool:
    return not day_first


def load_table(spark: SparkSession, path: str, filename: str | None = None, taken: set[str] = frozenset(), keep: bool = True, **options) -> Loaded:
    """A file as a table and a view of its own name; kept in memory and on disk so that it is read once."""
    name = filename or path
    kind = reader_for(file_kind(name))
    notes: list[str] = []
    if kind == "csv":
        df, notes = load_csv(spark, path, **options)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        head = head_bytes(spark, path).lstrip()
        df = spark.read.option("multiLine", head[:1] == b"[" or not re.search(r"\.(ndjson|jsonl)", name.lower())).json(path)
    table = table_name_for(name, set(taken))
    if keep:
        df = df.persist()
    df.createOrReplaceTempView(table)
    return Loaded(table, df, notes)


def fingerprint(spark: SparkSession, path: str, most: int = 1 << 30) -> DataFrame:
    """path, bytes, sha256 of each file; null above `most` bytes, where the content is not read."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= most).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > most).select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("sha256"))
    return small.union(large)


def list_tables(spark: SparkSession) -> list[tuple[str, int | None]]:
    """Names of tables and views, with the size that the optimizer assumes."""
    out = []
    for t in spark.catalog.listTables():
        size = spark.table(t.name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        out.append((t.name, int(str(size))))
    return sorted(out)
