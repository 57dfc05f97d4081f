"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: alternatives of trigrams that any match must
hold. An index of postings (trigram, doc_id) over the whole corpus, restricted to the trigrams that some rule asks for,
is written to the shared folder; postings are intersected document by document, and only documents that satisfy a
rule's query are verified with its expression. Rules without mandatory trigrams scan every text. Everything is a
DataFrame expression.

Defined cases: a null text counts as empty; an empty text has no spans; a text of any length is scanned whole, in time
that grows with it; repeated rows give repeated results; rows that share a doc_id share their candidates; a null doc_id is
scanned by every rule; an empty table gives an empty result; extra columns of any name are kept by scan and redact and
left out by report. A rule's expression must not match the control characters U+0001 to U+0003.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import BLOCK, bound, literal, running
from .common import forget, unused, written

#: So many candidate documents at most are broadcast to the texts; more are joined by key.
MAX_BROADCAST_ROWS = 200_000
#: Strings that a part of an expression may stand for, at most, before it counts as anything.
MAX_STRINGS, MAX_ALTERNATIVES = 48, 64
#: Marks around matches, and what stands for such a character of a text meanwhile.
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
#: Characters of a part of a text.
PART = 4096
NO_SPANS = "cast(array() as array<struct<start:int,end:int,size:int>>)"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1
    base: bool = False


#: The base kinds, in order; a match fails if its group is shorter than min_length.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES


# Boolean trigram queries


def _trigrams(text: str) -> frozenset[str]:
    text = text.lower()
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _tidy(alternatives: set[frozenset[str]]) -> set[frozenset[str]]:
    """Without alternatives that another one covers; one that asks for nothing covers all."""
    return {a for a in alternatives if not any(b < a for b in alternatives)}


def _strings(op, arg) -> set[str] | None:
    """All strings that an element can stand for, if they are few."""
    if op is C.LITERAL:
        return {chr(arg)}
    if op is C.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                out.add(chr(value))
            elif kind is C.RANGE and value[1] - value[0] < 8:
                out |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is C.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is C.BRANCH:
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 2:
        one = _sequence_strings(arg[2])
        if one is None:
            return None
        out, now = {""} if arg[0] == 0 else set(), {""}
        for n in range(1, int(arg[1]) + 1):
            now = {a + b for a in now for b in one}
            out |= now if n >= arg[0] else set()
        return out if len(out) <= MAX_STRINGS else None
    return {""} if op is C.AT else None


def _sequence_strings(seq) -> set[str] | None:
    out = {""}
    for op, arg in seq:
        more = _strings(op, arg)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams of the lower-cased text, one of which any match holds in full; None: no such query."""
    found: set[frozenset[str]] = {frozenset()}

    def both(a: set[frozenset[str]], b: set[frozenset[str]]) -> set[frozenset[str]]:
        out = _tidy({x | y for x in a for y in b})
        return out if len(out) <= MAX_ALTERNATIVES else a

    def walk(seq) -> None:
        nonlocal found
        run = {""}

        def flush() -> None:
            nonlocal found, run
            found, run = both(found, _tidy({_trigrams(x) for x in run})), {""}

        for op, arg in seq:
            more = _strings(op, arg)
            if more is not None and len(run) * len(more) <= MAX_STRINGS:
                run = {a + b for a in run for b in more}
                continue
            flush()
            if more is not None:
                run = more
            elif op is C.SUBPATTERN:
                walk(arg[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
        flush()

    walk(_parser.parse(pattern))
    return None if frozenset() in found else sorted(found, key=sorted)


# index and candidates


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings: trigram, doc_id; each pair once for each row of docs that holds it."""
    low = F.col("_low")
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.where("doc_id is not null").select("doc_id", F.lower("text").alias("_low")).select(F.explode(hits).alias("trigram"), "doc_id")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, rules: the kinds whose query the postings of a document satisfy."""
    held = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("_t"))
    kinds = []
    for rule in rules:
        if (query := trigram_query(rule.pattern)) is not None:
            any_of = [F.forall(F.array(*map(F.lit, sorted(part))), lambda x: F.array_contains("_t", x)) for part in query]
            met = any_of[0]
            for x in any_of[1:]:
                met = met | x
            kinds.append(F.when(met, F.lit(rule.kind)))
    return held.select("doc_id", F.array_compact(F.array(*kinds)).alias("rules")).where(F.size("rules") > 0)


def spans_of(text: str, rule: Rule) -> Column:
    """Spans of the matches of a rule in a column, leftmost first and not overlapping: start, end in code points, size of the group.

    Matches are marked, the text is split at the marks, and places are running sums of the lengths of the parts.
    """
    pattern = rule.pattern
    if rule.group == 0 and pattern.endswith("]+") and rule.kind == "hex":
        pattern = pattern[:-1] + "{%d,}" % rule.min_length  # a run is a match as a whole
    marked = f"regexp_replace(translate(`{text}`, {literal(OPEN + CLOSE)}, {literal(OTHER * 2)}), {literal(pattern)}, {literal(OPEN + '$0' + CLOSE)})"
    parts = f"split({marked}, {literal(OPEN)})"
    starts = running("transform(_p, (x, i) -> length(x) - if(i = 0, 0, 1))")
    match = f"substring_index(element_at(_p, k), {literal(CLOSE)}, 1)"
    size = f"length(regexp_extract(_m, {literal(pattern)}, {rule.group}))" if rule.group else "length(_m)"
    span = bound(match, "_m", f"named_struct('start', element_at(_s, k), 'end', element_at(_s, k) + length(_m), 'size', {size})")
    every = f"if(size(_p) < 2, {NO_SPANS}, transform(sequence(2, size(_p)), k -> {span}))"
    found = f"filter({bound(parts, '_p', bound(starts, '_s', every))}, x -> x.size >= {rule.min_length})"
    return F.when(F.col(text).rlike(pattern), F.expr(found)).otherwise(F.expr(NO_SPANS))


def scan(docs: DataFrame, rules=RULES, name: str = "found") -> DataFrame:
    """The columns of docs, with name: an array of (start, order, end, kind), sorted."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() if q for part in q for t in part})
    own, asked, text = (unused(docs.columns, x) for x in ("candidate", "asked", "scanned"))
    index = written(build_index(docs.select("doc_id", "text"), trigrams))
    hits = written(candidates(index, rules).select(F.col("doc_id").alias(own), F.col("rules").alias(asked)))
    forget(index)
    side = F.broadcast(hits) if hits.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else hits
    joined = docs.join(side, F.col("doc_id") == F.col(own), "left").withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    parts = []
    for order, rule in enumerate(rules):
        spans = spans_of(text, rule)
        if queries[rule.kind] is not None:
            wanted = F.col("doc_id").isNull() | F.coalesce(F.array_contains(asked, rule.kind), F.lit(False))
            spans = F.when(wanted, spans).otherwise(F.expr(NO_SPANS))
        parts.append(_named(spans, order, rule.kind))
    return joined.withColumn(name, F.array_sort(F.concat(*parts))).drop(own, asked, text)


def _named(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _of_kind(kind: str) -> Column:
    return F.filter("found", lambda s: s["kind"] == kind)


def joined_spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans for each row of docs."""
    found = scan(docs.select("doc_id", "text"), rules)
    base = [r.kind for r in rules if r.base]
    count = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    only = F.filter("found", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *count, F.sha2(joined_spans(only), 256).alias("base_sha256"), joined_spans(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))


def redact(docs: DataFrame, rules=RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs with each secret of the text replaced by mask; where spans overlap, the part after the first is cut with it.
    n_chars, if there is one, follows.

    What stays is a list of gaps between spans, gathered in blocks as in running(); a gap is cut from a part of the text.
    """
    columns = docs.columns
    found, gaps = unused(columns, "found"), unused(columns, "gaps")
    gap = "if(s.start >= x.at, array_append(x.out, named_struct('from', x.at, 'to', s.start)), x.out)"
    inner = f"aggregate(slice(`{found}`, k * {BLOCK} + 1, {BLOCK}), named_struct('at', y.at, 'out', cast(array() as array<struct<from:int,to:int>>)), (x, s) -> named_struct('at', greatest(x.at, s.end), 'out', {gap}))"
    step = bound(inner, "_i", "named_struct('at', _i.at, 'out', array_append(y.out, _i.out))")
    start = "named_struct('at', 0, 'out', cast(array() as array<array<struct<from:int,to:int>>>))"
    last = "array(array(named_struct('from', y.at, 'to', length(text))))"
    all_gaps = f"aggregate(sequence(0, cast(ceil(size(`{found}`) / {BLOCK}) as int) - 1), {start}, (y, k) -> {step}, y -> flatten(concat(y.out, {last})))"
    part = f"slice(_t, g.from div {PART} + 1, greatest(g.to - 1, g.from) div {PART} - g.from div {PART} + 1)"
    piece = f"substring(array_join({part}, ''), g.from % {PART} + 1, g.to - g.from)"
    pieces = bound(f"regexp_extract_all(text, {literal('(?s).{1,%d}' % PART)}, 0)", "_t", f"array_join(transform(`{gaps}`, g -> {piece}), {literal(mask)})")
    some = F.size(found) > 0
    out = scan(docs, rules, found).withColumn(gaps, F.when(some, F.expr(all_gaps))).withColumn("text", F.when(some, F.expr(pieces)).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)


def _oracle() -> str:
    """report() in DuckDB SQL: matches are marked in the text, and places are sums of the lengths between marks."""
    parts = []
    for order, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {order} AS k, '{r.kind}' AS kind, {str(r.base).upper()} AS base, start, start + length(m) AS stop FROM ("
            f"SELECT doc_id, split_part(seg, chr(2), 1) AS m, i, sum(length(replace(seg, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY i) - length(replace(seg, chr(2), '')) AS start FROM ("
            f"SELECT doc_id, unnest(segs) AS seg, unnest(range(len(segs))) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS segs FROM d))) "
            f"WHERE i > 0 AND length(regexp_extract(m, '{pattern}', {r.group})) >= {r.min_length}"
        )
    text = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, k"
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS (" + " UNION ALL ".join(parts) + f"), g AS (SELECT doc_id, string_agg({text}) AS spans, string_agg({text}) FILTER (WHERE base) AS b, count(*) AS n, "
        + ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
        + " FROM s GROUP BY doc_id) SELECT d.doc_id, "
        + ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)
        + ", sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0) AS n_spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"
    )


ORACLE_SQL = _oracle()
