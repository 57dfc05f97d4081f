"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its share of the target weights times the wanted rows, over the rows it has.
The number of copies of a document is the Poisson distribution of that mean, inverted at a uniform number that a hash
of seed and document gives, so a rerun makes the same copies. Copies are exploded and shuffled globally by hash.

Weights come as a map from source to weight; sources that it lacks get weight 1 (None: all are equal). Defined cases:
a null source is a source of its own with weight 1 (or that of the key None in the map); a row without doc_id draws by
its text; repeated rows get the same number of copies; texts are neither read nor cut, but for the shuffle's hash; a weight of 0 drops
the source; an empty table gives an empty result; extra columns are ignored by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import running
from .common import DOCUMENT_COLUMNS, written

#: So many cumulative probabilities of all sources at most are broadcast; more are joined by key.
MAX_BROADCAST_VALUES = 1_000_000
#: Parts that a source's rows are dealt to where sources are joined by key.
SALT = 64
NO_SOURCE = "\u0000none"


def uniform(seed: int, doc_id: str, source: str, text: str) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5; the text decides where there is no doc_id."""
    none = F.lit(NO_SOURCE)
    who = F.coalesce(F.col(doc_id).cast("string"), F.concat(none, F.md5(F.coalesce(F.col(text), none))))
    key = F.concat_ws("\u0001", F.lit(str(seed)), who, F.coalesce(F.col(source), none))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def poisson_cdf(rate: str) -> Column:
    """P(X <= k) for k = 0, 1, … as an array, as far as the tail is below the least uniform number."""
    steps = f"cast(ceil({rate} + 12 * sqrt({rate}) + 40) as int)"
    # running() leaves out the element itself, so the element after it ends each sum
    logs = running(f"concat(array(-{rate}), transform(sequence(1, {steps}), k -> ln({rate}) - ln(k)), array(0D))", "double")
    sums = running(f"concat(transform(slice({logs}, 2, {steps} + 1), x -> exp(x)), array(0D))", "double")
    return F.expr(f"CASE WHEN {rate} > 0 THEN slice({sums}, 2, {steps} + 1) ELSE cast(array(1) as array<double>) END")


def source_rates(docs: DataFrame, weights: dict | None, total_rows: float | None) -> DataFrame:
    """source, rows, rate: one row for each source."""
    key = F.coalesce(F.col("source"), F.lit(NO_SOURCE))
    counts = docs.groupBy(key.alias("source_key")).agg(F.count(F.lit(1)).alias("rows"))
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source_key") == F.lit(NO_SOURCE if name is None else name), F.lit(float(value))).otherwise(weight)
    every = counts.withColumn("weight", weight)
    sums = every.agg(F.sum("weight").alias("weights"), F.sum("rows").alias("all_rows"))
    wanted = F.col("all_rows").cast("double") if total_rows is None else F.lit(float(total_rows))
    rate = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights") * wanted / F.col("rows")).otherwise(0.0)
    return every.join(F.broadcast(sums), how="cross").select("source_key", "rows", rate.alias("rate"))


def replicate(docs: DataFrame, weights: dict | None = None, total_rows: float | None = None, seed: int = 20) -> DataFrame:
    """The columns of documents, with copy (from 1), n_copies, rate and shuffle_key; total_rows None keeps the size of docs."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    rates = written(source_rates(docs, weights, total_rows).withColumn("cdf", poisson_cdf("rate")).drop("rows"))
    few = (rates.agg(F.sum(F.size("cdf")).alias("n")).first().n or 0) <= MAX_BROADCAST_VALUES
    keyed = docs.withColumn("source_key", F.coalesce(F.col("source"), F.lit(NO_SOURCE)))
    if few:
        joined = keyed.join(F.broadcast(rates), "source_key")
    else:  # a hot source is dealt to many tasks
        salted = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_chars", "text"), F.lit(SALT)))
        joined = salted.join(rates.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))), ["source_key", "salt"])
    copies = joined.withColumn("u", uniform(seed, "doc_id", "source", "text")).withColumn("n_copies", F.expr("size(filter(cdf, c -> c < u))"))
    out = copies.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    # rows without doc_id may be many and alike: they are dealt one by one
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    shuffled = out.withColumn("shuffle_key", F.xxhash64(F.lit(seed), "doc_id", "copy", "text", place))
    return shuffled.select(*DOCUMENT_COLUMNS, "copy", "n_copies", "rate", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")


#: What the registered query returns, in DuckDB SQL. doc_id is unique in documents.
ORACLE_SQL = """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM c)) * (SELECT sum(n) FROM c)::DOUBLE / n AS rate FROM c),
k AS (SELECT source, rate, k FROM r, range(0, 400) t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 40)),
p AS (SELECT source, k, exp(-rate + k * ln(rate) - CASE WHEN k < 2 THEN 0 ELSE lgamma(k + 1) END) AS pmf FROM k),
f AS (SELECT source, k, sum(pmf) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
u AS (SELECT doc_id, source, text, (('0x' || substr(md5('20' || chr(1) || doc_id || chr(1) || source), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT u.doc_id, u.source, count(*) FILTER (WHERE f.cdf < u.u) AS n_copies FROM u JOIN f ON u.source = f.source GROUP BY 1, 2),
e AS (SELECT doc_id, unnest(range(1, n_copies + 1)) AS copy, n_copies FROM n)
SELECT e.doc_id, d.source, CAST(e.copy AS INTEGER) AS copy, CAST(e.n_copies AS INTEGER) AS n_copies, md5(d.text) AS text_md5
FROM e JOIN documents d ON d.doc_id = e.doc_id
"""
