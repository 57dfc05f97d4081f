"""The queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotraining, language, mixing, ngram_join, packing, quality_lines, redirects, secrets, topk, toxicity
from .common import dealt, table


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents"))
    return quality_lines.apply(docs, quality_lines.fit(docs, table(spark, sf_dir, "labels")))


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.replicate(dealt(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "source", "copy", "n_copies", F.md5("text").alias("text_md5"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents"))
    scored = toxicity.apply(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(dealt(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op5_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(dealt(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents"))
    scored = language.apply(docs, language.fit(docs))
    return scored.select("doc_id", "held_out", "lang_pred", "score", "n_letter_words", "n_switches")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(dealt(table(spark, sf_dir, "documents")))


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = dealt(table(spark, sf_dir, "documents")), dealt(table(spark, sf_dir, "pages"))
    return cotraining.apply(docs, pages, cotraining.fit(docs, pages, table(spark, sf_dir, "labels")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(dealt(table(spark, sf_dir, "documents")))


def op10_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redirects.judge(dealt(table(spark, sf_dir, "pages"))).drop("component")


QUERIES = {
    "op1_line_quality": op1_line_quality,
    "op2_poisson_mix": op2_poisson_mix,
    "op3_toxicity": op3_toxicity,
    "op4_pivot_topk": op4_pivot_topk,
    "op5_curve_packing": op5_curve_packing,
    "op6_language": op6_language,
    "op7_ngram_join": op7_ngram_join,
    "op8_cotraining": op8_cotraining,
    "op9_secrets": op9_secrets,
    "op10_redirects": op10_redirects,
}
ORACLE_SQL: dict[str, str] = {"op2_poisson_mix": mixing.ORACLE_SQL, "op4_pivot_topk": topk.ORACLE_SQL, "op9_secrets": secrets.ORACLE_SQL, "op10_redirects": redirects.ORACLE_SQL}
