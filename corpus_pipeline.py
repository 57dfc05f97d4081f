"""A corpus from documents to packed sequences, in stages.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents.

Defined cases, for every stage: a null text counts as empty; rows without doc_id, with empty or null texts or with nulls in other
columns stay (mixing draws for them as for others, packing packs them with a null doc_id); texts of any length are read
whole; repeated rows are judged alike, one of them stays in the n-gram join; rows that share a doc_id and differ in text
are different documents; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablecheck.llm import mixing, ngram_join, packing, secrets, toxicity
from tablecheck.llm.common import DOCUMENT_COLUMNS, dealt, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.one_of_each(docs.select(*DOCUMENT_COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secrets.redact(docs.select(*DOCUMENT_COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go by chance, so that all sources weigh the same."""
    return mixing.replicate(docs).select(*DOCUMENT_COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", without_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: Trained models, approximate search and tokens cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents"))
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
