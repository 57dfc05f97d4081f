import corpus_pipeline
from tests.conftest import SF
from tests.llm.helpers import empty_documents, odd_documents


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "secrets", "mixing", "packing"]
    rows = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows.append(docs.count())
    assert rows[0] > rows[1] > rows[2] == rows[3] and rows[4] > 0
    pieces = corpus_pipeline.packed(spark, docs, SF)
    assert pieces.where("start = 0").count() == rows[4]


def test_odd_and_empty_documents(spark):
    for docs in (odd_documents(spark), empty_documents(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, SF))
        assert docs.columns[0] == "doc_id"
