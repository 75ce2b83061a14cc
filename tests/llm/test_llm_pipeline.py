"""The pipeline on small data: stages chain, keep columns, and remove what they should."""

from __future__ import annotations

import corpus_pipeline
from courtside.llm.queries import tokenizer
from llm.llm_fixtures import SF, documents
from llm.test_llm_texts import check_packing


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = apply(spark, docs, SF)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    assert tokenizer()


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_an_empty_table(spark):
    empty = documents(spark, [])
    for _, apply in corpus_pipeline.STAGES:
        assert apply(spark, empty, SF).count() == 0
