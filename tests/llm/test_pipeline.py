"""The pipeline's stages on odd cases, each judged on its own input."""

import collections

import corpus_pipeline
from tests.llm.conftest import BASE, ITEM, LINE


def test_stages(spark, sf_dir, data):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), name)
        seen[name] = docs.collect()
        if name != "encode":
            assert docs.columns == columns and all(r["kept"] == r["lower"] == "x" for r in seen[name])
    ids = {n: collections.Counter(r["doc_id"] for r in rows) for n, rows in seen.items()}
    short = {i for i, t, *_ in data if len((t or "").split()) < 20}
    assert not short & set(ids["quality"]) and ids["quality"][0] == 2
    assert not any(LINE in r["text"] for r in seen["lines"]) and ids["lines"] == ids["quality"]
    assert ids["near"][0] == 1 and 1 not in ids["near"] and 2 not in ids["near"]  # copies of 0, in capitals too
    leaked = {i for i, t, *_ in data if t and ITEM in t}
    assert set(ids["near"]) - set(ids["leaks"]) == leaked & set(ids["near"])
    assert ids["encode"] == ids["leaks"]
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in seen["encode"])


def test_run(spark, sf_dir, empty_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 10
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
    assert BASE
