"""The pipeline's stages on each other's output, and its registration."""

from pyspark.sql import functions as F

import corpus_pipeline
from claimflow.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns and {r[0] for r in docs.select("doc_id").collect()} <= ids
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0.7 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert fill.agg(F.max("n")).first()[0] <= 1024
    assert packed.where("piece = 0").count() == docs.count()


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and [n for n in range(1, 14) if not any(k.startswith(f"op{n}_") for k in names)] == []
