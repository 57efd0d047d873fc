"""Stages that carry whole rows, and the classifier's bounded sample."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from claimflow.llm import exact_dedup, jaccard, quality
from claimflow.llm.common import stored

SF = "/root/testdata/sf0.001"
CLASHES = "_key long, _top string, _hex string, _keep long, _row string, _id long, _tops int, _score double, component_id long, keep_id int"


def clashing(spark, rows):
    """(doc_id, text) with extra columns named like the operators' own."""
    return spark.createDataFrame([(i, t, 1, "t", "h", 2, "r", 3, 4, 0.1, 5, 6) for i, t in rows],
                                 f"doc_id long, text string, {CLASHES}").repartition(3)


LONG = " ".join(f"word{k}" for k in range(60))
ROWS = [(1, "one text"), (2, "ONE text"), (3, "other"), (4, None), (5, ""), (6, LONG), (7, LONG + " end"), (7, LONG + " end"),
        (None, "no id"), (None, "no id"), (8, "\n \t")]


def test_exact_dedup_keeps_rows_whatever_their_columns_are_called(spark):
    kept = exact_dedup.keep_one(clashing(spark, ROWS))
    assert kept.columns == clashing(spark, []).columns
    got = sorted((tuple(r)[:2] for r in kept.collect()), key=str)
    assert got == sorted([(2, "ONE text"), (3, "other"), (5, ""), (6, LONG), (7, LONG + " end"), (None, "no id"), (8, "\n \t")], key=str)
    assert {tuple(r)[2:] for r in kept.collect()} == {(1, "t", "h", 2, "r", 3, 4, 0.1, 5, 6)}
    assert exact_dedup.keep_one(clashing(spark, [])).count() == 0


def test_near_dedup_keeps_rows_whatever_their_columns_are_called(spark):
    kept = jaccard.keep_one(clashing(spark, ROWS))
    assert kept.columns == clashing(spark, []).columns
    assert sorted({str(r.doc_id) for r in kept.collect()}) == ["1", "3", "4", "5", "6", "8", "None"]
    assert jaccard.keep_one(clashing(spark, [])).count() == 0


@pytest.mark.parametrize("most", [100, 12_000])
def test_the_sample_is_drawn_from_rows_that_can_train(spark, most):
    docs = spark.range(0, 300).select((F.col("id") * 1000).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(0, 300_000, 2).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("quality"))
    usable = quality.remainder("doc_id", 3) != 1
    able = docs.where(usable & (F.col("doc_id") % 2 == 0)).count()
    rows = quality.training_rows(docs, labels, usable, most, "doc_id", "text", "quality")
    assert able > 150 and rows.count() == min(able, most)


def test_pipeline_stages_over_odd_documents(spark):
    odd = [(i, f"{LONG} {i % 7} {'x' * (i % 5)}", "en", "s1" if i % 3 else None, 1) for i in range(40)]
    odd += [(100, None, None, None, None), (101, "", "en", "s2", 0), (None, "no id here", "en", "s1", 5), (3, odd[3][1], "en", "s1", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, _keep long, _row int"
    for rows in (odd, []):
        docs = spark.createDataFrame([(*r, "k", 7, 8) for r in rows], schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, SF), name)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert packed.where("piece = 0").count() == docs.count() and (docs.count() > 0 or not rows)
