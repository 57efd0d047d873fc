"""Queries that read their whole input."""

import duckdb
from compare import compare, connect
from pyspark.sql import functions as F

from workload import classify, ingest
from workload.corpus import raw_files
from workload.stages import classified

SF = "/root/testdata/sf0.001"


def test_source_union_all_has_every_source(spark):
    df = ingest.source_union_all(spark, SF)
    assert df.count() == raw_files(spark, SF).count()
    kinds = {r[0] for r in df.select("source_type").distinct().collect()}
    assert {"hl7_v2", "fhir_r4", "edi_837", "webhook"} < kinds and len(kinds) == 5
    assert compare(df, connect(SF), ingest.ORACLES["source_union_all"]) == ""


def test_predict_top2_scores_undecided_documents(spark):
    method = F.col("classification.method")
    want = {r[0] for r in classified(spark, SF).where(method.isin("rules_only", "no_signal")).select("record_id").collect()}
    ids = [r["id"] for r in classify.predict_top2(spark, SF).collect()]
    prose = duckdb.sql(f"SELECT 'doc_' || doc_id FROM '{SF}/documents.parquet'").fetchall()
    assert want and sorted(ids) == sorted([*want, *(r[0] for r in prose)])
