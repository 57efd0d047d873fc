"""Queries that read few columns of the phases: one pass, nothing written, the rows of the written phases."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimflow.functions.fence import settle
from claimflow.operators.meter import call_records, call_summary
from claimflow.operators.report import build_report, report_counts, report_means, report_rows
from workload import classify, decide, extract, files, stages


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fence_computes_only_the_columns_that_are_read(spark):
    df = settle(spark.range(3).select("id", F.sha2(F.col("id").cast("string"), 256).alias("costly")))
    assert df.columns == ["id", "costly"]
    assert "sha2" not in optimized(df.select("id")) and "sha2" in optimized(df)
    assert sorted(r.id for r in df.select("id").collect()) == [0, 1, 2]


def test_no_filter_passes_the_fence(spark):
    df = settle(spark.range(6).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), "id")).where("h > '5' and id > 1")
    plan = optimized(df)
    assert plan.index("Filter") < plan.index("Generate") and plan.count("sha2(") == 1
    plain = spark.range(6).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), "id").where("h > '5' and id > 1")
    assert sorted(df.collect()) == sorted(plain.collect())


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Orders with a key that repeats and a null customer."""
    sf = str(tmp_path_factory.mktemp("one-pass"))
    rows = [(k, None if k == 7 else k % 9, Decimal(k) / 3, datetime.date(2024, 1, 1)) for k in [*range(1, 241), 17, 17]]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_totalprice decimal(15,2), o_orderdate date").write.parquet(f"{sf}/orders.parquet")
    return sf


def unwritten(spark, sf, query):
    """The query's rows; it must not have written a phase on its way to them."""
    before = set(stages._written)
    rows = sorted(map(tuple, query(spark, sf).collect()), key=str)
    assert set(stages._written) == before
    return rows


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_documents_by_type(spark, orders):
    got = unwritten(spark, orders, classify.documents_by_type)
    c = F.col("classification")
    by_hand = stages.classified(spark, orders).where(c.isNotNull()).groupBy("document_type", c["method"], c["routing_queue"]).agg(
        F.count(F.lit(1)), F.count_if(F.col("disposition") == "human_review"), F.round(F.avg(c["confidence"]), 4))
    assert got == as_rows(by_hand) and len(got) > 5
    assert as_rows(classify.documents_by_type(spark, orders)) == got  # now from the written phase before


def test_call_metering_and_model_calls(spark, orders):
    for query in (extract.call_metering, extract.model_calls):
        unwritten(spark, orders, query)
    calls = call_records(stages.extracted(spark, orders))
    assert as_rows(extract.call_metering(spark, orders)) == as_rows(call_summary(calls))
    assert as_rows(extract.model_calls(spark, orders)) == as_rows(calls.select(
        "document_id", "model", "prompt_name", "input_tokens", "cost_usd", "success"))


def test_report_counts_and_means(spark, orders):
    counts = unwritten(spark, orders, decide.report_counts)
    means = unwritten(spark, orders, decide.report_means)
    records = stages.decided(spark, orders)
    assert counts == as_rows(report_counts(report_rows(records))) and len(counts) > 10
    assert means == as_rows(report_means(records)) and means[0][0] == 242


def recorded(spark, orders, monkeypatch, query, name, sf=None):
    """The query's rows, where all it reads of the phases is one pass up to ``name``."""
    asked = []

    def passed(spark, sf, name):
        asked.append(name)
        return getattr(stages, name)(spark, orders)

    def by_phase(spark, sf):
        raise AssertionError("reads a phase that is written for it")

    with monkeypatch.context() as m:
        for module in (decide, extract, files):
            for other in ("decided", "governed", "extracted", "live_decided"):
                m.setattr(module, other, by_phase, raising=False)
            m.setattr(module, "passed", passed)
        rows = as_rows(query(spark, sf or orders))
    assert asked == [name]
    return rows


def test_provider_match(spark, orders, tmp_path, monkeypatch):
    spark.createDataFrame([(k, f"s{k}") for k in range(1, 5)], "s_suppkey bigint, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    assert recorded(spark, orders, monkeypatch, decide.provider_match, "governed", str(tmp_path))


def test_phases_in_one_pass_and_result_upsert(spark, orders, tmp_path):
    """Every column of the last phase, in one pass and phase by phase; the upsert writes that phase alone."""
    sf = str(tmp_path)
    spark.read.parquet(f"{orders}/orders.parquet").write.parquet(f"{sf}/orders.parquet")
    got = as_rows(files.result_upsert(spark, sf))
    assert [name for _, at, name in stages._written if at == sf] == ["decided"]
    assert as_rows(stages.decided_at_once(spark, sf)) == as_rows(stages.decided(spark, orders))
    assert len(got) == stages.decided(spark, orders).select("document_id").distinct().count()


def test_dispatch(spark, orders, monkeypatch):
    assert len(recorded(spark, orders, monkeypatch, decide.dispatch, "decided")) == 242


def test_prior_auth(spark, orders, monkeypatch):
    assert recorded(spark, orders, monkeypatch, decide.prior_auth, "decided")


def test_denial_appeal(spark, orders, monkeypatch):
    assert recorded(spark, orders, monkeypatch, decide.denial_appeal, "decided")


def test_referral_triage(spark, orders, monkeypatch):
    assert recorded(spark, orders, monkeypatch, decide.referral_triage, "decided")


def test_run_report(spark, orders, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "view", 2.0), (2, "view", 4.0)], "event_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = recorded(spark, orders, monkeypatch, files.run_report, "decided", str(tmp_path))
    timings = spark.read.parquet(f"{tmp_path}/events.parquet").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    records = stages.decided(spark, orders)
    assert got == as_rows(build_report(records, call_records(records), timings))


def test_rules_fallback(spark, orders, monkeypatch):
    assert recorded(spark, orders, monkeypatch, decide.rules_fallback, "governed")


def test_flatten_fields(spark, orders, monkeypatch):
    assert len(recorded(spark, orders, monkeypatch, decide.flatten_fields, "governed")) > 100


def test_guardrail_flags(spark, orders, monkeypatch):
    assert len(recorded(spark, orders, monkeypatch, decide.guardrail_flags, "governed")) > 100


def test_ocr_penalty(spark, orders, monkeypatch):
    assert len(recorded(spark, orders, monkeypatch, extract.ocr_penalty, "extracted")) > 10
