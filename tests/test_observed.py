"""Figures of a run against a second look at its records."""

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from claimflow.operators.meter import call_records, call_summary
from claimflow.operators.report import report_means
from claimflow.plans.observed import RunMeter
from claimflow.plans.phases import Services, run_batch
from claimflow.schemas import PHASES, RAW_FILES
from workload import files
from workload.corpus import raw_files

SF = "/root/testdata/sf0.001"


def when():
    return F.lit("2024-01-01").cast("timestamp")


def model():
    def answer(system, user):
        if "CLM" in user:
            raise RuntimeError("down")
        return '{"patient_name": {"value": "Z", "confidence": 0.9}}'

    return answer


@pytest.mark.parametrize("phase_files", [False, True])
@pytest.mark.parametrize("call", [None, model()])
def test_run_figures_equal_a_second_scan(spark, tmp_path, phase_files, call):
    raw = raw_files(spark, SF).limit(300)
    report = run_batch(spark, raw, str(tmp_path), "r", Services(call=call), phase_files=phase_files, run_ts=when()).first()
    records = spark.read.parquet(f"{tmp_path}/records/run_id=r")
    calls = call_summary(call_records(records)).first()
    means = report_means(records).first()
    assert (report.total_records, report.mean_extraction_confidence) == tuple(means) and means.total_records == 300
    assert (report.llm_calls, report.llm_cost_usd) == (calls.llm_calls, calls.llm_cost_usd) and calls.llm_calls > 0
    assert report.llm_mean_latency_ms == pytest.approx(calls.llm_mean_latency_ms, abs=0.002)
    stages = {k: v for k, v in report.stage_mean_ms.asDict().items() if v is not None}
    assert set(stages) == (set(PHASES[:-1]) if phase_files else {"run"}) and min(stages.values()) > 0
    rows = {r.stage: r for r in spark.read.json(f"{tmp_path}/run_id=r/stages").collect()}
    failed = records.where(~F.col("call.success")).count()
    assert rows["agents"].failed_calls == failed and (call is None or failed > 0)
    assert rows["ingestion"].records == 300 and rows["agents"].in_flight == 0


def test_run_over_no_documents(spark, tmp_path):
    none = spark.createDataFrame([], RAW_FILES)
    report = run_batch(spark, none, str(tmp_path), "r", phase_files=True, run_ts=when()).first()
    assert report.total_records == report.llm_calls == 0 and report.mean_extraction_confidence == 0.0


def test_a_phase_written_again_replaces_its_row(spark, tmp_path):
    meter = RunMeter()
    df = spark.range(10).select(F.lit("x").alias("full_text"), F.lit(None).cast("string").alias("disposition"),
                                F.array(F.lit("ingestion")).alias("stages_completed"))
    for n in (1, 2):
        seen = meter.watched("ingestion", df.limit(5 * n))
        meter.timed("ingestion", lambda seen=seen: seen.write.mode("overwrite").parquet(str(tmp_path / "t")))
    row = meter.table(spark).first()
    assert (row.records, row.staged, row.in_flight, row.text_bytes, row.calls) == (10, 10, 10, 10, 0)


@pytest.mark.parametrize("name", ["run_stages", "run_means"])
def test_queries_equal_sql(spark, name):
    assert compare(files.QUERIES[name](spark, SF), connect(SF), files.ORACLES[name]) == ""
