"""A landing folder end to end, the text model, and streams against batches."""

import json

import pytest
from pyspark.sql import functions as F

from claimflow.operators.textmodel import TextModel
from claimflow.plans.phases import Services, run_landing, run_phases
from claimflow.sources import landing as ld
from claimflow.streaming import ingest as st

FAX = ["PRIOR AUTHORIZATION REQUEST", "Patient: Ann Lee", "Member ID: M-1", "Payer: Acme (ACME-1)", "Provider NPI: 1234567890",
       "ICD-10: M54.5", "CPT: 99213", "Auth number: PA77", "Status: PENDING"]


def fax(lines, conf):
    return json.dumps({"s3_key": "k", "content_type": "application/pdf", "blocks": [{"page": 1, "text": t, "confidence": conf} for t in lines]})


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    root = tmp_path_factory.mktemp("landing")
    body = json.dumps({"event": "claim.denied", "patient": {"name": "A B"}, "denial": {"reason_code": "CO-50"}})
    files = {
        "fax/a.json": fax(FAX, 95.0), "fax/weak.json": fax(FAX, 41.5), "fax/short.json": fax(["p.1"], 99.0), "fax/bad.json": '{"s3',
        "hl7v2/orm.hl7": "MSH|^~\\&|A|B|C|D|2024||ORM^O01|1|P|2.5\nPID|1||M1||O'BRIEN^ANN||19800102|F\nDG1|1|I|I21.9\n",
        "hl7v2/adt.hl7": "MSH|^~\\&|A|B|C|D|2024||ADT^A08|1|P|2.5\nPID|1||M1||DOE^ANN||19800102|F\n",
        "fhir_r4/empty.json": '{"resourceType": "Bundle", "type": "collection", "entry": []}',
        "edi837/c.edi": "ISA*00~\nNM1*QC*1*DOE*JOHN~\nHI*ABK:M545~\nSV1~\n",
        "webhook/d.json": json.dumps({"headers": {}, "body": body}), "webhook/empty.json": json.dumps({"headers": {}, "body": ""}),
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    return str(root)


EXPECTED = {
    "a.json": "completed", "weak.json": "dlq", "short.json": "dlq", "bad.json": "failed", "orm.hl7": "completed", "adt.hl7": "human_review",
    "empty.json": "dlq", "c.edi": "routed_no_agent", "d.json": "completed",
}


def test_batch_run_and_outputs(spark, landing, tmp_path):
    out = str(tmp_path / "out")
    report = run_landing(spark, landing, out, "r1", run_ts=F.lit("2024-01-01").cast("timestamp")).first()
    records = {r.record_id: r for r in spark.read.parquet(f"{out}/records/run_id=r1").collect()}
    assert len(records) == 10 == report.total_records
    assert records["fhir_r4/empty.json"].disposition == "human_review"
    for name, disposition in EXPECTED.items():
        hit = [r.disposition for k, r in records.items() if k.endswith("/" + name) and not k.startswith("fhir")]
        assert hit == [disposition], name
    assert records["edi837/c.edi"].fallback_source == "rules"
    assert records["hl7v2/orm.hl7"].fields[0].value == "Ann O'Brien"
    assert spark.read.parquet(f"{out}/tables/ingestion_errors").count() == 4
    assert report.by_source["fax"] == 4 and report.by_disposition["completed"] == 3


def test_source_filter_and_partial_run(spark, landing):
    df = run_phases(ld.source_union(spark, landing, ["fax"]), until="ingestion")
    assert df.count() == 4 and "classification" not in df.columns
    with pytest.raises(ValueError):
        ld.check_sources(["nope"])


def test_compacted_table_is_pruned(spark, landing, tmp_path):
    path = str(tmp_path / "bronze")
    ld.compact(ld.source_union(spark, landing), path, files_per_source=2)
    df = ld.read_compacted(spark, path, ["webhook"])
    assert df.count() == 2 and "PartitionFilters: [isnotnull(source" in df._jdf.queryExecution().toString()


def test_model_hook_isolates_failures(spark, landing):
    def call(system, user):
        if "ORM" in user:
            raise RuntimeError("down")
        return '{"patient_name": {"value": "Z", "confidence": 0.9}}'

    rows = {r.file: r for r in run_phases(ld.source_union(spark, landing), Services(call=call), "orchestration").collect()}
    assert rows["orm.hl7"].extraction_warnings[0] == "extraction_error: down" and rows["orm.hl7"].fallback_source == "rules"
    assert rows["a.json"].fields[0].value == "Z" and rows["weak.json"].call is None


def test_text_model_seed_scores_and_files(spark, tmp_path):
    model = TextModel.seed(spark)
    assert len(model.idf) == 54 and len(model.labels) == 6
    docs = spark.createDataFrame([("PROGRESS NOTE\nAssessment and plan: history of present illness",), ("zzz",)], "t string")
    before = model.score(docs, "t").collect()
    assert before[0].tm_type == "clinical_note" and before[1].tm_type == "unknown"
    model.save(str(tmp_path / "m"))
    assert TextModel.load(str(tmp_path / "m")).score(docs, "t").collect() == before
    with pytest.raises(FileNotFoundError):
        TextModel.load(str(tmp_path / "none"))


def test_stream_equals_batch(spark, landing, tmp_path):
    docs = st.ingested(st.landing_stream(spark, landing))
    st.write_documents(docs, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o")).groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in got} == {"valid": 6, "dlq": 3, "failed": 1}
