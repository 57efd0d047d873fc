"""Runs that start from kept phases, and OCR blocks as a table."""

import json

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from claimflow.operators import normalize as nm
from claimflow.operators.textmodel import TextModel
from claimflow.plans import resume
from claimflow.plans.phases import Services, run_batch
from workload import files, ingest

SF = "/root/testdata/sf0.001"
FHIR = json.dumps({"resourceType": "Bundle", "entry": []})


def ts():
    return F.lit("2024-01-01").cast("timestamp")


@pytest.fixture
def raw(spark):
    hl7 = "MSH|^~\\&|A|B|C|D|2024||ORM^O01|1|P|2.5\nPID|1||M{0}||DOE^ANN||19800102|F\nDG1|1|I|I21.9\n"
    rows = [("hl7v2", f"{i}.hl7", hl7.format(i)) for i in range(20)] + [("fhir_r4", "a.json", FHIR), ("fax", "bad.json", '{"s3')]
    return spark.createDataFrame(rows, "source string, file string, raw string")


def run(spark, raw, out, run_id, until="observability", **services):
    run_batch(spark, raw, out, run_id, Services(**services), until, run_ts=ts(), resume=True)
    stages = {r.stage: r for r in spark.read.json(f"{out}/run_id={run_id}/stages").collect()}
    written = {s for s, r in stages.items() if "ms" in r and r.ms is not None}
    return stages, written, sorted(str(r) for r in spark.read.parquet(f"{out}/records/run_id={run_id}").collect())


ALL = {"ingestion", "classification", "extraction", "orchestration", "agents"}


def test_a_later_run_starts_from_the_newest_phase_that_holds(spark, raw, tmp_path):
    out, other = str(tmp_path / "a"), str(tmp_path / "b")
    _, written, _ = run(spark, raw, out, "r1", "extraction")
    assert written == {"ingestion", "classification", "extraction"}
    stages, written, rows = run(spark, raw, out, "r2")
    assert written == {"orchestration", "agents"}
    assert stages["extraction"].records == 22 and stages["agents"].records == 22
    _, written, whole = run(spark, raw, other, "r1")
    assert written == ALL and rows == whole
    # Nothing is left to do: the report still has its figures.
    _, written, again = run(spark, raw, out, "r3")
    assert written == set() and again == rows
    report = spark.read.json(f"{out}/run_id=r3/report").first()
    assert report.total_records == 22 and report.mean_extraction_confidence > 0


def test_what_changed_runs_again(spark, raw, tmp_path):
    out = str(tmp_path)
    run(spark, raw, out, "r1")
    providers = spark.createDataFrame([("1", "x", "y")], "npi string, name string, specialty string")
    prints = lambda df=raw, **s: resume.phase_fingerprints(df, Services(**s), ts())
    base = prints()
    assert prints(raw.repartition(3)) == base
    assert not set(prints(raw.limit(21)).values()) & set(base.values())
    assert not set(resume.phase_fingerprints(raw, Services(), F.lit("2025-01-01").cast("timestamp")).values()) & set(base.values())
    changed = lambda new: {p for p in base if new[p] != base[p]}
    assert changed(prints(providers=providers)) == {"agents"}
    assert changed(prints(prefer_local=True)) == {"extraction", "orchestration", "agents"}
    assert changed(prints(model=TextModel.seed(spark))) == ALL - {"ingestion"}
    _, written, _ = run(spark, raw.where("file <> '3.hl7'"), out, "r2")
    assert written == ALL


def test_a_phase_without_its_manifest_is_written_again(spark, raw, tmp_path):
    out = str(tmp_path)
    store = resume.PhaseStore(spark, f"{out}/phases", resume.phase_fingerprints(raw, Services(), ts()))
    with pytest.raises(RuntimeError):
        def broken(write):
            write()
            raise RuntimeError("lost before the manifest")
        store.keep("ingestion", raw, broken)
    assert store.newest("agents") is None
    assert run(spark, raw, out, "r1", "classification")[1] == {"ingestion", "classification"}


def test_fingerprints_tell_nulls_rows_and_maps_apart(spark):
    f = lambda rows, kind="a string, b string, m map<string,string>": resume.frame_fingerprint(spark.createDataFrame(rows, kind))
    seen = [f(r) for r in ([], [("x", None, None)], [(None, "x", None)], [("x", None, {})], [("x", None, {"k": "v"})],
                           [("x", None, None)] * 2, [("x", None, None)] * 3)]
    assert len(set(seen)) == len(seen)


def test_block_table_equals_the_array_form(spark):
    line = lambda page, text, conf, kind="LINE": (page, text, conf, kind)
    rows = [("a", [line(2, "z", 90.0), line(None, "y", 40.0), line(1, "x", None), line(2, None, 80.0), line(3, "w", 99.0, "WORD")]),
            ("b", [line(i % 7, f"t{i}", 50.0 + i % 50) for i in range(1000)]), (None, [line(1, "", 100.0)])]
    df = spark.createDataFrame(rows, "document_key string, blocks array<struct<page:int,text:string,confidence:double,block_type:string>>")
    want = {r.document_key: r.ocr for r in nm.assemble_ocr(df).collect()}
    table = df.select("document_key", F.posexplode("blocks").alias("block", "b")).select("document_key", "block", "b.*")
    for lines in (1, 3, 4096):
        got = {r.document_key: r for r in nm.assemble_ocr_table(table.repartition(3), lines=lines).collect()}
        assert set(got) == set(want)
        for k, w in want.items():
            g = got[k]
            assert (g.full_text, g.page_texts, g.page_count, g.mean_confidence) == (w.full_text, w.page_texts, w.page_count, w.mean_confidence)
            assert g.n_low_conf == len(w.low_conf_blocks)
            assert g.first_low_conf == (w.low_conf_blocks[0] if w.low_conf_blocks else None)
    assert nm.weak_ocr_blocks(table).count() == sum(len(w.low_conf_blocks) for w in want.values())
    assert nm.assemble_ocr_table(table.limit(0)).count() == 0


def test_a_long_document_is_assembled_in_runs(spark):
    n = 200_000
    table = spark.range(n).repartition(5).select(
        F.lit("d").alias("document_key"), F.col("id").alias("block"), F.lit(1).alias("page"),
        F.concat(F.lit("line "), F.col("id").cast("string")).alias("text"), F.lit(90.0).alias("confidence"))
    got = nm.assemble_ocr_table(table).first()
    assert got.full_text == "\n".join(f"line {i}" for i in range(n)) and got.mean_confidence == 90.0


@pytest.mark.parametrize("module, name", [(ingest, "assemble_ocr_table"), (files, "resumed_run")])
def test_queries_equal_their_sql(spark, module, name):
    assert compare(module.QUERIES[name](spark, SF), connect(SF), module.ORACLES[name]) == ""
