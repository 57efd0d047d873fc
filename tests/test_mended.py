"""Whole texts, one model call a document, NULL codes, repeated keys and unsupported gold rows."""

import json

from pyspark.sql import functions as F

from claimflow.operators.enrich import enrich_codes
from claimflow.operators.evaluate import eval_exact
from claimflow.operators.extract import extract_builtin
from claimflow.operators.infer import extract
from claimflow.operators.reply import parse_reply


def bundle(filler):
    return json.dumps({"resourceType": "Bundle", "entry": [
        {"resource": {"resourceType": "Basic", "note": "x" * filler}},
        {"resource": {"resourceType": "Patient", "name": [{"family": "Doe", "given": ["Jane"]}], "birthDate": "1980-01-02"}}]})


def test_long_documents_are_read_whole(spark):
    texts = [bundle(10), bundle(9000), "MSH|^~\\&|A\r" + "NTE|" + "y" * 9000 + "\rPID|1||77||Doe^Jane||19800102"]
    df = spark.createDataFrame([(t,) for t in texts], "safe_text string")
    names = [sorted(f["field_name"] for f in r["fields"]) for r in extract_builtin(df).collect()]
    assert names[0] == names[1] and "patient_name" in names[0]
    assert "patient_name" in names[2]


def coded(spark):
    field = F.array(*[F.struct(F.lit("diagnosis_codes").alias("field_name"), F.lit(c).alias("value"),
                               F.lit(0.9).alias("confidence"), F.lit("llm").alias("source")) for c in ("A00", "Q99")])
    return spark.range(3).select(F.col("id").cast("string").alias("document_id"),
                                 field.alias("fields"),
                                 F.array().cast("array<string>").alias("extraction_warnings"))


def test_null_codes_check_alike_on_both_paths(spark):
    table = spark.createDataFrame([("A00",), (None,)], "code string")
    got = [sorted((r["codes_validated"], tuple(r["extraction_warnings"])) for r in
                  enrich_codes(coded(spark), icd10=table, literal_rows=n).collect()) for n in (2000, 0)]
    assert got[0] == got[1] and all(not ok and len(w) == 1 for ok, w in got[0])


def test_the_model_is_asked_once(spark, tmp_path):
    log = tmp_path / "calls"

    def call(system, user, log=str(log)):
        with open(log, "a") as f:
            f.write("x")
        return '{"patient_name": "Jane", "diagnosis_codes": ["A00"], "procedure_codes": ["99213"]}'

    docs = spark.range(12).select(
        F.col("id").cast("string").alias("document_id"), F.concat(F.lit("text "), "id").alias("full_text"),
        F.lit("claim_837").alias("document_type"), F.lit(None).cast("double").alias("ocr_mean_confidence"))
    docs = docs.withColumns({"page_count": F.lit(1), "word_count": F.lit(2).cast("bigint")})
    table = spark.range(2500).select(F.col("id").cast("string").alias("code"))
    out = extract(docs, call, icd10=table, cpt=table)
    assert out.count() == 12 and len(out.select("fields", "codes_validated").collect()) == 12
    assert len(log.read_text()) == 12


def test_the_last_of_repeated_keys_counts(spark):
    df = spark.createDataFrame([('{"patient_name": "A", "payer_id": "P", "patient_name": "B"}',)], "reply string")
    r = parse_reply(df).first()
    assert sorted((f["field_name"], f["value"]) for f in r["fields"]) == [("patient_name", "B"), ("payer_id", "P")]


def test_unsupported_gold_rows_count(spark):
    gold = spark.createDataFrame(
        [("fhir_r4", bundle(1), {"patient_name": "Jane Doe"}), ("fax", "x", {"patient_name": "Q"})],
        "source_type string, input string, expected map<string,string>")
    assert eval_exact(gold).first()["total"] == 2
