"""A run's result is parsed and its fields looked up once, not once a mention."""

import json

from claimflow.operators.govern import check_schema, guardrail_flags
from claimflow.operators.infer import result_json
from claimflow.schemas import FIELDS, LIST_FIELDS, SCALAR_FIELDS


def plan(df) -> str:
    conf, key = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    conf.set(key, "1000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        conf.unset(key)


def test_schema_parses_a_text_once_outside_a_transform(spark):
    texts = ['{"k": 1, "kind": null}', ' ```json\n{"kind": 2}\n``` ', "[1]", "12", "prose", "{", "", None]
    df = check_schema(spark.createDataFrame([(t,) for t in texts], "t string"), "t", ["k", "kind"])
    found = {r["t"]: r["schema_failures"] for r in df.collect()}
    lost = ["Missing required key: k", "Missing required key: kind"]
    assert [found[t] for t in texts[:7]] == [[], lost[:1], lost, lost, ["Invalid JSON"], ["Invalid JSON"], ["Invalid JSON"]]
    assert df.columns == ["t", "schema_failures", "schema_ok"]
    assert "transform(" not in plan(df) and plan(df).count("from_json(MapType") == 1


def test_result_json_looks_a_field_up_once(spark):
    fields = [("patient_id", "a", 0.5, "llm"), ("patient_id", "b", 0.5, "llm"), ("procedure_codes", "1", 0.5, "llm")]
    rows = [("d1", fields), ("d2", []), ("d3", None)]
    df = spark.createDataFrame(rows, f"document_id string, fields {FIELDS}").selectExpr(
        "*", "'referral' AS document_type", "timestamp'2024-01-01' AS ingested_at", "0.5D AS mean_confidence", "array() AS low_conf_fields",
        "array() AS extraction_warnings", "true AS npi_validated", "true AS codes_validated")
    done = result_json(df)
    out = {r[0]: json.loads(r[1]) for r in done.select("document_id", "result_json").collect()}
    assert out["d1"]["patient_id"]["value"] == "a" and out["d1"]["payer_id"] is None
    assert [f["value"] for f in out["d1"]["procedure_codes"]] == ["1"] and out["d2"]["procedure_codes"] == []
    assert out["d3"]["patient_id"] is None and out["d3"]["procedure_codes"] is None
    assert plan(done).count("filter(fields") == len(SCALAR_FIELDS + LIST_FIELDS)
    assert guardrail_flags(done).where("schema_ok").count() == 3
