from pyspark.sql import functions as F

from claimflow.functions import fields as fl
from claimflow.operators import decide as dc
from claimflow.operators import enrich as en
from claimflow.operators import evaluate as ev
from claimflow.operators import normalize as nm
from claimflow.operators.lookup import lookup_join
from claimflow.operators.reply import parse_reply
from claimflow.operators.prompts import latest, registered
from claimflow.schemas import FIELDS, OCR_BLOCKS_RAW


def normal(spark, fn, text):
    return fn(spark.createDataFrame([(text,)], "full_text string")).first()


def test_hl7_carriage_returns_and_last_segment(spark):
    r = normal(spark, nm.normalize_hl7, "MSH|^~\\&|A\rPID|1||OLD||X^Y\rPID|1||M1^^^H||DOE^JOHN||19800515\rDG1|1||M54.5^Pain\rIN1|1||BCBS\r")
    assert (r.patient_id, r.patient_name, r.diagnosis_codes, r.procedure_codes, r.payer_id) == (
        "M1^^^H", "DOE^JOHN", ["M54.5^Pain"], [], "BCBS")


def test_edi_first_and_middle_name(spark):
    r = normal(spark, nm.normalize_edi, "ISA*00~\nNM1*QC*1*DOE*JOHN*A***MI*MB1~\nHI*ABK:M545**ABF:I10~\nSV1*HC:99213*1~\nSV1*99214~\nREF*2U*P1~\n")
    assert (r.patient_name, r.patient_id, r.diagnosis_codes, r.procedure_codes, r.payer_id) == (
        "JOHN A", "MB1", ["M545", "I10"], ["99213", "99214"], "P1")


def test_fhir_last_resource_wins(spark):
    r = normal(spark, nm.normalize_fhir, '{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Patient","name":[{"family":"Old"}]}},{"resource":{"resourceType":"Patient","name":[{"family":"New","given":["A","B"]}]}}]}')
    assert (r.patient_name, r.payer_id, r.diagnosis_codes) == ("A B New", "", [])


def test_ocr_pages_in_order_and_defaults(spark):
    blocks = [(2, "c", 80.0, "LINE"), (1, "a", 90.0, "LINE"), (None, "b", None, "LINE"), (1, "x", 1.0, "WORD")]
    df = spark.createDataFrame([(blocks,), ([],)], f"blocks {OCR_BLOCKS_RAW}")
    full, empty = [r.ocr for r in nm.assemble_ocr(df).collect()]
    assert (full.full_text, full.page_count, full.mean_confidence) == ("a\nb\n\nc", 2, 56.67)
    assert [b.text for b in full.low_conf_blocks] == ["c", "b"]
    assert (empty.full_text, empty.page_count, empty.mean_confidence) == ("", 0, 0.0)


def test_reply_shapes(spark):
    cases = {
        '```json\n{"patient_name": {"value": "X", "confidence": 1.5}}\n```': (1, 1.0, 0),
        "": (0, 0.0, 1), "not json!": (0, 0.0, 1), '{"patient_name": null}': (0, 0.0, 0),
        '{"patient_name": "John"}': (1, 0.75, 0), '{"patient_name": {"value": "X", "confidence": 0.3}}': (1, 0.3, 0),
        '{"custom": {"value": 1, "confidence": 0.5}, "diagnosis_codes": ["I10"]}': (1, 0.625, 0),
        '["a"]': (0, 0.0, 1), '{"patient_name": {"value": "X", "confidence": "high"}}': (0, 0.0, 1),
    }
    rows = parse_reply(spark.createDataFrame([(k,) for k in cases], "reply string")).collect()
    assert {r.reply: (len(r.fields), r.mean_confidence, len(r.extraction_warnings)) for r in rows} == cases


def state(spark, kind, mean, values):
    fields = [(n, v, mean, "llm") for n, vs in values.items() for v in (vs if isinstance(vs, list) else [vs])]
    df = spark.createDataFrame([("d", kind, mean, fields)], f"record_id string, document_type string, mean_confidence double, fields {FIELDS}")
    df = df.withColumn("classification", F.struct(F.lit("q").alias("routing_queue")))
    return dc.dispatch(df).first()


FULL = {"patient_name": "J", "member_id": "M", "provider_npi": "1", "payer_id": "P", "diagnosis_codes": ["M54.5"], "procedure_codes": ["22612"]}


def test_prior_auth_gates(spark):
    assert state(spark, "prior_auth", 0.92, {}).disposition == "failed"
    low = state(spark, "prior_auth", 0.5, FULL)
    assert low.disposition == "needs_hitl" and low.agent.hitl_reason == "Extraction confidence 0.50 below gate 0.8"
    good = state(spark, "prior_auth", 0.8, FULL)
    assert good.disposition == "completed" and good.agent.output.action == "submit_prior_auth"
    assert [s.node for s in good.agent.audit_trail] == ["start", "validate_fields", "check_criteria", "auto_route", "complete"]


def test_denial_viability_comes_before_confidence(spark):
    assert state(spark, "denial_eob", 0.1, {}).disposition == "completed"
    assert state(spark, "denial_eob", 0.5, {"denial_reason_codes": ["co-11"]}).disposition == "needs_hitl"
    out = state(spark, "denial_eob", 0.9, {"denial_reason_codes": ["CO-50"]}).agent.output
    assert (out.strategy, out.letter_status) == ("medical_necessity", "draft_generated")


def test_referral_urgency_and_other_types(spark):
    assert state(spark, "referral", 0.59, {"diagnosis_codes": ["M54.5"]}).disposition == "needs_hitl"
    assert state(spark, "referral", 0.6, {"diagnosis_codes": ["i21.9"]}).agent.output.queue == "urgent-referral"
    other = state(spark, "claim_837", 0.9, {})
    assert (other.disposition, other.queue, other.agent) == ("routed_no_agent", "q", None)


def test_ocr_penalty_leaves_denial_codes_out_of_the_mean(spark):
    fields = [("patient_name", "J", 0.9, "llm"), ("denial_reason_codes", "CO-4", 0.1, "llm")]
    df = spark.createDataFrame([(60.0, fields), (85.0, fields), (None, fields)], f"ocr_mean_confidence double, fields {FIELDS}")
    df = df.withColumns({"mean_confidence": F.lit(0.5), "low_conf_fields": F.array(F.lit("z"))})
    rows = en.ocr_penalty(df).collect()
    assert (rows[0].mean_confidence, rows[0].fields[0].confidence, rows[0].low_conf_fields) == (0.8265, 0.8265, [])
    assert [r.mean_confidence for r in rows[1:]] == [0.5, 0.5]


def test_lookup_paths_agree_on_a_hot_key(spark):
    left = spark.range(600).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"))
    ref = spark.createDataFrame([("hot", 1), ("7", 2)], "ref string, v int")
    small = lookup_join(left, ref, "key", "ref", ["id"]).select("id", "v").orderBy("id").collect()
    big = lookup_join(left, ref, "key", "ref", ["id"], rows=1, salts=4).select("id", "v").orderBy("id").collect()
    assert small == big and len(big) == 600


def test_code_reference_paths_agree(spark):
    fields = [("provider_npi", "1234567890", 0.9, "llm"), ("diagnosis_codes", "m54.5", 0.9, "llm"), ("diagnosis_codes", "BAD", 0.9, "llm"), ("procedure_codes", "1", 0.9, "llm")]
    df = spark.createDataFrame([("a", fields), ("b", fields[:2])], f"document_id string, fields {FIELDS}")
    df = df.withColumns({"extraction_warnings": F.array().cast("array<string>"), "record_id": F.col("document_id")})
    icd = spark.createDataFrame([("M54.5",), ("I10",)], "code string")
    out = [en.enrich(df, icd10=icd).orderBy("record_id"), en.enrich_codes(en.enrich_npi(df), icd, literal_rows=1, rows=1).orderBy("record_id")]
    a, b = [[(r.npi_validated, r.codes_validated, r.extraction_warnings) for r in o.collect()] for o in out]
    assert a == b == [(True, False, ["ICD-10 not in reference table: BAD", "CPT not in reference table: 1"]), (True, True, [])]


def test_set_f1(spark):
    df = spark.createDataFrame([("d", True, ["m54.5"], ["M54.5", "I10"]), ("e", True, [], []), ("f", True, [], ["x"]), ("n", False, [], ["None"])],
                               "field_name string, is_list boolean, actual array<string>, expected array<string>")
    assert [round(r.f1, 4) for r in ev.field_f1(df).collect()] == [0.6667, 1.0, 0.0, 1.0]


def test_latest_prompt_is_the_text_maximum(spark):
    df = spark.createDataFrame([("p", "v1.9", 1, "a"), ("p", "v1.10", 2, "b"), ("p", "v1.9", 3, "c")], "name string, version string, n int, system string")
    assert [tuple(r) for r in latest(registered(df, "n")).select("version", "system").collect()] == [("v1.9", "c")]
