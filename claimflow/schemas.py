"""Column schemas and enumerated values shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCES = ["fax", "hl7v2", "fhir_r4", "edi837", "webhook"]

SOURCE_TYPES = {
    "fax": "fax_s3",
    "hl7v2": "hl7_v2",
    "fhir_r4": "fhir_r4",
    "edi837": "edi_837",
    "webhook": "webhook",
}

DOCUMENT_TYPES = [
    "referral", "prior_auth", "denial_eob", "claim_837", "clinical_note", "eligibility", "unknown",
]

DISPOSITIONS = ["completed", "needs_hitl", "human_review", "dlq", "routed_no_agent", "failed"]

# Declaration order of the scalar and list fields of one extraction.
SCALAR_FIELDS = [
    "patient_name", "patient_dob", "patient_id", "member_id", "provider_name", "provider_npi",
    "service_date", "place_of_service", "payer_id", "payer_name", "claim_number", "total_charge",
    "denial_date", "appeal_deadline", "auth_number", "auth_status",
]
LIST_FIELDS = ["diagnosis_codes", "procedure_codes", "denial_reason_codes"]

PHASES = [
    "ingestion", "classification", "extraction", "orchestration", "agents", "observability",
]

RAW_FILES = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("raw", T.StringType()),
])

OCR_BLOCKS = "array<struct<page:int,text:string,confidence:double>>"
OCR_BLOCKS_RAW = "array<struct<page:int,text:string,confidence:double,block_type:string>>"

FAX_JSON = (
    f"s3_key string, content_type string, intended_type string, defect string, blocks {OCR_BLOCKS}"
)
WEBHOOK_JSON = "headers map<string,string>, body string"

FHIR_JSON = (
    "resourceType string, entry array<struct<resource:struct<"
    "resourceType:string, birthDate:string,"
    "name:array<struct<family:string,given:array<string>>>,"
    "identifier:array<struct<value:string>>,"
    "payor:array<struct<display:string,identifier:struct<value:string>>>,"
    "diagnosis:array<struct<diagnosisCodeableConcept:struct<coding:array<struct<code:string>>>>>,"
    "item:array<struct<productOrService:struct<coding:array<struct<code:string>>>>>,"
    "total:struct<value:string,currency:string>>>>"
)

EVENT_JSON = (
    "event string, patient struct<name:string,dob:string,mrn:string>,"
    "payer struct<id:string,name:string>, diagnosis_codes array<string>,"
    "procedure_codes array<string>, provider_npi string, claim_number string,"
    "auth_number string, denial struct<reason_code:string,appeal_by:string>"
)

FIELD = "struct<field_name:string,value:string,confidence:double,source:string>"
FIELDS = f"array<{FIELD}>"

GOLD = "doc_id string, expected_type string, text string, expected map<string,string>"
EXACT_GOLD = "source_type string, input string, expected map<string,string>"

PROMPT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("document_type", T.StringType()),
    T.StructField("system", T.StringType()),
    T.StructField("user_template", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("max_tokens", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()),
])

MODEL_CALL = (
    "call_id string, document_id string, model string, prompt_name string, prompt_version string,"
    "input_tokens bigint, output_tokens bigint, latency_ms double, cost_usd double,"
    "success boolean, error string, called_at timestamp"
)
