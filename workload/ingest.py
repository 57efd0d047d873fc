"""Queries over sources, normalisation and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimflow.functions.segments import clean_codes
from claimflow.operators import normalize as nm
from claimflow.operators import validate as vl
from claimflow.sources.landing import spread

from . import sql as S
from .corpus import raw_files, table
from .stages import ingested


def flat(c: str):
    return F.array_join(c, "|").alias(c)


def pay(spark: SparkSession, sf: str, *sources: str) -> DataFrame:
    raw = raw_files(spark, sf)
    return nm.payloads(raw.where(F.col("source").isin(list(sources))) if sources else raw)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return nm.normalize(raw_files(spark, sf), F.lit("2024-01-01 00:00:00").cast("timestamp"))


def valid(spark: SparkSession, sf: str) -> DataFrame:
    return vl.validate(docs(spark, sf))


# ---------------------------------------------------------------- scans of raw file texts

def scan_fax(spark, sf):
    return pay(spark, sf, "fax").select(
        "file", "source_id", "content_type", F.element_at("raw_metadata", "key").alias("object_key"),
        F.col("page_count").cast("bigint").alias("page_count"), "ocr_mean_confidence",
        F.length("full_text").cast("bigint").alias("text_length"), "error")


def scan_hl7(spark, sf):
    return pay(spark, sf, "hl7v2").select(
        "file", "source_id", "content_type", F.md5("full_text").alias("text_md5"))


def scan_fhir(spark, sf):
    return pay(spark, sf, "fhir_r4").select(
        "file", "content_type", F.coalesce(F.try_element_at("raw_metadata", F.lit("resource_type")), F.lit("")).alias("resource_type"),
        F.md5("full_text").alias("text_md5"), "error")


def scan_edi(spark, sf):
    return pay(spark, sf, "edi837").select(
        "file", "source_id", "content_type", F.md5("full_text").alias("text_md5"))


def scan_webhook(spark, sf):
    return pay(spark, sf, "webhook").select(
        "file", "content_type", F.get_json_object(F.element_at("raw_metadata", "headers"), "$.x-source-system").alias("system"),
        F.md5("full_text").alias("body_md5"))


def source_union(spark, sf):
    """Only three sources, as ``--source`` would ask for; the filter sits below the parsing."""
    return pay(spark, sf, "fax", "edi837", "webhook").select("record_id", "source_type", "source_id")


def source_union_all(spark, sf):
    """All five sources in one list (SR-6)."""
    return pay(spark, sf).select("record_id", "source_type", "source_id")


def bad_record_isolation(spark, sf):
    d = docs(spark, sf)
    return d.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("disposition") == "failed").alias("n_failed"),
        F.coalesce(F.max(F.get("errors", F.lit(0))), F.lit("")).alias("last_error"))


# ---------------------------------------------------------------- normalisers

def _normal(df):
    return df.select("file", "patient_name", "patient_dob", "patient_id", flat("diagnosis_codes"),
                     flat("procedure_codes"), "payer_id")


def normalize_hl7(spark, sf):
    return _normal(nm.normalize_hl7(pay(spark, sf, "hl7v2")))


def normalize_fhir(spark, sf):
    return _normal(nm.normalize_fhir(pay(spark, sf, "fhir_r4").where(F.col("error").isNull())))


def normalize_edi(spark, sf):
    return _normal(nm.normalize_edi(pay(spark, sf, "edi837")))


def document_blocks(spark, sf) -> DataFrame:
    """Every document's lines as OCR blocks, out of page order: whole texts, one row per document."""
    lines = F.split("text", "\n")
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.transform(
        lines, lambda t, i: F.struct(
            F.when(i % 4 == 3, F.lit(1)).otherwise(((i * 7) % 5 + 2)).cast("int").alias("page"),
            t.alias("text"), (F.lit(60.0) + (F.length(t) % 40)).alias("confidence"),
            F.when(i % 6 == 5, F.lit("WORD")).otherwise(F.lit("LINE")).alias("block_type"))).alias("blocks"))


def assemble_ocr(spark, sf):
    o = F.col("ocr")
    return nm.assemble_ocr(document_blocks(spark, sf)).select(
        "doc_id", F.md5(o["full_text"]).alias("text_md5"), o["page_count"].cast("bigint").alias("page_count"),
        o["mean_confidence"].alias("mean_confidence"), F.size(o["low_conf_blocks"]).cast("bigint").alias("n_low"),
        F.coalesce(F.get(o["low_conf_blocks"], F.lit(0))["conf"], F.lit(-1.0)).alias("first_low"))


def assemble_ocr_table(spark, sf):
    """The same blocks as a table with a row each, as an OCR service's output lands."""
    rows = document_blocks(spark, sf).select("doc_id", F.posexplode("blocks").alias("block", "b")).select("doc_id", "block", "b.*")
    return nm.assemble_ocr_table(rows, "doc_id").select(
        "doc_id", F.md5("full_text").alias("text_md5"), F.col("page_count").cast("bigint").alias("page_count"),
        "mean_confidence", F.col("n_low_conf").alias("n_low"),
        F.coalesce(F.col("first_low_conf")["conf"], F.lit(-1.0)).alias("first_low"))


ASSEMBLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, list_transform(string_split(text, chr(10)), lambda t, i: {{
      'page': CASE WHEN (i - 1) % 4 = 3 THEN 1 ELSE ((i - 1) * 7) % 5 + 2 END, 'text': t,
      'conf': 60.0::DOUBLE + len(t) % 40, 'kind': CASE WHEN (i - 1) % 6 = 5 THEN 'WORD' ELSE 'LINE' END}}) AS raw
  FROM documents
), kept AS (SELECT doc_id, list_filter(raw, lambda b: b.kind = 'LINE') AS b FROM lines),
paged AS (
  SELECT *, list_transform(list_sort(list_distinct(list_transform(b, lambda x: x.page))), lambda p:
    array_to_string(list_transform(list_filter(b, lambda x: x.page = p), lambda x: x.text), chr(10))) AS pages,
    list_filter(b, lambda x: x.conf < 85.0) AS low
  FROM kept)
SELECT doc_id, md5(coalesce(array_to_string(pages, concat(chr(10), chr(10))), '')) AS text_md5, len(pages) AS page_count,
  CASE WHEN len(b) > 0 THEN {S.half_even("list_sum(list_transform(b, lambda x: x.conf)) / len(b)", 2)} ELSE 0.0 END AS mean_confidence,
  len(low) AS n_low, coalesce(low[1].conf, -1.0) AS first_low
FROM paged"""


def to_canonical(spark, sf):
    return docs(spark, sf).select(
        "file", "source_type", "source_id", "patient_name", "patient_dob", "patient_id",
        flat("diagnosis_codes"), flat("procedure_codes"), "payer_id",
        F.col("page_count").cast("bigint").alias("page_count"), "ocr_mean_confidence",
        F.coalesce(F.element_at("raw_metadata", "content_type"), F.lit("")).alias("content_type"),
        F.coalesce("disposition", F.lit("")).alias("disposition"))


def document_key(spark, sf):
    return docs(spark, sf).select("file", "document_id")


def dedup_codes(spark, sf):
    """Every word of every document as a code list with repeats and padding."""
    words = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("codes"))
    cleaned = spread(words).withColumn("codes", clean_codes(F.col("codes")))
    return cleaned.select("doc_id", F.size("codes").cast("bigint").alias("n_codes"),
                          F.md5(F.array_join("codes", "|")).alias("codes_md5"))


DEDUP_SQL = f"""
WITH words AS (SELECT doc_id, i, w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)),
firsts AS (SELECT doc_id, trim(w, {S.WS}) AS w, min(i) AS i FROM words GROUP BY doc_id, trim(w, {S.WS})),
lists AS (SELECT doc_id, list(w ORDER BY i) AS codes FROM firsts WHERE w <> '' GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(codes), 0) AS n_codes, md5(coalesce(array_to_string(codes, '|'), '')) AS codes_md5
FROM documents d LEFT JOIN lists USING (doc_id)"""


# ---------------------------------------------------------------- validation

def validate(spark, sf):
    return valid(spark, sf).select(
        "file", flat("validation_errors"), flat("validation_warnings"), "is_valid",
        F.coalesce("disposition", F.lit("")).alias("disposition"))


def code_format_warnings(spark, sf):
    return ingested(spark, sf).select(F.explode("validation_warnings").alias("warning")).groupBy("warning").agg(
        F.count(F.lit(1)).alias("n"))


def dlq_split(spark, sf):
    _, dead = vl.dlq_split(ingested(spark, sf))
    s = F.col("raw_snapshot")
    return dead.select(
        "source_id", "source_type", flat("errors"), flat("warnings"), s["ocr_confidence"].alias("ocr_confidence"),
        s["text_length"].cast("bigint").alias("text_length"),
        F.array_join(s["diagnosis_codes"], "|").alias("diagnosis_codes"))


def in_flight(spark, sf):
    return vl.in_flight(ingested(spark, sf)).select("file", "document_id", F.length("full_text").cast("bigint").alias("text_length"))


def data_quality_rollup(spark, sf):
    return vl.data_quality(valid(spark, sf))


DUCK_NORMAL = ("SELECT file, patient_name, patient_dob, patient_id, array_to_string(dx, '|') AS diagnosis_codes, "
               "array_to_string(px, '|') AS procedure_codes, payer_id FROM docs WHERE source = '{s}' AND error IS NULL")

QUERIES = {f.__name__: f for f in (
    scan_fax, scan_hl7, scan_fhir, scan_edi, scan_webhook, source_union, source_union_all, bad_record_isolation,
    normalize_hl7, normalize_fhir, normalize_edi, assemble_ocr, assemble_ocr_table, to_canonical, document_key,
    dedup_codes, validate, code_format_warnings, dlq_split, in_flight, data_quality_rollup)}

ORACLES = {
    "scan_fax": S.query(S.PAYLOAD, """SELECT file, source_id, content_type, CASE WHEN ok THEN source_id END AS object_key,
        CASE WHEN ok THEN page_count END AS page_count, ocr AS ocr_mean_confidence, len(full_text) AS text_length, error
        FROM payload WHERE source = 'fax'"""),
    "scan_hl7": S.query(S.PAYLOAD, "SELECT file, source_id, content_type, md5(full_text) AS text_md5 FROM payload WHERE source = 'hl7v2'"),
    "scan_fhir": S.query(S.PAYLOAD, """SELECT file, content_type, CASE WHEN ok THEN json_extract_string(raw, '$.resourceType') ELSE '' END AS resource_type,
        md5(full_text) AS text_md5, error FROM payload WHERE source = 'fhir_r4'"""),
    "scan_edi": S.query(S.PAYLOAD, "SELECT file, source_id, content_type, md5(full_text) AS text_md5 FROM payload WHERE source = 'edi837'"),
    "scan_webhook": S.query(S.PAYLOAD, """SELECT file, content_type, json_extract_string(raw, '$.headers."x-source-system"') AS system,
        md5(full_text) AS body_md5 FROM payload WHERE source = 'webhook'"""),
    "source_union": S.query(S.PAYLOAD, "SELECT concat(source, '/', file) AS record_id, source_type, source_id FROM payload WHERE source IN ('fax', 'edi837', 'webhook')"),
    "source_union_all": S.query(S.PAYLOAD, "SELECT concat(source, '/', file) AS record_id, source_type, source_id FROM payload"),
    "bad_record_isolation": S.query(S.DOCS, """SELECT source, count(*) AS n_records, count(error) AS n_failed, coalesce(max(error), '') AS last_error
        FROM docs GROUP BY source"""),
    "normalize_hl7": S.query(S.DOCS, DUCK_NORMAL.format(s="hl7v2")),
    "normalize_fhir": S.query(S.DOCS, DUCK_NORMAL.format(s="fhir_r4")),
    "normalize_edi": S.query(S.DOCS, DUCK_NORMAL.format(s="edi837")),
    "assemble_ocr": ASSEMBLE_SQL,
    "assemble_ocr_table": ASSEMBLE_SQL,
    "to_canonical": S.query(S.DOCS, """SELECT file, source_type, source_id, patient_name, patient_dob, patient_id,
        array_to_string(dx, '|') AS diagnosis_codes, array_to_string(px, '|') AS procedure_codes, payer_id,
        CASE WHEN source <> 'fax' OR ocr IS NOT NULL THEN page_count END AS page_count,
        ocr AS ocr_mean_confidence, coalesce(content_type, '') AS content_type, CASE WHEN error IS NOT NULL THEN 'failed' ELSE '' END AS disposition FROM docs"""),
    "document_key": S.query(S.DOCS, "SELECT file, document_id FROM docs"),
    "dedup_codes": DEDUP_SQL,
    "validate": S.query(S.VALID, """SELECT file, array_to_string(v_errors, '|') AS validation_errors, array_to_string(v_warnings, '|') AS validation_warnings,
        closed IS NULL AS is_valid, coalesce(closed, '') AS disposition FROM valid"""),
    "code_format_warnings": S.query(S.VALID, "SELECT warning, count(*) AS n FROM (SELECT unnest(v_warnings) AS warning FROM valid) GROUP BY warning"),
    "dlq_split": S.query(S.VALID, """SELECT source_id, source_type, array_to_string(v_errors, '|') AS errors, array_to_string(v_warnings, '|') AS warnings,
        ocr AS ocr_confidence, len(full_text) AS text_length, array_to_string(dx, '|') AS diagnosis_codes FROM valid WHERE closed = 'dlq'"""),
    "in_flight": S.query(S.VALID, "SELECT file, document_id, len(full_text) AS text_length FROM valid WHERE closed IS NULL"),
    "data_quality_rollup": S.query(S.VALID, """SELECT source, count(*) FILTER (closed IS NULL) AS valid, count(*) FILTER (closed = 'dlq') AS dlq,
        count(*) FILTER (closed = 'failed') AS crashed, count(*) FILTER (len(v_warnings) > 0) AS with_warnings FROM valid GROUP BY source"""),
}
