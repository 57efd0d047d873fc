"""Raw documents of five formats to one canonical table.

Every step is a projection: the five parsers sit side by side behind a test of ``source``, so one
pass over the raw table normalises all sources and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import LOW_OCR_BLOCK
from ..functions import segments as seg
from ..functions.fence import settle
from ..functions.jsontext import STRICT, is_object
from ..functions.text import blank_to_null, round_half_even, strip, strip_text, text_or_empty
from ..schemas import FAX_JSON, FHIR_JSON, SOURCE_TYPES, WEBHOOK_JSON

def _no_codes() -> Column:
    return F.array().cast("array<string>")


# ---------------------------------------------------------------- OCR blocks

def assemble_ocr(df: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Add ``ocr``: text by page, mean confidence and the weak blocks.

    Blocks are sorted once by page and input position; each page is then one slice, so a document
    costs n log n in its own blocks however many pages it has.
    """
    fields = df.schema[blocks].dataType.elementType.fieldNames()
    line = df[blocks]
    if "block_type" in fields:
        line = F.filter(line, lambda b: b["block_type"] == "LINE")
    ordered = F.sort_array(F.transform(line, lambda b, i: F.struct(
        F.coalesce(b["page"], F.lit(1)).alias("page"), i.alias("ord"),
        text_or_empty(b["text"]).alias("text"),
        F.coalesce(b["confidence"], F.lit(0.0)).alias("conf"),
    )))
    b, starts = F.col("_blocks"), F.col("_starts")
    first = F.transform(b, lambda x, i: F.when(
        (i == 0) | (x["page"] != F.get(b, i - 1)["page"]), i))
    pages = F.transform(starts, lambda s, j: F.array_join(
        F.transform(
            F.slice(b, s + 1, F.coalesce(F.get(starts, j + 1), F.size(b)) - s),
            lambda x: x["text"]),
        "\n"))
    conf = F.transform(F.sort_array(F.transform(b, lambda x: F.struct(x["ord"], x["conf"]))),
                       lambda x: x["conf"])
    sums = F.aggregate(conf, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(F.size(b) > 0, round_half_even(sums / F.size(b), 2)).otherwise(0.0)
    weak = F.transform(
        F.filter(F.sort_array(F.transform(b, lambda x: F.struct(
            x["ord"].alias("ord"), x["text"].alias("text"), x["conf"].alias("conf"),
            x["page"].alias("page")))), lambda x: x["conf"] < LOW_OCR_BLOCK),
        lambda x: F.struct(x["text"].alias("text"), x["conf"].alias("conf"), x["page"].alias("page")))
    return (
        df.withColumn("_blocks", ordered)
        .withColumn("_starts", F.array_compact(first))
        .withColumn("_pages", pages)
        .withColumn("ocr", F.when(F.col(blocks).isNotNull(), F.struct(
            F.array_join("_pages", "\n\n").alias("full_text"),
            F.col("_pages").alias("page_texts"),
            F.size("_pages").alias("page_count"),
            mean.alias("mean_confidence"),
            weak.alias("low_conf_blocks"),
        )))
        .drop("_blocks", "_starts", "_pages")
    )


OCR_LINES = 4096  # lines that are one array at a time


def assemble_ocr_table(blocks: DataFrame, key: str = "document_key", order: str = "block", lines: int = OCR_LINES) -> DataFrame:
    """``assemble_ocr`` for a table with a row a block: one row a document, for documents of any length.

    ``order`` is a block's place in its document, from 0. Lines of a page meet in runs of ``lines``
    places, and a document in its runs' texts, so no array holds all of its lines and one that has most
    rows of the table is assembled by many tasks. Figures are sums folded before they move. In place of
    an array of weak blocks there are their number and the first; ``weak_ocr_blocks`` lists them.
    """
    page = F.coalesce(F.col("page"), F.lit(1)).alias("_page")
    rows = blocks.where(F.col("block_type") == "LINE") if "block_type" in blocks.columns else blocks
    rows = rows.select(F.col(key).alias("_key"), page, F.col(order).cast("bigint").alias("_ord"),
                       text_or_empty(F.col("text")).alias("_text"),
                       F.coalesce(F.col("confidence"), F.lit(0.0)).cast("double").alias("_conf"))
    low = F.col("_conf") < LOW_OCR_BLOCK
    runs = rows.groupBy("_key", "_page", F.floor(F.col("_ord") / lines).alias("_run")).agg(
        F.sort_array(F.collect_list(F.struct("_ord", "_text"))).alias("_lines"), F.count(F.lit(1)).alias("_n"),
        F.sum("_conf").alias("_conf"), F.count_if(low).alias("_low"),
        F.min(F.when(low, F.struct("_ord", F.col("_text").alias("text"), F.col("_conf").alias("conf"), F.col("_page").alias("page")))).alias("_first"))
    texts = runs.withColumn("_text", F.array_join(F.transform("_lines", lambda x: x["_text"]), "\n")).drop("_lines")
    pages = texts.groupBy("_key", "_page").agg(
        F.sort_array(F.collect_list(F.struct("_run", "_text"))).alias("_runs"), F.sum("_n").alias("_n"),
        F.sum("_conf").alias("_conf"), F.sum("_low").alias("_low"), F.min("_first").alias("_first"))
    pages = pages.withColumn("_text", F.array_join(F.transform("_runs", lambda x: x["_text"]), "\n")).drop("_runs")
    whole = pages.groupBy("_key").agg(
        F.sort_array(F.collect_list(F.struct("_page", "_text"))).alias("_pages"),
        F.sum("_n").alias("_n"), F.sum("_conf").alias("_conf"), F.sum("_low").alias("_low"), F.min("_first").alias("_first"))
    texts = F.transform("_pages", lambda x: x["_text"])
    first = F.col("_first")
    return whole.select(
        F.col("_key").alias(key), F.array_join(texts, "\n\n").alias("full_text"), texts.alias("page_texts"),
        F.size("_pages").alias("page_count"), round_half_even(F.col("_conf") / F.col("_n"), 2).alias("mean_confidence"),
        F.col("_low").alias("n_low_conf"),
        F.when(first.isNotNull(), F.struct(first["text"].alias("text"), first["conf"].alias("conf"), first["page"].alias("page"))).alias("first_low_conf"))


def weak_ocr_blocks(blocks: DataFrame) -> DataFrame:
    """The lines below the confidence that a weak block has, a row each."""
    rows = blocks.where(F.col("block_type") == "LINE") if "block_type" in blocks.columns else blocks
    return rows.where(F.coalesce(F.col("confidence"), F.lit(0.0)) < LOW_OCR_BLOCK)


# ---------------------------------------------------------------- parsers

def hl7_columns(segments: Column) -> dict[str, Column]:
    pid, dg1 = seg.hl7_segment(segments, "PID"), seg.hl7_segment(segments, "DG1")
    pr1, in1 = seg.hl7_segment(segments, "PR1"), seg.hl7_segment(segments, "IN1")

    def at(s: Column, i: int) -> Column:
        return strip(seg.field(s, i))

    return {
        "patient_name": at(pid, 5), "patient_dob": at(pid, 7), "patient_id": at(pid, 3),
        "diagnosis_codes": F.array(at(dg1, 3)), "procedure_codes": F.array(at(pr1, 3)),
        "payer_id": at(in1, 3),
    }


def fhir_resource(bundle: Column, kind: str) -> Column:
    """Last resource of the kind, NULL when there is none."""
    resources = F.transform(bundle["entry"], lambda e: e["resource"])
    return F.try_element_at(F.filter(resources, lambda r: r["resourceType"] == kind), F.lit(-1))


def fhir_columns(patient: Column, coverage: Column, claim: Column) -> dict[str, Column]:
    name = F.get(patient["name"], F.lit(0))
    given = F.coalesce(name["given"], _no_codes())
    dx = F.filter(claim["diagnosis"], lambda d: d["diagnosisCodeableConcept"].isNotNull())
    px = F.transform(claim["item"], lambda i: F.coalesce(
        i["productOrService"]["coding"], F.array().cast("array<struct<code:string>>")))
    return {
        "patient_name": F.array_join(
            F.concat(given, F.array(text_or_empty(name["family"]))), " "),
        "patient_dob": text_or_empty(patient["birthDate"]),
        "patient_id": text_or_empty(F.get(patient["identifier"], F.lit(0))["value"]),
        "diagnosis_codes": F.coalesce(
            F.transform(dx, lambda d: F.get(d["diagnosisCodeableConcept"]["coding"], F.lit(0))["code"]),
            _no_codes()),
        "procedure_codes": F.coalesce(
            F.transform(F.flatten(px), lambda c: c["code"]), _no_codes()),
        "payer_id": text_or_empty(F.get(coverage["payor"], F.lit(0))["identifier"]["value"]),
    }


def edi_columns(segments: Column) -> dict[str, Column]:
    patient = seg.edi_first(segments, "NM1", "QC")
    payer = seg.edi_first(segments, "REF", "2U")
    dx = F.flatten(F.transform(seg.edi_all(segments, "HI"), lambda s: F.transform(
        F.filter(F.slice(s, F.lit(2), F.size(s)), lambda e: e != ""),
        lambda e: F.replace(F.replace(e, F.lit("ABK:"), F.lit("")), F.lit("ABF:"), F.lit("")))))
    px = F.transform(
        F.filter(seg.edi_all(segments, "SV1"), lambda s: F.size(s) > 1),
        lambda s: F.coalesce(F.get(F.split(s[1], ":"), F.lit(1)), s[1]))

    def at(s: Column, i: int) -> Column:
        return strip(seg.field(s, i))

    return {
        "patient_name": F.concat_ws(" ", blank_to_null(at(patient, 4)), blank_to_null(at(patient, 5))),
        "patient_dob": F.lit(""), "patient_id": at(patient, 9),
        "diagnosis_codes": dx, "procedure_codes": px, "payer_id": at(payer, 2),
    }


PAYLOAD = [
    "source", "file", "record_id", "source_type", "source_id", "content_type", "raw_metadata",
    "full_text", "page_count", "ocr_mean_confidence", "error",
]
STRUCTURED = [
    "patient_name", "patient_dob", "patient_id", "diagnosis_codes", "procedure_codes", "payer_id",
]


def normalize_hl7(df: DataFrame, text: str = "full_text") -> DataFrame:
    parsed = df.withColumn("_hl7", seg.hl7_segments(strip_text(F.col(text))))
    return settle(_clean(parsed.withColumns(hl7_columns(F.col("_hl7")))).drop("_hl7"))


def normalize_fhir(df: DataFrame, text: str = "full_text") -> DataFrame:
    parsed = df.withColumn("_fhir", F.from_json(text, FHIR_JSON, STRICT)).withColumns({
        "_patient": fhir_resource(F.col("_fhir"), "Patient"),
        "_coverage": fhir_resource(F.col("_fhir"), "Coverage"),
        "_claim": fhir_resource(F.col("_fhir"), "Claim"),
    })
    cols = fhir_columns(F.col("_patient"), F.col("_coverage"), F.col("_claim"))
    return settle(_clean(parsed.withColumns(cols)).drop("_fhir", "_patient", "_coverage", "_claim"))


def normalize_edi(df: DataFrame, text: str = "full_text") -> DataFrame:
    parsed = df.withColumn("_edi", seg.edi_segments(F.col(text)))
    return settle(_clean(parsed.withColumns(edi_columns(F.col("_edi")))).drop("_edi"))


def _clean(df: DataFrame) -> DataFrame:
    return df.withColumns({c: seg.clean_codes(F.col(c)) for c in ("diagnosis_codes", "procedure_codes")})


# ---------------------------------------------------------------- payloads

def payloads(raw: DataFrame, bucket: str = "sim-bucket") -> DataFrame:
    """``(source, file, raw)`` to payload columns; unreadable files get an ``error``, not an exception.

    Other columns of ``raw`` are carried along.
    """
    source = F.col("source")
    carried = [c for c in raw.columns if c not in ("source", "file", "raw")]

    def only(name: str, c: Column) -> Column:
        return F.when(source == name, c)

    parsed = raw.withColumns({
        "_ok": F.when(source.isin("fax", "webhook", "fhir_r4"), is_object(strip_text(F.col("raw")))),
        "_fax": only("fax", F.from_json("raw", FAX_JSON, STRICT)),
        "_web": only("webhook", F.from_json("raw", WEBHOOK_JSON, STRICT)),
    }).withColumn("_lines", F.col("_fax.blocks"))
    parsed = assemble_ocr(parsed, "_lines")

    fax, web = F.col("_fax"), F.col("_web")
    bad_line = F.exists(fax["blocks"], lambda b: b["page"].isNull() | b["text"].isNull()
                        | b["confidence"].isNull())
    bad_fax = (fax["s3_key"].isNull() | fax["content_type"].isNull() | fax["blocks"].isNull()
               | F.coalesce(bad_line, F.lit(False)))
    error = (
        F.when(~F.col("_ok"), F.concat(F.lit("ingestion: unreadable "), source, F.lit(" payload")))
        .when((source == "fax") & bad_fax, F.lit("ingestion: fax without key, type or line blocks"))
        .when((source == "fax") & (F.size(fax["blocks"]) == 0), F.lit("ingestion: fax without pages"))
        .when((source == "webhook") & (web["body"].isNull() | web["headers"].isNull()),
              F.lit("ingestion: webhook without headers or body"))
    )
    content_type = (
        F.when(source == "fax", fax["content_type"])
        .when(source == "hl7v2", "application/hl7-v2")
        .when(source == "fhir_r4", "application/fhir+json")
        .when(source == "edi837", "application/x12")
        .otherwise(F.coalesce(F.try_element_at(web["headers"], F.lit("content-type")),
                              F.lit("application/octet-stream")))
    )
    kind = F.lit("content_type")
    metadata = (
        F.when(source == "fax", F.create_map(
            F.lit("bucket"), F.lit(bucket), F.lit("key"), fax["s3_key"], kind, F.col("content_type")))
        .when(source == "fhir_r4", F.create_map(
            F.lit("resource_type"), F.get_json_object("raw", "$.resourceType"),
            kind, F.col("content_type")))
        .when(source == "webhook", F.create_map(
            F.lit("headers"), F.to_json(web["headers"]), kind, F.col("content_type")))
        .otherwise(F.create_map(kind, F.col("content_type")))
    )
    source_type = F.lit(None).cast("string")
    for name, stype in SOURCE_TYPES.items():
        source_type = F.when(source == name, F.lit(stype)).otherwise(source_type)
    return settle(
        parsed.withColumn("content_type", content_type)
        .select(
            "source", "file",
            F.concat_ws("/", "source", "file").alias("record_id"),
            source_type.alias("source_type"),
            F.coalesce(F.when(source == "fax", fax["s3_key"]), F.col("file")).alias("source_id"),
            "content_type", metadata.alias("raw_metadata"),
            text_or_empty(F.when(source == "fax", F.col("ocr.full_text"))
                          .when(source == "webhook", web["body"])
                          .otherwise(F.col("raw"))).alias("full_text"),
            F.when(source == "fax", F.col("ocr.page_count")).otherwise(F.lit(1)).alias("page_count"),
            F.when(source == "fax", F.col("ocr.mean_confidence")).alias("ocr_mean_confidence"),
            error.alias("error"),
            *carried,
        )
    )


# ---------------------------------------------------------------- canonical table

def document_key() -> Column:
    """Content key: the same file always gets the same id, also when a task is run again."""
    return F.sha2(F.concat_ws("\u001f", "source_type", "source_id", "full_text"), 256)


def to_canonical(payload: DataFrame, run_ts: Column | None = None) -> DataFrame:
    """Payload rows to canonical documents; fax and webhook rows carry no structured fields."""
    source, text = F.col("source"), F.col("full_text")
    carried = [c for c in payload.columns if c not in PAYLOAD]
    ok = F.col("error").isNull()
    parsed = payload.withColumns({
        "_hl7": F.when(ok & (source == "hl7v2"), seg.hl7_segments(strip_text(text))),
        "_edi": F.when(ok & (source == "edi837"), seg.edi_segments(text)),
        "_fhir": F.when(ok & (source == "fhir_r4"), F.from_json("full_text", FHIR_JSON, STRICT)),
    }).withColumns({
        "_patient": fhir_resource(F.col("_fhir"), "Patient"),
        "_coverage": fhir_resource(F.col("_fhir"), "Coverage"),
        "_claim": fhir_resource(F.col("_fhir"), "Claim"),
    })
    by_source = {
        "hl7v2": hl7_columns(F.col("_hl7")),
        "edi837": edi_columns(F.col("_edi")),
        "fhir_r4": fhir_columns(F.col("_patient"), F.col("_coverage"), F.col("_claim")),
    }
    structured = {}
    for name in STRUCTURED:
        codes = name.endswith("codes")
        value = _no_codes() if codes else F.lit("")
        for src, cols in by_source.items():
            value = F.when(source == src, cols[name]).otherwise(value)
        structured[name] = F.coalesce(value, _no_codes() if codes else F.lit(""))
    bad_fhir = F.exists(F.col("_fhir.entry"), lambda e: e["resource"].isNotNull()
                        & e["resource"]["resourceType"].isNull())
    no_code = (F.exists(F.col("_claim.diagnosis"), lambda d: d["diagnosisCodeableConcept"].isNotNull()
                        & F.get(d["diagnosisCodeableConcept"]["coding"], F.lit(0))["code"].isNull())
               | F.exists(F.col("_claim.item"), lambda i: F.coalesce(F.exists(
                   i["productOrService"]["coding"], lambda c: c["code"].isNull()), F.lit(False))))
    error = F.coalesce(F.col("error"), F.when(
        F.coalesce(bad_fhir, F.lit(False)) | F.coalesce(no_code, F.lit(False)),
        F.lit("ingestion: bundle with an untyped resource or an uncoded entry")))
    when = run_ts if run_ts is not None else F.current_timestamp()
    return settle(_clean(
        parsed.withColumns(structured).withColumn("error", error).select(
            document_key().alias("document_id"), "record_id", "source", "file", "source_id",
            "source_type", F.lit("unknown").alias("document_type"), when.alias("ingested_at"),
            "full_text", "page_count", "ocr_mean_confidence", *STRUCTURED, "raw_metadata",
            F.when(F.col("error").isNull(), F.array().cast("array<string>"))
            .otherwise(F.array("error")).alias("errors"),
            F.when(F.col("error").isNotNull(), F.lit("failed")).alias("disposition"),
            *carried,
        )
    ))


def normalize(raw: DataFrame, run_ts: Column | None = None, bucket: str = "sim-bucket") -> DataFrame:
    """Raw table to canonical documents."""
    return to_canonical(payloads(raw, bucket), run_ts)
