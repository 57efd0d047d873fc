"""Validation, dead letters and the in-flight filter. All narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import CPT_FORMAT, ICD10_FORMAT, MIN_OCR_CONFIDENCE, MIN_TEXT_LENGTH
from ..functions.fence import settle
from ..functions.fields import gathered
from ..functions.text import fixed_point, quoted, strip_text


def validation_errors() -> Column:
    missing = [
        (F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"Missing required field: {c}"))
        for c in ("full_text", "source_id", "source_type")
    ]
    ocr = F.col("ocr_mean_confidence")
    weak = (ocr < MIN_OCR_CONFIDENCE, F.concat(
        F.lit("OCR confidence "), fixed_point(ocr, 1),
        F.lit(f" below threshold ({MIN_OCR_CONFIDENCE})")))
    short = (
        F.length(strip_text(F.coalesce(F.col("full_text"), F.lit("")))) < MIN_TEXT_LENGTH,
        F.lit("full_text too short — likely empty or corrupt page"))
    return gathered(*missing, weak, short)


def _suspects(codes: str, pattern: str, label: str) -> Column:
    bad = F.filter(F.col(codes), lambda c: ~F.rlike(c, F.lit(pattern)))
    return F.transform(bad, lambda c: F.concat(F.lit(f"Suspect {label} format: "), quoted(c)))


def code_format_warnings() -> Column:
    return F.concat(
        _suspects("diagnosis_codes", ICD10_FORMAT, "ICD-10"),
        _suspects("procedure_codes", CPT_FORMAT, "CPT"),
    )


def validate(docs: DataFrame) -> DataFrame:
    """Add errors, warnings and ``is_valid``; documents that fail become ``dlq``.

    Rows that ingestion already closed (``failed``) keep their disposition and are not judged.
    """
    none = F.array().cast("array<string>")
    closed = F.col("disposition").isNotNull()
    return settle(
        docs.withColumns({
            "validation_errors": F.when(closed, none).otherwise(validation_errors()),
            "validation_warnings": F.when(closed, none).otherwise(code_format_warnings()),
        })
        .withColumn("is_valid", ~closed & (F.size("validation_errors") == 0))
        .withColumn("disposition", F.when(closed, F.col("disposition"))
                    .when(~F.col("is_valid"), F.lit("dlq")))
    )


def error_envelopes(docs: DataFrame) -> DataFrame:
    """Dead letters with their five-key snapshot."""
    return docs.where(F.col("disposition") == "dlq").select(
        "document_id", "source_id", "source_type",
        F.col("validation_errors").alias("errors"),
        F.col("validation_warnings").alias("warnings"),
        F.struct(
            "source_type",
            F.col("ocr_mean_confidence").alias("ocr_confidence"),
            F.length("full_text").alias("text_length"),
            "diagnosis_codes", "procedure_codes",
        ).alias("raw_snapshot"),
    )


def in_flight(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("disposition").isNull())


def dlq_split(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(still in flight, dead-letter envelopes).

    Two filters on one frame: write or read ``docs`` from a table first, so the branches share it.
    """
    return in_flight(docs), error_envelopes(docs)


def data_quality(docs: DataFrame) -> DataFrame:
    """Valid / dead-letter / crashed / with-warnings counts per source.

    Counts are combined before the shuffle, so a source with most of the rows still sends one
    row per task.
    """
    return docs.groupBy("source").agg(
        F.count_if(F.col("is_valid")).alias("valid"),
        F.count_if(F.col("disposition") == "dlq").alias("dlq"),
        F.count_if(F.col("disposition") == "failed").alias("crashed"),
        F.count_if(F.size("validation_warnings") > 0).alias("with_warnings"),
    )
