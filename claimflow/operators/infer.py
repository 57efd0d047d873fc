"""The extraction phase: redact, route, extract (built in or by a model), enrich, penalise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import LOW_FIELD, MAX_PROMPT_CHARS, PROMPT_BODIES, PROMPT_VERSION
from ..functions import fields as fl
from ..functions.text import round_half_even, tokens, word_count
from ..schemas import LIST_FIELDS, SCALAR_FIELDS
from ..session import written
from .enrich import enrich, ocr_penalty, score_completeness
from .extract import extract_builtin
from .govern import redact_pii, route_model
from .inference import CallLimits, call_model
from .lookup import BROADCAST_ROWS
from .meter import cost, price
from .prompts import system_prompt, system_prompt_for, user_message
from .reply import parse_reply


def batch_inference(df: DataFrame, call: Callable[[str, str], str] | None = None,
                    text: str = "safe_text", prompt_chars: int = MAX_PROMPT_CHARS,
                    limits: CallLimits = CallLimits()) -> DataFrame:
    """Add the extraction columns and ``reply_call`` (tokens, latency, success, error, attempts).

    A prompt carries the first ``prompt_chars`` characters. Without ``call`` the built-in extractor
    answers, which reads the whole text; its token counts are those of the prompt a model would get.
    """
    user = user_message(F.col(text), prompt_chars)
    if call is None:
        return _builtin(df, text, user)
    system = system_prompt_for(F.col("document_type"))
    # The call runs once per row: its struct is a column of its own before anything reads it.
    df = df.withColumns({"_system": system, "_user": user})
    df = df.withColumn("_call", call_model(call, limits)(F.col("_system"), F.col("_user")))
    failed = F.col("_call.error").isNotNull()
    df = parse_reply(df.withColumn("_reply", F.when(~failed, F.col("_call.reply")).otherwise("{}")), "_reply")
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<string>")
    return df.withColumns({
        "extraction_error": F.when(failed, F.col("_call.error")).otherwise(F.col("extraction_error")),
        "extraction_warnings": F.when(failed, F.array(F.concat(F.lit("extraction_error: "), "_call.error")))
        .otherwise(F.coalesce("extraction_warnings", none)),
        "reply_call": F.struct(
            F.when(failed, zero).otherwise(
                tokens(word_count(F.concat("_system", "_user")))).alias("input_tokens"),
            F.when(failed, zero).otherwise(tokens(word_count(F.col("_reply")))).alias("output_tokens"),
            F.col("_call.latency_ms").alias("latency_ms"), F.col("_call.success").alias("success"),
            F.col("_call.error").alias("error"), F.col("_call.attempts").alias("attempts")),
    }).drop("_system", "_user", "_call", "_reply")


def _system_words(document_type: Column) -> Column:
    out = F.lit(len(system_prompt("unknown").split()))
    for kind in PROMPT_BODIES:
        out = F.when(document_type == kind, F.lit(len(system_prompt(kind).split()))).otherwise(out)
    return out


def _builtin(df: DataFrame, text: str, user: Column) -> DataFrame:
    df = extract_builtin(df, text)
    words = _system_words(F.col("document_type")) + word_count(user)
    failed = F.col("extraction_error").isNotNull()
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<string>")
    return df.withColumns({
        "fields": F.when(failed, fl.none()).otherwise(F.col("fields")),
        "extraction_warnings": F.when(failed, F.array(F.concat(
            F.lit("extraction_error: "), "extraction_error"))).otherwise(none),
        "reply_call": F.struct(
            F.when(failed, zero).otherwise(tokens(words)).alias("input_tokens"),
            F.when(failed, zero).otherwise(tokens(F.col("reply_words"))).alias("output_tokens"),
            F.lit(0.0).alias("latency_ms"), (~failed).alias("success"),
            F.col("extraction_error").alias("error"),
            F.array(F.struct(F.lit(0).alias("attempt"), F.lit(0.0).alias("latency_ms"), (~failed).alias("success"),
                             F.col("extraction_error").alias("error"))).alias("attempts")),
    }).withColumns({
        "mean_confidence": round_half_even(fl.mean_confidence(F.col("fields")), 4),
        "low_conf_fields": fl.low_names(F.col("fields"), LOW_FIELD),
    }).drop("reply_words")


def extract(df: DataFrame, call: Callable[[str, str], str] | None = None,
            registry: DataFrame | None = None, icd10: DataFrame | None = None,
            cpt: DataFrame | None = None, prefer_local: bool = False,
            prompt_chars: int = MAX_PROMPT_CHARS, broadcast_rows: int = BROADCAST_ROWS,
            limits: CallLimits = CallLimits()) -> DataFrame:
    """The whole phase on in-flight documents. Personal data is replaced before any model sees it."""
    df = route_model(redact_pii(df), prefer_local=prefer_local)
    df = df.withColumns({
        "prompt_name": F.concat(F.lit("extraction-"), "document_type"),
        "prompt_version": F.lit(PROMPT_VERSION),
    })
    df = batch_inference(df, call, prompt_chars=prompt_chars, limits=limits)
    asked = call is not None and any(t is not None for t in (registry, icd10, cpt))
    if asked:
        # Lookups read the frame more than once; the model is asked once.
        df = written(df, "replies")
    df = enrich(df, registry, icd10, cpt, is_table=asked, rows=broadcast_rows)
    df = score_completeness(ocr_penalty(df))
    r = F.col("reply_call")
    return df.withColumn("call", F.struct(
        F.col("model"), F.col("prompt_name"), F.col("prompt_version"),
        r["input_tokens"].alias("input_tokens"), r["output_tokens"].alias("output_tokens"),
        r["latency_ms"].alias("latency_ms"),
        cost(r["input_tokens"], r["output_tokens"], price(F.col("model"))).alias("cost_usd"),
        r["success"].alias("success"), r["error"].alias("error"), r["attempts"].alias("attempts"),
    )).drop("reply_call", "extraction_error", "safe_text", "max_tokens", "cost_per_1k",
            "prompt_name", "prompt_version")


def result_json(df: DataFrame, extracted_at: Column | None = None) -> DataFrame:
    """Add ``result_json``: the whole extraction as one JSON text, absent fields as null."""
    def shaped(f: Column) -> Column:
        return F.when(f.isNotNull(), F.struct(
            f["field_name"].alias("field_name"), f["value"].alias("value"),
            f["confidence"].alias("confidence"), f["source"].alias("source"),
            F.lit(None).cast("int").alias("page_ref"),
            F.lit(None).cast("array<int>").alias("char_span")))

    def column(name: str) -> Column:
        found = F.transform(fl.named(F.col("fields"), name), shaped)
        return found if name in LIST_FIELDS else F.try_element_at(found, F.lit(1))

    when = extracted_at if extracted_at is not None else F.col("ingested_at")
    cols = [column(n).alias(n) for n in SCALAR_FIELDS + LIST_FIELDS]
    return df.withColumn("result_json", F.to_json(F.struct(
        "document_id", "document_type", when.alias("extracted_at"), *cols, "mean_confidence",
        "low_conf_fields", "extraction_warnings", "npi_validated", "codes_validated",
    ), {"ignoreNullFields": "false"}))
