"""Redaction, model routing, guardrails and the fallback chain. All narrow."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (
    MAX_OUTPUT, MIN_OUTPUT, MODELS, PII, PREMIUM_ABOVE, REQUIRED_KEYS, REVIEW_THRESHOLD,
    RULES_CONFIDENCE, SHORT_UP_TO, STANDARD_TASKS,
)
from ..functions import fields as fl
from ..functions.jsontext import is_json, object_map, without_fences
from ..functions.text import let, strip_text, text_or_empty
from .classify import choose

FALLBACK_ERROR = "orchestration: extraction unusable after fallback — sent to human review"
REPLACED = ["patient_name", "patient_dob", "patient_id", "payer_id", "diagnosis_codes", "procedure_codes"]


# ---------------------------------------------------------------- redaction

def redact(text: Column) -> Column:
    """Every pattern's matches replaced, one after the other.

    A text is rewritten only if it holds what every match does: the pattern without its word
    boundaries, which are looked at in every place of a text and cost most of the search.
    """
    for label, pattern in PII:
        inner = pattern.replace(r"\b", "")
        literal = next((x for x in "@-" if x in re.sub(r"\[[^]]*\]\??", "", inner)), "")

        def one(t: Column) -> Column:
            found = F.contains(t, F.lit(literal)) & F.rlike(t, F.lit("(?U)" + inner))
            return F.when(found, F.regexp_replace(t, "(?U)" + pattern, f"[{label}-REDACTED]")).otherwise(t)

        text = let(text, one)
    return text


def redact_pii(df: DataFrame, text: str = "full_text") -> DataFrame:
    """Add ``safe_text`` and ``pii_redacted``."""
    return df.withColumn("safe_text", redact(F.col(text))).withColumn(
        "pii_redacted", F.col("safe_text") != F.col(text))


# ---------------------------------------------------------------- model routing

def model_tier_for(task: Column, length: Column, reasoning: Column, prefer_local: Column) -> Column:
    return (
        F.when(reasoning | (length > PREMIUM_ABOVE), F.lit("premium"))
        .when(prefer_local & (length <= SHORT_UP_TO), F.lit("local_slm"))
        .when((length > SHORT_UP_TO) | task.isin(STANDARD_TASKS), F.lit("standard"))
        .otherwise(F.lit("fast"))
    )


def route_model(df: DataFrame, task: str = "extraction", text: str = "safe_text",
                reasoning: bool = False, prefer_local: bool = False,
                local_model: str = MODELS["local_slm"][0]) -> DataFrame:
    """Add ``model_tier``, ``model``, ``max_tokens`` and ``cost_per_1k``."""
    models = {**MODELS, "local_slm": (local_model, *MODELS["local_slm"][1:])}
    tier = F.col("model_tier")
    df = df.withColumn("model_tier", model_tier_for(
        F.lit(task), F.length(text), F.lit(reasoning), F.lit(prefer_local)))

    def pick(i: int, sql_type: str) -> Column:
        return choose(tier, {t: str(m[i]) for t, m in models.items()}).cast(sql_type)

    return df.withColumns({
        "model": pick(0, "string"), "max_tokens": pick(1, "int"), "cost_per_1k": pick(2, "double"),
    })


# ---------------------------------------------------------------- guardrails

def schema_failures(df: DataFrame, text: str, required: list[str], name: str) -> DataFrame:
    """Add ``name``: invalid JSON, or one message per missing key. The text is parsed once, as a column."""
    clean, keys = F.col("_schema_text"), F.col("_schema_keys")
    df = df.withColumn("_schema_text", without_fences(F.col(text)))
    df = df.withColumn("_schema_members", object_map(clean))
    df = df.withColumn("_schema_keys", F.map_keys("_schema_members"))
    missing = fl.gathered(*[
        (~F.coalesce(F.array_contains(keys, F.lit(k)), F.lit(False)), F.lit(f"Missing required key: {k}"))
        for k in required
    ])
    return df.withColumn(name, F.when(is_json(clean, F.col("_schema_members")), missing).otherwise(
        F.array(F.lit("Invalid JSON")))).drop("_schema_text", "_schema_members", "_schema_keys")


def check_schema(df: DataFrame, text: str, required: list[str] | None = None) -> DataFrame:
    df = schema_failures(df, text, required or REQUIRED_KEYS, "schema_failures")
    return df.withColumn("schema_ok", F.size("schema_failures") == 0)


def output_failures(text: Column, min_length: int = MIN_OUTPUT, max_length: int = MAX_OUTPUT) -> Column:
    text = text_or_empty(text)
    marks = [(F.contains(text, F.lit(f"[{label}-REDACTED]")),
              F.lit(f"PII detected and redacted: {label}")) for label, _ in PII]
    return fl.gathered(
        (F.length(strip_text(text)) < min_length, F.lit(f"Output too short (< {min_length} chars)")),
        (F.length(text) > max_length, F.lit(f"Output too long (> {max_length} chars)")),
        *marks,
    )


def validate_output(df: DataFrame, text: str, min_length: int = MIN_OUTPUT,
                    max_length: int = MAX_OUTPUT) -> DataFrame:
    return df.withColumns({
        "output_failures": output_failures(F.col(text), min_length, max_length),
        "redacted": redact(F.col(text)),
    }).withColumn("output_ok", F.size("output_failures") == 0)


def guardrail_flags(df: DataFrame, payload: str = "result_json") -> DataFrame:
    """Recorded for the report; they never change a disposition."""
    df = schema_failures(df, payload, REQUIRED_KEYS, "_schema")
    return df.withColumn("_output", output_failures(F.col(payload))).withColumns({
        "schema_ok": F.size("_schema") == 0, "output_ok": F.size("_output") == 0,
        "guardrail_failures": F.concat("_schema", "_output"),
    }).drop("_schema", "_output")


# ---------------------------------------------------------------- fallback

def rule_fields() -> Column:
    """Fields that ingestion parsed, as extraction fields of the rules tier."""
    conf = F.lit(RULES_CONFIDENCE)
    scalars = fl.gathered(*[
        (F.col(n) != "", fl.make(n, F.col(n), conf, "rules"))
        for n in REPLACED if not n.endswith("codes")
    ])
    lists = [fl.make_all(n, F.col(n), conf, "rules") for n in REPLACED if n.endswith("codes")]
    return F.concat(scalars, *lists)


def rules_available() -> Column:
    return ((F.col("patient_name") != "") | (F.size("diagnosis_codes") > 0)
            | (F.size("procedure_codes") > 0))


def fallback_chain(df: DataFrame, min_confidence: float = REVIEW_THRESHOLD) -> DataFrame:
    """Model result, else ingestion fields, else a person."""
    source = (
        F.when(F.col("mean_confidence") >= min_confidence, F.lit("llm"))
        .when(rules_available(), F.lit("rules")).otherwise(F.lit("human_queue"))
    )
    kept = F.filter("fields", lambda f: ~f["field_name"].isin(REPLACED))
    by_rules, by_hand = F.col("fallback_source") == "rules", F.col("fallback_source") == "human_queue"
    return df.withColumn("fallback_source", source).withColumns({
        "used_fallback": F.col("fallback_source") != "llm",
        "fallback_confidence": F.when(by_rules, F.lit(RULES_CONFIDENCE)).when(by_hand, F.lit(0.0))
        .otherwise(F.col("mean_confidence")),
        "fields": F.when(by_rules, F.concat(kept, rule_fields())).otherwise(F.col("fields")),
        "mean_confidence": F.when(by_rules, F.lit(RULES_CONFIDENCE)).otherwise(F.col("mean_confidence")),
        "extraction_warnings": F.when(by_rules, F.concat(
            "extraction_warnings", F.array(F.lit("rules_fallback_used"))))
        .otherwise(F.col("extraction_warnings")),
        "errors": F.when(by_hand, F.concat("errors", F.array(F.lit(FALLBACK_ERROR))))
        .otherwise(F.col("errors")),
        "disposition": F.when(by_hand, F.lit("human_review")).otherwise(F.col("disposition")),
    })
