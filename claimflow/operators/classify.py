"""Document type: source hint, then rules, then the text model, then a pluggable model call.

The tiers are columns of one frame rather than branches of it: a tier's input is empty for rows
an earlier tier has decided, so the costly tiers do no work on them and the frame is read once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (
    CLASSIFY_SYSTEM, HIGH_PRIORITY, HL7_MESSAGES, MODEL_EXCERPT, QUEUES, REVIEW_QUEUE, RULES,
    RULES_THRESHOLD, SOURCE_HINT_CONFIDENCE, TEXT_MODEL_THRESHOLD, WEBHOOK_EVENTS,
)
from ..functions.fence import settle
from ..functions.jsontext import is_object, outer_object, without_fences
from ..functions.text import lines, round_half_even, strip, strip_text
from ..schemas import DOCUMENT_TYPES
from .inference import CallLimits, call_model
from .rules import Catalogue, apply_rules

UNKNOWN_ERROR = "classification: no confident document type — sent to human review"


def choose(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(default).cast("string")
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def source_hint() -> Column:
    """The type a format declares about itself, NULL when it declares none or is malformed."""
    stype, text = F.col("source_type"), F.col("full_text")
    body = strip_text(text)
    kinds = F.get_json_object(text, "$.entry[*].resource.resourceType")
    message = F.get(F.split(F.get(F.split(F.get(lines(text), F.lit(0)), r"\|"), F.lit(8)), r"\^"), F.lit(0))
    return (
        F.when(stype == "edi_837", F.lit("claim_837"))
        .when(stype == "fhir_r4", F.when(
            F.contains(kinds, F.lit('"Claim"')) & is_object(body), F.lit("claim_837")))
        .when((stype == "hl7_v2") & F.startswith(text, F.lit("MSH|")), choose(message, HL7_MESSAGES))
        .when(stype == "webhook", F.when(
            is_object(body), choose(F.get_json_object(text, "$.event"), WEBHOOK_EVENTS)))
    )


def routing_queue(document_type: Column) -> Column:
    return choose(document_type, QUEUES, REVIEW_QUEUE)


def is_high_priority(document_type: Column) -> Column:
    return document_type.isin(HIGH_PRIORITY)


def route(df: DataFrame, document_type: str = "document_type") -> DataFrame:
    kind = F.col(document_type)
    return df.withColumns({
        "routing_queue": routing_queue(kind), "high_priority": is_high_priority(kind),
    })


def read_type_reply(reply: Column) -> dict[str, Column]:
    """Type, confidence and reasoning out of a model's reply."""
    clean = without_fences(reply)
    obj = F.when(is_object(clean), clean).otherwise(outer_object(clean))
    ok = is_object(obj)
    stated = F.lower(F.coalesce(F.get_json_object(obj, "$.type"), F.lit("unknown")))
    raw_conf = F.get_json_object(obj, "$.confidence")
    conf = F.when(raw_conf.isNull(), F.lit(0.5)).otherwise(raw_conf.try_cast("double"))
    usable = F.coalesce(ok & conf.isNotNull(), F.lit(False))
    return {
        "document_type": F.when(usable & stated.isin(DOCUMENT_TYPES), stated).otherwise("unknown"),
        "confidence": F.when(usable, F.least(F.lit(1.0), F.greatest(F.lit(0.0), conf))).otherwise(0.0),
        "reasoning": F.when(usable, F.coalesce(F.get_json_object(obj, "$.reasoning"), F.lit("")))
        .otherwise("parse_error"),
    }


def model_tier(df: DataFrame, call: Callable[[str, str], str], text: str = "full_text",
               only: Column | None = None, excerpt_chars: int = MODEL_EXCERPT,
               limits: CallLimits = CallLimits()) -> DataFrame:
    """Add ``reply_type``, ``reply_confidence`` and ``reply_reasoning`` from ``call(system, user)``.

    The prompt carries the first ``excerpt_chars`` characters.
    """
    excerpt = strip(F.left(F.col(text), F.lit(excerpt_chars)))
    user = F.concat(F.lit("DOCUMENT:\n"), excerpt)
    if only is not None:
        user = F.when(only, user)
    called = df.withColumn("_call", call_model(call, limits)(F.lit(CLASSIFY_SYSTEM), user))
    cols = read_type_reply(F.col("_call.reply"))
    failed = F.col("_call.error").isNotNull()
    return called.withColumns({
        "reply_type": F.when(failed, F.lit("unknown")).otherwise(cols["document_type"]),
        "reply_confidence": F.when(failed, F.lit(0.0)).otherwise(cols["confidence"]),
        "reply_reasoning": F.when(failed, F.concat(F.lit("error: "), F.col("_call.error")))
        .otherwise(cols["reasoning"]),
    }).drop("_call")


def cascade(df: DataFrame, model=None, call: Callable[[str, str], str] | None = None,
            catalogue: Catalogue = RULES, use_hint: bool = True,
            excerpt_chars: int = MODEL_EXCERPT, limits: CallLimits = CallLimits()) -> DataFrame:
    """Add ``classification`` (type, confidence, runner-up, method, queue).

    ``model`` is a fitted ``TextModel``; ``call`` a model function. Both are optional.
    """
    hint = source_hint() if use_hint else F.lit(None).cast("string")
    df = df.withColumn("_hint", hint)
    open_rows = F.col("_hint").isNull()
    df = apply_rules(df, catalogue=catalogue, only=open_rows)
    df = df.withColumns({"_top": F.try_element_at("signals", F.lit(1)),
                         "_second": F.try_element_at("signals", F.lit(2))})
    top, second = F.col("_top"), F.col("_second")
    sure = top.isNotNull() & (top["confidence"] >= RULES_THRESHOLD)
    undecided = open_rows & ~F.coalesce(sure, F.lit(False))

    by_model = F.lit(False)
    extra = []
    if model is not None:
        df = model.score(df, "full_text", only=undecided, prefix="_tm")
        extra = ["_tm_type", "_tm_conf", "_tm_second", "_tm_second_conf"]
        agrees = top.isNull() | (top["document_type"] == F.col("_tm_type"))
        by_model = (F.col("_tm_conf") >= TEXT_MODEL_THRESHOLD) & (F.col("_tm_type") != "unknown") & agrees
        by_model = undecided & F.coalesce(by_model, F.lit(False))
    if call is not None:
        df = model_tier(df, call, only=undecided & ~by_model, excerpt_chars=excerpt_chars, limits=limits)
        extra += ["reply_type", "reply_confidence", "reply_reasoning"]

    def result(kind, conf, method, second_kind=None, second_conf=None) -> Column:
        none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
        return F.struct(
            kind.alias("document_type"), conf.cast("double").alias("confidence"),
            (second_kind if second_kind is not None else none_s).alias("runner_up_type"),
            (F.nullif(second_conf, F.lit(0.0)) if second_conf is not None else none_d)
            .alias("runner_up_conf"),
            F.lit(method).alias("method"),
        )

    out = F.when(~open_rows, result(F.col("_hint"), F.lit(SOURCE_HINT_CONFIDENCE), "source_hint"))
    out = out.when(~undecided, result(top["document_type"], top["confidence"], "rules",
                                      second["document_type"], second["confidence"]))
    if model is not None:
        out = out.when(by_model, result(F.col("_tm_type"), F.col("_tm_conf"), "embedding",
                                        F.col("_tm_second"), F.col("_tm_second_conf")))
    if call is not None:
        out = out.otherwise(result(F.col("reply_type"), round_half_even(F.col("reply_confidence"), 4),
                                   "llm"))
    else:
        out = out.when(top.isNotNull(), result(top["document_type"], top["confidence"], "rules_only"))
        out = out.otherwise(result(F.lit("unknown"), F.lit(0.0), "no_signal"))
    decided = df.withColumn("_c", out)
    c = F.col("_c")
    return settle(decided.withColumn("classification", F.struct(
        c["document_type"].alias("document_type"), c["confidence"].alias("confidence"),
        c["runner_up_type"].alias("runner_up_type"), c["runner_up_conf"].alias("runner_up_conf"),
        c["method"].alias("method"), routing_queue(c["document_type"]).alias("routing_queue"),
    )).drop("_hint", "_top", "_second", "_c", "signals", *extra))


def close_out(df: DataFrame) -> DataFrame:
    """Write the type back; unknown documents go to human review."""
    kind = F.col("classification.document_type")
    lost = kind == "unknown"
    return df.withColumns({
        "document_type": kind,
        "errors": F.when(lost, F.concat("errors", F.array(F.lit(UNKNOWN_ERROR)))).otherwise(F.col("errors")),
        "disposition": F.when(lost, F.lit("human_review")).otherwise(F.col("disposition")),
    })
