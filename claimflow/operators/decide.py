"""Business decisions as decision tables over the extracted values. All narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed as fx
from ..functions import fields as fl
from ..functions.fence import settle
from ..functions.text import fixed_point, quoted_list
from .lookup import lookup_join

AGENTS = {"prior_auth": "prior_auth", "denial_eob": "denial_appeal", "referral": "referral_triage"}
STATUS_DISPOSITION = {"completed": "completed", "needs_hitl": "needs_hitl", "failed": "failed"}

OUTPUT = (
    "struct<action:string,patient_name:string,member_id:string,procedure_codes:array<string>,"
    "payer_id:string,auth_status:string,decoded_codes:array<struct<code:string,overturnable:boolean>>,"
    "appeal_viable:boolean,strategy:string,letter_type:string,claim_number:string,"
    "appeal_deadline:string,letter_status:string,urgency:string,"
    "matched_provider:struct<npi:string,name:string,availability:string>,"
    "referral_status:string,queue:string>"
)
OUTPUT_FIELDS = [
    "action", "patient_name", "member_id", "procedure_codes", "payer_id", "auth_status",
    "decoded_codes", "appeal_viable", "strategy", "letter_type", "claim_number", "appeal_deadline",
    "letter_status", "urgency", "matched_provider", "referral_status", "queue",
]


def flatten_fields(df: DataFrame) -> DataFrame:
    """Add ``x``: plain values, scalars as text and code lists as arrays."""
    return settle(df.withColumn("x", fl.flat(F.col("fields"))))


def _output(**cols: Column) -> Column:
    types = {
        "procedure_codes": "array<string>",
        "decoded_codes": "array<struct<code:string,overturnable:boolean>>",
        "appeal_viable": "boolean",
        "matched_provider": "struct<npi:string,name:string,availability:string>",
    }
    return F.struct(*[
        cols.get(n, F.lit(None)).cast(types.get(n, "string")).alias(n) for n in OUTPUT_FIELDS
    ])


def _hitl(prefix: str, mean: Column, suffix: str) -> Column:
    return F.concat(F.lit(prefix), fixed_point(mean, 2), F.lit(suffix))


def _step(node: str, agent: str, **detail: Column) -> Column:
    pairs = [c for k, v in detail.items() for c in (F.lit(k), v.cast("string"))]
    empty = F.create_map().cast("map<string,string>")
    return F.struct(F.lit(node).alias("node"), F.lit(agent).alias("agent"), F.col("decided_at").alias("ts"),
                    (F.create_map(*pairs) if pairs else empty).alias("detail"))


def _state(df: DataFrame, status: Column, reason: Column, output: Column, errors: Column,
           steps: list[tuple[Column | None, Column]], agent: str, only: Column | None) -> DataFrame:
    waiting = status == "needs_hitl"
    state = F.struct(
        F.lit(agent).alias("agent"), status.alias("status"), waiting.alias("hitl_required"),
        F.when(waiting, reason).otherwise(F.lit("")).alias("hitl_reason"),
        output.alias("output"), errors.alias("errors"),
        fl.gathered(*steps).alias("audit_trail"),
    )
    return settle(df.withColumn("agent", state if only is None else F.when(only, state)))


def _values(only: Column | None) -> Column:
    return F.col("x") if only is None else F.when(only, F.col("x"))


def _no_errors() -> Column:
    return F.array().cast("array<string>")


def _with_clock(df: DataFrame) -> DataFrame:
    if "decided_at" in df.columns:
        return df
    stamp = F.col("ingested_at") if "ingested_at" in df.columns else F.current_timestamp()
    return df.withColumn("decided_at", stamp)


# ---------------------------------------------------------------- the three tables

def prior_auth(df: DataFrame, only: Column | None = None) -> DataFrame:
    """Needs ``x`` and ``mean_confidence``; adds ``agent``, for rows in ``only`` where given."""
    me, x, mean = "prior_auth", _values(only), F.col("mean_confidence")

    def absent(n: str) -> Column:
        empty = F.size(x[n]) == 0 if n.endswith("codes") else x[n] == ""
        return F.coalesce(empty, F.lit(True))

    missing = fl.gathered(*[(absent(n), F.lit(n)) for n in fx.PRIOR_AUTH_REQUIRED])
    df = _with_clock(df).withColumn("_missing", missing if only is None else F.when(only, missing))
    missing = F.col("_missing")
    broken = F.size(missing) > fx.PRIOR_AUTH_MAX_MISSING
    sure = mean >= fx.PRIOR_AUTH_GATE
    status = F.when(broken, F.lit("failed")).when(sure, F.lit("completed")).otherwise(F.lit("needs_hitl"))
    output = F.when(status == "completed", _output(
        action=F.lit("submit_prior_auth"), patient_name=x["patient_name"], member_id=x["member_id"],
        procedure_codes=x["procedure_codes"], payer_id=x["payer_id"],
        auth_status=F.lit("pending_payer_response")))
    errors = F.when(broken, F.array(F.concat(F.lit("Too many missing fields: "), quoted_list(missing)))) \
        .otherwise(_no_errors())
    count = F.size(x["diagnosis_codes"])
    sent = F.to_json(output)
    steps = [
        (None, _step("start", me, document_type=F.lit("prior_auth"))),
        (~broken, _step("validate_fields", me, missing=F.to_json(missing))),
        (~broken, _step("check_criteria", me, criteria_met=count > 0, dx_count=count)),
        (~broken & sure, _step("auto_route", me, output=sent)),
        (~broken & sure, _step("complete", me, output=sent)),
    ]
    reason = _hitl("Extraction confidence ", mean, f" below gate {fx.PRIOR_AUTH_GATE}")
    return _state(df, status, reason, output, errors, steps, me, only).drop("_missing")


def denial_appeal(df: DataFrame, only: Column | None = None) -> DataFrame:
    me, x, mean = "denial_appeal", _values(only), F.col("mean_confidence")
    decoded = F.transform(x["denial_reason_codes"], lambda c: F.struct(
        F.upper(c).alias("code"), F.upper(c).isin(fx.OVERTURNABLE).alias("overturnable")))
    df = _with_clock(df).withColumn("_decoded", decoded)
    d = F.col("_decoded")
    df = df.withColumns({
        "_viable": F.exists(d, lambda c: c["overturnable"]),
        "_strategy": F.when(F.exists(d, lambda c: c["code"].isin(fx.MEDICAL_NECESSITY)),
                            F.lit("medical_necessity")).otherwise(F.lit("coding_correction")),
    })
    viable, strategy = F.col("_viable"), F.col("_strategy")
    sure = mean >= fx.DENIAL_GATE
    status = F.when(~viable, F.lit("completed")).when(sure, F.lit("completed")).otherwise(F.lit("needs_hitl"))
    letter = viable & sure
    when_letter = {
        "letter_type": F.lit("appeal"), "patient_name": x["patient_name"],
        "claim_number": x["claim_number"], "appeal_deadline": x["appeal_deadline"],
        "letter_status": F.lit("draft_generated"),
    }
    output = _output(
        decoded_codes=d, appeal_viable=viable, strategy=F.when(viable, strategy),
        **{k: F.when(letter, c) for k, c in when_letter.items()})
    steps = [
        (None, _step("start", me, document_type=F.lit("denial_eob"))),
        (None, _step("decode_denial", me, codes=F.to_json(d))),
        (None, _step("assess_viability", me, viable=viable)),
        (~viable, _step("no_appeal", me, reason=F.lit("codes not overturnable"))),
        (viable, _step("build_strategy", me, strategy=strategy)),
        (letter, _step("generate_letter", me, strategy=strategy, **when_letter)),
        (letter, _step("complete", me, output=F.to_json(output))),
    ]
    reason = _hitl("Low extraction confidence ", mean, " — review before letter gen")
    return _state(df, status, reason, output, _no_errors(), steps, me, only).drop(
        "_decoded", "_viable", "_strategy")


def default_provider() -> Column:
    npi, name, wait = fx.DEFAULT_PROVIDER
    return F.struct(F.lit(npi).alias("npi"), F.lit(name).alias("name"), F.lit(wait).alias("availability"))


def provider_match(df: DataFrame, providers: DataFrame | None = None, spread: str = "record_id") -> DataFrame:
    """Add ``matched_provider``.

    ``providers`` has ``chapter`` (first letter of a diagnosis code), ``npi``, ``name``,
    ``availability`` and ``wait_days``; the shortest wait per chapter wins, ties by NPI. Documents
    without a match, or without a table, get the fixed provider.
    """
    if providers is None:
        return df.withColumn("matched_provider", default_provider())
    best = providers.groupBy("chapter").agg(F.min_by(
        F.struct("npi", "name", "availability"), F.struct("wait_days", "npi")).alias("_provider"))
    first = F.substring(F.upper(F.get(F.col("x")["diagnosis_codes"], F.lit(0))), 1, 1)
    joined = lookup_join(df.withColumn("_chapter", first), best, "_chapter", "chapter", [spread])
    return joined.withColumn("matched_provider", F.coalesce("_provider", default_provider())).drop(
        "_chapter", "_provider")


def referral_triage(df: DataFrame, providers: DataFrame | None = None, only: Column | None = None) -> DataFrame:
    me, x, mean = "referral_triage", _values(only), F.col("mean_confidence")
    df = provider_match(_with_clock(df), providers)
    urgent = F.exists(x["diagnosis_codes"], lambda c: F.upper(c).isin(fx.URGENT_DX))
    df = df.withColumn("_urgency", F.when(urgent, F.lit("urgent")).otherwise(F.lit("routine")))
    urgency, provider = F.col("_urgency"), F.col("matched_provider")
    sure = mean >= fx.REFERRAL_GATE
    queue = F.when(urgency == "urgent", F.lit("urgent-referral")).otherwise(F.lit("standard-referral"))
    output = _output(
        urgency=urgency, matched_provider=provider,
        referral_status=F.when(sure, F.lit("routed")), queue=F.when(sure, queue))
    steps = [
        (None, _step("start", me)),
        (None, _step("score_urgency", me, urgency=urgency, dx_count=F.size(x["diagnosis_codes"]))),
        (None, _step("match_provider", me, provider=F.to_json(provider))),
        (sure, _step("route_referral", me, urgency=urgency, matched_provider=F.to_json(provider),
                     referral_status=F.lit("routed"), queue=queue)),
    ]
    status = F.when(sure, F.lit("completed")).otherwise(F.lit("needs_hitl"))
    reason = _hitl("Referral confidence ", mean, " too low for auto-routing")
    return _state(df, status, reason, output, _no_errors(), steps, me, only).drop("_urgency", "matched_provider")


# ---------------------------------------------------------------- dispatch

def dispatch(df: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    """Decide every in-flight document by its type; other types go to their queue.

    One frame, three decision tables side by side: the table that applies is picked per row, and a
    row is not decided by the others.
    """
    df = _with_clock(df if "x" in df.columns else flatten_fields(df))
    kind = F.col("document_type")
    df = prior_auth(df, kind == "prior_auth").withColumnRenamed("agent", "_prior")
    df = denial_appeal(df, kind == "denial_eob").withColumnRenamed("agent", "_denial")
    df = referral_triage(df, providers, kind == "referral").withColumnRenamed("agent", "_referral")
    df = df.withColumn("agent", F.coalesce("_prior", "_denial", "_referral"))
    disposition = F.lit("failed")
    for status, name in STATUS_DISPOSITION.items():
        disposition = F.when(F.col("agent.status") == status, F.lit(name)).otherwise(disposition)
    routed = F.col("agent").isNull()
    return df.withColumns({
        "disposition": F.when(routed, F.lit("routed_no_agent")).otherwise(disposition),
        "queue": F.when(routed, F.col("classification.routing_queue")),
    }).drop("_prior", "_denial", "_referral", "decided_at")


def audit_events(df: DataFrame) -> DataFrame:
    """One row per audited step, in order."""
    return df.where(F.col("agent").isNotNull()).select(
        "document_id", F.posexplode("agent.audit_trail").alias("step", "e")
    ).select("document_id", "step", "e.node", "e.agent", "e.ts", "e.detail")
