"""Queries over guardrails, fallback, decisions, reports and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimflow.operators import decide as dc
from claimflow.operators import evaluate as ev
from claimflow.operators import govern as gv
from claimflow.operators import report as rp
from claimflow.sinks import queue_messages

from . import sql as S
from .corpus import table
from .extract import prose
from .stages import decided, ingested, live_governed, passed


def check_schema(spark, sf):
    """Event properties, some cut short, must be JSON with their keys."""
    e = F.col("event_id")
    text = F.when(e % 11 == 3, F.substring("props", 1, 5)).when(e % 13 == 2, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    df = table(spark, sf, "events").select("event_id", text.alias("t"))
    return gv.check_schema(df, "t", ["k", "kind"]).select(
        "event_id", "schema_ok", F.array_join("schema_failures", "|").alias("failures"))


def validate_output(spark, sf):
    safe = gv.redact_pii(prose(spark, sf), "text")
    return gv.validate_output(safe, "safe_text").select(
        "doc_id", "output_ok", F.array_join("output_failures", "|").alias("failures"))


def guardrail_flags(spark, sf):
    return passed(spark, sf, "governed").where(F.col("fallback_source").isNotNull()).select(
        "file", "schema_ok", "output_ok", F.size("guardrail_failures").cast("bigint").alias("n_failures"))


def rules_fallback(spark, sf):
    q = F.col("q")
    df = passed(spark, sf, "governed").where(F.col("fallback_source") == "rules")
    return df.select("file", F.explode("fields").alias("q")).select(
        "file", q["field_name"].alias("field_name"), q["value"].alias("value"), q["confidence"].alias("confidence"), q["source"].alias("source"))


def fallback_chain(spark, sf):
    return live_governed(spark, sf).where(F.col("fallback_source").isNotNull()).select(
        "file", "fallback_source", "used_fallback", "mean_confidence", F.coalesce("disposition", F.lit("")).alias("disposition"))


def flatten_fields(spark, sf):
    df = dc.flatten_fields(passed(spark, sf, "governed").where(F.col("fields").isNotNull()))
    x = F.col("x")
    return df.select("file", *[x[n].alias(n) for n in S.FLAT_NAMES],
                     *[F.array_join(x[n], "|").alias(n) for n in S.LISTS])


def _agent(spark, sf, name):
    return passed(spark, sf, "decided").where(F.col("agent.agent") == name)


def prior_auth(spark, sf):
    a = F.col("agent")
    return _agent(spark, sf, "prior_auth").select(
        "file", a["status"].alias("status"), a["hitl_reason"].alias("hitl_reason"), a["output"]["action"].alias("action"),
        a["output"]["member_id"].alias("member_id"), F.array_join(a["errors"], "|").alias("errors"))


def denial_appeal(spark, sf):
    a, o = F.col("agent"), F.col("agent.output")
    return _agent(spark, sf, "denial_appeal").select(
        "file", a["status"].alias("status"), o["appeal_viable"].alias("appeal_viable"), o["strategy"].alias("strategy"),
        o["letter_status"].alias("letter_status"), o["claim_number"].alias("claim_number"), o["appeal_deadline"].alias("appeal_deadline"),
        F.array_join(F.transform(o["decoded_codes"], lambda c: F.concat_ws(":", c["code"], c["overturnable"].cast("string"))), "|").alias("codes"))


def referral_triage(spark, sf):
    a, o = F.col("agent"), F.col("agent.output")
    return _agent(spark, sf, "referral_triage").select(
        "file", a["status"].alias("status"), a["hitl_reason"].alias("hitl_reason"), o["urgency"].alias("urgency"), o["queue"].alias("queue"))


def provider_match(spark, sf):
    """Suppliers as the provider network; the shortest wait per diagnosis chapter wins."""
    s = F.col("s_suppkey")
    providers = table(spark, sf, "supplier").select(
        F.element_at(F.array(*[F.lit(c) for c in "MJEIKF"]), (s % 6 + 1).cast("int")).alias("chapter"),
        F.lpad(s.cast("string"), 10, "0").alias("npi"), F.col("s_name").alias("name"),
        F.concat((s % 9 + 1).cast("string"), F.lit(" days")).alias("availability"), (s % 9).alias("wait_days"))
    df = dc.flatten_fields(passed(spark, sf, "governed").where(F.col("disposition").isNull() & (F.col("document_type") == "referral")))
    p = F.col("matched_provider")
    return dc.provider_match(df, providers).select("file", p["npi"].alias("npi"), p["availability"].alias("availability"))


def dispatch(spark, sf):
    return passed(spark, sf, "decided").select("file", "disposition", F.col("agent.agent").alias("agent"),
                                     F.coalesce("queue", F.lit("")).alias("queue"))


def audit_trail(spark, sf):
    return dc.audit_events(decided(spark, sf)).groupBy("agent", "node", "step").agg(F.count(F.lit(1)).alias("n"))


def report_counts(spark, sf):
    return rp.report_counts(rp.report_rows(passed(spark, sf, "decided")))


def report_means(spark, sf):
    return rp.report_means(passed(spark, sf, "decided"))


def stage_latency(spark, sf):
    return rp.stage_latency(table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))


def gold(spark, sf):
    """Gold records from the corpus: each valid document with the codes ingestion parsed as the truth."""
    d = ingested(spark, sf).where((F.col("disposition").isNull() | (F.col("disposition") == "dlq")) & F.col("source").isin("hl7v2", "edi837", "fhir_r4"))

    def codes(c):
        return F.to_json(c)

    return d.select(F.col("file").alias("doc_id"), F.lit("").alias("expected_type"), F.col("full_text").alias("text"),
                    F.create_map(F.lit("patient_id"), F.col("patient_id"), F.lit("payer_id"), F.col("payer_id"),
                                 F.lit("diagnosis_codes"), codes("diagnosis_codes"),
                                 F.lit("procedure_codes"), codes("procedure_codes")).alias("expected"))


def field_f1(spark, sf):
    return ev.score_gold(gold(spark, sf)).select("doc_id", "field_name", F.round("f1", 6).alias("f1"))


def eval_summary(spark, sf):
    return ev.run_eval(gold(spark, sf))


def field_precision_recall(spark, sf):
    return ev.precision_recall(ev.score_gold(gold(spark, sf)))


def exact_gold(spark, sf):
    """Labelled bundles: the truth is what the order says, which some bundles leave out."""
    d = ingested(spark, sf).where((F.col("disposition").isNull() | (F.col("disposition") == "dlq")) & (F.col("source") == "fhir_r4"))
    return d.select("file", F.lit("fhir_r4").alias("source_type"), F.col("full_text").alias("input"),
                    F.create_map(F.lit("patient_dob"), F.lit("1950-03-08"), F.lit("payer_id"), F.col("payer_id"),
                                 F.lit("procedure_codes"), F.lit('["93000", "99213"]')).alias("expected"))


def eval_exact(spark, sf):
    return ev.eval_exact(exact_gold(spark, sf))


def queue_outputs(spark, sf):
    return queue_messages(ingested(spark, sf)).groupBy("queue", "group_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("dedup_id").alias("n_ids"))


QUERIES = {f.__name__: f for f in (
    check_schema, validate_output, guardrail_flags, rules_fallback, fallback_chain, flatten_fields,
    prior_auth, denial_appeal, referral_triage, provider_match, dispatch, audit_trail, report_counts,
    report_means, stage_latency, field_f1, eval_summary, field_precision_recall, eval_exact, queue_outputs)}

F_ACT = "list_distinct(list_transform(list_filter(f0, lambda q: q.n = name), lambda q: upper(q.v)))"
SCORES = f"""{S.DOCS},
x0 AS (SELECT *, NULL::VARCHAR AS closed2, full_text AS safe_text, {S.strip("full_text")} AS x FROM docs WHERE error IS NULL AND source IN ('hl7v2', 'edi837', 'fhir_r4')),
dispatched AS (SELECT *, CASE source WHEN 'fhir_r4' THEN 'bundle' WHEN 'hl7v2' THEN 'hl7' ELSE CASE WHEN starts_with(x, 'ISA*') THEN 'edi' ELSE 'text' END END AS xkind FROM x0),
{S.EXTRACTED[S.EXTRACTED.index('opened2 AS ('):S.EXTRACTED.index('enriched AS (')].rstrip().rstrip(',')},
pairs AS (
  SELECT file, f0, unnest([{{'n': 'patient_id', 'e': [patient_id]}}, {{'n': 'payer_id', 'e': [payer_id]}}, {{'n': 'diagnosis_codes', 'e': dx}}, {{'n': 'procedure_codes', 'e': px}}]) AS g FROM packed),
named AS (SELECT file, f0, g.n AS name, g.e AS e FROM pairs),
acts AS (SELECT *, {F_ACT} AS act, list_distinct(list_transform(e, lambda v: upper(v))) AS ex,
  list_filter(f0, lambda q: q.n = name)[1].v AS sv FROM named),
pr AS (SELECT *, len(list_intersect(act, ex)) AS hit FROM acts),
ratios AS (SELECT *, name LIKE '%codes' AS many,
  CASE WHEN name LIKE '%codes' THEN CASE WHEN len(act) = 0 AND len(ex) = 0 THEN 1.0 WHEN len(act) = 0 OR len(ex) = 0 THEN 0.0 ELSE hit / len(act) END ELSE CASE WHEN trim(coalesce(sv, 'None')) = trim(e[1]) THEN 1.0 ELSE 0.0 END END::DOUBLE AS p,
  CASE WHEN name LIKE '%codes' THEN CASE WHEN len(act) = 0 AND len(ex) = 0 THEN 1.0 WHEN len(act) = 0 OR len(ex) = 0 THEN 0.0 ELSE hit / len(ex) END ELSE CASE WHEN trim(coalesce(sv, 'None')) = trim(e[1]) THEN 1.0 ELSE 0.0 END END::DOUBLE AS r FROM pr),
scores AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM ratios)"""

REPORT = """SELECT 'source' AS dimension, source AS value, count(*) AS n FROM final GROUP BY source
UNION ALL SELECT 'disposition', disposition, count(*) FROM final GROUP BY disposition
UNION ALL SELECT 'document_type', coalesce(kind, 'unknown'), count(*) FROM final WHERE error IS NULL GROUP BY 2
UNION ALL SELECT 'method', method, count(*) FROM final WHERE method IS NOT NULL GROUP BY method
UNION ALL SELECT 'agent', agent, count(*) FROM final WHERE agent IS NOT NULL GROUP BY agent"""
PROVIDERS = """best AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY wait, npi) AS rn FROM (
  SELECT ['M','J','E','I','K','F'][1 + s_suppkey % 6] AS chapter, lpad(s_suppkey::VARCHAR, 10, '0') AS npi, concat(s_suppkey % 9 + 1, ' days') AS availability, s_suppkey % 9 AS wait FROM supplier))"""
AUDIT = """steps AS (SELECT agent, CASE
  WHEN agent = 'prior_auth' THEN CASE WHEN status = 'failed' THEN ['start'] WHEN status = 'completed' THEN ['start', 'validate_fields', 'check_criteria', 'auto_route', 'complete'] ELSE ['start', 'validate_fields', 'check_criteria'] END
  WHEN agent = 'denial_appeal' THEN CASE WHEN NOT viable THEN ['start', 'decode_denial', 'assess_viability', 'no_appeal'] WHEN status = 'completed' THEN ['start', 'decode_denial', 'assess_viability', 'build_strategy', 'generate_letter', 'complete'] ELSE ['start', 'decode_denial', 'assess_viability', 'build_strategy'] END
  ELSE CASE WHEN status = 'completed' THEN ['start', 'score_urgency', 'match_provider', 'route_referral'] ELSE ['start', 'score_urgency', 'match_provider'] END END AS nodes FROM final WHERE agent IS NOT NULL),
numbered AS (SELECT agent, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS step FROM steps)"""

ORACLES = {
    "check_schema": """WITH t AS (SELECT event_id, event_id % 11 = 3 AS cut, json_exists(props, '$.k') AS has_k, json_exists(props, '$.kind') AS has_kind FROM events)
        SELECT event_id, NOT cut AND has_k AND has_kind AS schema_ok, CASE WHEN cut THEN 'Invalid JSON' ELSE array_to_string(list_filter([
        CASE WHEN NOT has_k THEN 'Missing required key: k' END, CASE WHEN NOT has_kind THEN 'Missing required key: kind' END], lambda m: m IS NOT NULL), '|') END AS failures FROM t""",
    "validate_output": f"""WITH t AS (SELECT doc_id, {S.redact('text')} AS s FROM documents), q AS (SELECT doc_id, list_filter([
        CASE WHEN len({S.strip('s')}) < 5 THEN 'Output too short (< 5 chars)' END, CASE WHEN len(s) > 50000 THEN 'Output too long (> 50000 chars)' END,
        CASE WHEN contains(s, '[SSN-REDACTED]') THEN 'PII detected and redacted: SSN' END, CASE WHEN contains(s, '[CARD-REDACTED]') THEN 'PII detected and redacted: CARD' END,
        CASE WHEN contains(s, '[EMAIL-REDACTED]') THEN 'PII detected and redacted: EMAIL' END], lambda m: m IS NOT NULL) AS m FROM t)
        SELECT doc_id, len(m) = 0 AS output_ok, array_to_string(m, '|') AS failures FROM q""",
    "guardrail_flags": S.query(S.GOVERNED, """SELECT file, true AS schema_ok, len(list_filter(f, lambda q: contains(q.v, '-REDACTED]'))) = 0 AS output_ok,
        len(list_filter(['SSN', 'CARD', 'EMAIL'], lambda l: len(list_filter(f, lambda q: contains(q.v, concat('[', l, '-REDACTED]')))) > 0)) AS n_failures
        FROM governed WHERE tier IS NOT NULL"""),
    "rules_fallback": S.query(S.GOVERNED, """SELECT file, q.n AS field_name, q.v AS value, q.c AS confidence, q.s AS source
        FROM (SELECT file, unnest(f) AS q FROM governed WHERE tier = 'rules')"""),
    "fallback_chain": S.query(S.GOVERNED, """SELECT file, tier AS fallback_source, tier <> 'llm' AS used_fallback, mean_conf AS mean_confidence,
        coalesce(closed3, '') AS disposition FROM governed WHERE tier IS NOT NULL"""),
    "flatten_fields": S.query(S.DECIDED, "SELECT file, " + ", ".join(f"x_{n} AS {n}" for n in S.VALUES) + ", " + ", ".join(
        f"array_to_string(x_{n}, '|') AS {n}" for n in S.LISTS) + " FROM flat WHERE closed2 IS NULL"),
    "prior_auth": S.query(S.DECIDED, """SELECT file, status, CASE WHEN status = 'needs_hitl' THEN concat('Extraction confidence ', printf('%.2f', mean_conf), ' below gate 0.8') ELSE '' END AS hitl_reason,
        CASE WHEN status = 'completed' THEN 'submit_prior_auth' END AS action, CASE WHEN status = 'completed' THEN x_member_id END AS member_id,
        CASE WHEN status = 'failed' THEN concat('Too many missing fields: [', array_to_string(list_transform(missing, lambda m: concat(chr(39), m, chr(39))), ', '), ']') ELSE '' END AS errors
        FROM final WHERE agent = 'prior_auth'"""),
    "denial_appeal": S.query(S.DECIDED, f"""SELECT file, status, viable AS appeal_viable, CASE WHEN viable THEN strategy END AS strategy,
        CASE WHEN viable AND mean_conf >= 0.65 THEN 'draft_generated' END AS letter_status, CASE WHEN viable AND mean_conf >= 0.65 THEN x_claim_number END AS claim_number,
        CASE WHEN viable AND mean_conf >= 0.65 THEN x_appeal_deadline END AS appeal_deadline,
        array_to_string(list_transform(carcs, lambda c: concat(c, ':', list_contains(['CO-4', 'CO-11', 'CO-50', 'CO-97', 'PR-96'], c))), '|') AS codes
        FROM final WHERE agent = 'denial_appeal'"""),
    "referral_triage": S.query(S.DECIDED, """SELECT file, status, CASE WHEN status = 'needs_hitl' THEN concat('Referral confidence ', printf('%.2f', mean_conf), ' too low for auto-routing') ELSE '' END AS hitl_reason,
        urgency, CASE WHEN status = 'completed' THEN CASE urgency WHEN 'urgent' THEN 'urgent-referral' ELSE 'standard-referral' END END AS queue FROM final WHERE agent = 'referral_triage'"""),
    "provider_match": S.query(f"{S.DECIDED}, {PROVIDERS}", """SELECT file, coalesce(b.npi, '1234567890') AS npi, coalesce(b.availability, '3 days') AS availability
        FROM final LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON upper(x_diagnosis_codes[1])[1] = b.chapter WHERE agent = 'referral_triage'"""),
    "dispatch": S.query(S.DECIDED, f"""SELECT file, disposition, agent, CASE WHEN disposition = 'routed_no_agent' THEN {S.queue('kind')} ELSE '' END AS queue FROM final"""),
    "audit_trail": S.query(f"{S.DECIDED}, {AUDIT}", "SELECT agent, node, step, count(*) AS n FROM numbered GROUP BY ALL"),
    "report_counts": S.query(S.DECIDED, REPORT),
    "report_means": S.query(S.DECIDED, "SELECT count(*) AS total_records, round(coalesce(avg(mean_conf), 0.0), 4) AS mean_extraction_confidence FROM final"),
    "stage_latency": "SELECT event_type AS stage, round(avg(value), 2) AS mean_ms FROM events GROUP BY event_type",
    "field_f1": S.query(SCORES, "SELECT file AS doc_id, name AS field_name, round(f1, 6) AS f1 FROM scores"),
    "eval_summary": S.query(SCORES, "SELECT count(*) AS n_pairs, round(avg(f1), 4) AS mean_f1, avg(f1) >= 0.8 AS passed FROM scores"),
    "field_precision_recall": S.query(SCORES, """SELECT name AS field_name, round(avg(p), 4) AS precision, round(avg(r), 4) AS recall, round(avg(f1), 4) AS f1,
        sum(CASE WHEN many THEN len(ex) ELSE 1 END)::BIGINT AS n_expected, sum(CASE WHEN many THEN len(act) WHEN sv IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_actual FROM scores GROUP BY name"""),
    "eval_exact": S.query(S.DOCS, """, s AS (SELECT (CASE WHEN patient_dob = '1950-03-08' THEN 1 ELSE 0 END + 1 + CASE WHEN list_sort(px) = ['93000', '99213'] THEN 1 ELSE 0 END) / 3.0::DOUBLE AS score
        FROM docs WHERE source = 'fhir_r4' AND error IS NULL) SELECT count(*) AS total, round(avg(score), 4) AS mean_score, avg(score) >= 0.9 AS passed FROM s"""),
    "queue_outputs": S.query(S.VALID, """SELECT queue, source_type AS group_id, count(*) AS n, count(DISTINCT document_id) AS n_ids FROM (
        SELECT source_type, document_id, unnest(CASE WHEN closed IS NULL THEN ['classifier', 'extraction'] ELSE ['dlq'] END) AS queue FROM valid) GROUP BY ALL"""),
}
