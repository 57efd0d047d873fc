"""Queries over redaction, routing, extraction, replies and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimflow import fixed as fx
from claimflow.functions import fields as fl
from claimflow.operators import enrich as en
from claimflow.operators import govern as gv
from claimflow.operators import prompts as pr
from claimflow.operators.extract import extract_builtin
from claimflow.operators.infer import batch_inference
from claimflow.operators.inference import CallLimits
from claimflow.operators.meter import call_records, call_summary, token_cost
from claimflow.operators.reply import parse_reply
from claimflow.plans.phases import Services, extraction
from claimflow.sources.landing import spread

from . import sql as S
from .corpus import DX, PX, pick, table
from .stages import classified, extracted, passed


CODE_TABLES = {
    "icd10": f"""SELECT upper({pick(DX, 'o_orderkey')}) AS code FROM orders WHERE o_orderkey % 13 NOT IN (2, 5, 8)
        UNION ALL SELECT concat('Z', cast(o_orderkey AS string)) FROM orders UNION ALL SELECT cast(NULL AS string)""",
    "cpt": f"""SELECT {pick(PX, 'o_orderkey')} AS code FROM orders WHERE o_orderkey % 12 NOT IN (1, 7, 11)
        UNION ALL SELECT concat('8', cast(o_orderkey AS string)) FROM orders""",
}


def prose(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def done(spark, sf):
    return extracted(spark, sf).where(F.col("fields").isNotNull())


def live(spark, sf, *sources, **services):
    """The extraction phase itself, over the documents of the named sources, which the scan picks."""
    df = classified(spark, sf)
    if sources:
        df = df.where(F.col("source").isin(list(sources)))
    return extraction(df, Services(**services)).where(F.col("fields").isNotNull())


def redact_pii(spark, sf):
    return gv.redact_pii(prose(spark, sf), "text").select(
        "doc_id", F.md5("safe_text").alias("safe_md5"), "pii_redacted")


def model_route(spark, sf):
    safe = gv.redact_pii(prose(spark, sf), "text")
    return gv.route_model(safe, prefer_local=True).select(
        "doc_id", "model_tier", "model", F.col("max_tokens").cast("bigint").alias("max_tokens"), "cost_per_1k")


def prompt_rows(spark, sf):
    """Prompt versions out of ``part``: a name per brand and container size, re-registered at will."""
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("name"), F.concat(F.lit("v1."), (F.col("p_partkey") % 13).cast("string")).alias("version"),
        F.col("p_partkey").alias("loaded"), F.col("p_name").alias("system"))


def prompt_latest(spark, sf):
    return pr.latest(pr.registered(prompt_rows(spark, sf), "loaded")).select("name", "version", "system")


def build_prompt(spark, sf):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("denial_eob", "prior_auth", "referral", "claim_837", "eligibility")]),
                         (F.col("doc_id") % 5 + 1).cast("int"))
    df = pr.build_prompt(prose(spark, sf).withColumn("document_type", kinds), "text")
    return df.select("doc_id", F.md5("system").alias("system_md5"), F.md5("user").alias("user_md5"),
                     F.length("user").cast("bigint").alias("user_length"))


def _fields(df):
    """One row per extracted field."""
    f = F.col("f")
    return df.select("file", F.posexplode("fields").alias("i", "f")).select(
        "file", f["field_name"].alias("field_name"), f["value"].alias("value"), f["confidence"].alias("confidence"))


def _source(spark, sf, source):
    return _fields(live(spark, sf, source))


def extract_json(spark, sf):
    return _fields(live(spark, sf, "fhir_r4", "webhook"))


def extract_hl7(spark, sf):
    return _source(spark, sf, "hl7v2")


def extract_edi(spark, sf):
    return _source(spark, sf, "edi837")


def extract_text(spark, sf):
    return _source(spark, sf, "fax")


def extract_dispatch(spark, sf):
    """Fields per document of all kinds, before enrichment."""
    return live(spark, sf).select(
        "file", F.size("fields").cast("bigint").alias("n_fields"), "mean_confidence",
        F.array_join("low_conf_fields", "|").alias("low_conf_fields"))


def extract_prose(spark, sf):
    """The extractor on prose: whole texts, nothing cut at the prompt length."""
    df = extract_builtin(prose(spark, sf).withColumnRenamed("text", "safe_text"))
    return df.select("doc_id", F.size("fields").cast("bigint").alias("n_fields"))


def replies(spark, sf):
    """Replies of every shape a model gives, made from the orders."""
    k, ks = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    conf = ((k * 7) % 131 / 100).cast("string")
    one = F.concat(F.lit('{"patient_name": {"value": "N'), ks, F.lit('", "confidence": '), conf,
                   F.lit(', "source": "ocr"}, "payer_id": "P'), (k % 9).cast("string"),
                   F.lit('", "claim_number": null, "auth_number": {"value": ""}, "custom": {"value": 5}, "diagnosis_codes": ['),
                   F.lit('{"value": "M54.5", "confidence": 0.55}, "I10", {"value": null}], "procedure_codes": "99213"}'))
    reply = (F.when(k % 8 == 0, F.concat(F.lit("```json\n"), one, F.lit("\n```")))
             .when(k % 8 == 1, F.concat(F.lit("Here: "), one, F.lit(" end")))
             .when(k % 8 == 2, F.lit("not json")).when(k % 8 == 3, F.lit(""))
             .when(k % 8 == 4, F.lit('["a"]')).when(k % 8 == 5, F.lit('{"patient_name": {"value": "X", "confidence": "high"}}'))
             .otherwise(one))
    return spread(table(spark, sf, "orders").select("o_orderkey")).select("o_orderkey", reply.alias("reply"))


def parse_reply_(spark, sf):
    return parse_reply(replies(spark, sf)).select(
        "o_orderkey", F.size("fields").cast("bigint").alias("n_fields"), "mean_confidence",
        F.array_join("low_conf_fields", "|").alias("low"), F.size("extraction_warnings").cast("bigint").alias("n_warnings"),
        fl.value(F.col("fields"), "patient_name").alias("patient_name"),
        F.array_join(fl.values(F.col("fields"), "diagnosis_codes"), "|").alias("dx"))


def enrich_npi(spark, sf):
    """Customers are the registry: it grows with the data, so its size decides the join."""
    customers = table(spark, sf, "customer").where(F.col("c_custkey") % 3 != 0)
    registry = customers.select(F.concat(F.lit("1"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("npi"))
    return live(spark, sf, registry=registry).select("file", "npi_validated")


def enrich_codes(spark, sf):
    return done(spark, sf).select("file", "npi_validated", "codes_validated",
                                  F.array_join("extraction_warnings", "|").alias("warnings"))


def enrich_codes_table(spark, sf):
    """Line items' part codes against a reference as large as ``part``, through the joined path."""
    items = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_partkey").cast("string").alias("code"))
    reference = table(spark, sf, "part").where(F.col("p_size") > 10).select(F.col("p_partkey").cast("string"))
    lost = en.unknown_by_document(items, reference, rows=1000, salts=8)
    return lost.select("document_id", F.array_join(F.sort_array("unknown"), "|").alias("unknown"))


def registry_rows(spark, sf):
    """Line items' suppliers and two of three customers as a registry with repeats; far above the bound given with it."""
    customers = table(spark, sf, "orders").where(F.col("o_custkey") % 3 != 0).select(
        F.concat(F.lit("1"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("npi"))
    others = table(spark, sf, "lineitem").select(F.concat(F.lit("2"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("npi"))
    return customers.unionByName(others)


def enrich_npi_registry(spark, sf):
    """The phase with a registry beyond the broadcast bound: a membership test, no record is shuffled."""
    return live(spark, sf, registry=registry_rows(spark, sf), broadcast_rows=100).select(
        "file", "npi_validated", F.array_join("extraction_warnings", "|").alias("warnings"))


def code_tables(spark, sf):
    """Code systems as large as ``orders``: some of the documents' codes and one more per order."""
    table(spark, sf, "orders").select("o_orderkey").createOrReplaceTempView("code_orders")
    return {name: spark.sql(text.replace("FROM orders", "FROM code_orders")) for name, text in CODE_TABLES.items()}


def enrich_codes_full(spark, sf):
    """The phase with code systems above the size of a literal set; extraction runs once."""
    return live(spark, sf, **code_tables(spark, sf)).select(
        "file", "codes_validated", F.array_join("extraction_warnings", "|").alias("warnings"))


def ocr_penalty(spark, sf):
    df = passed(spark, sf, "extracted").where(F.col("fields").isNotNull() & F.col("ocr_mean_confidence").isNotNull())
    low = F.array_min(F.transform("fields", lambda f: f["confidence"]))
    return df.select("file", "ocr_mean_confidence", "mean_confidence", low.alias("lowest"))


def completeness(spark, sf):
    return done(spark, sf).select("file", "completeness")


def needs_review(spark, sf):
    return en.needs_review(done(spark, sf)).select("file", "needs_review")


def token_costs(spark, sf):
    """User turns with the answers that follow; keys are unique, so no conversation is gathered."""
    turns = table(spark, sf, "conversations")
    ask = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user"))
    answer = turns.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    models = F.element_at(F.array(*[F.lit(m) for m in ("gpt-4o", "claude-haiku-4-5-20251001", "mistral", "other")]), (F.col("conv_id") % 4 + 1).cast("int"))
    calls = ask.join(answer, ["conv_id", "turn"], "left").withColumns({
        "system": F.lit(fx.CLASSIFY_SYSTEM), "model": models})
    return token_cost(calls, "system", "user", "reply").select(
        "conv_id", "turn", "model", "input_tokens", "output_tokens", "cost_usd")


def batch_inference_(spark, sf):
    """The model hook with a stand-in model over every prose document."""
    def answer(system, user):
        if len(user) % 7 == 0:
            raise RuntimeError("model unavailable")
        return '{"patient_name": {"value": "n%d", "confidence": 0.9}}' % (len(user) % 10)

    docs = prose(spark, sf).withColumnRenamed("text", "safe_text").withColumn("document_type", F.lit("referral"))
    return batch_inference(docs, answer).select(
        "doc_id", F.size("fields").alias("n_fields"), "mean_confidence", "extraction_error",
        F.col("reply_call.success").alias("success"), F.col("reply_call.input_tokens").alias("input_tokens"))


def call_attempts(spark, sf):
    """Calls that overlap, fail by the prompt's length and are repeated: a record for every attempt."""
    tried = {}

    def answer(system, user):
        import threading

        lane, needed = threading.get_ident(), len(user) % 5
        tried[lane] = tried.get(lane, 0) + 1
        if tried[lane] <= needed:
            tried[lane] %= 3  # the third attempt is the last
            raise RuntimeError(f"busy {needed}")
        tried[lane] = 0
        return "{}"

    docs = prose(spark, sf).withColumnRenamed("text", "safe_text").withColumn("document_type", F.lit("referral"))
    made = batch_inference(docs, answer, limits=CallLimits(lanes=8, retries=2, wait_s=0.0))
    a = F.col("a")
    return made.select("doc_id", F.explode("reply_call.attempts").alias("a")).select(
        "doc_id", a["attempt"].cast("bigint").alias("attempt"), a["success"].alias("success"), a["error"].alias("error"))


def model_calls(spark, sf):
    return call_records(passed(spark, sf, "extracted")).select(
        "document_id", "model", "prompt_name", "input_tokens", "cost_usd", "success")


def call_metering(spark, sf):
    return call_summary(call_records(passed(spark, sf, "extracted")))


QUERIES = {f.__name__.rstrip("_"): f for f in (
    redact_pii, model_route, prompt_latest, build_prompt, extract_json, extract_hl7, extract_edi,
    extract_text, extract_dispatch, extract_prose, batch_inference_, parse_reply_, enrich_npi, enrich_codes,
    enrich_npi_registry, enrich_codes_full, enrich_codes_table, ocr_penalty, completeness, needs_review, token_costs, call_attempts, model_calls, call_metering)}

FIELD_ROWS = "SELECT file, q.n AS field_name, q.v AS value, q.c AS confidence FROM (SELECT file, source, unnest(f) AS q FROM extracted WHERE closed2 IS NULL) WHERE source IN ({s})"
PROMPT_CASE = "CASE doc_id % 5 " + " ".join(
    f"WHEN {i} THEN md5('{pr.system_prompt(k)}')" for i, k in enumerate(("denial_eob", "prior_auth", "referral", "claim_837"))) + f" ELSE md5('{pr.system_prompt('eligibility')}') END"
NPI_TEN = "coalesce(regexp_matches(extracted.npi, '^\\d{10}$'), false)"
NPI_OK = "regexp_matches(npi, '^1\\d{9}$')"
PRICE = "CASE model " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in fx.PRICES.items()) + " ELSE 0.003::DOUBLE END"

ORACLES = {
    "redact_pii": f"SELECT doc_id, md5({S.redact('text')}) AS safe_md5, {S.redact('text')} <> text AS pii_redacted FROM documents",
    "model_route": f"""WITH s AS (SELECT doc_id, len({S.redact('text')}) AS n FROM documents), t AS (
        SELECT doc_id, CASE WHEN n > 5000 THEN 'premium' WHEN n <= 1000 THEN 'local_slm' ELSE 'standard' END AS model_tier FROM s)
        SELECT doc_id, model_tier, CASE model_tier WHEN 'premium' THEN 'claude-opus-4-6' WHEN 'local_slm' THEN 'llama3.2' ELSE 'claude-sonnet-4-20250514' END AS model,
        CASE model_tier WHEN 'premium' THEN 8192 WHEN 'local_slm' THEN 2048 ELSE 4096 END AS max_tokens,
        CASE model_tier WHEN 'premium' THEN 0.015 WHEN 'local_slm' THEN 0.0 ELSE 0.003 END::DOUBLE AS cost_per_1k FROM t""",
    "prompt_latest": """WITH p AS (SELECT p_brand AS name, concat('v1.', p_partkey % 13) AS version, p_partkey, p_name AS system FROM part),
        r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY concat(name, ':', version) DESC, p_partkey DESC) AS rn FROM p)
        SELECT name, version, system FROM r WHERE rn = 1""",
    "build_prompt": f"""WITH m AS (SELECT doc_id, concat('DOCUMENT:', chr(10), left(text, 6000), CASE WHEN len(text) > 6000 THEN concat(chr(10), chr(10), '[truncated to 6000 chars]') ELSE '' END) AS u FROM documents)
        SELECT doc_id, {PROMPT_CASE} AS system_md5, md5(u) AS user_md5, len(u) AS user_length FROM m""",
    "extract_json": S.query(S.EXTRACTED, FIELD_ROWS.format(s="'fhir_r4', 'webhook'")),
    "extract_hl7": S.query(S.EXTRACTED, FIELD_ROWS.format(s="'hl7v2'")),
    "extract_edi": S.query(S.EXTRACTED, FIELD_ROWS.format(s="'edi837'")),
    "extract_text": S.query(S.EXTRACTED, FIELD_ROWS.format(s="'fax'")),
    "extract_dispatch": S.query(S.EXTRACTED, "SELECT file, len(f) AS n_fields, mean_conf AS mean_confidence, '' AS low_conf_fields FROM extracted WHERE closed2 IS NULL"),
    "parse_reply": f"""WITH b AS (SELECT o_orderkey AS k, least(1.0, ((o_orderkey * 7) % 131) / 100.0)::DOUBLE AS c FROM orders),
        p AS (SELECT *, k % 8 IN (0, 1, 6, 7) AS good, [c, 0.75, 0.8, 0.55, 0.75] AS cs FROM b)
        SELECT k AS o_orderkey, CASE WHEN good THEN 4 ELSE 0 END AS n_fields,
        CASE WHEN good THEN {S.half_even("list_sum(cs) / 5", 4)} ELSE 0.0 END AS mean_confidence,
        CASE WHEN good THEN concat(CASE WHEN c < 0.6 THEN 'patient_name|' ELSE '' END, 'diagnosis_codes') ELSE '' END AS low,
        CASE WHEN k % 8 IN (1, 2, 3, 4, 5) THEN 1 ELSE 0 END AS n_warnings,
        CASE WHEN good THEN concat('N', k) END AS patient_name, CASE WHEN good THEN 'M54.5|I10' ELSE '' END AS dx FROM p""",
    "enrich_npi": S.query(S.EXTRACTED, f"""SELECT file, CASE WHEN {NPI_OK} THEN
        npi IN (SELECT concat('1', lpad(cast(c_custkey AS string), 9, '0')) FROM customer WHERE c_custkey % 3 <> 0) ELSE false END AS npi_validated
        FROM extracted WHERE closed2 IS NULL"""),
    "enrich_codes": S.query(S.EXTRACTED, """SELECT file, npi_ok AS npi_validated, len(bad_dx) + len(bad_px) = 0 AS codes_validated,
        array_to_string(warnings, '|') AS warnings FROM extracted WHERE closed2 IS NULL"""),
    "enrich_npi_registry": S.query(S.EXTRACTED, f"""SELECT file, coalesce({NPI_TEN} AND known.npi IS NOT NULL, false) AS npi_validated,
        array_to_string(list_concat(CASE WHEN {NPI_TEN} AND known.npi IS NULL THEN [concat('NPI not found in registry: ', extracted.npi)] ELSE [] END,
          list_filter(warnings, lambda w: NOT starts_with(w, 'NPI not'))), '|') AS warnings
        FROM extracted LEFT JOIN (
          SELECT concat('1', lpad(cast(o_custkey AS string), 9, '0')) AS npi FROM orders WHERE o_custkey % 3 <> 0
          UNION SELECT concat('2', lpad(cast(l_orderkey AS string), 9, '0')) FROM lineitem) known USING (npi) WHERE closed2 IS NULL"""),
    "enrich_codes_full": S.query(S.EXTRACTED + f""", icd AS ({CODE_TABLES['icd10']}), cpt AS ({CODE_TABLES['cpt']}),
        lost_dx AS (SELECT coalesce(list(DISTINCT c), []) AS lost FROM (SELECT upper(unnest(v_diagnosis_codes)) AS c FROM extracted) WHERE c NOT IN (SELECT code FROM icd WHERE code IS NOT NULL)),
        lost_px AS (SELECT coalesce(list(DISTINCT c), []) AS lost FROM (SELECT unnest(v_procedure_codes) AS c FROM extracted) WHERE c NOT IN (SELECT code FROM cpt)),
        tested AS (SELECT *, CASE WHEN broken THEN [] ELSE list_filter(v_diagnosis_codes, lambda c: list_contains(lost_dx.lost, upper(c))) END AS no_dx,
          CASE WHEN broken THEN [] ELSE list_filter(v_procedure_codes, lambda c: list_contains(lost_px.lost, c)) END AS no_px
          FROM extracted, lost_dx, lost_px WHERE closed2 IS NULL)""", """SELECT file, len(no_dx) + len(no_px) = 0 AS codes_validated,
        array_to_string(list_concat(list_filter(warnings, lambda w: NOT (starts_with(w, 'ICD-10 not') OR starts_with(w, 'CPT not'))),
          list_transform(no_dx, lambda c: concat('ICD-10 not in reference table: ', c)), list_transform(no_px, lambda c: concat('CPT not in reference table: ', c))), '|') AS warnings FROM tested"""),
    "enrich_codes_table": """SELECT document_id, array_to_string(list(code ORDER BY code), '|') AS unknown FROM (
        SELECT DISTINCT l_orderkey::VARCHAR AS document_id, l_partkey::VARCHAR AS code FROM lineitem
        WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)) GROUP BY document_id""",
    "ocr_penalty": S.query(S.EXTRACTED, """SELECT file, ocr AS ocr_mean_confidence, mean_conf AS mean_confidence,
        list_min(list_transform(f, lambda q: q.c)) AS lowest FROM extracted WHERE closed2 IS NULL AND ocr IS NOT NULL"""),
    "completeness": S.query(S.EXTRACTED, "SELECT file, complete AS completeness FROM extracted WHERE closed2 IS NULL"),
    "needs_review": S.query(S.EXTRACTED, "SELECT file, mean_conf < 0.55 AS needs_review FROM extracted WHERE closed2 IS NULL"),
    "call_attempts": """WITH m AS (SELECT doc_id, (len(text[:6000]) + 10 + CASE WHEN len(text) > 6000 THEN len('[truncated to 6000 chars]') + 2 ELSE 0 END) % 5 AS needed FROM documents WHERE text IS NOT NULL),
        t AS (SELECT doc_id, needed, unnest(range(least(needed, 2) + 1)) AS attempt FROM m)
        SELECT doc_id, attempt, attempt >= needed AS success, CASE WHEN attempt < needed THEN concat('busy ', needed) END AS error FROM t""",
    "token_costs": f"""WITH c AS (SELECT a.conv_id, a.turn, a.text AS u, b.text AS r,
          ['gpt-4o', 'claude-haiku-4-5-20251001', 'mistral', 'other'][1 + a.conv_id % 4] AS model
        FROM (SELECT * FROM conversations WHERE role = 'user') a LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') b
          ON a.conv_id = b.conv_id AND a.turn = b.turn - 1),
        t AS (SELECT *, CASE WHEN r IS NULL THEN 0 ELSE {S.words(f"concat('{fx.CLASSIFY_SYSTEM}', u)")} * 4 // 3 END AS i,
          CASE WHEN r IS NULL THEN 0 ELSE {S.words('r')} * 4 // 3 END AS o FROM c)
        SELECT conv_id, turn, model, i AS input_tokens, o AS output_tokens, {S.half_even(f"(i + o)::DOUBLE / 1000.0::DOUBLE * {PRICE}", 6)} AS cost_usd FROM t""",
}
