"""Queries over classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimflow.operators import classify as cl
from claimflow.operators.rules import apply_rules, top_two
from claimflow.operators.ruletable import rule_signals
from claimflow.operators.textmodel import TextModel
from claimflow.session import scratch
from claimflow.sources.landing import spread

from . import sql as S
from .corpus import table
from .stages import classified, ingested, live_classified, passed


def source_hint(spark, sf):
    df = ingested(spark, sf).where(F.col("disposition").isNull())
    return df.select("file", cl.source_hint().alias("declared_type"))


def scored(spark, sf):
    docs = ingested(spark, sf).where(F.col("disposition").isNull()).select("file", "full_text")
    return apply_rules(docs)


def rule_scores(spark, sf):
    """Every rule on every valid document, one row per signal."""
    s = F.col("s")
    return scored(spark, sf).select("file", F.explode("signals").alias("s")).select(
        "file", s["document_type"].alias("document_type"), s["confidence"].alias("confidence"),
        s["matched_rule"].alias("matched_rule"))


def rule_scores_prose(spark, sf):
    """The same rules on whole prose documents, where most patterns never match."""
    docs = spread(table(spark, sf, "documents").select("doc_id", F.col("text").alias("full_text")))
    return apply_rules(docs).select("doc_id", F.size("signals").cast("bigint").alias("n_signals"))


RULE_TABLE = """SELECT p_brand AS document_type, CASE p_partkey % 3 WHEN 0 THEN concat(chr(92), 'bclm', cast(p_partkey AS string), chr(92), 'b')
    WHEN 1 THEN concat('mrn-', cast(p_partkey AS string), chr(92), 'b') ELSE concat('claim.*clm', cast(p_partkey AS string)) END AS pattern,
    CASE p_partkey % 3 WHEN 1 THEN concat('mrn-', cast(p_partkey AS string)) ELSE concat('clm', cast(p_partkey AS string)) END AS word,
    0.9 AS base, p_partkey AS ord FROM part"""


def rule_table(spark, sf):
    """A rule for every part, grouped by brand, over every valid document; the rules stay a table, however many."""
    table(spark, sf, "part").select("p_partkey", "p_brand").createOrReplaceTempView("rule_parts")
    rules = spark.sql(RULE_TABLE.replace("FROM part", "FROM rule_parts"))
    docs = ingested(spark, sf).where(F.col("disposition").isNull()).select("file", "full_text")
    return rule_signals(docs, rules, "file").select(
        "file", "document_type", F.round("confidence", 3).alias("confidence"), "matched_rule")


def rank_signals(spark, sf):
    names = F.transform("signals", lambda s: F.concat_ws(":", s["document_type"], F.format_string("%.4f", s["confidence"])))
    return scored(spark, sf).select("file", F.array_join(names, "|").alias("ranked"))


def top2(spark, sf):
    return top_two(scored(spark, sf)).select(
        "file", "top_type", "top_confidence", "matched_rule", "runner_up_type", "runner_up_conf")


def cascade(spark, sf):
    c = F.col("classification")
    return live_classified(spark, sf).where(c.isNotNull()).select(
        "file", c["document_type"].alias("document_type"), c["confidence"].alias("confidence"),
        c["method"].alias("method"), c["runner_up_type"].alias("runner_up_type"),
        c["runner_up_conf"].alias("runner_up_conf"))


def routing_join(spark, sf):
    df = classified(spark, sf).where(F.col("classification").isNotNull())
    return cl.route(df).groupBy("document_type", "routing_queue", "high_priority").agg(F.count(F.lit(1)).alias("n"))


def classification_close_out(spark, sf):
    return classified(spark, sf).select(
        "file", "document_type", F.coalesce("disposition", F.lit("")).alias("disposition"),
        F.size("errors").cast("bigint").alias("n_errors"))


def documents_by_type(spark, sf):
    """Documents by type, method and queue, and how many reach a person."""
    c = F.col("classification")
    return passed(spark, sf, "classified").where(c.isNotNull()).groupBy(
        "document_type", c["method"].alias("method"), c["routing_queue"].alias("routing_queue")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("disposition") == "human_review").alias("n_review"),
        F.round(F.avg(c["confidence"]), 4).alias("mean_confidence"))


def type_reply(spark, sf):
    """Model replies to a type question, read back; the replies come from the orders."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("REFERRAL", "prior_auth", "nonsense", "unknown", "claim_837")]), (k % 5 + 1).cast("int"))
    body = F.concat(F.lit('{"type": "'), kind, F.lit('", "confidence": '), ((k % 31) / 20).cast("string"), F.lit(', "reasoning": "r"}'))
    reply = (F.when(k % 7 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
             .when(k % 7 == 1, F.concat(F.lit("Sure: "), body, F.lit(" done")))
             .when(k % 7 == 2, F.lit("no idea")).when(k % 7 == 3, F.lit('{"type": "referral"}')).otherwise(body))
    df = table(spark, sf, "orders").select("o_orderkey", reply.alias("reply"))
    return df.select("o_orderkey", *[c.alias(n) for n, c in cl.read_type_reply(F.col("reply")).items()])


def labelled_documents(spark, sf):
    """All labelled documents, by the given quality label."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return docs.join(labels, "doc_id")


def train_text_model(spark, sf):
    model = TextModel.train(labelled_documents(spark, sf), vocabulary=20_000, min_documents=2, iterations=1000)
    return spark.createDataFrame([(n, len(model.idf)) for n in model.labels], "label string, terms long")


def predict_top2(spark, sf):
    """The seed model over every derived document that hint and rules left undecided, and every prose document."""
    model = TextModel.seed(spark)
    prose = table(spark, sf, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("id"), "text")
    undecided = classified(spark, sf).where(F.col("classification.method").isin("rules_only", "no_signal")).select(
        F.col("record_id").alias("id"), F.col("full_text").alias("text"))
    return model.score(spread(prose).unionByName(undecided), "text").select("id", "tm_type", "tm_conf", "tm_second", "tm_second_conf")


def model_persist(spark, sf):
    """Train on the labelled documents, save, load and score with what was loaded."""
    path = scratch(spark, "textmodel")
    TextModel.train(labelled_documents(spark, sf), vocabulary=20_000, min_documents=2, iterations=1000).save(path)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return TextModel.load(path).score(spread(docs), "text").select("doc_id", "tm_type", "tm_conf")


def model_call_tier(spark, sf):
    """The pluggable model tier on prose; the stand-in answers by the excerpt's length."""
    def answer(system, user):
        if len(user) % 5 == 0:
            raise ValueError("model unavailable")
        return '{"type": "clinical_note", "confidence": %s}' % (0.9 if len(user) > 500 else 0.6)

    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return cl.model_tier(docs, answer, "text").select("doc_id", "reply_type", "reply_confidence", "reply_reasoning")


QUERIES = {f.__name__: f for f in (
    source_hint, rule_scores, rule_scores_prose, rule_table, rank_signals, top2, cascade, routing_join,
    classification_close_out, documents_by_type, type_reply, train_text_model, predict_top2,
    model_persist, model_call_tier)}

SCORED = f"""{S.VALID},
scored AS (SELECT file, {S.signals('lower(full_text)')} AS sig FROM valid WHERE closed IS NULL)"""
REPLY = """
WITH bodies AS (
  SELECT o_orderkey AS k, ['REFERRAL', 'prior_auth', 'nonsense', 'unknown', 'claim_837'][1 + o_orderkey % 5] AS t, (o_orderkey % 31) / 20.0 AS c FROM orders
), typed AS (
  SELECT k, CASE WHEN k % 7 = 2 THEN NULL WHEN k % 7 = 3 THEN 'referral' ELSE lower(t) END AS t, CASE WHEN k % 7 = 3 THEN 0.5 ELSE c END AS c FROM bodies)
SELECT k AS o_orderkey, CASE WHEN t IN ('referral', 'prior_auth', 'claim_837') THEN t ELSE 'unknown' END AS document_type,
  CASE WHEN t IS NULL THEN 0.0 ELSE least(1.0, c) END::DOUBLE AS confidence,
  CASE WHEN t IS NULL THEN 'parse_error' WHEN k % 7 = 3 THEN '' ELSE 'r' END AS reasoning FROM typed"""

ORACLES = {
    "source_hint": S.query(S.VALID, f"SELECT file, {S.HINT} AS declared_type FROM valid WHERE closed IS NULL"),
    "rule_scores": S.query(SCORED, "SELECT file, s.type AS document_type, -s.neg AS confidence, s.rule AS matched_rule FROM (SELECT file, unnest(sig) AS s FROM scored)"),
    "rule_table": S.query(f"{S.VALID}, rules AS MATERIALIZED ({RULE_TABLE}), sizes AS (SELECT document_type, count(*) AS n, min(ord) AS first FROM rules GROUP BY ALL)",
        """, texts AS MATERIALIZED (SELECT file, lower(full_text) AS t FROM valid WHERE closed IS NULL),
        tokens AS (SELECT DISTINCT file, token FROM (SELECT file, unnest(regexp_extract_all(t, '(?:clm|mrn-)[0-9]+')) AS token FROM texts)),
        heads AS (SELECT DISTINCT file, left(token, unnest(range(4, len(token) + 1))::INT) AS word FROM tokens),
        hits AS (SELECT file, document_type, pattern, ord FROM heads JOIN rules USING (word) JOIN texts USING (file) WHERE regexp_matches(t, pattern, 's')),
        found AS (SELECT file, document_type, count(*) AS h, arg_min(pattern, ord) AS matched_rule FROM hits GROUP BY ALL)
        SELECT file, document_type, round(least(0.99, 0.9 * (0.7 + 0.3 * least(1.0, h / n * 4))), 3) AS confidence, matched_rule FROM found JOIN sizes USING (document_type)"""),
    "rule_scores_prose": f"SELECT doc_id, len({S.signals('lower(text)')}) AS n_signals FROM documents",
    "rank_signals": S.query(SCORED, "SELECT file, array_to_string(list_transform(sig, lambda s: concat(s.type, ':', printf('%.4f', -s.neg))), '|') AS ranked FROM scored"),
    "top2": S.query(SCORED, """SELECT file, sig[1].type AS top_type, -sig[1].neg AS top_confidence, sig[1].rule AS matched_rule,
        sig[2].type AS runner_up_type, -sig[2].neg AS runner_up_conf FROM scored"""),
    "cascade": S.query(S.CLASSIFIED, """SELECT file, kind AS document_type, class_conf AS confidence, method, ru_type AS runner_up_type, ru_conf AS runner_up_conf
        FROM classified WHERE kind IS NOT NULL"""),
    "routing_join": S.query(S.CLASSIFIED, f"""SELECT kind AS document_type, {S.queue('kind')} AS routing_queue, kind IN ('prior_auth', 'denial_eob') AS high_priority,
        count(*) AS n FROM classified WHERE kind IS NOT NULL GROUP BY ALL"""),
    "classification_close_out": S.query(S.CLASSIFIED, """SELECT file, coalesce(kind, 'unknown') AS document_type, coalesce(closed2, '') AS disposition,
        CASE WHEN error IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN kind = 'unknown' THEN 1 ELSE 0 END AS n_errors FROM routed"""),
    "documents_by_type": S.query(S.CLASSIFIED, f"""SELECT kind AS document_type, method, {S.queue('kind')} AS routing_queue, count(*) AS n,
        count(*) FILTER (closed2 = 'human_review') AS n_review, round(avg(class_conf), 4) AS mean_confidence FROM routed WHERE kind IS NOT NULL GROUP BY ALL"""),
    "type_reply": REPLY,
}
