"""Registered queries of the operators, with their DuckDB counterparts where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimflow.llm import (
    exact_dedup, fill_middle, html, jaccard, language, line_dedup, mixing, packing, quality, suffix_dedup, topk,
    vector_codes, warc,
)

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(back).alias("restored_sha256"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.without_lines(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_html_extraction, op2_exact_dedup, op3_quality_classifier, op4_suffix_dedup, op5_ngram_jaccard, op6_top_k, op7_language_id, op8_mixing, op9_warc,
    op10_best_fit_packing, op11_vector_codes, op12_fill_in_middle, op13_line_dedup)}


def _codes_sql(rounds: int = 4) -> str:
    """The rounds written out: assignments ``a1 ...`` to codebooks ``c0 ...``, each from the one before."""
    assigned = """
        a{k} AS MATERIALIZED (
            SELECT w.vec_id, w.label, w.p, w.w, min((w.q + c.q - 2 * list_inner_product(w.w, c.w))::BIGINT * 256 + c.e) AS m
            FROM parts w JOIN c{b} c USING (p) GROUP BY ALL)"""
    means = """,
        s{k} AS (
            SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS n
            FROM (SELECT p, m % 256 AS e, unnest(range(len(w))) AS i, unnest(w)::BIGINT AS x FROM a{k}) GROUP BY p, e, i),
        m{k} AS (SELECT p, e, list(((s - (s % n + n) % n) // n)::DOUBLE ORDER BY i) AS w FROM s{k} GROUP BY p, e),
        c{k} AS MATERIALIZED (
            SELECT p, e, w, list_inner_product(w, w) AS q
            FROM (SELECT c.p, c.e, coalesce(m.w, c.w) AS w FROM c{b} c LEFT JOIN m{k} m USING (p, e))),"""
    body = "".join((assigned + means).format(k=k, b=k - 1) for k in range(1, rounds + 1))
    return """
        WITH usable AS (
            SELECT vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        parts AS MATERIALIZED (
            SELECT vec_id, label, p, w, list_inner_product(w, w) AS q
            FROM (SELECT vec_id, label, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS w FROM usable, range(4) t(p))),
        c0 AS MATERIALIZED (
            SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, w, q FROM parts
            WHERE vec_id IN (SELECT vec_id FROM usable ORDER BY vec_id LIMIT 256)),""" + body + assigned.format(
        k=rounds + 1, b=rounds) + """,
        coded AS (
            SELECT vec_id, label, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error
            FROM a{n} GROUP BY vec_id, label),
        book AS (
            SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
            FROM (SELECT p, e, unnest(range(len(w))) AS i, unnest(w) AS x FROM c{r}))
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
        FROM coded, book""".format(n=rounds + 1, r=rounds)


ORACLES = {
    "op2_exact_dedup": """
        WITH keyed AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents),
        groups AS (
            SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM keyed GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM keyed JOIN groups USING (text_sha256)""",
    "op6_top_k": """
        WITH usable AS (
            SELECT vec_id, embedding FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        ints AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM usable),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM ints q JOIN ints c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 20 = 0),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
        SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 20""",
    "op9_warc": """
        WITH rows AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   sha1(coalesce(html, '')) AS payload_digest
            FROM pages),
        tops AS (
            SELECT payload_digest, max(page_id) AS top FROM rows WHERE payload_bytes >= 1000
            GROUP BY payload_digest HAVING count(*) > 1)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, rows.payload_digest,
               CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END
                   AS record_type,
               CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
        FROM rows LEFT JOIN tops USING (payload_digest)""",
    "op11_vector_codes": _codes_sql(),
    "op12_fill_in_middle": """
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts,
                   sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digest
            FROM documents),
        counted AS (
            SELECT *, len(parts) - (parts[-1] = '')::INT AS n, ('0x' || digest[1:8])::BIGINT AS h1,
                   ('0x' || digest[9:16])::BIGINT AS h2, ('0x' || digest[25:32])::BIGINT AS h4
            FROM texts),
        placed AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                        THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM counted),
        ends AS (
            SELECT *, length(array_to_string(parts[1:a], chr(10))) + (a > 0 AND a < len(parts))::INT AS p_end,
                   length(array_to_string(parts[1:b], chr(10))) + (b > 0 AND b < len(parts))::INT AS m_end
            FROM placed),
        made AS (
            SELECT *, substr(text, 1, p_end) AS prefix, substr(text, p_end + 1, m_end - p_end) AS middle,
                   substr(text, m_end + 1) AS suffix
            FROM ends)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                      ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM made""",
    "op13_line_dedup": """
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        cut AS (
            SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(len(string_split(text, chr(10))))) AS i
            FROM texts),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM cut),
        common AS (
            SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key
            HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 3),
        marked AS (
            SELECT keyed.*, common.key IS NOT NULL AND doc_id IS DISTINCT FROM top AS gone
            FROM keyed LEFT JOIN common USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY r, doc_id""",
}
