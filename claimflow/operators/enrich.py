"""Reference-table checks, OCR penalty and completeness on the per-document field arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (
    CPT_REFERENCE, ICD10_REFERENCE, LOW_FIELD, NPI_REGISTRY, OCR_PENALTY_BELOW, OCR_PENALTY_WEIGHT,
    REVIEW_THRESHOLD,
)
from ..functions import fields as fl
from ..functions.fence import settle
from ..functions.text import round_half_even
from ..session import written
from .lookup import BROADCAST_ROWS, LITERAL_ROWS, is_small, lookup_join
from .membership import exact_members


def enrich_npi(df: DataFrame, registry: DataFrame | None = None, spread: str = "record_id",
               rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``npi_validated``; a ten-digit NPI outside the registry adds a warning.

    ``registry`` has one row per ``npi``. Without it the fixed two-entry registry applies. A registry of
    up to ``rows`` rows is broadcast. A larger one becomes a membership test, for which the distinct NPIs
    of the frame are read beside it, so the frame should be a written table; its rows stay where they are.
    """
    npi = fl.value(F.col("fields"), "provider_npi")
    df = df.withColumn("_npi", F.when(F.rlike(npi, F.lit(r"^\d{10}$")), npi))
    if registry is None:
        df = df.withColumn("_known", F.col("_npi").isin([r[0] for r in NPI_REGISTRY]))
    else:
        test = None if is_small(registry, rows) else exact_members(df.select("_npi"), registry.select("npi"))
        if test is not None:
            df = df.withColumn("_known", test.known(F.col("_npi")))
        else:
            known = registry.select("npi").distinct().withColumn("_known", F.lit(True))
            df = lookup_join(df, known, "_npi", "npi", [spread], rows=rows)
    known = F.coalesce("_known", F.lit(False))
    lost = F.col("_npi").isNotNull() & ~known
    return df.withColumns({
        "npi_validated": F.col("_npi").isNotNull() & known,
        "extraction_warnings": F.when(lost, F.concat("extraction_warnings", F.array(
            F.concat(F.lit("NPI not found in registry: "), "_npi"))))
        .otherwise(F.col("extraction_warnings")),
    }).drop("_npi", "_known")


def unknown_by_document(codes: DataFrame, reference: DataFrame, rows: int = BROADCAST_ROWS,
                        salts: int = 32) -> DataFrame:
    """``(document_id, code)`` pairs to one row per document with the codes the table lacks.

    Equal pairs are merged before they are joined, so copies of one document cost one row, and
    each group is bounded by the codes of a single document.
    """
    pairs = codes.distinct()
    table = reference.select(F.col(reference.columns[0]).alias("ref")).distinct().withColumn(
        "_hit", F.lit(True))
    joined = lookup_join(pairs, table, "code", "ref", ["document_id"], rows=rows, salts=salts)
    lost = joined.where(F.col("_hit").isNull())
    return lost.groupBy("document_id").agg(F.collect_set("code").alias("unknown"))


CODE_SYSTEMS = {"diagnosis_codes": ("dx", F.upper, ICD10_REFERENCE), "procedure_codes": ("px", lambda c: c, CPT_REFERENCE)}


def code_pairs(df: DataFrame) -> DataFrame:
    """``(document_id, system, code)`` for every code of both lists, as spelled in the reference tables."""
    def listed(name: str) -> Column:
        system, spelled, _ = CODE_SYSTEMS[name]
        return F.transform(fl.values(F.col("fields"), name), lambda c: F.struct(
            F.lit(system).alias("system"), spelled(c).alias("code")))

    return df.select("document_id", F.inline(F.concat(*[listed(name) for name in CODE_SYSTEMS])))


def unknown_codes(pairs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Dictionary check: ``(system, code)`` of the corpus that the system's table lacks.

    The codes are made distinct first, so the work after that follows the vocabulary and not the corpus,
    and no code is hot. Systems without a table are not looked at.
    """
    kept = pairs.where(F.col("system").isin(list(tables))).select("system", "code").where(F.col("code").isNotNull()).distinct()
    known = None
    for system, t in tables.items():
        one = t.select(F.lit(system).alias("system"), F.col(t.columns[0]).cast("string").alias("code"))
        known = one if known is None else known.unionByName(one)
    return kept.join(known, ["system", "code"], "left_anti")


def _by_document(df: DataFrame, pairs: DataFrame, unknown: DataFrame, rows: int) -> DataFrame:
    """Many unknown codes: they are joined to the narrow pairs and come back as two arrays a document."""
    key = F.concat_ws("\u001f", "system", "code")
    marked = pairs.distinct().withColumn("key", key)
    hits = lookup_join(marked, unknown.select(key.alias("lost")), "key", "lost", ["document_id"], "inner", rows)
    lists = hits.groupBy(F.col("document_id").alias("_doc")).agg(*[
        F.collect_set(F.when(F.col("system") == system, F.col("code"))).alias(f"_lost_{system}")
        for system, _, _ in CODE_SYSTEMS.values()])
    return df.join(lists, df["document_id"] == lists["_doc"], "left").drop("_doc")


def enrich_codes(df: DataFrame, icd10: DataFrame | None = None, cpt: DataFrame | None = None,
                 literal_rows: int = LITERAL_ROWS, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``codes_validated`` and a warning per code outside its reference table.

    Diagnosis codes compare in upper case. A table of up to ``literal_rows`` codes becomes a hash set
    inside the expression. For larger ones the corpus's distinct codes are checked against both tables in
    one pass, which reads the frame beside its own scan (so it should be a written table), and the unknown
    codes become the hash set. If they too are more than ``literal_rows``, they are joined by document.
    """
    sets, large = {}, {}
    for (name, (system, _, fixed)), table in zip(CODE_SYSTEMS.items(), (icd10, cpt), strict=True):
        if table is None:
            sets[name] = fixed
            continue
        # A NULL code would make every comparison with the set unknown.
        table = table.select(table.columns[0]).where(F.col(table.columns[0]).isNotNull())
        head = table.limit(literal_rows + 1).collect()
        if len(head) > literal_rows:
            large[system] = table
        else:
            sets[name] = [r[0] for r in head]
    lost = {}
    if large:
        pairs = code_pairs(df)
        unknown = written(unknown_codes(pairs, large), "unknown-codes")
        head = unknown.limit(literal_rows + 1).collect()
        if len(head) > literal_rows:
            df = _by_document(df, pairs, unknown, rows)
        else:
            lost = {system: [r["code"] for r in head if r["system"] == system] for system in large}

    def missing(name: str) -> Column:
        system, spelled, _ = CODE_SYSTEMS[name]
        codes = fl.values(F.col("fields"), name)
        if name in sets:
            return F.filter(codes, lambda c: ~spelled(c).isin(sets[name]))
        if system in lost:
            return F.filter(codes, lambda c: spelled(c).isin(lost[system]))
        return F.filter(codes, lambda c: F.coalesce(F.array_contains(f"_lost_{system}", spelled(c)), F.lit(False)))

    def warn(column: str, label: str) -> Column:
        return F.transform(column, lambda c: F.concat(F.lit(f"{label} not in reference table: "), c))

    df = df.withColumns({"_dx": missing("diagnosis_codes"), "_px": missing("procedure_codes")})
    return df.withColumns({
        "codes_validated": (F.size("_dx") == 0) & (F.size("_px") == 0),
        "extraction_warnings": F.concat("extraction_warnings", warn("_dx", "ICD-10"), warn("_px", "CPT")),
    }).drop("_dx", "_px", "_lost_dx", "_lost_px")


def enrich(df: DataFrame, registry: DataFrame | None = None, icd10: DataFrame | None = None,
           cpt: DataFrame | None = None, is_table: bool = False, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Both checks. A frame that is not a written table becomes one if a reference beyond its bound has it read twice."""
    bounds = ((registry, rows), (icd10, LITERAL_ROWS), (cpt, LITERAL_ROWS))
    if not is_table and any(t is not None and not is_small(t, n) for t, n in bounds):
        df = written(df, "extracted")
    return enrich_codes(enrich_npi(df, registry, rows=rows), icd10, cpt)


def ocr_penalty(df: DataFrame) -> DataFrame:
    """Lower every field's confidence on weak scans and recompute mean and weak fields.

    The recomputed mean leaves denial codes out.
    """
    ocr = F.col("ocr_mean_confidence")
    hit = F.coalesce(ocr < OCR_PENALTY_BELOW, F.lit(False))
    cut = F.greatest(F.lit(0.0), (F.lit(OCR_PENALTY_BELOW) - ocr) / OCR_PENALTY_BELOW) * OCR_PENALTY_WEIGHT
    lowered = F.transform("fields", lambda f: F.struct(
        f["field_name"].alias("field_name"), f["value"].alias("value"),
        round_half_even(F.greatest(F.lit(0.0), f["confidence"] - cut), 4).alias("confidence"),
        f["source"].alias("source")))
    df = df.withColumn("fields", F.when(hit, lowered).otherwise(F.col("fields")))
    counted = F.filter("fields", lambda f: f["field_name"] != "denial_reason_codes")
    df = df.withColumn("_counted", F.when(hit, counted))
    return settle(df.withColumns({
        "mean_confidence": F.when(hit, round_half_even(fl.mean_confidence(F.col("_counted")), 4))
        .otherwise(F.col("mean_confidence")),
        "low_conf_fields": F.when(hit, fl.low_names(F.col("_counted"), LOW_FIELD))
        .otherwise(F.col("low_conf_fields")),
    }).drop("_counted"))


def completeness(fields: Column) -> Column:
    def present(n: str) -> Column:
        return fl.has(fields, n).cast("int")

    coded = fl.has(fields, "diagnosis_codes") | fl.has(fields, "procedure_codes")
    found = sum((present(n) for n in ("patient_id", "payer_id", "service_date")), present("patient_name"))
    return F.round((found + coded.cast("int")) / 5.0, 2)


def score_completeness(df: DataFrame) -> DataFrame:
    return df.withColumn("completeness", completeness(F.col("fields")))


def needs_review(df: DataFrame) -> DataFrame:
    return df.withColumn("needs_review", F.col("mean_confidence") < REVIEW_THRESHOLD)
