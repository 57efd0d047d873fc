"""Registries and code systems beyond their bounds: the same answers, and no record moves."""

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from claimflow.operators import enrich as en
from claimflow.operators.infer import extract
from claimflow.operators.membership import build_filter, exact_members, passes
from claimflow.schemas import FIELDS
from workload import extract as we

SF = "/root/testdata/sf0.001"
FRAME = f"record_id string, document_id string, full_text string, fields {FIELDS}, extraction_warnings array<string>"


@pytest.fixture(scope="module")
def frame(spark, tmp_path_factory):
    """Records with a hot NPI, no NPI, a wrong one, repeated codes, NULL codes and lists that are empty."""
    rows = []
    for i in range(400):
        npi = "1000000007" if i % 3 == 0 else None if i % 5 == 0 else "12" if i % 7 == 0 else f"1{i:09d}"
        fields = [("provider_npi", npi, 0.9, "llm")] if npi else []
        fields += [("diagnosis_codes", c, 0.9, "llm") for c in ([f"a{i % 50}", f"A{i % 50}", "zz"] if i % 4 else [])]
        fields += [("procedure_codes", c, 0.9, "llm") for c in ([f"{i % 60}", None] if i % 6 else [])]
        rows.append((f"r{i}", f"d{i % 390}", "text " * 50, fields, ["before"]))
    path = str(tmp_path_factory.mktemp("frame"))
    spark.createDataFrame(rows, FRAME).repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def registry(spark):
    return spark.range(0, 5000).select(F.when(F.col("id") % 2 == 1, F.format_string("1%09d", "id")).alias("npi"))


def shown(df):
    return sorted(df.select("record_id", "npi_validated", F.array_join("extraction_warnings", "|")).collect())


def test_membership_test_equals_the_broadcast(frame, registry):
    small = en.enrich_npi(frame, registry)
    large = en.enrich_npi(frame, registry, rows=10)
    assert shown(large) == shown(small) and {r[1] for r in shown(large)} == {True, False}
    plan = large._jdf.queryExecution().toString()
    assert "getbit" in plan and "Exchange" not in large._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bits", [1, 2, 16])
def test_false_hits_go_back(spark, registry, bits):
    asked = spark.range(0, 3000).select(F.when(F.col("id") % 10 != 0, F.format_string("1%09d", "id")).alias("npi"))
    test = exact_members(asked, registry, bits_per_key=bits, false_hits=2000)
    wrong = asked.where(test.known(F.col("npi")) != (F.substring("npi", 2, 9).cast("int") % 2 == 1))
    assert wrong.count() == 0 and (bits == 16 or test.false_hits)
    assert asked.where(F.col("npi").isNull() & test.known(F.col("npi")).isNotNull()).count() == 0
    assert exact_members(asked, registry, bits_per_key=bits, max_words=1, false_hits=3) is None


def test_filter_admits_all_members_and_nothing_of_an_empty_table(spark, registry):
    keys = registry.where("npi IS NOT NULL")
    row = build_filter(keys, 100)
    assert keys.where(~passes(F.col("npi"), row, 100)).count() == 0 and row.count() == 1
    none = exact_members(keys, registry.where("false"))
    assert keys.where(none.known(F.col("npi"))).count() == 0


def test_without_a_filter_the_salted_join_answers(frame, registry, monkeypatch):
    monkeypatch.setattr(en, "exact_members", lambda *a: None)
    assert shown(en.enrich_npi(frame, registry, rows=10)) == shown(en.enrich_npi(frame, registry))


@pytest.fixture(scope="module")
def tables(spark):
    icd10 = spark.range(0, 3000).select(F.when(F.col("id") % 3 != 0, F.format_string("A%d", "id")).alias("code"))
    return icd10, spark.range(0, 2500).select((F.col("id") * 2).cast("string").alias("code"))


def codes(df):
    return sorted(df.select("record_id", "codes_validated", F.array_join("extraction_warnings", "|")).collect())


def plain_codes(frame):
    out = []
    for r in frame.collect():
        dx = [f.value for f in r.fields if f.field_name == "diagnosis_codes" and not (
            f.value.upper()[1:].isdigit() and f.value.upper()[0] == "A" and int(f.value[1:]) % 3)]
        px = [f.value for f in r.fields if f.field_name == "procedure_codes" and f.value is not None and int(f.value) % 2]
        warn = ["before"] + [f"ICD-10 not in reference table: {c}" for c in dx] + [f"CPT not in reference table: {c}" for c in px]
        out.append((r.record_id, not dx and not px, "|".join(warn)))
    return sorted(out)


@pytest.mark.parametrize("literal_rows,rows", [(100_000, 10), (100, 200_000), (5, 200_000), (5, 3)])
def test_code_systems_by_every_path(frame, tables, literal_rows, rows):
    """As hash sets, by the dictionary check, and with too many unknown codes by broadcast and salted joins."""
    got = codes(en.enrich_codes(frame, *tables, literal_rows=literal_rows, rows=rows))
    assert [tuple(r) for r in got] == plain_codes(frame)


def test_one_large_table_leaves_the_other_as_it_is(frame, tables):
    got = {r[0]: r[2] for r in codes(en.enrich_codes(frame, icd10=tables[0], literal_rows=100))}
    want = {r[0]: r[2] for r in codes(en.enrich_codes(frame, icd10=tables[0]))}
    assert got == want


def test_documents_are_extracted_once(spark, tables):
    asked = spark.sparkContext.accumulator(0)

    def call(system, user):
        asked.add(1)
        return '{"diagnosis_codes": [{"value": "A1", "confidence": 0.9}, {"value": "A3", "confidence": 0.9}]}'

    docs = spark.range(30).select(F.col("id").cast("string").alias("record_id"), F.col("id").cast("string").alias("document_id"),
                                  F.lit("some text").alias("full_text"), F.lit("referral").alias("document_type"),
                                  F.lit(None).cast("double").alias("ocr_mean_confidence"))
    out = extract(docs, call, icd10=tables[0], cpt=tables[1])
    assert {(r.codes_validated, r.extraction_warnings[0]) for r in out.collect()} == {(False, "ICD-10 not in reference table: A3")}
    assert asked.value == 30
    built_in = extract(docs, icd10=tables[0], cpt=tables[1])
    plan = built_in._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Range" not in plan  # the written frame, read once


@pytest.mark.parametrize("name", ["enrich_npi_registry", "enrich_codes_full"])
def test_queries_equal_sql(spark, name):
    df = we.QUERIES[name](spark, SF)
    assert compare(df, connect(SF), we.ORACLES[name]) == ""
    assert df.select(df.columns[1]).distinct().count() == 2


def test_plan_names_the_filter_once(spark, registry):
    row = build_filter(registry.select("npi"), 64)
    tested = spark.range(1).select(passes(F.col("id").cast("string"), row, 64).alias("hit"))
    assert tested._jdf.queryExecution().analyzed().expressions().toString().count("scalar-subquery") == 1
