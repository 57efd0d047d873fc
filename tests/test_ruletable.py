"""Rule tables: equal to generated columns, and thousands of rules in one pass."""

import random
import re
import time

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from claimflow.fixed import RULES
from claimflow.operators.rules import apply_rules, rule_confidence
from claimflow.operators.ruletable import MOST_RULES, apply_rule_table, load_catalogue, rule_signals
from workload import classify

SF = "/root/testdata/sf0.001"
WORDS = [w for _, ps, _ in RULES for p in ps for w in re.findall("[a-z]{2,}", p.replace("\\b", " ").replace("\\d", " "))]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice([*WORDS, "and", "12", "CPT 99213", "Straße", "İ", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "EXPLANATION OF BENEFITS " * 2000), (902, "prior authorization"), (903, "prior authorization")]
    return spark.createDataFrame(rows, "id int, full_text string").repartition(4)


def table(spark, catalogue):
    rows = [(t, p, base, float(n)) for n, (t, p, base) in enumerate((t, p, base) for t, ps, base in catalogue for p in ps)]
    return spark.createDataFrame(rows, "document_type string, pattern string, base double, ord double")


def test_equal_to_generated_columns_on_the_fixed_rules(spark, texts):
    catalogue = load_catalogue(table(spark, RULES))
    assert catalogue == [(t, list(ps), base) for t, ps, base in RULES]
    got, want = apply_rule_table(texts, catalogue), apply_rules(texts)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.where(F.size("signals") > 1).count() > 50


def test_rules_without_a_literal_word_and_shared_words(spark, texts):
    catalogue = [("a", [r"(?:cpt|icd) \d+", "prior", "prior"], 0.9), ("b", [r"[x-z]{9}", "prior.*authorization", r"\bprior\b"], 0.5), ("c", ["^$"], 0.3)]
    got, want = apply_rule_table(texts, catalogue), apply_rules(texts, catalogue=catalogue)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert apply_rule_table(texts, []).where(F.size("signals") > 0).count() == 0
    assert apply_rule_table(texts.where("false"), catalogue).count() == 0


def test_catalogue_order_nulls_and_bound(spark):
    rows = [("x", "b", 0.5, 2.0), ("y", "a", 0.7, 1.0), ("x", "c", 0.9, 3.0), (None, "d", 0.1, 0.0), ("y", None, 0.1, 0.0)]
    rules = spark.createDataFrame(rows, "document_type string, pattern string, base double, ord double")
    assert load_catalogue(rules) == [("y", ["a"], 0.7), ("x", ["b", "c"], 0.5)]
    with pytest.raises(ValueError, match="more than 2 rules"):
        load_catalogue(rules, most=2)


def test_five_thousand_rules_cost_less_than_a_test_each(spark):
    catalogue = [(f"t{k % 50}", [], 0.9) for k in range(50)]
    for k in range(5000):
        catalogue[k % 50][1].append(rf"\bcode{k}\b")
    rng = random.Random(3)
    rows = [(i, " ".join(f"code{rng.randrange(9000)}" if rng.random() < 0.02 else "word" for _ in range(200))) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, full_text string").repartition(4).cache()
    df.count()
    started = time.perf_counter()
    got = {r.id: {s.document_type: (s.confidence, s.matched_rule) for s in r.signals} for r in apply_rule_table(df, catalogue).collect()}
    table_seconds = time.perf_counter() - started
    for i, text in rows:
        found = {}
        for k in sorted({int(x) for x in re.findall(r"\bcode(\d+)\b", text) if int(x) < 5000}):
            found.setdefault(f"t{k % 50}", []).append(k)
        assert got[i] == {t: (rule_confidence(0.9, len(ks), 100), rf"\bcode{ks[0]}\b") for t, ks in found.items()}
    # The cheapest test a rule could have, a plain substring search, for a fiftieth of the rules.
    started = time.perf_counter()
    df.select(*[F.sum(F.contains("full_text", F.lit(f"code{k}")).cast("int")) for k in range(100)]).collect()
    assert table_seconds < 50 * (time.perf_counter() - started)
    df.unpersist()


def test_query_equals_sql(spark):
    assert compare(classify.rule_table(spark, SF), connect(SF), classify.ORACLES["rule_table"]) == ""


@pytest.mark.parametrize("most", [50_000, 3])
def test_a_rule_frame_gives_the_catalogues_signals(spark, texts, most):
    odd = [("a", [r"(?:cpt|icd) \d+", "prior", "prior"], 0.9), ("b", [r"[x-z]{9}", "prior.*authorization", r"\bprior\b"], 0.5), ("c", ["^$"], 0.3)]
    for catalogue in (RULES, odd):
        s = F.col("s")
        want = apply_rule_table(texts, catalogue).select("id", F.explode("signals").alias("s")).select(
            "id", s["document_type"], s["confidence"], s["matched_rule"])
        got = rule_signals(texts, table(spark, catalogue), "id", most_heads=most)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert rule_signals(texts, table(spark, RULES).where("false"), "id").count() == 0


def test_more_rules_than_a_catalogue_holds(spark):
    n = MOST_RULES + 20_000
    rules = spark.range(n).select((F.col("id") % 40).cast("string").alias("document_type"), F.format_string(r"\bcode%d\b", "id").alias("pattern"),
                                  F.lit(0.9).alias("base"), F.col("id").alias("ord"))
    rows = [(1, f"Code{n - 1} code7, code{n}"), (2, "code"), (None, "code40 code0"), (None, "code40 code0"), (5, None)]
    got = rule_signals(spark.createDataFrame(rows, "id int, full_text string"), rules, "id").collect()
    level = rule_confidence(0.9, 1, n // 40), rule_confidence(0.9, 2, n // 40)
    want = [(1, "39", level[0], rf"\bcode{n - 1}\b"), (1, "7", level[0], r"\bcode7\b"), *[(None, "0", level[1], r"\bcode0\b")] * 2]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
