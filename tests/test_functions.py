import random

from pyspark.sql import functions as F

from claimflow.functions import text as tx
from claimflow.functions.jsontext import is_json, object_map
from claimflow.operators.govern import redact
from claimflow.operators.rules import needles, rule_confidence
from claimflow.sources.landing import spread


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rounding_follows_the_binary_value(spark):
    rng = random.Random(5)
    xs = [0.84875, 0.78435, 0.725, 59.95, 72.005, 1.5e-6, 0.0, 1.0] + [rng.randint(0, 10 ** 5) / 10 ** 5 for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (2, 4, 6):
        for r in df.select("x", tx.round_half_even(F.col("x"), digits).alias("r")).collect():
            assert r.r == round(r.x, digits)


def test_title_case_breaks_at_every_non_letter(spark):
    assert one(spark, tx.title_case(F.lit("o'brien-lee x2y"))) == "o'brien-lee x2y".title()


def test_words_split_on_unicode_space(spark):
    text = "a b c d  e\x1cf"
    assert one(spark, tx.word_count(F.lit(text))) == len(text.split())


def test_json_checks(spark):
    cases = {'{"a":1}': True, '{"a":1': False, "[1]": True, "12": True, "abc": False, "{'a':1}": False,
             '{"a":1} x': False, "null": True, '"s"': True, "": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.ok for r in df.select("t", is_json(F.col("t")).alias("ok")).collect()} == cases
    assert one(spark, object_map(F.lit('{"a":{"b":1.5}}')))["a"] == '{"b":1.5}'


def test_redaction_order_and_labels(spark):
    text = "SSN 123-45-6789, card 4111 1111 1111 1111, mail a@b.org"
    assert one(spark, redact(F.lit(text))) == "SSN [SSN-REDACTED], card [CARD-REDACTED], mail [EMAIL-REDACTED]"


def test_rule_needles_and_levels():
    assert needles(r"\bCO-\d+\b") == ["co-"]
    assert needles(r"\brefer.*patient\b") == ["refer", "patient"]
    assert needles(r"a|b") == []
    assert [rule_confidence(0.92, h, 10) for h in (1, 2, 3)] == [0.7544, 0.8648, 0.92]


def test_spread_bounds_the_rows_of_a_task(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spread(spark.read.parquet(str(tmp_path / "t")), rows=50)
    assert df.rdd.getNumPartitions() == 20 and max(len(p) for p in df.rdd.glom().collect()) <= 60
    assert sorted(r.id for r in df.collect()) == list(range(1000))
