"""Whole texts are trimmed without a walk over every character."""

from pyspark.sql import functions as F

from claimflow.functions.text import WHITESPACE, strip, strip_text


def test_strip_text_equals_strip(spark):
    edges = ["", "x", "~", "!", "é", "中", "\x7f", "\x00", "\U0001f600", "x y", *WHITESPACE]
    rows = [(a + m + b,) for a in edges for m in ("", "é", "a b") for b in edges] + [(None,)]
    df = spark.createDataFrame(rows, "t string").select(strip("t").alias("a"), strip_text(F.col("t")).alias("b"))
    assert df.count() == len(rows) and df.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
