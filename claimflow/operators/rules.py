"""Weighted text rules.

A rule catalogue is compiled to column expressions. Each pattern is guarded by the literal words
it cannot match without: those are plain substring tests, so on most documents most patterns
never run.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import RULES
from ..functions.fence import settle
from ..functions.text import as_literal

Catalogue = list[tuple[str, list[str], float]]

SIGNAL = "struct<neg:double,ord:int,document_type:string,confidence:double,matched_rule:string>"


def needles(pattern: str) -> list[str]:
    """Literal words every match must contain; [] if the pattern uses anything but \\b, \\d+ and .*"""
    parts = re.split(r"\\d\+|\.\*", pattern.replace(r"\b", ""))
    if any(re.search(r"[\\\[\](){}|?*+.^$]", p) for p in parts):
        return []
    return [p.lower() for p in parts if p]


def pattern_test(lowered: Column, pattern: str) -> Column:
    test = F.rlike(lowered, F.lit("(?idU)" + pattern))
    for word in needles(pattern):
        test = F.contains(lowered, F.lit(word)) & test
    return test


def rule_confidence(base: float, hits: int, patterns: int) -> float:
    """More matching patterns, more confidence: full weight from a quarter of the patterns on."""
    weight = 0.7 + 0.3 * min(1.0, hits / patterns * 4)
    return round(min(0.99, base * weight), 4)


def matched_patterns(lowered: Column, catalogue: Catalogue) -> Column:
    """Per type the patterns that match, in catalogue order."""
    return F.array(*[
        F.array_compact(F.array(*[F.when(pattern_test(lowered, p), F.lit(p)) for p in pats]))
        for _, pats, _ in catalogue
    ])


def rank_signals(matched: Column, catalogue: Catalogue = RULES) -> Column:
    """Signals by falling confidence; ties keep catalogue order."""
    levels = [[rule_confidence(base, h, len(pats)) for h in range(1, len(pats) + 1)]
              for _, pats, base in catalogue]
    conf = as_literal(levels, "array<array<double>>")
    types = as_literal([t for t, _, _ in catalogue], "array<string>")

    def signal(found: Column, i: Column) -> Column:
        score = F.get(F.get(conf, i), F.size(found) - 1)
        return F.when(F.size(found) > 0, F.struct(
            (-score).alias("neg"), i.alias("ord"), F.get(types, i).alias("document_type"),
            score.alias("confidence"), F.get(found, F.lit(0)).alias("matched_rule")))

    return F.sort_array(F.array_compact(F.transform(matched, signal)))


def apply_rules(df: DataFrame, text: str = "full_text", catalogue: Catalogue = RULES,
                only: Column | None = None) -> DataFrame:
    """Add ``signals``; rows outside ``only`` get an empty list without running a pattern."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    if only is not None:
        lowered = F.when(only, lowered).otherwise(F.lit(""))
    return settle(
        df.withColumn("_lowered", lowered)
        .withColumn("_matched", matched_patterns(F.col("_lowered"), catalogue))
        .withColumn("signals", rank_signals(F.col("_matched"), catalogue))
        .drop("_lowered", "_matched")
    )


def top_two(df: DataFrame) -> DataFrame:
    """Best and runner-up signal as columns, from a bounded per-row list."""
    one, two = (F.try_element_at("signals", F.lit(n)) for n in (1, 2))
    return df.withColumns({
        "top_type": one["document_type"], "top_confidence": one["confidence"],
        "matched_rule": one["matched_rule"],
        "runner_up_type": two["document_type"], "runner_up_conf": two["confidence"],
    })
