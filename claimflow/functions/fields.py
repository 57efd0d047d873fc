"""Extracted fields: one bounded array of (name, value, confidence, source) per document.

Keeping the fields inside the document row means extraction, enrichment, penalties, guardrails
and decisions are all narrow: nothing is exploded and regrouped, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FIELDS, LIST_FIELDS, SCALAR_FIELDS


def make(name: str, value: Column, confidence: Column, source: str = "llm") -> Column:
    return F.struct(
        F.lit(name).alias("field_name"), value.alias("value"),
        confidence.cast("double").alias("confidence"), F.lit(source).alias("source"),
    )


def make_all(name: str, values: Column, confidence: Column, source: str = "llm") -> Column:
    return F.transform(values, lambda v: make(name, v, confidence, source))


def none() -> Column:
    return F.array().cast(FIELDS)


def names(fields: Column) -> Column:
    """Field names as an array: looked up in generated code, which a lambda per element is not."""
    return fields["field_name"]


def first(fields: Column, name: str) -> Column:
    """First field of that name, NULL when absent."""
    return F.get(fields, (F.array_position(names(fields), name) - 1).cast("int"))


def has(fields: Column, name: str) -> Column:
    return F.array_contains(names(fields), name)


def gathered(*parts: tuple[Column | None, Column]) -> Column:
    """Array of the values whose condition holds, in order. No condition always holds.

    The same as ``array_compact`` over an array of them, which would leave generated code for
    everything below it.
    """
    if not parts:
        return F.array().cast("array<string>")
    return F.concat(*[F.array(c) if test is None else F.when(test, F.array(c)).otherwise(F.array()) for test, c in parts])


def named(fields: Column, name: str) -> Column:
    return F.filter(fields, lambda f: f["field_name"] == name)


def value(fields: Column, name: str) -> Column:
    """Value of a scalar field, NULL when absent."""
    return first(fields, name)["value"]


def values(fields: Column, name: str) -> Column:
    """Values of a list field, empty array when absent."""
    return named(fields, name)["value"]


def is_scalar(f: Column) -> Column:
    return f["field_name"].isin(SCALAR_FIELDS)


def total(confidences: Column) -> Column:
    return F.aggregate(confidences, F.lit(0.0), lambda a, x: a + x)


def mean_confidence(fields: Column) -> Column:
    """Unrounded mean; 0.0 for no fields."""
    sums = total(fields["confidence"])
    return F.when(F.size(fields) > 0, sums / F.size(fields)).otherwise(F.lit(0.0))


def low_names(fields: Column, below: float) -> Column:
    return names(F.filter(fields, lambda f: f["confidence"] < below))


def flat(fields: Column) -> Column:
    """Wide struct of plain values, in declaration order."""
    scalars = [value(fields, n).alias(n) for n in SCALAR_FIELDS]
    lists = [values(fields, n).alias(n) for n in LIST_FIELDS]
    return F.struct(*scalars, *lists)
