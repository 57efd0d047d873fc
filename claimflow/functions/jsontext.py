"""JSON kept as text: validity checks and fence stripping without re-serialising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_text

STRICT = {"allowSingleQuotes": "false"}


def without_fences(c: Column) -> Column:
    fenced = F.contains(c, F.lit("```"))
    return strip_text(F.when(fenced, F.regexp_replace(c, r"```(?:json)?|```", "")).otherwise(c))


def outer_object(c: Column) -> Column:
    """From the first ``{`` to the last ``}``; '' when there is none."""
    return F.regexp_extract(c, r"(?s)(\{.*\})", 1)


def object_map(c: Column) -> Column:
    """Top-level members as text, NULL unless ``c`` is one whole JSON object."""
    whole = F.startswith(c, F.lit("{")) & F.endswith(c, F.lit("}"))
    return F.when(whole, F.from_json(c, "map<string,string>", STRICT))


def is_object(c: Column) -> Column:
    return object_map(c).isNotNull()


def is_json(c: Column, members: Column | None = None) -> Column:
    """True for any JSON value. ``c`` must be stripped. Plain prose fails on its first character.

    ``members`` is ``object_map(c)`` where the caller has it already.
    """
    as_array = (
        F.startswith(c, F.lit("[")) & F.endswith(c, F.lit("]"))
        & F.from_json(c, "array<string>", STRICT).isNotNull()
    )
    scalar = F.rlike(
        c,
        F.lit(r'^(-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?|true|false|null|NaN|-?Infinity'
              r'|"([^"\\\x00-\x1f]|\\(["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")$'),
    )
    return F.when(F.startswith(c, F.lit("{")),
                  (members if members is not None else object_map(c)).isNotNull()).otherwise(as_array | scalar)
