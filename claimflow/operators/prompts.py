"""Versioned prompts as a DataFrame, and the messages built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import (
    MAX_PROMPT_CHARS, PROMPT_BASE, PROMPT_BODIES, PROMPT_DEFAULT_BODY, PROMPT_MAX_TOKENS,
    PROMPT_MODEL, PROMPT_VERSION, USER_TEMPLATE,
)
from ..schemas import DOCUMENT_TYPES, PROMPT


def system_prompt(document_type: str) -> str:
    return PROMPT_BASE + PROMPT_BODIES.get(document_type, PROMPT_DEFAULT_BODY)


def system_prompt_for(document_type: Column) -> Column:
    out = F.lit(system_prompt("unknown"))
    for kind in PROMPT_BODIES:
        out = F.when(document_type == kind, F.lit(system_prompt(kind))).otherwise(out)
    return out


def user_message(text: Column, max_chars: int = MAX_PROMPT_CHARS) -> Column:
    mark = F.when(F.length(text) > max_chars, F.lit(f"\n\n[truncated to {max_chars} chars]"))
    return F.concat(F.lit("DOCUMENT:\n"), F.left(text, F.lit(max_chars)), F.coalesce(mark, F.lit("")))


def default_prompts(spark: SparkSession) -> DataFrame:
    """One extraction prompt per document type."""
    rows = [
        (f"extraction-{t}", PROMPT_VERSION, t, system_prompt(t), USER_TEMPLATE, PROMPT_MODEL,
         PROMPT_MAX_TOKENS, 0.0)
        for t in DOCUMENT_TYPES
    ]
    return spark.createDataFrame(rows, PROMPT)


def registered(prompts: DataFrame, load_order: str) -> DataFrame:
    """One row per (name, version): the one loaded last. Combined before the shuffle."""
    rest = [c for c in prompts.columns if c not in ("name", "version", load_order)]
    last = F.max_by(F.struct(*rest), F.col(load_order)).alias("p")
    return prompts.groupBy("name", "version").agg(last).select("name", "version", "p.*")


def latest(prompts: DataFrame) -> DataFrame:
    """Latest version per name. Versions compare as text, so v1.9 is later than v1.10."""
    rest = [c for c in prompts.columns if c not in ("name", "version")]
    best = F.max_by(F.struct("version", *rest), F.concat_ws(":", "name", "version")).alias("p")
    return prompts.groupBy("name").agg(best).select("name", "p.*")


def get_prompt(prompts: DataFrame, name: str, version: str = "latest") -> DataFrame:
    mine = prompts.where(F.col("name") == name)
    return latest(mine) if version == "latest" else mine.where(F.col("version") == version)


def list_versions(prompts: DataFrame, name: str) -> DataFrame:
    return prompts.where(F.col("name") == name).select("version").distinct()


def build_prompt(df: DataFrame, text: str = "full_text", document_type: str = "document_type",
                 max_chars: int = MAX_PROMPT_CHARS) -> DataFrame:
    return df.withColumns({
        "system": system_prompt_for(F.col(document_type)),
        "user": user_message(F.col(text), max_chars),
    })
