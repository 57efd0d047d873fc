"""Model-call metering: token estimates, prices and one record per call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import DEFAULT_PRICE, PRICES
from ..functions.text import round_half_even, tokens, word_count
from .lookup import lookup_join


def price(model: Column) -> Column:
    out = F.lit(DEFAULT_PRICE)
    for name, rate in PRICES.items():
        out = F.when(model == name, F.lit(rate)).otherwise(out)
    return out


def cost(input_tokens: Column, output_tokens: Column, rate: Column) -> Column:
    return round_half_even((input_tokens + output_tokens) / 1000 * rate, 6)


def token_cost(df: DataFrame, system: str, user: str, reply: str, model: str = "model",
               prices: DataFrame | None = None, spread: str = "document_id") -> DataFrame:
    """Add ``input_tokens``, ``output_tokens`` and ``cost_usd``; a NULL reply is a failed call."""
    failed = F.col(reply).isNull()
    zero = F.lit(0).cast("bigint")
    df = df.withColumns({
        "input_tokens": F.when(failed, zero).otherwise(
            tokens(word_count(F.concat(F.col(system), F.col(user))))),
        "output_tokens": F.when(failed, zero).otherwise(tokens(word_count(F.col(reply)))),
    })
    if prices is None:
        df = df.withColumn("_rate", price(F.col(model)))
    else:
        table = prices.select(F.col("model").alias("_model"), F.col("cost_per_1k").alias("_found"))
        df = lookup_join(df, table, model, "_model", [spread])
        df = df.withColumn("_rate", F.coalesce("_found", F.lit(DEFAULT_PRICE))).drop("_found")
    return df.withColumn("cost_usd", cost(F.col("input_tokens"), F.col("output_tokens"), F.col("_rate"))).drop("_rate")


def call_records(df: DataFrame, called_at: Column | None = None) -> DataFrame:
    """One row per attempt of a model call out of the ``call`` struct of extracted documents.

    Tokens and cost belong to the attempt that was answered.
    """
    c, a = F.col("call"), F.col("_attempt")
    when = called_at if called_at is not None else F.col("ingested_at")
    zero = F.lit(0).cast("bigint")
    rows = df.where(c.isNotNull()).select("record_id", "document_id", "call", when.alias("called_at"),
                                          F.explode("call.attempts").alias("_attempt"))
    return rows.select(
        F.sha2(F.concat_ws("\u001f", "record_id", "document_id", c["prompt_name"], c["model"], a["attempt"].cast("string")), 256)
        .alias("call_id"),
        "document_id", c["model"].alias("model"), c["prompt_name"].alias("prompt_name"),
        c["prompt_version"].alias("prompt_version"), F.when(a["success"], c["input_tokens"]).otherwise(zero).alias("input_tokens"),
        F.when(a["success"], c["output_tokens"]).otherwise(zero).alias("output_tokens"), a["latency_ms"].alias("latency_ms"),
        F.when(a["success"], c["cost_usd"]).otherwise(F.lit(0.0)).alias("cost_usd"), a["success"].alias("success"),
        a["error"].alias("error"), "called_at",
    )


def call_summary(calls: DataFrame) -> DataFrame:
    """Calls, cost, mean latency in one row; sums are combined before the shuffle."""
    return calls.agg(
        F.count(F.lit(1)).alias("llm_calls"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("llm_cost_usd"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 3).alias("llm_mean_latency_ms"),
    )
