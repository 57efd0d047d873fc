"""A model's JSON reply to extraction fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import LOW_FIELD
from ..functions import fields as fl
from ..functions.fence import settle
from ..functions.jsontext import is_json, is_object, object_map, outer_object, without_fences
from ..functions.text import round_half_even
from ..schemas import FIELDS, LIST_FIELDS, SCALAR_FIELDS

UNPARSED = "could not parse LLM JSON response"
BAD = "reply is not an object of fields with numeric confidences"


def _member(name: Column, raw: Column) -> Column:
    """One raw JSON value to a field struct: an object with value/confidence/source, or bare."""
    obj = F.startswith(raw, F.lit("{"))
    stated = F.get_json_object(raw, "$.confidence")
    has = F.array_contains(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), "confidence")
    conf = (F.when(~obj, F.lit(0.75)).when(~has, F.lit(0.8))
            .otherwise(F.coalesce(stated.try_cast("double"), F.lit(float("nan")))))
    clamped = F.when(F.isnan(conf), conf).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), conf)))
    return F.struct(
        name.alias("field_name"),
        F.when(obj, F.get_json_object(raw, "$.value")).otherwise(raw).alias("value"),
        clamped.alias("confidence"),
        F.when(obj, F.coalesce(F.get_json_object(raw, "$.source"), F.lit("llm")))
        .otherwise(F.lit("llm")).alias("source"),
    )


def parse_reply(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add ``fields``, ``mean_confidence``, ``low_conf_fields``, ``extraction_warnings``, ``extraction_error``.

    Unknown scalar keys count in the mean but are not kept. A reply that is no object, or states a
    confidence that is no number, gives an error on its row instead of stopping the run.
    """
    clean = F.col("_clean")
    df = df.withColumn("_clean", without_fences(F.col(reply)))
    valid = F.coalesce(is_json(clean), F.lit(False))
    df = df.withColumn("_valid", valid).withColumn(
        "_object", F.when(F.col("_valid"), clean).otherwise(outer_object(clean)))
    empty_reply = ~F.col("_valid") & (F.col("_object") == "")
    df = df.withColumn("_members", F.when(empty_reply, F.array().cast("array<struct<key:string,value:string>>"))
                       .otherwise(F.map_entries(object_map(F.col("_object")))))
    # Of a repeated key the last member counts.
    keys = F.reverse(F.transform("_members", lambda m: m["key"]))
    df = df.withColumn("_members", F.filter("_members", lambda m, i: F.array_position(
        keys, m["key"]) == F.size("_members") - i))
    scalars = F.filter("_members", lambda m: ~m["key"].isin(LIST_FIELDS) & m["value"].isNotNull())
    scalar_fields = F.transform(scalars, lambda m: _member(m["key"], m["value"]))

    def listed(name: str) -> Column:
        raw = F.try_element_at(F.filter("_members", lambda m: m["key"] == name), F.lit(-1))["value"]
        items = F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>"))
        kept = F.filter(items, lambda i: i.isNotNull())
        return F.coalesce(F.transform(kept, lambda i: _member(F.lit(name), i)), fl.none())

    parsed = F.concat(scalar_fields, *[listed(n) for n in LIST_FIELDS]).cast(FIELDS)
    df = df.withColumn("_parsed", F.filter(
        parsed, lambda f: f["value"].isNotNull() & (f["value"] != "")))
    bad = F.col("_parsed").isNull() | F.exists("_parsed", lambda f: F.isnan(f["confidence"]))
    df = df.withColumn("extraction_error", F.when(F.coalesce(bad, F.lit(True)), F.lit(BAD)))
    ok = F.col("extraction_error").isNull()
    known = F.filter("_parsed", lambda f: f["field_name"].isin(SCALAR_FIELDS + LIST_FIELDS))
    none = F.array().cast("array<string>")
    return settle(df.withColumns({
        "fields": F.when(ok, known).otherwise(fl.none()),
        "mean_confidence": F.when(ok, round_half_even(fl.mean_confidence(F.col("_parsed")), 4))
        .otherwise(0.0),
        "low_conf_fields": F.when(ok, fl.low_names(F.col("_parsed"), LOW_FIELD)).otherwise(none),
        "extraction_warnings": F.when(~ok, F.array(F.concat(
            F.lit("extraction_error: "), "extraction_error")))
        .when(~F.col("_valid"), F.array(F.lit(UNPARSED))).otherwise(none),
    }).drop("_clean", "_valid", "_object", "_members", "_parsed"))
