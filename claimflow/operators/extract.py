"""Field extraction without a model: JSON bundles, event JSON, HL7, EDI and free text.

One pass of column expressions. The document's kind is decided first; each parser's input is NULL
for other kinds, so a row pays for one parser only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed as fx
from ..functions import fields as fl
from ..functions import segments as seg
from ..functions.fence import settle
from ..functions.jsontext import STRICT, is_json, object_map
from ..functions.text import iso_date, strip, strip_text, text_or_empty, title_case
from ..schemas import EVENT_JSON, FHIR_JSON, LIST_FIELDS, SCALAR_FIELDS
from .normalize import fhir_columns, fhir_resource

INDEX_ERROR = "list index out of range"


def document_kind(text: Column, members: Column) -> Column:
    return (
        F.when(F.try_element_at(members, F.lit("resourceType")) == "Bundle", F.lit("bundle"))
        .when(F.map_contains_key(members, F.lit("event")), F.lit("event"))
        .when(F.startswith(text, F.lit("MSH|")), F.lit("hl7"))
        .when(F.startswith(text, F.lit("ISA*")), F.lit("edi"))
        .otherwise(F.lit("text"))
    )


# ---------------------------------------------------------------- parsers: name -> column

def from_bundle(patient: Column, coverage: Column, claim: Column) -> dict[str, Column]:
    cols = fhir_columns(patient, coverage, claim)
    return {**cols, "patient_name": strip(cols["patient_name"]), "total_charge": claim["total"]["value"]}


def from_event(e: Column) -> dict[str, Column]:
    reason = e["denial"]["reason_code"]
    return {
        "patient_name": e["patient"]["name"], "patient_dob": e["patient"]["dob"],
        "patient_id": e["patient"]["mrn"], "payer_id": e["payer"]["id"],
        "payer_name": e["payer"]["name"], "diagnosis_codes": e["diagnosis_codes"],
        "procedure_codes": e["procedure_codes"], "provider_npi": e["provider_npi"],
        "claim_number": e["claim_number"], "auth_number": e["auth_number"],
        "denial_reason_codes": F.array(reason), "appeal_deadline": e["denial"]["appeal_by"],
    }


def from_hl7(segments: Column) -> dict[str, Column]:
    pid = seg.hl7_segment(segments, "PID")

    def first(tag: str, i: int) -> Column:
        return seg.component(seg.hl7_segment(segments, tag), i)

    return {
        "patient_name": strip(F.concat(title_case(seg.component(pid, 5, 1)), F.lit(" "),
                                       title_case(seg.component(pid, 5, 0)))),
        "patient_dob": iso_date(seg.component(pid, 7)), "patient_id": seg.component(pid, 3),
        "payer_id": first("IN1", 3), "diagnosis_codes": F.array(first("DG1", 3)),
        "procedure_codes": F.array(first("PR1", 3)), "provider_npi": first("PV1", 7),
    }


def dotted(code: Column) -> Column:
    plain = F.contains(code, F.lit(".")) | (F.length(code) <= 3)
    return F.when(plain, code).otherwise(
        F.concat(F.substring(code, 1, 3), F.lit("."), F.substring(code, F.lit(4), F.length(code))))


def second_part(e: Column) -> Column:
    return F.get(F.split(e, ":"), F.lit(1))


def from_edi(segments: Column) -> dict[str, Column]:
    patient, claim = seg.edi_first(segments, "NM1", "QC"), seg.edi_first(segments, "CLM")
    dx = F.flatten(F.transform(seg.edi_all(segments, "HI"), lambda s: F.transform(
        F.filter(F.slice(s, F.lit(2), F.size(s)), lambda e: F.contains(e, F.lit(":"))),
        lambda e: dotted(second_part(e)))))
    px = F.transform(
        F.filter(seg.edi_all(segments, "SV1"),
                 lambda s: F.coalesce(F.contains(F.get(s, F.lit(1)), F.lit(":")), F.lit(False))),
        lambda s: second_part(s[1]))
    return {
        "patient_name": strip(F.concat(title_case(seg.field(patient, 4)), F.lit(" "),
                                       title_case(seg.field(patient, 3)))),
        "patient_dob": iso_date(seg.field(seg.edi_first(segments, "DMG"), 2)),
        "patient_id": seg.field(patient, 9), "member_id": seg.field(patient, 9),
        "payer_id": seg.field(seg.edi_first(segments, "REF", "2U"), 2),
        "provider_npi": seg.field(seg.edi_first(segments, "NM1", "85"), 9),
        "claim_number": seg.field(claim, 1), "total_charge": seg.field(claim, 2),
        "diagnosis_codes": dx, "procedure_codes": px,
    }


def leading_word(pattern: str) -> str:
    """Literal text every match starts with, lower-cased; '' if there is none."""
    return re.match(r"[A-Za-z -]*", re.sub(r"^(\\b|\()+", "", pattern)).group().lower()


def grab(text: Column, lowered: Column, pattern: str) -> Column:
    """First group of the first match in any letter case, '' without a match.

    The pattern only runs on texts that contain its leading word.
    """
    found = strip(F.regexp_extract(text, "(?idU)" + pattern, 1))
    word = leading_word(pattern)
    return F.when(F.contains(lowered, F.lit(word)), found).otherwise(F.lit("")) if word else found


def from_text(text: Column, lowered: Column, payer_line: Column, dx_zone: Column,
              px_zone: Column) -> dict[str, Column]:
    def one(c: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(c, "(?dU)" + pattern, 1), F.lit(""))

    def every(c: Column, pattern: str) -> Column:
        return F.regexp_extract_all(c, F.lit("(?dU)" + pattern), F.lit(0))

    out = {name: grab(text, lowered, p) for name, p in fx.TEXT_SCALARS}
    out["payer_id"] = F.coalesce(
        one(payer_line, fx.PAYER_PARENS), one(payer_line, fx.PAYER_LEADING),
        one(text, fx.PAYER_ANYWHERE))
    out["payer_name"] = F.when(
        F.contains(payer_line, F.lit("(")),
        F.regexp_replace(payer_line, "(?dU)" + fx.PAYER_TAIL, ""))
    out["diagnosis_codes"] = every(dx_zone, fx.DX_CODE)
    out["procedure_codes"] = every(px_zone, fx.PX_CODE)
    out["denial_reason_codes"] = every(text, fx.CARC_CODE)
    return out


CONFIDENCE = {
    "bundle": fx.JSON_CONFIDENCE, "event": fx.JSON_CONFIDENCE, "hl7": fx.HL7_CONFIDENCE,
    "edi": fx.EDI_CONFIDENCE, "text": fx.TEXT_CONFIDENCE,
}


def parse_document(df: DataFrame, text: str = "safe_text") -> DataFrame:
    """Reads the whole text. Add ``kind``, ``base_confidence``, ``extraction_error`` and one ``v_<field>`` per field."""
    x, kind = F.col("_x"), F.col("kind")
    df = df.withColumn("_x", strip_text(F.col(text)))
    df = df.withColumn("_members", object_map(x))
    df = df.withColumn("kind", document_kind(x, F.col("_members")))

    def only(name: str, c: Column) -> Column:
        return F.when(kind == name, c)

    free = only("text", x)
    df = df.withColumns({
        "_bundle": only("bundle", F.from_json("_x", FHIR_JSON, STRICT)),
        "_event": only("event", F.from_json("_x", EVENT_JSON, STRICT)),
        "_hl7": only("hl7", seg.hl7_segments(x)),
        "_edi": only("edi", seg.edi_segments(x)),
        "_free": free, "_lowered": F.lower(free), "_is_json": only("text", is_json(x)),
    })
    text_, lowered = F.col("_free"), F.col("_lowered")
    df = df.withColumns({
        "_patient": fhir_resource(F.col("_bundle"), "Patient"),
        "_coverage": fhir_resource(F.col("_bundle"), "Coverage"),
        "_claim": fhir_resource(F.col("_bundle"), "Claim"),
        "_payer": grab(text_, lowered, fx.PAYER_LINE),
        "_dxzone": grab(text_, lowered, fx.DX_ZONE),
        "_pxzone": grab(text_, lowered, fx.PX_ZONE),
    })
    parsers = {
        "bundle": from_bundle(F.col("_patient"), F.col("_coverage"), F.col("_claim")),
        "event": from_event(F.col("_event")),
        "hl7": from_hl7(F.col("_hl7")),
        "edi": from_edi(F.col("_edi")),
        "text": from_text(text_, lowered, F.col("_payer"), F.col("_dxzone"), F.col("_pxzone")),
    }
    broken = F.exists(seg.edi_all(F.col("_edi"), "SV1"), lambda s: F.size(s) == 1)
    broken = F.coalesce(broken, F.lit(False))

    values = {}
    for name in SCALAR_FIELDS + LIST_FIELDS:
        found = None
        for k, cols in parsers.items():
            if name in cols:
                here = (kind == k) & ~broken if k == "edi" else kind == k
                found = F.when(here, cols[name]) if found is None else found.when(here, cols[name])
        if name in LIST_FIELDS:
            empty = F.array().cast("array<string>")
            values[f"v_{name}"] = F.coalesce(F.filter(found, lambda v: v != ""), empty)
        else:
            values[f"v_{name}"] = text_or_empty(found) if found is not None else F.lit("")
    base = F.lit(None).cast("double")
    for k, c in CONFIDENCE.items():
        base = F.when(kind == k, F.lit(c)).otherwise(base)
    return df.withColumns({
        **values,
        "base_confidence": F.when(F.col("_is_json"), F.lit(fx.JSON_CONFIDENCE)).otherwise(base),
        "extraction_error": F.when(broken, F.lit(INDEX_ERROR)),
    }).drop("_x", "_members", "_bundle", "_event", "_hl7", "_edi", "_free", "_lowered", "_is_json",
            "_patient", "_coverage", "_claim", "_payer", "_dxzone", "_pxzone")


def reply_words() -> Column:
    """Words in the JSON reply the parsed values would be written as."""
    def spaced(v: Column) -> Column:
        words = F.regexp_count(F.concat(F.lit('"'), v, F.lit('"')), F.lit("[^ ]+"))
        return F.when(F.contains(v, F.lit(" ")), words).otherwise(1)

    total = F.lit(0)
    for n in SCALAR_FIELDS:
        v = F.col(f"v_{n}")
        total = total + F.when(v != "", spaced(v) + 4).otherwise(0)
    for n in LIST_FIELDS:
        v = F.col(f"v_{n}")
        each = F.aggregate(v, F.lit(1), lambda a, x: a + spaced(x) + 3)
        total = total + F.when(F.size(v) > 0, each).otherwise(0)
    return F.greatest(total, F.lit(1)).cast("bigint")


def pack_fields(df: DataFrame) -> DataFrame:
    """The ``v_`` columns as the ``fields`` array, empty values dropped."""
    conf = F.col("base_confidence")
    scalars = fl.gathered(*[
        (F.col(f"v_{n}") != "", fl.make(n, F.col(f"v_{n}"), conf)) for n in SCALAR_FIELDS
    ])
    lists = [fl.make_all(n, F.col(f"v_{n}"), conf) for n in LIST_FIELDS]
    return df.withColumn("fields", F.concat(scalars, *lists))


def extract_builtin(df: DataFrame, text: str = "safe_text") -> DataFrame:
    """Add ``fields``, ``reply_words`` and ``extraction_error``."""
    parsed = parse_document(df, text)
    packed = pack_fields(parsed.withColumn("reply_words", reply_words()))
    return settle(packed.drop("kind", "base_confidence", *[f"v_{n}" for n in SCALAR_FIELDS + LIST_FIELDS]))
