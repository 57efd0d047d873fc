"""Delimited segment formats: HL7 v2 pipes and X12 stars, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lines, strip, text_or_empty


def hl7_segments(text: Column) -> Column:
    """Segments of a message as arrays of fields; lines of three characters or less drop out."""
    kept = F.filter(lines(text), lambda s: F.length(s) > 3)
    return F.transform(kept, lambda s: F.split(s, r"\|"))


def hl7_segment(text_lines: Column, tag: str) -> Column:
    """Fields of the last segment that carries the tag, NULL when there is none."""
    mine = F.filter(text_lines, lambda s: F.startswith(F.get(s, F.lit(0)), F.lit(tag)))
    return F.try_element_at(mine, F.lit(-1))


def edi_segments(text: Column) -> Column:
    kept = F.filter(F.split(text, "[~\n]"), lambda s: strip(s) != "")
    return F.transform(kept, lambda s: F.split(s, r"\*"))


def edi_all(segments: Column, tag: str) -> Column:
    return F.filter(segments, lambda s: F.get(s, F.lit(0)) == tag)


def edi_first(segments: Column, tag: str, qualifier: str | None = None) -> Column:
    """First segment with the tag (and, if given, with that first element)."""
    def matches(s: Column) -> Column:
        hit = F.get(s, F.lit(0)) == tag
        if qualifier is None:
            return hit
        return hit & F.coalesce(F.get(s, F.lit(1)) == qualifier, F.lit(False))

    return F.try_element_at(F.filter(segments, matches), F.lit(1))


def field(segment: Column, index: int) -> Column:
    """One element, '' where the segment is missing or too short."""
    return text_or_empty(F.get(segment, F.lit(index)))


def component(segment: Column, index: int, part: int = 0) -> Column:
    """One ``^`` component of an HL7 field."""
    return text_or_empty(F.get(F.split(field(segment, index), r"\^"), F.lit(part)))


def clean_codes(codes: Column) -> Column:
    """Strip, drop empty, keep the first occurrence of each code."""
    return F.array_distinct(F.filter(F.transform(codes, strip), lambda c: c != ""))
