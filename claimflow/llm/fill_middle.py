"""Fill-in-the-middle transformation with counted quantifiers of a regular expression.

A text is cut into lines (``[^\\n]*\\n|[^\\n]+``), which ``regexp_count`` counts. Two cuts a <= b fall
between lines. A pattern made for the row, ``(line{a})(line{b-a})(rest)`` with possessive quantifiers,
captures prefix, middle and suffix in one match, and the replacement puts them in order behind their
markers. A possessive counted group is a loop without backtracking, so a text of a million lines takes
neither more stack nor more than one pass.

Everything about a row comes from the SHA-256 of its id and a seed, so reruns and retried tasks agree.
All of it is one projection over the scan: no shuffle, no Python.

Defined results: a null text counts as empty, and an empty text stays as it is (form ``plain``), as
does one that contains a marker, since it could not be told apart again. A null id is hashed as the
empty string. Repeated rows each give their own row. An empty table gives an empty result. Only id and
text are read, so other columns do no harm whatever their names.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = r"[^\n]*+\n|[^\n]++"


class Markers(NamedTuple):
    """Strings that introduce the parts; none may occur inside another or overlap itself."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def _regex(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def _insert(text: str) -> str:
    """The text as a literal of a replacement string."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _draw(digest: Column, k: int) -> Column:
    """The k-th 8-digit group of a hexadecimal digest as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _after(output: Column, marker: str) -> Column:
    """Characters up to the end of a marker."""
    return F.instr(output, marker) + F.lit(len(marker) - 1)


def fill_in_middle(df: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, markers: Markers = Markers(),
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, form, output, prefix_chars, middle_chars`` per row.

    ``rate`` percent of the rows are transformed, ``spm_rate`` percent of those with the suffix first
    (form ``spm``), the others prefix first (``psm``). Lengths are code points, null for ``plain``.
    """
    text, out = F.col("_text"), F.col("output")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), digest.alias("_digest"))
    rows = rows.withColumn("n", F.regexp_count("_text", F.lit(LINE)).cast("long"))
    one, two = (_draw(F.col("_digest"), k) % (F.col("n") + 1) for k in (0, 1))
    marked = F.lit(False)
    for marker in markers:
        marked = marked | F.contains(text, F.lit(marker))
    plain = (text == "") | marked | (_draw(F.col("_digest"), 2) % 100 >= rate)
    rows = rows.withColumns({
        "_a": F.least(one, two), "_b": F.greatest(one, two),
        "form": F.when(plain, "plain").when(_draw(F.col("_digest"), 3) % 100 < spm_rate, "spm").otherwise("psm")})
    units = lambda n: F.concat(F.lit(rf"((?:{LINE}){{"), n.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), units(F.col("_a")), units(F.col("_b") - F.col("_a")), F.lit(r"((?s:.*))\z"))
    p, s, m = (_insert(x) for x in markers)
    order = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    rows = rows.withColumn("output", F.when(F.col("form") == "plain", text).otherwise(F.regexp_replace(text, pattern, order)))
    spm, moved = F.col("form") == "spm", F.col("form") != "plain"
    # The markers do not occur in the parts, so the first of each in the output is the one put there.
    at = {x: _after(out, x) for x in markers}
    prefix = F.when(spm, at[markers.middle] - len(markers.middle) - at[markers.prefix]).otherwise(
        at[markers.suffix] - len(markers.suffix) - at[markers.prefix])
    return rows.select(
        id_col, "n", "form", "output", F.when(moved, prefix).cast("long").alias("prefix_chars"),
        F.when(moved, F.length(out) - at[markers.middle]).cast("long").alias("middle_chars"))


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text an output was made from."""
    p, s, m = (_regex(x) for x in markers)
    psm = F.regexp_replace(output, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
