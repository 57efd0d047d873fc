"""String and number helpers that keep the documents' original text conventions.

All of them are built-in JVM expressions; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space at the ends of a value.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# White space outside the six characters that the regular expression class \s knows.
RARE_CONTROL = "\x1c\x1d\x1e\x1f"
RARE_SPACE = RARE_CONTROL + (
    "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029"
    "\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def strip_text(c: Column) -> Column:
    """``strip`` for whole texts, where ``c`` is cheap to mention more than once.

    Trimming visits every character of a text, so one that begins and ends with a printable ASCII
    byte is handed on as it is.
    """
    def printable(at: int) -> Column:
        return F.substring(c.cast("binary"), at, 1).between(F.lit(b"!"), F.lit(b"~"))

    return F.when(printable(1) & printable(-1), c).otherwise(strip(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def word_count(c: Column) -> Column:
    """Number of white-space separated words.

    Rare spaces are replaced first, and only in texts that may hold one: a character class with
    all of them costs ten times as much per character.
    """
    def count(t: Column) -> Column:
        rare = F.octet_length(t) != F.char_length(t)
        for x in RARE_CONTROL:
            rare = rare | F.contains(t, F.lit(x))
        plain = F.when(rare, F.translate(t, RARE_SPACE, " " * len(RARE_SPACE))).otherwise(t)
        return F.regexp_count(plain, F.lit(r"\S+")).cast("bigint")

    return let(c, count)


def tokens(words: Column) -> Column:
    """Token estimate: four tokens for every three words, rounded down."""
    return F.floor(words * 4 / 3).cast("bigint")


def title_case(c: Column) -> Column:
    """Capitalise every run of letters, so ``o'brien-lee`` becomes ``O'Brien-Lee``."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def iso_date(c: Column) -> Column:
    """``yyyymmdd`` to ``yyyy-mm-dd``; anything that is not eight characters gives ''."""
    dashed = F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))
    return F.when(F.length(c) == 8, dashed).otherwise("")


# (upper bound, power of two): below the bound a double times that power is a whole number that
# fits 63 bits, down to the lower neighbour's bound. Values under 2**-21 round to zero at 6 digits.
_SCALES = [(2.0 ** -11, 73), (2.0 ** -2, 63), (2.0, 61), (2.0 ** 10, 52)]


def round_half_even(c: Column, digits: int) -> Column:
    """Round a non-negative double by its exact binary value, ties to even; up to six digits.

    ``round`` and ``bround`` look at the shortest decimal spelling, so 0.84875 (which is stored
    a little below that) goes the wrong way. Here the value is scaled by a power of two, which is
    exact, and the remainder is compared in integers. From 1024 on plain ``round`` serves.

    That is needed near a tie only. Elsewhere the product in doubles is off by less than a
    millionth, so the nearest whole number is the same, at a small part of the cost.
    """
    unit = F.lit(10 ** digits).cast("decimal(10,0)")

    def split(x: Column) -> Column:
        parts = F.lit(None).cast("struct<s:decimal(20,0),o:decimal(38,0)>")
        for bound, bits in reversed(_SCALES):
            half = F.lit(2 ** (bits // 2)).cast("decimal(38,0)")
            one = (half * F.lit(2 ** (bits - bits // 2)).cast("decimal(38,0)")).cast("decimal(38,0)")
            scaled = F.floor(x * F.lit(2.0 ** bits)).cast("decimal(20,0)")
            parts = F.when(x < bound, F.struct(scaled.alias("s"), one.alias("o"))).otherwise(parts)
        return parts

    def rounded(p: Column) -> Column:
        number = (p["s"] * unit).cast("decimal(38,0)")
        rest = number % p["o"]
        whole = ((number - rest) / p["o"]).cast("decimal(20,0)")
        up = (rest * 2 > p["o"]) | ((rest * 2 == p["o"]) & (whole % 2 == 1))
        return (whole + up.cast("decimal(1,0)")).cast("double") / float(10 ** digits)

    def nearest(x: Column) -> Column:
        number = x * F.lit(float(10 ** digits))
        whole = F.floor(number).cast("double")
        rest = number - whole
        clear = (x >= 0.0) & (x < 1024.0) & ((rest < 0.499) | (rest > 0.501))
        return F.when(clear, (whole + (rest > 0.5).cast("double")) / float(10 ** digits)).otherwise(
            F.coalesce(let(split(x), rounded), F.round(x, digits)))

    return let(c, nearest)


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def fixed_point(c: Column, digits: int) -> Column:
    """Text of a number with a fixed count of decimals."""
    return F.format_string(f"%.{digits}f", round_half_even(c, digits))


def quoted_list(c: Column) -> Column:
    """``['a', 'b']`` for an array of strings."""
    items = F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def quoted(c: Column) -> Column:
    """A value in quotes the way messages spell it: double quotes only around an apostrophe."""
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    body = F.replace(body, F.lit("\n"), F.lit("\\n"))
    body = F.replace(body, F.lit("\r"), F.lit("\\r"))
    body = F.replace(body, F.lit("\t"), F.lit("\\t"))
    single = F.contains(c, F.lit("'"))
    double = F.contains(c, F.lit('"'))
    return (
        F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def as_literal(values, sql_type: str) -> Column:
    """A nested constant as one expression: folded once by the optimizer, whatever its size."""
    import json

    return F.from_json(F.lit(json.dumps(values)), sql_type)
