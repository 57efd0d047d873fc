"""Lookups in reference tables of any size.

A reference table is broadcast only after a count that stops at the bound. Beyond it the join
shuffles both sides with a salt: each hot key of the documents is spread over ``salts`` tasks and
the reference rows are repeated once per salt, so a key that holds a third of all rows does not
end in one task. Results are the same either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
LITERAL_ROWS = 2_000


def is_small(reference: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when the reference has at most ``rows`` rows; never counts further than that."""
    return reference.limit(rows + 1).count() <= rows


def lookup_join(left: DataFrame, reference: DataFrame, left_key: str, reference_key: str,
                spread: list[str], how: str = "left", rows: int = BROADCAST_ROWS,
                salts: int = 32) -> DataFrame:
    """Join ``left`` to ``reference`` on one key.

    ``spread`` names columns of ``left`` that vary within a hot key (a record id); they decide
    the salt, so a task that runs again makes the same choice.
    """
    ref = reference.withColumnRenamed(reference_key, "_key")
    if is_small(reference, rows):
        return left.join(F.broadcast(ref), left[left_key] == ref["_key"], how).drop("_key")
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = ref.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    match = (salted[left_key] == copies["_key"]) & (salted["_salt"] == copies["_copy"])
    return salted.join(copies, match, how).drop("_key", "_copy", "_salt")
