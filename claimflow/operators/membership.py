"""Exact membership of values in a reference of any size, without moving the rows that ask.

A Bloom filter is built from the reference in tasks and written as one row of 64-bit words; its size is
a parameter. It reaches the asking rows as a scalar subquery, so it is a constant of the projection: the
rows are neither joined nor shuffled. The filter never denies a member. What it wrongly admits is found from the distinct values alone: those that pass
are anti-joined with the reference, and the few left over (``false hits``) go back as a set of constants.
If they are too many, the filter is built again with twice the bits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

HASHES = 6
BITS_PER_KEY = 16
#: A filter never has more words than this: 32 MB.
MAX_WORDS = 1 << 22
#: False hits that go back as constants.
FALSE_HITS = 2_000


def place(key: Column, words: int) -> tuple[Column, Column]:
    """The key's word and its bits in that word: all of a key's bits lie in one word, so a test reads one."""
    bits = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("bigint")
    for i in range(HASHES):
        at = F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return F.pmod(F.xxhash64(key), F.lit(words)), mask


def build_filter(keys: DataFrame, words: int) -> DataFrame:
    """One row with the ``words`` of a filter over the frame's only column.

    Bits are merged before the shuffle, so what arrives is at most one row a word and task.
    """
    word, mask = place(F.col(keys.columns[0]), words)
    at = keys.select(word.cast("bigint").alias("word"), mask.alias("bits"))
    empty = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    merged = at.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return merged.agg(F.transform(ordered, lambda w: w["bits"]).alias("words"))


def passes(key: Column, filter_row: DataFrame, words: int) -> Column:
    """Whether the filter admits the key: true for every member; NULL for NULL.

    The filter is named once: every mention is a copy of all its words in what the driver sends to the tasks.
    """
    word, mask = place(key, words)
    missing = mask.bitwiseAND(F.bitwise_not(F.get(filter_row.select("words").scalar(), word.cast("int"))))
    # The sign bit of (count - 1) is set when no bit is missing.
    return F.when(key.isNotNull(), F.getbit(F.bit_count(missing) - 1, F.lit(31)) == 1)


@dataclass
class Members:
    """A finished test: ``known(column)`` is exact for the values it was made for."""

    filter_row: DataFrame
    words: int
    false_hits: list[str]

    def known(self, key: Column) -> Column:
        admitted = passes(key, self.filter_row, self.words)
        return admitted & ~key.isin(self.false_hits) if self.false_hits else admitted


def exact_members(asked: DataFrame, reference: DataFrame, bits_per_key: int = BITS_PER_KEY,
                  false_hits: int = FALSE_HITS, max_words: int = MAX_WORDS) -> Members | None:
    """The test for the values in ``asked`` (one string column) against ``reference`` (one column).

    Both are read in tasks only. ``asked`` is made distinct before it is shuffled, so a value with a
    third of all rows is one row a task. None if no filter within ``max_words`` leaves few enough
    false hits; callers then join.
    """
    name = asked.columns[0]
    keys = reference.select(F.col(reference.columns[0]).cast("string").alias(name)).where(F.col(name).isNotNull()).distinct()
    keys = written(keys, "reference")
    distinct = written(asked.where(F.col(name).isNotNull()).distinct(), "asked")
    count = keys.count()
    words = max(1, -(-count * bits_per_key // 64))
    while words <= max_words:
        row = written(build_filter(keys, words), "filter")
        admitted = distinct.where(passes(F.col(name), row, words))
        wrong = [r[0] for r in admitted.join(keys, name, "left_anti").limit(false_hits + 1).collect()]
        if len(wrong) <= false_hits:
            return Members(row, words, wrong)
        words *= 2
    return None

