"""Mixing sources to target weights.

Each source's documents are laid end to end and cut into fixed-length blocks of words. A source's
target is a number of words: whole passes over its blocks, then whole blocks, then a part of one. Each
of these is a slot of the mix, and a source's slots fall on the output shards by a multinomial draw, so
shards look alike and every source comes out at its target. Slot ``i`` of a source with ``n`` blocks
takes block ``permutation[i div n](i mod n)``: every pass over a source visits each block once, in a
pseudorandom order that needs no shuffled list (a Feistel network that walks cycles back into range).
The last block, which may be short, ends its pass, so that the words of the first ``i`` slots are known.
Slots and blocks meet in a join on the block index.

Places in a source come from sums over hashed parts of it and running sums over the parts, so no
source's documents have to pass through one task. Sources are a table like any other: their order is a
sort, their weights' common level comes from a few aggregations, their draws are made in tasks.

Defined results: a null text has size 0; null sources are one source, last in order. Repeated rows
are documents of their own. A source without words has target 0. An empty table gives an empty
result. Columns other than id, text and source are carried by ``mixed_documents`` and ignored
otherwise; result names win no clash, as inputs are renamed first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimflow.llm.common import parallel, stored
from claimflow.operators.lookup import lookup_join

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words, what the mix takes
LIMIT = 2.0  # times its size, what a source gives at most
SHARDS = 64
PARTS = 4096  # parts of a source whose sums are run over
SLOTS_PER_ROW = 100_000
DRAWS = 10_000  # rows handed on at once
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """What ``source_table`` computes, for the sizes of a few sources in order: ``share`` of all words by
    weight, no source above ``limit`` times its size, the excess going to the others by weight."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    while open_:
        level = left / sum(weight[i] for i in open_)
        full = [i for i in open_ if weight[i] * level >= limit * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weight[i] * level
            break
        for i in full:
            out[i] = limit * sizes[i]
            left -= out[i]
        done = set(full)
        open_ = [i for i in open_ if i not in done]
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of ``range(n)``, chosen by ``key``, at the given places."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def walk(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for r in range(4):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            f = (right ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << shift) | right

    out = walk(index.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = walk(out[far])
    return out.astype(np.int64)


def placed(df: DataFrame, id_col: str, text_col: str, source_col: str, carry: bool) -> DataFrame:
    """Rows with ``_source``, ``_size`` and ``_start``, the words before them in their source."""
    own = [F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("_source"),
           word_count(text_col).alias("_size"), F.xxhash64(text_col).alias("_hash")]
    rows = df.select(*own, *([F.struct(*df.columns).alias("_row")] if carry else []))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_id", "_hash"), F.lit(PARTS)).cast("int"))
    if not carry:
        rows = stored(rows, "sizes")
    sums = rows.groupBy("_source", "_part").agg(F.sum("_size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_part")
                                .rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"),
                       F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("_size").over(Window.partitionBy("_source", "_part").orderBy(
        F.col("_id").asc_nulls_first(), "_size", "_hash").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_within", within - F.col("_size"))
    on = rows["_source"].eqNullSafe(sums["_s"]) & (rows["_part"] == sums["_p"])
    return rows.join(sums, on).withColumn("_start", F.col("_before") + F.col("_within")).drop(
        "_s", "_p", "_part", "_before", "_within", "_hash")


def water_level(sources: DataFrame, share: float, limit: float) -> float:
    """Words per unit of weight of the sources that are not full (infinite if all are).

    The level rises from round to round as full sources hand on their excess, so the full ones of a round
    are those of all rounds before and some more; it ends when none joins them.
    """
    level, weight, total = 0.0, -1, 0
    while True:
        full = F.col("_weight") * F.lit(level) >= F.lit(limit) * F.col("_source_size")
        row = sources.where("_source_size > 0").agg(
            F.sum("_source_size"), F.sum(F.when(full, F.col("_source_size"))), F.sum(F.when(~full, F.col("_weight")))).first()
        total, given, open_ = row[0] or 0, row[1] or 0, row[2] or 0
        if not open_:
            return float("inf")
        if open_ == weight:
            return level
        weight, level = open_, (share * total - limit * given) / open_


def source_table(rows: DataFrame, block: int, weights: tuple, share: float, limit: float) -> DataFrame:
    """One row a source: ``_at`` (its place in order), size, target, blocks, slots and, where the last slot
    takes a part of its block only, that part's words in ``_last`` (else 0)."""
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    ordered = stored(sizes.orderBy(F.col("_source").asc_nulls_last()).withColumn("_mark", F.monotonically_increasing_id()), "sources")
    # The mark is the sort's partition and the place in it: one row a partition is summed over.
    part, within = F.shiftright("_mark", 33).alias("_p"), F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ordered.groupBy(part).agg(F.count("*").alias("_n")).select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    placed_ = ordered.join(F.broadcast(offsets), F.shiftright("_mark", 33) == F.col("_p"))
    at = F.col("_before") + within
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (at % len(weights) + 1).cast("int"))
    sources = stored(placed_.select("_source", "_source_size", at.alias("_at"), weight.alias("_weight")), "weights")
    size, level = F.col("_source_size"), F.lit(water_level(sources, share, limit))
    most = F.lit(limit) * size
    target = F.when(size > 0, F.least(F.col("_weight") * level, most)).otherwise(F.lit(0.0))
    sources = sources.withColumn("_target", target.cast("double"))
    words = F.least(F.round("_target"), F.floor(most)).cast("long")
    blocks = F.ceil(size / block).cast("long")
    rest = F.col("_words") % F.greatest(size, F.lit(1))
    sources = sources.withColumn("_words", words).withColumns({"_blocks": blocks, "_last": rest % block})
    slots = F.floor(F.col("_words") / F.greatest(size, F.lit(1))) * F.col("_blocks") + F.ceil(rest / block)
    return stored(sources.withColumn("_slots", slots.cast("long")).drop("_words", "_weight"), "plan")


def slot_table(sources: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """One row per slot of the mix: shard, _at (the source's place), slot, _epoch, _block and _take, the
    words that it may take of the block."""

    def draw(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rows = ["shard", "at", "blocks", "slots", "last", "first", "n"], []
        even = np.full(shards, 1 / shards)
        for batch in batches:
            for r in batch.itertuples(index=False):
                counts = np.random.default_rng([seed, int(r.at)]).multinomial(int(r.slots), even)
                ends = np.cumsum(counts)
                for shard in np.flatnonzero(counts):
                    for first in range(int(ends[shard] - counts[shard]), int(ends[shard]), SLOTS_PER_ROW):
                        rows.append((shard, r.at, r.blocks, r.slots, r.last, first, min(int(ends[shard]) - first, SLOTS_PER_ROW)))
                        if len(rows) == DRAWS:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    def expand(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, held, size = ["shard", "_at", "slot", "_epoch", "_block", "_take"], [], 0

        def together() -> pd.DataFrame:
            return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*held, strict=True)), strict=True)))

        for batch in batches:
            for r in batch.itertuples(index=False):
                slot = np.arange(r.first, r.first + r.n)
                epoch, index = slot // r.blocks, slot % r.blocks
                taken = np.full(r.n, r.blocks - 1, np.int64)
                for e in np.unique(epoch):
                    own = (epoch == e) & (index < r.blocks - 1)
                    taken[own] = permuted(index[own], int(r.blocks) - 1, seed * 1_000_003 + int(r.at) * 1009 + int(e))
                take = np.full(r.n, block, np.int64)
                if r.last:
                    take[slot == r.slots - 1] = r.last
                held.append((np.full(r.n, r.shard, np.int32), np.full(r.n, r.at, np.int64), slot, epoch.astype(np.int32), taken, take))
                size += r.n
                if size >= SLOTS_PER_ROW:
                    yield together()
                    held, size = [], 0
        if held:
            yield together()

    plan = sources.where("_slots > 0").select(*[F.col(f"_{c}").alias(c) for c in ("at", "blocks", "slots", "last")])
    draws = plan.mapInPandas(draw, "shard int, at long, blocks long, slots long, last long, first long, n long")
    return draws.repartition(parallel(sources), "shard", "at", "first").mapInPandas(
        expand, "shard int, _at long, slot long, _epoch int, _block long, _take long")


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's place, size and target; beyond a counted bound by a salted join."""
    name = F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("")).alias("_name")
    return lookup_join(rows.select("*", name), sources.select(name, "_at", "_source_size", "_target"), "_name", "_name",
                       ["_id", "_start"], "inner").drop("_name")


def _spans(rows: DataFrame, block: int) -> DataFrame:
    """A row for each document and block that share words: those from ``_low`` up to ``_high``."""
    touched = F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("_size") - 1) / block))
    out = rows.where("_size > 0").select("_at", "_start", "_size", F.explode(touched).alias("_block"))
    low = F.greatest("_start", F.col("_block") * block)
    high = F.least(F.col("_start") + F.col("_size"), (F.col("_block") + 1) * block)
    return out.withColumns({"_low": low, "_high": high})


def mix(df: DataFrame, block: int = 32, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT, shards: int = SHARDS,
        seed: int = 20240601) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``taken``."""
    rows = stored(placed(df, id_col, text_col, source_col, carry=False), "placed")
    sources = source_table(rows, block, weights, share, limit)
    rows = _with_source(rows, sources)
    slots = slot_table(sources, block, shards, seed)
    # Written: the planner knows its true size then, and does not take it for one to broadcast.
    whole = F.col("_take") == block  # all slots of a source but its last one
    uses = stored(slots.groupBy("_at", "_block").agg(
        F.count_if(whole).alias("_uses"), F.coalesce(F.max(F.when(~whole, F.col("_take"))), F.lit(0)).alias("_part")), "uses")
    part = F.greatest(F.lit(0), F.least("_high", F.col("_block") * block + F.col("_part")) - F.col("_low"))
    words = (F.col("_high") - F.col("_low")) * F.col("_uses") + part
    taken = _spans(rows, block).join(uses, ["_at", "_block"]).groupBy("_at", "_start").agg(
        F.sum(words).alias("_taken")).withColumnsRenamed({"_at": "_a", "_start": "_b"})
    on = (rows["_at"] == taken["_a"]) & (rows["_start"] == taken["_b"]) & (rows["_size"] > 0)
    return rows.join(taken, on, "left").select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, block: int = 1024, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", chars_col: str | None = "n_chars", weights: tuple = WEIGHTS,
                    share: float = SHARE, limit: float = LIMIT, shards: int = SHARDS,
                    seed: int = 20240601) -> DataFrame:
    """The mix itself, with the columns of ``df``: each row is an unbroken run of blocks that one pass
    takes from one document. A run over a whole document is its text unchanged, another is its words
    with the white space between them. Documents without words are not in the mix.
    """
    import re

    rows = stored(placed(df, id_col, text_col, source_col, carry=True), "placed")
    sources = source_table(rows, block, weights, share, limit)
    rows = _with_source(rows, sources)
    slots = stored(slot_table(sources, block, shards, seed).select("_at", "_block", "_epoch", "_take"), "slots")
    # A document's own blocks: as many as it has words, at most.
    taken = _spans(rows, block).join(slots, ["_at", "_block"]).groupBy("_at", "_start").agg(
        F.sort_array(F.collect_list(F.struct("_epoch", "_block", "_take"))).alias("_taken"))
    both = rows.join(taken, ["_at", "_start"]).where("_size > 0")
    word, text_at = re.compile(WORD), df.columns.index(text_col)

    def runs(text: str, start: int, size: int, taken: list) -> list[str]:
        out, at = [], 0
        while at < len(taken):
            to = at + 1
            while to < len(taken) and taken[to - 1]["_take"] == block and taken[to]["_epoch"] == taken[at]["_epoch"] and (
                    taken[to]["_block"] == taken[to - 1]["_block"] + 1):
                to += 1
            low = max(0, taken[at]["_block"] * block - start)
            high = min(size, taken[to - 1]["_block"] * block + taken[to - 1]["_take"] - start)
            if high <= low:
                pass  # the part of the block ends before this document
            elif (low, high) == (0, size):
                out.append(text)
            else:
                ends = [m.span() for m in word.finditer(text)]
                out.append(text[ends[low][0] : ends[high - 1][1]])
            at = to
        return out

    kind = "array<string>"
    cut = F.udf(runs, kind)
    out = both.select("_row", F.explode(cut(F.col("_row")[df.columns[text_at]], "_start", "_size", "_taken")).alias("_text"))
    new = {text_col: F.col("_text"), **({chars_col: F.length("_text").cast(df.schema[chars_col].dataType)}
                                        if chars_col in df.columns else {})}
    return out.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in df.columns))
