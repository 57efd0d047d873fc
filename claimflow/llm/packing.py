"""Best-fit-decreasing packing of tokenised documents into sequences.

A document is its token ids plus an end id; one longer than a sequence is cut into full sequences,
the first piece taking what does not divide. Best-fit decreasing looks at lengths alone, and pieces
of one length are interchangeable. So the whole corpus is packed at once from a histogram of at most
1024 counters, whatever its size: lengths go from long to short, a segment tree over remaining
capacities finds the tightest open bin that fits, and a run of bins with the same room takes a run of
equal pieces in one step. The resulting list of runs is a small table (its size depends on the
sequence length alone); each piece finds its bin by its length and its rank among pieces of that
length, which Spark counts.

Defined results: null and empty texts are the end id alone. Repeated rows are documents of their
own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimflow.llm.common import small_batches, stored

SEQUENCE = 1024
END_ID = 2
#: Pieces of one length are ranked in this many parts.
RANK_PARTS = 4096
#: Letters, signs or spaces in a row from which the rank-based encoder is slow.
_LONG_RUN = re.compile(r"\S{500}|\s{500}")


class Encoder:
    """Token ids as little-endian bytes, read from the tokenizer's own file.

    Byte-pair merges in rank order give the same ids in any library. Where the file is a plain
    byte-level vocabulary whose ids follow its merges, the ranks go to the faster one; texts with a
    very long unbroken run, which it takes square time for, texts that hold an added token such as
    <|endoftext|>, which has an id of its own, and any other file go to ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = _ranked(spec)
        added = [re.escape(x["content"]) for x in spec.get("added_tokens") or ()]
        self.slow_text = re.compile("|".join([_LONG_RUN.pattern, *added]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        rest = [i for i, t in enumerate(texts) if t and (self.fast is None or self.slow_text.search(t))]
        for i, e in zip(rest, self.slow.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False),
                        strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        done = set(rest)
        for i, t in enumerate(texts):
            if t and i not in done:
                out[i] = np.array(self.fast.encode_ordinary(t), "<u4").tobytes()
        return out


def _ranked(spec: dict):
    """A rank-based encoding of the file's vocabulary, or None where ranks do not describe it."""
    import tiktoken
    from public_tokenizers import PATTERN

    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
    if not plain or spec.get("normalizer") or model.get("type") != "BPE":
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    letters = {chr(b): b for b in shown}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = {x["content"] for x in spec.get("added_tokens") or ()}
    vocab = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in added}
    joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"][word] for word in joined]
    if ids != sorted(set(ids)) or len(vocab) != 256 + len(ids):
        return None
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a process, kept for later tasks."""
    return Encoder(path)


def token_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    small_batches(df.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of = encoder(tokenizer).encode
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 100):
                for doc, data in zip(ids[at : at + 100], ids_of(texts[at : at + 100]), strict=True):
                    data += end
                    n = len(data) // 4
                    start, size, piece = 0, n % length or length, 0
                    while start < n:
                        for col, v in zip(out, (doc, piece, start, size,
                                                zlib.crc32(data[4 * start : 4 * (start + size)])), strict=True):
                            col.append(v)
                        start, size, piece = start + size, length, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()),
                                                strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class CapacityTree:
    """Segment tree over remaining capacities: the tightest capacity with open bins, in log time."""

    def __init__(self, capacity: int):
        self.n = 1
        while self.n <= capacity:
            self.n *= 2
        self.open = [0] * (2 * self.n)  # open bins below each node

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.n
        while i:
            self.open[i] += bins
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has an open bin."""
        i = least + self.n
        if self.open[i]:
            return least
        while i > 1:  # climb until a right sibling has bins
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.n:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.n


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Runs ``(length, first rank, pieces, first bin, offset)``: pieces ``first rank + i`` go to bins
    ``first bin + i`` at ``offset``. The bins are those of one piece at a time, tightest first.
    """
    tree, room = CapacityTree(capacity), {}
    runs, bins = [], 0

    def reopen(left: int, first: int, n: int) -> None:
        if left and n:
            room.setdefault(left, []).append((first, n))
            tree.add(left, n)

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            left = tree.tightest(length)
            if left is None:
                left, first, n = capacity, bins, -(-(total - rank) // (capacity // length))
                bins += n
            else:
                first, n = room[left].pop()
                tree.add(left, -n)
            # A bin that took a piece is the tightest while it fits another, so bins are filled in turn.
            fill = left // length
            full, rest = min(n, (total - rank) // fill), 0
            if full < n:
                rest = total - rank - full * fill
            for k in range(fill):
                here = full + (k < rest)
                if here:
                    runs.append((length, rank, here, first, capacity - left + k * length))
                    rank += here
            reopen(left - fill * length, first, full)
            if full < n:
                reopen(left - rest * length, first + full, 1)
                reopen(left, first + full + 1, n - full - 1)
    return runs


def pack(pieces: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (columns doc_id, piece, length at least)."""
    spark = pieces.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_PARTS)).cast("int")
    pieces = stored(pieces.withColumn("_part", part), "pieces")
    sizes = stored(pieces.groupBy("length", "_part").agg(F.count("*").alias("_n")), "lengths")
    # One row for each length: bounded by the sequence length.
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = best_fit_runs(counts, capacity) or [(0, 0, 0, 0, 0)]
    table = {}
    for length, rank, n, first, offset in runs:
        table.setdefault(length, []).append((rank, n, first, offset))
    table = {k: np.array(sorted(v), np.int64) for k, v in table.items()}
    shared = spark.sparkContext.broadcast(table)

    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part")
                              .rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_part").orderBy(
        F.col("doc_id").asc_nulls_first(), "piece", "ids_crc32"))
    ranked = pieces.withColumn("_within", within - 1).join(starts, ["length", "_part"]).withColumn(
        "_rank", F.col("_within") + F.col("_before"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_of = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                own = runs_of[int(value)]
                k = np.searchsorted(own[:, 0], rank[at], "right") - 1
                seq[at] = own[k, 2] + rank[at] - own[k, 0]
                off[at] = own[k, 3]
            kept = [batch.column(c) for c in COLUMNS]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)],
                                             names=[*COLUMNS, "sequence_id", "offset"])

    return ranked.select(*COLUMNS, F.col("_rank").cast("long")).mapInArrow(place, PACKED)


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = SEQUENCE) -> DataFrame:
    return pack(token_pieces(df, tokenizer, id_col, text_col, capacity), capacity)
