"""Exact deduplication with a cuckoo-filter index over live digests.

A text's key is the SHA-256 of its UTF-8 bytes after lower-casing A-Z. Keys are dealt to buckets by
their first bytes. A bucket holds a cuckoo filter over its live keys and the keys themselves with
what is known of them (rows, largest id). A filter miss proves a key new without a look at the
stored content; a hit is verified against the stored content of the bucket. Keys can be deleted,
and a filter that runs full is rebuilt at twice the size from the stored keys.

Copies meet twice: each task first folds the rows it reads into one row a key, so a text that makes
up a third of the corpus reaches its bucket as one row a task.

Defined results: a null text counts as empty, and empty texts are equal to each other. Of rows that
also share the largest id (repeated rows), all report the same ``keep_id``; ``keep_one`` keeps one.
A null id counts as the smallest; a group of nothing but null ids keeps all its rows in ``dedup``
(nothing tells them apart) and one in ``keep_one``. An empty table gives an empty result. Other
columns are carried by ``keep_one`` and ignored by ``dedup``; names of theirs that clash with result
columns do no harm, as only ``id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow.llm.common import parallel, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS = 4  # entries per filter bucket
KICKS = 256  # moves before a filter counts as full


class CuckooFilter:
    """Set membership of byte digests with 16-bit fingerprints, insertion and deletion.

    ``contains`` has no false negatives. ``insert`` returns False when the filter is full; it is then
    unchanged. ``delete`` must only be called for digests that were inserted.
    """

    def __init__(self, capacity: int):
        n = 1
        while n * SLOTS * 0.85 < capacity:
            n *= 2
        self.mask, self.table, self.size = n - 1, [[] for _ in range(n)], 0

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[-2:], "little") | 1

    def _other(self, i: int, fp: int) -> int:
        return (i ^ (fp * 0x5BD1E995)) & self.mask

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        fp = self._print(digest)
        i = int.from_bytes(digest[8:16], "little") & self.mask
        return fp, i, self._other(i, fp)

    def contains(self, digest: bytes) -> bool:
        fp, i, j = self._places(digest)
        return fp in self.table[i] or fp in self.table[j]

    def insert(self, digest: bytes) -> bool:
        fp, i, j = self._places(digest)
        for at in (i, j):
            if len(self.table[at]) < SLOTS:
                self.table[at].append(fp)
                self.size += 1
                return True
        moves, at = [], j
        for k in range(KICKS):
            slot = (k * 7 + fp) % SLOTS
            moves.append((at, slot))
            self.table[at][slot], fp = fp, self.table[at][slot]
            at = self._other(at, fp)
            if len(self.table[at]) < SLOTS:
                self.table[at].append(fp)
                self.size += 1
                return True
        for at, slot in reversed(moves):  # full: undo
            self.table[at][slot], fp = fp, self.table[at][slot]
        return False

    def delete(self, digest: bytes) -> bool:
        fp, i, j = self._places(digest)
        for at in (i, j):
            if fp in self.table[at]:
                self.table[at].remove(fp)
                self.size -= 1
                return True
        return False


class DigestIndex:
    """Live digests of one bucket: a cuckoo filter in front of the stored keys.

    The stored entry of a key is ``[rows, largest id, rows that have it]``.
    """

    def __init__(self, capacity: int = 64):
        self.filter, self.keys = CuckooFilter(capacity), {}
        self.resizes = self.false_hits = 0

    def find(self, digest: bytes) -> list | None:
        if not self.filter.contains(digest):
            return None
        entry = self.keys.get(digest)  # a hit is only a hit if the stored key agrees
        self.false_hits += entry is None
        return entry

    def add(self, digest: bytes, rows: int, top: int | None, tops: int) -> None:
        entry = self.find(digest)
        if entry is None:
            self.keys[digest] = [rows, top, tops]
            if not self.filter.insert(digest):
                self._resize()
            return
        entry[0] += rows
        if top == entry[1]:
            entry[2] += tops
        elif entry[1] is None or (top is not None and top > entry[1]):
            entry[1], entry[2] = top, tops

    def remove(self, digest: bytes) -> bool:
        """Forget a live digest; False if it is not live."""
        if self.find(digest) is None:
            return False
        del self.keys[digest]
        self.filter.delete(digest)
        return True

    def _resize(self) -> None:
        capacity = 2 * max(len(self.keys), (self.filter.mask + 1) * SLOTS)
        while True:
            self.filter = CuckooFilter(capacity)
            if all(self.filter.insert(k) for k in self.keys):
                break
            capacity *= 2
        self.resizes += 1

    def entries(self) -> pa.RecordBatch:
        v = list(self.keys.values())
        return pa.RecordBatch.from_arrays([
            pa.array(list(self.keys), pa.binary()), pa.array([x[0] for x in v], pa.int64()),
            pa.array([x[1] for x in v], pa.int64()), pa.array([x[2] for x in v], pa.int64())], names=NAMES)


NAMES = ["digest", "rows", "top", "tops"]
INDEX = "digest binary, rows long, top long, tops long"
#: Live keys a first-pass index holds before it hands them on and starts anew.
FOLD_KEYS = 200_000


def normalised(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digest_hex(text: Column | str) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _add_all(index: DigestIndex, batch: pa.RecordBatch) -> None:
    for d, r, t, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
        index.add(d, r, t, n)


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a key for what a task reads; keys seen again after a hand-on simply come twice."""
    index = DigestIndex()
    for batch in batches:
        _add_all(index, batch)
        if len(index.keys) >= FOLD_KEYS:
            yield index.entries()
            index = DigestIndex()
    yield index.entries()


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of some buckets, sorted by bucket: an index a bucket, handed on when the next begins."""
    index, bucket = DigestIndex(), None
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        for b, d, r, t, n in zip(*cols, strict=True):
            if b != bucket:
                if index.keys:
                    yield index.entries()
                index, bucket = DigestIndex(), b
            index.add(d, r, t, n)
    if index.keys:
        yield index.entries()


def build_index(rows: DataFrame) -> DataFrame:
    """Merge rows of the index's shape (``INDEX``) into one row a digest.

    The first two digest bytes name one of 65,536 buckets, so a bucket of a corpus of 10^10 texts
    holds some 150,000 keys.
    """
    folded = rows.select(*NAMES).mapInArrow(_fold, INDEX)
    bucket = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    dealt = folded.select(bucket.alias("bucket"), *NAMES).repartition(parallel(rows), "bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(_merge, INDEX)


def insert_into(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index after more rows: live keys gain rows, new keys are inserted."""
    return build_index(index.select(*NAMES).unionByName(rows.select(*NAMES)))


def delete_from(index: DataFrame, digests: DataFrame) -> DataFrame:
    """The index without the given digests (column ``digest``); unknown ones are ignored."""
    gone = digests.select("digest", F.lit(True).alias("gone")).distinct()
    both = index.select(*NAMES, F.lit(False).alias("gone")).unionByName(
        gone.select("digest", *(F.lit(None).cast("long").alias(c) for c in NAMES[1:]), "gone"))
    bucket = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    dealt = both.withColumn("bucket", bucket).repartition(parallel(index), "bucket")

    def per_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, at = DigestIndex(), None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != at:
                    if live.keys:
                        yield live.entries()
                    live, at = DigestIndex(), row["bucket"]
                if row["gone"]:
                    live.remove(row["digest"])
                else:
                    live.add(row["digest"], row["rows"], row["top"], row["tops"])
        if live.keys:
            yield live.entries()

    return dealt.sortWithinPartitions("bucket", "gone").mapInArrow(per_bucket, INDEX)


def rows_for_index(keyed: DataFrame, id_col: str, hex_col: str) -> DataFrame:
    return keyed.select(F.unhex(hex_col).alias("digest"), F.lit(1).cast("long").alias("rows"),
                        F.col(id_col).cast("long").alias("top"), F.lit(1).cast("long").alias("tops"))


def _known(keyed: DataFrame, id_col: str, hex_col: str) -> DataFrame:
    index = build_index(rows_for_index(keyed, id_col, hex_col))
    return index.select(F.lower(F.hex("digest")).alias("_hex"), F.col("rows").alias("_rows"),
                        F.col("top").alias("_top"), F.col("tops").alias("_tops"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    keyed = stored(df.select(F.col(id_col).cast("long").alias("_id"), digest_hex(text_col).alias("_key")), "digests")
    known = stored(_known(keyed, "_id", "_key"), "digest-index")
    return keyed.join(known, keyed["_key"] == known["_hex"]).select(
        F.col("_id").alias(id_col), F.col("_top").alias("keep_id"), F.col("_rows").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_top")).alias("kept"), F.col("_key").alias("text_sha256"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one for each text."""
    # The row travels as one column, so no name of its own can clash with the columns added here.
    keyed = df.select(F.struct(*df.columns).alias("_row"), F.col(id_col).cast("long").alias("_id"), digest_hex(text_col).alias("_key"))
    known = stored(_known(keyed.select("_id", "_key"), "_id", "_key"), "digest-index")
    both = keyed.join(known, F.col("_key") == F.col("_hex")).where(F.col("_id").eqNullSafe(F.col("_top")))
    single = both.where("_tops = 1").select("_row")
    tied = both.where("_tops > 1").dropDuplicates(["_key"]).select("_row")
    return single.unionByName(tied).select("_row.*")
