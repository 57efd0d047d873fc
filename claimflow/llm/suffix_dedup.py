"""Removal of repeated byte strings with a sparse suffix array, sorted deep-shallow.

A byte goes if some ``LENGTH``-byte string that covers it starts anywhere else as well, in the same
document or another. Matches never cross documents and are judged on the input.

1. Every window of ``LENGTH`` bytes names one anchor: the start of the least of its ``GRAM``-byte
   strings (by hash, leftmost first). Equal windows have equal anchors at equal places. The windows
   of one anchor that follow each other are a unit: two numbers and the bytes they span. There is a
   unit for some 85 bytes of text.
2. Spark counts anchors' grams; a unit whose gram occurs once holds nothing repeated. Units that are
   equal as a whole are counted next, with partial sums before the shuffle, so large groups of copies
   stay small: all windows of a unit that occurs twice are repeated.
3. What is left are distinct units with a common gram: the edges of repeated passages. Their texts
   before the anchor (reversed) and from the anchor on are two sparse suffix arrays. Each is sorted
   deep-shallow: multikey quicksort down to ``SHALLOW`` bytes, where most suffixes part, and blind
   tries for the groups that share more. Two units share the window that begins d bytes before the
   anchor exactly if the common prefixes reach d in one array and ``LENGTH - d`` in the other, which
   neighbours in both orders tell for all units at once.
4. A gram with more than ``GROUP`` distinct units is not gathered in one task: its windows are dealt
   out and counted one by one, by a hash.

Defined results: null and empty texts have no bytes and nothing removed. Texts are their UTF-8 bytes.
Repeated rows are documents of their own, so their texts repeat; rows with equal ids and texts get
equal results. Null ids are kept. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.llm.common import blocks, mix, parallel, prefix_hash, small_batches, span_hash, stored, text_buffers

LENGTH = 400
GRAM = 232
SHALLOW = 32
#: Distinct units of one gram that one task sorts.
GROUP = 50_000
#: Units a task sorts at once.
SORTED = 20_000
PART_BYTES = 4 << 20  # of a very long text, worked on at once
_PLACE = np.uint64((1 << 24) - 1)

UNIT = "doc long, key long, at long, lo int, hi int, gram long, unit long"


def units_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Units of a block of texts: row, at (anchor), lo and hi (window starts lie hi..lo bytes before
    the anchor), gram and unit hashes."""
    width = length - gram + 1
    n = len(data) - length + 1
    if n <= 0:
        return {}
    prefix = prefix_hash(data)
    starts = np.arange(len(data) - gram + 1)
    hashes = span_hash(prefix, starts, starts + gram)
    packed = (hashes & ~_PLACE) | starts.astype(np.uint64)
    padded = np.full(-(-len(packed) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(packed)] = packed
    table = padded.reshape(-1, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n], before[width - 1 : width - 1 + n])
    anchor = (least & _PLACE).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(len(data)), "right") - 1 if len(offsets) > 2 else np.zeros(len(data), int)
    within = row[:n] == row[length - 1 :]
    change = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (within[1:] != within[:-1]), [True]]))
    first, last = change[:-1], change[1:] - 1
    real = within[first]
    first, last = first[real], last[real]
    at = anchor[first]
    hi, lo = at - first, at - last
    unit = mix(span_hash(prefix, first, last + length) + hi.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return {"row": row[first], "at": at - offsets[row[first]], "lo": lo, "hi": hi, "gram": hashes[at].view(np.int64),
            "unit": unit.view(np.int64)}


def _units(length: int, gram: int):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = batch.column(0), batch.column(1)
            data, offsets = text_buffers(batch.column(2))
            for i, j in blocks(offsets):
                size = offsets[j] - offsets[i]
                for lo in range(0, max(int(size), 1), PART_BYTES):
                    if j - i > 1 or size <= PART_BYTES:
                        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                    else:  # window starts lo .. lo + PART_BYTES of one long text
                        part = data[offsets[i] + lo : min(offsets[i] + lo + PART_BYTES + length - 1, offsets[j])]
                        own = np.array([0, len(part)])
                    got = units_of(part, own, length, gram)
                    if got:
                        rows = pa.array(got["row"] + i)
                        yield pa.RecordBatch.from_arrays([
                            doc.take(rows), key.take(rows),
                            pa.array(got["at"] + (lo if len(own) == 2 and j - i == 1 else 0)),
                            pa.array(got["lo"].astype(np.int32)), pa.array(got["hi"].astype(np.int32)),
                            pa.array(got["gram"]), pa.array(got["unit"])],
                            names=["doc", "key", "at", "lo", "hi", "gram", "unit"])
                    if j - i > 1 or size <= PART_BYTES:
                        break

    return find


class BlindTrie:
    """Orders strings that share a long prefix, looking at one byte per branch on the way down.

    A node holds the first byte position in which its strings differ and its children by that byte
    (-1 where a string ends). A new string goes down by those bytes alone, is compared once with the
    leaf it reaches, and is put in at the position in which the two part.
    """

    def __init__(self, strings: list[bytes], depth: int):
        self.strings, self.depth, self.root = strings, depth, None

    @staticmethod
    def _byte(s: bytes, at: int) -> int:
        return s[at] if at < len(s) else -1

    def _leaf(self, s: bytes):
        node = self.root
        while isinstance(node, tuple):
            at, children = node
            node = children.get(self._byte(s, at)) or next(iter(children.values()))
        return node

    def insert(self, index: int) -> None:
        s = self.strings[index]
        if self.root is None:
            self.root = [index]
            return
        leaf = self._leaf(s)
        other = self.strings[leaf[0]]
        if s == other:
            leaf.append(index)
            return
        part = common_prefix(s, other, self.depth)
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < part:
            above = node, self._byte(s, node[0])
            node = node[1][above[1]]
        if isinstance(node, tuple) and node[0] == part:
            node[1][self._byte(s, part)] = [index]
            return
        new = (part, {self._byte(other, part): node, self._byte(s, part): [index]})
        if above is None:
            self.root = new
        else:
            above[0][1][above[1]] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            elif node:
                out += node
        return out


def common_prefix(s: bytes, t: bytes, known: int = 0) -> int:
    end, step = min(len(s), len(t)), 32
    while known < end and s[known : known + step] == t[known : known + step]:
        known += step
    if known >= end:
        return end
    while known < end and s[known] == t[known]:
        known += 1
    return known


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW, key: int = 8) -> list[int]:
    """Indices in byte order: multikey quicksort on ``key`` bytes at a time, blind tries from ``shallow`` on."""
    out, stack = [], [(list(range(len(strings))), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) <= 1:
            out += rows
            continue
        if depth >= shallow:
            trie = BlindTrie(strings, depth)
            for i in rows:
                trie.insert(i)
            out += trie.order()
            continue
        keys = [strings[i][depth : depth + key] for i in rows]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less, same, more = [], [], []
        for i, k in zip(rows, keys, strict=True):
            (same if k == pivot else less if k < pivot else more).append(i)
        stack.append((more, depth))
        stack.append((same, depth + key if len(pivot) == key else max(shallow, depth + key)))
        stack.append((less, depth))
    return out


def neighbours(strings: list[bytes], order: list[int]) -> np.ndarray:
    """Common prefix of each string in order with the one before it; 0 for the first."""
    width = max(map(len, strings), default=0)
    size = np.array([len(strings[i]) for i in order])
    table = np.frombuffer(b"".join(strings[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(order), width)
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 4096):
        hi = min(lo + 4096, len(order))
        differ = table[lo:hi] != table[lo - 1 : hi - 1]
        first = np.where(differ.any(1), differ.argmax(1), width)
        out[lo:hi] = np.minimum(first, np.minimum(size[lo:hi], size[lo - 1 : hi - 1]))
    return out


def shared_windows(bodies: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For distinct units, which of their windows (column d) another of the units has too."""
    n = len(bodies)
    right = [b[h:] for b, h in zip(bodies, hi, strict=True)]
    left = [b[:h][::-1] for b, h in zip(bodies, hi, strict=True)]
    place, prefix = [], []
    for strings in (right, left):
        order = deep_shallow_sort(strings)
        place.append(np.array(order))
        prefix.append(neighbours(strings, order))
    out = np.zeros((n, int(hi.max(initial=0)) + 1), bool)
    same_right, same_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(lo.min(initial=0)), out.shape[1]):
        own = np.flatnonzero((lo <= d) & (hi >= d))
        if len(own) < 2:
            continue
        same_right[place[0]] = np.cumsum(prefix[0] < length - d)
        same_left[place[1]] = np.cumsum(prefix[1] < d) if d else 0
        key = same_right[own] * (n + 1) + same_left[own]
        order = np.argsort(key, kind="stable")
        equal = key[order][1:] == key[order][:-1]
        twice = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
        out[own[order[twice]], d] = True
    return out


SPAN = "doc long, key long, start long, end long"


def _span_batch(doc, key, at, d1, d2, length: int) -> pa.RecordBatch:
    at, d1, d2 = (np.asarray(x, np.int64) for x in (at, d1, d2))
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(at - d2),
                                       pa.array(at + length - d1)], names=["doc", "key", "start", "end"])


def _edges(length: int, block: int):
    """Spans of the repeated windows of units that occur once. Input sorted by gram:
    gram, doc, key, at, lo, hi, times, body."""

    def solve(cols: list[list]) -> pa.RecordBatch:
        gram, doc, key, at, lo, hi, times, body = cols
        hit = shared_windows(body, np.array(lo, np.int64), np.array(hi, np.int64), length)
        hit[np.array(times) > 1] = False  # wholly repeated: found without this
        edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (i, d1), (_, d2) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return _span_batch([doc[k] for k in i], [key[k] for k in i], [at[k] for k in i], d1, d2 - 1, length)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(8)]
        for batch in batches:
            for h, c in zip(held, (batch.column(i).to_pylist() for i in range(8)), strict=True):
                h += c
            if len(held[0]) >= block:  # all but the last gram, which may go on
                cut = held[0].index(held[0][-1])
                if cut:
                    yield solve([h[:cut] for h in held])
                    held = [h[cut:] for h in held]
        if held[0]:
            yield solve(held)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Spans (``SPAN``) of repeated bytes; they may overlap. ``docs`` has doc, key, text."""
    spark = docs.sparkSession
    small_batches(spark)
    units = stored(docs.select("doc", "key", "text").mapInArrow(_units(length, gram), UNIT), "units")
    grams = units.groupBy(F.col("gram").alias("_g")).agg(F.count("*").alias("_n")).where("_n > 1").select("_g")
    likely = stored(units.join(grams, units["gram"] == grams["_g"]).drop("_g"), "likely-units")
    one = [F.first(c).alias(c) for c in ("doc", "key", "at", "lo", "hi")]
    distinct = stored(likely.groupBy("gram", "unit").agg(F.count("*").alias("times"), *one), "distinct-units")

    whole = distinct.where("times > 1").select(F.col("gram").alias("_g"), F.col("unit").alias("_u"))
    again = likely.join(whole, (F.col("gram") == F.col("_g")) & (F.col("unit") == F.col("_u")))
    spans = again.select("doc", "key", (F.col("at") - F.col("hi")).alias("start"),
                         (F.col("at") + length - F.col("lo")).alias("end"))

    sizes = distinct.groupBy(F.col("gram").alias("_g")).agg(
        F.count("*").alias("_units"), F.min("times").alias("_least")).where("_units > 1 AND _least = 1")
    edges = distinct.join(sizes, distinct["gram"] == sizes["_g"]).select(
        "doc", "key", "gram", "times", "at", "lo", "hi", (F.col("_units") > group).alias("hot"))
    wanted = edges.groupBy(F.col("doc").alias("_doc"), F.col("key").alias("_key")).agg(
        F.collect_list(F.struct("gram", "times", "at", "lo", "hi", "hot")).alias("units"))  # of one document
    on = (docs["key"] == wanted["_key"]) & docs["doc"].eqNullSafe(wanted["_doc"])
    # Rows with equal id and text share a key, and one of them speaks for all.
    texts = docs.join(wanted, on).dropDuplicates(["key", "doc"]).select("doc", "key", "text", "units")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(),) * 4 + (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
        names = ["gram", "doc", "key", "at", "lo", "hi", "times", "body", "window"]
        for batch in batches:
            for doc, key, text, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data, rows = text.encode(), []
                for u in found:
                    g, at, lo, hi, n = u["gram"], u["at"], u["lo"], u["hi"], u["times"]
                    if not u["hot"]:
                        rows.append((g, doc, key, at, lo, hi, n, data[at - hi : at + length - lo], None))
                    else:
                        for d in range(lo, hi + 1):
                            window = hashlib.blake2b(data[at - d : at - d + length], digest_size=8).digest()
                            rows.append((g, doc, key, at, d, d, n, None, int.from_bytes(window, "little", signed=True)))
                for k in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*rows[k : k + 1000], strict=True), kinds, strict=True)], names=names)

    kind = "gram long, doc long, key long, at long, lo int, hi int, times long, body binary, window long"
    bodies = stored(texts.mapInArrow(cut, kind), "edge-units")
    dealt = bodies.where("body IS NOT NULL").drop("window").repartition(parallel(docs), "gram").sortWithinPartitions("gram")
    edge_spans = dealt.mapInArrow(_edges(length, min(SORTED, group)), SPAN)

    windows = bodies.where("body IS NULL")
    twice = windows.groupBy(F.col("gram").alias("_g"), F.col("lo").alias("_d"), F.col("window").alias("_w")).agg(
        F.count("*").alias("_n")).where("_n > 1")
    hot = windows.join(twice, (F.col("gram") == F.col("_g")) & (F.col("lo") == F.col("_d"))
                       & (F.col("window") == F.col("_w"))).select(
        "doc", "key", (F.col("at") - F.col("lo")).alias("start"), (F.col("at") - F.col("lo") + length).alias("end"))
    return spans.unionByName(edge_spans).unionByName(hot)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` and ``removed``, the removed runs of bytes."""
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc", "text"))
    spans = repeated_spans(docs, length, gram, group)
    by_doc = stored(spans.groupBy(F.col("doc").alias("_doc"), F.col("key").alias("_key")).agg(
        F.collect_list(F.struct("start", "end")).alias("spans")), "spans")  # of one document
    small_batches(df.sparkSession)
    joined = docs.join(by_doc, (F.col("key") == F.col("_key")) & F.col("doc").eqNullSafe(F.col("_doc")), "left")

    def strip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
        run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), run)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data, runs = text.encode(), []
                for s in sorted((s["start"], s["end"]) for s in spans or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                kept, at = hashlib.sha256(), 0
                for s, e in runs:
                    kept.update(data[at:s])
                    at = e
                kept.update(data[at:])
                for col, v in zip(out, (doc, len(data), sum(e - s for s, e in runs), len(runs), kept.hexdigest(),
                                        [{"start": s, "end": e} for s, e in runs]), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    out = joined.select("doc", "text", "spans").mapInArrow(
        strip, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string,"
               " removed array<struct<start: long, end: long>>")
    return out.withColumnRenamed("doc", id_col)
