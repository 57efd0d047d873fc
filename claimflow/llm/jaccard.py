"""Near copies by an exact Jaccard join over word shingles, with grouped prefixes.

A document is the set of its distinct five-word shingles (64-bit hashes of the words lower-cased
A-Z). Two documents link when their sets overlap in at least 80 % of their union.

1. Documents with equal sets are one from the start, so copies cost one row a task.
2. Shingles have one global order, by how often their hash bucket was seen in the corpus, rarest
   first. Linked sets share a shingle among their first ``n - ceil(0.8 n) + 1``.
3. Sets of equal size and prefix are one group. Groups meet at the shingles of their prefixes, and a
   pair of groups must pass the size and the position filter.
4. Pairs of groups are expanded to members. Counts of a set's shingles in ``BUCKETS`` buckets bound the
   overlap from above and rule most pairs out, in the last round where they meet; the rest is verified on
   the whole sets, taken from the text again.
5. Groups are attached in steps, as one link is enough to join a component. A step looks at one shingle
   of each group, the rarest that at least so many groups share, so that small and large classes each
   have a step of their size. Only groups outside the largest component at that shingle look for
   partners in it (among single groups, the first one is it). What a step attaches takes no part in the
   next one, so the pairs of a large group of near copies stay near its size. Last, every pair that
   passes the filters and lies in different components meets. A pair that was not compared lies in one
   component already, so no link between components is lost.
6. No task holds more than about ``HELD`` postings of one shingle. In the steps a more frequent shingle is
   dealt into sections that look for partners on their own; in the last round each pair of its sections
   meets in a task of its own.

Defined results: a text of fewer than five words has its whole sequence as its one shingle; without
words, and for null, the set is empty and links with nothing. Rows that share an id are one document
with the links of all of them. A null id links with nothing and has a null component. An empty table
gives an empty result; other columns are ignored by ``classes`` and carried by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimflow.llm.common import blocks, mix, parallel, small_batches, stored, text_buffers, word_hashes
from claimflow.llm.components import components

WORDS = 5
#: Buckets of the shingle counts, a table of fixed size. With few buckets all get about equal counts, and
#: frequent shingles are no longer told from rare ones. That costs time, not links.
COUNT_BITS = 22
SLICES = 64
#: Partners of one document that a task verifies; more are dealt to several.
PARTNERS = 500
#: For each step: how many groups share the shingle at least, and how many partners a group meets there.
#: More steps cost passes over the texts, fewer leave more pairs to the last round.
STEPS = ((2, 1), (8, 2), (32, 4), (128, 8))
#: Shingles of each step at which a group can be found by others.
FOUND_AT = 3
#: Postings of one shingle that a task holds; a more frequent shingle is dealt to several.
HELD = 20_000
#: Buckets of a set's histogram, which bounds an overlap before whole sets travel.
BUCKETS = 128
#: Bits of the filter that keeps texts no pair needs out of a shuffle, a table of fixed size.
SIEVE_BITS = 26
_STEP = [pow(0x9E3779B97F4A7C15 | 1, k + 1, 1 << 64) for k in range(WORDS)]


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of a set of size n with a set it links to: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def shingle_sets(texts: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = text_buffers(texts)
    for i, j in blocks(offsets):
        words, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        joined = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
        for k in range(WORDS):
            joined += words[k : len(words) - WORDS + 1 + k] * np.uint64(_STEP[k])
        joined = mix(joined)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= WORDS:
                yield np.unique(joined[a : b - WORDS + 1])
            elif b > a:
                short = sum(int(w) * s for w, s in zip(words[a:b], _STEP, strict=False)) + int(b - a)
                yield mix(np.array([short & 0xFFFFFFFFFFFFFFFF], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen, held = np.zeros(1 << COUNT_BITS, np.int64), [], 0
    for batch in batches:
        for s in shingle_sets(batch.column(0)):
            seen.append(_slot(s))
            held += len(s)
            if held > 1 << 20:
                total += np.bincount(np.concatenate(seen), minlength=len(total))
                seen, held = [], 0
    if held:
        total += np.bincount(np.concatenate(seen), minlength=len(total))
    for k, part in enumerate(np.split(total, SLICES)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_narrow(part)], pa.binary())],
                                         names=["slice", "counts"])


def _narrow(part: np.ndarray) -> bytes:
    """Counts of a slice in as few bytes each as its largest one needs."""
    return part.astype(np.min_scalar_type(int(part.max()))).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) * SLICES >> COUNT_BITS}").astype(np.int64)


def _add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[k] = total.get(k, 0) + _wide(c)
    for k, c in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_narrow(c)], pa.binary())],
                                         names=["slice", "counts"])


def shingle_counts(rows: DataFrame) -> np.ndarray:
    """How often each of ``2^COUNT_BITS`` hash buckets was seen, over all documents: at most 32 MB."""
    kind = "slice int, counts binary"
    parts = rows.select("_text").mapInArrow(_count, kind)
    got = parts.repartition(SLICES, "slice").mapInArrow(_add, kind).collect()
    total = np.zeros((SLICES, (1 << COUNT_BITS) // SLICES), np.int64)
    for r in got:
        total[r["slice"]] += _wide(r["counts"])
    return total.ravel().astype(np.min_scalar_type(int(total.max())))


def histogram(shingles: np.ndarray) -> bytes | None:
    """How many shingles fall in each bucket; None if a count needs more than a byte."""
    counts = np.bincount((shingles & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def signatures(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """``_id, n, set_key, group_key, prefix, hist`` of each row (columns _id, _text)."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sets, groups, prefixes, hists = [], [], [], [], []
            for s in shingle_sets(batch.column(1)):
                size = len(s)
                take = size - needed(size) + 1 if size else 0
                rank = shared.value[_slot(s)]
                prefix = s[np.lexsort((s, rank))[:take]].tobytes()
                n.append(size)
                sets.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                groups.append(hashlib.blake2b(prefix + size.to_bytes(8, "little"), digest_size=16).digest())
                prefixes.append(prefix)
                hists.append(histogram(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()),
                 *(pa.array(x, pa.binary()) for x in (sets, groups, prefixes, hists))],
                names=["_id", "n", "set_key", "group_key", "prefix", "hist"])

    return rows.select("_id", "_text").mapInArrow(
        sign, "_id long, n long, set_key binary, group_key binary, prefix binary, hist binary")


POSTING_COLUMNS = ("token", "group", "n", "at")
POSTING = "token long, group long, n long, at int"


def _postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prefixes = [np.frombuffer(p, np.int64) for p in batch.column(2).to_pylist()]
        size = np.array([len(p) for p in prefixes])
        tokens = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
        at = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
        yield pa.RecordBatch.from_arrays([
            pa.array(tokens), pa.array(np.repeat(batch.column(0).to_numpy(), size)),
            pa.array(np.repeat(batch.column(1).to_numpy(), size)), pa.array(at.astype(np.int32))],
            names=["token", "group", "n", "at"])


def passes(n1: np.ndarray, at1: np.ndarray, n2: np.ndarray, at2: np.ndarray) -> np.ndarray:
    """Size filter, and the position filter at a pair's first common shingle."""
    size = 5 * np.minimum(n1, n2) >= 4 * np.maximum(n1, n2)
    return size & (9 * np.minimum(n1 - at1, n2 - at2) >= 4 * (n1 + n2))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole batches, cut so that no token is torn."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
        if cut:
            yield [c[:cut] for c in cols]
        held = [c[cut:] for c in cols]
    if held is not None and len(held[0]):
        yield held


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    if len(a):
        a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["a", "b"])


def _outside_pairs(partners: int):
    """Groups outside a shingle's largest component, whose turn it is there, with ``partners`` inside it.

    Columns: shingle or section of one, group, n, at, component, mixed, turn.
    """

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, g, size, place, comp, _, turn in _runs(batches):
            edges = np.concatenate([np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])), [len(t)]])
            a, b = [], []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo < 2 or (comp[lo:hi] == comp[lo]).all():
                    continue
                labels, n = np.unique(comp[lo:hi], return_counts=True)
                inside = comp[lo:hi] == labels[n.argmax()]
                major = lo + np.flatnonzero(inside)
                for x in lo + np.flatnonzero(~inside & turn[lo:hi]):
                    y = major[passes(size[major], place[major], size[x], place[x])]
                    if len(y) > partners:  # others at each shingle
                        at = int(mix(np.array([g[x]]).view(np.uint64) + t[x : x + 1].view(np.uint64))[0] % np.uint64(len(y)))
                        y = y[(at + np.arange(partners) * (len(y) // partners)) % len(y)]
                    a.append(g[y])
                    b.append(np.full(len(y), g[x]))
            if a:
                yield _pair_batch(np.concatenate(a), np.concatenate(b))

    return pairs


def _apart(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings at shingles whose groups do not lie in one component; columns as for the cross pairs but ``hist``."""
    names = [*POSTING_COLUMNS, "component", "mixed", "section"]
    for cols in _runs(batches):
        t, comp, mixed = cols[0], cols[4], cols[5]
        first = np.concatenate([[True], t[1:] != t[:-1]])
        run, starts = np.cumsum(first) - 1, np.flatnonzero(first)
        several = np.maximum.reduceat(comp, starts) != np.minimum.reduceat(comp, starts)
        keep = (several | np.logical_or.reduceat(mixed.astype(bool), starts))[run]
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=names)


def _cross_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of groups at a shingle that pass the filters, do not lie in one component, and whose
    histograms allow enough overlap (a group of several sets has none and passes).

    Columns: shingle or pair of its sections, group, n, at, component, mixed (the group's own members lie
    in several), section, hist. Where two sections meet, pairs within one are left to that section's own task.
    """
    for t, g, size, place, comp, mixed, section, hist in _runs(batches):
        edges = np.concatenate([np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])), [len(t)]])
        a, b = [], []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < 2 or (not mixed[lo:hi].any() and (comp[lo:hi] == comp[lo]).all()):
                continue
            order = lo + np.lexsort((comp[lo:hi], mixed[lo:hi]))  # equal components side by side
            c, m = comp[order], mixed[order]
            apart = (section[lo:hi] != section[lo]).any()
            known = np.array([h is not None for h in hist[lo:hi]])
            counts = np.frombuffer(b"".join(h or bytes(BUCKETS) for h in hist[lo:hi]), np.uint8).reshape(-1, BUCKETS)
            for i in range(len(order) - 1):  # against what follows the own component
                j = i + 1 if m[i] else max(i + 1, int(np.searchsorted(c[: len(c) - int(m.sum())], c[i], "right")))
                x, y = order[i], order[j:]
                ok = passes(size[y], place[y], size[x], place[x]) & (g[y] != g[x])
                if apart:
                    ok &= section[y] != section[x]
                y = y[ok]
                if known[x - lo] and len(y):
                    both = np.minimum(counts[y - lo], counts[x - lo]).sum(1, dtype=np.int64)
                    y = y[~known[y - lo] | (9 * both >= 4 * (size[y] + size[x]))]
                a.append(g[y])
                b.append(np.full(len(y), g[x]))
            if sum(map(len, a)) > 500_000:
                yield _pair_batch(np.concatenate(a), np.concatenate(b))
                a, b = [], []
        if a:
            yield _pair_batch(np.concatenate(a), np.concatenate(b))


def _sieve_places(ids: np.ndarray) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return [(h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64),
            (h & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)]


def sieve(ids: DataFrame) -> np.ndarray:
    """Bloom filter of the ids in the first column, packed: ``2^SIEVE_BITS`` bits, always."""
    kind = "slice int, few boolean, bits binary"
    names, width = ["slice", "few", "bits"], (1 << SIEVE_BITS) // SLICES

    def batch_of(k: int, few: bool, data: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([few]), pa.array([data.tobytes()], pa.binary())],
                                          names=names)

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((SLICES, width), bool)
        for batch in batches:
            for place in _sieve_places(batch.column(0).to_numpy()):
                bits.ravel()[place] = True
        for k in np.flatnonzero(bits.any(1)).tolist():
            set_ = np.flatnonzero(bits[k]).astype(np.uint32)
            few = len(set_) < width // 32  # places take less room than bits
            yield batch_of(k, few, set_ if few else np.packbits(bits[k]))

    def unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, few, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                bits = total.setdefault(k, np.zeros(width // 8, np.uint8))
                if few:
                    set_ = np.frombuffer(data, np.uint32)
                    np.bitwise_or.at(bits, set_ >> 3, (128 >> (set_ & 7)).astype(np.uint8))
                else:
                    bits |= np.frombuffer(data, np.uint8)
        for k, bits in total.items():
            yield batch_of(k, False, bits)

    parts = ids.mapInArrow(mark, kind).repartition(SLICES, "slice").mapInArrow(unite, kind).collect()
    out = np.zeros((SLICES, (1 << SIEVE_BITS) // 8 // SLICES), np.uint8)
    for r in parts:
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def sifted(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows whose id the filter may hold: a scan, no shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def held(ids: pa.Array) -> pa.Array:
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        found = np.ones(len(known), bool)
        for place in _sieve_places(known):
            found &= (shared.value[place >> 3] >> (7 - (place & 7))) & 1 == 1
        return pa.array(found, pa.bool_())

    held.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    return rows.where(F.arrow_udf(held, "boolean")(F.col("_id")))


def possible(pairs: DataFrame, hists: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose histograms (``rep, hist``) allow enough overlap, or are missing."""

    def allowed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = pc.is_valid(batch.column(2)).to_numpy(False) & pc.is_valid(batch.column(3)).to_numpy(False)
            x, y = (np.frombuffer(b"".join(batch.column(c).filter(pa.array(known)).to_pylist()), np.uint8)
                    .reshape(-1, BUCKETS).astype(np.int64) for c in (2, 3))
            keep = ~known
            keep[known] = 9 * np.minimum(x, y).sum(1) >= 4 * (x.sum(1) + y.sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    near = sifted(hists.select(F.col("rep").alias("_id"), "hist"), sieve(pairs.select(F.explode(F.array("a", "b")))))
    near = stored(near, "near-histograms")
    one, two = (near.select(F.col("_id").alias(f"_{c}"), F.col("hist").alias(f"_h{c}")) for c in "ab")
    both = pairs.join(one, F.col("a") == F.col("_a"), "left").join(two, F.col("b") == F.col("_b"), "left")
    return both.select("a", "b", "_ha", "_hb").mapInArrow(allowed, "a long, b long")


def verified(rows: DataFrame, pairs: DataFrame, hists: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets link, as links ``u, v``.

    Pairs whose histograms rule a link out go first. Then a set travels to each document it is paired
    with as ``b``; a document with many partners has them dealt over several tasks, its own set going
    to each.
    """
    small_batches(rows.sparkSession)
    met = stored(pairs.select("a", "b").where("a <> b").distinct(), "pairs")
    if not met.isEmpty():
        met = stored(possible(met, hists), "possible-pairs")
    if met.isEmpty():
        return met.select(F.col("a").alias("u"), F.col("b").alias("v"))
    pairs = met
    parts = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("_parts"))
    dealt = pairs.join(parts.where("_parts > 1"), F.col("a") == F.col("_a"), "left")
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("_parts")), F.lit(0)).cast("int").alias("part")
    to = dealt.select(F.col("b").alias("_to"), F.struct("a", part, F.lit(True).alias("partner")).alias("_at"))
    own = parts.select("_a", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part")).select(
        F.col("_a").alias("_to"), F.struct(F.col("_a").alias("a"), "part", F.lit(False).alias("partner")).alias("_at"))
    ways = to.unionByName(own).groupBy("_to").agg(F.collect_list("_at").alias("_ways")).hint("merge")
    met = sieve(pairs.select(F.explode(F.array("a", "b"))))
    texts = sifted(rows, met).join(ways, F.col("_id") == F.col("_to")).select("_id", "_text", "_ways")

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "part", "partner", "id", "shingles"]
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for one, ways, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(),
                                    shingle_sets(batch.column(1)), strict=True):
                data = s.tobytes()
                for w in ways:
                    for col, v in zip(out, (w["a"], w["part"], w["partner"], one, data), strict=True):
                        col.append(v)
                    if len(out[0]) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                        out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
    sent = texts.mapInArrow(send, "a long, part int, partner boolean, id long, shingles binary")
    met = sent.repartition(parallel(rows), "a", "part").sortWithinPartitions("a", "part", "partner")

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, []
        for batch in batches:
            u, v = [], []
            for r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (r[0], r[1]) != at:
                    at, sets = (r[0], r[1]), []
                s = np.frombuffer(r[4], np.uint64)
                if not r[2]:
                    sets.append(s)
                    continue
                for own in sets:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= 80 * (len(own) + len(s) - both):
                        u.append(r[0])
                        v.append(r[3])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return stored(met.mapInArrow(judge, "u long, v long"), "links")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``. Links within a found class are not all
    looked for, as they cannot change it, so no number of links is given."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    signed = stored(signatures(rows, shingle_counts(rows)), "signatures")
    full = signed.where("n > 0 AND _id IS NOT NULL")
    # Copies: one representative a set, and links between sets that share an id.
    reps = stored(full.groupBy("set_key").agg(F.min("_id").alias("rep"), F.min("group_key").alias("group_key"),
                                              F.min("n").alias("n"), F.min("hist").alias("hist")), "sets")
    # An id that stands for several sets has no histogram.
    hists = stored(reps.groupBy("rep").agg(F.when(F.count("*") == 1, F.min("hist")).alias("hist")), "histograms")
    same_id = full.select("_id", "set_key").join(reps, "set_key").select(
        F.col("_id").alias("u"), F.col("rep").alias("v")).where("u <> v")
    groups = reps.groupBy("group_key").agg(F.min("rep").alias("group"), F.count("*").alias("members"))
    members = stored(reps.join(groups, "group_key").select("rep", "group", "members", "set_key", "group_key"), "members")
    chosen = members.where("rep = group").select(F.col("group").alias("_g"), F.col("set_key").alias("_s"))
    prefixes = full.join(chosen, (F.col("_id") == F.col("_g")) & (F.col("set_key") == F.col("_s")))
    postings = prefixes.select("_g", "n", "prefix").mapInArrow(_postings, POSTING)
    # Prefix shingles that one group alone has meet nothing.
    shared = stored(postings.repartition(parallel(df), "token").sortWithinPartitions("token").mapInArrow(
        _several, f"{POSTING}, posts long"), "shared")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    # The place of each posting among its group's shingles that are shared widely enough for a step.
    rarer = Window.partitionBy("group").orderBy("at", "token").rowsBetween(Window.unboundedPreceding, 0)
    wide = [F.col("posts") >= least for least, _ in STEPS]
    few = shared.select("*", *(F.when(w, F.sum(w.cast("int")).over(rarer)).alias(f"turn{k}") for k, w in enumerate(wide)))
    few = stored(few.where(F.least(*(f"turn{k}" for k in range(len(STEPS)))) <= FOUND_AT), "rarest")
    inside = members.where("members > 1 AND rep <> group").select(F.col("group").alias("a"), F.col("rep").alias("b"))
    # Copies of a set under ids of their own are found again through the set; only ids shared by sets link here.
    twice = full.groupBy("_id").agg(F.countDistinct("set_key").alias("k")).where("k > 1").select(F.col("_id").alias("_d"))
    shared_ids = same_id.join(twice, F.col("u") == F.col("_d"), "left_semi")

    def placed_by(links: DataFrame) -> DataFrame:
        """Members with their group and component."""
        found = components(links)
        return stored(members.select("rep", "group").join(found, F.col("rep") == F.col("node"), "left").select(
            "rep", "group", F.coalesce("component", "rep").alias("component")), "placed")

    def open_by(postings: DataFrame, at: DataFrame) -> DataFrame:
        """The postings with their group's component."""
        state = at.groupBy(F.col("group").alias("_g")).agg(
            F.min("component").alias("component"), (F.min("component") != F.max("component")).alias("mixed"))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
        return postings.join(state, F.col("group") == F.col("_g")).select(*POSTING_COLUMNS, "component", "mixed", *(
            c for c in postings.columns if c not in POSTING_COLUMNS))

    def by_token(postings: DataFrame) -> DataFrame:
        return postings.repartition(parallel(df), "token").sortWithinPartitions("token")

    parts = F.ceil(F.col("posts") / HELD)
    placed, links = members.select("rep", "group", F.col("rep").alias("component")), shared_ids
    for step, (_, partners) in enumerate(STEPS):
        section = F.xxhash64("token", F.pmod(F.xxhash64("group", F.lit(step)), parts))  # others at each step
        open_ = open_by(few, placed).withColumn("token", F.when(parts > 1, section).otherwise(F.col("token")))
        turn = F.coalesce(F.col(f"turn{step}") == 1, F.lit(False)).alias("turn")
        pairs = by_token(open_.select(*POSTING_COLUMNS, "component", "mixed", turn)).mapInArrow(
            _outside_pairs(partners), "a long, b long")
        found = verified(rows, pairs.unionByName(inside) if step == 0 else pairs, hists)
        links = links.unionByName(found)
        placed = placed_by(links)
    open_ = open_by(shared, placed).withColumn("section", F.lit(0))
    if not shared.where(parts > 1).isEmpty():
        hot = open_.where(parts > 1)
        # A frequent shingle whose groups lie in one component has no pair left.
        several = hot.groupBy(F.col("token").alias("_t")).agg(
            F.min("component").alias("_low"), F.max("component").alias("_high"), F.max("mixed").alias("_mixed")).where(
            "_low <> _high OR _mixed").select("_t")
        split = hot.join(several, F.col("token") == F.col("_t")).withColumn(
            "section", F.pmod(F.xxhash64("group"), parts).cast("int"))
        split = split.select("*", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)).alias("_other")).withColumn(
            "token", F.xxhash64("token", F.least("section", "_other"), F.greatest("section", "_other")))
        open_ = open_.where(parts <= 1).unionByName(split.select(*open_.columns))
    kind = f"{POSTING}, component long, mixed boolean, section int"
    open_ = by_token(open_.drop("posts")).mapInArrow(_apart, kind)
    alone = members.where("members = 1").join(hists, "rep").select(F.col("group").alias("_g"), "hist")
    open_ = by_token(open_.join(alone, F.col("group") == F.col("_g"), "left").drop("_g"))
    state = placed.groupBy(F.col("group").alias("_g")).agg(
        (F.min("component") != F.max("component")).alias("mixed"))
    crossed = open_.mapInArrow(_cross_pairs, "a long, b long").distinct()
    left = placed.select(F.col("group").alias("a"), F.col("rep").alias("ra"), F.col("component").alias("ca"))
    right = placed.select(F.col("group").alias("b"), F.col("rep").alias("rb"), F.col("component").alias("cb"))
    rest = crossed.join(left, "a").join(right, "b").where("ca <> cb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    own = left.join(state.where("mixed"), F.col("a") == F.col("_g"), "left_semi")
    mixed = own.join(right, F.col("a") == F.col("b")).where("ca <> cb AND ra < rb").select(
        F.col("ra").alias("a"), F.col("rb").alias("b"))
    more = verified(rows, rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(mixed), hists)
    final = components(links.unionByName(more))
    label = stored(reps.select("set_key", "rep").join(final, F.col("rep") == F.col("node"), "left").select(
        F.col("set_key").alias("_k"), F.coalesce("component", "rep").alias("_c")), "labels")
    out = signed.select("_id", "n", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key")).join(
        label, F.col("set_key") == F.col("_k"), "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("_id").isNotNull(), F.coalesce("_c", "_id")).alias("component_id"))


def _several(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings whose token occurs at least twice, with how often; input sorted by token."""
    for cols in _runs(batches):
        t = cols[0]
        same = t[1:] == t[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        edges = np.concatenate([np.flatnonzero(np.concatenate([[True], ~same])), [len(t)]])
        posts = np.repeat(np.diff(edges), np.diff(edges))
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (*cols, posts)], names=[*POSTING_COLUMNS, "posts"])


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each class, with all columns. Rows without words or id stay."""
    found = classes(df, id_col, text_col)
    kept = stored(found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(
        F.col(id_col).alias("_keep")).distinct(), "kept")
    # The row travels as one column, so no name of its own can clash.
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(id_col).cast("long").alias("_id"))
    return rows.join(kept, F.col("_id").eqNullSafe(F.col("_keep")), "left_semi").select("_row.*")
