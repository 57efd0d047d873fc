"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

A text's words are its runs of letters and digits and its runs of other visible signs. Features are
the distinct single words, pairs of neighbours, and triples of word shapes (case, digits, length,
"same as the word before"; a run of signs is its own shape), hashed to ``2^BITS`` weights and scaled
to unit length. Labels are learnt from at most ``max_rows`` labelled rows, those with the smallest
hash of the id: a documented bound, as a linear model of this size gains nothing from more. The rows
are dealt to ``SHARDS`` tasks; each runs the sequential updates over its rows, and after each pass
the per-coordinate sums of all shards are averaged. A score needs no shuffle.

Defined results: null and empty texts have no feature and score the bias. With no usable label, or
labels of one class only, the score is that class's share (0.5 without labels). An id labelled twice
counts once with its largest label; labels other than 0 and 1 and null labels are not used. Repeated
rows score alike. Other columns are ignored by ``quality_scores`` and carried by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow.llm.common import _LOWER, blocks, mix, prefix_hash, small_batches, span_hash, stored, text_buffers

BITS = 18
MAX_ROWS = 12_000
SHARDS, PASSES = 4, 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-2

#: Byte classes: white space, word, other sign.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[[0x20, *range(0x09, 0x0E), 0]] = 0


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - BITS)).astype(np.uint64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices of a block of texts, distinct and sorted within each, and each text's first."""
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    edge[0] = edge[-1] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    seen = kind[starts] > 0 if len(data) else np.zeros(0, bool)
    starts, ends = starts[seen], ends[seen]
    row = np.searchsorted(offsets, starts, "right").astype(np.uint64) - np.uint64(1)
    word = span_hash(prefix_hash(_LOWER[data]), starts, ends)

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return total[ends] - total[starts]

    upper = count((data >= 65) & (data <= 90))
    lower = count((data >= 97) & (data <= 122))
    digit = count((data >= 48) & (data <= 57))
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    length = np.minimum(np.log2(ends - starts + 1).astype(np.uint64), np.uint64(7))
    shape = (length | (upper > 0).astype(np.uint64) << np.uint64(3) | (lower > 0).astype(np.uint64) << np.uint64(4)
             | (upper > 1).astype(np.uint64) << np.uint64(5) | (digit > 0).astype(np.uint64) << np.uint64(6)
             | same.astype(np.uint64) << np.uint64(7))
    shape = np.where(kind[starts] == 2, word, shape) if len(word) else shape
    found = [row << np.uint64(BITS) | _bucket(word, 1)]
    if len(word) > 1:
        pair = row[1:] == row[:-1]
        found.append((row[1:] << np.uint64(BITS) | _bucket(word[1:] * np.uint64(3) + word[:-1], 2))[pair])
    if len(word) > 2:
        triple = row[2:] == row[:-2]
        mixed = mix(mix(shape[:-2]) + shape[1:-1] * np.uint64(0x9E3779B1)) + shape[2:] * np.uint64(5)
        found.append((row[2:] << np.uint64(BITS) | _bucket(mixed, 3))[triple])
    keys = np.unique(np.concatenate(found))
    first = np.searchsorted(keys >> np.uint64(BITS), np.arange(len(offsets), dtype=np.uint64))
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int32), first


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss; coordinate ``2^BITS`` is the bias."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        size = (1 << BITS) + 1
        self.z = np.zeros(size, np.float32) if z is None else z.copy()
        self.n = np.zeros(size, np.float32) if n is None else n.copy()

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0, w)

    def learn(self, index: np.ndarray, label: int) -> None:
        at = np.append(index, 1 << BITS)
        x = np.full(len(at), 1 / np.sqrt(max(len(index), 1)), np.float32)
        x[-1] = 1
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


class Model:
    """Weights ready to score; ``constant`` is set when there was nothing to learn."""

    def __init__(self, weights: np.ndarray | None, constant: float = 0.5):
        self.weights, self.constant = weights, constant

    def score(self, texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        data, offsets = text_buffers(texts)
        out = np.zeros(len(offsets) - 1)
        for i, j in blocks(offsets):
            index, first = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            total = np.concatenate([[0.0], np.cumsum(self.weights[index], dtype=np.float64)])
            sums = total[first[1:]] - total[first[:-1]]
            out[i:j] = sums / np.sqrt(np.maximum(np.diff(first), 1)) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def training_rows(df: DataFrame, labels: DataFrame, usable: Column, max_rows: int, id_col: str,
                  text_col: str, label_col: str) -> DataFrame:
    """``shard, label, features`` of at most ``max_rows`` labelled ids, drawn from those that can train."""
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    present = df.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_present"))
    own = own.join(present, F.col("_id") == F.col("_present"), "left_semi")
    picked = own.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)  # at most max_rows, so it may be broadcast
    rows = df.where(usable).select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("_text"))
    rows = rows.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select(
        F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(SHARDS)).cast("int"), "_label", "_text", F.xxhash64("_id", F.lit(2)))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            out = []
            for i, j in blocks(offsets):
                index, first = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out += [index[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()),
                                              batch.column(3)], names=["shard", "label", "features", "turn"])

    return rows.mapInArrow(extract, "shard int, label int, features binary, turn long")


def _one_pass(state: Broadcast):
    def learn(shard: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl(*state.value)
        for _, r in shard.sort_values(["turn", "label"]).iterrows():
            model.learn(np.frombuffer(r["features"], np.int32), int(r["label"]))
        return pd.DataFrame({"z": [model.z.tobytes()], "n": [model.n.tobytes()], "rows": [len(shard)]})

    return learn


def train(df: DataFrame, labels: DataFrame, usable: Column, max_rows: int = MAX_ROWS, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn ``label_col`` of ``labels`` for the rows of ``df`` that ``usable`` picks."""
    spark = df.sparkSession
    small_batches(spark)
    rows = stored(training_rows(df, labels, usable, max_rows, id_col, text_col, label_col), "quality-rows")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model(None, float(next(iter(counts), 0.5)))
    z = n = None
    for _ in range(PASSES):
        state = spark.sparkContext.broadcast((z, n))

        got = rows.groupBy("shard").applyInPandas(_one_pass(state), "z binary, n binary, rows long").collect()
        got.sort(key=lambda r: (r["rows"], r["z"]))
        share = np.array([r["rows"] for r in got], np.float32) / sum(r["rows"] for r in got)
        z, n = (sum(s * np.frombuffer(r[c], np.float32) for s, r in zip(share, got, strict=True)) for c in "zn")
        state.unpersist()
    return Model(Ftrl(z, n).weights().astype(np.float32))


def score_column(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts), pa.float64())

    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "double")(F.col(text_col))


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted``; rows whose remainder modulo 3 is 1 are never learnt from."""
    held = remainder(id_col, 3) == 1
    model = train(df, labels, ~held, id_col=id_col, text_col=text_col)
    small_batches(df.sparkSession)
    out = df.select(F.col(id_col), held.alias("held_out"), score_column(df, model, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that score at least 0.5, with all their columns."""
    model = train(df, labels, remainder(id_col, 3) != 1, id_col=id_col, text_col=text_col)
    small_batches(df.sparkSession)
    rows = df.select(F.struct(*df.columns).alias("_row"), score_column(df, model, text_col).alias("_score"))
    return rows.where("_score >= 0.5").select(*(F.col("_row")[c].alias(c) for c in df.columns))
