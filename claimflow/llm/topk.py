"""Exact top-k inner products through multi-resolution segment statistics.

A vector cut into segments of length L has in each a mean m and a deviation s, and for two vectors
``q . x <= sum over segments of L (m_q m_x + s_q s_x)`` (Cauchy-Schwarz on what is left of the means).
Few segments give a coarse and cheap bound, more a finer one. A block of candidates meets a block of
queries: the coarse bounds of all pairs are one matrix product, pairs that cannot reach the query's
k-th score drop out, the finer bounds judge the rest, and exact integer products decide among
survivors. Where most pairs of a chunk survive, one dense product is the cheaper way to the same
scores. Bounds are loosened by more than floating point can err, so results are exact.

Queries are dealt in blocks to every block of candidates; a task keeps a running k best for each
query block it meets and hands on k rows a query.

Defined results: vectors that are null, empty or hold null or non-finite components take no part. Only
vectors of the query's length are its candidates. Rows that share the query's id are its own and no
candidates. Repeated candidate rows all count; repeated query rows each get their answers. Null ids
take no part. Ties go to the smaller id. Products are 64-bit integers. Empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimflow.llm.common import parallel, stored

CANDIDATES = 16_384  # rows of a candidate block
QUERIES = 1024  # rows of a query block
CHUNK = 2048  # candidates judged at once
LEVELS = (4, 16)  # segments, coarse to fine
DENSE = 0.2  # share of survivors from which a dense product is cheaper

BLOCK = "dim int, n int, ids binary, vectors binary"


def usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def to_integers(vector: str, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, vector) as blocks of one dimension."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def emit(dim: int) -> pa.RecordBatch:
            ids, vecs = zip(*held.pop(dim), strict=True)
            ids = np.concatenate(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()),
                pa.array([ids.tobytes()], pa.binary()), pa.array([np.concatenate(vecs).tobytes()], pa.binary())],
                names=["dim", "n", "ids", "vectors"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            lengths = np.asarray(lists.value_lengths())
            flat, starts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths)])
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                for lo in range(0, len(at), size):
                    part = at[lo : lo + size]
                    if sum(len(x) for x, _ in held.get(int(dim), [])) + len(part) > size:
                        yield emit(int(dim))
                    vecs = flat[(starts[part][:, None] + np.arange(dim)).ravel()]
                    held.setdefault(int(dim), []).append((ids[part], vecs))
        for dim in list(held):
            yield emit(dim)

    return rows.mapInArrow(gather, BLOCK)


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row, the scaled means and deviations whose dot product bounds the inner product."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    lengths = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / lengths
    square = np.add.reduceat(x * x, cuts[:-1], axis=1) / lengths
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate([mean, deviation], axis=1) * np.sqrt(np.concatenate([lengths, lengths]))


class Best:
    """The k best candidates so far of each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.exact, self.k = ids, vectors, k
        self.real = vectors.astype(np.float64)
        self.features = [segment_features(self.real, s) for s in LEVELS]
        self.norm = np.sqrt((self.real**2).sum(1))
        self.scores = [np.zeros(0, np.int64) for _ in ids]
        self.found = [np.zeros(0, np.int64) for _ in ids]
        self.least = np.full(len(ids), -np.inf)  # a candidate below this is none of the k best
        self.judged = self.survived = 0

    def _offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.found[q], ids])
        if len(scores) > 4 * self.k:  # most of them are far below
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            near = scores >= cut
            scores, ids = scores[near], ids[near]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.found[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[q] = self.scores[q][-1]

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        real = vectors.astype(np.float64)
        norm = np.sqrt((real**2).sum(1))
        slack = 1e-9 * self.norm[:, None] * norm[None, :] + 1e-6
        self.judged += slack.size
        alive = np.broadcast_to(True, slack.shape)
        for level, segments in enumerate(LEVELS):
            if not np.isfinite(self.least).any():
                break
            other = segment_features(real, segments)
            if level and alive.mean() < DENSE:
                q, c = np.nonzero(alive)
                bound = np.einsum("ij,ij->i", self.features[level][q], other[c]) + slack[q, c]
                keep = bound >= self.least[q]
                alive = np.zeros(slack.shape, bool)
                alive[q[keep], c[keep]] = True
            else:
                alive = alive & (self.features[level] @ other.T + slack >= self.least[:, None])
        alive = alive & (self.ids[:, None] != ids[None, :])
        q, c = np.nonzero(alive)
        self.survived += len(q)
        small = len(q) and float(self.norm.max()) * float(norm.max()) < 2**52  # floats are exact then
        if small and len(q) > DENSE * alive.size:
            scores = (self.real @ real.T)[q, c].astype(np.int64)
        else:
            scores = np.empty(len(q), np.int64)
            for lo in range(0, len(q), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                scores[part] = np.einsum("ij,ij->i", self.exact[q[part]], vectors[c[part]])
        edges = np.searchsorted(q, np.arange(len(self.ids) + 1))
        for i in np.flatnonzero(np.diff(edges)):
            self._offer(i, scores[edges[i] : edges[i + 1]], ids[c[edges[i] : edges[i + 1]]])


def top_k(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all other rows for each row that ``queries`` picks."""
    spark = df.sparkSession
    rows = df.where(usable(vector_col) & F.col(id_col).isNotNull())
    ints = lambda x: x.select(F.col(id_col).cast("long").alias("id"), to_integers(vector_col, scale).alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(CHUNK * 2))
    mark = F.monotonically_increasing_id()
    candidates = stored(_in_blocks(ints(rows), CANDIDATES).withColumn("block", mark), "candidates")
    asked = stored(_in_blocks(ints(rows.where(queries)), QUERIES).withColumn("asked", mark), "queries")
    # Every block of queries meets every block of candidates of its dimension.
    pairs = candidates.select("block", "dim").join(asked.select("asked", "dim"), "dim").drop("dim")
    side = lambda x, p: x.select(*(F.col(c).alias(p + c) for c in ("n", "ids", "vectors")), x.columns[-1])
    met = pairs.join(side(candidates, "c_"), "block").join(side(asked, "q_"), "asked")
    dealt = met.repartition(parallel(df), "block").sortWithinPartitions("asked")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = None, None

        def emit() -> pa.RecordBatch:
            n = [len(x) for x in best.scores]
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(sum(n), at, np.int64)), pa.array(np.repeat(np.arange(len(n)), n).astype(np.int32)),
                pa.array(np.repeat(best.ids, n)), pa.array(np.concatenate(best.found)),
                pa.array(np.concatenate(best.scores))], names=["asked", "row", "query_id", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["asked"] != at:
                    if best:
                        yield emit()
                    at = r["asked"]
                    best = Best(np.frombuffer(r["q_ids"], np.int64),
                                np.frombuffer(r["q_vectors"], np.int64).reshape(r["q_n"], -1), k)
                ids = np.frombuffer(r["c_ids"], np.int64)
                vectors = np.frombuffer(r["c_vectors"], np.int64).reshape(r["c_n"], -1)
                for lo in range(0, len(ids), CHUNK):
                    best.meet(ids[lo : lo + CHUNK], vectors[lo : lo + CHUNK])
        if best:
            yield emit()

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row is a pair of blocks
    found = stored(dealt.mapInArrow(search, "asked long, row int, query_id long, vec_id long, score long"), "found")
    order = Window.partitionBy("asked", "row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
