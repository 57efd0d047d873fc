"""Vector code compression: product codes of integer vectors, nearest entries found through GNATs.

A vector is cut into consecutive parts; each part position has a codebook, and a part is coded by the
index of its nearest entry (squared Euclidean distance in integers, ties to the lower index). Codebooks
start as the parts of the vectors with the smallest ids and move for some rounds to the floored means of
the parts assigned to them.

The search for the nearest entry goes through a geometric near-neighbour access tree over a codebook. A
node has split points; every other entry of it belongs to the child of the nearest split point, and for
each pair (split point i, child j) the node keeps the range of distances from i to the members of j. By
the triangle inequality a query at distance d from i is at least ``low - d`` and ``d - high`` from all of
them, so a child whose bound is strictly beyond the best distance so far is skipped whole. Ranges, distances
and the best distance are rounded outwards, a bound that ties keeps the child, and candidates are compared
as integers (distance, index). A batch of vectors walks the tree together, first into the child of each
one's nearest split point, then into what is left. How much is skipped depends on the data: nothing that
is spread evenly over many dimensions can be excluded.

Spark reads the vectors once and keeps them as integers; each round is one pass that returns, per task, a
sum and a count for each entry, and a sum by entry of those. What reaches the driver is the codebooks: a
few hundred entries a part whatever the table holds.

Defined results: vectors that are null, empty or hold null or non-finite components are left out, and so
are those whose length is not that of the vector with the smallest id. A length that the number of parts
does not divide is cut as evenly as can be. Null ids are coded but start no entry; rows that share an id
are all coded, the smallest of their vectors starts the entry. With fewer ids than entries a codebook is
that much smaller. Equal entries stay apart, the lower index takes the parts. Null labels form one group.
A component of 131072 or more in size ends the job with an error, as its squares would leave 64 bits. An
empty table gives an empty result. Only id, vector and label are read, so other columns do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimflow.llm.common import stored
from claimflow.llm.topk import usable
from claimflow.operators.lookup import lookup_join

SPLITS = 8  # split points of a node
LEAF = 12  # entries of a node that is not split further
BATCH = 8192  # vectors that walk a tree together
LARGEST = 1 << 27  # integer components stay below this
EXACT = 1 << 52  # sums below this are exact in floating point
OUT = 1e-14  # relative rounding outwards, many times what a conversion and a root can err


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances of two sets of integer vectors, exact."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    top = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * top * top * a.shape[1] < EXACT:
        a, b = a.astype(np.float64), b.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((a - p) ** 2).sum(1) for p in b], axis=1)


class Gnat:
    """Nearest entry of a codebook for batches of vectors."""

    def __init__(self, entries: np.ndarray, splits: int = SPLITS, leaf: int = LEAF):
        self.entries, self.splits, self.leaf = entries, splits, leaf
        self.root = self._node(np.arange(len(entries)))
        self.measured = 0  # distances computed by searches

    def _node(self, ids: np.ndarray) -> dict:
        if len(ids) <= max(self.leaf, self.splits):
            return {"ids": ids, "children": []}
        chosen = [0]  # split points far from each other
        near = squared_distances(self.entries[ids], self.entries[ids[:1]])[:, 0]
        while len(chosen) < self.splits:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, squared_distances(self.entries[ids], self.entries[ids[chosen[-1:]]])[:, 0])
        chosen = np.unique(chosen)  # equal entries may leave fewer; ascending, so a first minimum is the lowest index
        rest = np.setdiff1d(np.arange(len(ids)), chosen)
        squares = squared_distances(self.entries[ids[chosen]], self.entries[ids[rest]])
        owner, far = squares.argmin(0), np.sqrt(squares.astype(np.float64))
        low, high = np.full((2, len(chosen), len(chosen)), np.nan)
        children = []
        for j in range(len(chosen)):
            mine = owner == j
            if mine.any():
                low[:, j], high[:, j] = far[:, mine].min(1) * (1 - OUT), far[:, mine].max(1) * (1 + OUT)
                children.append((j, self._node(ids[rest[mine]])))
        return {"ids": ids[chosen], "children": children, "low": low, "high": high}

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest entry."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), len(self.entries))
        if len(queries):
            self._search(self.root, queries, np.arange(len(queries)), best, index)
        return index, best

    def _search(self, node: dict, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        squares = squared_distances(queries[rows], self.entries[node["ids"]])
        self.measured += squares.size
        first = squares.argmin(1)
        least, which = squares[np.arange(len(rows)), first], node["ids"][first]
        better = (least < best[rows]) | ((least == best[rows]) & (which < index[rows]))
        best[rows[better]], index[rows[better]] = least[better], which[better]
        if not node["children"]:
            return
        far = np.sqrt(squares.astype(np.float64))
        down, up = far * (1 - OUT), far * (1 + OUT)
        bounds = {j: np.maximum(node["low"][:, j] - up, down - node["high"][:, j]).max(1) for j, _ in node["children"]}
        for own in (True, False):  # the nearest split point's child first: it tightens the bound for the others
            for j, child in node["children"]:
                reach = np.sqrt(best[rows].astype(np.float64)) * (1 + OUT)
                on = np.flatnonzero(((first == j) == own) & ~(bounds[j] > reach))
                if len(on):
                    self._search(child, queries, rows[on], best, index)


def cuts(length: int, parts: int) -> list[int]:
    return [i * length // parts for i in range(parts + 1)]


def _vectors(batch: pa.RecordBatch, column: str, length: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().astype(np.int64).reshape(-1, length)


def integers(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """Rows (id, label, v) of the usable vectors, components floored after scaling."""
    floored = F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    large = F.exists("vector", lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) >= float(LARGEST))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    checked = F.when(large, F.raise_error(F.lit("a vector component is too large for 64-bit squared distances")))
    return rows.where(usable("vector")).select("id", "label", F.coalesce(
        checked.cast("array<int>"), floored.cast("array<int>")).alias("v"))


def seeds(rows: DataFrame, entries: int) -> np.ndarray:
    """The smallest vector of each of the smallest ids, by id: at most ``entries`` rows reach the driver."""
    ids = rows.where("id IS NOT NULL").select("id").distinct().orderBy("id").limit(entries)
    firsts = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()
    return np.array([r["v"] for r in firsts], np.int64)


def _assigned(trees: list[Gnat], bounds: list[int], vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entry and squared distance of every vector's part, part by part."""
    for p, tree in enumerate(trees):
        part = vectors[:, bounds[p] : bounds[p + 1]]
        found = [tree.nearest(part[lo : lo + BATCH]) for lo in range(0, len(part), BATCH)]
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2


def _sums(books: list[np.ndarray], bounds: list[int]) -> Callable:
    """A pass over vectors: per task, sum and count of the parts assigned to each entry."""
    length, widest = bounds[-1], max(np.diff(bounds))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        totals = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            vectors = _vectors(batch, "v", length)
            for p, (index, _) in enumerate(_assigned(trees, bounds, vectors)):
                part = vectors[:, bounds[p] : bounds[p + 1]]
                order = np.argsort(index, kind="stable")
                at, starts = np.unique(index[order], return_index=True)
                if len(at):
                    totals[p][at, 1:] += np.add.reduceat(part[order], starts, axis=0)
                    totals[p][:, 0] += np.bincount(index, minlength=len(totals[p]))
        for p, total in enumerate(totals):
            used = np.flatnonzero(total[:, 0])
            wide = np.zeros((len(used), widest), np.int64)
            wide[:, : total.shape[1] - 1] = total[used, 1:]
            offsets = pa.array(np.arange(0, (len(used) + 1) * widest, widest, dtype=np.int32)[: len(used) + 1])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(total[used, 0]),
                pa.ListArray.from_arrays(offsets, pa.array(wide.ravel()))], names=["part", "entry", "n", "sums"])

    return run


def moved(rows: DataFrame, books: list[np.ndarray], bounds: list[int]) -> list[np.ndarray]:
    """The codebooks after one round: entries at the floored means of their parts, unused ones as they were."""
    widest = int(max(np.diff(bounds)))
    passed = rows.select("v").mapInArrow(_sums(books, bounds), "part int, entry int, n long, sums array<long>")
    # Sums of sums may leave 64 bits; decimals do not.
    total = [F.sum(F.get("sums", i).cast("decimal(19,0)")).alias(f"s{i}") for i in range(widest)]
    out = [b.copy() for b in books]
    for r in passed.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():
        book = out[r["part"]]
        book[r["entry"]] = [int(Decimal(r[f"s{i}"])) // r["n"] for i in range(book.shape[1])]
    return out


def _codes(books: list[np.ndarray], bounds: list[int], schema: T.StructType) -> Callable:
    length = bounds[-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        digits = np.array([f"{i:02x}" for i in range(max(len(b) for b in books))], object)
        for batch in batches:
            code, error = np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, np.int64)
            for index, distance in _assigned(trees, bounds, _vectors(batch, "v", length)):
                code, error = code + digits[index], error + distance
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error)], names=schema.names)

    return run


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined with commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def train(rows: DataFrame, length: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    bounds, first = cuts(length, parts), seeds(rows, entries).reshape(-1, length)
    books = [first[:, a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    for _ in range(rounds):
        books = moved(rows, books, bounds)
    return books


def vector_codes(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, code, error, label_error, codebooks_sha256`` per kept vector."""
    every = stored(integers(df, id_col, vector_col, label_col, scale), "integers")
    smallest = every.orderBy(F.asc_nulls_last("id"), "v").select(F.size("v")).first()
    length = smallest[0] if smallest else parts
    rows = every.where(F.size("v") == length)
    books = train(rows, length, parts, entries, rounds)
    schema = T.StructType([*rows.select("id", "label").schema.fields, T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType())])
    if not len(books[0]):  # no id to start an entry from
        coded = df.sparkSession.createDataFrame([], schema)
    else:
        coded = stored(rows.mapInArrow(_codes(books, cuts(length, parts), schema), schema), "codes")
    coded = coded.withColumn("group", F.struct("label"))  # structs of null are equal to each other
    sums = stored(coded.groupBy("group").agg(F.sum("error").alias("label_error")), "label-errors")
    out = lookup_join(coded, sums.withColumnRenamed("group", "sum_group"), "group", "sum_group", ["id", "code"])
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error",
                      F.lit(fingerprint(books)).alias("codebooks_sha256"))
