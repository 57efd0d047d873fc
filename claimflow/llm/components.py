"""Connected components of a link table by alternating stars, on DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.llm.common import stored

EDGES = "u long, v long"
#: Links that one task may hold; more are worked on in rounds over all tasks.
ONE_TASK = 500_000


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars around the smallest node of each of its components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())],
                                     names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: a node's larger neighbours move to its smallest one. Small star: it and its smaller ones do."""
    low = F.least("u", "v")
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), low.alias("v"))
    least = both.groupBy(F.col("u").alias("w")).agg(F.min(F.least("u", "v")).alias("m"))
    near = both.join(least, both["u"] == least["w"])
    out = near.where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out if large else out.distinct()


def _labels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of one partition's links with the smallest node it reaches there."""
    for stars in _forest(batches):
        roots = stars.column(1).unique()
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([stars.column(0), roots]),
                                          pa.concat_arrays([stars.column(1), roots])], names=["node", "component"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns u, v): the smallest node it reaches.

    Each partition first shrinks its own links to stars. If at most ``one_task`` links remain (16 bytes
    each), one task ends the work; otherwise large and small stars alternate until nothing changes, in
    a number of rounds that grows with the logarithm of the longest chain. Both give the same rows.
    """
    edges = stored(links.where("u <> v").mapInArrow(_forest, EDGES), "forest")
    if edges.count() <= one_task:
        return stored(edges.coalesce(1).mapInArrow(_labels, "node long, component long"), "components")
    mark = None
    while True:
        edges = stored(_star(_star(edges, True), False), "stars")
        r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(r) == mark:
            break
        mark = tuple(r)
    least = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = least.select(F.col("component").alias("node"), "component").distinct()
    return stored(least.unionByName(roots), "components")
