"""Connected components: local contraction, and alternating large-star and small-star steps over staged tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

LINKS = "a long, b long"
TASK_LINKS = 1 << 20  # links that a task contracts at once


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, roots) of the components of some links; a root is its component's least vertex."""
    vertices, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(vertices))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for ends in (label[x], label[y]):  # hook the roots of both ends
            np.minimum.at(new, ends, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return vertices, vertices[label]
        label = new


def links_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from each vertex of a task to the root that it has there; a full buffer is contracted before more is read."""
    held_a, held_b, n = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    more: list[pa.RecordBatch] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        a, b = contracted(*(np.concatenate([held, *(m.column(i).to_numpy() for m in more)]) for i, held in enumerate((held_a, held_b))))
        return a[a != b], b[a != b]

    for batch in batches:
        more.append(batch)
        n += batch.num_rows
        if n >= TASK_LINKS:
            held_a, held_b = merged()
            more, n = [], 0
    a, b = merged()
    yield links_batch(a, b)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each vertex's larger (or smaller) neighbours to the least vertex in its neighbourhood."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    down = edges.select(high.alias("u"), low.alias("v"))
    around = down.union(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    # min combines on the map side; staged, it has no partitioning that the join would have to keep,
    # so AQE can split a vertex with very many links
    least = stage(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    linked = around.join(least, "u")
    if large:
        new = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        new = linked.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return new.filter("a <> b").distinct()


def components(edges: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(vertex, root) of every vertex with a link; root is its component's least vertex, and has a row too.

    ``edges`` has two long columns a and b in any order; loops and repeats don't
    matter. Each round first contracts what tasks of about ``task_links`` links
    hold; if that was all in one task, it is done, else star steps bring
    together what lies apart, until nothing changes.
    """
    now = stage(edges.select("a", "b").filter("a <> b"), "edges")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        tasks = math.ceil(mark[0] / task_links)
        local = now.coalesce(tasks).mapInArrow(_contract, LINKS)
        if tasks == 1:
            now = stage(local, "edges")
            break
        now = stage(_star(_star(stage(local, "edges"), True), False), "edges")
    pairs = now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return pairs.union(pairs.select(F.col("root").alias("vertex"), "root").distinct())
