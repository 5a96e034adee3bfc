"""Exact top-k inner products by a Voronoi join.

Vectors are grouped by their nearest pivot; there are about as many pivots as
the square root of the rows. A cell is cut into rings by the distance to its
pivot, and a ring's summary (pivot, greatest distance, rows) bounds from above
every score with a member. Large rings are cut into blocks of bounded size,
small ones of neighbouring cells share one.

Queries are grouped by the same pivots. They first meet the few cells that
look best, which bounds their k-th score from below. Then each group's least
bound is held against the summaries once, its queries' own bounds against what
that leaves, and a query is sent only to the blocks of rings that it may need.
Each block is solved by a task that holds it and streams the queries past.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import sample_by_hash, stage

ROUTED = "vec_id long, v array<long>, cell int, dist double, salt long"
SENT = "block long, query_id long, v array<long>, floor long"
FOUND = "query_id long, vec_id long, score long"
EXACT, WIDE = float(1 << 52), float(1 << 62)
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
MOST_PIVOTS = 4096  # that come to the driver and are broadcast
RINGS = 8  # of a cell at most
LENGTHS = 4  # the most frequent lengths of vectors, which have pivots
STEP = 1024  # vectors that meet all pivots, or a block, at once


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point or 64-bit integers where no sum can lose a bit, else by unbounded ones, held at the ends of 64 bits."""
    top = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if top < EXACT:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if top < WIDE:
        return q @ x.T
    exact = q.astype(object) @ x.T.astype(object)
    return np.minimum(np.maximum(exact, LOWEST), HIGHEST).astype(np.int64)


def quantise(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors that are null, empty or hold a null, NaN or infinity are left out; what 64 bits can't hold is held at their ends."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    good = vectors.filter("vec_id is not null and embedding is not null and size(embedding) > 0").filter(whole)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _route(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each row's nearest pivot and the distance to it."""
    squares = (pivots**2).sum(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                x = _matrix(batch.column(1)).astype(np.float64)
                salt = np.arange(seen, seen + len(x))
                seen += len(x)
                near = np.argmin(squares - 2 * (x @ pivots.T), axis=1)
                dist = np.sqrt(((x - pivots[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(dist), pa.array(salt)], names=["vec_id", "v", "cell", "dist", "salt"])

    return rows.mapInArrow(assign, ROUTED)


class Plan:
    """The summaries of all rings, and the blocks that hold them.

    ``rings`` are (cell, ring, rows, greatest distance), sorted. Rings of more
    than ``block_rows`` rows have blocks of their own; smaller ones are packed,
    cell by cell along the direction in which the pivots differ most.
    """

    def __init__(self, pivots: np.ndarray, rings: list[tuple[int, int, int, float]], block_rows: int) -> None:
        cell, ring, n, far = (np.array([r[i] for r in rings]) for i in range(4))
        self.cell, self.ring, self.rows = cell, ring, n
        self.pivots = pivots
        self.far = far.astype(np.float64) * (1 + 1e-9) + 1e-6
        spread = pivots - pivots.mean(0)
        _, vectors = np.linalg.eigh(spread.T @ spread / max(1.0, float(np.abs(spread).max(initial=0)) ** 2))
        order = np.lexsort((ring, cell, (spread @ vectors[:, -1])[cell]))
        self.chunks = -(-n // block_rows)
        self.first = np.zeros(len(n), np.int64)
        at, room = -1, 0
        for i in order.tolist():
            if n[i] > room or self.chunks[i] > 1:
                at, room = at + 1, block_rows
            self.first[i] = at
            room -= int(n[i])
            if self.chunks[i] > 1:
                at, room = at + int(self.chunks[i]) - 1, 0

    def trial(self, q: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, ring) pairs of the cells whose pivots score best."""
        lean = q @ self.pivots.T
        lean[:, np.setdiff1d(np.arange(len(self.pivots)), self.cell)] = -np.inf
        chosen = np.zeros(lean.shape, dtype=bool)
        np.put_along_axis(chosen, np.argsort(-lean, axis=1, kind="stable")[:, :cells], True, axis=1)
        return np.nonzero(chosen[:, self.cell])

    def needed(self, q: np.ndarray, group: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, ring) pairs that a floor doesn't rule out; queries of one group must stand together."""
        edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(group) else np.zeros(1, np.int64)
        norms = np.sqrt((q**2).sum(1))
        far_pivot = np.sqrt((self.pivots**2).sum(1))
        who, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            middle = self.pivots[group[a]]
            radius = np.sqrt(((q[a:b] - middle) ** 2).sum(1).max())
            lean = (self.pivots @ middle)[self.cell]
            reach = radius * far_pivot[self.cell] + norms[a:b].max() * self.far
            rest = np.flatnonzero(self._may(lean, reach, floors[a:b].min()))  # for the whole group
            lean = q[a:b] @ self.pivots[self.cell[rest]].T
            i, j = np.nonzero(self._may(lean, norms[a:b, None] * self.far[rest], floors[a:b, None]))
            who.append(i + a)
            where.append(rest[j])
        return np.concatenate(who), np.concatenate(where)

    @staticmethod
    def _may(lean: np.ndarray, reach: np.ndarray, floor: np.ndarray) -> np.ndarray:
        upper = lean + reach + 1e-9 * (np.abs(lean) + reach) + 1e-3  # beyond what rounding loses
        return np.maximum(upper, float(LOWEST)) >= np.asarray(floor, dtype=np.float64) * (1 - 1e-15 * np.sign(floor))

    def blocks(self, who: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different (query, block) pairs of (query, ring) pairs."""
        n = self.chunks[where]
        who = np.repeat(who, n)
        block = np.repeat(self.first[where], n) + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        both = np.unique(np.stack([who, block], axis=1), axis=0) if len(who) else np.zeros((0, 2), np.int64)
        return both[:, 0], both[:, 1]


def _solve(data: DataFrame, sent: DataFrame, k: int) -> DataFrame:
    """Each sent query's k best in the block that it was sent to, without its own row and those under its floor; the vectors of a block have one length."""
    side = F.lit(None).cast("long")
    both = data.select("block", F.lit(0).alias("kind"), "vec_id", "v", side.alias("floor")).union(sent.select("block", F.lit(1).alias("kind"), "query_id", "v", "floor"))
    sorted_rows = both.repartition("block").sortWithinPartitions("block", "kind", "vec_id")

    def best(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch | None:
        s = _scores(q, x)
        own = ids[None, :] == q_ids[:, None]
        ok = (s >= floors[:, None]) & ~own
        if (at := len(x) - k) > 0:  # under a block's own k-th nothing need be sorted
            ok &= s >= np.partition(np.where(own, LOWEST, s), at, axis=1)[:, at, None]
        rows, cols = np.nonzero(ok)
        if not len(rows):
            return None
        value = s[rows, cols]
        order = np.lexsort((ids[cols], ~value, rows))  # ~ turns the order around and can't overflow
        rows, cols, value = rows[order], cols[order], value[order]
        begins = np.concatenate(([True], rows[1:] != rows[:-1]))
        place = np.arange(len(rows)) - np.maximum.accumulate(np.where(begins, np.arange(len(rows)), 0))
        top = place < k
        return pa.RecordBatch.from_arrays([pa.array(q_ids[rows[top]]), pa.array(ids[cols[top]]), pa.array(value[top])], names=["query_id", "vec_id", "score"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held_ids, held, ready = None, [], [], None
        for batch in batches:
            block, kind, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            floors = batch.column(4).fill_null(0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(ids)], strict=True):
                if a == b:
                    continue
                if block[a] != now:
                    now, held_ids, held, ready = block[a], [], [], None
                v = _matrix(batch.column(3).slice(a, b - a))
                if kind[a] == 0:
                    held_ids.append(ids[a:b])
                    held.append(v)
                    continue
                if not held:
                    continue
                if ready is None:
                    ready = np.concatenate(held_ids), np.concatenate(held)
                for i in range(a, b, STEP):
                    j = min(b, i + STEP)
                    if (out := best(ids[i:j], v[i - a : j - a], floors[i:j], *ready)) is not None:
                        yield out

    return sorted_rows.mapInArrow(solve, FOUND)


def top_k(vectors: DataFrame, query_filter: str, k: int = 20, n_pivots: int | None = None, trial_cells: int = 6, block_rows: int = 4096, scale: int = 64, lengths: int = LENGTHS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets ``query_filter`` the k best of all other rows, exactly.

    Ties go to the smaller vec_id; a query with fewer others gets them all.
    Only vectors of one length have a score. Vectors left out by ``quantise``
    are neither queries nor results. Rows that repeat a vec_id are candidates
    each, but never of a query of that id; a query id with several vectors
    takes the best of all. Scores that 64 bits can't hold are held at their
    ends, and tie there. An empty table gives an empty one. The pivots, the
    square root of the rows in number unless given and ``MOST_PIVOTS`` at most,
    are chosen by hash; vectors of the ``lengths`` most frequent lengths have
    some, the others meet all of their own length.
    """
    rows = stage(quantise(vectors, scale).withColumn("n", F.size("v")), "vectors")
    counts = stage(rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows")), "lengths")
    frequent = counts.orderBy(F.col("rows").desc(), "n").limit(lengths).collect()
    parts = [_near(rows.filter(F.col("n") == r["n"]).select("vec_id", "v"), query_filter, k, min(MOST_PIVOTS, n_pivots or max(16, math.isqrt(r["rows"]))), trial_cells, block_rows) for r in frequent]
    rare = counts.join(F.broadcast(rows.sparkSession.createDataFrame([(r["n"],) for r in frequent], "n int")), "n", "left_anti")
    if rare.limit(1).count():
        parts.append(_every(rows.join(rare, "n"), query_filter, k, block_rows))
    found = parts[0] if parts else rows.sparkSession.createDataFrame([], FOUND)
    for p in parts[1:]:
        found = found.union(p)
    return found.withColumn("rank", F.row_number().over(_order()).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _order():
    return Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")


def _every(rows: DataFrame, query_filter: str, k: int, block_rows: int) -> DataFrame:
    """Each query's k best in each block of its length; ``rows`` is the number of rows of that length."""
    blocks = F.ceil(F.col("rows") / block_rows)
    base = F.shiftleft(F.col("n").cast("long"), 40)
    data = rows.select("vec_id", "v", (base + F.pmod(F.xxhash64("vec_id", "v"), blocks)).alias("block"))
    queries = rows.filter(query_filter).select("vec_id", "v", "n", "rows").distinct()
    sent = queries.select(F.col("vec_id").alias("query_id"), "v", F.explode(F.sequence(base, base + blocks - 1)).alias("block"), F.lit(LOWEST).cast("long").alias("floor"))
    return _solve(data, sent, k)


def _near(rows: DataFrame, query_filter: str, k: int, n_pivots: int, trial_cells: int, block_rows: int) -> DataFrame:
    chosen = sample_by_hash(rows, ["v"], n_pivots).select("v").toArrow().column(0).combine_chunks()
    pivots = np.unique(_matrix(chosen).astype(np.float64), axis=0)
    routed = stage(_route(rows, pivots), "routed")
    parts = F.array(*(F.lit(i / RINGS) for i in range(1, RINGS)))
    cells = routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("dist", parts, F.lit(1000)).alias("at"))
    edges = F.when(F.col("n") > block_rows, F.array_distinct("at")).otherwise(F.array().cast("array<double>"))
    cells = stage(cells.select("cell", edges.alias("at")), "cells")  # one for each pivot
    ring = F.size(F.filter("at", lambda e: e < F.col("dist")))
    ringed = routed.join(F.broadcast(cells), "cell").withColumn("ring", ring)
    sums = ringed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far")).collect()
    plan = Plan(pivots, sorted((r["cell"], r["ring"], r["n"], r["far"]) for r in sums), block_rows)
    places = rows.sparkSession.createDataFrame(list(zip(plan.cell.tolist(), plan.ring.tolist(), plan.first.tolist(), plan.chunks.tolist(), strict=True)), "cell int, ring int, first long, chunks long")
    # the salt is staged, so that a lost task's rows go where they went before; it deals repeats of a vec_id apart
    block = F.col("first") + F.pmod(F.xxhash64("vec_id", "salt"), F.col("chunks"))
    data = ringed.join(F.broadcast(places), ["cell", "ring"]).select("vec_id", "v", block.alias("block"))
    queries = stage(routed.filter(query_filter).select("vec_id", "v", "cell").distinct(), "queries")
    sent_plan = rows.sparkSession.sparkContext.broadcast(plan)

    def send(first: bool):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plan = sent_plan.value
            for whole in batches:
                for at in range(0, whole.num_rows, STEP):
                    batch = whole.slice(at, STEP)
                    q = _matrix(batch.column(1)).astype(np.float64)
                    if first:
                        floors = np.full(len(q), LOWEST)
                        who, where = plan.trial(q, trial_cells)
                    else:
                        floors = batch.column(3).to_numpy(zero_copy_only=False)
                        who, where = plan.needed(q, batch.column(2).to_numpy(zero_copy_only=False), floors)
                    who, block = plan.blocks(who, where)
                    for i in range(0, len(who), STEP):
                        own = who[i : i + STEP]
                        take = pa.array(own)
                        yield pa.RecordBatch.from_arrays([pa.array(block[i : i + STEP]), batch.column(0).take(take), batch.column(1).take(take), pa.array(floors[own])], names=["block", "query_id", "v", "floor"])

        return go

    trial = _solve(data, queries.mapInArrow(send(True), SENT), k)
    kth = trial.withColumn("r", F.row_number().over(_order())).filter(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    floors = F.coalesce("floor", F.lit(LOWEST).cast("long")).alias("floor")
    bounded = queries.join(kth, "vec_id", "left").select("vec_id", "v", "cell", floors)
    # AQE splits a cell with very many queries; it is no group that must stay together
    bounded = stage(bounded.hint("rebalance", "cell").sortWithinPartitions("cell"), "queries")
    return _solve(data, bounded.mapInArrow(send(False), SENT), k)
