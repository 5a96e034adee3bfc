"""A uniform shuffle into shards of exact sizes.

Rows are permuted within their partition, a matrix with a hypergeometric law
says how many rows each partition sends to each shard, the rows are exchanged
once, and are permuted again within their shard. Everything that touches rows
is a DataFrame expression; the driver sees one count per partition.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

_OWN = ("__part", "__at", "__key", "__bin")


_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def _stirling_error(n: int) -> float:
    """log n! less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - _HALF_LOG_2PI if n else 0.0
    s = 1 / (n * n)
    return (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s / 1188)))) / n


def _deviance(x: int, mean: float, above: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where x is near; ``above`` is x - mean."""
    if abs(above) < 0.1 * (x + mean):
        v = above / (x + mean)
        total, term, j = above * v, 2 * x * v, 1
        while True:
            term *= v * v
            more = total + term / (2 * j + 1)
            if more == total:
                return total
            total, j = more, j + 1
    return x * math.log(x / mean) - above


def _binomial_mass(x: int, n: int, good: int, total: int) -> float:
    """log of the chance of x hits among n draws, each a hit with chance good / total."""
    if x in (0, n):
        hit = good if x else total - good
        return n * math.log1p((hit - total) / total) if n else 0.0
    # x - n * good / total as a quotient of whole numbers
    above = (x * total - n * good) / total
    d = _deviance(x, n * good / total, above) + _deviance(n - x, n * (total - good) / total, -above)
    return _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - d - _HALF_LOG_2PI + 0.5 * math.log(n / (x * (n - x)))


def hypergeometric_mass(x: int, good: int, bad: int, draws: int) -> float:
    """The chance that x of ``draws`` without replacement are good."""
    total = good + bad
    if draws in (0, total):
        return 1.0
    return math.exp(_binomial_mass(x, good, draws, total) + _binomial_mass(draws - x, bad, draws, total) - _binomial_mass(draws, total, draws, total))


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """How many of ``draws`` without replacement are good: exact inversion outward from the mode.

    The expected number of steps is of the order of the standard deviation. The
    mode's mass is a quotient of three binomial ones, none of which is a
    difference of large logarithms; its relative error stays near 1e-12 for
    totals up to 2**53.
    """
    total = good + bad
    lowest, highest = max(0, draws - bad), min(draws, good)
    if lowest == highest:
        return lowest
    mode = min(highest, max(lowest, (draws + 1) * (good + 1) // (total + 2)))
    at_mode = hypergeometric_mass(mode, good, bad, draws)
    while True:
        u = rng.random() - at_mode
        if u <= 0:
            return mode
        down = up = mode
        p_down = p_up = at_mode
        while down > lowest or up < highest:
            if down > lowest:
                p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
                down -= 1
                u -= p_down
                if u <= 0:
                    return down
            if up < highest:
                p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
                up += 1
                u -= p_up
                if u <= 0:
                    return up
            if p_down + p_up < 1e-18 and (down == lowest or p_down < 1e-18) and (up == highest or p_up < 1e-18):
                break  # rounding left a remainder smaller than any probability; draw again


def communication_matrix(counts: list[int], sizes: list[int], rng: random.Random) -> list[list[int]]:
    """Rows sum to ``counts``, columns to ``sizes``; distributed as under a uniform permutation of all rows."""
    if sum(counts) != sum(sizes):
        raise ValueError("counts and sizes must have equal sums")
    left = list(sizes)
    matrix = []
    for n in counts:
        others, row = sum(left), []
        for j, room in enumerate(left):
            others -= room
            k = hypergeometric(room, others, n, rng)
            row.append(k)
            left[j] -= k
            n -= k
        matrix.append(row)
    return matrix


def shuffle_into_shards(df: DataFrame, n_shards: int = 8, seed: int = 7, bin_rows: int = 100_000) -> DataFrame:
    """Deal all rows of ``df`` into ``n_shards`` shards whose counts differ by one at most.

    Adds shard (int, from 0) and slot (long, gapless from 0 in each shard);
    input columns of these names are replaced. Every row counts by itself:
    nulls, equal rows and equal keys need no care and no key is ever hot. An
    empty input gives an empty result. The slots of a shard come from bins of
    about ``bin_rows`` rows, so a shard needn't fit in a task.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot", *_OWN)]
    spark = df.sparkSession
    # rand is drawn per partition; its order is fixed by staging the rows with their places.
    place = F.monotonically_increasing_id()
    placed = df.select(*(F.col(f"`{c}`") for c in kept), F.rand(seed).alias("__key")).sortWithinPartitions("__key").withColumn("__at", place)
    placed = placed.withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)}).drop("__key")
    rows = stage(placed, "shards")
    counts = sorted((r["__part"], r["n"]) for r in rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in counts)
    sizes = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, random.Random(seed))
    bounds = []
    for (part, _), row in zip(counts, matrix, strict=True):
        at, ends = 0, []
        for k in row[:-1]:
            at += k
            ends.append(at)
        bounds.append((part, ends))
    plan = spark.createDataFrame(bounds, "__part long, __ends array<long>")
    shard = F.size(F.filter("__ends", lambda e: e <= F.col("__at")))
    dealt = rows.join(plan, "__part").withColumn("shard", shard.cast("int"))
    bins = max(1, math.ceil(max(sizes, default=0) / bin_rows))
    key = F.xxhash64(F.lit(seed), F.lit("slot"), "__part", "__at")
    dealt = dealt.withColumns({"__key": key, "__bin": F.pmod(F.shiftrightunsigned(key, 17), F.lit(bins))})
    sums = dealt.groupBy("shard", "__bin").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "__bin", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("shard", "__bin").orderBy("__key", "__part", "__at")
    slots = dealt.withColumn("slot", F.row_number().over(within) - 1).join(sums, ["shard", "__bin"])
    return slots.select(*(F.col(f"`{c}`") for c in kept), "shard", (F.col("slot") + F.col("__before")).cast("long").alias("slot"))
