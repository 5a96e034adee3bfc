import math
import random

import numpy as np

from brindle.llm import topk
from brindle.llm.staging import sample_by_hash

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, score long"


def brute(rows, every, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        own = [v for i, v in good if i == q]
        found = sorted({(-sum(a * b for a, b in zip(x, v, strict=True)), i, n) for x in own for n, (i, v) in enumerate(good) if i != q and len(v) == len(x)})
        out += [(q, r + 1, i, -s) for r, (s, i, _) in enumerate(found[:k])]
    return sorted(out)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    f = lambda: rng.randrange(-64, 64) / 32
    rows = [(i, [f() for _ in range(6)]) for i in range(300)]
    rows += [(i, [1.0, 0.5, 0.0, -0.5, 0.25, 1.5]) for i in range(300, 420)]  # one hot vector
    rows += [(1000, None), (1020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1040, [math.nan] * 6), (1060, [math.inf] + [0.0] * 5), (1080, []), (None, [1.0] * 6), (1100, [0.0] * 6), (2000, [1.0, 2.0]), (2020, [0.5, -2.0])]
    df = spark.createDataFrame([(*r, 0, 1, 2) for r in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, "vec_id % 20 = 0", k=5, n_pivots=8, trial_cells=2, block_rows=50).collect())
    assert got == brute(rows, 20, 5)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 0, 0, 0)], SCHEMA)
    assert topk.top_k(df, "vec_id % 20 = 0").collect() == []
    assert topk.top_k(df.filter("false"), "vec_id % 20 = 0").collect() == []
    both = spark.createDataFrame([(0, [1.0], 0, 0, 0), (1, [-3.0], 0, 0, 0)], SCHEMA)
    assert [tuple(r) for r in topk.top_k(both, "vec_id % 20 = 0").collect()] == [(0, 1, 1, -64 * 192)]


def test_large_values_are_exact_or_held_at_the_ends(spark):
    rows = [(0, [3.0e9, 1.0]), (1, [2.0e9, 1.0]), (2, [2.0e9, 2.0]), (3, [-2.0e9, 5.0]), (4, [1.0, 1.0]), (5, [3.0, 1.0])]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in topk.top_k(df, "vec_id % 20 = 0").collect())
    held = [(0, 1, 1, (1 << 63) - 1), (0, 2, 2, (1 << 63) - 1)]  # these tie, so the smaller id comes first
    assert got == held + [(0, 3, 5, 4096 * (9 * 10**9 + 1)), (0, 4, 4, 4096 * (3 * 10**9 + 1)), (0, 5, 3, -(1 << 63))]
    far = spark.createDataFrame([(i, [1e17 * (i + 1), -3e38 if i == 3 else 0.0], 0, 0, 0) for i in range(4)], SCHEMA)
    assert [r["score"] for r in topk.top_k(far, "vec_id = 0").collect()] == [(1 << 63) - 1] * 3
    rng = random.Random(7)
    wide = [(i, [float(rng.randrange(-(2**20), 2**20)) * 16 for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in wide], SCHEMA)
    assert sorted(tuple(r) for r in topk.top_k(df, "vec_id % 20 = 0", k=7, n_pivots=5, trial_cells=1, block_rows=9).collect()) == brute(wide, 20, 7)


def test_many_lengths(spark):
    rng = random.Random(9)
    rows = [(i, [rng.randrange(-64, 64) / 32 for _ in range(1 + i % 11)]) for i in range(400)]
    df = spark.createDataFrame([(*r, 0, 1, 2) for r in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, "vec_id % 20 = 0", k=5, n_pivots=4, block_rows=10, lengths=3).collect())
    assert got == brute(rows, 20, 5)


def _clustered(n=6000, dims=16, clusters=40):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3, (clusters, dims))
    return np.floor(64 * (centres[rng.integers(0, clusters, n)] + rng.normal(0, 0.1, (n, dims))))


def test_clustered_vectors_are_pruned():
    """Of clustered vectors most pairs are never compared; the bounds hold for all."""
    x = _clustered()
    pivots = x[:: len(x) // 77][:77]
    near = np.argmin(((x[:, None] - pivots) ** 2).sum(2), axis=1)
    dist = np.sqrt(((x - pivots[near]) ** 2).sum(1))
    ring = (dist > np.median(dist)).astype(int)
    rings = [(c, r, int(m.sum()), float(dist[m].max())) for c in range(77) for r in (0, 1) if (m := (near == c) & (ring == r)).any()]
    plan = topk.Plan(pivots, rings, 200)
    assert sum(plan.rows) == len(x) and len(set(plan.first.tolist())) < len(rings)
    queries = np.argsort(near, kind="stable")[::20]
    q = x[queries]
    scores = q @ x.T
    floors = np.sort(scores, axis=1)[:, -20].astype(np.int64)
    who, where = plan.needed(q, near[queries], floors)
    sent = np.zeros((len(q), len(rings)), bool)
    sent[who, where] = True
    mine = np.array([next(i for i, (a, b, *_) in enumerate(rings) if a == c and b == r) for c, r in zip(near, ring, strict=True)])
    best = scores >= floors[:, None]
    assert sent[np.nonzero(best)[0], mine[np.nonzero(best)[1]]].all()
    pruned = 1 - (sent * np.array([r[2] for r in rings])).sum() / (len(q) * len(x))
    print(f"{pruned:.3f} of the pairs pruned")
    assert pruned > 0.9


def test_clustered_vectors_match_brute_force(spark):
    x = _clustered(1500)
    rows = [(i, (v / 64).tolist()) for i, v in enumerate(x)]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA), "vec_id % 50 = 0", k=20, block_rows=64).collect())
    assert got == brute(rows, 50, 20)


def test_repeats_leave_pivots(spark):
    """Many repeats of few vectors neither thin the pivots nor lose the result."""
    for copies, distinct, wanted in ((200, 100, 64), (2000, 1, 1)):
        df = spark.range(copies * distinct).selectExpr("id AS vec_id", f"array(id % {distinct}) AS v")
        assert sample_by_hash(df, ["v"], 64).count() == wanted
    assert sample_by_hash(spark.range(1000), ["id"], 5).count() == 5
    for value in range(3):  # any of these may hash beyond the share
        rows = [(i, [float(value), 1.0], 0, 0, 0) for i in range(300)]
        got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, SCHEMA), "vec_id = 0", k=3).collect())
        assert got == [(0, i, i, 4096 * (value**2 + 1)) for i in (1, 2, 3)]
