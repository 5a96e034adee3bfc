import itertools
import os
from collections import Counter, defaultdict

from . import cases
import numpy as np
import pytest

from brindle.llm import graph, neardup


def shingles(t, k):
    w = cases.words((t or "").translate({ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t in rows]
    ids = sorted({d for d, _ in sets if d is not None})
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
            i, j = find(a), find(b)
            parent[max(i, j)] = min(i, j)
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=repr)


def run(df, **more):
    return sorted((tuple(r) for r in neardup.near_duplicates(df, **more).collect()), key=repr)


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 512), (5, 80, 512), (3, 85, 4), (2, 60, 3)])
def test_matches_brute_force(spark, k, percent, block):
    df = cases.docs(spark)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = brute(rows, k, percent)
    assert run(df, k=k, percent=percent, block=block) == want
    assert sum(not r[3] for r in want) > 10


def exact_groups(rows, k, percent):
    """Component of each document by an exact prefix-filter join over all rows."""
    sets = {d: shingles(t, k) for d, t in rows}
    seen = Counter(s for x in sets.values() for s in x)
    by, parent = defaultdict(list), {d: d for d in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for d, x in sorted(sets.items(), key=lambda r: (len(r[1]), r[0])):
        rare = sorted(x, key=lambda s: (seen[s], s))[: len(x) - -(-percent * len(x) // 100) + 1]
        for other in {o for s in rare for o in by[s]}:
            y = sets[other]
            if find(d) != find(other) and 100 * len(y) >= percent * len(x) and 100 * len(x & y) >= percent * len(x | y):
                i, j = find(d), find(other)
                parent[max(i, j)] = min(i, j)
        for s in rare:
            by[s].append(d)
    return {d: find(d) for d in sets}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_no_link_is_lost_on_whole_tables(spark, k, percent):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    want = exact_groups([tuple(r) for r in df.collect()], k, percent)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, k=k, percent=percent).collect()}
    copies = [d for d, c in want.items() if c != d]
    print(f"{sum(got[d] == want[d] for d in copies)} of {len(copies)} copies")
    assert got == want and len(copies) > 500


def test_empty_and_nameless(spark):
    assert run(cases.none(spark)) == []
    df = cases.nameless(spark)
    assert run(df, k=3, percent=85) == brute([tuple(r) for r in df.select("doc_id", "text").collect()], 3, 85)


def test_odd_sketches_estimate(spark):
    assert neardup.most_different_bits(1.0, 100) == 0
    assert neardup.most_different_bits(0.6, 100) > neardup.most_different_bits(0.85, 100) > 26
    assert neardup.bands_for(0.85) == 20


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["vertex"]: r["root"] for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    apart = {r["vertex"]: r["root"] for r in graph.components(spark.createDataFrame(path, "a long, b long").repartition(6), task_links=15).collect()}
    assert apart == got


def test_random_components():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.integers(0, 60, (2, rng.integers(1, 60)))
        vertices, roots = graph.contracted(a, b)
        root = dict(zip(vertices.tolist(), roots.tolist(), strict=True))
        known = {v: {v} for v in root}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            both = known[x] | known[y]
            for v in both:
                known[v] = both
        assert all(root[v] == min(known[v]) for v in root)


@pytest.mark.parametrize(("rows", "size"), [(3, 10**9), (1000, 60)])
def test_groups_beyond_a_block_lose_no_link(spark, rows, size):
    """Numbers are linked if they differ by 3 at most; a chain of them, a crowd, and some that are linked with nothing."""
    members = [(1, v, 20) for v in range(0, 90, 3)] + [(2, v, 20) for v in [*range(1000, 1040), 1100, 1101, 1200, 1300]] + [(3, 5000, 20), (3, 5001, 20), (4, 7000, 20)]
    df = spark.createDataFrame([(*m, m[1]) for m in members], "g long, rep long, bytes long, v long")

    def prepare(batch, edge):
        v = batch.column(1).to_numpy()
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield lambda i, others, own=v[a:b]: np.abs(own[others] - own[i]) <= 3

    links = neardup.linked_in_groups(df, prepare, rows, size)
    assert all(abs(r["a"] - r["b"]) <= 3 for r in links.collect())
    got = {r["vertex"]: r["root"] for r in graph.components(links).collect()}
    assert got == {v: 0 for v in range(0, 90, 3)} | {v: 1000 for v in range(1000, 1040)} | {1100: 1100, 1101: 1100, 5000: 5000, 5001: 5000}


def test_spanning_forest_reaches_all():
    m = np.zeros((9, 9), bool)
    for a, b in [(0, 3), (3, 5), (5, 8), (1, 2)]:
        m[a, b] = m[b, a] = True
    assert len(neardup.spanning(9, lambda i, others: m[i][others])) == 4
