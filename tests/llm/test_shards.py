import random
from collections import Counter

from . import cases
import numpy as np
import pytest

from brindle.llm import shards


def test_sizes_slots_and_rows(spark):
    df = cases.docs(spark, partitions=5)
    out = shards.shuffle_into_shards(df, 8, bin_rows=4)
    assert out.columns == [c for c in df.columns if c != "slot"] + ["shard", "slot"]
    rows = out.collect()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    key = lambda r: (r["doc_id"], r["text"])
    assert Counter(map(key, rows)) == Counter(map(key, df.collect()))


def test_few_rows_and_none(spark):
    assert shards.shuffle_into_shards(cases.none(spark)).count() == 0
    assert sorted((r["shard"], r["slot"]) for r in shards.shuffle_into_shards(cases.nameless(spark)).collect()) == [(0, 0), (1, 0), (2, 0)]


def test_matrix_sums():
    rng = random.Random(2)
    for _ in range(50):
        counts = [rng.randrange(200) for _ in range(6)]
        total = sum(counts)
        sizes = [total // 5 + (j < total % 5) for j in range(5)]
        m = shards.communication_matrix(counts, sizes, rng)
        assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m, strict=True)] == sizes


def test_hypergeometric_law():
    rng = random.Random(3)
    n = 20000
    got = Counter(shards.hypergeometric(7, 5, 6, rng) for _ in range(n))
    from math import comb

    for k in range(1, 7):
        p = comb(7, k) * comb(5, 6 - k) / comb(12, 6)
        assert abs(got[k] / n - p) < 0.015
    assert abs(shards.hypergeometric(10**9, 7 * 10**9, 10**8, rng) - 10**8 / 8) < 10**5


def test_mass_of_large_numbers():
    from fractions import Fraction
    from math import comb

    for x, good, bad, draws in [(3, 7, 5, 6), (0, 5, 9, 4), (60, 100, 300, 200), (250, 1000, 3000, 1000), (40_100, 100_000, 150_000, 100_000), (5, 5, 10**6, 1000)]:
        exact = float(Fraction(comb(good, x) * comb(bad, draws - x), comb(good + bad, draws)))
        assert shards.hypergeometric_mass(x, good, bad, draws) == pytest.approx(exact, rel=1e-10)
    good, bad, draws = 10**12, 7 * 10**12, 10**12 + 12345
    mode = (draws + 1) * (good + 1) // (good + bad + 2)
    ratio = shards.hypergeometric_mass(mode + 1, good, bad, draws) / shards.hypergeometric_mass(mode, good, bad, draws)
    assert ratio == pytest.approx((good - mode) * (draws - mode) / ((mode + 1) * (bad - draws + mode + 1)), rel=1e-9)
    variance = draws * (1 / 8) * (7 / 8) * (good + bad - draws) / (good + bad - 1)
    assert shards.hypergeometric_mass(mode, good, bad, draws) == pytest.approx((2 * np.pi * variance) ** -0.5, rel=1e-6)


@pytest.mark.parametrize("first", [0, 40])
def test_positions_are_uniform(spark, first):
    seen = Counter()
    df = spark.range(80).repartitionByRange(4, "id")
    for seed in range(24):
        seen.update(r["shard"] for r in shards.shuffle_into_shards(df, 4, seed=seed).filter(f"id >= {first} and id < {first + 40}").collect())
    assert all(abs(v - 240) < 60 for v in seen.values())


def test_the_query_returns_whole_rows(spark, tmp_path):
    """Sizes, digests and law of every row, beside shards and slots."""
    import zlib

    from brindle.llm import queries

    cases.docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op2_sharding(spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = out.collect()
    texts = Counter((r["doc_id"], (r["text"] or "").encode()) for r in cases.docs(spark).collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter([(d, len(t) + 1, zlib.crc32(t)) for (d, t), n in texts.items() for _ in range(n)])
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in counts.items())
