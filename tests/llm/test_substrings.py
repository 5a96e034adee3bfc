import hashlib
import random

from . import cases
import pytest

from brindle.llm import substrings


def brute(rows, window=50):
    first = {}
    split = [(d, cases.words(t)) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                g = tuple(w[i : i + window])
                first[g] = min(d, first.get(g, d))
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(df, window=50, k=12, **more):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in substrings.remove_repeats(df, window, k, **more).collect()), key=repr)
    assert got == brute(rows, window)
    return got


def test_matches_brute_force(spark):
    assert sum(r[2] for r in check(cases.docs(spark))) > 500


@pytest.mark.parametrize(("window", "k"), [(5, 3), (8, 8), (1, 1), (30, 4)])
def test_other_windows(spark, window, k):
    rng = random.Random(window)
    texts = [cases.prose(rng, rng.randrange(0, 60), 6) for _ in range(40)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window, k)


def test_periodic_texts(spark):
    rows = [(3, "a b " * 60), (1, "b a " * 40), (2, "a " * 130), (5, "a " * 50 + "b"), (4, "c " + "a " * 49)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_empty_and_nameless(spark):
    assert check(cases.none(spark)) == []
    check(cases.nameless(spark))


def test_kept_text(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(60)))), (2, "x " + " ".join(map(str, range(60))) + " y")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in substrings.remove_repeats(df, with_text=True).collect()}[2] == "x y"


def test_rows_that_share_an_id_are_judged_each_by_its_text(spark):
    p, q = (" ".join(f"{x}{i}" for i in range(60)) for x in "pq")
    check(spark.createDataFrame([(1, p), (2, p), (2, q), (2, p), (3, q), (3, f"{p} {q}")], "doc_id long, text string"))


def test_confused_hashes_change_nothing(spark):
    """Words whose hashes collide give spans that aren't alike; their words tell."""
    rows = [(i, " ".join(f"{x}{j}" for j in range(90))) for i, x in enumerate("abcabd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r[2] for r in check(df, bits=1)) == 180
    check(cases.docs(spark), bits=4)


def test_words_of_colliding_sums(spark):
    """Strings of this kind agree in any sum of powers modulo 2**64."""
    a = "a"
    while len(a) < 4096:
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    tail = " ".join(map(str, range(70)))
    assert [r[2] for r in check(spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{b} {tail}")], "doc_id long, text string"))] == [0, 70, 71]


def test_long_paths_are_compacted(spark):
    rng = random.Random(2)
    text = cases.prose(rng, 4000, 10**6)
    df = spark.createDataFrame([(1, text), (2, text), (3, f"{cases.prose(rng, 80)} {text}"), (4, cases.prose(rng, 500))], "doc_id long, text string")
    spans = substrings.repeated_spans(df).collect()
    assert len(spans) < 10 and max(r["n"] for r in spans) > 3800 and {r["s_doc"] for r in spans} == {1}
    check(df)
