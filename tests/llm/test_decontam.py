import random

from . import cases

from brindle.llm import decontam

ALNUM = "".join(chr(c) for c in range(0x80) if not chr(c).isalnum())
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def split(t):
    return cases.words((t or "").translate(LOWER), ALNUM)


def brute(docs, items, window=13):
    pats = {}
    for i, t in items:
        w = split(t)
        if i is not None:
            for j in range(max(1, len(w) - window + 1) if w else 0):
                pats.setdefault(tuple(w[j : j + window]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, names = split(t), set(), set()
        for m in {len(p) for p in pats}:
            for j in range(len(w) - m + 1):
                if (p := tuple(w[j : j + m])) in pats:
                    hit.update(range(j, j + m))
                    names |= pats[p]
        out.append((d, len(w), len(hit), len(names), sorted(names)))
    return sorted(out, key=repr)


def items(spark):
    rng = random.Random(9)
    texts = cases.texts()
    rows = [(1, texts[4]), (2, texts[5][:90]), (20, "one TWO!"), (3, "日本語 テキスト"), (4, ""), (5, None), (6, "..."), (None, "one"), (7, cases.prose(rng, 40)), (1, texts[6]), (8, texts[4]), (9, "a" * 5000), (10, "w1 w1 w1")]
    return spark.createDataFrame(rows, "item_id long, text string"), rows


def run(df, bench, **more):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], list(r["items"])) for r in decontam.find_benchmark(df, bench, **more).collect()), key=repr)


def test_matches_brute_force(spark):
    bench, rows = items(spark)
    df = cases.docs(spark)
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = brute(docs, rows)
    assert run(df, bench) == want and any(r[2] for r in want)
    assert run(df, bench, broadcast_bytes=3000) == want  # several blocks of patterns
    assert run(df, bench, broadcast_bytes=700) == want  # more than executors hold at once


def test_table_grows_with_the_patterns():
    """Few slots are nought, however many patterns there are, so that most positions are skipped."""
    rng = random.Random(3)
    for n in (20, 20_000):
        patterns = decontam.compile_patterns([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(13))) for i in range(n)], 13)
        assert [p.m for p in patterns] == [13] and len(patterns[0].strings) == n
        assert (patterns[0].shift < 12).mean() < 0.13


def test_overlapping_periodic_patterns(spark):
    docs = [(1, "a b a b a b a"), (2, "b b b b"), (3, "A-b:a"), (None, "a b a")]
    rows = [(1, "a b a"), (2, "b b"), (3, "a")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")
    assert run(df, bench) == brute(docs, rows)


def test_empty_tables(spark):
    bench, _ = items(spark)
    assert run(cases.none(spark), bench) == []
    df = cases.docs(spark)
    assert all(r[2] == 0 for r in run(df, bench.filter("false")))
