import random
import zlib

from . import cases
import numpy as np
import pytest

from brindle.llm import toxicity

RUDE = ["grumbag", "snozzle", "blattered", "wretchling"]


def labelled(n=400, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = cases.prose(rng, rng.randrange(20, 90), 300).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE) + rng.choice(["", "s", "y"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    right = 0
    for i, _, y in rows:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        right += r["held_out"] and r["predicted"] == y
    assert right >= 0.9 * sum(r["held_out"] for r in got.values())


def test_held_out_labels_have_no_influence(spark):
    rows = labelled(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    a = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    b = spark.createDataFrame([(i, 1 - y if out(i) else y) for i, _, y in rows], "doc_id long, toxic int")
    first, second = (sorted(map(tuple, toxicity.classify(docs, x).collect())) for x in (a, b))
    assert first == second


def test_awkward_rows(spark):
    df = cases.docs(spark)
    rows = labelled(60)
    docs = df.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t, _ in rows], "doc_id long, text string")).union(cases.nameless(spark).select("doc_id", "text"))
    labels = spark.createDataFrame([(10_000 + i, y) for i, _, y in rows] + [(7, None), (None, 1), (100, 5)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["doc_id"] is None for r in got) == 2 and not any(r["held_out"] for r in got if r["doc_id"] is None)


@pytest.mark.parametrize("classes", [[], [1], [0]])
def test_missing_classes_give_the_share(spark, classes):
    labels = spark.createDataFrame([(i, y) for y in classes for i in range(9)], "doc_id long, toxic int")
    got = toxicity.classify(cases.docs(spark), labels).select("score").distinct().collect()
    assert len(got) == 1 and (got[0][0] > 0.5) == (classes == [1])
    assert toxicity.classify(cases.none(spark), labels).count() == 0


def test_windows_cover_the_whole_text():
    text = "A b, c! D e é f g h"
    assert toxicity.windows(text) == [b" a b c d ", " e é f g ".encode(), b" h "]
    assert toxicity.windows("") == [] and np.isfinite(toxicity._features(np.zeros(0))).all()


def test_fitted_on_whole_texts(spark, monkeypatch):
    rows = [(i, cases.prose(random.Random(i), 8000) + " " + RUDE[0], i % 2) for i in range(12)]
    monkeypatch.setattr(toxicity, "train", lambda toxic, ordinary, rate: (toxic, ordinary))
    toxic, ordinary = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("doc_id", "text"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert toxic and ordinary and all(t.endswith(RUDE[0]) and len(t) > 16_000 for t in toxic + ordinary)


def test_the_fit_is_bounded_by_its_parameters_alone(monkeypatch):
    rng = random.Random(9)
    ordinary, trained = [cases.prose(rng, 40) for _ in range(10)], []
    monkeypatch.setattr(toxicity, "_trained", lambda samples, size, **_: trained.append(samples) or b"")
    monkeypatch.setattr(toxicity, "FIT_WINDOWS", 20)
    monkeypatch.setattr(toxicity, "SHARED_BY", 3)
    toxic = [f"{t} snozzle" if i < 3 else f"{t} grumbag" for i, t in enumerate(ordinary[:9])]
    toxicity._dictionaries(toxic, ordinary)
    assert [len(x) for x in trained[:2]] == [10, 10] and any(b"snozzle" in s for s in trained[2])
    monkeypatch.setattr(toxicity, "SHARED_BY", 2)  # four texts must share it now
    toxicity._dictionaries(toxic, ordinary)
    assert not any(b"snozzle" in s for s in trained[5]) and any(b"grumbag" in s for s in trained[5])
