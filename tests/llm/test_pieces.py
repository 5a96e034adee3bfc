import itertools
import os
import random

from . import cases
import numpy as np
import pytest

from brindle.llm import pieces, queries

MODEL = pieces.default_model()


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def awkward():
    rng = random.Random(6)
    out = ["", " ", "  a  b ", "a" * 3000, "ab" * 700 + "\n\t x", "▁▁x ▁", "日本語 🙂🙂 é́", "<s> </s> <0x0A> <unk>", "\n\n\n", "the" * 200]
    return out + ["".join(rng.choice("ab thenig  er\n▁é日<0x>") for _ in range(rng.randrange(40))) for _ in range(300)] + cases.texts()


@pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the model file")
def test_ids_equal_the_library(spark):
    encoder = pieces.Encoder(pieces.Model(open(MODEL, "rb").read()))
    texts = awkward()
    first, ids = encoder.encode(texts)
    want = library().encode(texts)
    for t, a, b, w in zip(texts, first[:-1], first[1:], want, strict=True):
        assert ids[a:b].tolist() == w, t[:50]
        assert encoder.model.decode(ids[a:b]) == t.replace("▁", " ")


@pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the model file")
def test_operators(spark):
    df = cases.docs(spark)
    out = pieces.encode(df)
    rows = {r["doc_id"]: r for r in out.collect()}
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert out.count() == df.count() and all(r["round_trip"] for r in rows.values())
    lib = library()
    assert all(r["ids"] == lib.encode(texts[i] or "") and r["n_tokens"] == len(r["ids"]) for i, r in rows.items())
    back = {r["doc_id"]: r["text"] for r in pieces.decode(out).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in texts.items())
    assert pieces.encode(cases.none(spark)).count() == 0
    assert pieces.encode(cases.nameless(spark)).filter("doc_id is null").count() == 2


def test_viterbi_of_a_unigram_model():
    rng = random.Random(8)
    names = ["▁", "▁a", "b", "ab", "ba", "aab", "bb", "▁ab", "c", "a"]
    model = pieces.Model.of([("<unk>", 0.0, 2), ("<s>", 0.0, 3)] + [(n, -rng.random() * 5, 1) for n in names], pieces.UNIGRAM)
    encoder = pieces.Encoder(model)

    def best(word):
        found = []
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            b = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            parts = [word[x:y] for x, y in zip(b, b[1:], strict=False)]
            if all(p in model.scores or len(p) == 1 for p in parts):
                found.append((sum(model.scores.get(p, model.lowest) for p in parts), parts))
        return max(found)[0]

    for _ in range(200):
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 10)))
        first, ids = encoder.encode([text])
        words = encoder._stretch.findall(" " + text)
        score = sum(model.lowest if i == model.unknown else model.scores[next(n for n, j in model.ids.items() if j == i)] for i in ids.tolist())
        assert score == pytest.approx(sum(best(w.replace(" ", "▁")) for w in words))


@pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the model file")
def test_a_unigram_model_scores_as_well_as_the_library():
    """The file's pieces with other scores; the library adds them up in 32 bits, so near ties may differ, not the sums."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = pieces.UNIGRAM
    rng = random.Random(1)
    for p in proto.pieces:
        if p.type == pieces.NORMAL:
            p.score = -4 - rng.random() * 12
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = awkward()
    encoder = pieces.Encoder(pieces.Model(proto.SerializeToString()))
    first, ids = encoder.encode(texts)
    want = lib.encode(texts)
    score = lambda found: sum(proto.pieces[i].score for i in found if proto.pieces[i].type == pieces.NORMAL)
    own = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert all(score(x) == pytest.approx(score(w), rel=1e-5) for x, w in zip(own, want, strict=True))
    assert sum(x == w for x, w in zip(own, want, strict=True)) > 0.9 * len(texts)


@pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the model file")
def test_a_lost_pair_is_found_again(monkeypatch):
    monkeypatch.setattr(pieces, "PAIR_BITS", 3)
    texts = cases.texts()[:20]
    first, ids = pieces.Encoder(pieces.Model(open(MODEL, "rb").read())).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == library().encode(texts)


def test_bad_models_and_ids():
    with pytest.raises(ValueError, match="space"):
        pieces.Model.of([("a▁b", 0.0, 1)], pieces.BPE)
    model = pieces.Model.of([("<unk>", 0.0, 2), ("a", -1.0, 1)], pieces.BPE)
    with pytest.raises(ValueError, match="vocabulary"):
        model.decode(np.array([5]))


@pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the model file")
def test_the_query_returns_the_pieces(spark, tmp_path):
    cases.docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op8_pieces(spark, str(tmp_path)).collect()
    assert len(rows) == cases.docs(spark).count() and all(r["n_tokens"] == len(r["ids"]) for r in rows)
