import random

from . import cases
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import langid

WORDS = {"en": "the and of that with this from have".split(), "de": "der und die nicht mit sich auch für".split(), "fr": "le les des que une dans être où".split()}


def text(rng, lang, n=40):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(text(rng, x), x) for x in WORDS for _ in range(30)]
    return langid.fit_text_model(spark.createDataFrame(rows, "text string, lang string"))


EVIDENCE = "id long, text string, declared string, host string, parent string, suffix string, lang string, best int"


def run(spark, model, rows):
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], EVIDENCE)
    return {r["id"]: r for r in langid.identify(df, model, "id").collect()}


def test_text_decides_where_it_is_long(spark, model):
    rng = random.Random(2)
    rows = [(i, text(rng, x), "en", "h", "h", "com") for i, x in enumerate(["en", "de", "fr"])]
    got = run(spark, model, rows)
    assert [got[i]["lang"] for i in range(3)] == ["en", "de", "fr"] and not any(r["rejected"] for r in got.values())


def test_host_and_declaration_decide_where_it_is_short(spark, model):
    rng = random.Random(3)
    rows = [(i, text(rng, "de"), "de", "de.site", "site", "site") for i in range(60)] + [(100 + i, text(rng, "fr"), "fr", "fr.site", "site", "site") for i in range(60)]
    rows += [(500, "xyzq", None, "de.site", "site", "site"), (501, "xyzq", None, "fr.site", "site", "site"), (502, "xyzq", "fr", None, None, None), (503, "xyzq", "de", None, None, None)]
    got = run(spark, model, rows)
    assert [got[i]["lang"] for i in range(500, 504)] == ["de", "fr", "fr", "de"]


def test_rejection(spark, model):
    rng = random.Random(4)
    junk = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400))
    rows = [(1, None, "en", "h", None, None), (2, "", "en", None, None, None), (3, "12 345 %%% --", "en", "h", None, None), (4, junk, None, None, None, None), (5, text(rng, "en"), None, None, None, None), (None, text(rng, "en"), None, None, None, None), (6, text(rng, "en", 9000), "zz", None, None, None)]
    got = run(spark, model, rows)
    assert {i for i, r in got.items() if r["rejected"]} == {1, 2, 3, 4}
    assert got[None]["lang"] == got[5]["lang"] == got[6]["lang"] == "en" and got[1]["lang"] == "und" and got[1]["confidence"] == 0.0


def test_smoothing_by_hand(spark):
    table = np.zeros((3, 1 << langid.SLOTS_BITS), np.float32)
    flat = langid.TextModel(["a", "b", "und"], table)  # every text says nothing, so the first language wins all
    rows = [(i, "xyz", None, "h", "p", None) for i in range(4)]
    got = run(spark, flat, rows)
    overall = [(4 + 1) / 7, 1 / 7, 1 / 7]
    parent = [(3 + 20 * overall[0]) / 23, 20 * overall[1] / 23, 20 * overall[2] / 23]
    host = [(3 + 10 * parent[0]) / 13, 10 * parent[1] / 13, 10 * parent[2] / 13]
    assert got[0]["lang"] == "a" and got[0]["confidence"] == pytest.approx(host[0] / sum(host))


def test_evidence_of_pages(spark):
    df = spark.createDataFrame([(1, "https://User@WWW.Example.co.UK:80/x?y", '<!DOCTYPE html>\n<HTML class=x LANG="en-GB"><script>var a="</p>";</script><style>b</style><p>Hi &amp; <!-- no -->you'), (2, None, None), (3, "nonsense", "<html><body lang='de'>x")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in langid.pages_evidence(df).collect()}
    assert (got[1]["declared"], got[1]["host"], got[1]["parent"], got[1]["suffix"]) == ("en", "www.example.co.uk", "co.uk", "uk")
    assert got[1]["text"].split() == ["Hi", "you"]
    assert (got[2]["declared"], got[2]["host"], got[2]["text"]) == (None, None, "") and got[3]["declared"] is None and got[3]["host"] is None


def test_held_out_accuracy(spark):
    """Trained on documents, right on nearly all pages' declared languages, with the declaration hidden."""
    sf = "/root/testdata/sf0.01"
    model = langid.fit_text_model(spark.read.parquet(f"{sf}/documents.parquet"), rows=300)
    evidence = langid.pages_evidence(spark.read.parquet(f"{sf}/pages.parquet"))
    truth = evidence.select("page_id", F.col("declared").alias("truth"))
    got = langid.identify(evidence.withColumn("declared", F.lit(None).cast("string")), model, "page_id").join(truth, "page_id")
    assert got.filter("lang = truth").count() >= 0.95 * got.count()
    assert duckdb.execute(f"SELECT count(*) FROM '{sf}/pages.parquet'").fetchall()[0][0] == got.count()


def test_nothing_labelled(spark):
    empty = cases.none(spark)
    model = langid.fit_text_model(empty)
    assert model.languages == ["und"]
    assert langid.identify(langid.documents_evidence(empty), model, "doc_id").count() == 0
    assert langid.identify(langid.documents_evidence(cases.docs(spark)), model, "doc_id").filter("not rejected").count() == 0


def test_a_rare_language_is_known(spark):
    """One row among thousands is enough for its language, whatever its hash."""
    rng = random.Random(5)
    rows = [(i, text(rng, "en", 12), "en", "s") for i in range(4000)]
    rare = [(4000 + i, f"საქართველო არის ქვეყანა {w} მდებარეობს კავკასიაში და აღმოსავლეთ ევროპაში", f"x{i}", "s") for i, w in enumerate(["ერთი", "ორი", "სამი", "ოთხი", "ხუთი", "ექვსი"])]
    df = spark.createDataFrame(rows + rare, "doc_id long, text string, lang string, source string").repartition(3)
    model = langid.fit_text_model(df)
    assert model.languages == ["en", *(f"x{i}" for i in range(6)), "und"]
    got = {r["doc_id"]: r for r in langid.identify(langid.documents_evidence(df), model, "doc_id").collect()}
    assert not any(got[r[0]]["rejected"] for r in rows + rare)
    assert langid.fit_text_model(df, rows=1).languages == model.languages


def test_copies_count_once(spark):
    rng = random.Random(6)
    rows = [(text(rng, "de"), "de"), (text(rng, "en"), "en"), (text(rng, "en"), "en")]
    once, often = (langid.fit_text_model(spark.createDataFrame(x, "text string, lang string")) for x in (rows, rows + rows[:2] * 50))
    assert (once.table == often.table).all()


def test_an_unknown_declared_language_is_no_ground_for_rejection(spark, model):
    foreign = "საქართველო არის ქვეყანა მდებარეობს კავკასიაში " * 8
    got = run(spark, model, [(1, foreign, "ka", "h", None, None), (2, foreign, None, "h", None, None), (3, foreign, "", "h", None, None), (4, "123", "ka", "h", None, None)])
    assert (got[1]["lang"], got[1]["rejected"], got[1]["text_lang"]) == ("ka", False, "und")
    assert all(got[i]["rejected"] and got[i]["lang"] == "und" for i in (2, 3, 4))


def test_whole_texts_are_counted(spark):
    """What a text says late, and what the five thousandth says, is learned as well."""
    rng = random.Random(7)
    rows = [(text(rng, "en", 2000) + " zvqx" * 2000, "en")] + [(f"{text(rng, 'de', 5)} {i}", "de") for i in range(5000)]
    got = langid.fit_text_model(spark.createDataFrame(rows, "text string, lang string"))
    late = langid._slots(np.frombuffer(b"zvqx", np.uint8))[0]
    assert (got.table[got.languages.index("en")][late] > np.log(0.05)).all()


def whole_rows(model, rows):
    """The posterior of every row by the formulas alone: (lang, confidence, rejected, text_lang, n_trigrams)."""
    names, n = model.languages, len(model.languages)
    grams, ll = zip(*(model.score(b, np.array([0, len(b)])) for b in (np.frombuffer((r[1] or "").encode(), np.uint8) for r in rows)), strict=True)
    best = [int(np.argmax(x[0])) if g[0] else n - 1 for g, x in zip(grams, ll, strict=True)]
    spoken = [bool(g[0]) for g in grams]
    every = np.array([sum(s and b == j for s, b in zip(spoken, best, strict=True)) + 1.0 for j in range(n)])
    every /= sum(spoken) + n
    out = []
    for i, (_, _, declared, host, parent, suffix) in enumerate(rows):
        def seen(at, value, i=i):
            own = np.zeros(n)
            for j, other in enumerate(rows):
                if value is not None and j != i and spoken[j] and other[at] == value:
                    own[best[j]] += 1
            return own

        post = ll[i][0].copy()
        prior = (seen(4, parent) + 20 * every) / (seen(4, parent).sum() + 20)
        post += np.log((seen(3, host) + 10 * prior) / (seen(3, host).sum() + 10))
        for at, value in ((2, declared), (5, suffix)):
            if value is not None:
                post += np.log((seen(at, value) + every) / (seen(at, value).sum() + 1) / every)
        which = int(np.argmax(post)) if spoken[i] else n - 1
        share = float(1 / np.exp(post - post.max()).sum()) if spoken[i] else 0.0
        stays = which == n - 1 and spoken[i] and bool(declared) and declared not in names
        out.append((declared if stays else names[which], share, which == n - 1 and not stays, names[best[i]], int(grams[i][0])))
    return out


def test_whole_rows_match_the_formulas(spark, model):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        x = rng.choice(["en", "de", "fr"])
        host = rng.choice([None, f"{x}.one", "all.one", "b.two"])
        body = rng.choice([text(rng, x, rng.randrange(1, 30)), "xq zw", "", "12", None, "\u4e00\u8d77" * rng.randrange(1, 9)])
        rows.append((i, body, rng.choice([x, "en", None, "zz", ""]), host, host and host[-3:], host and rng.choice(["one", "two", None])))
    got = run(spark, model, rows)
    for r, want in zip(rows, whole_rows(model, rows), strict=True):
        g = got[r[0]]
        assert (g["lang"], g["rejected"], g["text_lang"], g["n_trigrams"]) == (want[0], *want[2:]), r
        assert g["confidence"] == pytest.approx(want[1], rel=1e-4, abs=1e-9)


def test_many_languages(spark, monkeypatch):
    """Sixty languages take no longer plan than three; beyond the table's bound each has fewer slots, and all are known."""
    rng = random.Random(10)
    words = {f"x{i:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(30)] for i in range(60)}
    rows = [(60 * j + i, " ".join(rng.choice(w) for _ in range(60)), x, "s") for i, (x, w) in enumerate(words.items()) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for bound, width in ((1 << 27, 1 << 16), (61 * 4 << 12, 1 << 12)):
        monkeypatch.setattr(langid, "TABLE_BYTES", bound)
        model = langid.fit_text_model(df)
        assert model.table.shape == (61, width)
        out = langid.identify(langid.documents_evidence(df), model, "doc_id")
        assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
        assert {r["doc_id"]: r["lang"] for r in out.collect()} == {r[0]: r[2] for r in rows}
