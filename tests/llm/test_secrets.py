import hashlib
import re

from . import cases

from brindle.llm import queries, secrets

BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 0),
    ("github", re.compile(r"gh[oprsu]_[A-Za-z0-9]{36,}"), 0, 0),
)


def brute(text):
    spans = [(m.start(), k, m.end()) for k, (_, r, g, least) in enumerate(BASE) for m in r.finditer(text or "") if len(m[g]) >= least]
    return sorted(spans)


def test_spans_match_brute_force(spark):
    df = cases.docs(spark)
    found = secrets.find_secrets(df)
    assert set(found.columns) == set(df.columns)  # its own spans replace the clashing column
    for r in found.collect():
        assert [tuple(s) for s in r["spans"]] == brute(r["text"])
    assert found.count() == df.count()


def test_query_columns(spark, tmp_path):
    cases.docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op3_secrets(spark, str(tmp_path))
    by = {r["doc_id"]: r for r in out.collect()}
    for r in cases.docs(spark).collect():
        spans = brute(r["text"])
        say = lambda ss: ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in ss)
        got = by[r["doc_id"]]
        assert got["spans"] == say(spans)
        assert got["base_sha256"] == hashlib.sha256(say([s for s in spans if s[1] < 3]).encode()).hexdigest()
        assert [got["n_assign"], got["n_access"], got["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]


def test_no_python_in_the_plan(spark):
    plan = secrets.find_secrets(cases.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_kept_index(spark):
    df = cases.docs(spark)
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    kept = secrets.build_index(df, secrets.trigrams_of(rules) + ["zzz"])
    show = lambda found: sorted(((r["doc_id"], r["text"], tuple(map(tuple, r["spans"]))) for r in found.collect()), key=repr)
    assert show(secrets.find_secrets(df, rules, postings=kept)) == show(secrets.find_secrets(df, rules))
    assert show(secrets.find_secrets(df, rules[:2], postings=kept)) == show(secrets.find_secrets(df, rules[:2]))


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é token=abcdef0123456789abcdef0123 tail"), (2, "clean"), (3, None)], "doc_id long, text string")
    found = secrets.find_secrets(df)
    got = {r["doc_id"]: r["t"] for r in found.select("doc_id", secrets.redact(found["text"], found["spans"]).alias("t")).collect()}
    assert got == {1: "é [SECRET] tail", 2: "clean", 3: None}


def test_empty_and_nameless(spark):
    assert secrets.find_secrets(cases.none(spark)).count() == 0
    df = spark.createDataFrame([(None, "secret=abcdefgh"), (None, "nothing"), (5, "x secret=abcdefgh"), (5, "y")], "doc_id long, text string")
    assert sorted(len(r["spans"]) for r in secrets.find_secrets(df).collect()) == [0, 0, 1, 1]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token={i:06d}" for i in range(2000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(s) for s in secrets.find_secrets(df).first()["spans"]] == brute(text)


def test_trigram_queries():
    q = secrets.trigram_query
    assert q(r"[0-9a-f]{24,}") is None and q("ab") is None and q("a.c") is None
    assert q("AKIA[A-Z0-9]{16,}") == [frozenset({"aki", "kia"})]
    assert q("(foo|bars)x*") == [frozenset({"bar", "ars"}), frozenset({"foo"})] or set(q("(foo|bars)x*")) == {frozenset({"foo"}), frozenset({"bar", "ars"})}
    assert set(q("ab_?cd")) == {frozenset({"abc", "bcd"}), frozenset({"ab_", "b_c", "_cd"})}
    for rule in secrets.BASE_RULES + secrets.MORE_RULES:
        for t in cases.texts():
            query = q(rule.pattern)
            if query and re.search(rule.pattern, t):
                low = t.lower()
                assert any(all(g in low for g in clause) for clause in query)
