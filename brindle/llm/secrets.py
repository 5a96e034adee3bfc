"""Secret scanning through a trigram inverted index, in DataFrame expressions alone.

From each rule's regular expression a Boolean query over trigrams is derived.
Postings of the trigrams that the rules ask for are intersected to candidate
documents, and only there the rule's expression runs. A rule from which no
mandatory trigram follows runs on every text.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import free_name, stage

MAX_STRINGS, MAX_CLAUSES, MAX_RULE_ENTRIES = 64, 64, 10_000


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters are secrets of this ``kind``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The kinds asked for, in their order. A run of hex digits or of
# capitals is matched whole, so its least length stands in the pattern itself.
BASE_RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Further rules, whose spans come on top of those.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
)


# -- Boolean trigram queries ---------------------------------------------------

Query = list[frozenset[str]] | None  # an OR of ANDs; None: nothing is mandatory


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _either(a: Query, b: Query) -> Query:
    return None if a is None or b is None or len(a) + len(b) > MAX_CLAUSES else a + b


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return a if b is None else b
    if len(a) * len(b) > MAX_CLAUSES:
        return min(a, b, key=len)  # the weaker query selects more, never less
    return [x | y for x, y in itertools.product(a, b)]


def _of_strings(strings: set[str]) -> Query:
    if not strings or min(map(len, strings)) < 3:
        return None
    return list(dict.fromkeys(_grams(s) for s in sorted(strings)))


def _times(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= MAX_STRINGS else None


def _literal(code: int) -> str | None:
    return chr(code).lower() if code < 128 else None


def _analyse(items) -> tuple[set[str] | None, Query]:
    """The strings that a sequence matches (None: too many), and what they all demand."""
    exact: set[str] | None = {""}
    run: set[str] = {""}
    query: Query = None
    for kind, arg in items:
        part, demand = _item(kind, arg)
        joined = None if part is None else _times(run, part)
        if joined is not None:
            run = joined
        else:
            query = _both(_both(query, _of_strings(run)), demand)
            run = part if part is not None else {""}
        if exact is not None:
            exact = None if part is None else _times(exact, part)
    return exact, _both(query, _of_strings(run))


def _item(kind, arg) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        c = _literal(arg)
        return ({c}, None) if c else (None, None)
    if kind is op.IN:
        chars: set[str] = set()
        for k, a in arg:
            codes = [a] if k is op.LITERAL else range(a[0], a[1] + 1) if k is op.RANGE else None
            if codes is None or len(codes) > MAX_STRINGS or any(c > 127 for c in codes):
                return None, None
            chars |= {chr(c).lower() for c in codes}
        return (chars, None) if len(chars) <= 4 else (None, None)
    if kind is op.SUBPATTERN:
        return _analyse(arg[-1])
    if kind is op.BRANCH:
        parts = [_analyse(x) for x in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MAX_STRINGS:
            return set().union(*(e for e, _ in parts)), None
        query: Query = []
        for _, q in parts:
            query = _either(query, q)
        return None, query
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, body = arg
        exact, query = _analyse(body)
        if (low, high) == (1, 1):
            return exact, query
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, None
        if low == 0:
            return None, None
        return None, query
    if kind is op.AT:
        return {""}, None
    return None, None


def trigram_query(pattern: str) -> Query:
    """An OR of sets of lower-case trigrams, one of which every match contains whole; None if there is none."""
    return _analyse(parser.parse(pattern))[1]


# -- index ---------------------------------------------------------------------


def build_index(docs: DataFrame, trigrams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (gram, key) of the given trigrams, staged; letters of either case count alike."""
    folded = docs.select(F.col(key).alias("key"), F.lower(text).alias("text"))
    held = F.array_compact(F.array(*(F.when(F.contains("text", F.lit(g)), F.lit(g)) for g in trigrams)))
    return stage(folded.select("key", F.explode(held).alias("gram")), "postings")


def trigrams_of(rules: tuple[Rule, ...]) -> list[str]:
    """All trigrams that the rules' queries ask for."""
    return sorted({g for r in rules for clause in trigram_query(r.pattern) or [] for g in clause})


def candidates(postings: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(key, rules): the rules of whose clauses one has all its postings in that document, staged.

    Each clause's postings are intersected as bits, which combine on the map
    side. A clause of more than 62 trigrams is asked for the first 62 alone,
    which selects more documents, never fewer, and verification decides. The
    clauses come from the rules, whose number is checked.
    """
    spark = postings.sparkSession
    entries = [(r, c, g, 1 << i, (1 << len(clause)) - 1) for r, q in queries.items() for c, clause in enumerate(q) for i, g in enumerate(sorted(clause)[:62])]
    entries = [(r, c, g, bit, min(full, (1 << 62) - 1)) for r, c, g, bit, full in entries]
    if len(entries) > MAX_RULE_ENTRIES:
        raise ValueError(f"the rules need {len(entries)} trigrams; at most {MAX_RULE_ENTRIES} are broadcast")
    clauses = spark.createDataFrame(entries, "rule int, clause int, gram string, bit long, full long")
    held = postings.join(F.broadcast(clauses), "gram").groupBy("key", "rule", "clause", "full").agg(F.bit_or("bit").alias("bits"))
    found = held.filter("bits = full").groupBy("key").agg(F.collect_set("rule").alias("rules"))
    return stage(found, "candidates")


# -- verification --------------------------------------------------------------


def _spans(text: Column, order: int, rule: Rule) -> Column:
    """All leftmost non-overlapping matches as structs (start, order, end) in code points."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule.pattern, -1)  # has one more element than there are matches; the last meets a null, which adds no span
    sizes = F.zip_with(found, gaps, lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), F.length(m).alias("value")))
    if rule.group:
        values = F.regexp_extract_all(text, pattern, F.lit(rule.group))
        sizes = F.zip_with(sizes, values, lambda s, v: F.struct(s["gap"].alias("gap"), s["n"].alias("n"), F.length(v).alias("value")))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + s["n"]).alias("end")))
        more = F.when(s["value"] >= rule.least, F.concat(acc["spans"], one)).otherwise(acc["spans"])
        return F.struct((start + s["n"]).alias("at"), more.alias("spans"))

    return F.aggregate(sizes, zero, step, lambda acc: acc["spans"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, key: str = "doc_id", text: str = "text", postings: DataFrame | None = None) -> DataFrame:
    """Add ``spans``, an array of structs (start, kind, end) sorted by start, then by the rules' order.

    kind is the rule's index. Each input row gives one row with all its
    columns; an input column named spans is replaced. A null text is as an
    empty one. Rows that share a key, or have none, are verified by their own
    text, so they get their own spans. Texts may be of any length; an empty
    table gives an empty one. ``postings`` is an index kept from ``build_index``
    over the same rows, with ``trigrams_of`` these rules at least; without it
    one is built.
    """
    plans = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    asked = {i: q for i, q in plans.items() if q}
    rows = docs.drop("spans") if "spans" in docs.columns else docs
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    body = F.coalesce(F.col(text), F.lit(""))
    if asked:
        chosen = candidates(build_index(docs, trigrams_of(rules), key, text) if postings is None else postings, asked)
        own_key, own_rules = free_name(rows, "chosen_key"), free_name(rows, "chosen_rules")
        chosen = chosen.select(F.col("key").alias(own_key), F.col("rules").alias(own_rules))
        kept = [F.col(f"`{c}`") for c in rows.columns]
        rows = rows.join(chosen, F.col(key).eqNullSafe(F.col(own_key)), "left")
        wanted = {i: F.array_contains(own_rules, F.lit(i)) for i in asked}
    else:
        kept = [F.col(f"`{c}`") for c in rows.columns]
    parts = [F.when(wanted[i] if i in asked else F.regexp_like(body, F.lit(r.pattern)), _spans(body, i, r)).otherwise(none) for i, r in enumerate(rules)]
    return rows.select(*kept, F.array_sort(F.concat(*parts)).alias("spans"))


def span_text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or each run of overlapping spans, replaced by ``mark``."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        out = F.when(s["start"] >= acc["at"], more).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    cut = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, cut).otherwise(text)
