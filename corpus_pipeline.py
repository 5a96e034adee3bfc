"""A corpus pipeline of five stages; each works on all rows that its predecessor kept.

A stage's decisions are small tables keyed by the row or the id, so Catalyst
broadcasts them where they are few and shuffles where they aren't; the texts
pass through otherwise untouched. Rows keep all their columns, whatever their
names: a stage's own columns take names that the input doesn't have. The input
has doc_id, text and lang at least.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontam, langid, neardup, pieces, secrets
from brindle.llm.queries import contaminated
from brindle.llm.staging import free_name, stage, table
from brindle.shipping import shipped


def _row(docs: DataFrame) -> Column:
    """128 bits that name a row by what its decision depends on; equal rows share them."""
    of = [F.col(c) for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    return F.concat(F.hex(F.xxhash64(*of)), F.lit("-"), F.hex(F.xxhash64(F.lit("row"), *of)))


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts in no known language (without any letters, say); lang becomes the identified language.

    Null and empty texts go, for they have no letters, whatever is declared. A
    null lang or source says nothing. Of languages that tie the first by name
    is taken. Repeated rows are decided alike; rows without doc_id and texts of
    any length like others; an empty table stays empty.
    """
    row, lang, gone = (free_name(docs, n) for n in ("row_key", "found_lang", "is_rejected"))
    model = langid.fit_text_model(docs)
    keyed = docs.select(_row(docs).alias("doc_id"), *(c for c in ("text", "lang", "source") if c in docs.columns))
    found = langid.identify(langid.documents_evidence(keyed), model, "doc_id")
    changes = found.filter("rejected or declared is null or lang <> declared").select(F.col("doc_id").alias(row), F.col("lang").alias(lang), F.col("rejected").alias(gone))
    changes = stage(changes.distinct(), "language-changes")
    joined = docs.withColumn(row, _row(docs)).join(changes, row, "left").filter(~F.coalesce(gone, F.lit(False)))
    return joined.select(*(F.coalesce(lang, "lang").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, that of the smallest id.

    Null and empty texts, and rows without doc_id, are in no group and stay.
    Rows that repeat the doc_id that is kept all stay. Texts of any length are
    compared whole; an empty table stays empty.
    """
    found = neardup.near_duplicates(docs)
    gone = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select("doc_id")
    # duplicates grow with the corpus, so the join is a shuffle at every size
    return docs.join(stage(gone, "duplicates").hint("merge"), "doc_id", "left_anti").select(*_own(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more is benchmark passages.

    Null and empty texts have no words and stay; so do all if the benchmark has
    no item with words. Repeated rows are decided alike; rows without doc_id and
    texts of any length like others; an empty table stays empty.
    """
    row = free_name(docs, "row_key")
    keyed = docs.withColumn(row, _row(docs))
    found = decontam.find_benchmark(keyed.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = stage(found.filter(contaminated()).select(F.col("doc_id").alias(row)).distinct(), "contaminated")
    return keyed.join(gone, row, "left_anti").select(*_own(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each secret by a mark; no document goes. n_chars, where the input has it, follows the new text.

    Spans that overlap become one mark. Null and empty texts stay as they are.
    Repeated rows change alike; rows without doc_id and texts of any length
    like others; an empty table stays empty.
    """
    row, spans, clash = (free_name(docs, n) for n in ("row_key", "found_spans", "input_spans"))
    keyed = docs.withColumn(row, _row(docs)).withColumnRenamed("spans", clash)  # the operator's own column has that name
    found = secrets.find_secrets(keyed, key=row).withColumnRenamed("spans", spans)
    new = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": secrets.redact(F.col("text"), F.col(spans))}
    if "spans" in new:
        new["spans"] = F.col(clash)
    if "n_chars" in new:
        new["n_chars"] = F.when(F.size(spans) > 0, F.length(new["text"]).cast("long")).otherwise(F.col("n_chars"))
    return found.select(*(x.alias(c) for c, x in new.items()))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every text: doc_id, n_tokens, ids, ids_sha256, round_trip; a row per row.

    Null and empty texts have no ids; texts of any length are encoded whole; a
    null doc_id stays null; an empty table stays empty.
    """
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", shipped(language)),
    ("near_duplicates", shipped(near_duplicates)),
    ("decontamination", shipped(decontamination)),
    ("secret_scan", shipped(secret_scan)),
    ("encoding", shipped(encoding)),
]

# Language models, exact near-duplicate groups and pieces are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
