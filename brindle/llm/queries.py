"""The registered queries of this subpackage: thin wrappers that load a table, apply an operator and derive the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, neardup, pieces, secrets, shards, substrings, topk, toxicity, warc
from .staging import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_warc(warc.mark_revisits(table(spark, sf_dir, "pages")))
    return warc.read_warc(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    none = F.lit(None).cast("int")
    return shards.shuffle_into_shards(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", none.alias("grown_shard"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), rules).select("doc_id", "spans")
    n_base = len(secrets.BASE_RULES)
    base = F.filter("spans", lambda s: s["kind"] < n_base)
    counts = {f"n_{r.kind}": F.size(F.filter("spans", _of_kind(i))).cast("long") for i, r in enumerate(secrets.BASE_RULES)}
    return found.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(secrets.span_text(base, rules), 256).alias("base_sha256"), secrets.span_text(F.col("spans"), rules).alias("spans"))


def _of_kind(i: int):
    return lambda s: s["kind"] == i


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), contaminated().alias("contaminated"))


def contaminated():
    """At least a twentieth of the words is in benchmark passages."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit_text_model(table(spark, sf_dir, "documents"))
    return langid.identify(langid.pages_evidence(table(spark, sf_dir, "pages")), model, "page_id")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_warc, op2_sharding, op3_secrets, op4_substring_dedup, op5_decontamination, op6_toxicity, op7_language_id, op8_pieces, op9_topk, op10_near_dedup)
    return {f.__name__: f for f in found}
