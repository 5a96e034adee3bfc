"""Language identification by Bayesian fusion of four kinds of evidence.

The text's likelihood comes from byte trigrams. The declared markup language
and the address suffix speak through tables of how often each goes with each
language. The host's prior is smoothed by its parent domain's, and that by the
whole corpus's. All these tables, and the trigram counts of each language, are
grouped aggregations over all rows; a language that one row has is a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage
from .words import CHUNK_BYTES, text_buffers

NONE = "und"  # no known language
SLOTS_BITS = 16
TEMPER = 0.25  # trigrams overlap and repeat; their joint likelihood counts for less than their product
NOISE = 0.05  # trigrams of any text that are names, keys and the like
PARENT_WEIGHT, HOST_WEIGHT, TABLE_WEIGHT = 20.0, 10.0, 1.0
HELD = 64  # languages whose counts a task holds before it passes them on
TABLE_BYTES = 1 << 27  # of a model at most; beyond 511 languages each has half as many slots, and so on


class TextModel:
    """Log-likelihoods of hashed byte trigrams for each language; ``und`` has them all alike."""

    def __init__(self, languages: list[str], table: np.ndarray) -> None:
        self.languages, self.table = languages, table
        self.shift = SLOTS_BITS - (table.shape[1].bit_length() - 1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trigrams that hold a letter, tempered log-likelihood by language) of each text."""
        slot, start = _slots(data)
        slot >>= self.shift
        first = np.searchsorted(start, offsets[:-1])
        last = np.maximum(np.searchsorted(start, offsets[1:] - 2), first)  # a trigram ends inside its text
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for j in range(len(self.languages)):
            total = np.concatenate(([0.0], np.cumsum(self.table[j][slot], dtype=np.float64)))
            out[:, j] = total[last] - total[first]
        return last - first, out * TEMPER


def _slots(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams that hold a letter (ASCII or beyond), in lower case, all else as a blank; and their places."""
    fold = np.full(256, 0x20, dtype=np.uint32)
    fold[0x61:0x7B] = np.arange(0x61, 0x7B)
    fold[0x41:0x5B] = np.arange(0x61, 0x7B)
    fold[0x80:] = np.arange(0x80, 0x100)
    b = fold[data]
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    start = np.flatnonzero((key != 0x202020) & ~((b[:-2] == 0x20) & (b[1:-1] == 0x20)))
    return ((key[start] * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS_BITS)).astype(np.int64), start


def fit_text_model(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int | None = None) -> TextModel:
    """Fit on all different labelled texts, each whole, or on ``rows`` of each language, those first by hash.

    Executors count the trigrams; at most 65,536 counts a language come to the
    driver, whatever the number of rows. The table has ``TABLE_BYTES`` at most:
    the more languages there are, the fewer slots has each, and none is left
    out. Null and empty texts and labels teach nothing; repeated rows count
    once. With no labelled row at all the only language is ``und``.
    """
    good = labelled.filter(F.col(lang).isNotNull() & (F.col(lang) != "") & F.col(text).isNotNull())
    slim = good.select(F.lower(F.col(lang)).alias("lang"), F.col(text).alias("text"))
    different = slim.withColumn("__hash", F.xxhash64("text", "lang")).dropDuplicates(["__hash"])
    if rows is not None:
        place = F.row_number().over(Window.partitionBy("lang").orderBy("__hash"))
        different = different.withColumn("__place", place).filter(F.col("__place") <= rows)
    counted = different.select("lang", "text").mapInArrow(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names, slots, n = counted.column("lang").combine_chunks().dictionary_encode(), counted.column("slot").to_numpy(), counted.column("n").to_numpy()
    codes = names.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else []
    by = dict(zip(names.dictionary.to_pylist(), parts, strict=True))
    languages = sorted(by)
    width = 1 << min(SLOTS_BITS, (TABLE_BYTES // 4 // (len(languages) + 1)).bit_length() - 1)
    table = np.full((len(languages) + 1, width), -np.log(width), dtype=np.float32)
    for j, name in enumerate(languages):
        counts = np.bincount(slots[by[name]] >> (SLOTS_BITS - (width.bit_length() - 1)), weights=n[by[name]], minlength=width)
        own = (counts + 0.01) / (counts.sum() + 0.01 * len(counts))
        table[j] = np.log((1 - NOISE) * own + NOISE / len(counts))
    return TextModel([*languages, NONE], table)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n) of rows (lang, text); a pair may come more than once."""
    held: dict[str, np.ndarray] = {}

    def passed() -> Iterator[pa.RecordBatch]:
        for name, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], names=["lang", "slot", "n"])
        held.clear()

    for batch in batches:
        names = batch.column(0).dictionary_encode()
        codes, names = names.indices.to_numpy(zero_copy_only=False), names.dictionary.to_pylist()
        raw, offsets = text_buffers(batch.column(1))
        at = 0
        while at < batch.num_rows:
            to = min(max(int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1, at + 1), batch.num_rows)
            part = offsets[at : to + 1] - offsets[at]
            slot, start = _slots(raw[offsets[at] : offsets[to]])
            row = np.searchsorted(part, start, side="right") - 1
            inside = start + 2 < part[row + 1]  # a trigram ends inside its text
            slot, code = slot[inside], codes[at:to][row[inside]]
            order = np.argsort(code, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                if len(mine):
                    name = names[code[mine[0]]]
                    if name not in held:
                        if len(held) >= HELD:
                            yield from passed()
                        held[name] = np.zeros(1 << SLOTS_BITS, np.int64)
                    held[name] += np.bincount(slot[mine], minlength=1 << SLOTS_BITS)
            at = to
    yield from passed()


def host_of(url: Column) -> Column:
    """The lower-case host of an address; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def parent_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    """The last label of a host that has more than one."""
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def declared_of(html: Column) -> Column:
    """The primary subtag of the html element's lang attribute, lower case; null if there is none."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,8})", 1))
    return F.when(found != "", found)


def visible_text(html: Column) -> Column:
    """The text of a page without its scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&[A-Za-z0-9#]+;", " ")


def identify(rows: DataFrame, model: TextModel, key: str) -> DataFrame:
    """Posterior of each row of (key, text, declared, host, parent, suffix), nulls allowed in all.

    Adds to the key: lang, confidence, rejected, text_lang, n_trigrams. A row is
    rejected (lang ``und``) if its text has no trigram with a letter, whatever
    is declared, or if its evidence fits no known language better than chance
    and the model knows what is declared, or nothing is. If it doesn't know a
    declared language, which then can't be told from chance, that stays, with
    the confidence that it is no known one; a model without languages rejects all.
    A null declaration, suffix or host says nothing; unseen ones say little, by
    smoothing. Ties go to the first language by name. Repeated rows count each;
    a row's own text doesn't speak twice, for its host's counts leave it out.
    Texts of any length are read whole; an empty table gives an empty one. The
    key may have any type and needn't be unique.
    """
    spark = rows.sparkSession
    languages, sent = model.languages, spark.sparkContext.broadcast(model)
    n = len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            at = 0
            while at < batch.num_rows:
                to = min(max(int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1, at + 1), batch.num_rows)
                part = offsets[at : to + 1]
                grams, ll = sent.value.score(raw[part[0] : part[-1]], part - part[0])
                best = np.where(grams > 0, np.argmax(ll, axis=1), n - 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1, dtype=np.int32) * n), pa.array(ll.ravel()))
                own = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([own.column(0), *(own.column(i) for i in range(2, 6)), pa.array(grams, pa.int64()), pa.array(best, pa.int32()), lists], names=[key, "declared", "host", "parent", "suffix", "n_trigrams", "best", "ll"])
                at = to

    kind = rows.schema[key].dataType.simpleString()
    columns = [F.col(f"`{key}`"), "text", *(F.col(c).cast("string").alias(c) for c in ("declared", "host", "parent", "suffix"))]
    schema = f"`{key}` {kind}, declared string, host string, parent string, suffix string, n_trigrams long, best int, ll array<double>"
    scored = stage(rows.select(*columns).mapInArrow(run, schema), "text-evidence")

    def counts(by: str) -> DataFrame:
        """For each value of a column the rows of each language, and their sum; combines on the map side."""
        sums = [F.count(F.when((F.col("best") == j) & (F.col("n_trigrams") > 0), 1)) for j in range(n)]
        return stage(scored.filter(F.col(by).isNotNull()).groupBy(by).agg(F.array(*sums).alias(f"{by}_n")), f"{by}-counts")

    everywhere = scored.filter("n_trigrams > 0").groupBy("best").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    of = {r["best"]: r["n"] for r in everywhere}
    total = sum(of.values())
    overall = [(of.get(j, 0) + 1.0) / (total + n) for j in range(n)]
    out, zeros = scored, F.array_repeat(F.lit(0).cast("long"), n)
    tables = ("host", "parent", "declared", "suffix")
    for by in tables:
        out = out.join(counts(by), by, "left")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everyone = np.array(overall)
        for batch in batches:
            grams, best = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            post = _flat(batch.column(5), n)
            own = np.zeros(post.shape)
            own[np.flatnonzero(grams > 0), best[grams > 0]] = 1
            host, parent, declared, suffix = (np.maximum(0, _flat(batch.column(6 + i), n) - own) for i in range(4))
            prior = (parent + PARENT_WEIGHT * everyone) / (parent.sum(1, keepdims=True) + PARENT_WEIGHT)
            post = post + np.log((host + HOST_WEIGHT * prior) / (host.sum(1, keepdims=True) + HOST_WEIGHT))
            for column, seen in ((1, declared), (10, suffix)):  # log P(value | language), up to a constant, where there is a value
                told = np.log((seen + TABLE_WEIGHT * everyone) / (seen.sum(1, keepdims=True) + TABLE_WEIGHT) / everyone)
                post = post + told * batch.column(column).is_valid().to_numpy(zero_copy_only=False)[:, None]
            which = np.where(grams > 0, np.argmax(post, axis=1), n - 1)
            share = np.where(grams > 0, 1 / np.exp(post - post.max(1, keepdims=True)).sum(1), 0.0)
            names = np.array(languages, dtype=object)
            lang, rejected = names[which], which == n - 1
            if n > 1:
                stated = batch.column(1).to_pylist()
                for i in np.flatnonzero(rejected & (grams > 0)).tolist():
                    if stated[i] and stated[i] not in known:
                        lang[i], rejected[i] = stated[i], False
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(share), pa.array(rejected), pa.array(names[best], pa.string()), *(batch.column(i) for i in (1, 2, 3))], names=[key, "lang", "confidence", "rejected", "text_lang", "declared", "host", "n_trigrams"])

    known = set(languages)
    fused = out.select(key, "declared", "host", "n_trigrams", "best", "ll", *(F.coalesce(f"{by}_n", zeros) for by in tables), "suffix")
    return fused.mapInArrow(fuse, f"`{key}` {kind}, lang string, confidence double, rejected boolean, text_lang string, declared string, host string, n_trigrams long")


def _flat(lists: pa.Array, n: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)


def pages_evidence(pages: DataFrame) -> DataFrame:
    """The evidence rows of web pages (page_id, url, html)."""
    host = host_of(F.col("url"))
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", visible_text(html).alias("text"), declared_of(html).alias("declared"), host.alias("host"), parent_of(host).alias("parent"), suffix_of(host).alias("suffix"))


def documents_evidence(docs: DataFrame) -> DataFrame:
    """The evidence rows of documents: lang is what is declared, source stands for the host."""
    none = F.lit(None).cast("string")
    declared, host = (F.col(c) if c in docs.columns else none for c in ("lang", "source"))
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.lower(declared).alias("declared"), host.alias("host"), none.alias("parent"), none.alias("suffix"))
