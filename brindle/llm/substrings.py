"""Long passages that repeat across documents, found on a compacted de Bruijn graph.

Edges are all runs of ``window`` words. Each edge belongs to the node of its
least-hashed inner k-mer (its minimizer), so the consecutive edges around one
k-mer form a path, and a repeated edge always lies on paths of the same node.
Nodes that occur in one document alone are dropped.

A node whose paths are all alike doesn't branch. Two such nodes of which the
one is always followed by the other, and the other always preceded by it, are
compacted, by joins that double the length reached each time; what is left are
the heads of the longest nonbranching paths. Of branching nodes each distinct
path is cut into its edges at its source coordinates, and edges are joined with
the least place that holds them.

Either way a repeat is a span of a row and the coordinates of its source. Both
are read again when words are removed, and the SHA-256 of their words must
agree; should hashes ever have confused two spans, all is done again with
others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage
from .words import U64, Words, chunks, mix, span

PATHS = "doc_id long, text_key long, start int, n int, node long, path long"
EDGES = "node long, path long, at int, edge long, doc_id long, text_key long, pos int"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
CHECKS = "array<struct<start:int,n:int,s_doc:long,s_key:long,s_start:int,digest:binary>>"
ROW = ["doc_id", "text_key"]  # rows that share an id are told apart by their texts
ATTEMPTS = 5


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """For each i the place of the first least of values[i:i+w]; shorter by w-1."""
    at, size = np.arange(len(values), dtype=np.int64), 1
    while size < w:
        step = min(size, w - size)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        size += step
    return at


def _paths(w: Words, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, start in the text, number of edges, node, path hash) of all paths."""
    empty = np.zeros(0, np.int64)
    if len(w.hash) < window:
        return empty, empty, empty, empty, empty
    sums, text, first = w.sums(), w.texts(), w.first
    begin = np.arange(len(w.hash) - k + 1)
    kmers = span(sums, begin, begin + k)
    edges = len(w.hash) - window + 1
    least = _least(kmers, window - k + 1)
    valid = text[:edges] == text[window - 1 :]
    fresh = np.ones(edges, dtype=bool)
    fresh[1:] = (least[1:] != least[:-1]) | (text[1:edges] != text[: edges - 1])
    start = np.flatnonzero(valid & (fresh | ~np.concatenate(([False], valid[:-1]))))
    if not len(start):
        return empty, empty, empty, empty, empty
    group = np.cumsum(fresh)[:edges]
    good = np.flatnonzero(valid)
    _, counts = np.unique(group[good], return_counts=True)
    node = least[start]
    whole = span(sums, start, start + counts + window - 1)
    path = mix(whole + (node - start).astype(U64) * U64(0x632BE59BD9B4E019))
    return text[start], start - first[text[start]], counts, kmers[node].view(np.int64), path.view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def _runs(held: Column) -> Column:
    """Edges (at, src) in order, with those joined that follow each other here and at their source: (at, n, src)."""
    none = F.expr("cast(array() as array<struct<at:int,n:int,src:struct<doc_id:bigint,text_key:bigint,pos:int>>>)")

    def step(acc: Column, e: Column) -> Column:
        last, src = F.element_at(acc, -1), e["src"]
        follows = (last["at"] + last["n"] == e["at"]) & (last["src"]["pos"] + last["n"] == src["pos"]) & (last["src"]["doc_id"] == src["doc_id"]) & (last["src"]["text_key"] == src["text_key"])
        more = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["at"].alias("at"), (last["n"] + 1).alias("n"), last["src"].alias("src"))))
        new = F.concat(acc, F.array(F.struct(e["at"].alias("at"), F.lit(1).alias("n"), src.alias("src"))))
        return F.when(F.size(acc) == 0, new).when(follows, more).otherwise(new)

    return F.aggregate(F.sort_array(held), none, step)


def _compacted(plain: DataFrame) -> DataFrame:
    """(node, n, source): the heads of the longest nonbranching paths, their edges in all, and the least place of theirs."""
    along = Window.partitionBy(*ROW).orderBy("start")
    placed = plain.repartition(*ROW).dropDuplicates([*ROW, "start"])  # repeated rows count once
    after = F.when(F.lead("start").over(along) == F.col("start") + F.col("n"), F.lead("node").over(along))
    before = F.when(F.lag("start").over(along) + F.lag("n").over(along) == F.col("start"), F.lag("node").over(along))

    def always(c: str) -> Column:
        return F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c)).alias(c)

    seen = placed.withColumns({"after": after, "before": before}).groupBy("node")
    vertices = stage(seen.agg(F.first("n").cast("long").alias("n"), F.min(F.struct(*ROW, "start")).alias("source"), always("after"), always("before")), "vertices")
    forth = vertices.filter("after is not null").select("node", F.col("after").alias("to"))
    back = vertices.filter("before is not null").select(F.col("before").alias("node"), F.col("node").alias("to"))
    links = stage(forth.join(back, ["node", "to"], "left_semi"), "links")
    reach = stage(vertices.select("node", "n").join(links, "node", "left"), "reach")
    # a path ends with its last document, so no link leads back; each round doubles what is reached
    while reach.filter("to is not null").limit(1).count():
        ahead = reach.select(F.col("node").alias("to"), F.col("n").alias("more"), F.col("to").alias("further"))
        reach = stage(reach.join(ahead, "to", "left").select("node", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.col("further").alias("to")), "reach")
    heads = vertices.select("node", "source").join(links.select(F.col("to").alias("node")), "node", "left_anti")
    return stage(heads.join(reach.select("node", "n"), "node"), "heads")


def repeated_spans(docs: DataFrame, window: int = 50, k: int = 12, seed: int = 0, bits: int = 64) -> DataFrame:
    """(doc_id, text_key, start, n, s_doc, s_key, s_start), staged: n consecutive windows that start in a row, and their source in a row of a smaller id.

    text_key is the xxhash64 of the row's text. Null ids, null texts and texts
    of fewer words have none. Spans are found by hashes; ``remove_repeats``
    compares their words.
    """
    if not 0 < k <= window:
        raise ValueError("k must be at most the window")
    texts = _texts(docs).filter("doc_id is not null and text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for a, b, w in chunks(batch.column(2), "blank", False, seed, bits):
                text, start, n, node, path = _paths(w, window, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][text]), pa.array(keys[a:b][text]), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(node), pa.array(path)], names=["doc_id", "text_key", "start", "n", "node", "path"])

    paths = stage(texts.mapInArrow(cut, PATHS), "paths")
    nodes = paths.groupBy("node").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("path").alias("p0"), F.max("path").alias("p1"))
    # staged sums have no partitioning that a join would have to keep, so AQE can split a hot node
    nodes = stage(nodes.filter("low < high").select("node", (F.col("p0") != F.col("p1")).alias("branches")), "nodes")
    shared = stage(paths.join(nodes, "node"), "shared-paths")

    plain = shared.filter("not branches")
    whole = plain.select(*ROW, "start", "node").join(_compacted(plain), "node").filter("doc_id > source.doc_id")
    whole = whole.select(*ROW, "start", F.col("n").cast("int").alias("n"), F.col("source.doc_id").alias("s_doc"), F.col("source.text_key").alias("s_key"), F.col("source.start").alias("s_start"))

    branching = shared.filter("branches")
    classes = stage(branching.groupBy("node", "path").agg(F.min(F.struct(*ROW, "start", "n")).alias("source")), "path-classes")
    wanted = classes.groupBy(F.col("source.doc_id").alias("doc_id"), F.col("source.text_key").alias("text_key")).agg(F.collect_list(F.struct(F.col("source.start").alias("start"), F.col("source.n").alias("n"), "node", "path")).alias("wanted"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            lists = batch.column(3)
            flat, offs = lists.flatten(), np.asarray(lists.offsets)
            offs = offs - offs[0]
            starts, sizes, nodes_, paths_ = (np.asarray(flat.field(i)) for i in range(4))
            for a, b, w in chunks(batch.column(2), "blank", False, seed, bits):
                i = np.arange(offs[a], offs[b])
                t = np.repeat(np.arange(b - a), np.diff(offs[a : b + 1]))
                count = sizes[i].astype(np.int64)
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                own, t = np.repeat(i, count), np.repeat(t, count)
                pos = starts[own] + nth
                begin = w.first[t] + pos
                edge = span(w.sums(), begin, begin + window).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes_[own]), pa.array(paths_[own]), pa.array(nth, pa.int32()), pa.array(edge), pa.array(ids[a + t]), pa.array(keys[a + t]), pa.array(pos, pa.int32())], names=["node", "path", "at", "edge", "doc_id", "text_key", "pos"])

    edges = stage(texts.join(wanted, ROW).select(*ROW, "text", "wanted").mapInArrow(read, EDGES), "edges")
    least = edges.groupBy("node", "edge").agg(F.min(F.struct(*ROW, "pos")).alias("src"))
    runs = edges.select("node", "path", "at", "edge").join(least, ["node", "edge"]).groupBy("node", "path").agg(F.collect_set(F.struct("at", "src")).alias("held"))
    runs = stage(runs.select("node", "path", _runs(F.col("held")).alias("runs")), "runs")
    parts = branching.join(runs, ["node", "path"]).select(*ROW, "start", F.explode(F.filter("runs", lambda r: r["src"]["doc_id"] < F.col("doc_id"))).alias("r"))
    parts = parts.select(*ROW, (F.col("start") + F.col("r.at")).alias("start"), F.col("r.n").alias("n"), F.col("r.src.doc_id").alias("s_doc"), F.col("r.src.text_key").alias("s_key"), F.col("r.src.pos").alias("s_start"))
    return stage(whole.union(parts), "spans")


def remove_repeats(docs: DataFrame, window: int = 50, k: int = 12, with_text: bool = False, bits: int = 64) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept_sha256, and kept text on demand.

    Words are runs of characters other than \\x20 and \\x09-\\x0D. A word goes if
    a window that covers it also starts in a document of a smaller id; windows
    are judged on the input. Rows that repeat a doc_id are rows of the same
    document, each judged by its own text. Rows without doc_id keep all words
    and remove none elsewhere; a null text has no words; an empty table gives
    an empty one. A first attempt keeps ``bits`` of the words' hashes.
    """
    for seed in range(ATTEMPTS):
        done = _applied(docs, repeated_spans(docs, window, k, seed, bits if seed == 0 else 64), window, with_text)
        told = done.select(*ROW, F.explode("checks").alias("c")).select(*ROW, "c.*")
        sources = told.filter("s_doc is null").select(F.col("doc_id").alias("s_doc"), F.col("text_key").alias("s_key"), F.col("start").alias("s_start"), "n", F.col("digest").alias("s_digest"))
        apart = told.filter("s_doc is not null").join(sources, ["s_doc", "s_key", "s_start", "n"], "left").filter("s_digest is null or s_digest <> digest")
        if not apart.limit(1).count():
            return done.drop("checks", "text_key")
    raise RuntimeError("hashes confused spans at every attempt")


def _applied(docs: DataFrame, spans: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Remove the words that the spans cover; ``checks`` has the digests of the words of all spans and sources that a row holds."""
    none = F.lit(None)
    sources = spans.select(F.col("s_doc").alias("doc_id"), F.col("s_key").alias("text_key"), F.col("s_start").alias("start"), "n", none.cast("long").alias("s_doc"), none.cast("long").alias("s_key"), none.cast("int").alias("s_start")).distinct()
    coords = spans.union(sources).groupBy(*ROW).agg(F.collect_set(F.struct("start", "n", "s_doc", "s_key", "s_start")).alias("coords"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept_texts, digests = [], [], []
            lists = batch.column(3).fill_null([])
            flat, offs = lists.flatten(), np.asarray(lists.offsets).tolist()
            starts, sizes = (np.asarray(flat.field(i)).astype(np.int64) for i in range(2))
            marks = flat.field(2).is_valid().to_numpy(zero_copy_only=False)
            base = offs[0]
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = (text or "").encode().split()
                n, a, b = len(words), offs[i] - base, offs[i + 1] - base
                cover = np.zeros(n + 1, dtype=np.int64)
                for begin, end in zip(starts[a:b].tolist(), (starts[a:b] + sizes[a:b] + window - 1).tolist(), strict=True):
                    digests.append(hashlib.sha256(b" ".join(words[begin:end])).digest())
                at, to = starts[a:b][marks[a:b]], (starts[a:b] + sizes[a:b] + window - 1)[marks[a:b]]
                np.add.at(cover, np.minimum(at, n), 1)
                np.add.at(cover, np.minimum(to, n), -1)
                if len(at):
                    words = [words[j] for j in np.flatnonzero(np.cumsum(cover)[:n] == 0).tolist()]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest()))
                kept_texts.append(kept.decode() if with_text else None)
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            arrays = [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))]
            names = ["doc_id", "text_key", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(kept_texts, pa.string()))
                names.append("kept")
            fields = [flat.field(i) for i in range(5)] + [pa.array(digests, pa.binary())]
            told = pa.StructArray.from_arrays(fields, names=["start", "n", "s_doc", "s_key", "s_start", "digest"])
            arrays.append(pa.ListArray.from_arrays(pa.array([o - base for o in offs], pa.int32()), told))
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "checks"])

    marked = _texts(docs).join(coords, ROW, "left").select(*ROW, "text", "coords")
    schema = RESULT.replace("doc_id long,", "doc_id long, text_key long,") + (", kept string" if with_text else "") + f", checks {CHECKS}"
    return stage(marked.mapInArrow(apply, schema), "without-repeats")
