"""Benchmark passages in documents: Wu-Manber search over words.

The alphabet is words, held as 64-bit hashes. Patterns of one length share a
shift table over blocks of two words. Many stretches of text are searched at
once: each keeps a cursor, all cursors move by their block's shift, and where
the shift is nought the block's bucket names the patterns to compare. A match
is confirmed on the words' bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .words import U64, Words, chunks, mix

PASSED = "doc_id {kind}, text string, n_words long, spans array<int>, items array<string>"
_LANE = 256
_FEWEST_BITS, _MOST_BITS = 12, 24
SPARSE = 16  # slots of the shift table for each block of the patterns, so that few unrelated blocks share one
LIVE = 4  # blocks of patterns that executors hold at once
_PAIR = U64(0x9FB21C651E98DF25)


def _block(h: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    key = h[last] if size == 1 else h[last - 1] * _PAIR + h[last]
    return mix(key)


class Patterns:
    """All patterns of ``m`` words: shift table, buckets by the last block, words to confirm.

    ``strings`` has the places of each pattern's words in ``words``; the items
    of pattern i are ``items[edge[i] : edge[i + 1]]``.
    """

    def __init__(self, m: int, words: list[bytes], hashes: np.ndarray, strings: np.ndarray, items: list[list[str]]) -> None:
        self.m, self.size = m, min(2, m)
        self.words, self.strings, self.hashes = words, strings, hashes[strings]
        self.edge = np.concatenate(([0], np.cumsum([len(x) for x in items], dtype=np.int64)))
        self.items = np.array([x for own in items for x in own], dtype=object)
        ends = np.concatenate([_block(self.hashes.ravel(), np.arange(len(strings)) * m + e, self.size) for e in range(self.size - 1, m)])
        n = len(np.unique(ends))
        self.bits = min(_MOST_BITS, max(_FEWEST_BITS, (SPARSE * n).bit_length()))
        self.shift = np.full(1 << self.bits, m - self.size + 1, dtype=np.int16 if m < 30000 else np.int64)
        late = np.repeat(m - 1 - np.arange(self.size - 1, m), len(strings))
        np.minimum.at(self.shift, self._slot(ends), late)
        last = ends[len(ends) - len(strings) :]
        self.order = np.argsort(last, kind="stable")
        self.suffix = last[self.order]

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> U64(64 - self.bits)).astype(np.int64)

    def search(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word positions and pattern numbers of all occurrences inside single texts."""
        h, m = w.hash, self.m
        counts = w.counts - m + 1  # windows of each text
        texts = np.flatnonzero(counts > 0)
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = -(-counts[texts] // _LANE)
        owner = np.repeat(texts, lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = w.first[owner] + nth * _LANE
        stop = np.minimum(at + _LANE, w.first[owner] + counts[owner])
        found = []
        while len(at):
            block = _block(h, at + m - 1, self.size)
            step = self.shift[self._slot(block)].astype(np.int64)
            hit = step == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(found)
        block = _block(h, at + m - 1, self.size)
        low, high = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        n = high - low
        at = np.repeat(at, n)
        which = self.order[np.repeat(low, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]
        same = np.ones(len(at), dtype=bool)
        for j in range(m):
            same &= h[at + j] == self.hashes[which, j]
        at, which = at[same], which[same]
        sure = np.fromiter((all(w.word(p + j).lower() == self.words[x] for j, x in enumerate(self.strings[k].tolist())) for p, k in zip(at.tolist(), which.tolist(), strict=True)), bool, len(at))
        return at[sure], which[sure]


def compile_patterns(items: list[tuple[int, str]], window: int) -> list[Patterns]:
    """Pattern groups by length: each item's windows, or all of a shorter item."""
    held: dict[tuple[int, ...], list[str]] = defaultdict(list)
    known: dict[bytes, int] = {}
    hashes: list[int] = []
    texts = pa.array([t or "" for _, t in items], pa.string())
    for a, b, w in chunks(texts, "alnum", True):
        codes = []
        for i, h in enumerate(w.hash.tolist()):
            code = known.setdefault(w.word(i).lower(), len(known))
            if code == len(hashes):
                hashes.append(h)
            codes.append(code)
        for r in range(a, b):
            own = tuple(codes[w.first[r - a] : w.first[r - a + 1]])
            name = str(items[r][0])
            for i in range(max(1, len(own) - window + 1) if own else 0):
                ids = held[own[i : i + window]]
                if name not in ids:
                    ids.append(name)
    by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    for s in sorted(held):
        by_length[len(s)].append(s)
    words, numbers = list(known), np.array(hashes, dtype=U64)
    return [Patterns(m, words, numbers, np.array(ss, dtype=np.int64).reshape(len(ss), m), [held[s] for s in ss]) for m, ss in sorted(by_length.items())]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 13, broadcast_bytes: int = 1 << 24) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items): one row per document row; no shuffle. doc_id may have any type.

    Words are runs of 0-9, letters and all characters beyond ASCII, A-Z lowered.
    Null and empty texts have no words; items without words or id match
    nothing; repeated documents and items count by themselves; texts of any
    length are searched whole; an empty table gives an empty one. The patterns
    are broadcast in blocks of items of about ``broadcast_bytes`` of text
    (counted first). A text passes block after block with what they found in
    it; after every ``LIVE`` blocks that is staged, and the next ones follow
    when the last are gone, so that memory doesn't grow with the benchmark.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / broadcast_bytes))
    schema = PASSED.format(kind=docs.schema["doc_id"].dataType.simpleString())
    none = F.lit(None)
    state = docs.select("doc_id", "text", none.cast("long").alias("n_words"), none.cast("array<int>").alias("spans"), none.cast("array<string>").alias("items"))
    live = []
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        live.append(spark.sparkContext.broadcast(compile_patterns([tuple(r) for r in part.toLocalIterator()], window)))
        state = state.mapInArrow(_scan(live[-1], last=b == blocks - 1), schema)
        if len(live) == LIVE and b < blocks - 1:
            state = stage(state, "benchmark-hits")
            for sent in live:
                sent.destroy()
            live = []
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: x - acc)  # begins and ends by turns, see _scan
    return state.select("doc_id", "n_words", length.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")


def _scan(sent, last: bool):
    """Search the patterns of one block; spans are merged runs of hit words, flat as begin, end, begin, end..."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: list[np.ndarray] = []
            names: list[list[str]] = []
            counts: list[int] = []
            for a, b, w in chunks(batch.column(1), "alnum", True):
                cover = np.zeros(len(w.hash) + 1, dtype=np.int32)
                found: dict[int, set[str]] = defaultdict(set)
                before = batch.column(3).slice(a, b - a), batch.column(4).slice(a, b - a)
                if before[0].null_count < b - a:  # what earlier blocks found
                    for t, (own, ids) in enumerate(zip(before[0].to_pylist(), before[1].to_pylist(), strict=True)):
                        np.add.at(cover, w.first[t] + np.array(own or [], np.int64), np.resize([1, -1], len(own or [])))
                        found[t].update(ids or [])
                for patterns in sent.value:
                    at, which = patterns.search(w)
                    if len(at):
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + patterns.m, -1)
                        text = np.searchsorted(w.first, at, "right") - 1
                        for t, k in set(zip(text.tolist(), which.tolist(), strict=True)):
                            found[t].update(patterns.items[patterns.edge[k] : patterns.edge[k + 1]].tolist())
                hit = np.cumsum(cover[:-1]) > 0
                change = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                for t in range(b - a):
                    low, high = int(w.first[t]), int(w.first[t + 1])
                    own = change[np.searchsorted(change, low, "right") : np.searchsorted(change, high, "left")] - low
                    if low < high:
                        own = np.concatenate((np.zeros(int(hit[low]), np.int64), own, np.full(int(hit[high - 1]), high - low)))
                    spans.append(own)
                    names.append(sorted(found.get(t, ())))
                counts += w.counts.tolist()
            texts = pa.nulls(batch.num_rows, pa.string()) if last else batch.column(1)
            edges = np.concatenate(([0], np.cumsum([len(x) for x in spans], dtype=np.int32))).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *spans]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat)), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "spans", "items"])

    return scan


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
