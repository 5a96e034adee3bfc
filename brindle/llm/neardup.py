"""Near-duplicate groups: MinHash bands, odd sketches, exact confirmation.

Equal shingle sets are one class from the start. Bands of MinHash samples put
classes into buckets; inside a bucket the odd sketches (parity bitmaps of all
samples) estimate each similarity from one XOR, and only spanning links of what
looks alike are kept. The clusters of these links are then solved exactly on
the full sets, and again only spanning links leave a task.

Buckets and clusters of more rows or bytes than a block are cut into blocks,
each solved by itself. One member of each component found goes on to the next
level while that at least halves them, until they fit a block. What is then
still apart is compared whole: all members outside of the group's largest component with
all others. So none is capped, none is held whole, and no link is lost.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import LINKS, components, links_batch
from .staging import stage
from .words import U64, Words, chunks, mix, span

SIGNED = "doc_id long, n long, h1 long, h2 long, buckets array<long>, s0 long, s1 long, s2 long, s3 long"
BITS = 256
ROWS = 5  # MinHash samples in a band
SKETCHED = BITS // 2  # samples in a sketch at most; more would fill it up


def bands_for(threshold: float, miss: float = 1e-5) -> int:
    """Bands after which a pair at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**ROWS)))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): each text's distinct k-word shingles, sorted; of a shorter text its whole sequence."""
    texts = len(w.first) - 1
    counts = w.counts
    sums, text = w.sums(), w.texts()
    begin = np.flatnonzero(text[: len(text) - k + 1] == text[k - 1 :]) if len(text) >= k else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    begins = np.concatenate((begin, w.first[short]))
    ends = np.concatenate((begin + k, w.first[short + 1]))
    owner = np.concatenate((text[begin], short))
    if not len(begins):
        return np.zeros(texts + 1, np.int64), np.zeros(0, U64)
    values = span(sums, begins, ends)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return np.searchsorted(owner, np.arange(texts + 1)), values


def _class(first: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each text's set; nought for an empty one."""
    total = [np.concatenate((np.zeros(1, U64), np.cumsum(mix(values * U64(c))))) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    return tuple((t[first[1:]] - t[first[:-1]]).view(np.int64) for t in total)


def _coefficients(samples: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * samples + 1, dtype=U64) * U64(0xD1B54A32D192ED03))
    return seeds[:samples] | U64(1), seeds[samples:]


def sign(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """Set size, class, bucket keys and odd sketch of every document row."""
    samples = bands * ROWS
    times, plus = _coefficients(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in chunks(batch.column(1), "blank", True):
                first, values = shingles(w, k)
                n = np.diff(first)
                h1, h2 = _class(first, values)
                some = np.flatnonzero(n)
                keys = np.zeros((len(some), bands), U64)
                sketch = np.zeros((len(some), BITS // 64), U64)
                at = np.arange(len(some))
                for i in range(samples if len(some) else 0):
                    least = np.minimum.reduceat(values * times[i] + plus[i], first[some])
                    band = i // ROWS
                    keys[:, band] = mix(keys[:, band] ^ (least + U64(i)))
                    if i < SKETCHED:
                        bit = (mix(least ^ plus[i]) >> U64(56)).astype(np.int64)
                        sketch[at, bit >> 6] ^= U64(1) << (bit & 63).astype(U64)
                offsets = np.zeros(b - a + 1, np.int32)
                np.cumsum(np.where(n > 0, bands, 0), out=offsets[1:])
                full = np.zeros((b - a, BITS // 64), U64)
                full[some] = sketch
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
                columns = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), lists, *(pa.array(full[:, j].view(np.int64)) for j in range(4))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "h1", "h2", "buckets", "s0", "s1", "s2", "s3"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNED)


def most_different_bits(similarity: float, samples: int, deviations: float = 5.0) -> float:
    """Bits that the XOR of two odd sketches hardly ever exceeds at this similarity.

    The expectation and some standard deviations: of the samples that differ,
    and of the parities that they leave.
    """
    load = 4 * samples * (1 - similarity) / BITS
    spread = (2 * math.exp(-load)) ** 2 * samples * similarity * (1 - similarity) + BITS / 4 * (1 - math.exp(-2 * load))
    return BITS / 2 * (1 - math.exp(-load)) + deviations * math.sqrt(spread)


# -- groups of sorted rows -----------------------------------------------------


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups with the groups' bounds; rows must come sorted by the first ``n_keys`` columns."""
    held: list[pa.RecordBatch] = []

    def bounds(batch: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
        for i in range(n_keys):
            c = batch.column(i).to_numpy(zero_copy_only=False)
            change |= c[1:] != c[:-1]
        return np.concatenate(([0], np.flatnonzero(change) + 1))

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        same = held and all(held[-1].column(i)[-1] == batch.column(i)[0] for i in range(n_keys))
        begin = bounds(batch)
        if held and not same:
            done = joined()
            yield done, np.append(bounds(done), done.num_rows)
            held = []
        if len(begin) == 1:
            held.append(batch)
            continue
        last = int(begin[-1])
        held.append(batch.slice(0, last))
        done = joined()
        yield done, np.append(bounds(done), done.num_rows)
        held = [batch.slice(last)]
    if held:
        done = joined()
        yield done, np.append(bounds(done), done.num_rows)


def spanning(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links of a spanning forest; ``linked(i, others)`` says which of the others i is linked with."""
    left, out = np.arange(n), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = linked(i, left)
            near = left[hit]
            out += [(i, int(j)) for j in near]
            queue += near.tolist()
            left = left[~hit]
    return out


Test = Callable[[int, np.ndarray], np.ndarray]


def linked_in_groups(members: DataFrame, prepare: Callable[[pa.RecordBatch, np.ndarray], Iterator[Test]], rows: int, size: int) -> DataFrame:
    """Links (a, b) that connect whatever links the members of each group have among them, staged.

    ``members``, staged, has the columns g (the group), rep, bytes, and more for
    ``prepare``. That takes a batch with the bounds of its groups and yields for
    each a test of which rows (counted from the group's begin) are linked with
    one of them. A block has about ``rows`` rows and ``size`` bytes at most,
    single larger rows apart.
    """
    names = members.columns
    kept = [c for c in names if c not in ("g", "bytes")]  # rep comes first

    def blocks_of(n: Column, total: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / rows), F.ceil(total / size)).cast("int")

    def dealt(df: DataFrame) -> DataFrame:
        return df.select("g", "x", "y", "minor", "label", *kept).repartition("g", "x", "y").sortWithinPartitions("g", "x", "y", "minor", "rep")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edge in groups(batches, 3):
            minor, label, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
            out = [np.zeros((0, 2), np.int64)]
            for (a, b), linked in zip(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True), prepare(batch.select(range(5, 5 + len(kept))), edge), strict=True):
                if not minor[b - 1]:
                    out.append(rep[a + np.array(spanning(b - a, linked), dtype=np.int64).reshape(-1, 2)])
                    continue
                own = label[a:b]
                for i in np.flatnonzero(minor[a:b]).tolist():
                    others = np.flatnonzero(~minor[a:b] & (own != own[i]))
                    hit = others[linked(i, others)] if len(others) else others
                    near = hit[np.unique(own[hit], return_index=True)[1]]  # one of each component
                    out.append(np.stack([np.full(len(near), rep[a + i]), rep[a + near]], axis=1))
            both = np.concatenate(out)
            yield links_batch(both[:, 0], both[:, 1])

    def solved(df: DataFrame) -> DataFrame:
        return stage(dealt(df).mapInArrow(solve, LINKS), "links")

    alone = {"y": F.lit(0), "minor": F.lit(False), "label": F.lit(0).cast("long")}
    todo, links, cut = members, None, None
    for level in itertools.count():
        sizes = todo.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total")).filter("n > 1")
        sizes = stage(sizes.select("g", "n", blocks_of(F.col("n"), F.col("total")).alias("blocks")), "group-sizes")
        own = F.pmod(F.xxhash64(F.lit(level), "rep", "g"), F.col("blocks")).cast("int")
        found = solved(todo.join(sizes, "g").withColumns({"x": own, **alone}))
        links = found if links is None else links.union(found)
        large = sizes.filter("blocks > 1").select("g", "blocks")
        cut = large if cut is None else cut
        n = sizes.filter("blocks > 1").agg(F.sum("n")).first()[0]
        if n is None:
            break
        labels = stage(components(links), "labels")
        below = labels.filter("vertex <> root").select(F.col("vertex").alias("rep"))
        todo = stage(todo.join(large.select("g"), "g", "left_semi").join(below, "rep", "left_anti").select(*names), "roots")
        if 2 * todo.count() > n:  # little came together, so further levels would not help
            break
    if level == 0 and n is None:  # all groups fit a block
        return links
    # what the levels may have missed: any link has an end outside of the largest component
    label = F.coalesce("root", "rep").alias("label")
    every = stage(members.join(cut, "g").join(components(links).withColumnRenamed("vertex", "rep"), "rep", "left").select(*names, "blocks", label), "labelled")
    parts = stage(every.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total")), "parts")
    whole = parts.groupBy("g").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all"), F.sum("total").alias("bytes_all"), F.max_by("total", F.struct("n", "label")).alias("bytes_most"))
    left = blocks_of(F.col("all") - F.col("most.n"), F.col("bytes_all") - F.col("bytes_most"))
    open_ = stage(whole.filter(F.col("all") > F.col("most.n")).select("g", F.col("most.label").alias("largest"), left.alias("chunks")), "open-groups")
    held = every.join(open_, "g")
    x, y = (F.pmod(F.xxhash64(F.lit(-1), "rep", "g"), F.col(c)).cast("int") for c in ("blocks", "chunks"))
    base = held.withColumns({"x": x, "y": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "minor": F.lit(False)})
    minors = held.filter("label <> largest").withColumns({"x": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "y": y, "minor": F.lit(True)})
    return links.union(solved(base.unionByName(minors)))


def _alike(classes: DataFrame, limit: float, rows: int) -> DataFrame:
    """Links that connect, bucket by bucket, the classes whose sketches differ in at most ``limit`` bits."""
    slim = classes.select("rep", F.explode("buckets").alias("g"))
    shared = stage(slim.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g"), "buckets")
    members = stage(slim.join(shared, "g").join(classes.select("rep", "s0", "s1", "s2", "s3"), "rep").select("g", "rep", F.lit(40).alias("bytes"), "s0", "s1", "s2", "s3"), "bucket-members")

    def prepare(batch: pa.RecordBatch, edge: np.ndarray) -> Iterator[Test]:
        sketch = np.stack([batch.column(1 + j).to_numpy() for j in range(4)], axis=1).view(U64)
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            own = sketch[a:b]
            yield lambda i, others, own=own: np.bitwise_count(own[others] ^ own[i]).sum(1) <= limit

    return linked_in_groups(members, prepare, rows, rows * 40)


def _confirmed(docs: DataFrame, clusters: DataFrame, k: int, percent: int, rows: int, size: int) -> DataFrame:
    """Links that connect, cluster by cluster, the classes whose full sets are similar enough."""
    # clusters grow with the corpus, so the join is a shuffle at every size
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(clusters.hint("merge"), "rep")
    members = stage(texts.select(F.col("root").alias("g"), "rep", F.octet_length("text").cast("long").alias("bytes"), "h1", "text"), "cluster-texts")

    def prepare(batch: pa.RecordBatch, edge: np.ndarray) -> Iterator[Test]:
        named = batch.column(1).to_numpy()
        sets: list[np.ndarray] = []
        for a, b, w in chunks(batch.column(2), "blank", True):
            first, values = shingles(w, k)
            # a row whose text isn't the class's shares its id only
            good = (_class(first, values)[0] == named[a:b]) & (np.diff(first) > 0)
            sets += [values[first[i] : first[i + 1]] if good[i] else values[:0] for i in range(b - a)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield _similar(sets[a:b], percent)

    return linked_in_groups(members, prepare, rows, size)


def _similar(sets: list[np.ndarray], percent: int) -> Test:
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return lambda i, others: np.full(len(others), 100 * both >= percent * (size.sum() - both) and both > 0)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    flag = np.zeros(len(ids) + 1, dtype=np.int32)

    def linked(i: int, others: np.ndarray) -> np.ndarray:
        own = ids[starts[i] : starts[i] + size[i]]
        flag[own] = 1
        # only sets of a size that can be similar enough
        may = ((100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])) & (size[others] > 0)).nonzero()[0]
        out = np.zeros(len(others), dtype=bool)
        if len(may):
            n = size[others[may]]
            at = np.repeat(starts[others[may]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.add.reduceat(flag[ids[at]], np.cumsum(n) - n)
            out[may] = 100 * both >= percent * (n + size[i] - both)
        flag[own] = 0
        return out

    return linked


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 256, block_bytes: int = 1 << 24) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document row.

    Documents whose sets of distinct ``k``-word shingles have a Jaccard
    similarity of ``percent`` at least are linked; component_id is the smallest
    doc_id reachable. A link is missed with probability 1e-5 at most by the
    bands, and by the sketches only beyond five standard deviations. Texts
    without words, null texts and rows without doc_id link with nothing; their
    component is themselves (null without id) and they are kept. Rows that
    repeat a doc_id are judged each by its own text, and are kept together.
    Texts of any length are judged whole; an empty table gives an empty one.
    ``block`` texts of ``block_bytes`` bytes at most are compared at once.
    """
    threshold = percent / 100
    bands = bands_for(threshold)
    signed = stage(sign(docs, k, bands), "signatures")
    first = [F.first(c).alias(c) for c in ("buckets", "s0", "s1", "s2", "s3")]
    classes = stage(signed.filter("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), *first), "classes")
    limit = most_different_bits(threshold, min(SKETCHED, bands * ROWS))
    alike = components(_alike(classes, limit, 32 * block))
    clusters = stage(alike.withColumnRenamed("vertex", "rep").join(classes.select("rep", "h1"), "rep"), "clusters")
    roots = components(_confirmed(docs, clusters, k, percent, block, block_bytes))
    named = classes.select("h1", "h2", "rep").join(roots.withColumnRenamed("vertex", "rep"), "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("component"))
    joined = signed.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
