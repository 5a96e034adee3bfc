"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.
A text is cut into short windows, each window is compressed with either
dictionary, and a logistic function of how often the toxic one saves how many
bytes gives the score; its coefficients are fitted on labelled rows.

Most of a toxic text is ordinary language. So that the toxic dictionary holds
what is toxic in it, it is trained on the stretches of toxic texts whose byte
6-grams no ordinary text of the sample has; a stock of ordinary text is part of
both dictionaries, and cancels out. All windows begin with a constant that both
hold, as zstandard stores what it can't make smaller and its length would then
say nothing.
"""

from __future__ import annotations

import contextlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import sample_by_hash

WINDOW = 4  # words
GRAM = 6  # bytes
LEVEL = 12
SHARED_BYTES, OWN_BYTES = 16384, 8192
HEAD = bytes(range(128, 176))
STEPS, LOSSES = range(1, 10), (1, 2, 3, 5)
THRESHOLD = 0.3
# Bounds of what the classifier is fitted on; nothing else is bounded. Of the
# ordinary rows' windows at most FIT_WINDOWS, drawn at random, train the
# dictionaries. A stretch of toxic text is learned if at least one in SHARED_BY
# of the sampled toxic texts has it, and never fewer than two (of under 8, one).
TOXIC_ROWS, ORDINARY_ROWS, FIT_WINDOWS, SHARED_BY = 3000, 6000, 120_000, 350
BATCH_BYTES = 1 << 19

_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split()


def windows(text: str) -> list[bytes]:
    """The different windows of a whole text: lower-case words, all else as blanks."""
    words = _words(text)
    return list(dict.fromkeys(b" %b " % b" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)))


def _grams(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(a) - GRAM + 1
    key = np.zeros(max(0, n), np.uint64)
    for i in range(GRAM if n > 0 else 0):
        key = (key << np.uint64(8)) | a[i : n + i]
    return key


def _trained(samples: list[bytes], size: int, **parameters: int) -> bytes:
    """The content of a trained dictionary; of too few samples the samples' own end."""
    with contextlib.suppress(zstandard.ZstdError):
        return zstandard.train_dictionary(size + 2048, samples, **parameters).as_bytes()[-size:]
    return b"".join(samples)[-size:]


class Lengths:
    """Compressed lengths under one dictionary."""

    def __init__(self, content: bytes) -> None:
        content += HEAD
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=96, dict_size=len(content), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        dictionary.precompute_compress(compression_params=parameters)
        self._compressor = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)

    def of(self, samples: list[bytes]) -> np.ndarray:
        if not samples:
            return np.zeros(0)
        made = self._compressor.multi_compress_to_buffer(samples, threads=1)
        return np.fromiter(map(len, made), np.float64, len(samples))


def _features(gain: np.ndarray) -> list[float]:
    """What the gains of a text's windows amount to."""
    n = len(gain)
    if not n:
        return [0.0] * N_FEATURES
    top = np.sort(gain)[::-1]
    above = [float((gain >= j).sum()) for j in STEPS]
    return [*(x / n for x in above), *(x**0.5 for x in above), *(float((gain <= -j).mean()) for j in LOSSES), np.log1p(n), top[0], top[: max(1, n // 8)].mean(), gain.mean()]


N_FEATURES = 2 * len(STEPS) + len(LOSSES) + 4


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self) -> _Scorer:
        return _Scorer(self)


class _Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.ordinary, self.toxic = model, Lengths(model.ordinary), Lengths(model.toxic)

    def features(self, texts: list[str]) -> np.ndarray:
        cut = [windows(t) for t in texts]
        flat = [HEAD + w for ws in cut for w in ws]
        gain = self.ordinary.of(flat) - self.toxic.of(flat)
        ends = np.cumsum([len(ws) for ws in cut], dtype=np.int64)
        return np.array([_features(x) for x in np.split(gain, ends[:-1])]) if texts else np.zeros((0, N_FEATURES))

    def scores(self, texts: list[str]) -> np.ndarray:
        m = self.model
        return 1 / (1 + np.exp(-np.clip(((self.features(texts) - m.mean) / m.scale) @ m.weights + m.bias, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    mean, scale = x.mean(0), x.std(0) + 1e-6
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w[:-1], float(w[-1])


def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The (ordinary, toxic) dictionaries of some labelled texts, within ``FIT_WINDOWS`` and ``SHARED_BY``."""
    seen = np.zeros(0, np.uint64)
    for at in range(0, len(ordinary), 200):
        some = [_grams(b" %b " % b" ".join(_words(t))) for t in ordinary[at : at + 200]]
        seen = np.union1d(seen, np.concatenate(some))
    stretches, texts_with = [], Counter()
    for t in toxic:
        data = b" %b " % b" ".join(_words(t))
        grams = _grams(data)
        if not len(grams):
            continue
        near = np.minimum(np.searchsorted(seen, grams), max(0, len(seen) - 1))
        new = np.flatnonzero(seen[near] != grams) if len(seen) else np.arange(len(grams))
        runs = [r for r in np.split(new, np.flatnonzero(np.diff(new) > 1) + 1) if len(r)]
        stretches += [data[r[0] : r[-1] + GRAM] for r in runs]
        texts_with.update(np.unique(grams[new]).tolist())
    least = max(2 if len(toxic) >= 8 else 1, len(toxic) // SHARED_BY)  # toxic texts that share a stretch
    stretches = [s for s in stretches if max(texts_with[g] for g in _grams(s).tolist()) >= least]
    plain = [w for t in ordinary for w in windows(t)]
    order = np.random.default_rng(0).permutation(len(plain))[:FIT_WINDOWS]
    half = len(order) // 2
    shared = _trained([plain[i] for i in order[:half]], SHARED_BYTES)
    return shared + _trained([plain[i] for i in order[half:]], OWN_BYTES), shared + _trained(stretches, OWN_BYTES, k=32, d=6)


def train(toxic: list[str], ordinary: list[str], rate: float) -> Model:
    """Coefficients from either half's windows under the other half's dictionaries; the final ones are of all texts.

    ``rate`` is the toxic share to expect.
    """
    none = np.zeros(N_FEATURES)
    if len(toxic) < 2 or len(ordinary) < 2:
        return Model(b"", b"", none, none + 1, none, float(np.log(rate / (1 - rate))))
    x, y = [], []
    for k in (0, 1):
        scorer = Model(*_dictionaries(toxic[k::2], ordinary[k::2]), none, none + 1, none, 0.0).scorer()
        for label, part in ((1.0, toxic[1 - k :: 2]), (0.0, ordinary[1 - k :: 2])):
            x += [scorer.features(part[i : i + 50]) for i in range(0, len(part), 50)]
            y += [label] * len(part)
    mean, scale, weights, bias = _logistic(np.concatenate(x), np.array(y))
    sampled = len(toxic) / len(y)
    bias += float(np.log(rate / (1 - rate)) - np.log(sampled / (1 - sampled)))
    return Model(*_dictionaries(toxic, ordinary), mean, scale, weights, bias)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on labelled rows that aren't held out.

    The toxic share is counted over all of them. For the dictionaries and
    coefficients at most ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` rows, those first
    by hash, come to the driver with their whole texts. Null labels are none; without rows of both classes every score is the smoothed share.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic").filter(~held_out(F.col("doc_id"))).distinct()
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    texts: dict[int, list[str]] = {}
    for toxic, rows in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS)):
        chosen = sample_by_hash(known.filter(F.col("toxic") == toxic), ["doc_id"], rows).select("doc_id")
        found = docs.filter("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "text")  # at most ``rows`` ids
        texts[toxic] = [r["text"] for r in found.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).collect()]
    return train(texts[1], texts[0], rate)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document row, from its whole text; a null text is as an empty one."""
    scorers: list[_Scorer] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not scorers:
            scorers.append(model.scorer())
        for batch in batches:
            ids, texts, held, size, begin = batch.column(0), batch.column(1).to_pylist(), [], 0, 0
            for i, t in enumerate(texts):
                held.append(t or "")
                size += len(held[-1])
                if size >= BATCH_BYTES or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([ids.slice(begin, len(held)), pa.array(scorers[0].scores(held))], names=["doc_id", "score"])
                    begin, held, size = i + 1, [], 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per document row.

    Repeated texts score alike, rows without id are scored too, null texts as
    empty ones, texts of any length whole; an empty table gives an empty one.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
