"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Texts are cut where no piece can reach across, and each distinct stretch is
encoded once. Stretches of equal length advance together, one character a step:
the hashes of all substrings that end there probe the sorted keys of the
pieces, a vectorised maximum chooses the last piece, and where it begins is
stored for the way back.

What is maximised depends on the model. A unigram model adds up scores. A BPE
model means a sequence of merges, and a sum of its scores would give other ids;
but merging leaves a sequence of pieces just if it leaves every two neighbours
apart when they are merged alone. So there a step's worth is whether a piece
may follow the one that ends where it begins: of all pieces that end at a
place, exactly one does. Which pairs may stand together is found by merging
each pair once, and kept in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import CHUNK_BYTES, U64, mix, powers, text_buffers

UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SPACE = "▁"
NEVER = np.int64(1 << 62)
CACHED = 200_000  # stretches whose ids a worker keeps
FIRST_BITS = 20
PAIR_BITS = 21  # slots of the table of pairs; a pair that has lost its slot is found again
MATRIX = 1 << 18  # characters that advance together
START, LONE = -1, -2  # before the first piece; a character without piece
MODEL_BYTES = 1 << 26
_BASE = 0x8F14E45FCEEA167B


class Model:
    """Pieces, scores and tables of a serialised model."""

    def __init__(self, serialised: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(serialised)
        self.kind = proto.trainer_spec.model_type
        norm = proto.normalizer_spec
        if self.kind not in (UNIGRAM, BPE) or norm.name != "identity" or norm.remove_extra_whitespaces or norm.precompiled_charsmap:
            raise ValueError("only unigram and BPE models without normalisation are supported")
        self._setup([(p.piece, p.score, p.type) for p in proto.pieces], norm.add_dummy_prefix)

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], kind: int, prefix: bool = True) -> Model:
        self = cls.__new__(cls)
        self.kind = kind
        self._setup(pieces, prefix)
        return self

    def _setup(self, pieces: list[tuple[str, float, int]], prefix: bool) -> None:
        if any(t not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, t in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix, self.size = prefix, len(pieces)
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.byte_ids = np.full(256, -1, np.int64)
        for i, (p, _, t) in enumerate(pieces):
            if t == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        if any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece holds a space after another character; texts can't be cut at spaces")
        names = list(self.ids)
        self.scores = {p: pieces[i][1] for p, i in self.ids.items()}
        keys = np.array([_hash_one(p) for p in names], dtype=U64)
        order = np.argsort(keys)
        self.keys = keys[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        bucket = np.bincount((self.keys >> U64(64 - FIRST_BITS)).astype(np.int64), minlength=1 << FIRST_BITS)
        self.first, self.most = np.cumsum(bucket) - bucket, int(bucket.max(initial=0))
        self.key_ids = np.array([self.ids[n] for n in names], dtype=np.int64)[order]
        self.key_scores = np.array([self.scores[n] for n in names])[order]
        ranked = sorted(set(self.scores.values()), reverse=True)
        rank = {s: i for i, s in enumerate(ranked)}
        self.key_ranks = np.array([rank[self.scores[n]] for n in names], dtype=np.int64)[order]
        self.longest = max((len(n) for n in names), default=1)
        self.lowest = min(self.scores.values(), default=0.0) - 10
        self.inner = np.unique(np.array([ord(a) << 32 | ord(b) for p in names for a, b in zip(p, p[1:], strict=False)], dtype=np.int64))
        sorted_names = [names[i] for i in order.tolist()]
        self.key_size = np.array([len(n) for n in sorted_names], dtype=np.int64)
        self.key_codes = np.zeros((len(names), self.longest), np.uint32)
        for i, n in enumerate(sorted_names):
            self.key_codes[i, : len(n)] = [ord(c) for c in n]
        self.pairs = np.zeros(1 << PAIR_BITS, np.int64)  # (pair + 1) * 2 + may stand together
        if self.kind == BPE:
            self.whole = self._stay(np.full(len(names), START), np.arange(len(names)))  # pieces that merging makes
        shown = [b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, t in pieces]
        self.shown_size = np.array([len(s) for s in shown], dtype=np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)

    # -- probing -----------------------------------------------------------

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the sorted keys, or -1; their first bits say where to begin."""
        at = self.first[(hashes >> U64(64 - FIRST_BITS)).astype(np.int64)]
        out = np.full(hashes.shape, -1, np.int64)
        for _ in range(self.most):
            at = np.minimum(at, len(self.keys) - 1)
            same = self.keys[at] == hashes
            out[same] = at[same]
            at = at + 1
        return out

    def _fallback(self, char: str) -> list[int]:
        if self.byte_ids[0] < 0:
            return [self.unknown]
        return self.byte_ids[np.frombuffer(char.encode("utf-8", "surrogatepass"), np.uint8)].tolist()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids): how many pieces each stretch has, and all their ids; ``words`` use U+2581 for a space."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        size = np.array([len(w) for w in words], dtype=np.int64)
        fresh = np.zeros(len(flat), dtype=bool)
        fresh[np.cumsum(size)[size > 0] - size[size > 0]] = True
        # no piece holds these two characters in a row, so none reaches across
        both = flat[:-1].astype(np.int64) << 32 | flat[1:]
        near = np.minimum(np.searchsorted(self.inner, both), max(0, len(self.inner) - 1))
        fresh[1:] |= (self.inner[near] != both) if len(self.inner) else True
        start = np.flatnonzero(fresh)
        length = np.diff(np.append(start, len(flat)))
        # lengths are rounded up by an eighth at most, so that few are apart; what is added stands alone and goes
        room = 1 << np.maximum(0, np.frompyfunc(int.bit_length, 1, 1)((length - 1).tolist()).astype(np.int64) - 3)
        padded = -(-length // room) * room
        parts = []
        for n in np.unique(padded).tolist():
            where = np.flatnonzero(padded == n)
            step = max(1, MATRIX // n)
            for a in range(0, len(where), step):
                own = where[a : a + step]
                column = np.arange(n)
                inside = column[None, :] < length[own, None]
                codes = np.where(inside, flat[np.minimum(start[own, None] + column, len(flat) - 1)], 0)
                row, begin, found = self._viterbi(codes)
                keep = begin < length[own[row]]
                parts.append((start[own[row[keep]]] + begin[keep], found[keep]))
        if not parts:
            return np.zeros(len(words), np.int64), np.zeros(0, np.int64)
        at, found = (np.concatenate([p[i] for p in parts]) for i in range(2))
        order = np.argsort(at, kind="stable")
        at, ids, n = at[order], found[order], np.ones(len(at), np.int64)
        lost = np.flatnonzero(ids < 0)
        if len(lost):  # a character without piece becomes its bytes' pieces
            more = [self._fallback(chr(c)) for c in flat[at[lost]].tolist()]
            n[lost] = [len(m) for m in more]
            place = (np.cumsum(n) - n)[lost]
            ids, at = np.repeat(ids, n), np.repeat(at, n)
            for i, m in zip(place.tolist(), more, strict=True):
                ids[i : i + len(m)] = m
        return np.bincount(np.searchsorted(np.cumsum(size), at, "right"), minlength=len(words)), ids

    # -- equal-length words ----------------------------------------------------

    def _viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, begin, id) of the best segments of equal-length stretches, -1 for a character without piece."""
        n, length = codes.shape
        sums, down = _prefix_of(codes.astype(U64))
        found = []
        for size in range(1, min(self.longest, length) + 1):
            begin = length - size + 1
            at = self.probe(mix((sums[:, size:] - sums[:, :begin]) * down[:begin] + U64(size)))
            row, column = np.nonzero(at >= 0 if self.kind == UNIGRAM else (at >= 0) & self.whole[at])
            found.append((row, column, column + size, at[row, column]))
        row, begin, end, piece = (np.concatenate([f[i] for f in found]) for i in range(4))
        order = np.lexsort((begin, row, end))
        row, begin, piece = row[order], begin[order], piece[order]
        edge = np.searchsorted(end[order], np.arange(1, length + 2)).tolist()
        best = np.zeros((n, length + 1))
        last = np.full((n, length + 1), LONE, np.int64)  # the piece that ends at each place
        last[:, 0] = START
        back = np.tile(np.arange(-1, length), (n, 1))  # and where it begins
        for to in range(1, length + 1):
            r, b, x = (v[edge[to - 1] : edge[to]] for v in (row, begin, piece))
            if self.kind == UNIGRAM:
                best[:, to] = best[:, to - 1] + self.lowest
                worth = self.key_scores[x] + best[r, b]
                chosen = np.lexsort((b, -worth, r))
                chosen = chosen[np.diff(r[chosen], prepend=-1) > 0]
                short = (b[chosen] < to - 1) & (worth[chosen] <= best[r[chosen], to])
                chosen = chosen[~short]
                best[r[chosen], to] = worth[chosen]
            else:
                chosen = np.flatnonzero(self._may_follow(last[r, b], x))
            last[r[chosen], to], back[r[chosen], to] = x[chosen], b[chosen]
        row, end, parts = np.arange(n), np.full(n, length), []
        while len(row):  # all words step back together
            begin = back[row, end]
            parts.append((row, begin, last[row, end]))
            row, end = row[begin > 0], begin[begin > 0]
        row, begin, piece = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return row, begin, np.where(piece >= 0, self.key_ids[piece], -1)

    def _may_follow(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves each two pieces (places among the keys) apart; a start or lone character before one changes nothing."""
        out = np.ones(len(first), dtype=bool)
        some = np.flatnonzero(first >= 0)
        if not len(some):
            return out
        pair = first[some] * len(self.keys) + second[some]
        slot = (mix(pair.astype(U64)) >> U64(64 - PAIR_BITS)).astype(np.int64)
        held = self.pairs[slot]
        known = held >> 1 == pair + 1
        out[some[known]] = (held[known] & 1).astype(bool)
        fresh, which = np.unique(pair[~known], return_inverse=True)
        if len(fresh):
            stay = self._stay(fresh // len(self.keys), fresh % len(self.keys))
            out[some[~known]] = stay[which]
            self.pairs[(mix(fresh.astype(U64)) >> U64(64 - PAIR_BITS)).astype(np.int64)] = (fresh + 1) * 2 + stay
        return out

    def _stay(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging the characters of two pieces ends in these two; of START and a piece, in that piece."""
        out = np.zeros(len(first), dtype=bool)
        lead = np.where(first >= 0, self.key_size[first], 0)
        total = lead + self.key_size[second]
        for low in range(0, 2 * self.longest, 8):
            where = np.flatnonzero((total > low) & (total <= low + 8))
            for a in range(0, len(where), MATRIX // 16):
                own = where[a : a + MATRIX // 16]
                column = np.arange(low + 8)
                from_second = column - lead[own, None]
                mine = self.key_codes[second[own, None], np.clip(from_second, 0, self.longest - 1)]
                mine = np.where(from_second < 0, self.key_codes[first[own, None], np.minimum(column, self.longest - 1)], mine)
                mine = np.where(column < total[own, None], mine, 0)  # in no piece
                out[own] = self._merged(mine.astype(U64), lead[own], total[own])
        return out

    def _merged(self, codes: np.ndarray, lead: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Whether the best merges, one a step in every row, leave a bound at ``lead`` and else none below ``total``."""
        sums, down = _prefix_of(codes)
        n, length = codes.shape
        out = np.zeros(n, dtype=bool)
        alive, bounds = np.arange(n), np.tile(np.arange(length + 1), (n, 1))

        def ranks(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
            at = self.probe(mix((sums[row, end] - sums[row, begin]) * down[begin] + (end - begin).astype(U64)))
            return np.where(at >= 0, self.key_ranks[at], NEVER)

        def judge(row: np.ndarray, left: np.ndarray) -> None:
            inner = (left > 0) & (left < total[row, None])
            out[row] = np.where(lead[row] > 0, (inner.sum(1) == 1) & (inner & (left == lead[row, None])).any(1), ~inner.any(1))

        pair = ranks(np.repeat(alive, length - 1), bounds[:, :-2].ravel(), bounds[:, 2:].ravel()).reshape(n, length - 1)
        while len(alive) and pair.shape[1]:
            best = np.argmin(pair, axis=1)
            going = pair[np.arange(len(alive)), best] < NEVER
            if not going.all():
                judge(alive[~going], bounds[~going])
                alive, bounds, pair, best = alive[going], bounds[going], pair[going], best[going]
            width = pair.shape[1]
            column = np.arange(width + 2)
            bounds = bounds[column[None, :] != best[:, None] + 1].reshape(len(alive), width + 1)
            pair = pair[column[None, :width] != best[:, None]].reshape(len(alive), width - 1)
            for shift in (-1, 0):  # the pairs beside the new symbol
                at = best + shift
                ok = np.flatnonzero((at >= 0) & (at < width - 1))
                if len(ok):
                    pair[ok, at[ok]] = ranks(alive[ok], bounds[ok, at[ok]], bounds[ok, at[ok] + 2])
        judge(alive, bounds)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; bytes that aren't UTF-8 become U+FFFD."""
        if len(ids) and not (0 <= ids.min() and ids.max() < self.size):
            raise ValueError("an id is not in the vocabulary")
        n = self.shown_size[ids]
        at = np.repeat(self.shown_at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        text = self.shown[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def _hash_one(piece: str) -> int:
    codes = np.array([[ord(c) for c in piece]], dtype=U64)
    sums, _ = _prefix_of(codes)
    return int(mix(sums[:, -1] + U64(len(piece)))[0])


def _prefix_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(_BASE, codes.shape[1] + 1)
    sums = np.zeros((codes.shape[0], codes.shape[1] + 1), U64)
    np.cumsum(mix(codes + U64(1)) * up[: codes.shape[1]], axis=1, out=sums[:, 1:])
    return sums, down


class Encoder:
    """Encodes texts; what it knows of stretches met before is kept up to a bound."""

    _stretch = re.compile(" *[^ ]+| +")

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(first, ids): the ids of all texts, and where each text's begin."""
        cut: list[str] = []
        counts = []
        for t in texts:
            if t:
                t = t.replace(SPACE, " ")
                own = self._stretch.findall(" " + t if self.model.prefix else t)
                cut += own
                counts.append(len(own))
            else:
                counts.append(0)
        if len(self.known) > CACHED:
            self._forget()
        fresh = [w for w in dict.fromkeys(cut) if w not in self.known]
        if fresh:
            n, made = self.model.encode_words([w.replace(" ", SPACE) for w in fresh])
            self.known.update(zip(fresh, range(len(self.n), len(self.n) + len(fresh)), strict=True))
            self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(n) - n))
            self.n = np.concatenate((self.n, n))
            self.flat = np.concatenate((self.flat, made.astype(np.int32)))
        codes = np.fromiter(map(self.known.__getitem__, cut), np.int64, len(cut))
        n = self.n[codes]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.repeat(self.at[codes] - total[:-1], n) + np.arange(total[-1])]
        return total[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))], ids


_encoders: dict[bytes, Encoder] = {}


def shared_encoder(serialised: bytes) -> Encoder:
    """This process's encoder of a model, so that one task's stretches are known to the next."""
    key = hashlib.sha256(serialised).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Model(serialised))
    return _encoders[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _sent(df: DataFrame, model_path: str):
    with open(model_path, "rb") as f:
        serialised = f.read(MODEL_BYTES + 1)
    if len(serialised) > MODEL_BYTES:
        raise ValueError(f"a model of over {MODEL_BYTES} bytes is not broadcast")
    return df.sparkSession.sparkContext.broadcast(serialised)


def encode(docs: DataFrame, model_path: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids, ids_sha256, round_trip): a row per input row.

    ids_sha256 is of the ids as little-endian 32-bit integers; round_trip says
    that decoding the ids gives the text again (U+2581 counts as a space).
    Null and empty texts have no ids. Repeated rows give a row each, an empty
    table an empty one; a null key stays null. A text of any length is encoded
    whole, in time in proportion to its length. Without ``with_ids`` ids is
    null. The model file is read on the driver and broadcast, if it has 64 MB
    at most.
    """
    sent = _sent(docs, model_path or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(sent.value)
        for batch in batches:
            column = batch.column(1)
            _, offsets = text_buffers(column)
            at = 0
            while at < batch.num_rows:
                to = min(max(int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1, at + 1), batch.num_rows)
                texts = [t or "" for t in column.slice(at, to - at).to_pylist()]
                first, ids = encoder.encode(texts)
                digests, whole = [], []
                for t, a, b in zip(texts, first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = ids[a:b]
                    digests.append(hashlib.sha256(own.astype("<i4").tobytes()).hexdigest())
                    whole.append(encoder.model.decode(own) == t.replace(SPACE, " "))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids)) if with_ids else pa.nulls(to - at, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(np.diff(first)), lists, pa.array(digests, pa.string()), pa.array(whole, pa.bool_())], names=[key, "n_tokens", "ids", "ids_sha256", "round_trip"])
                at = to

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` long, n_tokens long, ids array<int>, ids_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, model_path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids), a row per row, of any length; null ids give a null text, no ids an empty one, an unknown id an error."""
    sent = _sent(encoded, model_path or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_encoder(sent.value).model
        for batch in batches:
            texts = [None if x is None else model.decode(np.array(x, dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(F.col(key).cast("long").alias(key), "ids").mapInArrow(run, f"`{key}` long, text string")
