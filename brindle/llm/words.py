"""Vectorised word tables over Arrow text batches (numpy, no per-word Python objects).

A batch is cut into chunks of about ``CHUNK_BYTES``; every array below is a few
times the chunk's size, so memory doesn't depend on the batch. A single longer
text is a chunk of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
LONG_WORD = 256  # bytes; there are longer strings whose sums modulo 2**64 agree whatever the base, so longer words are digested


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (murmur's)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least (base is odd)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, dtype=U64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        have = (both[0], both[1])
        if n <= 2 * CHUNK_BYTES:  # those of a giant text aren't kept
            _powers[base] = have
    return have


@lru_cache(maxsize=4)
def _byte_values(fold: bool, seed: int) -> np.ndarray:
    values = mix((np.arange(1, 257, dtype=U64) + U64(256 * seed)) * U64(0xA24BAED4963EE407))
    if fold:
        values[65:91] = values[97:123]
    return values


@lru_cache(maxsize=4)
def separators(pattern: str) -> np.ndarray:
    """Bytes that part words: 'blank' is \\x20 and \\x09-\\x0D; 'alnum' all ASCII but 0-9, A-Z, a-z."""
    sep = np.zeros(256, dtype=bool)
    if pattern == "blank":
        sep[[0x20, *range(0x09, 0x0E)]] = True
    elif pattern == "alnum":
        sep[:0x80] = True
        sep[0x30:0x3A] = sep[0x41:0x5B] = sep[0x61:0x7B] = False
    else:
        raise ValueError(pattern)
    return sep


class Words:
    """Words of some consecutive texts: byte bounds in ``data``, 64-bit hashes, and each text's first word in ``first``.

    Another ``seed`` gives other hashes; ``bits`` of them are kept.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, pattern: str, fold: bool, seed: int = 0, bits: int = 64) -> None:
        self.data = data
        n = len(data)
        word = ~separators(pattern)[data]
        fresh = np.zeros(n + 1, dtype=bool)
        fresh[offsets] = True
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = word[:-1]
        begins = word & (~before | fresh[:n])
        after = np.empty(n, dtype=bool)
        after[-1:] = False
        after[:-1] = word[1:]
        ends = word & (~after | fresh[1:])
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)  # one more than texts
        up, down = powers(_BYTE_BASE, n + 1)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(_byte_values(fold, seed)[data] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))
        for i in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            word = self.word(i).lower() if fold else self.word(i)
            self.hash[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=seed.to_bytes(8)).digest())
        if bits < 64:
            self.hash = self.hash >> U64(64 - bits)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def sums(self) -> np.ndarray:
        """Prefix sums from which ``span`` derives the hash of any run of words."""
        up, _ = powers(_WORD_BASE, len(self.hash) + 1)
        total = np.zeros(len(self.hash) + 1, dtype=U64)
        np.cumsum(self.hash * up[: len(self.hash)], out=total[1:])
        return total

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def span(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words from begin to end (exclusive); equal runs have equal hashes wherever they stand."""
    _, down = powers(_WORD_BASE, len(sums))
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; a null is as an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    if len(texts) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(texts: pa.Array | pa.ChunkedArray, pattern: str, fold: bool, seed: int = 0, bits: int = 64) -> Iterator[tuple[int, int, Words]]:
    """(first row, one past the last row, words) of pieces of a column of texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    raw, offsets = text_buffers(texts)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1
        to = min(max(to, at + 1), rows)
        part = offsets[at : to + 1]
        yield at, to, Words(raw[part[0] : part[-1]], part - part[0], pattern, fold, seed, bits)
        at = to
