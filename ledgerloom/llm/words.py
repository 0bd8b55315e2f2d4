"""Words and their hashes inside a task, whole batches at a time. A word is a run of bytes
outside [\\x20\\x09-\\x0D]; its hash is 64 bits wide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes hashed at a time; arrays of eight times this size stay in a processor's cache.
CHUNK = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values; every bit of the result depends on every bit given."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_FOLDED = _BYTES[np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))]
_places = mixed(np.arange(1, 1 + CHUNK, dtype=np.uint64)) | np.uint64(1)


def _factors(n: int) -> np.ndarray:
    global _places
    if n > len(_places):
        _places = mixed(np.arange(1, 1 + 2 * n, dtype=np.uint64)) | np.uint64(1)
    return _places


def _hashed(data: np.ndarray, fold: bool, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    inside = ~gaps[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start
    length = end - start
    first = np.cumsum(length) - length
    values = (_FOLDED if fold else _BYTES)[data[inside]]
    values *= _factors(int(length.max()))[np.arange(len(values)) - np.repeat(first, length)]
    return mixed(np.add.reduceat(values, first) + length.astype(np.uint64) * GOLDEN), start


def _long_text(raw: bytes, fold: bool, gaps: np.ndarray) -> np.ndarray:
    """One text by pieces that end where a word ends."""
    parts, at = [], 0
    data = np.frombuffer(raw, np.uint8)
    while at < len(data):
        to = min(len(data), at + CHUNK)
        while to < len(data) and not gaps[data[to]]:
            white = np.flatnonzero(gaps[data[to:to + CHUNK]])
            to += int(white[0]) if len(white) else min(CHUNK, len(data) - to)
        parts.append(_hashed(data[at:to], fold, gaps)[0])
        at = to
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def hashed_words(texts: list[bytes], fold: bool = False, gaps: np.ndarray = _WHITE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: number of the first one, the hashes of their words one text after the other,
    and the offsets at which each text's words begin and the last one's end. fold: A-Z count as a-z.
    gaps: which of the 256 bytes stand between words, the blank among them."""
    i = 0
    while i < len(texts):
        size, j = len(texts[i]), i + 1
        if size > CHUNK:
            hashes = _long_text(texts[i], fold, gaps)
            yield i, hashes, np.array([0, len(hashes)])
            i = j
            continue
        while j < len(texts) and size + len(texts[j]) + 1 <= CHUNK:
            size += len(texts[j]) + 1
            j += 1
        begin = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
        hashes, start = _hashed(np.frombuffer(b" ".join(texts[i:j]), np.uint8), fold, gaps)
        yield i, hashes, np.searchsorted(start, begin)
        i = j


def windows(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """One 64-bit hash for each run of `width` consecutive words; none if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    keys = mixed((np.arange(width, dtype=np.uint64) + np.uint64(1 + 1000 * seed)) * GOLDEN) | np.uint64(1)
    total = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        total += hashes[k:k + n] * keys[k]
        total ^= total >> np.uint64(29)
    return mixed(total)
