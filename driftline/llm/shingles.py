"""Word shingles of texts as 64-bit hashes, computed for many texts at once.

Words are the runs of bytes that are no white space (0x20, 0x09-0x0D), A-Z in lower case. A word's hash is a polynomial
over its bytes with random coefficients, a shingle's a polynomial over its words, both modulo 2^64 and mixed at the end. Different
shingles are taken for equal with a chance of about 2^-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: words of a shingle
SIZE = 5
#: bytes that are hashed at once; one longer text is a block of its own
BLOCK_BYTES = 4_000_000

_random = np.random.default_rng(7)
_BYTES = _random.integers(0, 1 << 64, 256, np.uint64)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    """The first powers of the base."""
    global _powers
    if n > len(_powers):
        size = max(n, 64, 2 * len(_powers))
        table = np.full(size, _BASE, np.uint64)
        table[0] = 1
        _powers = np.cumprod(table, dtype=np.uint64)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and the number of words of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    lengths = ends - starts
    counts = np.bincount(np.searchsorted(np.cumsum(sizes), starts, side="right"), minlength=len(raw))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    first = np.cumsum(lengths) - lengths
    places = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = _BYTES[data[inside]] * _power(int(lengths.max()))[places]
    return mix(np.add.reduceat(values, first)), counts


def of_words(hashes: np.ndarray, counts: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts by place, and the number of each; a text of fewer words has its whole sequence as one."""
    total = len(hashes)
    starts = np.cumsum(counts) - counts
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    weights = mix(np.arange(1, size + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    sums = np.zeros(total, np.uint64)
    for k in range(size):
        sums += padded[k:k + total] * weights[k]
    owner = np.repeat(np.arange(len(counts)), made)
    at = np.repeat(starts - (np.cumsum(made) - made), made) + np.arange(len(owner))
    shingles = mix(sums[at]) if len(at) else np.zeros(0, np.uint64)
    ends = np.cumsum(made)
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        n = int(counts[i])
        whole = hashes[starts[i]:starts[i] + n] * weights[:n]
        shingles[ends[i] - 1] = mix(np.array([whole.sum(dtype=np.uint64) + np.uint64(n)]))[0]
    return shingles, made


def blocks(texts: list[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def sets(texts: list[str | None], size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    out = []
    for start, stop in blocks(texts):
        shingles, made = of_words(*words(texts[start:stop]), size)
        cuts = np.cumsum(made)
        out += [np.unique(part) for part in np.split(shingles, cuts[:-1])]
    return out
