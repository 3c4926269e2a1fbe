"""Word hashes of whole Arrow batches, without a loop over words.

A text is lower-cased (A-Z only) and cut at the ASCII white space 0x20 and 0x09-0x0D, on its UTF-8 bytes;
no byte of a longer character is in these ranges. A word's hash is a polynomial over random values of its
bytes modulo 2**64, so all words of a batch come from one running sum. Shingle hashes mix the hashes of
consecutive words the same way. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RANDOM = np.random.default_rng(20_240_131)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] | np.uint64(1)
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
#: Bytes of text that are worked on at once; a single longer text is taken whole.
SLICE_BYTES = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, SLICE_BYTES + 1), np.uint64)
        have[1:] = np.uint64(base)
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string array with about `limit` bytes each, so that memory stays bounded."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(sizes):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield start, end
        start = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts joined by one space, and len + 1 offsets: text i is bytes[offsets[i] : offsets[i+1] - 1]."""
    values = [t.as_buffer() if t.is_valid else b"" for t in texts.cast(pa.large_binary())]
    data = np.frombuffer(b" ".join([*values, b""]), np.uint8)
    sizes = np.fromiter((len(v) for v in values), np.int64, len(values)) + 1
    return data, np.concatenate(([0], np.cumsum(sizes)))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and len + 1 offsets into them by text."""
    data, offsets = text_bytes(texts)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = IS_SPACE[data]
    edges = np.flatnonzero(np.diff(space, prepend=True))  # word start, word end, word start, ...
    starts, ends = edges[0::2], edges[1::2]
    terms = BYTE_VALUES[data] * powers(BASE, len(data))
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    hashes = mix((running[ends] - running[starts]) * powers(BASE_INVERSE, len(data) + 1)[starts])
    return hashes, np.searchsorted(starts, offsets)


def runs_of(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words; empty if there are fewer."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(BASE)
        out += words[k : len(words) - n + 1 + k]
    return mix(out)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer than n words the whole sequence is the one shingle."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(runs_of(words, min(n, len(words))))
