"""Words of UTF-8 texts as 64-bit hashes, for whole Arrow batches at a time.

A word's hash is the sum of a random number per byte times a power of an odd base, brought back to the word's start, then mixed. It
depends on the word's bytes alone, so it is the same in every batch, task and run. Bytes are handled SPAN at a time, cut between
words, so memory doesn't follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are handled at once.
SPAN = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for at least n bytes."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SPAN + 4096)
        steps = [np.full(size, b, dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for s in steps:
            s[0] = 1
        _powers = tuple(np.cumprod(s, dtype=np.uint64) for s in steps)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(outside) -> np.ndarray:
    """Which of the 256 byte values belong to words: all but those in the ranges `outside`."""
    inside = np.ones(256, dtype=bool)
    for low, high in outside:
        inside[low : high + 1] = False
    return inside


#: Bytes between words, for words cut at white space and for words of letters, digits and non-ASCII characters.
SPACED = byte_table([(0x20, 0x20), (0x09, 0x0D)])
ALPHANUMERIC = byte_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Lines as words: all but the line feed.
LINES = byte_table([(0x0A, 0x0A)])


def located(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in data, letters as they are."""
    return marked(data, inside[data])


def marked(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs of bytes of data for which `inside` holds, letters as they are."""
    flags = np.zeros(len(data) + 2, dtype=np.int8)
    flags[1:-1] = inside
    change = np.diff(flags)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    own = (sums[ends] - sums[starts]) * inverse[starts]
    return starts, ends, mixed(own + (ends - starts).astype(np.uint64))


def every(data: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words of data, letters as they are, whatever its length."""
    if len(data) <= SPAN:
        return located(np.frombuffer(data, dtype=np.uint8), inside)
    parts, at = ([], [], []), 0
    whole = np.frombuffer(data, dtype=np.uint8)
    while at < len(whole):
        end = min(at + SPAN, len(whole))
        while end < len(whole) and inside[whole[end]]:  # to the end of the word
            gap = np.flatnonzero(~inside[whole[end : end + SPAN]])
            end = end + int(gap[0]) if len(gap) else min(end + SPAN, len(whole))
        starts, ends, words = located(whole[at:end], inside)
        for kept, new in zip(parts, (starts + at, ends + at, words)):
            kept.append(new)
        at = end
    return tuple(np.concatenate(x) for x in parts)


def hashes(data: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and hashes of all words of data, A-Z in lower case."""
    return every(data.lower(), inside)[::2]  # of bytes, lower() changes A-Z alone


def runs(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive texts of at most SPAN bytes together, or one longer text: the index of the first, and the texts in UTF-8
    (null: empty). Only one run is held as Python objects."""
    n, i = len(texts), 0
    texts = texts.cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]) if n else np.zeros(0, dtype=np.int64)
    while i < n:
        j, total = i + 1, int(sizes[i])
        while j < n and total + sizes[j] + 1 <= SPAN:
            total += int(sizes[j]) + 1
            j += 1
        yield i, [b"" if t is None else t for t in texts[i:j].to_pylist()]
        i = j


def by_text(texts: pa.Array, inside: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For runs of consecutive texts: the index of the first, and the word hashes of each. Short texts are hashed together."""
    for first, parts in runs(texts):
        starts, words = hashes(b"\n".join(parts), inside)
        cuts = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))
        yield first, np.split(words, cuts[:-1])


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-word shingles as sorted 64-bit hashes; fewer words make one shingle; no words make none."""
    if not len(words):
        return words
    k = min(n, len(words))
    out = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        out = mixed(out * np.uint64(0xD1342543DE82EF95) + words[i : len(words) - k + 1 + i])
    return np.unique(mixed(out + np.uint64(k)))
