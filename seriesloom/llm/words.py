"""Hashed words and word shingles of whole texts, in numpy.

A word is a run of anything but ASCII white space. Its hash is a polynomial over its UTF-8 bytes modulo 2^64, read off
prefix sums, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from seriesloom.llm.bloom import mixed

SLICE = 1 << 20                    # bytes handled at a time
_P = 0x9E3779B97F4A7C55            # odd, hence invertible modulo 2^64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def slices(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, list]]:
    """A text column as Python lists of few rows: (first row, texts)."""
    for i in range(0, len(column), rows):
        yield i, column.slice(i, rows).to_pylist()


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _P, np.uint64)
    down = np.full(n, pow(_P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _hash_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if len(raw) <= SLICE + (1 << 16):
        up, down = _powers(SLICE + (1 << 16) + 1)
    else:
        up, down = _powers.__wrapped__(len(raw) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((raw + np.uint64(1)) * up[:len(raw)], dtype=np.uint64)))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def hashed_words(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of whole texts: (numbers of the texts, offsets into the hashes, hashes of all words in order).

    Null and wordless texts appear with no words. Texts over SLICE bytes are hashed slice by slice, cut at white space.
    """
    block, size, first = [], 0, 0
    for i, text in enumerate([*texts, None]):
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        last = i == len(texts)
        if block and (last or size + len(data) > SLICE):
            sizes = np.fromiter((len(b) + 1 for b in block), np.int64, len(block))
            hashes, start = _hash_block(b"\n".join(block))
            yield np.arange(first, i), np.searchsorted(start, np.append(0, np.cumsum(sizes))), hashes
            block, size, first = [], 0, i
        if last:
            return
        if len(data) > SLICE:
            parts, at = [], 0
            while at < len(data):
                end = min(len(data), at + SLICE)
                while end < len(data) and not _SPACE[data[end]]:
                    end += 1
                parts.append(_hash_block(data[at:end])[0])
                at = end
            hashes = np.concatenate(parts)
            yield np.array([i]), np.array([0, len(hashes)]), hashes
            first = i + 1
        else:
            block.append(data)
            size += len(data) + 1


def shingles(offsets: np.ndarray, hashes: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of every run of ``width`` words; a shorter text is one shingle of all its words."""
    words = np.diff(offsets)
    count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    out = np.append(0, np.cumsum(count))
    text = np.repeat(np.arange(len(words)), count)
    at = offsets[:-1][text] + np.arange(out[-1]) - out[:-1][text]
    padded = np.concatenate((hashes, np.zeros(width, np.uint64)))
    have = words[text]
    total = np.minimum(have, width).astype(np.uint64)
    for k in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + np.where(k < have, padded[at + k], np.uint64(0))
    return out, mixed(total, 7)
