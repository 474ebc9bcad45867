"""Words of Arrow text columns as numpy arrays: whole batches at a time, no Python object for a word.

A word is a run of bytes other than space and TAB to CR. Hashes are polynomial over the bytes, modulo 2**64, finished by a
mixing step; they're the same in every process.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
CHUNK_ROWS = 2048

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C55)
_BACK = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _BACK)]
    return _powers[0], _powers[1]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, at, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def chunks(texts: pa.Array, most_bytes: int = CHUNK_BYTES, most_rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets), in pieces of bounded size; only a single longer text exceeds it."""
    body, offsets = raw(texts)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1
        j = min(max(j, i + 1), i + most_rows, n)
        yield i, j, body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first byte and byte after the last of each word."""
    solid = ~WHITE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    heads, ends = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
    first[heads] |= solid[heads]
    last[ends] |= solid[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each lower-cased word."""
    doc, start, end = spans(data, offsets)
    return doc, hashes(LOWER[data], start, end)


def shingles(doc: np.ndarray, word: np.ndarray, docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each run of width words; a document of fewer words has one, of all its words."""
    counts = np.bincount(doc, minlength=docs)
    starts = np.concatenate([[0], np.cumsum(counts)])
    n, turn = len(word), np.uint64(0xC2B2AE3D27D4EB4F)
    total, padded = np.zeros(n, np.uint64), np.concatenate([word, np.zeros(width, np.uint64)])
    left = starts[doc + 1] - np.arange(n)
    for k in range(width):
        total = total * turn + np.where(left > k, padded[k : k + n], np.uint64(0))
    at = np.arange(n) - starts[doc]
    size = counts[doc]
    keep = (at + width <= size) | ((size < width) & (at == 0))
    return doc[keep], mixed(total[keep] + np.minimum(size[keep], width).astype(np.uint64))
