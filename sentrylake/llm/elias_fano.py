"""Monotone integer sequences in Elias-Fano form, and the memory-mapped files that hold them."""

import json
import os
import tempfile
import uuid

import numpy as np

BLOCK = 512
#: Queries that are worked on at a time, so that they stay in the cache.
PIECE = 1 << 14


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low width bits of each value, one after the other, as 64-bit words: 64 values fill width words, place by place."""
    n, mask = len(values), np.uint64((1 << width) - 1)
    rows = np.zeros((-(-n // 64), 64), np.uint64)
    rows.reshape(-1)[:n] = values & mask
    out = np.zeros((len(rows), width), np.uint64)
    for k in range(64 if width else 0):
        word, bit = divmod(k * width, 64)
        out[:, word] |= rows[:, k] << np.uint64(bit)
        if bit + width > 64:
            out[:, word + 1] |= rows[:, k] >> np.uint64(64 - bit)
    return np.concatenate([out.reshape(-1)[: -(-n * width // 64)], np.zeros(2, np.uint64)])


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the Elias-Fano form of a sorted uint64 sequence."""
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    high = (values >> np.uint64(width)).astype(np.int64)
    size = n + (int(high[-1]) if n else 0) + 1
    upper = np.zeros(-(-size // BLOCK) * BLOCK, np.uint8)
    upper[high + np.arange(n)] = 1
    ones = np.concatenate([[0], np.cumsum(upper.reshape(-1, BLOCK).sum(1, dtype=np.int64))])
    return {"n": np.array([n, width], np.int64), "low": _low(values, width), "upper": np.packbits(upper, bitorder="little"), "ones": ones}


def _low(values: np.ndarray, width: int) -> np.ndarray:
    step, parts = 1 << 15, []  # so many values fill whole words
    for i in range(0, len(values), step):
        words = _packed(values[i : i + step], width)
        parts.append(words[: step * width // 64] if i + step < len(values) else words)
    return np.concatenate(parts) if parts else np.zeros(2, np.uint64)


_SELECT = np.full((256, 8), 8, np.uint8)
for _byte in range(256):
    _set = [b for b in range(8) if _byte >> b & 1]
    _SELECT[_byte, : len(_set)] = _set


#: Bits from each one bit of a byte to the next; 0 where it's the last.
_NEXT = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _set = [b for b in range(8) if _byte >> b & 1]
    for _a, _b in zip(_set, _set[1:]):
        _NEXT[_byte, _a] = _b - _a


def _unpacked(low: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), np.uint64)
    bit = i.astype(np.uint64) * np.uint64(width)
    word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    value = low[word] >> shift
    value |= np.where(shift > 0, low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    return value & np.uint64((1 << width) - 1)


def packed(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the values in as few bits each as the largest needs."""
    width = int(values.max()).bit_length() if len(values) else 0
    return {"n": np.array([len(values), width], np.int64), "low": _low(values, width)}


class Packed:
    """Values in runs, each run sorted: access and search within runs."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in arrays["n"])
        self.low = arrays["low"]

    def access(self, i: np.ndarray) -> np.ndarray:
        return _unpacked(self.low, self.width, i)

    def find(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Index of each value among those from first up to last, or -1: a successor search within each run."""
        out = np.full(len(x), -1, np.int64)
        for i in range(0, len(x), PIECE):
            self._find(x[i : i + PIECE], first[i : i + PIECE], last[i : i + PIECE], out[i : i + PIECE])
        return out

    def _find(self, x: np.ndarray, low: np.ndarray, last: np.ndarray, out: np.ndarray) -> None:
        at = np.flatnonzero(low < last)
        x, low, last = x[at], low[at], last[at]
        high = last
        while len(at):
            middle = (low + high) >> 1
            less = (self.access(middle) < x) & (low < high)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
            done = low >= high
            if 4 * np.count_nonzero(done) >= len(at):
                place, want = low[done], x[done]
                hit = np.flatnonzero((place < last[done]) & (self.access(place) == want))
                out[at[done][hit]] = place[hit]
                more = ~done
                at, x, low, high, last = at[more], x[more], low[more], high[more], last[more]


_EACH, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_ODD, _PAIRS, _HALF = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)


def _in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one bit of each word: the ones up to each byte, in its bytes, are compared with k at once."""
    n = word - ((word >> np.uint64(1)) & _ODD)
    n = (n & _PAIRS) + ((n >> np.uint64(2)) & _PAIRS)
    upto = ((n + (n >> np.uint64(4))) & _HALF) * _EACH
    byte = ((((((k * _EACH) | _TOP) - upto) & _TOP) >> np.uint64(7)) * _EACH) >> np.uint64(56)
    shift = byte << np.uint64(3)
    left = k - (((upto << np.uint64(8)) >> shift) & np.uint64(255))
    return shift.astype(np.int64) + _SELECT[((word >> shift) & np.uint64(255)).astype(np.int64), left.astype(np.int64)]


class EliasFano:
    """Search and access by numpy arrays of queries; the arrays may be memory-mapped."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in arrays["n"])
        self.low, self.upper, self.ones = arrays["low"], arrays["upper"].reshape(-1, BLOCK // 8), arrays["ones"]
        self.words = self.upper.view(np.uint64)
        self.inner = np.zeros(self.words.shape, np.int16)  # ones of a block before each word
        np.cumsum(np.bitwise_count(self.words[:, :-1]), axis=1, out=self.inner[:, 1:])
        self.zeros = np.arange(len(self.ones)) * BLOCK - self.ones
        self.highest = len(self.upper) * BLOCK - self.n - 1

    def _select(self, k: np.ndarray, before: np.ndarray, flip: int) -> np.ndarray:
        """Place of the k-th (from 0) one, or zero, in the upper bits."""
        out = np.empty(len(k), np.int64)
        for i in range(0, len(k), PIECE):
            part = k[i : i + PIECE]
            block = np.searchsorted(before, part, "right") - 1
            left = part - before[block]
            word = np.zeros(len(part), np.int64)
            for step in (4, 2, 1):
                ones = self.inner[block, word + step]
                word += step * ((ones if flip == 0 else (word + step) * 64 - ones) <= left)
            ones = self.inner[block, word]
            left -= ones if flip == 0 else word * 64 - ones
            bits = self.words[block, word]
            out[i : i + PIECE] = block * BLOCK + word * 64 + _in_word(bits if flip == 0 else ~bits, left.astype(np.uint64))
        return out

    def _lows(self, i: np.ndarray) -> np.ndarray:
        return _unpacked(self.low, self.width, i)

    def ranges(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values i and i + 1 of a sequence of pointers. The next one bit is mostly in the same byte as the last."""
        at = self._select(i, self.ones, 0)
        byte, bit = np.divmod(at, 8)
        step = _NEXT[self.upper.reshape(-1)[byte], bit]
        after = at + step
        far = np.flatnonzero(step == 0)
        if len(far):
            after[far] = self._select(i[far] + 1, self.ones, 0)
        value = lambda place, k: ((place - k).astype(np.uint64) << np.uint64(self.width)) | self._lows(k)
        return value(at, i).astype(np.int64), value(after, i + 1).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, self.ones, 0) - i).astype(np.uint64) << np.uint64(self.width)) | self._lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value, or -1."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        high = (x >> np.uint64(self.width)).astype(np.int64)
        inside = high <= self.highest
        high = np.minimum(high, self.highest)
        end = self._select(high, self.zeros, 255) - high
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, 255) - high + 1, 0)
        want = x & np.uint64((1 << self.width) - 1)
        low, size = start.copy(), end.copy()
        for _ in range(int((end - start).max(initial=0)).bit_length()):
            middle = (low + size) // 2
            less = (low < size) & (self._lows(np.minimum(middle, self.n - 1)) < want)
            size = np.where((low < size) & ~less, middle, size)
            low = np.where(less, middle + 1, low)
        hit = inside & (low < end) & (self._lows(np.minimum(low, self.n - 1)) == want)
        return np.where(hit, low, -1)


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays, put in place at once, so that a task that is run again does no harm."""
    head, body, at = {}, [], 0
    for name, x in arrays.items():
        x = np.ascontiguousarray(x)
        head[name] = [x.dtype.str, len(x), at]
        body.append(x.tobytes() + b"\0" * (-x.nbytes % 8))
        at += len(body[-1])
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    data = b"".join([len(text).to_bytes(8, "little"), text, *body])
    if path.startswith("file:"):
        own = "/" + path[5:].lstrip("/")
        os.makedirs(os.path.dirname(own), exist_ok=True)
        with open(f"{own}.{uuid.uuid4().hex}", "wb") as f:
            f.write(data)
        os.replace(f.name, own)
    else:
        from pyarrow import fs

        system, own = fs.FileSystem.from_uri(path)
        system.create_dir(os.path.dirname(own))
        with system.open_output_stream(own) as f:
            f.write(data)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped from the shared folder, or from a local copy where that can't be mapped."""
    if path.startswith("file:"):
        own = "/" + path[5:].lstrip("/")
    else:
        from pyarrow import fs

        system, there = fs.FileSystem.from_uri(path)
        # a copy that goes with the last array that is mapped from it
        with system.open_input_file(there) as f, tempfile.TemporaryFile() as g:
            while block := f.read(1 << 22):
                g.write(block)
            g.flush()
            data = np.memmap(g, np.uint8, "r")
        return _arrays_of(data)
    return _arrays_of(np.memmap(own, np.uint8, "r"))


def _arrays_of(data: np.ndarray) -> dict[str, np.ndarray]:
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    return {name: np.frombuffer(data, np.dtype(kind), n, 8 + size + at) for name, (kind, n, at) in head.items()}
