"""Token counts of a byte-fallback BPE vocabulary by heap-and-linked-list merging; no identifiers are made."""

import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.work import ship

#: Words whose counts a worker keeps; the table starts anew when full, so memory is bounded and results don't change.
REMEMBERED = 1_000_000
NORMAL = 1


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 2:
            n, at = _varint(data, at)
            yield key >> 3, data[at : at + n]
            at += n
        elif key & 7 == 0:
            value, at = _varint(data, at)
            yield key >> 3, value
        else:
            width = 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + width]
            at += width


def load_ranks(model: bytes) -> dict[str, int]:
    """Rank by piece, best first, of the model's ordinary pieces; the file lists merges in the order of their scores."""
    found = []
    for number, body in _fields(model):
        if number == 1:
            piece = dict(_fields(body))
            if piece.get(3, NORMAL) == NORMAL:
                found.append((-struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece[1].decode()))
    best = {score: rank for rank, score in enumerate(sorted({s for s, _ in found}))}
    return {piece: best[score] for score, piece in found}


def count_symbols(text: str, ranks: dict[str, int]) -> int:
    """Initial symbols (a character of the vocabulary is one, any other one for each of its bytes) minus merges."""
    n = len(text)
    symbols, get = list(text), ranks.get
    count = n if ranks.keys() >= set(symbols) else sum(1 if c in ranks else len(c.encode("utf-8", "surrogatepass")) for c in symbols)
    heap = [(r, i, 2) for i, r in enumerate(map(get, map(add, symbols, symbols[1:]))) if r is not None]
    if not heap:
        return count
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        r, i, width = heappop(heap)
        left = symbols[i]
        if not left:
            continue
        j = after[i]
        if j >= n or len(left) + len(symbols[j]) != width:
            continue
        pair = left + symbols[j]
        if get(pair) != r:
            continue
        symbols[i], symbols[j] = pair, ""
        count -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            new = pair + symbols[k]
            r = get(new)
            if r is not None:
                heappush(heap, (r, i, len(new)))
        h = before[i]
        if h >= 0:
            new = symbols[h] + pair
            r = get(new)
            if r is not None:
                heappush(heap, (r, h, len(new)))
    return count


class Counter:
    """Counts whole texts. No piece has a word-start mark after another character, so merges stay within the words that
    start at such marks, and each distinct word is merged once while it's remembered."""

    def __init__(self, model: bytes):
        self.ranks, self.known = load_ranks(model), {}
        alone = "" if any("\n" in p for p in self.ranks) else "\n"
        self.units = re.compile(f"▁+[^▁{alone}]*|[^▁{alone}]+" + (f"|{alone}" if alone else ""))
        if any("▁" in p.lstrip("▁") for p in self.ranks):
            self.units = re.compile(r"(?s).+")

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        known, ranks = self.known, self.ranks
        total = 0
        for unit in self.units.findall("▁" + text.replace(" ", "▁")):
            n = known.get(unit)
            if n is None:
                n = count_symbols(unit, ranks)
                if len(unit) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[unit] = n
            total += n
        return total


_counters: dict[bytes, Counter] = {}


def _counter(model: bytes) -> Counter:
    if model not in _counters:
        _counters.clear()
        _counters[model] = Counter(model)
    return _counters[model]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than limit) of each whole text.

    A null text counts as empty, with 0 tokens. Equal rows give equal rows; null ids stay null; other columns are left
    out. The vocabulary (0.5 MB, fixed) goes to the executors inside the task; rows aren't shuffled. A text of one long
    word is merged in n log n steps.
    """
    ship(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([count(t) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
