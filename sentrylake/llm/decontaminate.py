"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed (a run of MATCH words) are tiled: the longest run of words that both have,
unmarked in either, is marked as a tile, again and again until no run of MATCH words is left. Runs are found by Karp-Rabin
hashes rolled over the unmarked words, at search lengths that go down as in running Karp-Rabin. The share of the item's words
under tiles is its coverage; since tiles may lie anywhere, an item whose sentences were moved about is covered as well.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sentrylake.llm import tokens
from sentrylake.llm.work import ship

#: Least words of a tile, and the share of an item's words under tiles from which a document counts as contaminated.
MATCH, COVERAGE = 4, 0.5
#: Words of benchmark items that one pass holds in memory; a larger benchmark takes more passes over the documents.
PASS_WORDS = 2_000_000


def _windows(word: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of each run of width words."""
    n = len(word) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C55
    up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(word) - 1, base, np.uint64)]))
    down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(word) - 1, pow(base, -1, 1 << 64), np.uint64)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * up)])
    return (total[width:] - total[:n]) * down[:n]


def _free(marked: np.ndarray, width: int) -> np.ndarray:
    """Which runs of width words have no marked word."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return total[width:] == total[: len(marked) - width + 1]


def tiles(text: np.ndarray, item: np.ndarray, match: int = MATCH) -> list[tuple[int, int, int]]:
    """(place in text, place in item, words) of each tile, longest first, then by place in the item and in the text."""
    marked, taken, found = np.zeros(len(text), bool), np.zeros(len(item), bool), []
    width = min(len(text), len(item))
    while width >= match:
        here, there = _windows(text, width), _windows(item, width)
        here_at, there_at = np.flatnonzero(_free(marked, width)), np.flatnonzero(_free(taken, width))
        both = np.isin(there[there_at], here[here_at])
        if not both.any():
            width = _next_width(text, item, marked, taken, match, width)
            continue
        here_by: dict[int, list[int]] = {}
        wanted = set(there[there_at[both]].tolist())
        for i in here_at[np.isin(here[here_at], there[there_at[both]])].tolist():
            here_by.setdefault(int(here[i]), []).append(i)
        for j in there_at[both].tolist():
            if int(there[j]) not in wanted or taken[j : j + width].any():
                continue
            for i in here_by[int(there[j])]:
                if not marked[i : i + width].any() and (text[i : i + width] == item[j : j + width]).all():
                    marked[i : i + width] = taken[j : j + width] = True
                    found.append((i, j, width))
                    break
        width -= 1
    return found


def _next_width(text: np.ndarray, item: np.ndarray, marked: np.ndarray, taken: np.ndarray, match: int, above: int) -> int:
    """The length of the longest common unmarked run, found by bisection, which is below the given length; 0 if it's too short."""
    low, high = match - 1, above - 1
    while low < high:
        middle = (low + high + 1) // 2
        a, b = _windows(text, middle)[_free(marked, middle)], _windows(item, middle)[_free(taken, middle)]
        low, high = (middle, high) if np.isin(b, a).any() else (low, middle - 1)
    return low if low >= match else 0


class _Block:
    """Some items: their words, and the places of each seed, counted over the words of all items."""

    def __init__(self, rows: list[tuple], match: int):
        self.ids, self.match = [r[0] for r in rows], match
        data, offsets = tokens.raw(pa.array([r[1] for r in rows], pa.string()))
        doc, word = tokens.words(data, offsets)
        cut = np.searchsorted(doc, np.arange(len(rows) + 1))
        self.start, self.size = cut[:-1], np.diff(cut)
        self.words = [word[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        seed = _windows(word, match)
        place = np.flatnonzero(doc[: len(seed)] == doc[match - 1 :]) if len(seed) else np.zeros(0, np.int64)
        place = place[np.argsort(seed[place], kind="stable")]
        self.seed, self.place = seed[place], place

    def hits(self, seed: np.ndarray, coverage: float) -> np.ndarray:
        """Items that a text with these seeds may cover: tiles lie within the places of shared seeds, so no more than the words
        of those can be under tiles. A phrase that very many texts share thus calls for no tiling."""
        low, high = np.searchsorted(self.seed, seed, "left"), np.searchsorted(self.seed, seed, "right")
        n = high - low
        place = np.sort(self.place[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        item = np.searchsorted(self.start, place, "right") - 1
        step = np.full(len(place), self.match)
        step[:-1] = np.where(item[1:] == item[:-1], np.minimum(place[1:] - place[:-1], self.match), self.match)
        within = np.bincount(item, step, len(self.size))
        return np.flatnonzero((within > 0) & (within >= coverage * self.size))


def _blocks(benchmark: DataFrame, most_words: int) -> Iterator[list[tuple]]:
    """The items, in blocks of bounded size."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (3 * most_words)))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect() if size else []
        yield sorted((r["item_id"], r["text"]) for r in rows)


def _found(block: _Block, texts: pa.Array, match: int, coverage: float) -> Iterator[tuple[int, int, float, list]]:
    """(row, item, coverage, tiles) of each item that a text covers."""
    for i, j, data, offsets in tokens.chunks(texts):
        doc, word = tokens.words(data, offsets)
        seed = _windows(word, match)
        at = np.searchsorted(block.seed, seed)
        shared = np.flatnonzero(block.seed[np.minimum(at, max(len(block.seed) - 1, 0))] == seed) if len(block.seed) and len(seed) else np.zeros(0, np.int64)
        shared = shared[doc[shared] == doc[shared + match - 1]]
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        for row in np.unique(doc[shared]).tolist():
            a, b = cut[row], cut[row + 1]
            own = word[a:b]
            for item in block.hits(np.unique(seed[shared[(shared >= a) & (shared < b)]]), coverage).tolist():
                laid = tiles(own, block.words[item], match)
                share = sum(w for _, _, w in laid) / len(block.words[item])
                if share >= coverage:
                    yield i + row, item, share, laid


def contaminated(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest, tiles (place in the document, in the item, and words) of each document
    and item with at least that coverage.

    Words are lower-cased for A-Z. Null or empty texts match nothing; an item of fewer words than a tile can't be found, and
    one without an id isn't looked for. Ids may be of any type. Rows that repeat are found as often as they occur; null ids are carried. Other
    columns aren't read. Empty tables give no rows. The items, in blocks of bounded size, go to every task, so each block
    takes one pass over the texts and nothing is shuffled, however many documents an item is in.
    """
    ship(docs.sparkSession)
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, coverage double, n_tiles int, longest int, tiles array<struct<doc_at:int,item_at:int,words:int>>"
    out = None
    for rows in _blocks(benchmark, PASS_WORDS):

        def run(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            block = _Block(rows, match)
            for batch in batches:
                found = list(_found(block, batch.column(1), match, coverage))
                laid = pa.array([[{"doc_at": a, "item_at": b, "words": w} for a, b, w in x[3]] for x in found], pa.list_(pa.struct([("doc_at", pa.int32()), ("item_at", pa.int32()), ("words", pa.int32())])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([x[0] for x in found], pa.int64())), pa.array([block.ids[x[1]] for x in found], item_type), pa.array([x[2] for x in found], pa.float64()), pa.array([len(x[3]) for x in found], pa.int32()), pa.array([max(w for *_, w in x[3]) for x in found], pa.int32()), laid],
                    ["doc_id", "item_id", "coverage", "n_tiles", "longest", "tiles"],
                )

        part = docs.select("doc_id", "text").mapInArrow(run, kinds)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """docs, all its columns, without the rows whose text covers an item; rows with null or empty texts stay."""
    ship(docs.sparkSession)
    for rows in _blocks(benchmark, PASS_WORDS):

        def run(batches: Iterator[pa.RecordBatch], rows=rows, at=docs.columns.index("text")) -> Iterator[pa.RecordBatch]:
            block = _Block(rows, match)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in _found(block, batch.column(at), match, coverage)]] = False
                for i, j, *_ in tokens.chunks(batch.column(at)):  # what stays leaves Python in pieces, not as a second batch
                    yield batch.slice(i, j - i).filter(pa.array(keep[i:j]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
