"""Where any of many fixed patterns stand in texts: one automaton for the whole catalogue, run once over each text."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

#: An automaton of more cells (states by letters, four bytes each) isn't given to tasks; its patterns are joined instead.
MOST_CELLS = 8_000_000
#: Texts are walked in pieces of so many characters, many pieces at a time, in a matrix of at most so many cells.
PIECE, MATRIX = 2048, 4_000_000
FLUSH = 65_536


class Automaton:
    """Goto table (complete: failures are followed in advance), and for each state the pattern that ends there and the next
    shorter state at which one ends. Patterns are distinct and not empty."""

    def __init__(self, patterns: list[str], letters: str):
        self.patterns, self.longest = patterns, max(map(len, patterns))
        self.alphabet = np.array(sorted(map(ord, letters)), np.uint32)
        code = {chr(c): i + 1 for i, c in enumerate(self.alphabet.tolist())}
        children, ends, depth_of = [{}], [-1], [0]
        for nth, pattern in enumerate(patterns):
            at = 0
            for letter in pattern:
                step = children[at].get(code[letter])
                if step is None:
                    step = children[at][code[letter]] = len(children)
                    children.append({})
                    ends.append(-1)
                    depth_of.append(depth_of[at] + 1)
                at = step
            ends[at] = nth
        self.ends = np.array(ends, np.int32)
        self.table = np.zeros((len(children), len(code) + 1), np.int32)
        fail = np.zeros(len(children), np.int32)
        self.shorter = np.zeros(len(children), np.int32)
        for at in sorted(range(len(children)), key=depth_of.__getitem__):
            back = fail[at]
            if at:
                self.table[at] = self.table[back]
                self.shorter[at] = back if ends[back] >= 0 else self.shorter[back]
            for letter, step in children[at].items():
                fail[step] = self.table[back, letter] if at else 0
                self.table[at, letter] = step
        self.speaks = (self.ends >= 0) | (self.shorter > 0)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == points
        return np.where(known, at + 1, 0).astype(np.uint16 if len(self.alphabet) < 65_535 else np.int32)

    def hits(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays of the text's number, the pattern's number and the first character from 1, piece by piece."""
        pieces = []
        for row, text in enumerate(texts):
            whole = self.codes(text or "")
            for own in range(0, len(whole), PIECE):
                start = max(0, own - self.longest + 1)
                pieces.append((row, start, own - start, whole[start : own + PIECE]))
        pieces.sort(key=lambda p: -len(p[3]))
        while pieces:
            n = max(1, MATRIX // len(pieces[0][3]))
            yield from self._walk(pieces[:n])
            pieces = pieces[n:]

    def _walk(self, pieces: list[tuple[int, int, int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rows, starts, own = (np.array([p[k] for p in pieces], np.int64) for k in range(3))
        lengths = np.array([len(p[3]) for p in pieces])
        matrix = np.zeros((lengths[0], len(pieces)), pieces[0][3].dtype)
        for k, piece in enumerate(pieces):
            matrix[: len(piece[3]), k] = piece[3]
        state = np.zeros(len(pieces), np.int32)
        for at in range(lengths[0]):
            live = int(np.searchsorted(-lengths, -at, "left"))
            state[:live] = self.table[state[:live], matrix[at, :live]]
            who = np.flatnonzero(self.speaks[state[:live]] & (own[:live] <= at))
            found = state[who]
            while len(who):
                ending = self.ends[found] >= 0
                nth = self.ends[found[ending]]
                if len(nth):
                    yield rows[who[ending]], nth, starts[who[ending]] + at + 2 - self.sizes[nth]
                found = self.shorter[found]
                who, found = who[found > 0], found[found > 0]

    @property
    def sizes(self) -> np.ndarray:
        if not hasattr(self, "_sizes"):
            self._sizes = np.array([len(p) for p in self.patterns], np.int64)
        return self._sizes


def occurrences(rows: DataFrame, patterns: DataFrame, key: str, text: str, pattern: str = "pattern", most_cells: int = MOST_CELLS) -> DataFrame:
    """(key, pattern, at) for each place, overlapping ones too, at which a pattern stands in a row's text, by code points from 1.

    Case counts. Patterns that repeat count once; null and empty ones, and null texts, have no places. Rows are told apart by
    key alone, so a key that repeats has the places of all its rows. The work of a text doesn't grow with the number of patterns
    but by what is found. A catalogue whose automaton would pass most_cells isn't held by tasks: its patterns are joined to the
    windows of their lengths.
    """
    known = patterns.select(F.col(pattern).alias("pattern")).where("pattern IS NOT NULL AND pattern <> ''").distinct()
    letters = known.select(F.explode(F.split("pattern", "")).alias("c")).where("c <> ''").distinct()
    sized = known.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("n")).first()["n"]
    if sized > most_cells // 2 or (sized + 1) * (letters.count() + 1) > most_cells:
        return _by_windows(rows, known, key, text)
    schema = StructType([rows.schema[key], *StructType().add("pattern", StringType()).add("at", LongType())])
    listed = sorted(r[0] for r in known.collect())  # bounded by most_cells
    if not listed:
        return rows.sparkSession.createDataFrame([], schema)
    held = rows.sparkSession.sparkContext.broadcast(Automaton(listed, "".join(sorted(set("".join(listed))))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = held.value
        names = pa.array(auto.patterns)
        for batch in batches:
            kept, size = [], 0
            for hit in auto.hits(batch.column(1).to_pylist()):
                kept.append(hit)
                size += len(hit[0])
                if size >= FLUSH:
                    yield _placed(batch, names, kept)
                    kept, size = [], 0
            if kept:
                yield _placed(batch, names, kept)

    return rows.select(key, F.col(text).alias("_text")).where("_text IS NOT NULL").mapInArrow(scan, schema)


def _placed(batch: pa.RecordBatch, names: pa.Array, hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    row, nth, at = (np.concatenate([h[k] for h in hits]) for k in range(3))
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), names.take(pa.array(nth)), pa.array(at, pa.int64())], [batch.schema.names[0], "pattern", "at"])


def _by_windows(rows: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """The same by a join: each text's windows of the patterns' lengths, cut from pieces so that no window is sought from afar."""
    lengths = known.agg(F.sort_array(F.collect_set(F.length("pattern"))).alias("sizes"), F.max(F.length("pattern")).alias("longest"))
    starts = F.sequence(F.lit(0), F.greatest(F.length("_text") - 1, F.lit(0)), F.lit(PIECE))
    cut = rows.select(key, F.col(text).alias("_text")).where("_text <> ''").crossJoin(F.broadcast(lengths))  # one row of lengths
    cut = cut.select(key, "sizes", F.posexplode(F.transform(starts, lambda s: F.substr("_text", s + 1, F.lit(PIECE) + F.col("longest") - 1))).alias("nth", "piece"))
    own = lambda n: F.least(F.lit(PIECE), F.length("piece") - n + 1)
    windows = lambda n: F.when(own(n) >= 1, F.transform(F.sequence(F.lit(1), own(n)), lambda i: F.struct(i.alias("i"), F.substr("piece", i, n).alias("pattern"))))
    out = cut.select(key, "nth", "piece", F.explode("sizes").alias("n")).select(key, "nth", F.explode(windows(F.col("n"))).alias("w"))
    return out.select(key, "w.pattern", (F.col("nth").cast("long") * PIECE + F.col("w.i")).alias("at")).join(known, "pattern").select(key, "pattern", "at")
