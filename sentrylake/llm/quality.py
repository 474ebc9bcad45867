"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document, softmax output.

Training is numpy stochastic gradient descent on a bounded, seeded sample of labelled rows. Once trained, the model is
linear in the average, so each hashed feature comes down to one number: a document's score is the logistic function of the
mean of its features' numbers plus a bias. That is what executors apply to whole texts, in batches.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from sentrylake.llm import tokens
from sentrylake.llm.work import ship

BUCKETS, WIDTHS, DIM = 1 << 17, (3, 4), 8
#: The bound on labelled rows that a model is fitted on.
TRAIN_ROWS = 4000
EPOCHS, RATE = 4, 10.0
#: Bytes of text whose features are held at once: they take many times as much memory, which a worker doesn't give back.
PIECE_BYTES = 1 << 16
#: Score from which a document is kept.
KEPT = 0.3


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text modulo parts; an id that is null has none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document and bucket of each feature: words, words that repeat the one before, and runs of 3 and 4 bytes that lie in a
    word or reach one byte past its ends. Case and punctuation count."""
    doc, start, end = tokens.spans(data, offsets)
    word = tokens.hashes(data, start, end)
    again = np.flatnonzero((word[1:] == word[:-1]) & (doc[1:] == doc[:-1])) + 1 if len(word) else np.zeros(0, np.int64)
    yield doc, (word >> np.uint64(40)).astype(np.int64) % BUCKETS
    yield doc[again], np.full(len(again), 1, np.int64)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    white = np.concatenate([[0], np.cumsum(tokens.WHITE[data])])
    up, down = tokens.powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((np.where(tokens.WHITE[data], 32, data).astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    for width in WIDTHS:
        n = len(data) - width + 1
        if n < 1:
            continue
        at = np.flatnonzero((white[width - 1 : width - 1 + n] == white[1 : n + 1]) & (of[:n] == of[width - 1 :]))
        h = (total[at + width] - total[at]) * down[at]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(width)
        yield of[at], (h >> np.uint64(47)).astype(np.int64) % BUCKETS


@dataclass
class Model:
    weights: np.ndarray  # of each bucket
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        return np.concatenate([np.empty(0), *(score for *_, score in self.pieces(texts))])

    def pieces(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, row after the last, scores), in pieces of bounded size."""
        for i, j, data, offsets in tokens.chunks(texts, PIECE_BYTES):
            total, count = np.zeros(j - i), np.zeros(j - i)
            for doc, bucket in features(data, offsets):
                total += np.bincount(doc, self.weights[bucket], j - i)
                count += np.bincount(doc, minlength=j - i)
            yield i, j, 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def train(texts: list[str | None] | pa.Array, labels: list[int], seed: int = 7) -> Model:
    """Softmax over averaged vectors, by stochastic gradient descent. Without rows of both labels the score
    is the share of label 1, or 0.5 where there are no rows."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        share = min(max(y.mean() if len(y) else 0.5, 0.01), 0.99)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    # a text of b bytes has less than 3 * b features; of this room only what is filled takes memory, and all of it is given back
    room = int(np.minimum(3 * np.diff(tokens.raw(texts)[1]), BUCKETS).sum())
    bucket, share, cut = np.empty(room, np.int32), np.empty(room, np.float32), np.zeros(len(y) + 1, np.int64)
    for i, j, data, offsets in tokens.chunks(texts, PIECE_BYTES):
        doc, own = (np.concatenate(x) for x in zip(*features(data, offsets), strict=True))
        both, count = np.unique(doc * BUCKETS + own, return_counts=True)
        doc = both // BUCKETS
        n = np.bincount(doc, count, j - i)
        cut[i + 1 : j + 1] = cut[i] + np.cumsum(np.bincount(doc, minlength=j - i))
        bucket[cut[i] : cut[j]], share[cut[i] : cut[j]] = both % BUCKETS, count / n[doc]
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32), np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    steps, step = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for row in rng.permutation(len(y)).tolist():
            rate = 1 - step / steps
            step += 1
            picked, part = bucket[cut[row] : cut[row + 1]], share[cut[row] : cut[row + 1]]  # no bucket twice
            held = vectors[picked]
            mean = part @ held
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[row]] -= 1
            vectors[picked] = held - np.outer(part * np.float32(RATE * rate), out @ p)
            out -= np.float32(0.2 * rate) * np.outer(mean, p)
            bias -= np.float32(0.01 * rate) * p
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = TRAIN_ROWS, folds: int = 5) -> Model:
    """A model from at most fit_rows labelled documents whose fold isn't 0, the first by a hash of their id.
    They are trained on in one task; the driver gets the weights alone."""
    marked = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), folds) != 0)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    sample = F.broadcast(marked.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id", "quality").limit(fit_rows))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "text", "quality")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            own = pa.Table.from_batches(held)
            own = own.set_column(1, "text", pc.fill_null(own.column(1), ""))
            own = own.take(pc.sort_indices(own, [(c, "ascending") for c in ("doc_id", "quality", "text")]))
        model = train(own.column(1).combine_chunks(), own.column(2).to_pylist()) if held else train([], [])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["weights", "bias"])

    made = rows.repartition(1).mapInArrow(run, "weights binary, bias double").collect()  # a row of 0.5 MB
    return Model(np.frombuffer(bytes(made[0]["weights"]), np.float32), made[0]["bias"]) if made else train([], [])


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with the score, from 0 to 1, of each whole text: the higher, the likelier label 1.

    A null or empty text has no features and gets the score of the bias. Equal texts get equal scores. All other columns stay
    as they are; one named like the score is replaced. No rows in, no rows out. No shuffle; the model (0.5 MB) goes to each
    executor once.
    """
    ship(docs.sparkSession)
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch], at=docs.columns.index("text")) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, score in shared.value.pieces(batch.column(at)):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(score)], [*batch.schema.names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(column, DoubleType()))


def kept(docs: DataFrame, model: Model, least: float = KEPT) -> DataFrame:
    """The rows of docs whose text scores that much or more, with their own columns, whatever the names, and no others. Null and
    empty texts have the score of the bias; rows that repeat stay or go together. No rows in, no rows out."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch], at=docs.columns.index("text")) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, score in shared.value.pieces(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(score >= least))

    return docs.mapInArrow(run, docs.schema)
