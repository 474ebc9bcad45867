"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A word's score for a language is the log probability of its character pairs and triples and of the word itself, all hashed,
as counted in training texts. Languages that aren't written in the word's script aren't candidates. A path through a text's
words pays a penalty for each change of language; the best path splits the text into spans.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from sentrylake.llm import tokens
from sentrylake.llm.quality import fold
from sentrylake.llm.work import ship

#: Code points of scripts, in the order of their numbers from 2; 1 is any other letter.
SCRIPTS = [
    [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],  # Latin
    [(0x370, 0x3FF), (0x1F00, 0x1FFF)],  # Greek
    [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],  # Cyrillic
    [(0x530, 0x58F)],  # Armenian
    [(0x590, 0x5FF)],  # Hebrew
    [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],  # Arabic
    [(0x900, 0x97F)],  # Devanagari
    [(0x980, 0x9FF)],  # Bengali
    [(0xB80, 0xBFF)],  # Tamil
    [(0xE00, 0xE7F)],  # Thai
    [(0x10A0, 0x10FF), (0x2D00, 0x2D2F)],  # Georgian
    [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],  # Hangul
    [(0x3040, 0x30FF), (0x31F0, 0x31FF)],  # Kana
    [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],  # Han
]
BUCKETS, PENALTY = 1 << 15, 12.0
#: What a word scores for a language that isn't a candidate, below any score of a candidate that a change of language could buy.
OFF = -1e4
#: Documents of each language that the model is fitted on: each row takes part with the chance that gives so many, by a hash of
#: its id.
FIT_ROWS = 1000
#: Languages whose counts a task holds before it sends them on.
HELD_LANGS = 32
UNKNOWN = "und"

_made: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: number of the script (0 is no letter), and the lower-case code point."""
    if not _made:
        top = 0x110000
        letter = np.fromiter((chr(i).isalpha() for i in range(top)), bool, top)
        script = letter.astype(np.uint8)
        for number, ranges in enumerate(SCRIPTS, 2):
            for a, b in ranges:
                script[a : b + 1] = np.where(letter[a : b + 1], number, 0)
        lower = np.arange(top, dtype=np.uint32)
        lower[:0x10000] = np.fromiter((ord(c[0]) for c in map(str.lower, map(chr, range(0x10000)))), np.uint32, 0x10000)
        _made[:] = [script, lower]
    return _made[0], _made[1]


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts and their offsets; bytes that aren't UTF-8 count as unknown characters."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    if heads[-1] != len(points):
        each = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
    return points, heads[offsets]


def _word_features(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of each word: text, first character, letters, script; and pairs of word and bucket for each kind of feature."""
    script_of, lower = _tables()
    white = (points == 32) | ((points >= 9) & (points <= 13))
    solid = ~white
    first = solid.copy()
    first[1:] &= white[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] |= solid[heads]
    start = np.flatnonzero(first)
    doc = np.searchsorted(offsets, start, "right") - 1
    of = np.cumsum(first) - 1
    script = script_of[points]
    letters = np.bincount(of[solid], script[solid] > 0, len(start)).astype(np.int64)
    kind = np.zeros(len(start), np.uint8)
    np.maximum.at(kind, of[solid], script[solid])
    low = np.where(white, 32, lower[points]).astype(np.uint64)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found = []
    for width in (2, 3):
        n = len(points) - width + 1
        if n < 1:
            found.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        inner = white[1:-1] if width == 3 else np.zeros(n, bool)
        at = np.flatnonzero(~inner & (text_of[:n] == text_of[width - 1 :]) & ~(white[:n] & white[width - 1 :]))
        h = low[at]
        for k in range(1, width):
            h = h * np.uint64(0x110001) + low[at + k]
        h = (h ^ (h >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C55) + np.uint64(width)
        found.append((of[at + white[at]], (h >> np.uint64(49)).astype(np.int64)))
    up, down = tokens.powers(len(points))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(solid, low + np.uint64(1), np.uint64(0)) * up[: len(points)])])
    end = np.append(start[1:], len(points))
    word = tokens.mixed((total[end] - total[start]) * down[start])
    found.append((np.arange(len(start)), (word >> np.uint64(49)).astype(np.int64)))
    return doc, start, letters, kind, found


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # kind of feature, bucket, language
    allowed: np.ndarray  # script, language

    def predict(self, texts: pa.Array, want_spans: bool = False) -> tuple[list[str], np.ndarray, list[str] | None]:
        """Language, score and, if wanted, spans (language:start:end in code points, comma-joined) of each text."""
        n, parts, sizes = len(texts), [], []
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n), [""] * n if want_spans else None
        for i, _, data, offsets in tokens.chunks(texts):
            points, at = _points(data, offsets)
            doc, start, letters, kind, found = _word_features(points, at)
            score = self.word_scores(letters, kind, found)
            parts.append((doc + i, start - at[doc] if want_spans else None, letters, score))
            sizes.append(np.diff(at))
        doc, letters, score = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 2, 3))
        label = viterbi(doc, score.reshape(len(doc), len(self.langs)), n)
        held = np.bincount(doc * len(self.langs) + label, letters, n * len(self.langs)).reshape(n, len(self.langs))
        total = held.sum(1)
        best = held.argmax(1)
        names = [self.langs[b] if t else UNKNOWN for b, t in zip(best.tolist(), total.tolist(), strict=True)]
        spans = None
        if want_spans:
            start = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            spans = self._spans(doc, start, label, np.concatenate(sizes) if sizes else np.zeros(0, np.int64))
        return names, np.where(total > 0, held[np.arange(n), best] / np.maximum(total, 1), 0.0), spans

    def word_scores(self, letters: np.ndarray, script: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log probability of each word for each language. The word's script narrows the languages first; only candidates are
        scored, and a word without letters is the same for all."""
        score = np.where(self.allowed[script], 0, OFF).astype(np.float32)
        patterns, of_script = np.unique(self.allowed, axis=0, return_inverse=True)
        pattern = of_script.reshape(-1)[script]
        present = np.unique(pattern)
        for x in present.tolist():
            langs = np.flatnonzero(patterns[x])
            for log, (of, bucket) in zip(self.logs, found, strict=True):
                if len(present) > 1:
                    at = np.flatnonzero(pattern[of] == x)
                    of, bucket = of[at], bucket[at]
                if len(of):
                    head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))  # features are in the order of words
                    each = log[bucket] if len(langs) == len(self.langs) else log[bucket[:, None], langs]
                    score[of[head][:, None], langs] += np.add.reduceat(each, head, axis=0)
        score[letters == 0] = 0
        return score

    def _spans(self, doc: np.ndarray, start: np.ndarray, label: np.ndarray, size: np.ndarray) -> list[str]:
        out: list[list[str]] = [[] for _ in range(len(size))]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])])) if len(doc) else []
        for k, a in enumerate(new):
            b = new[k + 1] if k + 1 < len(new) else len(doc)
            end = start[b] if b < len(doc) and doc[b] == doc[a] else size[doc[a]]
            out[doc[a]].append(f"{self.langs[label[a]]}:{start[a]}:{end}")
        return [",".join(x) for x in out]


def viterbi(doc: np.ndarray, score: np.ndarray, texts: int, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word, words being in the order of their texts: all texts advance together, a word at a time."""
    if not len(doc):
        return np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=texts)
    order = np.argsort(-count, kind="stable")
    count, start = count[order], (np.cumsum(count) - count)[order]
    alive = np.searchsorted(-count, -np.arange(1, count[0] + 1), "right")  # texts with more than t words
    moved, came = np.zeros(score.shape, bool), np.zeros(len(doc), np.uint8)
    now = score[start[: alive[0]]].astype(np.float64)
    for t in range(1, int(count[0])):
        n = alive[t]
        at, held = start[:n] + t, now[:n]
        top = held.argmax(1)
        change = held[np.arange(n), top] - penalty
        turn = change[:, None] > held
        moved[at], came[at] = turn, top
        now[:n] = np.where(turn, change[:, None], held) + score[at]
    state, label = now.argmax(1), np.zeros(len(doc), np.int64)
    for t in range(int(count[0]) - 1, -1, -1):
        n = alive[t]
        at, own = start[:n] + t, state[:n]
        label[at] = own
        state[:n] = np.where(moved[at, own], came[at], own)
    return label


CELLS = 3 * BUCKETS + 2 + len(SCRIPTS)


def counted(texts: pa.Array, langs: list[str]) -> dict[str, np.ndarray]:
    """For each language: how often each kind of feature falls into each bucket, then letters of each script."""
    out = {x: np.zeros(CELLS, np.int64) for x in dict.fromkeys(langs)}
    for i, j, data, offsets in tokens.chunks(texts):
        points, at = _points(data, offsets)
        doc, _, letters, kind, found = _word_features(points, at)
        number = {x: k for k, x in enumerate(dict.fromkeys(langs[i:j]))}
        own = np.array([number[x] for x in langs[i:j]], np.int64)[doc]
        for nth, (of, bucket) in enumerate([*found, (np.arange(len(own)), np.int64(3 * BUCKETS) + kind)]):
            cell = bucket + (nth * BUCKETS if nth < 3 else 0)
            sums = np.bincount(own[of] * CELLS + cell, None if nth < 3 else letters, len(number) * CELLS).reshape(len(number), CELLS)
            for lang, k in number.items():
                out[lang] += sums[k].astype(np.int64)
    return out


def built(tables: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """The model of languages with their log probabilities and letters by script; a script belongs to a language that has a
    hundredth of its letters in it."""
    tables = sorted(tables, key=lambda t: t[0])
    logs = np.stack([t[1] for t in tables], -1) if tables else np.zeros((3, BUCKETS, 0), np.float32)
    script = np.stack([t[2] for t in tables], -1) if tables else np.zeros((2 + len(SCRIPTS), 0))
    allowed = script >= 0.01 * np.maximum(script.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return Model([t[0] for t in tables], logs, allowed)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, folds: int = 4, held: int = 2) -> Model:
    """A model from about fit_rows documents of each language outside the held-out fold, all of them where there are fewer.

    Tasks count hashed features of whole texts, and the counts are added up by language and bucket. The driver sees no text: a
    language comes to it as one row of fixed size (0.4 MB), made by a task. Repeated rows count as often as they occur."""
    ship(docs.sparkSession)
    known = docs.where("lang is not null AND doc_id is not null AND text is not null").where(fold(F.col("doc_id"), folds) != held)
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    chance = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    rows = known.select("doc_id", "text", "lang").join(F.broadcast(sizes), "lang").where(chance * F.col("n") < fit_rows).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, cells in counted(batch.column(1), batch.column(0).to_pylist()).items():
                total[lang] = total[lang] + cells if lang in total else cells
            if len(total) > HELD_LANGS:
                yield from map(_sent, total.items())
                total = {}
        yield from map(_sent, total.items())

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros(CELLS, np.int64)
        cells[pdf["cell"].to_numpy()] = pdf["n"].to_numpy()
        counts = 1.0 + cells[: 3 * BUCKETS].reshape(3, BUCKETS)
        logs = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
        return pd.DataFrame({"lang": [key[0]], "logs": [logs.tobytes()], "script": [cells[3 * BUCKETS :].tobytes()]})

    cells = rows.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    made = cells.groupBy("lang").applyInPandas(finish, "lang string, logs binary, script binary").collect()  # a row for each language
    return built([(r["lang"], np.frombuffer(bytes(r["logs"]), np.float32).reshape(3, BUCKETS), np.frombuffer(bytes(r["script"]), np.int64)) for r in made])


def _sent(item: tuple[str, np.ndarray]) -> pa.RecordBatch:
    at = np.flatnonzero(item[1])
    return pa.RecordBatch.from_arrays([pa.array([item[0]] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(item[1][at])], ["lang", "cell", "n"])


def identified(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """docs with lang_pred and score (the share of the letters that lie in spans of that language), and spans if wanted.

    A text that is null, empty or without letters is und, with score 0; so is any text if the model has no language. A word
    whose script no language is written in has all as candidates. Equal texts get equal results; ties go to the first
    language by name. Other columns are carried; those named like the new ones are replaced. No rows in, no rows out; no
    shuffle.
    """
    ship(docs.sparkSession)
    new = ["lang_pred", "score", *["spans"] * spans]
    docs = docs.drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch], at=docs.columns.index("text")) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, found = shared.value.predict(batch.column(at), spans)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score), *([pa.array(found, pa.string())] if spans else [])], [*batch.schema.names, *new])

    kinds = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(run, kinds.add("spans", StringType()) if spans else kinds)
