"""Language-model scores from a three-level n-gram trie in Elias-Fano form.

Level 1 holds the words, sorted by hash (their place is their id), with counts and pointers to their successors. Level 2 holds
the successors: for each word, in the order of ids, the ids of the words that follow it, sorted and packed, with probabilities quantised to 256 values, and the pairs' counts. A word is looked for within the range that its context's
pointers give. Level 3 holds the same for pairs: for each pair, in the order
of their places in level 2 (a pair's place is its id), the ids of the words that follow it, with quantised shares. Hashes and
pointers are monotone sequences in Elias-Fano form. All are cut into parts by ranges of the contexts' hashes, level 3 by ranges of pair ids; each part is a file of the shared
folder that tasks map into memory, so no task holds the model and no one gathers it.

The probability of a word w after h is (c(h, w) + MASS * p(w)) / (c(h) + MASS), with p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)),
c a count of the training texts, N all tokens and V distinct ones. The end of a text is a token; it's also the context of the
first word. A word that never occurred has p of a count of zero, and as a context leaves p(w) as it is.

The probability after the pair (g, h) is (c(g, h, w) + MASS * p(w after h)) / (c(g, h) + MASS), of which level 3 holds
c(g, h, w) / (c(g, h) + MASS). A pair that never occurred leaves p(w after h) as it is, and so does the first word of a text, which
has only the end before it.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.llm import tokens
from sentrylake.llm.elias_fano import EliasFano, Packed, encode, load, packed, save
from sentrylake.llm.quality import fold
from sentrylake.llm.work import ship
from sentrylake.work import new_path

END = np.uint64(0xA0761D6478BD642F)
MASS, ADDED = 30.0, 0.1
#: Tokens that a task adds up before it sends them on, and bytes of text for which the model gets another part.
FLUSH, PART_BYTES, MOST_PARTS = 1_500_000, 16 << 20, 1 << 16


def _stream(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, document, token hash), each text's words followed by END, in pieces of bounded size."""
    for i, j, data, offsets in tokens.chunks(texts):
        doc, word = tokens.words(data, offsets)
        ends = np.searchsorted(doc, np.arange(j - i), "right")
        yield i, j, np.insert(doc, ends, np.arange(j - i)), np.insert(word, ends, END)


def _contexts(doc: np.ndarray, value: np.ndarray, first: np.generic) -> np.ndarray:
    """What stands before each token; the end of a text before its first one."""
    before = np.empty_like(value)
    before[1:] = value[:-1]
    before[np.concatenate([[True], doc[1:] != doc[:-1]])] = first
    return before


def _texts(h: np.ndarray) -> np.ndarray:
    """The number of each token's text, by the ends before it."""
    end = h == END
    return np.cumsum(end) - end


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and each value's place among them; by hashing, as tokens are few words many times."""
    code, value = pd.factorize(h.ravel())
    order = np.argsort(value)
    place = np.empty(len(value), np.int64)
    place[order] = np.arange(len(value))
    return value[order], place[code].reshape(h.shape)


def _unique(x: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, all from 0 and below a bound, and each value's place among them. A value and its place in x are
    sorted as one number where 63 bits hold both."""
    bits = len(x).bit_length()
    if below.bit_length() + bits > 63:
        return np.unique(x, return_inverse=True)
    both = np.sort((x.astype(np.int64) << bits) | np.arange(len(x)))
    value, at = both >> bits, both & ((1 << bits) - 1)
    new = np.concatenate([[True], value[1:] != value[:-1]])[: len(x)]
    place = np.empty(len(x), np.int64)
    place[at] = np.cumsum(new) - 1
    return value[new], place


def _part(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _slices(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal values of a sorted array."""
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    for k, a in enumerate(cut):
        yield int(part[a]), int(a), int(cut[k + 1]) if k + 1 < len(cut) else len(part)


@dataclass
class Trie:
    path: str
    bits: int
    total: int
    offsets: np.ndarray  # of the words of each part
    pairs: np.ndarray | None = None  # of the pairs of each part
    span: int = 1  # pair ids of a part of level 3

    @property
    def words(self) -> int:
        return int(self.offsets[-1])

    def open(self) -> "Reader":
        return Reader(self)


class Reader:
    def __init__(self, trie: Trie):
        self.trie, self.parts = trie, {}

    def part(self, k: int, level: int) -> dict:
        if (k, level) not in self.parts:
            arrays = load(f"{self.trie.path}/level{level}-{k}")
            own = {x: y for x, y in arrays.items() if "." not in x}
            for name, kind in (("ef", EliasFano), ("pointers", EliasFano), ("words", Packed)):
                if f"{name}.n" in arrays:
                    own[name] = kind({x[len(name) + 1 :]: y for x, y in arrays.items() if x.startswith(f"{name}.")})
            self.parts[k, level] = own
        return self.parts[k, level]

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: none) and count of each of the sorted hashes."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for k, a, b in _slices(_part(h, self.trie.bits)):
            if self.trie.offsets[k] == self.trie.offsets[k + 1]:
                continue
            own = self.part(k, 1)
            at = own["ef"].find(h[a:b])
            hit = at >= 0
            ids[a:b] = np.where(hit, at + self.trie.offsets[k], -1)
            counts[a:b] = np.where(hit, own["counts"][np.maximum(at, 0)], 0)
        return ids, counts

    def follow(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id (-1: didn't occur), probability (nan) and count of each pair of ids, sorted by context."""
        ids, value, counts = np.full(len(context), -1, np.int64), np.full(len(context), np.nan), np.zeros(len(context), np.int64)
        for k, a, b in _slices(np.searchsorted(self.trie.offsets, context, "right") - 1):
            own = self.part(k, 2)
            at = self._within(own, context[a:b] - self.trie.offsets[k], word[a:b])
            hit = np.flatnonzero(at >= 0)
            at = at[hit]
            count = own["counts"][at].astype(np.int64)
            large = count == 255
            count[large] = own["large"][np.searchsorted(own["large_at"], at[large])]
            ids[a:b][hit], value[a:b][hit], counts[a:b][hit] = at + self.trie.pairs[k], _powers(own["book"])[own["codes"][at]], count
        return ids, value, counts

    def _within(self, own: dict, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of each word among those that follow its context, or -1: the context's pointers give the range, and the word is
        searched there, relative to the context's base. context is sorted, so each one's pointers are read once."""
        head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        n = np.diff(np.append(head, len(context)))
        first, last = own["pointers"].ranges(context[head])
        return own["words"].find(word.astype(np.uint64), np.repeat(first, n), np.repeat(last, n))

    def third(self, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Share of each word after a pair, both as ids, sorted by pair; 0 where it didn't occur."""
        out = np.zeros(len(pair))
        for k, a, b in _slices(pair // self.trie.span):
            own = self.part(k, 3)
            at = self._within(own, pair[a:b] - k * self.trie.span, word[a:b])
            hit = np.flatnonzero(at >= 0)
            out[a:b][hit] = _powers(own["book"])[own["codes"][at[hit]]]
        return out

    def successors(self, word: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and log10 probabilities of all that follow a word, by its pointers."""
        k = int(np.searchsorted(self.trie.offsets, word, "right")) - 1
        own, local = self.part(k, 2), word - int(self.trie.offsets[k])
        a, b = own["pointers"].access(np.array([local, local + 1])).astype(np.int64)
        at = np.arange(a, b)
        return own["words"].access(at).astype(np.int64), own["book"][own["codes"][at]]


def _values(context: np.ndarray, word: np.ndarray, trie: Trie) -> np.ndarray:
    """What a part of level 2 or 3 holds for a word after a context of that part."""
    return context.astype(np.uint64) * np.uint64(trie.words) + word.astype(np.uint64)


def _unigram(count: np.ndarray, trie: Trie) -> np.ndarray:
    return (count + ADDED) / (trie.total + ADDED * (trie.words + 1))


def _powers(book: np.ndarray) -> np.ndarray:
    return 10.0 ** book.astype(np.float64)


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each value, by 256 ranges of equal width, and the mean of the values in each range."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(256, np.float32)
    code = ((x - x.min()) / max(x.max() - x.min(), 1e-12) * 255.999).astype(np.int64)
    n = np.maximum(np.bincount(code, minlength=256), 1)
    return code.astype(np.uint8), (np.bincount(code, x, 256) / n).astype(np.float32)


def _shuffled(docs: DataFrame, gather: Callable, write: Callable) -> list:
    """Sends what gather makes of the texts, tables of (part, blob), to one task for each part; gives write's row for each."""
    sent = docs.select("text").mapInArrow(gather, "part int, blob binary")
    return sent.groupBy("part").applyInPandas(write, "part int, n long, total long").collect()  # a row for each part


def _sent(pieces: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pieces], pa.int32()), pa.array([b for _, b in pieces], pa.binary())], ["part", "blob"])


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(x) for x in arrays], np.int64).tobytes(), *(x.tobytes() for x in arrays)])


def _arrays(blob: bytes, *kinds: type) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _small(count: np.ndarray, kind: type = np.uint8) -> list[np.ndarray]:
    """Counts as bytes, and apart those over 254; or so for another kind."""
    top = np.iinfo(kind).max
    return [np.minimum(count, top).astype(kind), count[count >= top].astype(np.uint64)]


def _full(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    count = small.astype(np.int64)
    count[small == np.iinfo(small.dtype).max] = large
    return count


def fit(docs: DataFrame, part_bytes: int = PART_BYTES) -> Trie:
    """The trie of all texts of docs. Three passes: words and their counts, then pairs of words, then pairs with the word after
    them, each added up within tasks, sent to the part that they belong to and merged there."""
    ship(docs.sparkSession)
    path = new_path(docs.sparkSession, "trie")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(int(size / part_bytes), 1).bit_length(), MOST_PARTS.bit_length() - 1)

    def gather_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _flushes(batches, lambda doc, h: h):
            word, at = _distinct(held)
            count = np.bincount(at)
            yield _sent([(k, _blob(word[a:b], *_small(count[a:b]))) for k, a, b in _slices(_part(word, bits))])

    def write_words(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        blobs = [_arrays(b, np.uint64, np.uint8, np.uint64) for b in pdf["blob"]]
        word, at = np.unique(np.concatenate([b[0] for b in blobs]), return_inverse=True)
        count = np.bincount(at, np.concatenate([_full(b[1], b[2]) for b in blobs]), len(word)).astype(np.int64)
        save(f"{path}/level1-{key[0]}", {f"ef.{x}": y for x, y in encode(word).items()} | {"counts": count.astype(np.uint32) if count.max() < 1 << 32 else count})
        return pd.DataFrame({"part": [key[0]], "n": [len(word)], "total": [int(count.sum())]})

    rows = _shuffled(docs, gather_words, write_words)
    sizes = np.zeros(1 << bits, np.int64)
    for r in rows:
        sizes[r["part"]] = r["n"]
    trie = Trie(path, bits, sum(r["total"] for r in rows), np.concatenate([[0], np.cumsum(sizes)]))
    ids = np.uint32 if trie.words < 1 << 32 else np.uint64

    def gather_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = trie.open()
        shift = np.uint64(max(trie.words, 1))
        for held in _flushes(batches, lambda doc, h: h):
            known, at = _distinct(held)
            word = reader.look_up(known)[0].astype(np.uint64)[at]
            before = _contexts(_texts(held), word, word[-1])  # the last token is an end
            if trie.words < 1 << 32:
                pair, count = np.unique(before * shift + word, return_counts=True)
                before, word = pair // shift, pair % shift
            else:
                order = np.lexsort((word, before))
                before, word = before[order], word[order]
                new = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (word[1:] != word[:-1])]))
                count, before, word = np.diff(np.append(new, len(order))), before[new], word[new]
            out = []
            for k, a, b in _slices(np.searchsorted(trie.offsets, before, "right") - 1):
                heads = np.flatnonzero(np.concatenate([[True], before[a + 1 : b] != before[a : b - 1]]))
                out.append((k, _blob((before[a:b][heads] - np.uint64(trie.offsets[k])).astype(ids), np.diff(np.append(heads, b - a)).astype(np.uint32), word[a:b].astype(ids), *_small(count[a:b]))))
            yield _sent(out)

    def write_pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        reader, k = trie.open(), key[0]
        blobs = [_arrays(b, ids, np.uint32, ids, np.uint8, np.uint64) for b in pdf["blob"]]
        before = np.concatenate([np.repeat(b[0], b[1]) for b in blobs]).astype(np.uint64)
        value, at = np.unique(before * np.uint64(trie.words) + np.concatenate([b[2] for b in blobs]).astype(np.uint64), return_inverse=True)
        count = np.bincount(at, np.concatenate([_full(b[3], b[4]) for b in blobs]), len(value))
        context, word = (value // np.uint64(trie.words)).astype(np.int64), (value % np.uint64(trie.words)).astype(np.int64)
        of_context = reader.part(k, 1)["counts"][context].astype(np.float64)
        some, back = np.unique(word, return_inverse=True)
        of_word = np.zeros(len(some))
        for j, a, b in _slices(np.searchsorted(trie.offsets, some, "right") - 1):
            of_word[a:b] = reader.part(j, 1)["counts"][some[a:b] - trie.offsets[j]]
        code, book = _quantised(np.log10((count + MASS * _unigram(of_word, trie)[back]) / (of_context + MASS)))
        small, large = _small(count)
        starts = np.searchsorted(context, np.arange(int(sizes[k]) + 1)).astype(np.uint64)
        save(f"{path}/level2-{k}", {f"words.{x}": y for x, y in packed(word.astype(np.uint64)).items()} | {f"pointers.{x}": y for x, y in encode(starts).items()} | {"codes": code, "book": book, "counts": small, "large": large, "large_at": np.flatnonzero(small == 255)})
        return pd.DataFrame({"part": [k], "n": [len(value)], "total": [int(count.sum())]})

    if not trie.words:
        return trie
    pairs = np.zeros(1 << bits, np.int64)
    for r in _shuffled(docs, gather_pairs, write_pairs):
        pairs[r["part"]] = r["n"]
    trie.pairs = np.concatenate([[0], np.cumsum(pairs)])
    trie.span = max(1, -(-int(trie.pairs[-1]) // min(2 << bits, MOST_PARTS)))

    def gather_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = trie.open()
        for held in _flushes(batches, lambda doc, h: h):
            known, at = _distinct(held)
            own, n = reader.look_up(known)[0], len(known)
            doc = _texts(held)
            pair, back = _unique(_contexts(doc, at, np.searchsorted(known, END)) * n + at, n * n)
            pair = reader.follow(own[pair // n], own[pair % n])[0]
            before = _contexts(doc, back, -1)
            later = before >= 0
            triple, count = np.unique(before[later] * n + at[later], return_counts=True)
            before, word, out = pair[triple // n], own[triple % n], []
            for k, a, b in _slices(before // trie.span):
                heads = np.flatnonzero(np.concatenate([[True], before[a + 1 : b] != before[a : b - 1]]))
                steps = np.diff(before[a:b][heads], prepend=k * trie.span)
                out.append((k, _blob(*_small(steps, np.uint16), *_small(np.diff(np.append(heads, b - a))), word[a:b].astype(ids), *_small(count[a:b]))))
            yield _sent(out)

    def write_triples(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        blobs = [_arrays(b, np.uint16, np.uint64, np.uint8, np.uint64, ids, np.uint8, np.uint64) for b in pdf["blob"]]
        before = np.concatenate([np.repeat(np.cumsum(_full(b[0], b[1])), _full(b[2], b[3])) for b in blobs])
        value, at = np.unique(_values(before, np.concatenate([b[4] for b in blobs]), trie), return_inverse=True)
        count = np.bincount(at, np.concatenate([_full(b[5], b[6]) for b in blobs]), len(value))
        pair = (value // np.uint64(trie.words)).astype(np.int64)
        code, book = _quantised(np.log10(count / (np.bincount(pair, count)[pair] + MASS)))
        starts = np.searchsorted(pair, np.arange(trie.span + 1)).astype(np.uint64)
        word = value % np.uint64(trie.words)
        save(f"{path}/level3-{key[0]}", {f"words.{x}": y for x, y in packed(word).items()} | {f"pointers.{x}": y for x, y in encode(starts).items()} | {"codes": code, "book": book})
        return pd.DataFrame({"part": [key[0]], "n": [len(value)], "total": [int(count.sum())]})

    _shuffled(docs, gather_triples, write_triples)
    return trie


def _flushes(batches: Iterator[pa.RecordBatch], make: Callable) -> Iterator[np.ndarray]:
    """What make gives for the tokens of the texts, put together to FLUSH tokens or so."""
    held, n = [], 0
    for batch in batches:
        for _, _, doc, h in _stream(batch.column(0)):
            held.append(make(doc, h))
            n += len(h)
            if n >= FLUSH:
                yield np.concatenate(held, axis=-1)
                held, n = [], 0
    if n:
        yield np.concatenate(held, axis=-1)


def scored(docs: DataFrame, trie: Trie) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and trigram_score of each whole text: log10 probability of words and end by
    words alone, after one word, and after two.

    A null or empty text is the end token alone. Equal texts get equal scores. Null ids are carried; other columns aren't
    read. A trie of no texts knows no word: every token has probability 1 then (V is 0, N is 0). No rows in, no rows out. No
    shuffle: tasks map the parts that they need.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = trie.open()
        for batch in batches:
            rows = batch.num_rows
            outs = [np.zeros(rows) for _ in range(5)]
            held, size = [], 0
            for i, j, doc, h in _stream(batch.column(1)):
                held.append((doc + i, h))
                size += len(h)
                if size >= FLUSH or j == rows:
                    for out, x in zip(outs, _scores(reader, trie, *(np.concatenate(y) for y in zip(*held, strict=True)), rows), strict=True):
                        out += x
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(outs[0].astype(np.int64)), pa.array(outs[1].astype(np.int64)), *map(pa.array, outs[2:])], ["doc_id", "n_tokens", "n_known", "base_score", "score", "trigram_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, trigram_score double")


def _scores(reader: Reader, trie: Trie, doc: np.ndarray, h: np.ndarray, rows: int) -> list[np.ndarray]:
    known, at = _distinct(h)
    ids, counts = reader.look_up(known)
    word, before = at, _contexts(doc, at, np.searchsorted(known, END))
    base = _unigram(counts, trie)
    pair, back = _unique(before * np.int64(len(known)) + word, len(known) ** 2)
    first, second = pair // len(known), pair % len(known)
    value = base[second] * np.where(ids[first] >= 0, MASS / (counts[first] + MASS), 1.0)
    both = np.flatnonzero((ids[first] >= 0) & (ids[second] >= 0))
    own, n_own = np.full(len(pair), -1, np.int64), np.zeros(len(pair), np.int64)
    own[both], found, n_own[both] = reader.follow(ids[first[both]], ids[second[both]])
    value[both] = np.where(np.isnan(found), value[both], found)
    triple, again = _unique((_contexts(doc, back, -1) + 1) * len(known) + word, (len(pair) + 1) * len(known))
    some = np.empty(len(triple), np.int64)
    some[again] = back  # the last pair of any token of each
    before, last, longer = triple // len(known) - 1, triple % len(known), value[some]
    after = np.flatnonzero((before >= 0) & (own[before] >= 0))
    share = np.zeros(len(after))
    seen = np.flatnonzero(ids[last[after]] >= 0)
    share[seen] = reader.third(own[before[after[seen]]], ids[last[after[seen]]])
    longer[after] = share + MASS / (n_own[before[after]] + MASS) * longer[after]
    of_word, of_pair, of_triple = np.log10(base), np.log10(value), np.log10(longer)
    return [np.bincount(doc, minlength=rows), *(np.bincount(doc, x, rows) for x in ((counts > 0).astype(np.float64)[word], of_word[word], of_pair[back], of_triple[again]))]


def training(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 10) != 0, F.lit(True))
