"""The trie against counts in dictionaries, and Elias-Fano sequences against plain arrays."""

from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pytest

from sentrylake.llm import lm
from sentrylake.llm.elias_fano import EliasFano, Packed, encode, load, packed, save
from sentrylake.llm.queries import op2_elias_fano_lm
from tests.llm.brute import SF, words


@pytest.mark.parametrize("n,top", [(0, 1), (1, 5), (1000, 1010), (5000, 1 << 62), (70_000, 200_000)])
def test_elias_fano(n, top, tmp_path):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n).astype(np.uint64))
    save(f"file://{tmp_path}/x", encode(values))
    ef = EliasFano(load(f"file://{tmp_path}/x"))
    assert (ef.access(np.arange(n)) == values).all()
    own = np.unique(values)
    at = ef.find(own)
    assert (at >= 0).all() and (values[at] == own).all()
    other = np.setdiff1d(rng.integers(0, top + 5, 500).astype(np.uint64), own)
    assert (ef.find(other) == -1).all()


def _model(texts):
    one, two = Counter(), Counter()
    for t in texts:
        w = [*words(t), None]
        one.update(w)
        two.update(zip([None, *w], w))
    return one, two


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {i for i in docs if crc32(str(i).encode()) % 10 == 0}
    one, two = _model(t for i, t in docs.items() if i not in held)
    total, distinct = sum(one.values()), len(one)
    p = {w: (one[w] + 0.1) / (total + 0.1 * (distinct + 1)) for w in [*one, ""]}
    rows = op2_elias_fano_lm(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    better = []
    for r in rows:
        w = [*words(docs[r["doc_id"]]), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] in held, len(w), sum(one[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(sum(log10(p.get(x, p[""])) for x in w), abs=1e-6 * len(w))
        want = sum(log10((two[h, x] + lm.MASS * p.get(x, p[""])) / (one[h] + lm.MASS)) if one[h] else log10(p.get(x, p[""])) for h, x in zip([None, *w], w))
        assert abs(r["pair_score"] - want) < 0.02 * len(w) + 1e-6
        better.append(r["pair_score"] > r["base_score"])
    assert np.mean(better) > 0.9


def test_trigrams(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {i for i in docs if crc32(str(i).encode()) % 10 == 0}
    one, two = _model(t for i, t in docs.items() if i not in held)
    three, before = Counter(), Counter()
    for w in ([None, *words(t), None] for i, t in docs.items() if i not in held):
        three.update(zip(w, w[1:], w[2:]))
        before.update(zip(w, w[1:-1]))
    total, distinct = sum(one.values()), len(one)
    p = {w: (one[w] + 0.1) / (total + 0.1 * (distinct + 1)) for w in [*one, ""]}

    def after(h, x):
        return (two[h, x] + lm.MASS * p.get(x, p[""])) / (one[h] + lm.MASS) if one[h] else p.get(x, p[""])

    gains = []
    for r in op2_elias_fano_lm(spark, SF).collect():
        w = [None, *words(docs[r["doc_id"]]), None]
        want = log10(after(w[0], w[1])) + sum(log10((three[g, h, x] + lm.MASS * after(h, x)) / (before[g, h] + lm.MASS)) for g, h, x in zip(w, w[1:], w[2:]))
        assert abs(r["score"] - want) < 0.02 * len(w) + 1e-6
        gains.append(r["score"] - r["pair_score"])
    assert max(map(abs, gains)) > 1


def test_two_words_decide(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a x b", "c x d"] * 300)] + [(1000, "a x b"), (1001, "a x d")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.scored(df.where("doc_id >= 1000"), lm.fit(df.where("doc_id < 1000"), part_bytes=1 << 6)).collect()}
    assert got[1000]["score"] == pytest.approx(got[1001]["score"], abs=0.02)
    # after "a x" b came 300 times of 300, d never
    b, d = (300 + 30 * 300 / 600) / 330, 30 * 300 / 600 / 330
    assert got[1000]["trigram_score"] - got[1001]["trigram_score"] == pytest.approx(log10(b / d), abs=0.1)


def test_successors(spark):
    trie = lm.fit(spark.createDataFrame([("a b a c",), ("a b",), (None,)], "text string"))
    reader = trie.open()
    hashes = np.sort(np.array([*lm._stream(__import__("pyarrow").array(["a b c"]))][0][3]))
    ids, counts = reader.look_up(hashes)
    assert sorted(counts.tolist()) == [1, 2, 3, 3] and (ids >= 0).all()
    assert sorted(len(reader.successors(int(i))[0]) for i in ids) == [1, 2, 2, 2]


def test_hard_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "a " * 60_000, 1), (3, "zzz", 1), (3, "zzz", 1)], "doc_id long, text string, score int")
    rows = lm.scored(df, lm.fit(df)).collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 1, 2, 2, 60_001]
    assert lm.scored(df.limit(0), lm.fit(df)).collect() == []
    empty = lm.scored(df, lm.fit(df.limit(0))).collect()
    assert all(r["n_known"] == 0 for r in empty)


def test_parts_do_not_matter(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r["doc_id"]: r["base_score"] for r in lm.scored(df, lm.fit(df)).collect()}
    b = {r["doc_id"]: r["base_score"] for r in lm.scored(df, lm.fit(df, part_bytes=1 << 14)).collect()}
    assert a == pytest.approx(b, abs=1e-6)


def test_packed_runs_and_ranges(tmp_path):
    rng = np.random.default_rng(4)
    cuts = np.sort(rng.integers(0, 4000, 300)).astype(np.uint64)
    cuts[0], cuts[-1] = 0, 4000
    values = np.concatenate([np.sort(rng.choice(90_000, int(b - a), replace=False)) for a, b in zip(cuts[:-1], cuts[1:])]).astype(np.uint64)
    save(f"file://{tmp_path}/p", packed(values))
    own, pointers = Packed(load(f"file://{tmp_path}/p")), EliasFano(encode(cuts))
    assert (own.access(np.arange(4000)) == values).all()
    first, last = pointers.ranges(np.arange(299))
    assert (first == cuts[:-1]).all() and (last == cuts[1:]).all()
    run = np.searchsorted(cuts, np.arange(4000), "right") - 1
    assert (own.find(values, first[run], last[run]) == np.arange(4000)).all()
    want = [-1 if x not in values[first[r] : last[r]] else 0 for x, r in zip(range(500), run)]
    assert (np.minimum(own.find(np.arange(500).astype(np.uint64), first[run[:500]], last[run[:500]]), 0) == want).all()
