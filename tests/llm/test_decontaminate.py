"""Greedy string tiling against a plain version that compares all places."""

import random

import numpy as np

from sentrylake.llm import decontaminate
from sentrylake.llm.queries import op4_string_tiling_decontamination
from tests.llm.brute import SF, tiles, words


def test_tiles():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 30))]
        b = [rng.randrange(4) for _ in range(rng.randrange(1, 20))]
        got = decontaminate.tiles(np.array(a, np.uint64) + np.uint64(10), np.array(b, np.uint64) + np.uint64(10), 3)
        assert sorted(got) == sorted(tiles(a, b, 3))


def _brute(docs, items, match=decontaminate.MATCH, coverage=decontaminate.COVERAGE):
    found = {}
    seeds = {k: {tuple(w[i : i + match]) for i in range(len(w) - match + 1)} for k, w in ((k, words(t)) for k, t in items)}
    for d, text in docs:
        w = words(text)
        own = {tuple(w[i : i + match]) for i in range(len(w) - match + 1)}
        for k, t in items:
            if own & seeds[k]:
                laid = tiles(w, words(t), match)
                share = sum(x[2] for x in laid) / len(words(t))
                if share >= coverage:
                    found[d, k] = round(share, 9)
    return found


def test_query(spark):
    short = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): round(r["coverage"], 9) for r in op4_string_tiling_decontamination(spark, SF).collect()}
    small = {d for d, t in short if len(words(t)) <= 600}
    want = _brute([x for x in short if x[0] in small], items)
    assert {k: v for k, v in got.items() if k[0] in small} == want
    assert got


def test_reordered_passages(spark):
    item = [f"w{i}" for i in range(40)]
    moved = item[20:30] + ["x"] * 7 + item[:10] + ["y"] + item[30:]
    docs = spark.createDataFrame([(1, " ".join(moved)), (2, " ".join(item).upper()), (3, " ".join(item[:15])), (4, "nothing at all here")], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: (r["coverage"], r["n_tiles"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {1: (0.75, 3), 2: (1.0, 1)}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == [3, 4]


def test_hard_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "a b c d e f", 1), (2, "a b c d e f", 1), (None, "a b c d e f", 1), (3, "q " * 50_000, 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "a b"), (None, "a b c d"), (4, "a b c d e f")], "item_id long, text string")
    rows = decontaminate.contaminated(docs, items).collect()
    assert sorted(((r["doc_id"] or -1), r["item_id"]) for r in rows) == [(-1, 1), (-1, 4), (2, 1), (2, 1), (2, 4), (2, 4)]
    assert decontaminate.clean(docs, items).count() == 3
    monkeypatch.setattr(decontaminate, "PASS_WORDS", 3)
    assert decontaminate.contaminated(docs, items).count() == 6
    assert decontaminate.contaminated(docs.limit(0), items).collect() == [] and decontaminate.contaminated(docs, items.limit(0)).collect() == []
    assert decontaminate.clean(docs, items.limit(0)).count() == 6


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("d1", "a b c d e f"), (None, "a b c d e f")], "doc_id string, text string")
    items = spark.createDataFrame([("x", "a b c d e f"), (None, "a b c d e f")], "item_id string, text string")
    assert sorted(((r["doc_id"] or ""), r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()) == [("", "x"), ("d1", "x")]


def test_bound_of_coverage():
    """Only items that shared seeds could cover are tiled; nothing that the tiling would find is passed over."""
    rng = random.Random(5)
    items = [(k, " ".join(str(rng.randrange(12)) for _ in range(rng.choice([0, 3, 8, 30])))) for k in range(60)]
    block = decontaminate._Block(items, 3)
    for _ in range(80):
        text = [str(rng.randrange(12)) for _ in range(60)]
        word = decontaminate.tokens.words(*decontaminate.tokens.raw(decontaminate.pa.array([" ".join(text)])))[1]
        kept = set(block.hits(np.unique(decontaminate._windows(word, 3)), 0.5).tolist())
        covered = {k for k, t in items if t and sum(x[2] for x in tiles(text, t.split(), 3)) >= 0.5 * len(t.split())}
        assert covered <= kept
    assert len(kept) < 60
