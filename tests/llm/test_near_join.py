"""The parity-sketch join against all pairs by brute force."""

import random

import pytest

from sentrylake.llm.near_join import near_components, one_of_each
from sentrylake.llm.queries import op10_parity_sketch_join
from tests.llm.brute import SF, SF2, near_components as brute


def _same(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_components(df).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("sf", [SF, SF2])
def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op10_parity_sketch_join(spark, sf).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)


def _edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_crowded_groups(spark):
    """Many near copies of a few texts, and a passage that most documents share: keys far over the hot bound."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows, n = [], 0
    for family in range(4):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(90)]
        for _ in range(60):
            rows.append((n, _edited(rng, base, rng.randrange(5))))
            n += 1
    for _ in range(150):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 40))]
        rows.append((n, " ".join(passage + own)))
        n += 1
    _same(spark, rows)


def test_sizes_near_the_threshold(spark):
    """Pairs of every size around bands' ends, whose overlap is just over or under 3/4."""
    rng, rows, n = random.Random(8), [], 0
    for size in [*range(1, 40), 63, 64, 65, 127, 128, 129, 250]:
        base = [f"s{size}x{i}" for i in range(size + 4)]
        for cut in {0, 1, size // 7, size // 4, size // 4 + 1, size // 3}:
            rows.append((n, " ".join(base[: len(base) - cut])))
            n += 1
    rng.shuffle(rows)
    _same(spark, rows)


def test_hard_rows(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "a b"), (9, "A  b"), (10, "a b c d e"), (11, "x " * 50_000), (12, "X\n" * 50_000), (13, "é É")]
    _same(spark, rows)
    clash = spark.createDataFrame([(None, "a b c", 1, 2), (3, "a b c", 1, 2), (3, "a b c", 1, 2), (1, None, None, None)], "doc_id long, text string, set_key long, n_shingles long")
    got = sorted(((r["doc_id"] or -1), r["n_shingles"], r["component_id"]) for r in near_components(clash).collect())
    assert got == [(-1, 1, 3), (1, 0, 1), (3, 1, 3), (3, 1, 3)]
    assert near_components(clash.limit(0)).collect() == []


def test_one_of_each(spark):
    df = spark.createDataFrame([(1, "q w e r t y"), (2, "q w e r t y"), (3, "z"), (None, "z"), (4, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1) for r in one_of_each(df).collect()) == [-1, 1, 3, 4]


def test_one_of_each_tells_rows_by_their_texts(spark):
    rows = [(1, "A b c d e f"), (2, "a b c d e f"), (2, "another text that nothing repeats"), (5, "one two three four five six seven eight nine ten"), (5, "one two three four five six seven eight nine ten eleven")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, mark string, first int")
    got = one_of_each(df)
    assert got.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(left)[:2] == [rows[0], rows[2]] and len(left) == 3 and left != rows[3:]


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("b", "q w e r t y"), ("a", "Q w e r t y"), ("c", None)], "doc_id string, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_components(df).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert sorted(r["doc_id"] for r in one_of_each(df).collect()) == ["a", "c"]
