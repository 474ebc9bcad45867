"""Each stage of the pipeline on what its predecessor kept, against brute force."""

from collections import Counter

import pytest

import corpus_pipeline
from sentrylake.llm import decontaminate, mixing, quality
from tests.llm.brute import SF, near_components, tiles, words
from tests.llm.test_mixing import WORD

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows before each stage and after the last."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    out = [df]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def _ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_columns(kept):
    assert all(df.columns == COLUMNS for df in kept[:-1])
    assert set(kept[-1].columns) == {*COLUMNS, "shard", "slot"}


def test_quality(spark, kept):
    model = quality.fit(kept[0], spark.read.parquet(f"{SF}/labels.parquet"))
    rows = kept[0].toArrow()
    score = model.scores(rows.column("text").combine_chunks())
    want = {i for i, s in zip(rows.column("doc_id").to_pylist(), score, strict=True) if s >= 0.3}
    assert set(_ids(kept[1])) == want and 0 < len(want) < kept[0].count()


def test_near_copies(kept):
    comp = near_components([(r["doc_id"], r["text"]) for r in kept[1].collect()])
    assert sorted(_ids(kept[2])) == sorted(i for i, (_, c) in comp.items() if i == c)


def test_decontamination(spark, kept):
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = set(_ids(kept[3]))
    for r in kept[2].collect():
        w = words(r["text"])
        if len(w) > 500:
            continue
        seeds = {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
        hit = any(seeds & {tuple(x[i : i + 4]) for i in range(len(x) - 3)} and sum(t[2] for t in tiles(w, x, 4)) >= decontaminate.COVERAGE * len(x) for x in items)
        assert (r["doc_id"] in left) == (not hit)
    assert left


def test_mix(kept):
    before, after = kept[3].collect(), Counter(_ids(kept[4]))
    assert set(after) <= {r["doc_id"] for r in before} and max(after.values()) <= 2
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in before}
    sizes, taken = {}, {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[r["doc_id"]]
        taken[r["source"]] = taken.get(r["source"], 0) + size[r["doc_id"]] * after[r["doc_id"]]
    for s, target in mixing.weighted_targets(sizes).items():
        assert abs(taken[s] - target) <= max(size.values())


def test_shards(kept):
    rows = kept[5].collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(_ids(kept[4]))
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows) and all(r["slot"] < counts[r["shard"]] for r in rows)


def test_run(spark, kept):
    assert Counter(_ids(corpus_pipeline.run(spark, SF))) == Counter(_ids(kept[5]))


@pytest.mark.parametrize("rows", [0, 1])
def test_hard_rows(spark, tmp_path, rows):
    """Own columns, whatever their names, come back as they went in; nulls, empty and long texts, repeats and empty tables."""
    names = ["size", "times", "taken", "source_size", "target", "_quality", "score", "set_key", "mark", "first", "row", "key", "pattern", "whole", "last", "nth"]
    texts = [None, "", " ", "a b", "the same words in the very same order", "the same words in the very same order", "w " * 200_000]
    data = [(k if k % 3 else None, t, None if k == 2 else "en", None if k % 2 else "s", None, *([f"own {k}"] * len(names))) for k, t in enumerate(texts)]
    data += [data[3]] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame(data if rows else [], schema)
    for name in ("labels", "benchmark"):
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        (table if rows else table.limit(0)).write.parquet(f"file://{tmp_path}/{name}.parquet")
    whole = {tuple(r) for r in data}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, f"file://{tmp_path}")
        got = [tuple(r) for r in docs.select(*(f"`{c.split()[0]}`" for c in schema.split(", "))).collect()]
        assert set(got) <= whole and bool(got) <= bool(rows), name
        if name != "sharding":
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    assert bool(got) == bool(rows)
