"""The digest index against the SQL, and over several batches."""

import hashlib
import uuid

import pytest

from sentrylake.llm import exact_dedup
from sentrylake.llm.exact_dedup import DigestIndex, deduplicate
from sentrylake.llm.queries import ORACLES, op9_digest_index_dedup
from tests.compare import assert_same, views
from tests.llm.brute import SF2


def exact_dedup_digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark):
    assert_same(op9_digest_index_dedup(spark, SF2), views(SF2), ORACLES["op9_digest_index_dedup"])


def test_batches(spark, tmp_path):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    one = spark.createDataFrame([(5, "a  b"), (3, "a\tb"), (4, None), (9, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["known"]) for r in deduplicate(one, DigestIndex(spark, path, 4)).collect()}
    assert got == {5: (3, 2, False, False), 3: (3, 2, True, False), 4: (4, 2, True, False), 9: (4, 2, False, False)}
    two = spark.createDataFrame([(1, "a b"), (2, "c"), (8, "c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"], r["known"]) for r in deduplicate(two, DigestIndex(spark, path, 4)).collect()}
    assert got == {1: (3, False, True), 2: (2, True, False), 8: (2, False, False)}
    assert DigestIndex(spark, path, 4).rows().count() == 3


def test_hot_by_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    found = []
    monkeypatch.setattr(exact_dedup, "hot_rows", lambda *a, f=exact_dedup.hot_rows: found.append(f(*a)) or found[-1])
    index = DigestIndex(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", 4)
    deduplicate(spark.createDataFrame([(k, "old") for k in range(5)] + [(9, "x")], "doc_id long, text string"), index)
    two = spark.createDataFrame([(k, "x") for k in range(20, 24)] + [(30, "old"), (31, "new")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["known"]) for r in deduplicate(two, index).collect()}
    assert got == {k: (9, 1, False, True) for k in range(20, 24)} | {30: (0, 5, False, True), 31: (31, 1, True, False)}
    assert [(r["keep_id"], r["group_size"]) for r in found[-1].collect()] == [(9, 1)]  # not the 5 rows of the older batch


def _answer(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_batch_again(spark, tmp_path):
    """A job that runs again after its batch has reached the index, wholly or in part, gives the same answer."""
    index = DigestIndex(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", 4)
    deduplicate(spark.createDataFrame([(50, "old"), (51, "older")], "doc_id long, text string"), index)
    df = spark.createDataFrame([(5, "a"), (3, "a"), (4, None), (9, "old"), (10, "new")], "doc_id long, text string")
    first = _answer(deduplicate(df, index, "b"))
    assert [r[0] for r in first if r[3]] == [10, 3, 4]
    assert _answer(deduplicate(df, index, "b")) == first and index.rows().count() == 5
    assert _answer(deduplicate(df, index, "c")) != first  # another batch of the same rows knows them all


def test_a_crash_between(spark, tmp_path):
    index = DigestIndex(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", 4)
    df = spark.createDataFrame([(k, f"t{k % 7}") for k in range(20)], "doc_id long, text string")
    half = spark.createDataFrame([(exact_dedup_digest(f"t{k}"), k, n) for k, n in ((0, 3), (1, 3), (2, 3))], "digest string, keep_id long, group_size long")
    index.append(half, "b")  # what an attempt left behind
    want = _answer(deduplicate(df, DigestIndex(spark, None, 4), "b"))
    assert _answer(deduplicate(df, index, "b")) == want and index.rows().count() == 7
    named = _answer(deduplicate(df, DigestIndex(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", 4)))
    assert named == want


def test_small_batch_on_large_groups(spark, tmp_path, monkeypatch):
    """Large groups of older batches aren't hot for a small one; ids may be strings."""
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    index = DigestIndex(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", 4, "STRING")
    deduplicate(spark.createDataFrame([(f"i{k:03}", f"t{k % 5}") for k in range(200)], "doc_id string, text string"), index)
    got = deduplicate(spark.createDataFrame([("x", "t1"), ("y", "t2"), ("z", "fresh")], "doc_id string, text string"), index).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["known"]) for r in got} == {"x": ("i001", 40, False, True), "y": ("i002", 40, False, True), "z": ("z", 1, True, False)}


def test_hard_rows(spark):
    df = spark.createDataFrame([(None, "x", 1), (None, "y", 1), (2, "y", 1), (2, "y", 1), (7, "l" * 500_000, 1)], "doc_id long, text string, digest int")
    got = sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["kept"]) for r in deduplicate(df, DigestIndex(spark)).collect())
    assert got == [(-1, -1, True), (-1, 2, False), (2, 2, True), (2, 2, True), (7, 7, True)]
    assert deduplicate(df.limit(0), DigestIndex(spark)).collect() == []


@pytest.mark.parametrize("forgotten", [False, True])
def test_another_number_of_buckets(spark, tmp_path, forgotten):
    """The stored number holds, in the same catalogue and in one that doesn't know the table."""
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    index = DigestIndex(spark, path, 4)
    deduplicate(spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string"), index)
    if forgotten:
        spark.sql(f"DROP TABLE {index.table}")  # the files stay
    again = DigestIndex(spark, path, 16, "STRING")
    assert (again.buckets, again.id_type) == (4, "BIGINT")
    got = deduplicate(spark.createDataFrame([(k + 1000, f"text {k}") for k in range(300)], "doc_id long, text string"), again).collect()
    assert sorted(r["doc_id"] for r in got if r["kept"]) == list(range(1200, 1300)) and again.rows().count() == 300
    again.drop()


def test_rows_without_a_layout(spark, tmp_path):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    spark.range(3).write.parquet(path)
    with pytest.raises(ValueError):
        DigestIndex(spark, path, 4)
