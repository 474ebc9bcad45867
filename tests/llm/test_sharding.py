"""Shards: exact sizes, gapless slots, all rows, the right distribution."""

import re
from collections import Counter
from math import comb
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from sentrylake.llm import sharding
from sentrylake.llm.queries import op1_hypergeometric_shards
from sentrylake.llm.sharding import communication_matrix, hypergeometric, uniform_shards
from tests.llm.brute import SF2


def test_query(spark):
    rows = op1_hypergeometric_shards(spark, SF2).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(40):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, crc32(data), "rows", None)


def test_query_shuffles_whole_documents(spark):
    plan = op1_hypergeometric_shards(spark, SF2)._jdf.queryExecution().optimizedPlan().toString()
    columns = spark.read.parquet(f"{SF2}/documents.parquet").columns
    rows = re.findall(r"(?:named_)?struct\(([^()]*)\) AS row#", plan)
    assert any(all(re.search(rf"\b{c}#", x) for c in columns) for x in rows)
    assert "_extract_" not in plan


def test_partitions_do_not_matter(spark):
    df = spark.range(500).selectExpr("id AS doc_id", "repeat('x', id % 7) AS text")
    a = {r["doc_id"]: (r["shard"], r["slot"]) for r in uniform_shards(df.repartition(1), 7).collect()}
    b = {r["doc_id"]: (r["shard"], r["slot"]) for r in uniform_shards(df.repartition(9), 7).collect()}
    assert a == b


def test_hard_rows(spark):
    rows = [(None, None, 1), (None, "", 1), (3, "a", 2), (3, "a", 2), (3, "b", 2), (4, "x" * 100_000, 9)] + [(7, "same", 0)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, shard long")
    out = uniform_shards(df, 4).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(r[:2] for r in rows)
    assert sorted(Counter(r["shard"] for r in out).values()) == [14, 14, 14, 14]
    assert len({(r["shard"], r["slot"]) for r in out}) == len(rows)
    assert len({r["shard"] for r in out if r["text"] == "same"}) == 4


def test_empty(spark):
    assert uniform_shards(spark.createDataFrame([], "doc_id long, text string"), 3).collect() == []


def test_hypergeometric_law():
    rng, n = np.random.default_rng(1), 20_000
    got = Counter(hypergeometric(rng, 6, 9, 5) for _ in range(n))
    for k in range(6):
        p = comb(6, k) * comb(9, 5 - k) / comb(15, 5)
        assert abs(got[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5


def test_matrix_margins():
    counts, sizes = [10, 0, 25, 7], [14, 14, 14]
    m = np.array(communication_matrix(counts, sizes, 3))
    assert m.sum(1).tolist() == counts and m.sum(0).tolist() == sizes and (m >= 0).all()


def test_rows_without_an_id_fill_all_partitions(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    part = sharding.logical_partition(F.col("doc_id"), F.xxhash64(F.lit(18), "doc_id", "text"), 17, sharding.LEAST_BLOCKS)
    sizes = [r["count"] for r in df.groupBy(part.alias("part")).count().collect()]
    assert len(sizes) == sharding.LEAST_BLOCKS and max(sizes) < 3 * 3000 / len(sizes)
    rows = uniform_shards(df, 7).collect()
    counts = [sum(r["shard"] == s for r in rows) for s in range(7)]
    assert max(counts) - min(counts) <= 1 and len({r["text"] for r in rows}) == 3000
