"""Held-out accuracy of the quality classifier, and its edge cases."""

import tracemalloc
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sentrylake.llm import quality
from sentrylake.llm.queries import op3_subword_quality

SF1 = "/root/testdata/sf0.1"


def test_held_out(spark):
    rows = {r["doc_id"]: r for r in op3_subword_quality(spark, SF1).collect()}
    assert len(rows) == spark.read.parquet(f"{SF1}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == (crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    marked = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF1}/labels.parquet").where("quality IS NOT NULL").collect()]
    held = [(rows[i]["score"], q) for i, q in marked if i in rows and rows[i]["held_out"]]
    good, bad = np.array([s for s, q in held if q == 1]), np.array([s for s, q in held if q == 0])
    auc = np.mean(good[:, None] > bad[None, :]) + 0.5 * np.mean(good[:, None] == bad[None, :])
    kept = np.mean(good >= 0.3)
    print("AUC", auc, "good kept", kept, "bad dropped", np.mean(bad < 0.3))
    assert auc > 0.85 and kept > 0.9


def test_labels_of_the_held_fold_are_not_read(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad stuff there") for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "x", 5), (4, "word " * 100_000, 5), (4, "w", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(2, 1), (None, 0), (4, None)], "doc_id long, quality int")
    rows = quality.scored(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    none = quality.fit(docs.limit(0), labels.limit(0))
    assert {r["score"] for r in quality.scored(docs, none).collect()} == {0.5}
    assert quality.scored(docs.limit(0), none).collect() == []


def test_memory_of_scoring():
    """Features of 256 KB of text were held at once."""
    texts = pa.array([f"{i} some words of a longer text " * 80 for i in range(2000)])
    model = quality.Model(np.ones(quality.BUCKETS, np.float32), 0.0)
    model.scores(texts.slice(0, 5))  # the powers that hashes need are made once
    tracemalloc.start()
    scores = model.scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores) == 2000 and len(set(scores)) == 1 and peak < 12_000_000


def test_rows_leave_in_pieces(spark):
    """All columns, in order, where a batch is scored in several pieces."""
    docs = spark.range(0, 300, numPartitions=1).selectExpr("id AS doc_id", "IF(id % 7 = 0, NULL, repeat(concat('w', id, ' '), 200)) AS text", "id * 2 AS other")
    model = quality.Model(np.random.default_rng(5).normal(size=quality.BUCKETS).astype(np.float32) * 20, 0.0)
    rows = quality.scored(docs, model).collect()
    assert [(r["doc_id"], r["other"]) for r in rows] == [(i, 2 * i) for i in range(300)] and rows[7]["score"] == 0.5
    alone = [float(model.scores(pa.array([r["text"]], pa.string()))[0]) for r in rows]
    assert [r["score"] for r in rows] == alone
    assert [r["doc_id"] for r in quality.kept(docs, model).collect()] == [i for i in range(300) if alone[i] >= quality.KEPT]
