"""Hashes of pictures against numpy, and look-ups of similar hashes against all pairs."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sentrylake.functions import imaging as I
from sentrylake.operators import lookalike
from sentrylake.operators.lookalike import bits_apart, most_similar

SF = "/root/testdata/sf0.001"


def _hex(bits):
    return f"{int(''.join(str(int(b)) for b in bits), 2):0{len(bits) // 4}x}"


def _perceptual(pixels, edge):
    k = np.arange(edge)
    d = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * edge)) * np.sqrt(2 / edge)
    d[0] /= np.sqrt(2)
    low = (d @ np.array(pixels, float).reshape(edge, edge) @ d.T)[:8, :8].ravel()
    return _hex(low > np.median(low[1:]))


def test_perceptual_hash(spark):
    small = pq.read_table(f"{SF}/embeddings.parquet")["embedding"].to_pylist()[:40]
    rng = np.random.default_rng(4)
    large = [rng.integers(0, 256, 1024).tolist() for _ in range(6)]
    got = spark.createDataFrame([(p,) for p in small], "p array<double>").select(I.perceptual_hash(F.col("p"), 8)).collect()
    assert [r[0] for r in got] == [_perceptual(p, 8) for p in small]
    got = spark.createDataFrame([(p,) for p in large], "p array<int>").select(I.perceptual_hash(F.col("p")), I.average_hash(F.col("p"), 32)).collect()
    assert [r[0] for r in got] == [_perceptual(p, 32) for p in large] and [r[1] for r in got] == [_hex(np.array(p) >= np.mean(p)) for p in large]


def test_odd_pictures(spark):
    df = spark.createDataFrame([(None,), ([],), ([1.0] * 63,), ([None] + [1.0] * 63,)], "p array<double>")
    assert all(r == (None, None, None) for r in df.select(I.average_hash(F.col("p")), I.gradient_hash(F.col("p"), 8), I.perceptual_hash(F.col("p"), 8)).collect())
    colours = "p array<struct<r:int,g:int,b:int>>"
    got = spark.createDataFrame([([(255, 255, 255)] * 900 + [(200, 10, 10)] * 50,), ([(255, 255, 255)] * 900 + [(200, 10, 10)] * 49,), ([],), (None,)], colours).select(I.palette(F.col("p"))).collect()
    assert got[0][0][48] == 1.0 and got[1][0][63] == 0.94837 and got[2][0] is None and got[3][0] is None


@pytest.mark.parametrize("bits,least", [(64, 0.85), (128, 0.85), (64, 1.0)])
def test_most_similar(spark, bits, least):
    rng = random.Random(bits)
    refs = [(k, f"{rng.getrandbits(bits):0{bits // 4}x}") for k in range(400)]
    rows = [(k, h) for k, h in enumerate([None, "", "zz", refs[0][1][:-1], refs[0][1].upper()])]
    for k in range(300):
        value = int(rng.choice(refs)[1], 16)
        for _ in range(rng.randrange(bits // 5)):
            value ^= 1 << rng.randrange(bits)
        rows += [(10 + k, f"{value:0{bits // 4}x}")] * rng.choice([1, 3])
    refs += [(900, refs[3][1]), (901, None), (902, "x")]
    want = []
    for k, h in rows:
        if h and len(h) == bits // 4 and h == h.lower():
            apart, ref = min(((int(h, 16) ^ int(r, 16)).bit_count(), i) for i, r in refs if r and len(r) > 1)
            if apart <= int((1 - least) * bits + 1e-9):
                want.append((k, ref, 1 - apart / bits))
    got = most_similar(spark.createDataFrame(rows, "id long, hash string"), spark.createDataFrame(refs, "ref long, ref_hash string"), "id", least, bits)
    assert sorted(map(tuple, got.collect())) == sorted(want) and (least == 1 or len(want) > 100)


def test_a_large_library(spark):
    """100,000 references: what meets is a small share of all pairs, and the plan is that of a small library."""
    refs = spark.range(100_000).select(F.col("id").alias("ref"), F.substring(F.md5(F.col("id").cast("string")), 1, 16).alias("ref_hash"))
    rows = refs.where("ref % 1000 = 7").select(F.col("ref").alias("id"), F.concat(F.substring("ref_hash", 1, 15), F.lit("0")).alias("hash"))
    pairs = rows.crossJoin(F.broadcast(refs)) if rows.count() == 100 else None  # brute force
    best = pairs.groupBy("id").agg(F.min(F.struct(bits_apart(F.col("hash"), F.col("ref_hash")).alias("a"), "ref")).alias("x")).where("x.a <= 9").select("id", "x.ref")
    assert sorted(map(tuple, most_similar(rows, refs, "id").select("id", "ref").collect())) == sorted(map(tuple, best.collect()))


def test_few_equal_bits(spark):
    """Where 19 of 64 bits may differ, nearly all pairs share a piece: they meet by blocks, more than one of each side, and ties go to
    the smallest reference across blocks."""
    rng = random.Random(7)
    refs = [(f"r{k:04d}", rng.getrandbits(64)) for k in range(300)]
    refs += [(f"q{k:04d}", v) for k, (_, v) in enumerate(refs[:20])]
    rows = [(k, rng.getrandbits(64) if k % 2 else refs[k][1] ^ rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)) for k in range(250)]
    want = {(k, min((((v ^ r).bit_count(), i) for i, r in refs))) for k, v in rows}
    hexed = lambda pairs: [(k, f"{v:016x}") for k, v in pairs]
    most, lookalike.BLOCK = lookalike.BLOCK, 64
    try:
        found = most_similar(spark.createDataFrame(hexed(rows), "id long, hash string"), spark.createDataFrame(hexed(refs), "ref string, ref_hash string"), "id", 0.7)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        got = set(map(tuple, found.collect()))
    finally:
        lookalike.BLOCK = most
    assert got == {(k, ref, 1 - apart / 64) for k, (apart, ref) in want if apart <= 19} and len(got) > 100
    assert "MapInArrow" in plan
    assert most_similar(spark.createDataFrame([], "id long, hash string"), spark.createDataFrame(hexed(refs), "ref string, ref_hash string"), "id", 0.7).count() == 0
