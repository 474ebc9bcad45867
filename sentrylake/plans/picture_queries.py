"""Queries over pictures: vectors of 64 numbers serve as 8 x 8 grey pixels, and as colours three at a time."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import imaging as I
from sentrylake.operators.lookalike import most_similar
from sentrylake.plans.queries import _table, query

_HEX = "array_to_string([substr('0123456789abcdef', 1 + 8 * b[4 * i + 1] + 4 * b[4 * i + 2] + 2 * b[4 * i + 3] + b[4 * i + 4], 1) FOR i IN range(len(b) // 4)], '')"
_AVERAGE = f"SELECT vec_id, {_HEX} AS hash FROM (SELECT vec_id, [CAST(p >= list_sum(g) / 64 AS INT) FOR p IN g] AS b FROM (SELECT vec_id, [round(CAST(x AS DOUBLE) * 1024) FOR x IN embedding] AS g FROM embeddings))"


def _grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1024)).alias("grey"))


@query(_AVERAGE)
def picture_average_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grey(spark, sf_dir).select("vec_id", I.average_hash(F.col("grey")).alias("hash"))


@query(f"SELECT vec_id, {_HEX} AS hash FROM (SELECT vec_id, [CAST(g[8 * (k // 7) + k % 7 + 2] > g[8 * (k // 7) + k % 7 + 1] AS INT) FOR k IN range(56)] AS b FROM (SELECT vec_id, [round(CAST(x AS DOUBLE) * 1024) FOR x IN embedding] AS g FROM embeddings))")
def picture_gradient_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grey(spark, sf_dir).select("vec_id", I.gradient_hash(F.col("grey"), 8, 8).alias("hash"))


def _colours(v: Column) -> Column:
    level = lambda i: F.least(F.lit(255), F.floor(F.abs(F.get(v, F.pmod(i, F.lit(64))).cast("double")) * 1024).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(level(i).alias("r"), level(i + 1).alias("g"), level(i + 2).alias("b")))


@query("""WITH v AS (SELECT vec_id, [least(255, CAST(floor(abs(CAST(x AS DOUBLE)) * 1024) AS INT)) FOR x IN embedding] AS c FROM embeddings),
    p AS (SELECT vec_id, [[c[i + 1], c[(i + 1) % 64 + 1], c[(i + 2) % 64 + 1]] FOR i IN range(64)] AS px FROM v),
    s AS (SELECT vec_id, px, [x FOR x IN px IF NOT (list_min(x) > 235 OR list_max(x) < 20 OR list_max(x) - list_min(x) < 18)] AS shown FROM p),
    b AS (SELECT vec_id, [x[1] // 64 * 16 + x[2] // 64 * 4 + x[3] // 64 FOR x IN (CASE WHEN len(shown) >= 50 THEN shown ELSE px END)] AS bins FROM s)
    SELECT vec_id, [round(len([x FOR x IN bins IF x = k]) / len(bins), 5) FOR k IN range(64)] AS palette FROM b""")
def picture_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", I.palette(_colours(F.col("embedding"))).alias("palette"))


@query(f"""WITH h AS ({_AVERAGE}), s AS (SELECT a.vec_id, b.vec_id AS ref, bit_count(xor(('0x' || substr(a.hash, 1, 8))::BIGINT, ('0x' || substr(b.hash, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(a.hash, 9, 8))::BIGINT, ('0x' || substr(b.hash, 9, 8))::BIGINT)) AS apart FROM h a JOIN h b ON b.vec_id % 2 = 1 WHERE a.vec_id % 2 = 0)
    SELECT vec_id, arg_min(ref, struct_pack(a := apart, r := ref)) AS ref, 1 - min(apart) / 64.0 AS sim FROM s WHERE apart <= 19 GROUP BY vec_id""")
def picture_most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of even numbers against a library of all odd ones."""
    h = _grey(spark, sf_dir).select("vec_id", I.average_hash(F.col("grey")).alias("hash"))
    return most_similar(h.where("vec_id % 2 = 0"), h.where("vec_id % 2 = 1").toDF("ref", "ref_hash"), "vec_id", 0.7)
