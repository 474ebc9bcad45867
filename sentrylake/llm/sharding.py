"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are first dealt to logical partitions by a hash of their id and their other columns. How many rows each partition sends to each slice of each
shard is drawn exactly: a matrix with the partitions' counts and the slices' sizes as its margins, as a uniform random
permutation would give. Each partition permutes its rows locally and cuts them by its row of the matrix; after the exchange
each slice permutes what it got. All of it is DataFrame operations; the driver draws the matrix only, whose size depends on
the number of partitions and slices, not of rows.
"""

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a logical partition or slice should hold, and bounds on their number (the matrix has at most 2048 x 2048 cells
#: for up to 2048 shards): above 2 G rows, partitions grow instead, and their sorts spill.
BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS = 1 << 20, 64, 2048


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn rows are good. Exact to double precision for any size: inversion over all values within 12
    standard deviations of the mode; what lies beyond has less weight than the last bit of a random number."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max(int((n + 1) * (good + 1) / (total + 2)), low), high)
    spread = int(12 * (n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5) + 32
    x = np.arange(max(low, mode - spread), min(high, mode + spread), dtype=np.float64)
    steps = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1)
    log_p = np.concatenate([[0.0], np.cumsum(steps)])
    weight = np.cumsum(np.exp(log_p - log_p.max()))
    return int(max(low, mode - spread) + np.searchsorted(weight, rng.random() * weight[-1], "right"))


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of counts[i] dealt to columns of sizes[j], each cell a hypergeometric draw given those before it."""
    rng, left, matrix = np.random.default_rng(seed), list(sizes), []
    for rows in counts:
        line, pool = [], sum(left)
        for j, size in enumerate(left):
            pool -= size
            took = hypergeometric(rng, size, pool, rows) if rows else 0
            line.append(took)
            rows -= took
        left = [a - b for a, b in zip(left, line, strict=True)]
        matrix.append(line)
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def logical_partition(row_id: Column, mark: Column, seed: int, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), row_id, mark), F.lit(blocks)).cast("int")


def uniform_shards(df: DataFrame, shards: int = 40, seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """df with shard and slot added: a uniformly random permutation of all rows cut into shards whose counts differ by one
    at most; slots run from 0 without gaps.

    The same rows, whatever the partitions of df, give the same shards; rows that share an id (or have none) are told apart
    by their other columns, which deal them to all partitions alike, and full repeats by their place among each other. Counting
    reads and hashes whole rows for that. Nulls, empty texts and extra columns are carried along; clashing columns named shard or slot
    are replaced. An empty df gives an empty result. One exchange brings rows to their partition, one to their slice.
    """
    own = [c for c, kind in df.dtypes if c not in ("shard", "slot") and not kind.startswith(("map", "variant"))]
    rest = [c for c in df.columns if c not in ("shard", "slot")]
    rows = df.count()
    blocks = min(max(LEAST_BLOCKS, -(-rows // BLOCK_ROWS)), MOST_BLOCKS)
    per_shard = max(1, min(-(-rows // (shards * BLOCK_ROWS)), MOST_BLOCKS // shards))
    mark = F.xxhash64(F.lit(seed + 1), *own)
    part = logical_partition(F.col(id_col), mark, seed, blocks)
    got = {r["part"]: r["n"] for r in df.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # blocks rows
    counts = [got.get(p, 0) for p in range(blocks)]
    slices = [(s, k, start, size) for s, whole in enumerate(shard_sizes(rows, shards)) for k, (start, size) in enumerate(_cuts(whole, per_shard))]
    matrix = communication_matrix(counts, [x[3] for x in slices], seed)
    plan = [{"part": p, "cum": np.cumsum(line).tolist()} for p, line in enumerate(matrix)]
    spark = df.sparkSession
    cuts = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(plan)), "array<struct<part:int,cum:array<bigint>>>")).alias("x")).select("x.*")

    row = F.struct(*rest)
    dealt = df.select(row.alias("row"), part.alias("part"), mark.alias("mark"), F.col(id_col).alias("id")).repartition("part")
    nth = F.row_number().over(Window.partitionBy("part", "mark").orderBy("id"))
    local = dealt.withColumn("nth", nth).withColumn("mix", F.xxhash64(F.lit(seed + 2), "mark", "nth"))
    local = local.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("mix", "mark", "nth")) - 1)
    sent = local.join(F.broadcast(cuts) if blocks * len(slices) <= 1 << 17 else cuts, "part")
    sent = sent.select("row", "mark", "nth", F.size(F.filter("cum", lambda c: c <= F.col("rank"))).alias("slice"))
    again = Window.partitionBy("slice").orderBy(F.xxhash64(F.lit(seed + 3), "mark", "nth"), "mark", "nth")
    put = sent.withColumn("at", F.row_number().over(again) - 1)
    table = F.from_json(F.lit(json.dumps([[x[0], x[2]] for x in slices])), "array<array<bigint>>")
    here = F.element_at(table, F.col("slice") + 1)
    return put.select("row.*", here[0].cast("int").alias("shard"), (here[1] + F.col("at")).alias("slot"))


def _cuts(size: int, parts: int) -> list[tuple[int, int]]:
    out, start = [], 0
    for n in shard_sizes(size, parts):
        out.append((start, n))
        start += n
    return out
