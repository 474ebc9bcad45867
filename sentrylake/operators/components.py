"""Connected components of an edge table, without gathering any of it."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sentrylake.work import drop, written


def _round(edges: DataFrame) -> tuple[DataFrame, dict]:
    """Edges (u, v) as a table, and what tells it from others, observed by the pass that writes it."""
    seen = Observation()
    state = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
    return written(edges.observe(seen, *state), "edges"), seen.get


def components(edges: DataFrame, most_rounds: int = 60, merged: bool = False) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that is reachable.

    Alternates the large-star and small-star steps. Each step is two joins-with-minima on hashed keys: the minimum is
    pre-aggregated before the shuffle, so a node with very many neighbours costs no task more than others; joins on such a
    node are split by adaptive execution. Nulls and loops are ignored; repeated edges count once; empty in, empty out.
    merged: no join sends its minima to all tasks, which their files' size may suggest though they are many.
    Lineage ends in the shared folder after each round. Edges that are stars around their smallest node already settle in one
    round.
    """
    of = lambda low: low.hint("merge") if merged else low
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = _round(both)
    for _ in range(most_rounds):
        sides = now.union(now.select("v", "u"))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = sides.join(of(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(of(low), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        after, state = _round(small.where("u <> v").distinct())
        drop(now)
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
