"""Mixing overlapping sources to target weights by min-cost flow.

Documents are added up by membership pattern: the set of sources they are in. The flow graph has a node for each pattern and
each source, so its size doesn't depend on the documents. A pattern's words can be taken once for nothing, and again at a
cost that rises with each repetition; each source has a quota. The cheapest flow says how many words each pattern gives to
each source. A pattern then gives its documents in the order of a seeded hash: all of them for each whole repetition, and the
first of them up to the last hash that fits for the rest, so what executors need to know is one hash for each pattern.
"""

import json
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentrylake.work import drop, written

SEED = "mix-1"
#: Leading hex digits of the hash by which sizes are added up, to find the bucket that the last document is in.
DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weighted_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Weights in the order of the sources' code points, null last, repeating; no target is above most times its source's
    size, and what is above is shared out again by weight."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return out


def min_cost_flow(capacity: list[int], members: list[list[int]], quotas: list[int], epochs: int) -> list[dict[int, int]]:
    """Words that each pattern gives to each of its sources. The e-th repetition of a word costs e squared; quotas are met as
    far as capacity goes, at the least cost. Successive shortest paths, found label by label."""
    p, s = len(capacity), len(quotas)
    source, sink = p + s, p + s + 1
    arcs: list[list[int]] = []  # to, left, cost
    out: list[list[int]] = [[] for _ in range(p + s + 2)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    for i, size in enumerate(capacity):
        for e in range(epochs):
            arc(source, i, size, e * e)
    gives = {}
    for i, own in enumerate(members):
        for j in own:
            gives[i, j] = len(arcs)
            arc(i, p + j, epochs * capacity[i], 0)
    for j, quota in enumerate(quotas):
        arc(p + j, sink, quota, 0)
    while True:
        cost, by, queue, waits = [None] * (p + s + 2), [-1] * (p + s + 2), deque([source]), {source}
        cost[source] = 0
        while queue:
            a = queue.popleft()
            waits.discard(a)
            for k in out[a]:
                b, room, c = arcs[k]
                if room > 0 and (cost[b] is None or cost[a] + c < cost[b]):
                    cost[b], by[b] = cost[a] + c, k
                    if b not in waits:
                        waits.add(b)
                        queue.append(b)
        if cost[sink] is None:
            break
        path, node = [], sink
        while node != source:
            path.append(by[node])
            node = arcs[by[node] ^ 1][0]
        n = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= n
            arcs[k ^ 1][1] += n
    return [{j: arcs[gives[i, j] ^ 1][1] for j in own} for i, own in enumerate(members)]


@dataclass
class Plan:
    """patterns: pattern, sources, given (words that the flow takes), whole (repetitions of every document), last (the last
    hash that is taken once more, or null); sizes and targets by source."""

    patterns: list[dict]
    sizes: dict[str | None, int]
    targets: dict[str | None, float]

    def table(self, df: DataFrame) -> DataFrame:
        rows = [{"pattern": x["pattern"], "whole": x["whole"], "last": x["last"], "source_size": self.sizes[x["sources"][0]] if x["sources"] else 0, "target": self.targets[x["sources"][0]] if x["sources"] else 0.0} for x in self.patterns]
        kind = "array<struct<pattern:string,whole:int,last:string,source_size:bigint,target:double>>"
        return df.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind)).alias("x")).select("x.*")


def _hash(docs: DataFrame) -> Column:
    text = F.concat(F.lit("text:"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("string"))
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), text)).cast("binary"))


def plan_mix(docs: DataFrame, members: Column, targets: Callable[[dict], dict], epochs: int = 2) -> Plan:
    """The mix of docs to the targets that are made from the sources' sizes (the words of all their documents)."""
    pattern, key = F.to_json(F.array_sort(members)), _hash(docs)
    slot = F.substring(key, 1, DIGITS)
    sums = written(docs.select(pattern.alias("pattern"), slot.alias("slot"), words(F.col("text")).alias("size")).groupBy("pattern", "slot").agg(F.sum("size").alias("size")), "mixsums")
    totals = {r["pattern"]: r["size"] for r in sums.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}  # a row for each pattern
    found = sorted(totals)
    sources = {p: json.loads(p) for p in found}
    sizes: dict[str | None, int] = {}
    for p in found:
        for s in sources[p]:
            sizes[s] = sizes.get(s, 0) + totals[p]
    goal = targets(sizes)
    order = list(sizes)
    at = {s: i for i, s in enumerate(order)}
    flow = min_cost_flow([totals[p] for p in found], [sorted({at[s] for s in sources[p]}) for p in found], [round(goal[s]) for s in order], epochs)
    rows = []
    for p, gives in zip(found, flow, strict=True):
        given = sum(gives.values())
        whole, rest = divmod(given, totals[p]) if totals[p] else (1, 0)
        rows.append({"pattern": p, "sources": sources[p], "given": given, "whole": whole, "rest": rest, "last": None})
    # the bucket of hashes where each pattern's rest runs out, then the last document within it
    kind = "array<struct<pattern:string,rest:bigint>>"
    rests = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"pattern": x["pattern"], "rest": x["rest"]} for x in rows])), kind)).alias("x")).select("x.*")
    so_far = F.sum("size").over(Window.partitionBy("pattern").orderBy("slot"))
    ends = sums.withColumn("upto", so_far).join(rests, "pattern").where("rest > 0 AND upto - size < rest AND rest <= upto")
    ends = ends.select("pattern", "slot", (F.col("rest") - F.col("upto") + F.col("size")).alias("room"))
    near = docs.select(pattern.alias("pattern"), slot.alias("slot"), key.alias("key"), "text").join(F.broadcast(ends), ["pattern", "slot"])
    near = near.select("pattern", "room", "key", words(F.col("text")).alias("size"))
    before = F.sum("size").over(Window.partitionBy("pattern").orderBy("key")) - F.col("size")
    picked = near.withColumn("before", before).where(F.col("before") + F.col("size") / 2 <= F.col("room"))
    last = {r["pattern"]: r["key"] for r in picked.groupBy("pattern").agg(F.max("key").alias("key")).collect()}
    slots = {r["pattern"]: r["slot"] for r in ends.collect()}
    drop(sums)
    for x in rows:
        if x["rest"]:
            x["last"] = last.get(x["pattern"], slots[x["pattern"]])  # a bucket's name sorts before all its hashes
    return Plan(rows, sizes, goal)


def mixed(docs: DataFrame, plan: Plan, members: Column) -> DataFrame:
    """docs with size (words), times (how often the mix takes the document), taken (size times that), source_size and target
    (of the first of its sources).

    A null text has no words. A null source is a source of its own, which sorts last. Rows that repeat an id are taken alike;
    rows without an id are told apart by their text. Documents without words are taken as often as their hash says. Other
    columns are carried; those named like the new ones are replaced. An empty table gives no rows. Nothing is shuffled: the
    plan has a row for each pattern.
    """
    new = ["size", "times", "taken", "source_size", "target"]
    own = [f"row.{c}" for c in docs.columns if c not in new]
    return _planned(docs, plan, members).select(*own, "size", "times", (F.col("size") * F.col("times")).cast("long").alias("taken"), "source_size", "target")


def repeated(docs: DataFrame, plan: Plan, members: Column) -> DataFrame:
    """The rows of docs as often as the mix takes each, with their own columns, whatever the names, and no others. Nulls, repeats and empty
    tables as with mixed()."""
    taken = _planned(docs, plan, members).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth")).select("row.*")


def _planned(docs: DataFrame, plan: Plan, members: Column) -> DataFrame:
    """Each row of docs as a struct, row, beside size, times and the plan's columns."""
    row = docs.select(F.struct(*docs.columns).alias("row"), F.to_json(F.array_sort(members)).alias("pattern"), _hash(docs).alias("key"), words(F.col("text")).alias("size"))
    times = F.col("whole") + F.coalesce((F.col("key") <= F.col("last")).cast("int"), F.lit(0))
    return row.join(F.broadcast(plan.table(docs)), "pattern").withColumn("times", times)


def by_source(docs: DataFrame) -> Column:
    return F.array(docs["source"])
