"""The mix: targets by a plain rule, the flow against all integer flows, and what documents give."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from sentrylake.llm import mixing
from sentrylake.llm.queries import op6_min_cost_flow_mix
from tests.llm.brute import SF2, WORD


def test_targets():
    assert mixing.weighted_targets({"a": 100, "b": 100, "c": 100}) == pytest.approx({"a": 200, "b": 250 / 3, "c": 500 / 3})
    t = mixing.weighted_targets({"b": 10, None: 1000, "a": 10})
    assert t == pytest.approx({"a": 20, "b": 20, None: 1490})
    assert mixing.weighted_targets({}) == {}
    assert mixing.weighted_targets({"a": 0}) == {"a": 0}


def test_flow_is_cheapest():
    """Two patterns, two sources, all ways to give words."""
    for capacity, quotas in (([3, 2], [4, 3]), ([2, 3], [1, 5]), ([3, 3], [6, 6]), ([1, 4], [7, 1])):
        members = [[0, 1], [1]]
        cost = lambda n, size: max(0, n - size)  # noqa: E731  the second repetition costs 1 a word
        best = None
        for a, b, c in product(range(9), repeat=3):
            if a + b <= 2 * capacity[0] and c <= 2 * capacity[1] and a <= quotas[0] and b + c <= quotas[1]:
                key = (-(a + b + c), cost(a + b, capacity[0]) + cost(c, capacity[1]))
                best = min(best or key, key)
        flow = mixing.min_cost_flow(capacity, members, quotas, 2)
        given = [sum(x.values()) for x in flow]
        assert (-sum(given), sum(cost(n, s) for n, s in zip(given, capacity))) == best


def test_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    rows = op6_min_cost_flow_mix(spark, SF2).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    sizes, taken, targets = {}, {}, {}
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(WORD.findall(d["text"] or "")) and r["taken"] <= 2 * r["size"]
        s = d["source"]
        sizes[s], taken[s], targets[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"], r["target"]
    want = mixing.weighted_targets(sizes)
    longest = max(r["size"] for r in rows)
    for r in rows:
        assert r["source_size"] == sizes[docs[r["doc_id"]]["source"]] and r["target"] == pytest.approx(want[docs[r["doc_id"]]["source"]])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= longest
    again = {r["doc_id"]: r["taken"] for r in op6_min_cost_flow_mix(spark, SF2).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_overlapping_sources(spark):
    rows = [(i, "w " * (1 + i % 5), ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b", None]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, in array<string>")
    plan = mixing.plan_mix(docs, F.col("in"), lambda s: {k: v / 2 for k, v in s.items()})
    given = sum(x["given"] for x in plan.patterns)
    got = mixing.mixed(docs, plan, F.col("in")).collect()
    assert len(got) == 90 and abs(sum(r["taken"] for r in got) - given) <= 5 * len(plan.patterns)


def test_hard_rows(spark):
    docs = spark.createDataFrame([(None, None, None, 1), (1, "", "a", 1), (2, "x y", None, 1), (2, "x y", None, 1), (3, "z " * 50_000, "b", 1)], "doc_id long, text string, source string, size int")
    got = mixing.mixed(docs, mixing.plan_mix(docs, mixing.by_source(docs), mixing.weighted_targets), mixing.by_source(docs)).collect()
    assert len(got) == 5 and all(r["taken"] <= 2 * r["size"] for r in got)
    none = docs.limit(0)
    assert mixing.mixed(none, mixing.plan_mix(none, mixing.by_source(none), mixing.weighted_targets), mixing.by_source(none)).collect() == []
