"""Many patterns, keywords and typing errors at once, against plain searches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sentrylake.functions import urls as U
from sentrylake.operators import catalogues as K
from sentrylake.operators import patterns as P


def _places(rows, patterns):
    return sorted((i, p, m.start() + 1) for i, t in rows if t for p in set(patterns) if p for m in re.finditer(f"(?={re.escape(p)})", t))


@pytest.mark.parametrize("most", [P.MOST_CELLS, 1])
def test_occurrences(spark, most):
    rng = random.Random(5)
    patterns = ["".join(rng.choices("abcé😀", k=rng.randint(1, 5))) for _ in range(60)] + ["aaaa", "a", None, "", "b" * 300, "a.c"]
    rows = [(k, "".join(rng.choices("abcdé😀.", k=rng.randint(0, 60)))) for k in range(150)]
    rows += [(900, None), (901, ""), (902, "a" * 5000), (903, "c" * 2040 + "abcab" * 3 + "b" * 2500 + "abc")]
    found = P.occurrences(spark.createDataFrame(rows, "id int, t string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"), "id", "t", most_cells=most)
    assert found.columns == ["id", "pattern", "at"]
    assert sorted(map(tuple, found.collect())) == _places(rows, patterns)


@pytest.mark.parametrize("most", [P.MOST_CELLS, 0])
def test_nothing_to_find(spark, most):
    rows, none = spark.createDataFrame([("x", "abc")], "id string, t string"), spark.createDataFrame([(None,)], "pattern string")
    assert P.occurrences(rows, none, "id", "t", most_cells=most).count() == 0
    assert P.occurrences(rows.where("false"), rows.selectExpr("t AS pattern"), "id", "t", most_cells=most).count() == 0


def _skeletons(rng, n):
    words = ["sbi", "upi", "yono", "pay", "news", "le", "an", "reward", "kyc", "2", "99", "x", "bhim", "hdfc", "paytm", "gpay"]
    return ["".join(rng.choices(words, k=rng.randint(1, 4))) + rng.choice([".", "-", ".my", "-x."]) + "".join(rng.choices(words, k=rng.randint(1, 3))) + rng.choice([".com", ".co.in", ".vercel.app", ".github.io"]) for _ in range(n)]


def test_keywords_are_those_of_the_patterns(spark):
    hosts = spark.createDataFrame([(s,) for s in _skeletons(random.Random(8), 1500)] + [(None,), ("",), ("sbi",)], "skel string")
    want = hosts.distinct().withColumn("keyword", U.first_of([(U.keyword_in(k, F.col("skel")), k) for k, _ in U.C.KEYWORDS])).where("keyword IS NOT NULL")
    got = K.first_keyword(hosts, K.own_keywords(spark))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 500


def test_ten_thousand_keywords(spark):
    """Five to nine letters each, held by one automaton; every host is walked once."""
    rng = random.Random(1)
    keywords = sorted({"".join(rng.choices("abcdefghij", k=rng.randint(5, 9))) for _ in range(10_000)})
    hosts = sorted({"".join(rng.choices("abcdefghij-", k=20)) + rng.choice(["", rng.choice(keywords)]) + ".com" for _ in range(400)})
    want = {h: k for h in hosts if (k := next((k for k in keywords if k in h), None))}
    got = K.first_keyword(spark.createDataFrame([(h,) for h in hosts], "skel string"), spark.createDataFrame(list(zip(keywords, range(len(keywords)), strict=True)), "keyword string, rank int"))
    assert {r["skel"]: r["keyword"] for r in got.collect()} == want and len(want) > 150


def test_typosquats_of_a_large_catalogue(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    keywords = sorted({"".join(rng.choices(letters, k=rng.randint(4, 10))) for _ in range(5000)})
    flats = []
    for _ in range(150):
        k = rng.choice(keywords)
        i = rng.randrange(len(k))
        k = rng.choice([k, k[:i] + k[i + 1 :], k[:i] + rng.choice(letters) + k[i:], k[:i] + rng.choice(letters) + k[i + 1 :], k[:i] + k[i + 1 : i + 2] + k[i : i + 1] + k[i + 2 :]])
        flats.append("".join(rng.choices(letters, k=rng.randint(0, 6))) + k + rng.choice(["", "#", "com"]))
    flats = sorted(set(flats)) + [""]
    patterns = [(k, re.compile(U.near_pattern(k))) for k in keywords if len(k) >= 5]
    want = {f: k for f in flats if (k := next((k for k, p in patterns if k not in f and p.search(f)), None))}
    got = K.first_typosquat(spark.createDataFrame([(f,) for f in [*flats, None]], "flat string"), spark.createDataFrame(list(zip(keywords, range(len(keywords)), strict=True)), "keyword string, rank int"))
    assert {r["flat"]: r["squat"] for r in got.collect()} == want and len(want) > 60
