"""Spelling variants against brute force: deletion neighbourhoods of all words, without bigrams."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from sentrylake.llm import variants
from sentrylake.llm.queries import op13_rare_qgram_variants
from tests.llm.brute import LOWER, SF, SF2

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near_words(known):
    by = defaultdict(set)
    for w in known:
        by[w].add(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if apart_by_one(a, b)}
    return near


def expected(n):
    near, form = near_words(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return out


def got(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query(spark):
    for sf in (SF, SF2):
        t = pq.read_table(f"{sf}/documents.parquet")
        want = expected(counted(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)))
        assert got(op13_rare_qgram_variants(spark, sf)) == want
    assert any(x[1] for x in want) and any(x[4] > 1 for x in want)


def test_repeated_bigrams(spark):
    """Words over few letters, whose bigrams repeat and tie: every near pair is found, whatever the edit's place."""
    rng = random.Random(7)
    known = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 12))) for _ in range(900)}
    known |= {"a" * k for k in range(7, 20)} | {"éà" * 4, "éà" * 4 + "é", "èà" + "éà" * 3, "ÿ" * 7, "ÿ" * 8}
    for word in ["abcdefghij", "kettledrum", "ambivalence", "aaaabbbb"]:
        known |= {word} | {word[:i] + x + word[i + k :] for i in range(len(word) + 1) for x in ("", "z", word[0]) for k in (0, 1)}
    known = {w for w in known if len(w) >= 7}
    df = spark.createDataFrame([(w, rng.choice([2, 3, 40, 900, 70000])) for w in sorted(known)], "word string, n long")
    want = {tuple(sorted((a, b))) for a, others in near_words(known).items() for b in others}
    assert {tuple(sorted(r)) for r in variants.near_pairs(df).collect()} == want and len(want) > 2000
    assert got(variants.forms(df)) == expected({r["word"]: r["n"] for r in df.collect()})


def test_chains(spark):
    chain = ["a" * 7 + "b" * k for k in range(8)]
    df = spark.createDataFrame([(w, 3 * 10**k) for k, w in enumerate(chain)], "word string, n long")
    assert {r["root"] for r in variants.forms(df).collect()} == {chain[-1]}


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (None, "Similarity similarity ÀPROPOS"), (3, "x" * 2000 + " wordlike WORDLIKE" + " many words of no use" * 20_000), (3, "x" * 2000 + " wordlike WORDLIKE" + " many words of no use" * 20_000), (4, "naïveté1naïveté_naïveté×÷ short"), (5, "ΑΒΓΔΕΖΗΘ wordlik wordlik wordlikes wordlikes")]
    df = spark.createDataFrame([(*r, "w", 5) for r in rows], "doc_id long, text string, word string, n int")
    assert got(variants.spelling_variants(df)) == expected(counted(rows))
    assert variants.spelling_variants(df.limit(0)).collect() == []
    assert variants.spelling_variants(df.limit(2)).collect() == []
