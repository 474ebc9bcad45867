"""Held-out accuracy of language identification, and its path search against all paths."""

from itertools import product
from zlib import crc32

import numpy as np

from sentrylake.llm import language
from sentrylake.llm.queries import op5_script_viterbi_language

SF1 = "/root/testdata/sf0.1"


def test_held_out(spark):
    docs = {r["doc_id"]: (r["text"], r["lang"]) for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()}
    rows = op5_script_viterbi_language(spark, SF1).collect()
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        text, lang = docs[r["doc_id"]]
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and lang is not None:
            right.append(r["lang_pred"] == lang)
    print("accuracy", np.mean(right), len(right))
    assert np.mean(right) > 0.95
    assert all((r["spans"] == "") == (not (docs[r["doc_id"]][0] or "").strip(" \t\n\v\f\r")) for r in rows)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n, k = int(rng.integers(1, 7)), 3
        score = rng.normal(size=(n, k)) * 3
        got = language.viterbi(np.zeros(n, np.int64), score.astype(np.float32), 1, penalty=2.0)
        value = lambda p: sum(score[i, s] for i, s in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023
        assert abs(value(got.tolist()) - max(map(value, product(range(k), repeat=n)))) < 1e-4


def _features(text: str) -> list[list[tuple]]:
    """Of each word, its features: itself, and pairs and triples of characters that touch it, white space being one character."""
    white = " \t\n\v\f\r"
    words, of = [], []
    for k, c in enumerate(text):
        if c not in white and (k == 0 or text[k - 1] in white):
            words.append([])
        of.append(len(words) - 1)
    low = [" " if c in white else c.lower() for c in text]
    for width in (2, 3):
        for k in range(len(low) - width + 1):
            run = low[k : k + width]
            if (run[0] == " " and run[-1] == " ") or " " in run[1:-1]:
                continue
            words[of[k + 1] if run[0] == " " else of[k]].append((width, "".join(run)))
    for w, spelt in zip(words, "".join(low).split(" ") if words else [], strict=False):
        w.append((1, spelt))
    return words


def test_scores_against_brute_force(spark):
    """Counts, scores and best paths of a plain version, whose features aren't hashed, over short texts of one script each or two."""
    rng = np.random.default_rng(11)
    letters = {"aa": "abcdefg", "bb": "efghijk", "cc": "абвгдежз"}
    word = lambda g: "".join(rng.choice(list(letters[g]), rng.integers(1, 5)))
    rows = [(i, " ".join(word(g) for _ in range(6)), g) for i, g in enumerate(["aa", "bb", "cc"] * 30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_rows=10_000)
    counts = {g: {1: {}, 2: {}, 3: {}} for g in letters}
    for i, text, g in rows:
        if crc32(str(i).encode()) % 4 != 2:
            for own in _features(text):
                for kind, f in own:
                    counts[g][kind][f] = counts[g][kind].get(f, 0) + 1
    log = lambda g, kind, f: np.log((1 + counts[g][kind].get(f, 0)) / (language.BUCKETS + sum(counts[g][kind].values())))
    texts = [" ".join(word(g) for g in rng.choice(list(letters), rng.integers(1, 6))) for _ in range(60)]
    found = language.identified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, spans=True).collect()
    for r in found:
        own = _features(r["text"])
        lat = ["а" <= w[0].lower() <= "я" for w in r["text"].split()]
        score = [[sum(log(g, *f) for f in w) if (g == "cc") == c else language.OFF for g in sorted(letters)] for w, c in zip(own, lat, strict=True)]
        value = lambda p: sum(score[i][s] for i, s in enumerate(p)) - language.PENALTY * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(value(p) for p in product(range(3), repeat=len(own)))
        spans = [x.split(":") for x in r["spans"].split(",")]
        path, at = [], 0
        for k, w in enumerate(r["text"].split()):
            at = r["text"].index(w, at)
            path.append(next(sorted(letters).index(g) for g, a, b in spans if int(a) <= at < int(b)))
            at += len(w)
        assert abs(value(path) - best) < 1e-2


def test_mixed_spans(spark):
    train = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog went to the house", "en"), ("der hund und die katze gehen in das haus", "de"), ("собака и кошка идут домой вместе", "ru")] * 40)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    mixed = "the cat and the dog went to the house der hund und die katze gehen in das haus собака и кошка идут домой"
    found = language.identified(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), language.fit(docs), spans=True).first()
    spans = [x.split(":") for x in found["spans"].split(",")]
    assert [s[0] for s in spans] == ["en", "de", "ru"]
    assert int(spans[0][1]) == 0 and int(spans[-1][2]) == len(mixed)
    assert all(a[2] == b[1] for a, b in zip(spans, spans[1:]))


def test_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 1), (3, "12 34 !!", None, 1), (None, "hello there", "en", 1), (5, "a " * 50_000, "en", 1), (6, "日本", "en", 1)], "doc_id long, text string, lang string, score int")
    rows = {r["text"]: r for r in language.identified(docs, language.fit(docs)).collect()}
    assert [rows[t]["lang_pred"] for t in (None, "", "12 34 !!")] == ["und"] * 3
    assert rows["hello there"]["lang_pred"] == "en"
    assert all(r["lang_pred"] == "und" for r in language.identified(docs, language.fit(docs.limit(0))).collect())
    assert language.identified(docs.limit(0), language.fit(docs)).collect() == []
