"""Token counts against the public library."""

import random

import public_tokenizers
import sentencepiece

from sentrylake.llm.bpe_count import Counter, count_tokens
from sentrylake.llm.queries import op7_bpe_token_counts
from tests.llm.brute import SF2

PATH = public_tokenizers.path("piece_bpe_32k.model")
TRICKY = ["", " ", "  ", "\n", "\n\n a", "a  b   c", "<s>", "</s> x", "<unk>", "<0x0A>", "▁", "▁▁a ▁", "a▁b", "日本語のテキスト", "🙂🙃", "é", "\x00", "﻿x", "x" * 3000, "ab" * 2000, "Ünïcödé", "\t\ttab", "don't  stop", "ﬁ ligature", " nbsp", "http://a.b/c?d=e&f=1", "a\r\nb", " leading", "trailing ", "　wide", "½ ² ™"]


def test_tricky():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    with open(PATH, "rb") as f:
        count = Counter(f.read())
    rng = random.Random(2)
    made = ["".join(rng.choice("ab ▁\n<s>é日0.,'") for _ in range(rng.randrange(40))) for _ in range(400)]
    for text in TRICKY + made:
        assert count(text) == len(sp.encode(text)), repr(text)[:80]


def test_query(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    rows = op7_bpe_token_counts(spark, SF2).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]] or ""
        n = len(sp.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_hard_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "hello", None)], "doc_id long, text string, n_tokens int")
    rows = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in count_tokens(df, PATH).collect())
    assert rows[:3] == [(-1, 0, 0), (1, 0, 0), (1, 0, 0)]
    assert count_tokens(df.limit(0), PATH).collect() == []
