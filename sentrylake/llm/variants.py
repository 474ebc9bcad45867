"""Groups of spelling variants: words one edit apart, by a rare-first q-gram prefix filter.

Positional bigrams of all words are put into one global order, rarest bigram first. One edit destroys two of a word's bigrams at
most, so of the three rarest of each of two near words one is shared, at the same place or, after an insertion, at the next one. Words
meet by these alone. The key also holds two thirds of a word: an edit leaves two of its three parts alone; so a common bigram makes few
candidates. Each candidate is verified by its edit distance.
"""

from collections import Counter
from collections.abc import Iterator
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.work import ship
from sentrylake.work import drop, written

#: The least word and count that take part; bigrams of a prefix; how many times commoner a form is.
LEAST_LENGTH, LEAST_COUNT, PREFIX, FORM_TIMES = 7, 2, 3, 10
#: One in so many runs, by a checksum, loses a letter: the errors that the words are known by.
ERRORS = 31

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_errors(run: Column, doc_id: Column) -> Column:
    """The run, or where ERRORS divides the crc32 h of <doc_id>:<run>, the run without its code point h % length (from 0). A null
    doc_id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    return F.when(F.pmod(h, F.lit(ERRORS)) == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of every word that whole texts have often enough: maximal runs of Latin letters, A to Z lower-cased, with errors.

    Null and empty texts have no words; rows that repeat an id count each time; other columns aren't read. Shorter runs can't
    become words, so the pattern passes over them. Counts are pre-aggregated, so a word may be any share of all."""
    lower = F.translate(docs[text], _UPPER, _LOWER)
    runs = docs.select(docs[doc_id].alias("d"), F.explode(F.regexp_extract_all(lower, F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))).alias("run"))
    found = runs.select(with_errors(F.col("run"), F.col("d")).alias("word")).where(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def bigrams(words_: DataFrame) -> DataFrame:
    """gram, n of each bigram of the words: as many at most as there are pairs of letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                seen.update(map(add, word, word[1:]))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["gram", "n"])

    return words_.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def prefixes(words_: DataFrame, count: int = PREFIX) -> DataFrame:
    """word, gram, pos of each word's rarest positional bigrams, in the global order of (rarity, bigram, place)."""
    order = {r["gram"]: k for k, r in enumerate(bigrams(words_).orderBy("n", "gram").collect())}  # pairs of letters
    shared = words_.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                for _, pos in sorted((rank[word[i : i + 2]], i) for i in range(len(word) - 1))[:count]:
                    rows.append((word, word[pos : pos + 2], pos))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["word", "gram", "pos"])

    return words_.select("word").mapInArrow(run, "word string, gram string, pos long")


def _parts(word: Column, size: Column, more: int) -> Column:
    """The three pairs of parts, one of which a word of size code points has in common with any near word of as many (more is 0), or with a
    longer one (more is 1), whose parts after the edit are one further on."""
    x, y, last = F.floor(size / 3).cast("int"), F.floor(size * 2 / 3).cast("int"), F.length(word)
    tail = F.substr(word, y + (1 + more), last)
    return F.array(F.concat(F.lit("<"), F.substr(word, F.lit(1), y)), F.concat(F.lit("="), F.substr(word, F.lit(1), x), F.lit("="), tail), F.concat(F.lit(">"), F.substr(word, x + (1 + more), last)))


def near_pairs(words_: DataFrame) -> DataFrame:
    """(a, b), each pair of words of 7 code points or more that one inserted, deleted or replaced code point parts, once: the shorter
    one, or of words of one length the first, is a."""
    ship(words_.sparkSession)
    word, size = F.col("word"), F.length("word")
    held = written(prefixes(words_).select("word", "gram", "pos", size.alias("size")), "prefixes")
    # a word is met by those of its length, and by those one shorter
    both = F.array_distinct(F.concat(_parts(word, size, 0), _parts(word, size - 1, 1)))
    own = held.select(word.alias("b"), "gram", F.col("pos").alias("pos_b"), F.col("size").alias("size_b"), F.explode(both).alias("part"))
    probes = held.select(word.alias("a"), "gram", F.col("pos").alias("pos_a"), F.col("size").alias("size_a"), F.explode(_parts(word, size, 0)).alias("part"))
    more, on = F.col("size_b") - F.col("size_a"), F.col("pos_b") - F.col("pos_a")
    # a word of the same length has the bigram at the same place, a longer one there or one further on
    met = probes.join(own, ["gram", "part"]).where(((more == 0) & (on == 0) & (F.col("a") < F.col("b"))) | ((more == 1) & ((on == 0) | (on == 1))))
    near = written(met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct(), "near")
    drop(held)
    return near


def forms(words_: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of (word, n), whose words are distinct and of 7 code points or more.

    form is the near word of largest n (of equal ones the first in code-point order), if n is so many times the word's own,
    else null; root is where forms lead. Counts grow along forms, so they end, and as times is 2 at least, within 63 steps. A
    word that is near very many others is pre-aggregated. No words in, no rows out."""
    if times < 2:
        raise ValueError("a form must be at least twice as common")
    near = near_pairs(words_)
    both = near.union(near.select("b", "a")).toDF("word", "other").join(words_.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    found = words_.join(both.groupBy("word").agg(F.count("*").alias("n_near"), best), "word", "left")
    has = -F.col("best.less") >= times * F.col("n")
    held = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    drop(near)
    ends = _roots(held.where("form is not null").select("word", F.col("form").alias("root")))
    return held.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): where the links of each word lead; each round doubles the links that a row has gone."""
    now = written(links, "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("end"))
        after = written(now.join(further, "root", "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("went")), "roots")
        drop(now)
        now = after.select("word", "root")
        if after.where("went").isEmpty():
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """forms() of the words() of docs, whose table of counts is written once."""
    return forms(written(words(docs), "words"))
