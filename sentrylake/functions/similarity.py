"""Similarity of perceptual hashes and histograms, and what a page shows against what a brand's pages show."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import catalogue as C


def _half(x: Column, start: int) -> Column:
    return F.conv(F.substring(x, start, 8), 16, 10).cast("long")


def hash_similarity(a: Column, b: Column) -> Column:
    """One minus the share of the 64 bits of two hex hashes that differ; 0 where one is unknown or of another length."""
    apart = F.bit_count(_half(a, 1).bitwiseXOR(_half(b, 1))) + F.bit_count(_half(a, 9).bitwiseXOR(_half(b, 9)))
    return F.when((F.length(a) == 16) & (F.length(b) == 16), 1 - apart / 64.0).otherwise(0.0)


def layout_similarity(a: Column, b: Column) -> Column:
    """Mean similarity of the two hashes of two pictures (struct<phash, dhash>); 0 where one is missing."""
    both = (hash_similarity(a["phash"], b["phash"]) + hash_similarity(a["dhash"], b["dhash"])) / 2
    return F.when(a.isNotNull() & b.isNotNull(), both).otherwise(0.0)


def palette_similarity(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)


#: References that every task may hold at a time.
MOST_REFERENCES = 10_000


def nearest(rows: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """key, ref and sim of the most similar reference hash; ties go to the smallest ref. The library goes to all tasks in blocks,
    each packed into one array, so no row is multiplied by references; a library of one block needs no shuffle. A key that repeats
    has one answer, for its nearest row. Without references there is no answer."""
    n = refs.count()
    if n == 0:
        return rows.limit(0).select(key, F.lit(None).cast(refs.schema["ref"].dataType).alias("ref"), F.lit(None).cast("double").alias("sim"))
    blocks = -(-n // MOST_REFERENCES)
    numbered = refs.select("ref", "ref_hash", F.pmod(F.xxhash64("ref", "ref_hash"), F.lit(blocks)).alias("block"))
    far = lambda r: F.struct((-hash_similarity(F.col("hash"), r["ref_hash"])).alias("far"), r["ref"].alias("ref"))

    def best(block: int) -> DataFrame:
        packed = numbered.where(F.col("block") == block).agg(F.array_sort(F.collect_list(F.struct("ref", "ref_hash"))).alias("refs")).where(F.size("refs") > 0)
        return rows.join(F.broadcast(packed)).select(key, F.array_min(F.transform("refs", far)).alias("best"))

    found = reduce(DataFrame.unionByName, map(best, range(blocks)))
    if blocks > 1:
        found = found.groupBy(key).agg(F.min("best").alias("best"))
    return found.select(key, F.col("best.ref").alias("ref"), (-F.col("best.far")).alias("sim"))


def looks_of(brand: Column) -> Column:
    """struct<title, vocab, markers> of what a brand's pages show; null for others."""
    words = lambda x: F.array(*map(F.lit, x))
    return F.create_map(*[x for key, title, vocab, markers in C.LOOKS for x in (F.lit(key), F.struct(words(title).alias("title"), words(vocab).alias("vocab"), words(markers).alias("markers")))])[brand]


def title_hits(title: Column, looks: Column) -> Column:
    return F.size(F.filter(looks["title"], lambda w: F.contains(title, w)))


def structural_similarity(title: Column, text: Column, looks: Column) -> Column:
    """Weighted mean of title words, twice the Jaccard index of vocabulary (1 at most), and markers. All in lower case."""
    shown = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)), F.regexp_extract_all(title, F.lit("[a-z0-9]+"), F.lit(0))))
    both = F.size(F.array_intersect(shown, looks["vocab"]))
    jaccard = F.when(F.size(shown) == 0, 0.0).otherwise(both / (F.size(shown) + F.size(looks["vocab"]) - both))
    marked = F.size(F.filter(looks["markers"], lambda m: F.contains(text, m) | F.contains(title, m))) / F.size(looks["markers"])
    return 0.4 * title_hits(title, looks) / F.size(looks["title"]) + 0.4 * F.least(F.lit(1.0), 2 * jaccard) + 0.2 * marked
