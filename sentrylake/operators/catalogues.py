"""The rules for brands in hosts with the catalogue as a table: any number of keywords, the same work for each host."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import catalogue as C
from sentrylake.functions.urls import user_part
from sentrylake.operators.patterns import occurrences

#: Forms of keywords that all tasks may hold; a larger catalogue is joined by their key.
MOST_FORMS = 500_000
_ALNUM = "[a-z0-9]"


def own_keywords(spark) -> DataFrame:
    """The catalogue's own keywords as a table (keyword, rank)."""
    return spark.createDataFrame([(k, i) for i, (k, _) in enumerate(C.KEYWORDS)], "keyword string, rank int")


def _chained(words: Column, start: Column, end: Column) -> Column:
    """Whether words (array of struct<s, e>, in order of s) stand one after the other from start up to end."""
    step = lambda met, w: F.when(F.array_contains(met, w["s"]), F.array_union(met, F.array(w["e"]))).otherwise(met)
    return (start >= end) | F.array_contains(F.aggregate(words, F.array(start), step), end)


def first_keyword(hosts: DataFrame, keywords: DataFrame, words: DataFrame | None = None, skel: str = "skel") -> DataFrame:
    """(skel, keyword): the keyword of lowest rank of keywords (keyword, rank) that each distinct skeleton of a host has; hosts
    without one have no row. Long keywords count anywhere. Those of four letters or less count as words of a label, among words
    (word; keywords are words too) with digits at the ends of either side, or at the start of a label that a free hosting
    platform's customer chose. Null hosts have none; of ranks that repeat the smallest keyword counts."""
    spark = hosts.sparkSession
    words = spark.createDataFrame([(w,) for w in C.CONTEXT_WORDS], "word string") if words is None else words
    ranked = keywords.where("keyword <> ''").groupBy("keyword").agg(F.min("rank").alias("rank"))
    sought = ranked.select(F.col("keyword").alias("pattern")).union(words.select("word")).where("pattern <> ''").distinct()
    seen = hosts.select(F.col(skel).alias("skel")).where("skel IS NOT NULL").distinct()
    # without one whole keyword a host needs no look at its words
    held = occurrences(seen, ranked, "skel", "skel", "keyword").withColumnRenamed("pattern", "keyword").join(ranked, "keyword")
    long = held.where(F.length("keyword") >= 5).select("skel", "rank", "keyword")
    short = held.where(F.length("keyword") < 5)
    near = occurrences(short.select("skel").distinct(), sought, "skel", "skel").groupBy("skel").agg(F.array_sort(F.collect_set(F.struct(F.col("at").alias("s"), (F.col("at") + F.length("pattern")).alias("e")))).alias("words"))
    before, after = F.substr("skel", F.lit(1), F.col("at").cast("int") - 1), F.substr("skel", (F.col("at") + F.length("keyword")).cast("int"))
    left, right = F.regexp_extract(before, f"{_ALNUM}*$", 0), F.regexp_extract(after, f"^{_ALNUM}*", 0)
    digits = lambda text, pattern: F.length(F.regexp_extract(text, pattern, 0))
    out = short.join(near, "skel").withColumns({"l": left, "r": right, "user": user_part(F.col("skel")), "end": F.col("at") + F.length("keyword")})
    sides = _chained(F.col("words"), F.col("at") - F.length("l") + digits(F.col("l"), "^[0-9]*"), F.col("at") - digits(F.col("l"), "[0-9]*$"))
    sides = sides & _chained(F.col("words"), F.col("end") + digits(F.col("r"), "^[0-9]*"), F.col("end") + F.length("r") - digits(F.col("r"), "[0-9]*$"))
    opens = (F.col("end") - 1 <= F.length("user")) & (F.col("l") == "")
    met = long.union(out.where(sides | opens).select("skel", "rank", "keyword"))
    return met.groupBy("skel").agg(F.min(F.struct("rank", "keyword"))["keyword"].alias("keyword"))


def _without_one(word: Column) -> Column:
    """A word, and it without each of its letters but the first."""
    less = F.transform(F.sequence(F.lit(2), F.greatest(F.length(word), F.lit(2))), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), less))


def _one_edit(word: Column, keyword: Column) -> Column:
    """Whether two words are one insertion, deletion, substitution or swap of neighbours apart."""
    at = F.sequence(F.lit(1), F.greatest(F.length(keyword) - 1, F.lit(1)))
    swapped = lambda i: F.concat(F.substr(keyword, F.lit(1), i - 1), F.substr(keyword, i + 1, F.lit(1)), F.substr(keyword, i, F.lit(1)), F.substr(keyword, i + 2))
    apart = F.levenshtein(word, keyword, 2)
    return (apart == 1) | ((apart == 2) & (F.length(word) == F.length(keyword)) & F.exists(at, lambda i: swapped(i) == word))


def first_typosquat(hosts: DataFrame, keywords: DataFrame, flat: str = "flat") -> DataFrame:
    """(flat, squat): the keyword of lowest rank of keywords (keyword, rank) that each distinct text of flat_of has within one edit,
    first letter kept, but not itself; hosts without one have no row. Keywords under five letters don't count, deletions only
    for seven or more. Of ranks that repeat the smallest keyword counts.

    Words that are one edit apart agree when each lacks one letter at most: windows of the hosts that begin like a keyword meet
    keywords by such forms, and what meets is verified, so a host's work grows by its length and not by the number of keywords.
    """
    ranked = keywords.where(F.length("keyword") >= 5).groupBy("keyword").agg(F.min("rank").alias("rank"))
    forms = ranked.select("keyword", "rank", F.explode(_without_one(F.col("keyword"))).alias("form")).withColumn("form", F.xxhash64("form"))
    some = F.broadcast(forms) if forms.limit(MOST_FORMS + 1).count() <= MOST_FORMS else forms
    n, first = F.length("keyword"), lambda c: F.substr(c, F.lit(1), F.lit(1))
    sizes = ranked.select(first(F.col("keyword")).alias("first"), F.explode(F.array(n + 1, n, F.when(n >= 7, n - 1))).alias("n")).where("n IS NOT NULL")
    starts = sizes.groupBy("first").agg(F.collect_set("n").alias("sizes"))  # a row for each letter that a keyword begins with
    # no test for null, which would be made on each row's whole expression before rows are told apart; an empty text has no windows
    seen = hosts.select(F.coalesce(flat, F.lit("")).alias("flat")).distinct()
    # only windows which begin like a keyword of about their length are cut; outer, since a plain explode first tests its array's size
    cut = seen.select("flat", F.posexplode(F.split("flat", "")).alias("at", "first")).join(F.broadcast(starts), "first")
    cut = cut.select("flat", F.explode_outer(F.transform("sizes", lambda k: F.when(F.col("at") + k <= F.length("flat"), F.substr("flat", F.col("at") + 1, k)))).alias("window")).where("window IS NOT NULL")
    cut = cut.select("flat", "window", F.explode_outer(_without_one(F.col("window"))).alias("form")).withColumn("form", F.xxhash64("form"))
    met = cut.join(some, "form").where(~F.contains("flat", F.col("keyword")) & (first(F.col("window")) == first(F.col("keyword"))))
    met = met.where(((F.length("window") >= n) | (n >= 7)) & _one_edit(F.col("window"), F.col("keyword")))
    return met.groupBy("flat").agg(F.min(F.struct("rank", "keyword"))["keyword"].alias("squat"))
