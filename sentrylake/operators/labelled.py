"""A labelled set of hosts from lists of phishing URLs and a ranking of domains."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import catalogue as C
from sentrylake.functions.urls import host_of, owner_of, registered_domain
from sentrylake.operators.casework import first_rows
from sentrylake.operators.evaluation import split_of

WORDS = sorted({k for k, _ in C.KEYWORDS} | {"upi", "npci"})


def mentions_brand(text: Column) -> Column:
    """Whether a keyword starts a token of up to 40 letters and digits, or, of five letters or more, ends it."""
    long = "|".join(w for w in WORDS if len(w) >= 5)
    tokens = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) <= 40)
    return F.exists(tokens, lambda t: t.rlike(f"^(?:{'|'.join(WORDS)})|(?:{long})$"))


def holds_keyword(text: Column) -> Column:
    return F.lower(text).rlike("|".join(WORDS))


def official(host: Column) -> Column:
    return owner_of(registered_domain(host)).isNotNull()


def phishing_hosts(lines: DataFrame) -> DataFrame:
    """(host, source) of feed lines (source, rank of the source, nth, value), the first line of each host. Comments, blanks and
    lines with blanks, commas, quotes or brackets are none."""
    value = F.trim("value")
    rows = lines.where((value != "") & ~value.rlike("""^#|[ ,"'<>]""")).withColumn("host", host_of(value)).where("host <> ''")
    return first_rows(rows.select("host", "source", "rank", "nth"), ["host"], [F.col("rank"), F.col("nth")]).select("host", "source")


def hosts_of(lines: DataFrame, ranking: DataFrame, targets: DataFrame, general: int = 1500, top: int = 100_000, seed: int = 20261007) -> DataFrame:
    """url, host, label, target, source and split of the set. Phishing rows are hosts of the feeds that mention a brand and aren't
    its own. Benign ones are domains of the ranking (rank, domain) that hold a keyword, and a seeded sample of general others from
    its top: a sample is the feature, drawn by a hash, so that it is the same whatever the partitions. Known targets (host,
    target) are named, those of other phishing rows are "other"."""
    feeds = phishing_hosts(lines)
    bad = feeds.where(mentions_brand(F.col("host")) & ~official(F.col("host"))).select("host", F.lit("phishing").alias("label"), "source")
    clean = ranking.withColumnRenamed("domain", "host").where(~official(F.col("host"))).join(feeds.select("host"), "host", "left_anti")
    hard = clean.where(holds_keyword(F.col("host"))).select("host", F.lit("benign").alias("label"), F.lit("ranking_keyword").alias("source")).distinct()
    rest = clean.where(~holds_keyword(F.col("host")) & (F.col("rank") <= top)).select("host").distinct().orderBy(F.xxhash64("host", F.lit(seed)), "host").limit(general)
    rows = bad.unionByName(hard).unionByName(rest.select("host", F.lit("benign").alias("label"), F.lit("ranking_general").alias("source")))
    named = rows.join(targets.select("host", F.col("target").alias("t")), "host", "left")
    target = F.when(F.col("label") == "phishing", F.coalesce("t", F.lit("other"))).otherwise("")
    return named.select(F.concat(F.lit("https://"), "host", F.lit("/")).alias("url"), "host", "label", target.alias("target"), "source", split_of(F.col("host")).alias("split"))


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "split").agg(F.count("*").alias("n"))
