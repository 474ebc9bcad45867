"""Queries with the catalogue as a table: many patterns at once, typing errors of many keywords."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import catalogue as C
from sentrylake.functions import urls as U
from sentrylake.operators import catalogues as K
from sentrylake.operators.patterns import occurrences
from sentrylake.plans.queries import _keyword_sql, _table, _typo_sql, _url_sql, _urls, query


@query(_url_sql("SELECT id, CASE " + " ".join(f"WHEN {_keyword_sql(k)} THEN '{k}'" for k, _ in C.KEYWORDS) + " END AS keyword FROM o"))
def url_keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword of each URL's host, with the catalogue's keywords as a table."""
    rows = _urls(spark, sf_dir).select("id", U.skeleton(U.host_of(F.col("url"))).alias("skel"))
    return rows.join(K.first_keyword(rows, K.own_keywords(spark)), "skel", "left").select("id", "keyword")


@query(_url_sql(f"SELECT id, squat FROM ({_typo_sql()})"))
def url_typosquat_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword that each URL's host nearly has; a host's look is told once for all of its URLs."""
    rows = _urls(spark, sf_dir).select("id", F.coalesce(U.host_of(F.col("url")), F.lit("")).alias("host"))
    hosts = rows.select("host").distinct().select("host", F.coalesce(U.flat_of(U.skeleton(F.col("host"))), F.lit("")).alias("flat"))
    near = hosts.join(K.first_typosquat(hosts, K.own_keywords(spark)).hint("merge"), "flat").select("host", "squat")
    return rows.join(near.hint("merge"), "host", "left").select("id", "squat")


_WORDS = "SELECT DISTINCT w AS pattern FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) AS w FROM benchmark)"


@query(f"""WITH k AS (SELECT pattern, len(list_filter(range(1, length(pattern)), lambda b: pattern[:b] = pattern[-b:])) > 0 AS meets_itself FROM ({_WORDS})),
    m AS (SELECT pattern, meets_itself, text FROM k JOIN documents d ON contains(d.text, k.pattern)),
    n AS (SELECT pattern, CASE WHEN meets_itself THEN list_sum([len(list_filter(range(1, length(w) + 1), lambda i: substr(w, i, length(pattern)) = pattern)) FOR w IN string_split(text, ' ') IF contains(w, pattern)])
        ELSE (length(text) - length(replace(text, pattern, ''))) // length(pattern) END AS n FROM m)
    SELECT pattern, count(*) AS documents, CAST(sum(n) AS BIGINT) AS places FROM n GROUP BY pattern""")
def benchmark_word_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents and places each longer word of the benchmark stands, within longer words and overlapping too."""
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("pattern"))
    found = occurrences(_table(spark, sf_dir, "documents").select("doc_id", "text"), words, "doc_id", "text")
    per = found.groupBy("pattern", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("pattern").agg(F.count("*").alias("documents"), F.sum("n").alias("places"))
