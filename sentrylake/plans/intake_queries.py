"""Queries over batches with bad rows and landed certificate logs, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import urls as U
from sentrylake.operators import checked as K
from sentrylake.plans.queries import _HOST, _table, query
from sentrylake.sources import certlog
from sentrylake.work import new_path

_LINKS = "SELECT page_id * 1000 AS nth, trim(url) AS url FROM pages UNION ALL SELECT page_id * 1000 + 1, trim(unnest(regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1))) FROM pages UNION ALL SELECT conv_id * 100 + turn, trim(text) FROM conversations"
_WHOLE = "CASE WHEN contains(url, '://') THEN url ELSE 'http://' || url END"
_CLASSES = f"""WITH l AS (SELECT url, min(nth) AS nth FROM ({_LINKS}) x GROUP BY url), h AS (SELECT *, {_HOST.format(u="url")} AS host FROM l),
    c AS (SELECT *, CASE WHEN coalesce(url, '') = '' THEN 'empty' WHEN length(url) > 2048 THEN 'too_long' WHEN NOT regexp_matches(lower({_WHOLE}), '^https?://') OR regexp_matches(lower(url), '^(mailto|tel|data|javascript):') THEN 'other_scheme'
        WHEN NOT regexp_full_match(host, '([^\\s.]+\\.)+[^\\s.]+') THEN 'no_host' END AS class FROM h)"""


def _batch(spark: SparkSession, sf_dir: str) -> K.Outcome:
    """All addresses of pages, all links in them, and all turns of conversations, few of which are URLs."""
    pages, turns = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "conversations")
    links = pages.select((F.col("page_id") * 1000 + 1).alias("nth"), F.explode(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1))).alias("url"))
    return K.url_batch(pages.select((F.col("page_id") * 1000).alias("nth"), "url").union(links).union(turns.select(F.col("conv_id") * 100 + F.col("turn"), "text")))


@query(f"{_CLASSES} SELECT nth, host FROM c WHERE class IS NULL")
def batch_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).good.select("nth", U.host_of(F.col("url")).alias("host"))


@query(f"{_CLASSES} SELECT 'batch' AS stage, class, url AS key, TRUE AS routine FROM c WHERE class IS NOT NULL")
def batch_put_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).bad


@query(f"""{_CLASSES}, n AS (SELECT count(*) AS processed, count(class) AS failed, {", ".join(f"count(*) FILTER (class = '{k}') AS {k}" for k in ("empty", "too_long", "other_scheme", "no_host"))} FROM c)
    SELECT * FROM (UNPIVOT n ON COLUMNS(*) INTO NAME what VALUE n)""")
def batch_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers as they were observed by the pass that wrote the rows."""
    return spark.createDataFrame(list(_batch(spark, sf_dir).counts.items()), "what string, n long")


def _landed(spark: SparkSession, sf_dir: str, size: int = certlog.RANGE) -> DataFrame:
    """The pages' hosts as answers, by their last label; each answer is followed by a line that is none."""
    host = U.host_of(F.col("url"))
    record = F.struct(F.col("page_id").alias("id"), F.concat(F.lit("*."), host, F.lit("\nPayments Limited\nmail."), host).alias("name_value"), F.upper(host).alias("common_name"))
    lines = _table(spark, sf_dir, "pages").select(F.substring_index(host, ".", -1).alias("term"), F.concat_ws("\n", F.to_json(F.array(record)), "url").alias("value"))
    path = new_path(spark, "certificates")
    lines.write.partitionBy("term").text(path)
    return certlog.read_log(spark, path, size)


_H = _HOST.format(u="url")


@query(f"SELECT CAST(page_id AS VARCHAR) AS certificate, list_sort(list_distinct([h, 'mail.' || h])) AS hosts FROM (SELECT page_id, {_H} AS h FROM pages) WHERE string_split(h, '.')[-1] = 'net'")
def certificate_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certlog.hosts_by_certificate(_landed(spark, sf_dir, 1000).where("term = 'net'"))


@query(f"SELECT string_split({_H}, '.')[-1] AS term, 'not_json' AS bad, count(*) AS n FROM pages GROUP BY ALL")
def certificate_lines_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(spark, sf_dir).where("bad IS NOT NULL").groupBy("term", "bad").agg(F.count("*").alias("n"))
