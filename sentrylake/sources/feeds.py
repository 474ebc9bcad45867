"""Text feeds and certificate-log answers as DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import text as T
from sentrylake.functions.urls import branded, host_of

#: Two labels or more of up to 63 letters, digits and inner hyphens, 253 characters at most.
HOST = r"^(?=.{1,253}$)[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+$"


def feed_urls(lines: DataFrame) -> DataFrame:
    """url and line (the first that has it) of feed lines (line, value): http URLs, not comments or blanks."""
    value = F.trim("value")
    return lines.where(value.rlike("(?i)^https?://")).groupBy(value.alias("url")).agg(F.min("line").alias("line"))


def brand_urls(feed: DataFrame, most: int | None = None) -> DataFrame:
    """The URLs of feed_urls that imitate a brand, the first most of them by line if so many are asked for."""
    found = branded(feed).select("url", "line", "brand")
    return found if most is None else found.orderBy("line").limit(most)


def lookalikes(hosts: DataFrame) -> DataFrame:
    """Distinct hosts that imitate a brand, of the answers to any number of queries."""
    return branded(hosts.select("host").distinct().withColumnRenamed("host", "url")).select("host", "brand")


def message_rows(messages: DataFrame) -> DataFrame:
    """What each message (id, text) is taken for: a row of kind url for each URL in it, else one of kind message if it has handles
    or numbers, else none. Each row carries the message's entities. Null texts have none."""
    text = F.coalesce("text", F.lit(""))
    found = messages.select("id", "text", T.all_urls(text).alias("urls"), T.message_entities(text).alias("entities"))
    urls = found.select("id", F.lit("url").alias("kind"), F.explode("urls").alias("value"), "entities")
    key = F.concat(F.lit("message://"), F.substring(T.message_digest(text), 1, 24))
    return urls.unionByName(found.where((F.size("urls") == 0) & (F.size("entities") > 0)).select("id", F.lit("message").alias("kind"), key.alias("value"), "entities"))


def ct_hosts(raw: DataFrame) -> DataFrame:
    """Distinct host names of certificate-log answers: JSON arrays with name_value (a name per line) and common_name.
    Anything else gives no rows."""
    rows = raw.select(F.explode(F.from_json("raw", "array<struct<name_value:string,common_name:string>>")).alias("r"))
    names = rows.select(F.explode(F.concat(F.split(F.coalesce("r.name_value", F.lit("")), "\n"), F.array(F.coalesce("r.common_name", F.lit("")))))).toDF("name")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), r"^\*\.", ""), r"\.+$", "")
    return names.select(host.alias("host")).where(F.col("host").rlike(HOST)).distinct()
