"""Search, statistics and dashboard numbers over assets."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flagged() -> Column:
    return (F.col("verdict") != "benign") & (F.col("review") != "false_positive")


def search(assets: DataFrame, min_points: int | None = None, verdict: str | None = None, kind: str | None = None, live: bool | None = None, review: str | None = None, brand: str | None = None, source: str | None = None, text: str | None = None, campaign: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the assets that meet all given conditions, by score and first_seen, both falling, then id. live counts three
    values: unknown is neither true nor false. text is looked for in the domain and in the URL, whatever its case; assets without a url column are searched by domain."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be from 1 to 1000, offset 0 or more")
    out = assets if min_points is None else assets.where(F.col("points") >= min_points)
    for name, value in (("verdict", verdict), ("kind", kind), ("review", review), ("brand", brand), ("source", source), ("campaign", campaign)):
        out = out if value is None else out.where(F.col(name) == value)
    out = out if live is None else out.where(F.col("live").eqNullSafe(F.lit(live)))
    if text:
        has = [F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in ("domain", "url") if c in assets.columns]
        out = out.where(reduce(or_, has))
    return out.orderBy(F.desc("points"), F.desc("first_seen"), "id").offset(offset).limit(limit)


def counts(assets: DataFrame, by: str) -> DataFrame:
    return assets.groupBy(by).agg(F.count("*").alias("n"))


def totals(assets: DataFrame) -> DataFrame:
    on = flagged()
    return assets.agg(F.count("*").alias("candidates"), F.count_if(on).alias("flagged"), F.count_if(on & F.col("live")).alias("live"), F.count_if(on & ~F.col("live")).alias("offline"))


def per_day(assets: DataFrame, today: str, days: int = 14) -> DataFrame:
    """Flagged assets first seen on each of the last days, today included; days without any count 0."""
    spine = assets.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(today).cast("date"), days - 1), F.lit(today).cast("date"))).alias("day"))
    n = assets.where(flagged()).groupBy(F.to_date("first_seen").alias("day")).agg(F.count("*").alias("n"))
    return spine.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def review_queue(assets: DataFrame, most: int = 10) -> DataFrame:
    return assets.where(flagged() & (F.col("review") == "unreviewed")).orderBy(F.desc("points"), "id").limit(most)


def top_signals(rows: DataFrame, most: int = 10) -> DataFrame:
    """How often each signal of positive weight occurs; ties by name."""
    each = rows.select(F.explode("signals").alias("s")).where("s.points > 0")
    return each.groupBy(F.col("s.name").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most)


def median_hours(cases: DataFrame) -> DataFrame:
    """The exact median of hours from sent_at to resolved_at, to one digit, of cases that have both; null without any."""
    both = cases.where("sent_at IS NOT NULL AND resolved_at IS NOT NULL")
    seconds = (F.unix_micros(F.col("resolved_at").cast("timestamp")) - F.unix_micros(F.col("sent_at").cast("timestamp"))) / 1e6
    return both.agg(F.round(F.median(seconds) / 3600, 1).alias("median_hours"), F.count("*").alias("resolved"))


def newest(rows: DataFrame, at: str, most: int = 200, **equal: str) -> DataFrame:
    """The last rows of a log (jobs, audit events), of those with the given values."""
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    return rows.orderBy(F.desc(at), F.desc("id")).limit(most)


def cases_of(cases: DataFrame, campaign: str | None = None, status: str | None = None) -> DataFrame:
    """All cases, the newest first; of one campaign the oldest first."""
    out = cases if status is None else cases.where(F.col("status") == status)
    return out.orderBy(F.desc("created_at"), "case_id") if campaign is None else out.where(F.col("campaign") == campaign).orderBy("created_at", "case_id")


def case_counts(cases: DataFrame) -> DataFrame:
    """status and n, and open, whether cases of that status still need work."""
    return cases.groupBy("status").agg(F.count("*").alias("n")).withColumn("open", F.col("status").isin("drafted", "sent", "acknowledged"))


def progress(steps: DataFrame) -> DataFrame:
    """By job of steps (job, nth, ok, asset): processed, failed, and the number of distinct assets."""
    return steps.groupBy("job").agg(F.count("*").alias("processed"), F.count_if(~F.col("ok")).alias("failed"), F.count_distinct("asset").alias("assets"))


def by_kind(assets: DataFrame) -> DataFrame:
    """sites, apps and messages of each campaign."""
    return assets.groupBy("campaign").agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("web", "sites"), ("app", "apps"), ("message", "messages"))))


def page_of(rows: DataFrame, number: int, size: int = 25) -> DataFrame:
    """A page of ordered rows and one row more, by which a reader knows that there is a next page."""
    return rows.offset(number * size).limit(size + 1)
