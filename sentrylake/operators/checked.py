"""Batches whose bad rows are put aside instead of failing the job, with progress counted on the way."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sentrylake.functions.urls import host_of, with_scheme
from sentrylake.work import new_path


@dataclass(frozen=True)
class Rule:
    """What makes a row bad: a name, the condition, and whether such failures are routine. A condition that is null doesn't hold."""

    name: str
    holds: Column
    routine: bool = True


@dataclass(frozen=True)
class Outcome:
    """good rows, with the batch's columns; bad ones as (stage, class, key, routine); and how many rows had which fate, known without
    another pass: processed, failed, and one number for each rule."""

    good: DataFrame
    bad: DataFrame
    counts: dict[str, int]


def checked(rows: DataFrame, stage: str, key: Column, rules: list[Rule]) -> Outcome:
    """One pass over rows: the first rule that holds is a row's class, and rows of none are good. The pass writes both kinds to the shared
    folder, apart, and the numbers are observed as it runs; so what follows reads the good rows only. Rules must be expressions that
    can't fail themselves: try_ functions where a value may not fit."""
    names = [r.name for r in rules]
    if len(set(names)) < len(names) or {"processed", "failed"} & set(names):
        raise ValueError("rules need names of their own")
    first = F.coalesce(*(F.when(r.holds, F.lit(r.name)) for r in rules), F.lit(None).cast("string"))
    routine = F.coalesce(*(F.when(F.col("class") == r.name, F.lit(r.routine)) for r in rules), F.lit(None).cast("boolean"))
    told = rows.select(F.struct(*map(F.col, rows.columns)).alias("row"), key.cast("string").alias("key"), first.alias("class"))
    told = told.select(F.when(F.col("class").isNull(), F.col("row")).alias("row"), F.when(F.col("class").isNotNull(), F.col("key")).alias("key"), "class", F.col("class").isNotNull().alias("failed"))
    seen = Observation()
    watched = told.observe(seen, F.count(F.lit(1)).alias("processed"), F.count_if("failed").alias("failed"), *(F.count_if(F.col("class") == n).alias(n) for n in names))
    path = new_path(rows.sparkSession, f"checked-{stage}")
    watched.write.partitionBy("failed").parquet(path)
    back = rows.sparkSession.read.schema(told.schema).parquet(path)
    bad = back.where("failed").select(F.lit(stage).alias("stage"), "class", "key", routine.alias("routine"))
    return Outcome(back.where("NOT failed").select("row.*"), bad, {k: int(v) for k, v in seen.get.items()})


#: The longest URL that is looked at.
LONGEST_URL = 2048


def url_rules(url: Column, longest: int = LONGEST_URL) -> list[Rule]:
    """Why a URL of a batch isn't looked at."""
    whole = with_scheme(F.trim(url))
    return [
        Rule("empty", F.trim(F.coalesce(url, F.lit(""))) == ""),
        Rule("too_long", F.length(url) > longest),
        Rule("other_scheme", ~F.lower(whole).rlike("^https?://") | url.rlike(r"(?i)^\s*(?:mailto|tel|data|javascript):")),
        Rule("no_host", ~host_of(whole).rlike(r"^(?:[^\s.]+\.)+[^\s.]+$")),
    ]


def url_batch(urls: DataFrame, stage: str = "batch") -> Outcome:
    """The distinct URLs of a batch (nth, url) in the order in which they first occur, those that can't be looked at put aside."""
    each = urls.groupBy(F.trim("url").alias("url")).agg(F.min("nth").alias("nth"))
    return checked(each, stage, F.col("url"), url_rules(F.col("url")))
