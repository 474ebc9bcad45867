"""State of assets by key: what a sequence of sightings leaves, independent of partitions and of late arrival."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(sightings: DataFrame) -> DataFrame:
    """One row for each url_key of (url_key, id, seq, seen, score, visual, entities): the id of the first arrival, the score
    of the last one, the latest known visual, first_seen, last_seen, sightings, and entities, the newest arrival's first.

    Arrival (seq), not event time, decides what is latest. Null keys are one asset; null entities count as none. Rows are
    pre-aggregated by their key; entities are gathered by key and value, so an asset's sightings never meet in one row.
    """
    base = sightings.groupBy("url_key").agg(F.min_by("id", "seq").alias("id"), F.max_by("score", "seq").alias("score"), F.max_by("visual", F.when(F.col("visual").isNotNull(), F.col("seq"))).alias("visual"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.count("*").alias("sightings"))
    each = sightings.select("url_key", "seq", F.posexplode("entities").alias("pos", "e")).groupBy("url_key", "e").agg(F.min(F.struct((-F.col("seq")).alias("s"), "pos")).alias("at"))
    lists = each.groupBy("url_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda x: x["e"]).alias("entities"))
    return base.join(lists, base["url_key"].eqNullSafe(lists["url_key"]), "left").select(base["*"], F.coalesce("entities", F.array().cast(lists.schema["entities"].dataType)).alias("entities"))


def latest(df: DataFrame, key: str, order: str, first: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key, by order; the columns named first are those of the key's first row, as an update leaves a time
    of creation alone."""
    rest = [c for c in df.columns if c != key and c not in first]
    kept = [F.min_by(c, order).alias(c) for c in first]
    found = df.groupBy(key).agg(*kept, F.max_by(F.struct(*rest), order).alias("last_row"))
    return found.select(key, *first, "last_row.*")
