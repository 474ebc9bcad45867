"""State of assets from a stream of sightings."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sentrylake.operators.stored import AssetState
from sentrylake.work import new_path


def state_of(events: DataFrame) -> DataFrame:
    """Sightings by key. Minimum and maximum don't depend on order, so late rows need no watermark."""
    return events.groupBy("user_id").agg(F.count("*").alias("sightings"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def final_state(spark: SparkSession, path: str) -> DataFrame:
    """The state after all files at path went through the stream once. Updated keys of each batch are written as files, and
    the newest row of a key is its state, so a restarted query picks up from its checkpoint."""
    held = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(held.schema).parquet(folder, pathGlobFilter=name) if name.endswith(".parquet") else spark.readStream.schema(held.schema).parquet(path)
    out = new_path(spark, f"sightings-{uuid.uuid4().hex[:6]}")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/state/batch={number}")

    query = state_of(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/state")
    latest = rows.groupBy("user_id").agg(F.max_by(F.struct("sightings", "first_seen", "last_seen"), "batch").alias("x"))
    return latest.select("user_id", "x.*")


def follow(sightings: DataFrame, state: AssetState, checkpoint: str, writer: str = "stream") -> StreamingQuery:
    """A query that takes a stream of sightings up into stored state, batch by batch, until it has all that is there.

    State is in the stored tables, not in the stream, so it grows with the assets and not with the time since they were seen; a batch
    rewrites the buckets it touches. A query that starts again from its checkpoint gives its last batch once more, and that is passed
    over by its number; rows that a source delivers twice are passed over by the ledger. Order of arrival is seq, so late and
    unordered files leave the same state, and no watermark is needed."""
    return sightings.writeStream.foreachBatch(lambda batch, number: state.add(batch, writer, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
