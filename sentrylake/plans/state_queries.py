"""Queries over stored state: batches that update tables, and streams into them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.operators import campaigns as G
from sentrylake.operators import state as ST
from sentrylake.operators.stored import AssetState, CampaignState
from sentrylake.plans import base as B
from sentrylake.plans.queries import ORACLES, _assets, _components_sql, _entities, _sightings, _table, query
from sentrylake.streaming.sightings import follow
from sentrylake.work import new_path, written


def _stored(spark: SparkSession, sf_dir: str, buckets: int = 16) -> AssetState:
    """The sightings in three batches, none of them in the order of arrival, and one of them twice."""
    rows = _sightings(spark, sf_dir)
    state = AssetState(spark, new_path(spark, "assets"), rows, buckets)
    for number, k in enumerate((2, 0, 1, 0)):
        state.add(rows.where(F.col("seq") % 3 == k), "batches", number)
    return state


@query(ORACLES["upsert_state"])
def stored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).assets().drop("entities")


_WANTED = "SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 20"


@query(f"SELECT * FROM ({ORACLES['upsert_state']}) x WHERE url_key IN ({_WANTED})")
def stored_state_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _stored(spark, sf_dir)
    state.prune(B.sql(spark, sf_dir, _WANTED).withColumnRenamed("user_id", "url_key"))
    return state.assets().drop("entities")


@query(f"SELECT url_key, sightings FROM ({ORACLES['upsert_state']}) x WHERE url_key IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def stored_state_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = B.sql(spark, sf_dir, "SELECT c_custkey AS url_key FROM customer WHERE c_acctbal < 0")
    return _stored(spark, sf_dir).probe(keys).select("url_key", "sightings")


@query(ORACLES["entity_union"])
def stream_asset_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as a stream of files into stored state."""
    rows = written(_sightings(spark, sf_dir).repartition(4, "seq"), "sightings")
    state = AssetState(spark, new_path(spark, "assets"), rows, 16)
    folder = rows.inputFiles()[0].rpartition("/")[0]
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    follow(stream, state, new_path(spark, "checkpoint")).awaitTermination()
    return state.assets().select("url_key", F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["value"])), ",").alias("entities"))


def _updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entities(spark, sf_dir, B.FLAGGED)
    state = CampaignState(spark, new_path(spark, "campaigns"), buckets=16)
    for k in (1, 0, 2):
        state.add(rows.where(F.col("id") % 3 == k))
    return state.members()


@query(_components_sql("SELECT id, component FROM m"))
def campaign_members_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir)


@query(ORACLES["campaign_summary"])
def campaign_summary_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.campaigns_of(_assets(spark, sf_dir, B.FLAGGED), _updated(spark, sf_dir)).select("camp_id", "size", "first_seen", "last_seen", "name")


@query("SELECT user_id, min(event_id) AS created, max(event_id) AS event_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("created"), F.col("event_type").alias("status"))
    return ST.latest(e, "user_id", "event_id", ("created",))
