"""Assets and campaigns as stored tables that batches update: what they'd be if all were computed anew, at the cost of what a batch
touches."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.operators.campaigns import strong_entities
from sentrylake.operators.components import components
from sentrylake.sources.versioned import Versioned
from sentrylake.work import drop, new_path, written


class AssetState:
    """The state that upserted() gives, kept by url_key: assets, their entities, and a ledger of the sightings that are in it.

    sightings: the schema's source; rows (url_key, id, seq, seen, score, visual, entities) as for upserted(). A sighting is known by
    url_key and seq, and counts once, however often it comes and in whatever batch; batches may come in any order. Null keys are
    one asset.
    """

    def __init__(self, spark: SparkSession, path: str, sightings: DataFrame, buckets: int = 64):
        kind = {f.name: f.dataType.simpleString() for f in sightings.schema}
        entity = sightings.schema["entities"].dataType.elementType.simpleString()
        key, seq = f"url_key {kind['url_key']}", kind["seq"]
        assets = f"{key}, first struct<seq:{seq},value:{kind['id']}>, last struct<seq:{seq},value:{kind['score']}>, looked struct<seq:{seq},value:{kind['visual']}>, first_seen {kind['seen']}, last_seen {kind['seen']}, sightings bigint"
        tables = {"assets": (assets, ["url_key"]), "entities": (f"{key}, e {entity}, at struct<s:{seq},pos:int>", ["url_key"]), "ledger": (f"{key}, seq {seq}", ["url_key"])}
        self.spark, self.kept, self.schema = spark, Versioned(spark, path, tables, buckets), sightings.schema

    def add(self, sightings: DataFrame, writer: str = "", number: int | None = None) -> bool:
        """Takes a batch up. number: its place among the writer's batches; one that was taken up before is passed over. False if nothing
        was new. Only buckets that have new sightings are read and written; the ledger's files are added to, not rewritten."""
        if number is not None and number <= self.kept.done(writer):
            return False
        path = new_path(self.spark, "batch")
        sightings.write.parquet(path)  # a stream's batch belongs to a session of its own
        batch = self.spark.read.schema(self.schema).parquet(path)
        known = self.kept.read("ledger", self.kept.touched("ledger", batch)).toDF("known_key", "known_seq")
        fresh = batch.dropDuplicates(["url_key", "seq"]).join(known, F.col("url_key").eqNullSafe(F.col("known_key")) & (F.col("seq") == F.col("known_seq")), "left_anti")
        fresh = written(fresh, "fresh")
        buckets = self.kept.touched("assets", fresh)
        done = None if number is None else (writer, number)
        if buckets:
            replaced = {"assets": self._assets(fresh, buckets), "entities": self._entities(fresh, buckets)}
            parts = {name: (self.kept.stage(name, rows), buckets) for name, rows in replaced.items()}
            self.kept.commit(parts, {"ledger": self.kept.stage("ledger", fresh)}, done)
        elif done:
            self.kept.commit({}, done=done)
        drop(fresh)
        return bool(buckets)

    def _assets(self, fresh: DataFrame, buckets: list[int]) -> DataFrame:
        pair = lambda c: F.struct("seq", F.col(c).alias("value"))
        own = fresh.select("url_key", pair("id").alias("first"), pair("score").alias("last"), F.when(F.col("visual").isNotNull(), pair("visual")).alias("looked"), F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"), F.lit(1).cast("long").alias("sightings"))
        return own.unionByName(self.kept.read("assets", buckets)).groupBy("url_key").agg(
            F.min_by("first", "first.seq").alias("first"), F.max_by("last", "last.seq").alias("last"), F.max_by("looked", "looked.seq").alias("looked"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("sightings").alias("sightings")
        )

    def _entities(self, fresh: DataFrame, buckets: list[int]) -> DataFrame:
        own = fresh.select("url_key", "seq", F.posexplode("entities").alias("pos", "e")).select("url_key", "e", F.struct((-F.col("seq")).alias("s"), "pos").alias("at"))
        return own.unionByName(self.kept.read("entities", buckets)).groupBy("url_key", "e").agg(F.min("at").alias("at"))

    def _view(self, buckets: list[int] | None = None) -> DataFrame:
        assets, each = self.kept.read("assets", buckets), self.kept.read("entities", buckets)
        lists = each.groupBy("url_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda x: x["e"]).alias("entities")).withColumnRenamed("url_key", "entity_key")
        none = F.array().cast(lists.schema["entities"].dataType)
        return assets.join(lists, F.col("url_key").eqNullSafe(F.col("entity_key")), "left").select("url_key", F.col("first.value").alias("id"), F.col("last.value").alias("score"), F.col("looked.value").alias("visual"), "first_seen", "last_seen", "sightings", F.coalesce("entities", none).alias("entities"))

    def assets(self) -> DataFrame:
        """What upserted() gives over all sightings that were taken up."""
        return self._view()

    def probe(self, keys: DataFrame) -> DataFrame:
        """The assets of the given url_key values; reads the buckets of these alone."""
        wanted = keys.select(F.col("url_key").alias("wanted")).distinct()
        return self._view(self.kept.touched("assets", keys)).join(wanted, F.col("url_key").eqNullSafe(F.col("wanted")), "left_semi")

    def prune(self, keys: DataFrame) -> bool:
        """Drops all assets whose url_key isn't among keys, with their entities and sightings. Buckets that lose nothing stay as they are."""
        wanted = keys.select(F.col("url_key").alias("wanted")).distinct()
        among = lambda rows, how: rows.join(wanted, F.col("url_key").eqNullSafe(F.col("wanted")), how)
        buckets = self.kept.touched("assets", among(self.kept.read("assets"), "left_anti"))
        if buckets:
            self.kept.commit({name: (self.kept.stage(name, among(self.kept.read(name, buckets), "left_semi")), buckets) for name in self.kept.tables})
        return bool(buckets)

    def clear(self) -> None:
        self.kept.clear()


class CampaignState:
    """The components that members() gives, kept between batches of entity rows (id, type, value, shared_hosting).

    A stored label stands for all edges among the ids that have it. A batch makes edges from its own rows to the first id of each
    of their entities; their ends are replaced by labels, and only this small graph is solved. Components that no new edge
    touches are neither read nor written, but for what shares their bucket. Rows of ids are many whatever their files' size suggests, so
    no join sends a side to all tasks.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int = 64):
        tables = {"heads": (f"type string, value string, head {id_type}", ["type", "value"]), "labels": (f"id {id_type}, component {id_type}", ["id"]), "members": (f"component {id_type}, id {id_type}", ["component"])}
        self.spark, self.kept = spark, Versioned(spark, path, tables, buckets)

    def add(self, entities: DataFrame) -> None:
        kept = self.kept
        strong = written(strong_entities(entities), "strong")
        at = kept.touched("heads", strong)
        old = kept.read("heads", at)
        heads = written(old.unionByName(strong.groupBy("type", "value").agg(F.min("id").alias("head"))).groupBy("type", "value").agg(F.min("head").alias("head")), "heads")
        ends = strong.select("type", "value", "id").unionByName(old.withColumnRenamed("head", "id"))
        edges = written(ends.join(heads.hint("merge"), ["type", "value"]).where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "edges")
        nodes = written(edges.select("a").union(edges.select("b")).distinct().toDF("id"), "nodes")
        labels = written(nodes.join(kept.read("labels", kept.touched("labels", nodes)).hint("merge"), "id", "left").select("id", "component"), "labels")
        by = lambda c: labels.select(F.col("id").alias(c), F.coalesce("component", "id").alias(f"of_{c}"))
        solved = components(edges.join(by("a").hint("merge"), "a").join(by("b").hint("merge"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), merged=True)
        stored = labels.where("component is not null").select(F.col("component").alias("node")).distinct()
        changed = written(solved.where("node <> component").join(stored.hint("merge"), "node", "left_semi"), "changed")
        gone = changed.select(F.col("node").alias("component"))
        moved = kept.read("members", kept.touched("members", gone)).join(changed.toDF("component", "to").hint("merge"), "component").select("id", F.col("to").alias("component"))
        fresh = labels.where("component is null").select("id").join(solved.toDF("id", "component").hint("merge"), "id")
        moving = written(moved.unionByName(fresh), "moving")
        parts = {"heads": (kept.stage("heads", heads), at)}
        here = kept.touched("labels", moving)
        if here:
            stay = kept.read("labels", here).join(moving.select("id").hint("merge"), "id", "left_anti")
            parts["labels"] = kept.stage("labels", stay.unionByName(moving)), here
            there = sorted({*kept.touched("members", moving), *kept.touched("members", gone)})
            stay = kept.read("members", there).join(gone.hint("merge"), "component", "left_anti")
            parts["members"] = kept.stage("members", stay.unionByName(moving)), there
        kept.commit(parts)
        for table in (strong, heads, edges, nodes, labels, changed, moving):
            drop(table)

    def members(self) -> DataFrame:
        """(id, component), as members() gives them over all rows so far."""
        return self.kept.read("labels")

    def clear(self) -> None:
        self.kept.clear()
