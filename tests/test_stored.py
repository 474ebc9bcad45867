"""Stored state against the same state computed anew, with crashes, restarts and batches that come twice."""

import random

import pytest
from pyspark.sql import functions as F

from sentrylake.operators.campaigns import members, strong_entities
from sentrylake.operators.state import upserted
from sentrylake.operators.stored import AssetState, CampaignState
from sentrylake.sources.versioned import Versioned
from sentrylake.streaming.sightings import follow
from sentrylake.work import new_path

SIGHTINGS = "url_key string, id string, seq long, seen long, score double, visual double, entities array<struct<type:string,value:string>>"


def _rows(n, seed=1, keys=12):
    rng = random.Random(seed)
    return [(rng.choice([None, *(f"u{k}" for k in range(keys))]), f"i{q}", q, rng.randrange(1000), rng.random(), rng.choice([None, rng.random()]), rng.choice([None, [], [("upi_id", f"e{rng.randrange(5)}"), ("phone", f"p{rng.randrange(5)}")]])) for q in range(n)]


def _as_set(df):
    return {repr(r.asDict(recursive=True)) for r in df.collect()}


def test_batches_in_any_order(spark):
    rows = _rows(90)
    df = spark.createDataFrame(rows, SIGHTINGS)
    state = AssetState(spark, new_path(spark, "state"), df, 4)
    cut = [rows[60:], rows[:30], rows[20:60]]  # ten rows come twice
    for k, part in enumerate(cut):
        assert state.add(spark.createDataFrame(part, SIGHTINGS), "w", k)
    assert not state.add(spark.createDataFrame(cut[1], SIGHTINGS), "w", 1)
    assert not state.add(spark.createDataFrame(cut[2], SIGHTINGS))  # no number: the ledger knows the rows
    assert _as_set(state.assets()) == _as_set(upserted(df))
    again = AssetState(spark, state.kept.path, df, 99)  # another job
    assert again.kept.buckets == 4 and _as_set(again.assets()) == _as_set(upserted(df))


def test_a_crash_before_the_switch(spark, monkeypatch):
    rows = _rows(40, 2)
    df = spark.createDataFrame(rows, SIGHTINGS)
    state = AssetState(spark, new_path(spark, "state"), df, 4)
    state.add(spark.createDataFrame(rows[:20], SIGHTINGS), "w", 0)
    before, version = _as_set(state.assets()), state.kept.version()
    with monkeypatch.context() as m:
        m.setattr(Versioned, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            state.add(spark.createDataFrame(rows[20:], SIGHTINGS), "w", 1)
    assert _as_set(state.assets()) == before and state.kept.version() == version
    state.add(spark.createDataFrame(rows[20:], SIGHTINGS), "w", 1)
    assert _as_set(state.assets()) == _as_set(upserted(df))
    with pytest.raises(Exception, match="exists"):  # a version's name is given once
        state.kept._publish(state.kept.version(), {})


def test_prune_probe_and_clear(spark):
    df = spark.createDataFrame(_rows(60, 3), SIGHTINGS)
    state = AssetState(spark, new_path(spark, "state"), df, 8)
    state.add(df)
    one = spark.createDataFrame([("u3",)], "url_key string")
    state.kept.reads.clear()
    assert _as_set(state.probe(one)) == _as_set(upserted(df).where("url_key = 'u3'"))
    assert {tuple(b) for _, b in state.kept.reads} == {tuple(state.kept.touched("assets", one))}
    keys = spark.createDataFrame([("u1",), ("u3",), (None,), ("never",)], "url_key string")
    assert state.prune(keys) and not state.prune(keys)
    assert _as_set(state.assets()) == _as_set(upserted(df).where("url_key in ('u1', 'u3') or url_key is null"))
    state.add(df.where("url_key = 'u2'"))  # a pruned sighting may come again
    assert state.assets().where("url_key = 'u2'").count() == 1
    state.clear()
    assert state.assets().count() == 0 and state.add(df)
    assert not state.add(df.limit(0), "w", 0) and state.kept.done("w") == 0


def test_old_buckets_are_not_rewritten(spark):
    df = spark.createDataFrame(_rows(60, 4), SIGHTINGS)
    state = AssetState(spark, new_path(spark, "state"), df, 8)
    state.add(df)
    before = state.kept.manifest()["files"]
    state.add(spark.createDataFrame([("u1", "x", 1000, 5, 0.5, None, None)], SIGHTINGS))
    after, here = state.kept.manifest()["files"], state.kept.touched("assets", spark.createDataFrame([("u1",)], "url_key string"))
    for name in before:
        assert {b for b in after[name] if after[name][b] != before[name].get(b)} == {str(here[0])}
    assert len(after["ledger"][str(here[0])]) == 2 and len(after["assets"][str(here[0])]) == 1


def test_a_stream_that_starts_again(spark, tmp_path):
    rows = _rows(80, 5)
    df = spark.createDataFrame(rows, SIGHTINGS)
    state = AssetState(spark, new_path(spark, "state"), df, 4)
    checkpoint = new_path(spark, "checkpoint")
    for part in (rows[50:], rows[:30], rows[25:55]):  # late files, and rows that come twice
        spark.createDataFrame(part, SIGHTINGS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
        follow(stream, state, checkpoint).awaitTermination()
    assert _as_set(state.assets()) == _as_set(upserted(df)) and state.kept.done("stream") == 2


ENTITY = "id long, type string, value string, shared_hosting boolean"


def test_campaigns_by_batches(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(120), "upi_id", f"u{rng.randrange(90)}", False) for _ in range(150)] + [(i, "phone", "9876500000", False) for i in range(100, 106)]
    rng.shuffle(rows)
    state, path = None, new_path(spark, "campaigns")
    for k in range(5):
        part = rows[k * 30 : (k + 1) * 30] if k < 4 else rows[120:]
        state = CampaignState(spark, path, buckets=4)
        state.add(spark.createDataFrame(part, ENTITY))
        seen = spark.createDataFrame(rows[: (k + 1) * 30] if k < 4 else rows, ENTITY)
        assert {tuple(r) for r in state.members().collect()} == {tuple(r) for r in members(seen).collect()}
        assert {tuple(r) for r in state.kept.read("members").select("id", "component").collect()} == {tuple(r) for r in state.members().collect()}
    version = _as_set(state.members())
    state.add(spark.createDataFrame(rows[:30], ENTITY))
    assert _as_set(state.members()) == version


def test_untouched_components_are_not_read(spark):
    rows = [(10 * c + k, "upi_id", f"u{c}", False) for c in range(40) for k in range(3)]
    state = CampaignState(spark, new_path(spark, "campaigns"), buckets=64)
    state.add(spark.createDataFrame(rows, ENTITY))
    batch = spark.createDataFrame([(7000, "upi_id", "u5", False), (7000, "phone", "9000000001", False), (60, "phone", "9000000001", False)], ENTITY)
    state.kept.reads.clear()
    state.add(batch)
    got = dict(tuple(r) for r in state.members().collect())
    assert {i for i, c in got.items() if c == 50} == {50, 51, 52, 60, 61, 62, 7000}
    own = spark.createDataFrame([(50,), (60,)], "component long")
    read = {b for name, buckets in state.kept.reads[:-1] if name == "members" for b in buckets}
    assert read <= set(state.kept.touched("members", own)) and len(read) <= 2
    assert strong_entities(batch).count() == 3
