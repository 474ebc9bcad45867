"""Linking of assets by shared entities, campaigns, graph and pivot."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import catalogue as C
from sentrylake.functions.urls import is_shortener, owner_of, registered_domain
from sentrylake.operators.components import components


def linking(kind: Column, value: Column) -> Column:
    """Whether an entity is specific enough to tie two assets to one operator."""
    host = F.lower(value)
    shared = is_shortener(host) | host.isin(C.FREE_HOSTING) | owner_of(registered_domain(host)).isNotNull()
    return kind.isin(C.LINKING) & ~((kind == "domain") & shared) & ~((kind == "signing_cert") & host.isin(C.SHARED_SIGNING_CERTS))


def strongly_linking(kind: Column, value: Column, shared_hosting: Column) -> Column:
    """Whether it merges campaigns on its own: not a registrar or network, nor what a shared network's customers share."""
    return linking(kind, value) & ~kind.isin(C.WEAK) & ~(F.coalesce(shared_hosting, F.lit(False)) & kind.isin(C.SHARED_ON_CDN))


def entity_key(kind: Column, value: Column) -> Column:
    return F.when(kind == "domain", F.lower(value)).otherwise(value)


def strong_entities(entities: DataFrame) -> DataFrame:
    """id, type, value, once each, of those rows that merge campaigns."""
    strong = strongly_linking(F.col("type"), F.col("value"), F.col("shared_hosting"))
    return entities.where(strong).select("id", "type", entity_key(F.col("type"), F.col("value")).alias("value")).distinct()


def star_edges(entities: DataFrame) -> DataFrame:
    """(a, b) links of rows (id, type, value, shared_hosting): each asset to the first one that has the entity."""
    strong = strong_entities(entities)
    heads = strong.groupBy("type", "value").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return strong.join(heads.hint("merge"), ["type", "value"]).where("id <> a").select("a", F.col("id").alias("b")).distinct()


def members(entities: DataFrame) -> DataFrame:
    """(id, component) of assets that are in a campaign: components of two assets or more."""
    return components(star_edges(entities), merged=True).select(F.col("node").alias("id"), "component")


def campaigns(assets: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for each campaign of assets (id, brand, first_seen, last_seen): camp_id by the earliest asset, name, size,
    first_seen, last_seen and brands. Assets that are benign or false positives mustn't be in entities."""
    return campaigns_of(assets, members(entities))


def campaigns_of(assets: DataFrame, of: DataFrame) -> DataFrame:
    """campaigns() of members that are known already; an id is that of the earliest asset, so it changes only where that does."""
    joined = assets.join(of.hint("merge"), "id")
    out = joined.groupBy("component").agg(F.min(F.struct("first_seen", "id")).alias("anchor"), F.count("*").alias("size"), F.min("first_seen").alias("first_seen"), F.max(F.coalesce("last_seen", "first_seen")).alias("last_seen"), F.array_sort(F.collect_set("brand")).alias("brands"))
    name = F.concat(F.lit("Campaign targeting "), F.when(F.size("brands") > 0, F.array_join("brands", ", ")).otherwise("unknown brand"))
    return out.select(F.concat(F.lit("camp-"), F.substring(F.sha1(F.col("anchor.id").cast("string").cast("binary")), 1, 8)).alias("camp_id"), "component", name.alias("name"), "size", "first_seen", "last_seen", "brands")


def shared_entities(entities: DataFrame, of: DataFrame) -> DataFrame:
    """(component, type, value, users) of linkable entities, weak ones too, that two members of a campaign have."""
    rows = entities.where(linking(F.col("type"), F.col("value"))).join(of, "id")
    return rows.groupBy("component", "type", entity_key(F.col("type"), F.col("value")).alias("value")).agg(F.count_distinct("id").alias("users")).where("users >= 2")


def relation(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in C.RELATIONS.items() for x in p])[kind], F.lit("uses"))


def graph_edges(assets: DataFrame, entities: DataFrame) -> DataFrame:
    """(source, target, relation), each once: asset nodes are their domains. A domain that is an asset's own is where a web
    asset redirects to."""
    nodes = assets.select("id", F.concat(F.lit("domain:"), "domain").alias("source"))
    uses = entities.join(nodes, "id").withColumn("target", F.concat_ws(":", "type", "value")).where("source <> target")
    own = nodes.select(F.col("source").alias("target")).distinct().withColumn("own", F.lit(True))
    rows = uses.join(own, "target", "left")
    return rows.select("source", "target", F.when((F.col("type") == "domain") & F.col("own"), "redirects_to").otherwise(relation(F.col("type"))).alias("relation")).distinct()


def graph_nodes(entities: DataFrame) -> DataFrame:
    """(node, type, degree, linking) of entity nodes: how many assets use them, and whether they link for all of these."""
    return entities.groupBy(F.concat_ws(":", "type", "value").alias("node"), "type").agg(F.count_distinct("id").alias("degree"), F.bool_and(strongly_linking(F.col("type"), F.col("value"), F.col("shared_hosting"))).alias("linking"))


def pivot(entities: DataFrame, kind: str, value: str) -> DataFrame:
    """Ids of the assets that use an entity; case doesn't count for domains."""
    return entities.where((F.col("type") == kind) & (entity_key(F.col("type"), F.col("value")) == (value.lower() if kind == "domain" else value))).select("id").distinct()
