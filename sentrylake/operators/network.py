"""The graph of assets and what they use: nodes of each kind, edges, scope, and what hangs together in it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.operators.campaigns import relation, strongly_linking


def scope(assets: DataFrame, campaign: str | None = None, benign: bool = False) -> DataFrame:
    """The assets that a graph is drawn of: of one campaign or all, benign ones only if asked for. False positives stay."""
    out = assets if campaign is None else assets.where(F.col("campaign") == campaign)
    return out if benign else out.where(~F.col("verdict").eqNullSafe("benign"))


def asset_node(kind: Column, package: Column, id_: Column, domain: Column) -> Column:
    """An app's node is its package, a message's its id, any other asset's its domain."""
    app = (kind == "app") & package.isNotNull()
    return F.when(app, F.concat(F.lit("package_name:"), package)).when(kind == "message", F.concat(F.lit("message:"), id_.cast("string"))).otherwise(F.concat(F.lit("domain:"), F.coalesce(domain, F.lit(""))))


def _uses(assets: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, kind, campaign, source, target, type, value, links): each use of an entity that isn't the asset's own node."""
    own = assets.select("id", "kind", "campaign", asset_node(F.col("kind"), F.col("package"), F.col("id"), F.col("domain")).alias("source"))
    rows = entities.where("type IS NOT NULL AND value IS NOT NULL").select("id", "type", "value", strongly_linking(F.col("type"), F.col("value"), F.col("shared_hosting")).alias("links"))
    # assets are as many as a table's rows, whatever their files' size suggests: none of the two goes to all tasks
    return own.hint("merge").join(rows, "id").withColumn("target", F.concat_ws(":", "type", "value")).where("source <> target")


def _networks(assets: DataFrame) -> DataFrame:
    """(ip_node, node, label, last, first) of addresses and the networks they are in, with the first and last asset so hosted."""
    label = F.trim(F.concat_ws(" ", "asn", F.coalesce("as_name", F.lit(""))))
    rows = assets.where("ip <> '' AND asn <> ''").select("id", F.concat(F.lit("ip:"), "ip").alias("ip_node"), F.concat(F.lit("asn:"), "asn").alias("node"), label.alias("label"))
    return rows.groupBy("ip_node", "node").agg(F.max("id").alias("last"), F.min(F.struct("id", "label")).alias("first"))


def nodes(assets: DataFrame, entities: DataFrame) -> DataFrame:
    """One row a node: node, type, label, campaign, asset, points, verdict, brand, linking and degree (assets that use it).

    assets have id, kind, domain, package, excerpt, campaign, points, verdict, brand, ip, asn and as_name; entities id, type, value and
    shared_hosting. Assets come in order of id, by which the last of those that share a node is shown; what an asset shows weighs more
    than an entity of its name, and its linking is null. An entity links if it does for all that use it; its campaign is that of the first.
    A network that only addresses lead to has a node without campaign. Entities without type or value are none.
    """
    label = F.when(F.col("kind") == "message", F.substring(F.coalesce("excerpt", "domain"), 1, 60)).otherwise(F.col("domain"))
    kind = F.when(F.col("kind").isin("app", "message"), F.col("kind")).otherwise("domain")
    shown = F.struct("id", kind.alias("type"), label.alias("label"), "campaign", "points", "verdict", "brand")
    own = assets.select(asset_node(F.col("kind"), F.col("package"), F.col("id"), F.col("domain")).alias("node"), shown.alias("own"))
    own = own.groupBy("node").agg(F.max_by("own", "own.id").alias("own"))
    used = _uses(assets, entities).groupBy("target", "type", "value").agg(F.count_distinct("id").alias("degree"), F.bool_and("links").alias("links"), F.min_by("campaign", "id").alias("campaign"), F.min("id").alias("first")).withColumnRenamed("target", "node")
    led = _networks(assets).groupBy("node").agg(F.min("first").alias("by"))
    out = own.join(used, "node", "full").join(led, "node", "full")
    an_asset, early = F.col("own").isNotNull(), F.col("by").isNotNull() & (F.col("first").isNull() | (F.col("by.id") < F.col("first")))
    return out.select(
        "node",
        F.when(an_asset, F.col("own.type")).otherwise(F.coalesce("type", F.lit("asn"))).alias("type"),
        F.when(an_asset, F.col("own.label")).when(early, F.col("by.label")).otherwise(F.col("value")).alias("label"),
        F.when(an_asset, F.col("own.campaign")).when(~early, F.col("campaign")).alias("campaign"),
        F.col("own.id").alias("asset"), "own.points", "own.verdict", "own.brand",
        F.when(~an_asset, F.coalesce("links", F.lit(False)) & ~early).alias("linking"),
        F.coalesce("degree", F.lit(0)).alias("degree"),
    )


def edges(assets: DataFrame, entities: DataFrame) -> DataFrame:
    """(source, target, relation), each once: what assets use, domains of assets that web assets redirect to, and the networks that
    addresses are in where an asset shows the address by then."""
    uses = _uses(assets, entities).groupBy("source", "target", "type", (F.col("kind") == "web").alias("web")).agg(F.min("id").alias("first"))
    own = assets.select(asset_node(F.col("kind"), F.col("package"), F.col("id"), F.col("domain")).alias("target")).distinct().withColumn("own", F.lit(True))
    plain = uses.where("type <> 'domain' OR NOT web").select("source", "target", relation(F.col("type")).alias("relation"))
    domains = uses.where("type = 'domain' AND web").join(own, "target", "left").select("source", "target", F.when(F.col("own"), "redirects_to").otherwise(relation(F.col("type"))).alias("relation"))
    seen = uses.where("type = 'ip'").groupBy(F.col("target").alias("ip_node")).agg(F.min("first").alias("seen"))
    within = _networks(assets).join(seen, "ip_node").where("seen <= last").select(F.col("ip_node").alias("source"), F.col("node").alias("target"), F.lit("in_network").alias("relation"))
    return plain.union(domains).union(within).distinct()


def whole(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """The edges both of whose ends are shown; others dangle."""
    ends = nodes_.select("node").distinct()
    return edges_.join(ends.withColumnRenamed("node", "source"), "source", "left_semi").join(ends.withColumnRenamed("node", "target"), "target", "left_semi").select(edges_.columns)


def by_type(entities: DataFrame) -> DataFrame:
    """(id, type, values): an asset's values of each type, each once, by code point. One asset's own are few: it is one page, app or
    message."""
    return entities.groupBy("id", "type").agg(F.array_sort(F.collect_set("value")).alias("values"))


def cases_of_items(items: DataFrame, cases: DataFrame) -> DataFrame:
    """(item, case_id) of the cases (case_id, recipient, contact, targets) that carry out an item of a plan (item, recipient, contacts,
    targets): the same recipient, its first contact if it has one, and a target of both unless the item has none."""
    first = F.get("contacts", F.lit(0))
    asked = items.select("item", "recipient", F.when(first != "", first).alias("first"), F.explode_outer("targets").alias("target"))
    held = cases.select("case_id", "recipient", "contact")
    some = asked.where("target IS NOT NULL").distinct().join(held.join(cases.select("case_id", F.explode("targets").alias("target")), "case_id"), ["recipient", "target"])
    none = asked.where("target IS NULL").join(held, "recipient")
    return some.select("item", "case_id", "first", "contact").union(none.select("item", "case_id", "first", "contact")).where("first IS NULL OR first = contact").select("item", "case_id").distinct()
