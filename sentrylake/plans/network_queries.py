"""Queries over the graph of assets, and their SQL."""

from pyspark.sql import DataFrame, SparkSession

from sentrylake.functions import catalogue as C
from sentrylake.operators import network as N
from sentrylake.plans import base as B
from sentrylake.plans.queries import _STRONG, query

_ROWS = f"SELECT *, CASE WHEN id % 8 < 3 THEN '10.0.' || CAST(CAST(floor(id / 64) AS BIGINT) AS VARCHAR(12)) || '.1' END AS ip FROM ({B.CASE_ASSETS}) c"
_USED = "SELECT * FROM e UNION ALL SELECT id, 'domain', lower(domain), FALSE FROM a WHERE id % 11 = 0 UNION ALL SELECT id, 'package_name', package, FALSE FROM a WHERE id % 13 = 0"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The assets that are drawn, and all entities; the graph takes those of its assets."""
    return N.scope(B.sql(spark, sf_dir, _ROWS)), B.sql(spark, sf_dir, f"WITH a AS ({B.CASE_ASSETS}), e AS ({B.ENTITIES}), x AS ({_USED}) SELECT * FROM x")


def _graph_sql(tail: str) -> str:
    relations = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.RELATIONS.items()) + " ELSE 'uses' END"
    return f"""WITH a AS ({_ROWS}), e AS ({B.ENTITIES}), x AS ({_USED}), g AS (SELECT * REPLACE (CASE kind WHEN 'app' THEN 'package_name:' || package WHEN 'message' THEN 'message:' || CAST(id AS VARCHAR) ELSE 'domain:' || domain END AS source) FROM a WHERE verdict <> 'benign'),
        u AS (SELECT g.id, kind, campaign, source, type, value, type || ':' || value AS target, {_STRONG} AS links FROM x JOIN g USING (id) WHERE source <> type || ':' || value),
        net AS (SELECT 'ip:' || ip AS ip_node, 'asn:' || asn AS node, id, trim(asn || ' ' || coalesce(as_name, '')) AS label FROM g WHERE ip IS NOT NULL AND asn IS NOT NULL),
        n1 AS (SELECT source AS node, CASE WHEN kind IN ('app', 'message') THEN kind ELSE 'domain' END AS type, CASE WHEN kind = 'message' THEN left(excerpt, 60) ELSE domain END AS label, campaign, id AS asset, points, verdict, brand FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY id DESC) = 1),
        d AS (SELECT target AS node, count(DISTINCT id) AS degree, bool_and(links) AS links FROM u GROUP BY target),
        f AS (SELECT target AS node, type, value, campaign, id FROM u QUALIFY row_number() OVER (PARTITION BY target ORDER BY id) = 1),
        i AS (SELECT node, label, id FROM net QUALIFY row_number() OVER (PARTITION BY node ORDER BY id) = 1),
        n2 AS (SELECT f.node, f.type, CASE WHEN i.id < f.id THEN i.label ELSE f.value END AS label, CASE WHEN i.id < f.id THEN NULL ELSE f.campaign END AS campaign, links AND NOT coalesce(i.id < f.id, FALSE) AS linking FROM f JOIN d USING (node) LEFT JOIN i USING (node) WHERE f.node NOT IN (SELECT node FROM n1)
            UNION ALL SELECT node, 'asn', label, NULL, FALSE FROM i WHERE node NOT IN (SELECT node FROM f)),
        n AS (SELECT node, type, label, campaign, asset, points, verdict, brand, NULL::BOOLEAN AS linking FROM n1 UNION ALL SELECT node, type, label, campaign, NULL, NULL, NULL, NULL, linking FROM n2),
        ed AS (SELECT DISTINCT source, target, CASE WHEN type = 'domain' AND kind = 'web' AND target IN (SELECT node FROM n1) THEN 'redirects_to' ELSE {relations} END AS relation FROM u
            UNION SELECT ip_node, node, 'in_network' FROM net WHERE EXISTS (SELECT 1 FROM u WHERE u.target = net.ip_node AND u.id <= net.id)) {tail}"""


@query(_graph_sql("SELECT n.*, coalesce(degree, 0) AS degree FROM n LEFT JOIN d USING (node)"))
def network_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.nodes(*_graph(spark, sf_dir))


@query(_graph_sql("SELECT * FROM ed"))
def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.edges(*_graph(spark, sf_dir))


@query(_graph_sql("SELECT * FROM ed WHERE source IN (SELECT node FROM n WHERE campaign IS NOT NULL) AND target IN (SELECT node FROM n WHERE campaign IS NOT NULL)"))
def network_edges_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges among nodes of campaigns."""
    a, e = _graph(spark, sf_dir)
    return N.whole(N.nodes(a, e).where("campaign IS NOT NULL"), N.edges(a, e))


@query(_graph_sql("SELECT id, type, list_sort(list_distinct(list(value))) AS \"values\" FROM x JOIN g USING (id) GROUP BY id, type"))
def asset_entities_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, e = _graph(spark, sf_dir)
    return N.by_type(e.join(a.select("id").hint("merge"), "id", "left_semi"))
