"""The graph of a few assets, worked out by hand, and the cases of a plan's items."""

import importlib

from sentrylake.operators import network as N

ASSETS = "id int, kind string, domain string, package string, excerpt string, campaign string, points int, verdict string, brand string, ip string, asn string, as_name string"
ENTITIES = "id int, type string, value string, shared_hosting boolean"


def _graph(spark):
    rows = [
        (1, "web", "a.top", None, None, "c1", 80, "malicious", "sbi", "10.0.0.1", "AS1", "Net One"),
        (2, "web", "a.top", None, None, "c1", 90, "malicious", None, None, None, None),
        (3, "app", "b.io", "com.x", None, "c2", 70, "malicious", None, "10.0.0.2", "AS2", None),
        (4, "message", "", None, "Pay now " * 20, None, 50, "suspicious", None, "", "AS9", None),
        (5, "web", "ok.com", None, None, None, 0, "benign", None, None, None, None),
        (6, "web", None, None, None, None, 45, None, None, None, None, None),
    ]
    used = [
        (1, "ip", "10.0.0.1", False), (1, "domain", "a.top", False), (2, "upi_id", "p@ok", None), (3, "upi_id", "p@ok", False), (3, "domain", "a.top", False), (3, "package_name", "com.x", False),
        (3, "asn", "AS1", False), (4, "phone", "9", False), (4, "phone", "9", False), (4, "ip", "10.0.0.1", True), (6, "domain", "a.top", False), (99, "ip", "1.1.1.1", False), (6, None, "x", False),
    ]
    return N.scope(spark.createDataFrame(rows, ASSETS)), spark.createDataFrame(used, ENTITIES)


def test_graph(spark):
    a, e = _graph(spark)
    got = {r["node"]: r for r in N.nodes(a, e).collect()}
    assert set(got) == {"domain:a.top", "package_name:com.x", "message:4", "domain:", "ip:10.0.0.1", "upi_id:p@ok", "phone:9", "asn:AS1", "asn:AS2"}
    assert (got["domain:a.top"]["asset"], got["domain:a.top"]["points"], got["domain:a.top"]["linking"], got["domain:a.top"]["degree"]) == (2, 90, None, 2)
    assert got["message:4"]["label"] == ("Pay now " * 20)[:60] and got["package_name:com.x"]["type"] == "app"
    assert (got["ip:10.0.0.1"]["linking"], got["ip:10.0.0.1"]["degree"], got["ip:10.0.0.1"]["campaign"]) == (False, 2, "c1")
    assert (got["upi_id:p@ok"]["linking"], got["upi_id:p@ok"]["campaign"]) == (True, "c1")
    assert (got["asn:AS1"]["label"], got["asn:AS1"]["campaign"], got["asn:AS1"]["degree"]) == ("AS1 Net One", None, 1)
    assert (got["asn:AS2"]["label"], got["asn:AS2"]["linking"], got["asn:AS2"]["degree"]) == ("AS2", False, 0)
    edges = set(map(tuple, N.edges(a, e).collect()))
    assert edges == {
        ("domain:a.top", "ip:10.0.0.1", "hosted_on"), ("domain:a.top", "upi_id:p@ok", "collects_payments_to"), ("package_name:com.x", "upi_id:p@ok", "collects_payments_to"), ("package_name:com.x", "domain:a.top", "communicates_with"),
        ("package_name:com.x", "asn:AS1", "in_network"), ("message:4", "phone:9", "lists_contact"), ("message:4", "ip:10.0.0.1", "hosted_on"), ("domain:", "domain:a.top", "redirects_to"), ("ip:10.0.0.1", "asn:AS1", "in_network"),
    }
    shown = N.nodes(a, e).where("node <> 'phone:9'")
    assert set(map(tuple, N.whole(shown, N.edges(a, e)).collect())) == {x for x in edges if x[1] != "phone:9"}


def test_scope_and_nothing(spark):
    a, e = _graph(spark)
    assert sorted(r["id"] for r in N.scope(a, "c1").collect()) == [1, 2] and a.where("id = 5").count() == 0
    assert N.scope(spark.createDataFrame([(1, "c", "benign"), (2, "c", None)], "id int, campaign string, verdict string"), benign=True).count() == 2
    assert N.nodes(a.where("false"), e).count() == 0 and N.edges(a, e.where("false")).count() == 0


def test_cases_of_items(spark):
    items = [(1, "bank", ["a@b"], ["u1", "u2"]), (2, "bank", [], ["u2"]), (3, "npci", ["x"], []), (4, "npci", ["y"], None), (5, "bank", ["a@b"], ["u9"]), (6, "npci", [""], ["u3"])]
    cases = [(10, "bank", "a@b", ["u2", "u3", "u2"]), (11, "bank", "other", ["u1", "u2"]), (12, "npci", "x", []), (13, "npci", None, ["u3"])]
    got = N.cases_of_items(spark.createDataFrame(items, "item int, recipient string, contacts array<string>, targets array<string>"), spark.createDataFrame(cases, "case_id int, recipient string, contact string, targets array<string>"))
    assert sorted(map(tuple, got.collect())) == [(1, 10), (2, 10), (2, 11), (3, 12), (6, 13)]


def test_assets_stay_off_the_driver(spark):
    """Assets and entities of small files, but very many rows, went to the driver and to every task."""
    a, e = _graph(spark)
    entry = importlib.import_module("__spark_entry__")
    plans = [N.edges(a, e), N.nodes(a, e), *(entry.queries()[q](spark, "/root/testdata/sf0.001") for q in ("network_nodes", "network_edges", "asset_entities_by_type"))]
    for df in plans:
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "Join [id" in plan and "BroadcastHashJoin [id" not in plan


def test_edges_shown_stay_off_the_driver(spark):
    plan = importlib.import_module("__spark_entry__").queries()["network_edges_shown"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "Join [id" in plan and "BroadcastHashJoin [id" not in plan
