"""Loaders of landed files, small helpers, the seeded sample and icons of apps, on rows worked out by hand."""

import json

from pyspark.sql import functions as F

from sentrylake.functions import markup as H
from sentrylake.operators import labelled as L
from sentrylake.operators import reads as R
from sentrylake.operators import verdicts as V
from sentrylake.operators.apps import app_candidates, scored_apps
from sentrylake.sources import feeds, landed


def test_networks(spark):
    rows = [
        ("1.1.1.1", '{"data": {"asns": ["13335"], "prefix": "1.1.1.0/24"}}', '{"data": {"holder": "CDN"}}', '{"data": {"abuse_contacts": ["a@b"]}}'),
        ("2.2.2.2", '{"data": {"asns": []}}', '{"data": {"holder": "X"}}', None),
        ("3.3.3.3", "no json", None, "[]"),
    ]
    got = landed.networks(spark.createDataFrame(rows, "ip string, network string, overview string, abuse string"))
    assert sorted(map(tuple, got.collect())) == [("1.1.1.1", "AS13335", "CDN", "1.1.1.0/24", ["a@b"]), ("2.2.2.2", None, None, None, []), ("3.3.3.3", None, None, None, [])]


def test_brand_library(spark, tmp_path):
    (tmp_path / "refs.json").write_text(json.dumps({"brands": {"sbi": {"screenshots": [{"phash": "p1", "dhash": "d1"}], "favicon_md5": ["m"], "favicon_phash": ["q"], "apps": [{"package": "x", "icon_phash": "i", "icon_dhash": "j"}]}, "hdfc": {}}}))
    got = landed.brand_library(spark, f"file://{tmp_path}/refs.json")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [("sbi", "screenshot", "p1", "d1", None), ("sbi", "icon", "q", None, None), ("sbi", "icon", None, None, "m"), ("sbi", "app", "i", "j", None)]))


def test_metrics_go_out_and_come_back(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"url": {"precision": 0.5, "note": null}, "page": {"recall": 1}}')
    got = landed.metrics(spark, f"file://{tmp_path}/m.json")
    assert sorted(map(tuple, got.collect())) == [("page", "recall", 1.0), ("url", "precision", 0.5)]
    landed.write_metrics(spark.createDataFrame([("b", 0.5), ("a", None)], "split string, f1 double"), f"file://{tmp_path}/out")
    back = spark.read.schema("split string, f1 double").json(f"file://{tmp_path}/out")
    assert sorted(map(tuple, back.collect())) == [("a", None), ("b", 0.5)]


def test_labelled_file(spark, tmp_path):
    (tmp_path / "l.csv").write_text("url,label,target\nhttp://a/,phishing,sbi\nhttp://b/,phishing,other\nhttp://c/,benign,\n")
    assert sorted(r["url"] for r in landed.labelled(spark, f"file://{tmp_path}/l.csv").collect()) == ["http://a/", "http://c/"]


def test_cases_and_pages_of_rows(spark):
    cases = spark.createDataFrame([(1, "c", "sent", 5), (2, "c", "drafted", 3), (3, "d", "sent", 9), (4, None, "sent", 9)], "case_id int, campaign string, status string, created_at int")
    ids = lambda df: [r["case_id"] for r in df.collect()]
    assert ids(R.cases_of(cases)) == [3, 4, 1, 2] and ids(R.cases_of(cases, campaign="c")) == [2, 1] and ids(R.cases_of(cases, status="sent")) == [3, 4, 1] and ids(R.cases_of(cases, "c", "sent")) == [1]
    rows = cases.orderBy("case_id")
    assert ids(R.page_of(rows, 0, 2)) == [1, 2, 3] and ids(R.page_of(rows, 1, 2)) == [3, 4] and ids(R.page_of(rows, 2, 2)) == []


def test_lookalikes_and_refusals(spark):
    hosts = spark.createDataFrame([("paytm-kyc.top",), ("paytm-kyc.top",), ("paytm.com",), ("example.org",), (None,)], "host string")
    assert list(map(tuple, feeds.lookalikes(hosts).collect())) == [("paytm-kyc.top", "paytm")]
    titles = spark.createDataFrame([("Just a moment...",), ("403 Forbidden",), ("",), (None,), ("PhonePe",)], "t string")
    assert [r[0] for r in titles.select(H.is_block_page(F.col("t"))).collect()] == [True, True, True, True, False]


def test_host_entities(spark):
    facts = spark.createDataFrame([("a.top", "1.1.1.1", "AS1", None, None, ["UA-1", "G-2"]), ("b.top", None, None, "Reg", "f" * 4, None)], "host string, ip string, asn string, registrar string, cert string, analytics array<string>")
    got = sorted(map(tuple, V.host_entities(facts).collect()))
    assert got == [("a.top", 0, "ip", "1.1.1.1"), ("a.top", 1, "asn", "AS1"), ("a.top", 2, "analytics_id", "UA-1"), ("a.top", 3, "analytics_id", "G-2"), ("b.top", 0, "cert_fingerprint", "ffff"), ("b.top", 1, "registrar", "Reg")]
    assert V.host_entities(facts.drop("cert", "analytics")).count() == 3


def test_a_seeded_sample(spark):
    """So many of the top as asked for, the same for any partitions, others for another seed."""
    ranking = spark.range(1, 501).select(F.col("id").alias("rank"), F.concat(F.lit("site"), F.col("id"), F.lit(".example")).alias("domain"))
    lines = spark.createDataFrame([("feed", 1, 1, "http://paytm-kyc.top/")], "source string, rank int, nth int, value string")
    targets = spark.createDataFrame([], "host string, target string")
    drawn = lambda df, seed: {r["host"] for r in L.hosts_of(lines, df, targets, general=40, top=200, seed=seed).where("source = 'ranking_general'").collect()}
    one = drawn(ranking, 1)
    assert len(one) == 40 and one == drawn(ranking.repartition(7, "domain"), 1) and one != drawn(ranking, 2)
    assert all(int(h[4:].split(".")[0]) <= 200 for h in one)
    assert [(r["host"], r["target"], r["label"]) for r in L.hosts_of(lines, ranking, targets, 0).collect()] == [("paytm-kyc.top", "other", "phishing")]


def test_icons_of_apps(spark):
    refs = spark.createDataFrame([("sbi", "app", "f" * 16, "0" * 16, None)], "brand string, kind string, phash string, dhash string, md5 string")
    schema = "sha256 string, package string, label string, permissions array<string>, strings array<string>, cert_sha256 array<string>, has_launcher boolean, origin_url string, icon struct<phash:string,dhash:string>"
    row = lambda k, icon: (k, "com.tool.x", "Tool", [], [], ["c"], True, None, icon)
    got = scored_apps(spark.createDataFrame([row("same", ("f" * 16, "0" * 16)), row("near", ("f" * 15 + "e", "0" * 15 + "1")), row("far", ("0" * 16, "f" * 16)), row("none", None)], schema), refs)
    assert {r["sha256"]: (r["brand"], [s["name"] for s in r["signals"]], r["score"]) for r in got.collect()} == {
        "same": ("sbi", ["app_icon_impersonation"], 40), "near": ("sbi", ["app_icon_impersonation"], 40), "far": (None, [], 0), "none": (None, [], 0),
    }
    made = {r["sha256"]: r for r in app_candidates(got.withColumn("origin_url", F.when(F.col("sha256") == "near", "http://x.top/a.apk"))).collect()}
    assert made["same"]["url"] == "android://com.tool.x?sha256=same" and made["same"]["visual_similarity"] == 1.0 and 0.9 < made["near"]["visual_similarity"] < 1 and made["far"]["visual_similarity"] is None
    assert [s["name"] for s in made["near"]["signals"]] == ["app_icon_impersonation", "sideloaded_distribution"] and made["far"]["signals"] == []
