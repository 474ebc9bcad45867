"""Lists of public suffixes, wired into what asks for registered names."""

import pytest
from pyspark.sql import functions as F

from sentrylake.functions.urls import lexical
from sentrylake.operators import casework as K
from sentrylake.operators.verdicts import judged
from sentrylake.sources import landed


@pytest.fixture
def rules(spark):
    return landed.suffix_rules(spark.createDataFrame([(r,) for r in ["// list", "com", "jp", "ne.jp", "in", "*.ck", "!www.ck", "github.io"]], "value string"))


HOSTS = {
    "a.b.ne.jp": "b.ne.jp", "b.ne.jp": "b.ne.jp", "ne.jp": "ne.jp", "x.y.com": "y.com", "A.B.Com": "b.com", "x.www.ck": "www.ck", "p.q.r.ck": "q.r.ck",
    "me.github.io": "me.github.io", "hdfc.bank.in": "hdfc.bank.in", "www.hdfc.bank.in": "hdfc.bank.in", "10.1.2.3": "10.1.2.3", "no.such.rule": "such.rule", "localhost": "localhost", "": "", "a.com.": "a.com",
}


def test_registered_names(spark, rules):
    rows = [(i, h, "kept") for i, h in enumerate([*HOSTS, None, *["hot.ne.jp"] * 50])]
    df = spark.createDataFrame(rows, "id int, host string, suffix string")
    out = landed.with_registered(df, rules)
    assert out.columns == ["id", "host", "suffix", "registered"] and out.count() == len(rows)
    found = {r.host: r.registered for r in out.collect()}
    assert found == HOSTS | {None: "", "hot.ne.jp": "hot.ne.jp"}
    assert landed.with_registered(df.where("false"), rules).count() == 0
    assert {r.registered for r in landed.with_registered(df.where("host = 'a.b.ne.jp'"), rules.where("false")).collect()} == {"ne.jp"}


def test_rules_reach_letters_verdicts_and_plans(spark, rules):
    urls = spark.createDataFrame([(1, "http://phonepe.evil.ne.jp/"), (2, None)], "id int, url string")
    own = landed.with_registered(urls.withColumn("site", F.regexp_extract("url", "//([^/]*)", 1)), rules, "site", "name")
    assert {r.id: r.registered for r in lexical(own, "url", "name").collect()} == {1: "evil.ne.jp", 2: ""}
    # with the short list ne.jp is the registered name, evil its subdomain as much as phonepe
    short, full = (judged(urls, rules=r).where("id = 1").first() for r in (None, rules))
    assert full.host == short.host == "phonepe.evil.ne.jp" and "brand_in_subdomain" in [s.name for s in full.signals]
    at = "struct<ok:boolean,status:int,url:string,hops:int,content_type:string,html:string,shot:struct<phash:string,dhash:string>,icon_phash:string,icon_md5:string>"
    moved = spark.createDataFrame([(1, "http://a.one.ne.jp/", (True, 200, "http://b.two.ne.jp/", 2, "text/html", "<p>x</p>", None, None, None))], f"id int, url string, page {at}")
    names = lambda df: [s.name for s in df.first().signals]
    assert "cross_site_redirect" in names(judged(moved, rules=rules)) and "cross_site_redirect" not in names(judged(moved))
    assets = spark.createDataFrame([(1, "c", "web", "unreviewed", "x.evil.ne.jp", "http://x.evil.ne.jp", None, None, None, None, None, None, None, None)], "id int, campaign string, kind string, review string, domain string, url string, brand string, registrar string, registrar_contact string, asn string, as_name string, host_contacts array<string>, package string, sha256 string")
    entities = spark.createDataFrame([], "id int, type string, value string")
    target = lambda df: df.where("recipient = 'registrar'").first().target
    assert target(K.plan_targets(assets, entities)) == "ne.jp"
    known = landed.with_registered(assets, rules, "domain")
    assert target(K.plan_targets(known, entities)) == target(K.case_targets(known, entities)) == "evil.ne.jp"
