"""Behaviour of the analytics operators on small cases."""

import pytest
from pyspark.sql import functions as F

from sentrylake.functions import text as T
from sentrylake.functions import urls as U
from sentrylake.operators import campaigns as G
from sentrylake.operators import casework as K
from sentrylake.operators import evaluation as E
from sentrylake.operators import messages as M
from sentrylake.operators import reads as R
from sentrylake.operators import state as ST
from sentrylake.operators.components import components
from sentrylake.sources import feeds


def _lexical(spark, url):
    return U.lexical(spark.createDataFrame([(url,)], "url string")).first()


@pytest.mark.parametrize("url,brand", [("http://pаytm-kyc.top/login", "paytm"), ("https://secure.phonpe.in/", "phonepe"), ("http://goog1epay.cc", "gpay")])
def test_lures_name_their_brand(spark, url, brand):
    row = _lexical(spark, url)
    assert row["brand"] == brand and row["verdict"] != "benign"


@pytest.mark.parametrize("url", ["https://www.phonepe.com/", "https://onlinesbi.sbi/portal", "https://example.org/", "http://lesbian-news.com/", "http://payment.com/refund"])
def test_innocent_hosts(spark, url):
    assert _lexical(spark, url)["verdict"] == "benign"


def test_normalize_url(spark):
    cases = {"HTTPS://WWW.Example.COM:443/Path?Q=1#frag": "https://www.example.com/Path?Q=1", "http://example.org:8080/": "http://example.org:8080", "example.net/a": "http://example.net/a"}
    rows = spark.createDataFrame([(k,) for k in cases], "url string").select("url", U.normalize_url(F.col("url")).alias("key")).collect()
    assert {r["url"]: r["key"] for r in rows} == cases


def test_messages(spark):
    texts = ["Dear SBI user, your account will be blocked today. Update KYC: pay Rs 10 to sbi.kyc@okaxis or call 9876543210", "Your OTP is 4812. Do not share it with anyone.", None, ""]
    rows = M.scored_messages(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).orderBy("id").collect()
    assert rows[0]["verdict"] == "malicious" and rows[0]["brand"] == "sbi" and rows[0]["upi"] == ["sbi.kyc@okaxis"]
    assert [r["verdict"] for r in rows[1:]] == ["benign"] * 3


def test_digest_ignores_case_and_space(spark):
    rows = spark.createDataFrame([("Pay  NOW",), (" pay now\n",)], "text string").select(T.message_digest(F.col("text")).alias("d")).distinct()
    assert rows.count() == 1


@pytest.mark.parametrize("edges,want", [([], {}), ([(1, 1)], {}), ([(1, 2), (2, 3), (5, 4)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}), ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}), ([(0, i) for i in range(1, 300)], {i: 0 for i in range(300)})])
def test_components(spark, edges, want):
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want


def _entities(spark, rows):
    return spark.createDataFrame(rows, "id long, type string, value string, shared_hosting boolean")


def test_what_links_campaigns(spark):
    same_ip = [(1, "ip", "203.0.113.7", False), (2, "ip", "203.0.113.7", False)]
    assert G.members(_entities(spark, same_ip)).count() == 2
    assert G.members(_entities(spark, [(i, k, v, True) for i, k, v, _ in same_ip])).count() == 0
    upi = [(i, k, v, True) for i, k, v, _ in same_ip] + [(1, "upi_id", "x@okaxis", True), (2, "upi_id", "x@okaxis", True)]
    assert G.members(_entities(spark, upi)).count() == 2
    assert G.members(_entities(spark, [(1, "asn", "AS1", False), (2, "asn", "AS1", False)])).count() == 0


def test_upsert_keeps_first_id_and_last_score(spark):
    e = lambda v: f"named_struct('type', 'ip', 'value', '{v}')"
    rows = spark.sql(f"SELECT * FROM VALUES ('k', 1L, 1L, TIMESTAMP_NTZ '2024-01-02', 0.5D, 0.9D, array({e('a')})), ('k', 2L, 2L, TIMESTAMP_NTZ '2024-01-01', 0.3D, CAST(NULL AS DOUBLE), array({e('b')}, {e('a')})) AS t(url_key, id, seq, seen, score, visual, entities)")
    r = ST.upserted(rows).first()
    assert (r["id"], r["score"], r["visual"], r["sightings"]) == (1, 0.3, 0.9, 2)
    assert [tuple(e) for e in r["entities"]] == [("ip", "b"), ("ip", "a")] and r["first_seen"] < r["last_seen"]


def test_search_bounds(spark):
    with pytest.raises(ValueError):
        R.search(spark.range(1), limit=0)
    with pytest.raises(ValueError):
        R.search(spark.range(1), offset=-1)


def test_channel(spark):
    df = spark.createDataFrame([([],), (["a@b.c"],), (["a@b.c", "https://x"],), (["1930"],)], "c array<string>")
    assert [r[0] for r in df.select(K.channel(F.col("c"))).collect()] == ["lookup_required", "email", "web_form", "phone"]


def test_published_rates(spark):
    """The confusion counts and rates of the published evaluation."""
    m = spark.createDataFrame([("test", 21, 3, 6, 1330), ("dev", 23, 2, 5, 1343), ("none", 0, 0, 0, 0)], "split string, tp long, fp long, fn long, tn long")
    got = {r["split"]: (r["precision"], r["recall"], r["f1"], r["fpr"]) for r in E.rates(m).collect()}
    assert got == {"test": (0.875, 0.7778, 0.8235, 0.0023), "dev": (0.92, 0.8214, 0.8679, 0.0015), "none": (0.0, 0.0, 0.0, 0.0)}
    low, high = E.wilson(F.lit(21), F.lit(24))
    r = spark.range(1).select(F.round(low, 2), F.round(high, 2)).first()
    assert tuple(r) == (0.69, 0.96)


def test_feed_and_certificate_logs(spark):
    lines = spark.createDataFrame(list(enumerate(["# note", "", "http://a.com/x", "https://b.com", "http://a.com/x", "ftp://no", "plain"])), "line long, value string")
    assert sorted(r["url"] for r in feeds.feed_urls(lines).collect()) == ["http://a.com/x", "https://b.com"]
    raw = spark.createDataFrame([('[{"name_value": "*.A.com\\nb.com", "common_name": "a.com"}]',), ("not json",), ("{}",), (None,)], "raw string")
    assert sorted(r["host"] for r in feeds.ct_hosts(raw).collect()) == ["a.com", "b.com"]


@pytest.mark.parametrize("text,want", [("Update KYC at sbi-kyc.top/update now", ["http://sbi-kyc.top/update"]), ("visit www.phonepe-kyc.in", ["http://www.phonepe-kyc.in"]), ("Dear Mr.Sharma, pay to sbi.kyc.help@ybl", []), ("see report.pdf, e.g. the attachment", []), ("mail me at a.b@gmail.com", []), ("under co.in or pay.co.in", ["http://pay.co.in"])])
def test_bare_hosts_need_a_public_suffix(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(T.all_urls(F.col("text"))).first()[0] == want
    assert feeds.message_rows(df.selectExpr("1 AS id", "text")).where("kind = 'url'").count() == len(want)


def test_suffixes_by_list(spark):
    hosts = spark.createDataFrame([("a.sharma",), ("a.b.ne.jp",), ("ne.jp",), ("jp",)], "h string")
    assert [r[0] for r in hosts.select(T.has_public_suffix(F.col("h"), ["ne.jp", "sharma"])).collect()] == [True, True, False, False]


def test_search_by_url(spark):
    assets = spark.createDataFrame([(1, "x.example", "http://x.example/paytm-login", 5, 1, "c"), (2, "paytm.example", None, 4, 1, "d"), (3, "y.example", "http://y.example", 9, 1, "c")], "id long, domain string, url string, points int, first_seen int, campaign string")
    assert [r["id"] for r in R.search(assets, text="PayTM").collect()] == [1, 2]
    assert [r["id"] for r in R.search(assets, text="paytm", campaign="d").collect()] == [2]
    assert [r["id"] for r in R.search(assets.drop("url"), text="paytm").collect()] == [2]
