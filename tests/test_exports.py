"""Reports and dossiers as whole texts."""

from datetime import datetime

import pytest
from pyspark.sql import DataFrame

from sentrylake.functions import catalogue as C
from sentrylake.operators import exports as X

AT = datetime(2024, 5, 6, 7, 8)
ASSETS = "campaign string, id int, kind string, review string, url string, domain string, label string, package string, version string, sha256 string, certs array<string>, origin_url string, excerpt string, points int, first_seen timestamp, reasons string, screenshot string, verdict string, signals array<struct<name:string,points:int>>"


def text(df: DataFrame, **of) -> str:
    rows = [r for r in df.collect() if all(r[k] == v for k, v in of.items())]
    order = [c for c in ("section", "at", "nth") if c in df.columns]
    return "\n".join(r.line for r in sorted(rows, key=lambda r: tuple(r[c] for c in order)))


@pytest.fixture
def tables(spark):
    campaigns = spark.createDataFrame([("c1", "Fake banks", 4, AT, AT), ("c2", "Empty", 0, AT, AT)], "campaign string, name string, size long, first_seen timestamp, last_seen timestamp")
    web = lambda i, review, domain, shot: ("c1", i, "web", review, f"http://{domain}/a", domain, None, None, None, None, None, None, None, 90, AT, "punycode", shot, "malicious", [("x", 5), ("y", 9), ("z", 0)])
    rows = [web(1, "confirmed", "pay.example", "s1.png"), web(2, "unreviewed", "10.0.0.1", None), web(3, "false_positive", "fine.example", "s3.png")]
    rows.append(("c1", 4, "app", "unreviewed", "android://com.x", "com.x", "Pay", "com.x", None, "ab", ["k1", "k2"], "http://dl.example/a.apk", None, 70, AT, None, None, "malicious", []))
    assets = spark.createDataFrame(rows, ASSETS)
    shared = spark.createDataFrame([("c1", "ip", "10.0.0.1"), ("c1", "upi_id", "a@okaxis")], "campaign string, type string, value string")
    return campaigns, assets, shared


def test_report_of_a_store(tables):
    assert text(X.report_lines(*tables), campaign="c1", recipient="app_store").split("\n") == [
        C.INTROS["app_store"], "", "Campaign: Fake banks (4 sites, first seen 2024-05-06)", "", "Evidence linking these sites:", "  - shared ip: 10.0.0.1", "  - shared upi_id: a@okaxis", "",
        "Application context:", "  - Pay (com.x, version unknown)", "      APK SHA-256: ab", "      signing certificate SHA-256: k1", "      signing certificate SHA-256: k2", "      distributed from: http://dl.example/a.apk", "  - (none available)", "",
        "Reported URLs:", "  - http://pay.example/a  (risk 0.90, seen 2024-05-06 07:08 UTC; punycode)", "      screenshot evidence: s1.png", "  - http://10.0.0.1/a  (risk 0.90, seen 2024-05-06 07:08 UTC; punycode)", "  - Android app Pay (com.x)  (risk 0.70, seen 2024-05-06 07:08 UTC; n/a)", "",
        "Generated automatically; analyst-reviewed before sending.",
    ]


def test_reports_say_what_is_missing(tables):
    out = X.report_lines(*tables)
    of = lambda campaign, recipient: text(out, campaign=campaign, recipient=recipient).split("\n")[3:-2]
    assert of("c2", "app_store") == ["", "Evidence linking these sites:", "  - (none recorded)", "", "Application context:", "  - (no Android applications in this campaign)", "  - (none available)", "", "Reported URLs:"]
    assert of("c2", "safe_browsing")[4:6] == ["URLs to blocklist:", "  - (none available)"]
    assert of("c1", "registrar")[5:8] == ["Registrar / domain context:", "  - domain: pay.example", ""]
    assert of("c1", "telecom")[5:8] == ["Fraud phone numbers:", "  - (none available)", ""]
    assert of("c1", "npci")[5:8] == ["UPI handle context:", "  - upi_id: a@okaxis", ""]
    assert out.groupBy("campaign", "recipient").count().count() == 18


def test_dossier(spark, tables):
    campaigns, assets, shared = tables
    plan = spark.createDataFrame([("c1", "registrar", "unknown registrar", "lookup_required", [], 1), ("c1", "bank", "gpay", "email", ["a@b.example", "c@d.example"], 2)], "campaign string, recipient string, name string, channel string, contacts array<string>, targets long")
    cases = spark.createDataFrame([("c1", "k7", "bank", None, "sent", AT), ("gone", "k8", "bank", None, "sent", AT)], "campaign string, case_id string, recipient string, contact string, status string, updated_at timestamp")
    out = X.dossier_lines(campaigns, assets, shared, plan, cases)
    assert text(out, campaign="c1").split("\n") == [
        "# Fake banks", "", "- Campaign id: `c1`", "- Assets: 4 (2 sites, 1 apps, 0 messages)", "- First seen: 2024-05-06 07:08 UTC; last seen 2024-05-06 07:08 UTC", "", "## Linking evidence", "", "- ip: `10.0.0.1`", "- upi_id: `a@okaxis`", "",
        "## Assets", "", "| asset | kind | risk | verdict | review | top signals |", "|---|---|---|---|---|---|", "| `http://pay.example/a` | web | 0.90 | malicious | confirmed | y, x |", "| `http://10.0.0.1/a` | web | 0.90 | malicious | unreviewed | y, x |", "| `Pay (com.x)` | app | 0.70 | malicious | unreviewed |  |", "",
        "## Takedown plan", "", "- **registrar** via lookup_required (lookup required): Suspend the domain registrations held at unknown registrar (no RDAP abuse contact on record; run enrichment); 1 target(s)", "- **bank** via email (a@b.example, c@d.example): Notify Google Pay so it can warn customers and pursue its own takedowns; 2 target(s)", "",
        "## Takedown cases", "", "- `k7` bank -> n/a: **sent**, updated 2024-05-06 07:08 UTC",
    ]
    assert text(out, campaign="c2").split("\n")[8] == "- none" and text(out, campaign="c2").endswith("## Takedown cases\n\n- none yet")
    assert out.where("campaign = 'gone'").count() == 0
