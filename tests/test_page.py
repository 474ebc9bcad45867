"""Pages read as tokens: what patterns over characters get wrong, and hard rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentrylake.functions.page import folded, page_of, tokens
from sentrylake.operators import pages as P

EMPTY = {"forms": [], "sources": [], "icon": None, "prompts": [], "scripts": "", "title": "", "body": "", "shown": ""}


def form(action, *inputs, method="get"):
    return {"action": action, "method": method, "inputs": [{"name": n, "type": t} for n, t in inputs]}


CASES = [
    (None, {}),
    ("", {}),
    ("plain & simple", {"body": "plain & simple", "shown": "plain & simple"}),
    ('<!-- <form action="/x"><input name=a></form> -->', {}),
    ('<form action="/a>b" METHOD=POST><INPUT NAME=q TYPE=Password></form>', {"forms": [form("/a>b", ("q", "password"), method="post")]}),
    ('<form action="1"><input name=a><form action="2"><input name=b></form><input name=c>', {"forms": [form("2", ("b", "text"))]}),
    ('<form action="open"><input name=a>', {}),
    ("</form><form></form>", {"forms": [form("")]}),
    ('<form action="&amp;x"><input name="a" name="b"/></form>', {"forms": [form("&x", ("b", "text"))]}),
    ('<script>var f = "<form></form>";</script>', {"scripts": 'var f = "<form></form>";'}),
    ("a<script>never closed <p>b</p>", {"body": "a", "shown": "a"}),
    ('<script src="//x/y.js"></script><script src></script>t', {"sources": ["//x/y.js"], "body": "t", "shown": "t"}),
    ("<style>p { x: '<title>no</title>' }</style><title>A &lt;b&gt;\n &copy;&nbsp;c</title> d", {"title": "A <b> © c", "shown": "A <b> © c d", "body": "d"}),
    ('<link rel="icon" href="1"><link REL="shortcut ICON" href="2"><link rel=icon><link rel=style href=3>', {"icon": "2"}),
    ('<input placeholder="Enter &quot;OTP&quot;"><input placeholder>', {"prompts": ['Enter "OTP"']}),
    ("kept<![odd[ lost", {"body": "kept", "shown": "kept"}),
    ("a<b>c</b>d <p", {"body": "a c d", "shown": "a c d"}),
]


@pytest.mark.parametrize("html, want", CASES, ids=[str(i) for i in range(len(CASES))])
def test_parts(html, want):
    assert folded(tokens(html)) == EMPTY | want


def test_columns_hold_the_same(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "id int, html string").repartition(3)
    found = {r.id: r.p.asDict(recursive=True) for r in rows.select("id", page_of(F.col("html")).alias("p")).collect()}
    assert found == {i: EMPTY | w for i, (_, w) in enumerate(CASES)}
    assert rows.where("false").select(page_of(F.col("html")).alias("p")).count() == 0


def test_a_very_long_page(spark):
    html = "<form action='//evil.example/'><input name=otp></form>" + "<p title='>'>word</p>" * 200_000 + "<" * 1000
    got = spark.createDataFrame([(html,)], "html string").select(page_of(F.col("html")).alias("p")).select(F.size("p.forms"), F.size(F.split("p.body", " "))).first()
    assert got[0] == 1 and got[1] >= 200_000


def test_behaviour_reads_tokens_once(spark):
    html = ['<!-- <form action="https://evil.example"><input name=otp></form> --><p>hello</p>', '<form action="https://evil.example/x>y"><input name="otp"></form><script>eval(atob("eA=="))</script>', None]
    rows = spark.createDataFrame([(i, "https://shop.example/", h, "mine") for i, h in enumerate(html)], "id int, url string, html string, _own string")
    out = P.behaviour(rows)
    assert out.columns[:4] == rows.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    got = {r.id: r for r in out.collect()}
    assert [(len(got[i].fields) > 0, got[i].foreign_form, len(got[i].obfuscated) > 0) for i in range(3)] == [(False, False, False), (True, True, True), (False, False, False)]
    again = P.behaviour(rows.withColumn("read", page_of(F.col("html"))), "read").drop("read")
    assert {r.id: r for r in again.collect()} == got


def test_pages_leave_in_pieces():
    """A batch of pages was one array of objects; small pages leave by number, large ones by size, in order."""
    small, large = [f"<title>{i}</title>" for i in range(3000)], ["<p>" + "x" * 500_000 + f"</p><title>{i}</title>" for i in range(9)]
    got = list(page_of.func(iter([pa.array(small + large), pa.array([], pa.string()), pa.array([None])])))
    assert [x["title"].as_py() for p in got for x in p] == [str(i) for i in range(3000)] + [str(i) for i in range(9)] + [""]
    assert max(map(len, got)) <= 1025 and len(got) >= 7
