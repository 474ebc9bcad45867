"""Archives by an exact round trip, the merged index against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from sentrylake.llm import warc
from sentrylake.llm.queries import ORACLES, op12_loser_tree_warc
from sentrylake.work import new_path
from tests.compare import assert_same, views
from tests.llm.brute import SF, SF2

SCHEMA = "page_id long, url string, html string, at timestamp, record string, length int"


@pytest.mark.parametrize("sf", [SF, SF2])
def test_query(spark, sf):
    assert_same(op12_loser_tree_warc(spark, sf), views(sf), ORACLES["op12_loser_tree_warc"])


def test_losers():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16, 50):
        runs = [sorted((rng.randrange(40), rng.random()) for _ in range(rng.randrange(30))) for _ in range(k)]
        assert [runs[r][i] for r, i in warc.losers(runs)] == sorted(x for run in runs for x in run)


def test_records():
    made = [warc.record("7", "http://a.example/x y\r\nz", "2020-01-01T00:00:00.000000Z", warc.base32_sha1(b), len(b), b, None) for b in (b"", b"\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n", "ж\0".encode(), b"\xff\xfe")]
    data = b"".join(x + b"\r\n\r\n" for x in made)
    found = list(warc.records(data))
    assert [data[o : o + n - 4] for o, n, *_ in found] == made
    assert found[0][2]["WARC-Target-URI"] == "http://a.example/x%20y%0D%0Az"
    assert [block.split(b"\r\n\r\n", 1)[1] for *_, block in found] == [b"", b"\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n", "ж\0".encode(), b"\xff\xfe"]
    with pytest.raises(ValueError):
        list(warc.records(data[:-9]))


def test_url_key():
    assert warc.url_key("HTTPS://user@www.Example.co.uk:8080/A?b#c") == "uk:8080,co,example)/a?b"
    assert warc.url_key(None) == warc.url_key("") == ")" and warc.url_key("x.example") == "example,x)"


def _plain(rows, least=0):
    """record: (type, refers_to) of rows (id, payload)."""
    out = []
    for i, body in rows:
        body = body or ""
        same = [j for j, b in rows if (b or "") == body]
        first = min((j for j in same if j is not None), default=None)
        revisit = len(same) > 1 and len(body.encode()) >= least and i != first
        out.append((i, len(body.encode()), warc.base32_sha1(body.encode()), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 3])
def test_hard_rows(spark, least):
    bodies = [None, "", "", "same", "same", "same", "dé", "dé", "l" * 3_000_000, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "same"]
    ids = [4, 9, None, 8, 3, 3, None, None, 20, 21, None]
    rows = [(i, None if k % 3 == 0 else f"http://u{k % 2}.example/", b, None, "x", 1) for k, (i, b) in enumerate(zip(ids, bodies, strict=True))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    path, runs = warc.archived(df, F.col("at"), least=least)
    got = warc.merged(runs).collect()
    number = lambda x: None if x is None else int(x)
    assert sorted(((number(r["record"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in got), key=repr) == _plain(list(zip(ids, bodies, strict=True)), least)
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    whole = {r["file"]: b"" for r in got} | {p.rpartition("/")[2]: bytes(c) for p, c in ((r["path"], r["content"]) for r in spark.read.format("binaryFile").load(path).collect())}
    for r in got:  # a record can be fetched by its entry alone
        (_, n, head, block), *more = warc.records(whole[r["file"]][r["offset"] : r["offset"] + r["length"]])
        assert not more and head["WARC-Type"] == r["record_type"]
    empty, runs = warc.archived(df.limit(0), F.col("at"), least=least)
    assert warc.merged(runs).collect() == []


def test_histories(spark, monkeypatch):
    """One URL has most captures, and is cut by its times; archives are small, so there are many."""
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    rng = random.Random(5)
    rows = [(k, "http://hot.example/" if rng.random() < 0.6 else f"http://s{rng.randrange(90)}.example/{rng.randrange(3)}", f"<p>{rng.randrange(40)}</p>", rng.randrange(500)) for k in range(6000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, at long").repartition(23)
    _, runs = warc.archived(df, F.timestamp_seconds("at"))
    assert runs.select(F.shiftright("place", 33)).distinct().count() > 3
    got = sorted(warc.merged(runs).collect(), key=lambda r: r["position"])
    want = sorted(rows, key=lambda r: (warc.url_key(r[1]), r[3], str(r[0])))
    assert [int(r["record"]) for r in got] == [r[0] for r in want]
    seen = {}
    for r in got:
        seen[r["url_key"]] = seen.get(r["url_key"], 0) + 1
        assert r["nth"] == seen[r["url_key"]]


def test_a_payload_that_changed(spark):
    path = new_path(spark, "archives")
    warc.write_archives(spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string"), path, F.lit(None).cast("timestamp"))
    text = spark.read.text(path, wholetext=True).select(F.replace("value", F.lit("body"), F.lit("bodY")).alias("value"))
    other = new_path(spark, "archives")
    text.write.option("lineSep", "\n").text(other)
    with pytest.raises(Exception, match="isn't what its record states|no whole record"):
        warc.read_archives(spark, other).collect()
