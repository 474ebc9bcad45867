"""Batches with bad rows, and landed certificate logs read by ranges and terms."""

import json

import pytest
from pyspark.sql import functions as F

from sentrylake.operators.checked import Rule, checked, url_batch
from sentrylake.sources import certlog


def test_bad_rows_are_put_aside(spark):
    rows = spark.createDataFrame([(1, "7", None), (2, "x", "a"), (3, None, "b"), (4, "-1", None), (5, "x", None)], "id int, failed string, class string")
    number = F.col("failed").try_cast("int") if hasattr(F.col("failed"), "try_cast") else F.expr("try_cast(failed AS int)")
    out = checked(rows, "parse", F.col("id"), [Rule("missing", F.col("failed").isNull()), Rule("no_number", number.isNull()), Rule("negative", number < 0, routine=False)])
    assert out.counts == {"processed": 5, "failed": 4, "missing": 1, "no_number": 2, "negative": 1}
    assert out.good.columns == rows.columns and list(map(tuple, out.good.collect())) == [(1, "7", None)]
    assert sorted(map(tuple, out.bad.collect())) == [("parse", "missing", "3", True), ("parse", "negative", "4", False), ("parse", "no_number", "2", True), ("parse", "no_number", "5", True)]


def test_no_rows_and_clashing_rules(spark):
    rows = spark.createDataFrame([], "id int")
    out = checked(rows, "none", F.col("id"), [Rule("any", F.lit(True))])
    assert out.counts == {"processed": 0, "failed": 0, "any": 0} and out.good.count() == out.bad.count() == 0
    with pytest.raises(ValueError):
        checked(rows, "none", F.col("id"), [Rule("failed", F.lit(True))])


def test_url_batch(spark):
    urls = ["https://a.example/x", " https://a.example/x", "a.example", "", None, "ftp://a.example", "mailto:a@b.example", "/path", "http://localhost/", "http://a.example/" + "x" * 2100, "Hello, how are you?"]
    out = url_batch(spark.createDataFrame(list(enumerate(urls)), "nth int, url string"))
    assert sorted(map(tuple, out.good.select("nth", "url").collect())) == [(0, "https://a.example/x"), (2, "a.example")]
    assert sorted((r["class"], r["key"] or "") for r in out.bad.collect() if r["class"] != "too_long") == [("empty", ""), ("empty", ""), ("no_host", "/path"), ("no_host", "Hello, how are you?"), ("no_host", "http://localhost/"), ("other_scheme", "ftp://a.example"), ("other_scheme", "mailto:a@b.example")]
    assert out.counts["processed"] == 10 and out.counts["too_long"] == 1


LINES = [
    json.dumps([{"id": 1, "name_value": "*.a.top\nA.top.\nPay Ltd", "common_name": "é.top"}, {"id": 2, "name_value": None, "common_name": "b.top"}, 7, {"name_value": "c.top"}]),
    "not json",
    '{"id": 1}',
    "",
    json.dumps([{"id": 1, "common_name": "d.top"}]),
    "[" * 100_000,
]


@pytest.mark.parametrize("size", [1, 7, 64, certlog.RANGE])
def test_ranges_give_each_line_once(spark, tmp_path, size):
    (tmp_path / "term=top").mkdir()
    (tmp_path / "term=a%20b").mkdir()
    (tmp_path / "term=top" / "x.txt").write_text("\n".join(LINES[: 5 if size == 1 else 6]), encoding="utf-8")
    (tmp_path / "term=a%20b" / "y.txt").write_text(LINES[4] + "\n")
    (tmp_path / "term=top" / "_SUCCESS").write_text("junk")
    reader = certlog.Reader(f"file://{tmp_path}", size)
    got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    want = [r for line in LINES[: 5 if size == 1 else 6] if line for r in certlog.rows_of("top", line)] + certlog.rows_of("a b", LINES[4])
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_source_and_pushed_term(spark, tmp_path):
    for term in ("top", "net"):
        (tmp_path / f"term={term}").mkdir()
        (tmp_path / f"term={term}" / "x.txt").write_text("\n".join(LINES), encoding="utf-8")
    log = certlog.read_log(spark, f"file://{tmp_path}", 50_000)
    assert {(r["certificate"], tuple(r["hosts"])) for r in certlog.hosts_by_certificate(log).collect()} == {("1", ("a.top", "d.top")), ("2", ("b.top",))}
    one = log.where("term = 'top' AND bad IS NOT NULL")
    assert sorted(r["bad"] for r in one.collect()) == ["not_a_list", "not_json", "not_json"] and {r["term"] for r in one.collect()} == {"top"}
    plan = one._jdf.queryExecution().executedPlan().toString()  # the term is left to the source, whose ranges are one folder's
    assert "isnotnull(bad" in plan and "= top" not in plan and one._jdf.queryExecution().executedPlan().execute().getNumPartitions() == 3
    assert certlog.read_log(spark, f"file://{tmp_path}/none").count() == 0 and log.where("term IN ('x')").count() == 0
