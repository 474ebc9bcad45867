"""What made queries grow beyond their input: rules repeated in filters, sides of joins that went to the driver."""

import importlib

from sentrylake.functions import urls as U
from sentrylake.plans import base as B


def _plan(spark, query):
    return importlib.import_module("__spark_entry__").queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def _longest_filter(plan):
    return max((len(line) for line in plan.splitlines() if "Filter " in line), default=0)


def test_branded_is_lexical(spark):
    rows = [(i, u.replace("{n}", str(n))) for n in (7, 42) for i, u in enumerate(B.URLS)] + [(98, None), (99, ""), (100, "http://evil.tk/a?b=www.sbi.co.in&c=x@paytm.com")]
    df = spark.createDataFrame(rows, "id int, url string")
    want = U.lexical(df).select("id", "url", "host", "brand").collect()
    assert sorted(U.branded(df).collect(), key=repr) == sorted((r for r in want if r["brand"]), key=repr)


def test_rules_of_feed_urls_are_not_repeated_in_filters(spark):
    assert _longest_filter(_plan(spark, "feed_brand_urls")) < 3000


def test_rules_of_lookalikes_are_not_repeated_in_filters(spark):
    assert _longest_filter(_plan(spark, "ct_lookalikes")) < 3000


def test_looks_of_hosts_are_not_repeated_in_filters(spark):
    assert _longest_filter(_plan(spark, "url_typosquat_table")) < 600


def test_campaigns_by_batch_send_no_side_of_a_join(spark):
    """Ids, labels and heads went to the driver and to all tasks for as long as their files were small."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    importlib.import_module("__spark_entry__").queries()["campaign_summary_by_batch"](spark, "/root/testdata/sf0.001").collect()
    bus.waitUntilEmpty()
    made = store.executionsList(before, 10_000)
    plans = [made.apply(i).physicalPlanDescription() for i in range(made.size())]
    assert len(plans) > 10 and not any("BroadcastExchange" in p for p in plans)
