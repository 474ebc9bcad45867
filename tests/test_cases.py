"""Cases with their targets, against a brute-force version."""

import random
import re

from sentrylake.operators import casework as K


def test_opened_makes_targets_last(spark, monkeypatch):
    """Blocks of cases meet blocks of targets; ids that repeat, wanted targets and unknown campaigns are as before. The many rows
    of whole cases were shuffled to find them distinct, and made in one task for each campaign."""
    monkeypatch.setattr(K, "BLOCK", 4)
    rng = random.Random(3)
    whole = sorted({(f"c{rng.randrange(3)}", rng.choice(["bank", "npci"]), f"t{rng.randrange(40)}") for _ in range(150)})
    requests = [(i, f"c{rng.randrange(4)}", rng.choice(["bank", "npci"]), None, rng.choice([None, [], ["t1"], ["t2", "t3", "none"], ["nowhere"]])) for i in range(60)]
    requests += [(7, "c1", "bank", None, None), (7, "c1", "bank", None, None), (7, "c1", "npci", None, None), (8, "c2", "npci", None, ["t5"]), (9, None, "npci", None, None)]
    want, hit = set(), {i for i, c, r, _, w in requests for t in w or [] if (c, r, t) in set(whole)}
    for i, c, r, _, w in requests:
        mine = {t for a, b, t in whole if (a, b) == (c, r)}
        want |= {(i, t) for t in (mine if not w else mine & set(w) if i in hit else w)}
    a = spark.createDataFrame(requests, "case_id long, campaign string, recipient string, contact string, wanted array<string>")
    b = spark.createDataFrame(whole, "campaign string, recipient string, target string")
    items = spark.createDataFrame([], "campaign string, recipient string, name string, contacts array<string>, target string")
    cases, targets = K.opened(a, b, items)
    got = sorted(map(tuple, targets.collect()))
    assert got == sorted(want) and cases.count() == len(requests)
    # what is made last isn't exchanged: no distinct lies above the union of both kinds of cases
    assert targets._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def _case_rows(spark, campaigns):
    requests = [(i, f"c{i % campaigns}", "npci", None, None) for i in range(40)] + [(99, "c0", "npci", None, ["t1"])]
    whole = [(f"c{i % campaigns}", r, f"t{i}") for i in range(60) for r in ("npci", "bank")]
    a = spark.createDataFrame(requests, "case_id long, campaign string, recipient string, contact string, wanted array<string>")
    b = spark.createDataFrame(whole, "campaign string, recipient string, target string")
    return a, b, spark.createDataFrame([], "campaign string, recipient string, name string, contacts array<string>, target string")


def test_no_generated_loop_makes_all_rows_of_a_pair(spark):
    """Both explodes were in one generated loop, which held copies of a million rows for each pair of blocks."""
    targets = K.opened(*_case_rows(spark, 2))[1]
    got = targets.collect()
    assert len(set(got)) == len(got) == 40 * 30 + 1
    lines = targets._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].splitlines()
    made = [line for line in lines if "Generate explode" in line and "case_ids" in line or "Generate explode" in line and "targets" in line]
    loops = [re.search(r"\*\((\d+)\) Generate", line) for line in made]
    assert len(made) >= 2 and len([x for x in loops if x]) == len({x[1] for x in loops if x})


def test_targets_without_whole_cases_are_not_packed(spark, monkeypatch):
    """Targets of all recipients were packed in blocks, also where no case asks for all of them."""
    seen = []
    blocks = K._blocks
    monkeypatch.setattr(K, "_blocks", lambda *x: seen.append((x[-2], blocks(*x))) or seen[-1][1])
    requests, whole, items = _case_rows(spark, 2)
    K.opened(requests, whole, items)
    packed = next(df for column, df in seen if column == "target")
    assert {r["recipient"] for r in packed.collect()} == {"npci"}


def test_case_targets_are_distinct_before_recipients(spark):
    """URLs were repeated for five recipients before they were made distinct."""
    columns = "id long, campaign string, kind string, review string, domain string, url string"
    rows = [(i, f"c{i % 2}", k, "unreviewed", f"h{i % 3}.evil.in", f"https://h{i % 3}.evil.in/") for i in range(12) for k in ("web", "app")] + [(50, "c0", "message", "unreviewed", "x.in", "m"), (51, "c0", "web", "false_positive", "y.in", "f"), (52, None, "web", "unreviewed", "z.in", "n"), (53, "c1", "web", "unreviewed", "10.0.0.1", "http://10.0.0.1/")]
    entities = spark.createDataFrame([(0, "upi_id", "a@b"), (2, "upi_id", "a@b"), (1, "phone", "9"), (51, "upi_id", "f@b"), (0, "ip", "1.1.1.1")], "id long, type string, value string")
    out = K.case_targets(spark.createDataFrame(rows, columns), entities)
    got = sorted(map(tuple, out.collect()))
    urls = {(c, f"https://h{h}.evil.in/") for c in ("c0", "c1") for h in range(3)}
    want = {(c, r, u) for c, u in urls | {("c1", "http://10.0.0.1/")} for r in ("hosting", "bank", "cert_in", "safe_browsing", "cybercrime_portal")}
    want |= {(c, "app_store", u) for c, u in urls} | {(c, "registrar", "evil.in") for c in ("c0", "c1")} | {("c0", "npci", "a@b"), ("c1", "telecom", "9")}
    assert got == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate")
