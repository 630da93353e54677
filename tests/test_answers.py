import pytest
from pyspark.sql import functions as F

from quarry.operators import claims, disclosure
from quarry.plans import business, root_cause


def test_claims(spark):
    said = {
        1: "'X' has a total net order value of EUR 3.50 across 2 order(s).",
        2: "'X' has a total net order value of EUR 9.99 across 2 order(s).",
        3: "'X' is one resolved entity spanning 1 customer record(s) and 1 address record(s).",
        4: "Refused to sum across EUR and USD: totals stay apart by currency.",
        5: "\"boom now\" appears in 'a.log' and 'b.log'",
        6: "\"boom now\" appears in 'a.log' and 'c.log'",
        7: "The clauses disagree on the renewal date: '1 May' and '2 June'",
        8: "plain words",
        9: "words nobody wrote",
        10: "uncited",
    }
    rows = [(1, "i1", "s", "item", "row", "EUR", "1.25"), (1, "i2", "s", "item", "row", "EUR", "2.25"), (2, "i1", "s", "item", "row", "EUR", "1.25")]
    rows += [(3, "c", "s", "Customer", "c", None, None), (3, "a", "s", "Address", "a", None, None), (4, "i1", "s", "item", "row", "EUR", "1"), (4, "i2", "s", "item", "row", "USD", "1")]
    rows += [(k, x, f"{x}.log", "document", f"it went Boom, NOW in {x}", None, None) for k in (5, 6) for x in "ab"]
    rows += [(7, "d1", "m", "document", "It renews every year on 1 May", None, None), (7, "d2", "n", "document", "renews\non 2 June", None, None), (8, "e", "m", "document", "Some PLAIN-words here", None, None), (9, "e", "m", "document", "other", None, None)]
    support = spark.createDataFrame(rows, "claim_id long, id string, source string, kind string, text string, currency string, amount string")
    out = {r["claim_id"]: r["supported"] for r in claims.verify(spark.createDataFrame(list(said.items()), "claim_id long, text string"), support, claims.shapes("Customer", "Address")).collect()}
    assert out == {1: True, 2: False, 3: True, 4: True, 5: True, 6: False, 7: True, 8: True, 9: False, 10: False}


def test_root_cause(spark):
    runs = spark.createDataFrame([("R-1001", "failed", "2024-01-01", "run one"), ("R-1002", "failed", "2024-01-02", "run two"), ("R-1003", "passed", "2024-01-03", "run three")], "run string, status string, started string, text string")
    chunks = spark.createDataFrame([("R-1001", "run_1:chunk1", "ERROR pay: Timeout in db"), ("R-1002", "run_2:chunk1", "##[error]Process completed with exit code 1."), ("R-1002", "run_2:chunk2", "ERROR pay: Timeout in db\nERROR job x failed")], "run string, id string, text string")
    tickets = spark.createDataFrame([("T-1", "seen: Timeout in db")], "id string, text string")
    fixes = spark.createDataFrame([("PR-1", "T-1", "fixes it")], "pr string, ticket string, text string")
    out = root_cause.explain(runs, chunks, tickets, fixes).filter("run = 'R-1002'").orderBy("ord").collect()
    assert [r["kind"] for r in out] == ["outcome", "log", "log", "recurrence", "incident", "ticket", "fix"]
    assert out[3]["text"] == "\"Timeout in db\" appears in 'run_2:chunk2' and 'run_1:chunk1'" and out[3]["support"] == ["run_2:chunk2", "run_1:chunk1"]
    asked = spark.createDataFrame([(1, "why did R-1002 fail?"), (2, "why did R-1003 fail?"), (3, "why did R-9999 fail?"), (4, "why?")], "qid long, question string")
    assert [r["refusal"] for r in root_cause.refusals(asked, runs).orderBy("qid").collect()] == [None, "the run did not fail", "the run is unknown", "no run is named"]
    kinds = asked.union(spark.createDataFrame([(5, "what does PR-123 change"), (6, "who owns the payments service")], "qid long, question string")).select("qid", root_cause.route(F.col("question"), F.array(), F.array(F.lit("Payments Service"))).alias("k"))
    assert [r["k"] for r in kinds.orderBy("qid").collect()] == ["rca", "rca", "rca", "lookup", "summary", "service"]


def test_business(spark):
    names = spark.createDataFrame([("e1", "Bittern Works GmbH"), ("e1", "Bittern Works"), ("e2", "Plover Holdings"), ("e3", "Curlew North"), ("e4", "Curlew South")], "entity string, name string")
    asked = spark.createDataFrame([(1, "What do we know about Bittern Works?"), (2, "Compare Bittern Works and Plover Holdings"), (3, "Who is largest in EUR?"), (4, "zebra"), (5, "what about curlew")], "qid long, question string")
    status = {r["qid"]: (r["status"], r["entity"]) for r in business.resolve(asked, names).collect()}
    assert status[1] == ("ok", "e1") and status[4] == ("none", None) and status[5] == ("ambiguous", None)
    assert {r["qid"]: r["kind"] for r in business.route(asked, names).collect()} == {1: "entity", 2: "multi", 3: "multi", 4: "lookup", 5: "lookup"}  # the tie takes too little of question 5
    sales = spark.createDataFrame([("e1", "s1", "EUR", "1.00"), ("e1", "s2", "EUR", "2.50"), ("e1", "s3", "USD", "7")], "entity string, id string, currency string, amount string")
    clauses = spark.createDataFrame([("e1", "d1", "m", "It renews on 1 May")], "entity string, id string, source string, text string")
    out = business.compose(business.resolve(asked.filter("qid = 1"), names), names, sales, clauses).orderBy("step", "text").collect()
    assert [r["step"] for r in out] == [2, 2, 3, 4]
    assert out[0]["text"] == "Net order value in EUR across 2 order(s): EUR 3.50." and out[0]["support"] == ["s1", "s2"]


def test_redaction_and_policy(spark):
    nodes = spark.createDataFrame([(x, f"text {x}") for x in "abcd"], "id string, text string")
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r")], "src string, dst string, relation string")
    out = {r["id"]: r for r in disclosure.redact(nodes, edges, spark.createDataFrame([("a",)], "id string"), 1).collect()}
    assert [out[x]["withheld"] for x in "abcd"] == [False, False, True, True] and out["c"]["text"] is None and out["c"]["digest"].startswith("sha256:")
    reports = spark.createDataFrame([(1, "k", "RE-DERIVED", 0, ["docs/a.md"], 1), (2, None, "INTEGRITY-ONLY", 2, ["x"], 9)], "bundle_id long, signer string, status string, unverified int, sources array<string>, withheld int")
    policy = {"require_signed": True, "require_rederived": True, "forbid_unverified_claims": True, "allowed_evidence_sources": ["docs/*"], "redaction": {"max_withheld": 3}}
    out = {r["bundle_id"]: r["breaches"] for r in disclosure.judge(reports, policy).collect()}
    assert out[1] == [] and len(out[2]) == 5
    with pytest.raises(ValueError):
        disclosure.judge(reports, {"nonsense": 1})
    with pytest.raises(ValueError):
        disclosure.judge(reports, {"redaction": {"nonsense": 1}})
    full = reports.select("*", F.when(F.col("bundle_id") == 2, "incident").alias("action"), F.lit(False).alias("gated"), (F.col("bundle_id") == 2).alias("sent"), F.col("bundle_id").alias("depth"), F.array(F.lit("k"), F.col("signer")).alias("upstream_signers"), F.array(F.lit("ada"), F.lit("ada")).alias("approvers"), F.lit(True).alias("in_ledger"))
    policy = {"actions": {"allow": ["pr_summary"], "require_approval_gate": True, "forbid_real_send": True}, "chain": {"max_depth": 1, "require_signed_upstreams": True, "allowed_upstream_signers": ["k"]}, "approvals": {"require": 2, "allowed_approvers": ["ada"], "distinct_approvers": 2}, "redaction": {"allow": False}, "ledger": {"require_inclusion": True}}
    out = {r["bundle_id"]: r["breaches"] for r in disclosure.judge(full, policy).collect()}
    assert out[1] == ["too few approvers", "redaction not allowed"]
    assert out[2] == ["action not allowed", "action without an approval gate", "action really sent", "chain too deep", "unsigned upstream", "upstream signer not allowed", "too few approvers", "redaction not allowed"]
