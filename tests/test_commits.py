"""Commits and views: idempotence, repeats, malformed input, limits."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import commits, relational, views


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- views


def test_source_blocks_take_what_is_a_block(spark):
    good = {"block_id": "a", "text": "t", "kind": "table", "page": 2}
    cases = [
        (json.dumps([good]), [("a", "t", "table", 2)]),
        (json.dumps([{**good, "page": True}, {**good, "page": "2"}, {**good, "page": 2.0}, {**good, "page": 0}, {**good, "page": None}]), [("a", "t", "table", None)] * 5),
        (json.dumps([{"id": 7, "text": "x", "kind": "odd"}, {"block_id": "", "id": "b", "text": 1.5}, {"block_id": 0, "text": "x"}, {"block_id": "c", "text": False}]), [("7", "x", "paragraph", None), ("b", "1.5", "paragraph", None)]),
        ("[1, null, \"x\", []]", []),
        ("{}", []), ("not json", []), ("", []), (None, []),
    ]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", views.source_blocks(F.col("t")).alias("b"))
    got = {r["i"]: [tuple(x) for x in r["b"] or []] for r in d.collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_reports_flatten_and_default(spark):
    content = [{"title": "s", "statements": [{"text": "a", "citations": [], "citation_ids": ["x"]}, {"text": None}, "plain", "", 5]}, {"statements": []}, {"text": "b", "kind": "odd", "citations": [1]}, {"kind": "fact"}, 3]
    rev = spark.createDataFrame([(10, json.dumps(content), "[]", json.dumps({"stale": 1}))], "revision_id long, content string, coverage string, input_manifest string").withColumn("as_of", F.lit(None).cast("timestamp"))
    rep = spark.createDataFrame([(1, "r", 10), (2, "none", None), (3, "lost", 99)], "report_id long, title string, current_revision_id long")
    got = {r["report_id"]: r for r in views.report_views(rep, rev, F.timestamp_seconds(F.lit(5))).collect()}
    assert [tuple(b) for b in got[1]["blocks"]] == [("a", "fact", ["x"]), ("", "fact", []), ("plain", "fact", []), ("b", "fact", ["1"])]
    assert (got[1]["revision_id"], got[1]["stale"], got[1]["coverage_status"], got[1]["as_of"]) == (10, True, "pending", None)
    for i in (2, 3):
        assert got[i]["revision_id"] == i and got[i]["as_of"] is not None and not got[i]["blocks"] and got[i]["stale"] is False


def test_message_status_fails_on_other_outcomes(spark):
    d = spark.createDataFrame([("ok",), ("insufficient_evidence",)], "s string").select(views.message_status(F.col("s")).alias("s"))
    assert rows(d) == [("partial",), ("ready",)]
    with pytest.raises(Exception, match="unknown answer status"):
        spark.createDataFrame([("done",)], "s string").select(views.message_status(F.col("s"))).collect()


# --- extraction

CLAIMS = "run_id long, parse_id long, claim_no int, text string, kind string, attribution string"
EVIDENCE = "run_id long, claim_no int, ordinal int, block_id string, quote string, relation string"


def extraction(spark, families=()):
    claims = spark.createDataFrame([(1, 7, 0, "it costs 40%", "fact", None), (1, 7, 1, "said", "source_statement", " "), (2, 8, 0, "it costs 40", "fact", None), (2, 8, 1, "no evidence", "fact", None)], CLAIMS)
    evidence = spark.createDataFrame([(1, 0, 0, "b", "price of 40%", "supports"), (1, 1, 0, "b", "the price of", "supports"), (1, 1, 1, "c", "日本の価格は四十", "refutes"), (2, 0, 0, "b", "price of 40%", "supports")], EVIDENCE)
    blocks = spark.createDataFrame([(7, "b", "x the price of 40%"), (7, "c", "👍 日本の価格は四十"), (8, "b", "price of 40%")], "parse_id long, block_id string, text string")
    origins = spark.createDataFrame([(7, "o"), (8, "o"), (9, "p")], "parse_id long, origin_ref string")
    known = spark.createDataFrame(list(families), "family_id long, origin_ref string")
    semantic = spark.createDataFrame([(1, 0, "supports"), (1, 1, "sure")], "run_id long, claim_no int, status string")
    return commits.extraction(claims, evidence, blocks, origins, known, semantic)


def test_extraction_commits_valid_claims_once(spark):
    x = extraction(spark)
    assert rows(x.rejected) == [(2, 0, "numeric_unsupported"), (2, 1, "no_evidence")]
    assert rows(x.claims.select("run_id", "claim_no", "kind")) == [(1, 0, "fact"), (1, 1, "inference")]
    assert rows(x.evidence.select("block_id", "start", "end", "status")) == [("b", 2, 14, "uncertain"), ("b", 6, 18, "supports"), ("c", 2, 10, "uncertain")]
    assert rows(x.families.select("origin_ref", "label")) == [("o", "origin:o")]
    assert x.evidence.select("family_id").distinct().count() == 1
    again = extraction(spark, [(r["family_id"], "o") for r in x.families.collect()])
    assert again.families.count() == 0  # a repost's origin is known now
    for name in ("claim", "evidence"):
        old, new = getattr(x, "claims" if name == "claim" else name), getattr(again, "claims" if name == "claim" else name)
        assert relational.insert_or_ignore(old, new, [f"{name}_id"], [F.col(f"{name}_id")]).count() == 0


# --- event build

PROPOSAL = "run_id long, proposal_no int, event_type string, title string, summary string, identity map<string,string>, occurred string, claim_ids array<long>, candidate_id long"


def test_event_build_links_and_creates(spark):
    key = {"correction_ref": "C 1", "target_ref": "T"}
    p = spark.createDataFrame(
        [
            (1, 0, "correction", "a", "", key, "2024-03-04", [5, 6], None),
            (1, 1, "correction", "b", "", {**key, "correction_ref": " c  1 ", "hidden": "x"}, "", [5, 99], 77),
            (2, 0, "correction", "c", "", {**key, "target_ref": " "}, "2024-13-40", [8], 77),
            (2, 1, "retraction", "d", "", key, None, None, None),
            (2, 2, "other", "e", "", None, "2024", [8, 8], None),
        ]
        + [(3, n, "other", "f", "", None, None, [n], None) for n in range(40)],
        PROPOSAL,
    )
    committed = spark.createDataFrame([(1, 5), (1, 6), (2, 8), (2, 8)] + [(3, n) for n in range(40)], "run_id long, claim_id long")
    known = spark.createDataFrame([(900, "retraction|correction_ref=c 1|target_ref=t")], "event_id long, event_key string")
    b = commits.event_build(p, committed, known)
    own = b.events.filter("run_id < 3")
    assert rows(own.select("title", "event_key", "precision")) == [("a", "correction|correction_ref=c 1|target_ref=t", "day"), ("c", None, "unknown"), ("e", None, "year")]
    assert b.events.filter("run_id = 3").count() == commits.MOST_PROPOSALS
    assert rows(b.reports.filter("run_id < 3")) == [(1, 1, 1, 1), (2, 2, 1, 0)]
    assert rows(b.duplicates.select("candidate_event_id")) == [(77,)]
    links = b.links.join(own.select("event_id", "title"), "event_id")
    assert rows(links.select("title", "claim_id")) == [("a", 5), ("a", 6), ("c", 8), ("e", 8)]
    assert b.events.select("event_id").distinct().count() == b.events.count()
    assert commits.event_build(p.limit(0), committed, known).events.count() == 0


def test_routes_write_changes_only(spark):
    d = spark.createDataFrame([(1, 1, 1, "direct", 0.5), (1, 1, 2, "background", 0.5), (1, 2, 1, "odd", 0.1), (2, 1, 1, None, None)], "parse_id long, topic_id long, seq int, decision string, confidence double")
    stored = spark.createDataFrame([(1, 1, "background", 0.5, 3), (1, 2, "direct", 0.1, 8)], "parse_id long, topic_id long, decision string, confidence double, row_version int")
    assert rows(commits.route_rows(d, stored)) == [(1, 2, "uncertain", 0.1, 9), (2, 1, "uncertain", None, 1)]


def test_coverage_and_evidence_order(spark):
    b = spark.createDataFrame([(1, "a", "x"), (1, "b", " "), (1, "c", "y"), (2, "a", "z")], "parse_id long, block_id string, text string")
    c = spark.createDataFrame([(1, ["a", "q"]), (2, [])], "parse_id long, block_ids array<string>")
    assert rows(views.uncovered_blocks(b, c)) == [(1, "c"), (2, "a")]
    claims = spark.createDataFrame([(1, 10), (2, None)], "claim_id long, current_revision_id long")
    e = spark.createDataFrame([(10, 5, 2), (10, 3, 2), (10, 9, 1), (11, 1, 0)], "claim_revision_id long, evidence_id long, created_at long")
    assert rows(views.evidence_of(claims, e).select("claim_id", "evidence_id", "nth")) == [(1, 3, 2), (1, 5, 3), (1, 9, 1)]
