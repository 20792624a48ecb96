"""Stored indexes and scoped recall against plain computations."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import recall as rc
from paperloom.operators import retrieval
from paperloom.operators.text_index import GramIndex, TermIndex, gram_sizes
from paperloom.operators.vector_index import VectorIndex, gate_report

VECTORS = "vec_id long, embedding array<float>"


def vectors(spark, n=1500, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 16))
    v = (centres[r.integers(0, 12, n)] + 0.4 * r.normal(size=(n, 16))).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    hot = [(n + i, v[3].tolist()) for i in range(n // 2)]  # a third of all rows are one vector
    return spark.createDataFrame([*rows, *hot, (90_001, None), (90_002, [0.0] * 16), (None, v[5].tolist()), (7, v[8].tolist())], VECTORS)


def test_vector_index_recalls_and_covers(spark):
    v = vectors(spark)
    index = VectorIndex.build(v, cells=24)
    asked = v.filter("vec_id % 50 = 0")
    assert index.calibrate(asked, 10) >= 0.98
    report = gate_report(index.recall(asked, 10)).first()
    assert report["passes"] and report["queries"] == asked.count()
    every = index.search(asked, 10, probes=24).collect()
    exact = retrieval.nearest_each(v, asked, 10).collect()
    assert {(r["query_id"], r["rank"], r["distance"]) for r in every} == {(r["query_id"], r["rank"], r["distance"]) for r in exact}
    stored = spark.read.parquet(index.path).selectExpr("sum(length(ids) / 8) as n").first()["n"]
    assert stored == v.count() - 2  # all but the missing and the directionless vector


def test_vector_index_reads_only_probed_lists(spark):
    v = vectors(spark)
    index = VectorIndex.build(v, cells=24)
    few = v.filter("vec_id = 11")
    assert index.search(few, 5, probes=1).count() == 5
    plan = index.search(few, 5, probes=1)._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*cell", plan)


def test_vector_gate_falls_back_to_the_exact_search(spark):
    v = vectors(spark, 300)
    index = VectorIndex.build(v, cells=8)
    asked = v.filter("vec_id % 50 = 0")
    assert index.choose(asked, 3, gate=1.1).count() == 3 * asked.count()
    empty = VectorIndex.build(v.limit(0))
    assert empty.search(asked, 3).count() == 0 and empty.search(v.limit(0), 3).count() == 0
    assert gate_report(empty.recall(v.limit(0), 3)).first()["passes"]


DOCS = [(i, f"common word{i % 9} word{i % 31} " + "filler " * (i % 13) + ("rare rare " if i % 97 == 0 else "")) for i in range(600)] + [(1000, None), (1001, ""), (None, "rare word1"), (1002, "Rare RARE 中文abc +x a-b:c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.mark.parametrize("terms", [["rare", "word3"], ["common", "Common ", ""], ["中文abc"], ["nowhere"], ["a-b:c", "rare"]])
def test_postings_score_as_the_scan(spark, docs, terms):
    index = TermIndex.build(docs, block=64)
    for every in (False, True):
        got = {(r["id"], round(r["score"], 9)) for r in index.scores(terms, require_all=every).collect()}
        assert got == {(r["id"], round(r["score"], 9)) for r in retrieval.bm25(docs, terms, require_all=every).collect()}


def test_blocks_below_the_threshold_are_skipped(spark, docs):
    index = TermIndex.build(docs, block=16)
    asked = ["rare", "common"]
    kept, held = index.surviving(asked, 3).select("block").distinct().count(), index.lists.read(asked).select("block").distinct().count()
    assert kept < held / 2
    best = [(r["id"], round(r["score"], 9)) for r in index.best(asked, 5).collect()]
    want = sorted(((r["id"], round(r["score"], 9)) for r in retrieval.bm25(docs, asked).collect()), key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:5]
    assert best == want
    plan = index.best(asked, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "text" not in re.findall(r"ReadSchema: (.*)", plan)[0]
    assert TermIndex.build(docs.limit(0)).best(["rare"], 5).count() == 0


@pytest.mark.parametrize("threshold", [0.1, 0.4, 0.9])
def test_gram_lists_equal_similarity(spark, docs, threshold):
    index = GramIndex.build(docs)
    aliases = ["common word3", "Rare", "??", "WORD12 filler common"]
    got = {(r["alias_no"], r["id"], round(r["score"], 9)) for r in index.hits(aliases, threshold).collect()}
    want = set()
    for no, alias in enumerate(aliases):
        q = set(gram_sizes(alias.lower())[1])
        for i, t in DOCS:
            g = set(gram_sizes((t or "").lower())[1])
            if q and g and len(q & g) / len(q | g) >= threshold:
                want.add((no, i, round(len(q & g) / len(q | g), 9)))
    assert got == want


def scope(spark, docs):
    own = docs.filter("doc_id is not null")
    chunks = own.selectExpr("case when doc_id % 10 = 0 then 'other' else 'me' end as owner_id", "doc_id as chunk_id", "doc_id div 2 as parse_id")
    parses = chunks.selectExpr("owner_id", "parse_id", "parse_id as capture_id").distinct()
    captures = parses.selectExpr("owner_id", "capture_id", "capture_id as document_id")
    documents = captures.selectExpr("owner_id", "document_id", "case when document_id % 3 = 0 then 'b' else 'a' end as industry_id", "document_id % 7 <> 0 as active").distinct()
    return rc.scope_chain(chunks, parses, captures, documents, "me", "a")


def test_channels_stay_in_scope(spark, docs):
    chain = scope(spark, docs)
    inside = {r["chunk_id"] for r in chain.collect()}
    assert inside and all(i % 10 and (i // 2) % 3 and (i // 2) % 7 for i in inside)
    terms, grams = TermIndex.build(docs), GramIndex.build(docs)
    bm = rc.bm25_hits(terms, chain, ["rare", "word3"], 10).collect()
    every = sorted(((-round(r["score"], 9), r["id"]) for r in retrieval.bm25(docs, ["rare", "word3"]).collect() if r["id"] in inside))
    assert [r["chunk_id"] for r in sorted(bm, key=lambda r: r["rank0"])] == [i for _, i in every[:10]]  # the limit counts the scope's hits only
    alias = rc.alias_hits(grams, chain, ["rare", "word3"], 0.1, 4).orderBy("rank0").collect()
    assert [r["reason"] for r in alias] == ["alias: rare"] * 4 + ["alias: word3"] * 4
    links = spark.createDataFrame([("t", 1, 1, 5), ("t", 1, 1, 9), ("t", 4, 4, 7), ("t", 3, 3, 99), ("u", 2, 2, 1)], "topic_id string, document_id long, parse_id long, updated_at long")
    near = rc.proximity_hits(links, chain, "t", 10).orderBy("rank0").collect()
    assert [(r["document_id"], r["chunk_id"], r["score"]) for r in near] == [(1, None, 1.0), (4, None, 1.0)]


def test_recall_pages_and_records(spark, docs):
    chain = scope(spark, docs)
    terms = TermIndex.build(docs)
    links = chain.selectExpr("'t' as topic_id", "document_id", "parse_id", "document_id as updated_at")
    channels = {rc.SEMANTIC: None, rc.BM25: rc.bm25_hits(terms, chain, ["common"], 30), rc.PROXIMITY: rc.proximity_hits(links, chain, "t", 20)}
    first = rc.recall(channels, 0, None, 15)
    assert first.manifest == {"channels": [rc.BM25, rc.PROXIMITY], "skipped": {rc.SEMANTIC: rc.NO_VECTOR}, "cursor": {"offset": 15}}
    second = rc.recall(channels, 15, first.rows, 15)
    one, two = ([(r["document_id"], r["position"]) for r in p.rows.orderBy("position").collect()] for p in (first, second))
    assert [p for _, p in one] == list(range(1, 16)) and not {d for d, _ in one} & {d for d, _ in two}
    scores = {r["document_id"]: 0.0 for r in first.hits.collect()}
    for r in first.hits.collect():
        scores[r["document_id"]] += 1 / (60 + r["rank0"])
    assert [d for d, _ in one] == [d for d, _ in sorted(scores.items(), key=lambda x: (-round(x[1], 12), x[0]))[:15]]
    none = spark.createDataFrame([], "job_id long, parse_id long, chunk_id long")
    recorded = rc.new_hits(none, first.hits, 4)
    assert recorded.count() == first.hits.select("parse_id", "chunk_id").distinct().count()
    again = rc.new_hits(recorded, first.hits, 4).collect()
    assert again and all(r["chunk_id"] is None for r in again)  # only chunkless hits don't conflict
    assert rc.new_hits(recorded, first.hits, 5).count() == recorded.count()
    with pytest.raises(ValueError):
        rc.recall({rc.SEMANTIC: None})


def test_semantic_channel_limits_after_the_scope(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0] if i % 5 else None) for i in range(40)], "chunk_id long, embedding array<float>")
    chain = spark.createDataFrame([(i, i, i) for i in range(20, 40)], "chunk_id long, parse_id long, document_id long")
    hits = rc.semantic_hits(v, chain, v.filter("chunk_id = 21"), 4).orderBy("rank0").collect()
    cos = lambda a, b: (a * b + 1) / math.sqrt((a * a + 1) * (b * b + 1))
    want = sorted((i for i in range(20, 40) if i % 5), key=lambda i: (-round(cos(i, 21), 9), i))[:4]
    assert [r["chunk_id"] for r in hits] == want
