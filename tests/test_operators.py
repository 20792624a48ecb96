import pytest
from pyspark.sql import functions as F

from paperloom.operators import documents, knowledge, queue, relational, retrieval
from paperloom.sources import html, readers
from paperloom.streaming import streams
from paperloom.tables import Scope, scoped


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_scope_fails_closed(spark):
    df = spark.createDataFrame([("o", 1), ("p", 2)], "owner_id string, x int")
    assert rows(scoped(df, Scope("o"))) == [("o", 1)]
    for bad in (None, Scope("")):
        with pytest.raises(PermissionError):
            scoped(df, bad)
    with pytest.raises(PermissionError):
        scoped(df.drop("owner_id"), Scope("o"))


def test_insert_or_ignore_keeps_null_keys(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2), (None, 4), (None, 4)], "k string, v int")
    got = [tuple(r) for r in relational.insert_or_ignore(old, new, ["k"], [F.col("v")]).collect()]
    assert sorted(got, key=str) == [("b", 2), (None, 4), (None, 4)] or sorted(got, key=str) == sorted([("b", 2), (None, 4), (None, 4)], key=str)


def test_upsert_and_versions(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 3)], "k int, v string, row_version long")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(relational.upsert(old, new, ["k"], ["v"])) == [(1, "a", 1), (2, "c", 4), (3, "d", 1)]
    commands = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, expected_version long")
    applied, conflicts = relational.versioned_update(old, commands, "k", "v")
    assert rows(applied) == [(1, "x", 2)] and rows(conflicts) == [(2, 3, 1)]


def test_pages_walk_the_whole_order(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i // 3) for i in range(20)], "id int, k int")
    order, seen, after = [("k", True), ("id", True)], [], None
    while True:
        page = sorted(((r["k"], r["id"]) for r in relational.page_after(df, order, after, 6).collect()), key=lambda x: (x[0] is None, x))
        if not page:
            break
        seen += page
        after = page[-1]
    assert len(seen) == 20 and len(set(seen)) == 20
    assert seen == sorted(seen, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def test_fusion_never_drops(spark):
    hits = spark.createDataFrame([("a", "x", 0), ("a", "y", 3), ("b", "x", 1), ("a", "x", 5)], "id string, channel string, rank0 int")
    got = {r["id"]: (r["score"], r["provenance"]) for r in retrieval.fuse(hits).collect()}
    assert got["a"][0] == pytest.approx(1 / 60 + 1 / 63 + 1 / 65) and got["a"][1] == "x:0,x:5,y:3"
    assert set(got) == {"a", "b"}
    empty = spark.createDataFrame([], "id long")
    assert retrieval.recall_at_k(empty, empty).first()["recall"] == 1.0


def test_claim_codes(spark):
    blocks = spark.createDataFrame([("b1", "Output rose 40% to 12 nm in May. In May."), ("b2", "twice a thing, twice a thing")], "block_id string, text string")
    claims = spark.createDataFrame([(i, t, "source_statement", a) for i, t, a in [(1, "rose 40%", None), (2, "x", "s"), (3, "x", "s"), (4, "x", "s"), (5, "rose 41%", "s"), (6, "x", "s"), (7, "x", "s")]], "claim_id int, text string, kind string, attribution string")
    evidence = spark.createDataFrame([(1, 0, "b1", "Output rose 40% to"), (2, 0, "b9", "whatever it is"), (3, 0, "b1", "short"), (4, 0, "b2", "twice a thing"), (5, 0, "b1", "Output rose 40% to"), (6, 0, "b1", "Output fell 40%")], "claim_id int, ordinal int, block_id string, quote string")
    assert rows(knowledge.validate_claims(claims, evidence, blocks)) == [
        (1, None, "inference"), (2, "block_missing", "source_statement"), (3, "quote_too_short", "source_statement"), (4, "quote_ambiguous", "source_statement"),
        (5, "numeric_unsupported", "source_statement"), (6, "quote_not_found", "source_statement"), (7, "no_evidence", "source_statement"),
    ]


def test_edges_and_cycles(spark):
    e = spark.createDataFrame([(1, "a", "a", "extends", "x", 1), (2, "a", "b", "parallel", "explicit", 0), (3, "b", "a", "parallel", "explicit", 0), (4, "a", "b", "refutes", "inferred", 0), (5, "a", "c", "extends", "stated", 0)], "edge_id int, from_node string, to_node string, relation string, basis string, n_evidence int")
    assert rows(knowledge.gate_edges(e)) == [(1, "self_loop"), (2, None), (3, "duplicate_parallel"), (4, "inferred_relation_without_evidence"), (5, "no_basis")]
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("w", "a"), ("c", "z")]
    g = spark.createDataFrame([(*p, "extends") for p in pairs] + [("y", "x", "supports")], "from_node string, to_node string, relation string")
    assert rows(knowledge.cyclic_nodes(g, lambda d: d)) == [("a",), ("b",), ("c",)]
    assert rows(knowledge.cyclic_nodes(g.filter("from_node <> 'c'"), lambda d: d)) == []


def test_coverage_states(spark):
    schema = "phase string, status string, discovered int, captured int"
    state = lambda *r: knowledge.coverage_status(spark.createDataFrame(list(r), schema)).first()["status"]
    assert state() == "unknown"
    assert state(("p", "complete", 1, 1)) == "complete"
    assert state(("p", "complete", 1, 1), ("q", "running", 1, 0)) == "pending"
    assert state(("p", "failed", 1, 1), ("q", "running", 1, 0)) == "partial"


def test_queue(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    early, late = "2023-12-31 00:00:00", "2024-02-01 00:00:00"
    jobs = spark.createDataFrame([(1, "running", 1, 3, early), (2, "running", 3, 3, early), (3, "running", 1, 3, late), (4, "queued", 0, 3, early)], "job_id int, state string, attempt int, max_attempts int, t string")
    jobs = jobs.withColumns({"lease_until": F.to_timestamp("t"), "available_at": F.to_timestamp("t")})
    assert rows(queue.reap(jobs, now).select("job_id", "state")) == [(1, "retry_wait"), (2, "failed"), (3, "running"), (4, "queued")]
    assert rows(queue.claim(jobs, 2, now).select("job_id", "worker", "attempt")) == [(4, 1, 1)]
    legal = spark.createDataFrame([("queued", "running"), ("succeeded", "queued")], "a string, b string")
    assert [r[0] for r in legal.select(queue.legal(F.col("a"), F.col("b"))).collect()] == [True, False]
    log = spark.createDataFrame([("j", s) for s in range(5, 9)], "job_id string, seq int")
    assert rows(queue.events_after(log, "j", 6).select("seq")) == [(7,), (8,)]
    with pytest.raises(Exception, match="older"):
        queue.events_after(log, "j", 2).collect()


def test_html_blocks_tables_and_gates(spark):
    page = "<html><head><title>T</title><meta name=author content=A></head><body><nav>menu</nav><h1>One</h1><p>First &amp; text<h2>Two</h2><p>second</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><table><tr><td>in</td></tr></table></td></tr><tr></tr></table><script>x</script><a href='/l'>go</a></body></html>"
    got = html.parse(page)
    assert [(b["kind"], b["text"], b["section_path"]) for b in got["blocks"]] == [
        ("heading", "One", []), ("paragraph", "First & text", ["One"]), ("heading", "Two", ["One"]), ("paragraph", "second", ["One", "Two"]), ("table", "a | b\n1 | in", ["One", "Two"]),
    ]
    assert got["title"] == "T" and got["author"] == "A" and got["links"] == ["/l"] and got["scripts"] == 1
    assert html.parse("<input type=password>")["login"] and html.parse("<title>Just a moment</title>")["challenge"]
    df = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    assert [r[0] for r in html.parse_html(df, "html").select(F.size("parsed.blocks")).collect()] == [5, 0]
    lines = spark.createDataFrame([("a\n\n b ",)], "t string").select(F.explode(html.plain_blocks(F.col("t"))).alias("b")).select("b.*")
    assert rows(lines) == [(1, "a", "line[0]:0"), (3, "b", "line[2]:3")]


def test_diff_and_chunks(spark):
    rows = lambda texts: spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "pair_id long, pos int, text string")
    old, new = ["a b c d", "same", "gone away"], ["a b c e", " same", "x", "same"]
    got = sorted(tuple(str(x) for x in r) for r in documents.diff_blocks(rows(old), rows(new)).collect())
    assert got == [("1", "added", "None", "same"), ("1", "added", "None", "x"), ("1", "changed", "a b c d", "a b c e"), ("1", "removed", "gone away", "None")]
    assert documents.diff_blocks(rows(old), rows(old)).count() == documents.diff_blocks(rows(["p", "q"]), rows(["q", "p"])).count() == 0
    words = " ".join(f"w{k:05d}" for k in range(2000))  # 14 kB in one block
    blocks = [(1, "s", 1, "b1", "Title"), (1, "s", 2, "b2", words), (1, "s", 3, "b3", "end of it"), (1, "t", 4, "b4", "short"), (1, "t", 5, "b5", " "), (2, "", 1, "c1", "x" * 9000), (3, "", 1, "d1", None)]
    out = documents.chunks(spark.createDataFrame(blocks, "doc_id long, section string, pos int, block_id string, text string")).collect()
    first = sorted((r for r in out if r["section"] == "s"), key=lambda r: r["ordinal"])
    assert [r["ordinal"] for r in first] == list(range(len(first))) and first[0]["block_ids"] == ["b1", "b2"] and first[-1]["block_ids"][-1] == "b3"
    seen = [r["text"].split() for r in first]
    assert set(sum(seen, [])) == {"Title", "end", "of", "it", *words.split()} and all(len(r["text"]) <= 3300 for r in first)
    assert all(set(x) & set(y) for x, y in zip(seen, seen[1:]))  # they overlap
    assert [(r["block_ids"], r["text"]) for r in out if r["section"] == "t"] == [(["b4"], "short")]
    assert "".join(r["text"] for r in out if r["doc_id"] == 2) == "x" * 9000
    table = "h | i\n" + "\n".join(f"{'r' * 300} | {k}" for k in range(25)) + "\n"
    parts = documents.table_chunks(spark.createDataFrame([(1, "b9", table), (2, "b1", "only"), (3, "b1", "")], "doc_id long, block_id string, text string")).collect()
    mine = [r["text"].split("\n") for r in sorted(parts, key=lambda r: r["part"]) if r["doc_id"] == 1]
    assert len(mine) == 3 and all(m[0] == "h | i" for m in mine) and sum(len(m) - 1 for m in mine) == 25
    assert [r["text"] for r in parts if r["doc_id"] == 2] == ["only\nonly"]


def test_sources(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title> A </title><link>http://x/a?utm_x=1</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item><item><title>B</title><link>http://x/a</link></item></channel></rss>")
    feed = readers.read_feed(spark, str(tmp_path / "feed.xml"))
    assert feed.count() == 2
    assert readers.new_candidates(feed, spark.createDataFrame([], "canonical_url string")).count() == 1
    assert readers.within_overlap(feed, F.lit("2024-02-01").cast("timestamp")).count() == 1
    api = spark.createDataFrame([('{"data":{"items":[{"id":1,"n":{"t":"x"}},{"id":2}]}}',)], "body string")
    assert rows(readers.api_items(api, "body", "data.items", {"id": "id", "t": "n.t"}).na.fill("-")) == [("1", "x"), ("2", "-")]
    with pytest.raises(ValueError):
        readers.check_config("rss", {"url": "u", "other": 1})


def test_streams_equal_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), source.schema, 1)
    got = streams.run_available(streams.tumbling_counts(stream, "ts", "event_type", late_hours=24 * 400), "slots", str(tmp_path / "c1"), "complete")
    want = source.groupBy(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 900).alias("s"), "event_type").count()
    assert rows(got) == rows(want.select(F.col("s") * 900, "event_type", "count"))
    once = streams.run_available(streams.first_seen(streams.file_stream(spark, str(tmp_path / "in"), source.schema), "ts", ["user_id"], 24 * 400), "once", str(tmp_path / "c2"))
    assert once.count() == source.select("user_id").distinct().count()


def test_state_fold(spark):
    c = spark.createDataFrame([(1, 1, "running"), (1, 2, "queued"), (1, 3, "succeeded"), (2, 1, "succeeded")], "job_id int, seq int, to_state string")
    assert rows(streams.fold_states(c, "job_id", [])) == [(1, "succeeded", 2, 1), (2, "queued", 0, 1)]


def test_nearest_each_equals_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "VECTORS", 7)
    monkeypatch.setattr(retrieval, "QUERIES", 2)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    v[5:25] = v[0]  # equal vectors tie
    rows = [(i, v[i].tolist(), i % 3) for i in range(60)] + [(60, None, 0), (61, [0.0] * 8, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    unit = v / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    far = np.round(1 - unit @ unit.T, 9)
    for cell in (None, "label"):
        got = {}
        for r in retrieval.nearest_each(d, d.filter("vec_id % 10 = 0"), 4, cell=cell).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == {q: sorted((i for i in range(60) if not cell or i % 3 == q % 3), key=lambda i: (far[q, i], i))[:4] for q in range(0, 60, 10)}
    gate = {r["query_id"]: (r["found"], r["wanted"]) for r in retrieval.recall_each(retrieval.nearest_each(d, d.filter("vec_id % 10 = 0"), 4), retrieval.nearest_each(d, d.filter("vec_id % 10 = 0"), 4, cell="label")).collect()}
    assert set(gate) == set(range(0, 60, 10)) and all(w == 4 and 1 <= f <= 4 for f, w in gate.values())


def test_catalogue_searches_for_every_query_vector(spark):
    import duckdb

    from paperloom.plans.catalogue import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    for name in ("knn_exact_each", "knn_recall_gate_each"):
        want = db.execute(ORACLES[name]).fetchall()
        got = [tuple(r) for r in QUERIES[name](spark, sf).collect()]
        assert sorted(got) == sorted(want) and len({r[0] for r in got}) == db.execute("SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0").fetchone()[0]
