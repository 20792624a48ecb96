"""Working memory of tasks, as tracemalloc counts it."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from paperloom.llm import op01_media as media
from paperloom.llm import op06_substring as passages
from paperloom.llm.common import stretches


class Tasks:
    """Stands for a DataFrame: keeps what a task runs."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def peak(run, batches):
    """Rows of a task's batches, and MB of its peak."""
    rows = []
    tracemalloc.start()
    for out in run(iter(batches)):
        rows.append(out)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return rows, most


def test_a_chunks_segments_are_built_from_arrays():
    r = random.Random(1)
    part = [" ".join(f"w{r.randrange(3000)}" for _ in range(40)) for _ in range(400)]
    texts = [" ".join(r.choice(part) for _ in range(5)) for _ in range(1500)]  # 300,000 words, most of them repeated
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["doc_id", "row", "text"])
    out, most = peak(passages.segments(Tasks(), np.zeros(0, np.uint64)), [batch])
    assert most < 35
    assert max(x.num_rows for x in out) <= passages.MOST_ROWS
    rows = [x for b in out for x in b.to_pylist()]
    assert all((x["hashes"] is None) == (x["source"] is not None) for x in rows) and all(len(x["hashes"]) == 6 * x["n"] for x in rows if x["hashes"])
    settled = np.zeros((len(texts), 200), bool)
    for x in rows:
        if x["source"]:
            assert (x["source"]["doc_id"], x["source"]["start"]) < (x["doc_id"], x["start"])
            a, b = (texts[i].split()[s : s + x["n"] + passages.WINDOW - 1] for i, s in ((x["doc_id"], x["start"]), (x["source"]["doc_id"], x["source"]["start"])))
            assert a == b
            settled[x["doc_id"], x["start"] : x["start"] + x["n"]] = True
    seen, again = set(), np.zeros((len(texts), 200), bool)
    for i, t in enumerate(texts):
        w = t.split()
        for s in range(len(w) - passages.WINDOW + 1):
            key = tuple(w[s : s + passages.WINDOW])
            again[i, s] = key in seen
            seen.add(key)
    assert (settled == again).all()


def test_media_are_coded_and_read_a_stretch_at_a_time(spark):
    texts = [None, ""] + ["x" * (3000 + i) for i in range(2000)] + ["y" * 3_000_000, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    parts = list(stretches(batch, "text", 1 << 20))
    assert pa.Table.from_batches(parts).combine_chunks().to_pylist() == batch.to_pylist()
    assert [p.num_rows for p in parts if max(len(t or "") for t in p.column("text").to_pylist()) > 1 << 20] == [1]
    assert len(parts) < 12 and not list(stretches(batch.slice(0, 0), "text", 9))
    stored, most = peak(media.store_media(Tasks()), [batch.slice(0, 2002)])
    assert most < 50 and max(b.nbytes for b in stored) < 2_000_000
    whole = pa.Table.from_batches(stored).combine_chunks().to_batches()[0]
    d = pa.RecordBatch.from_arrays([whole.column(k) for k in (0, 1, 2, 1, 2)], ["doc_id", "n_bytes", "media", "media_bytes", "media_sha256"]).set_column(4, "media_sha256", pa.array([""] * 2002))
    read, _ = peak(media.read_media(Tasks()), [d])
    assert len(read) > 5 and [r["payload_bytes"] for b in read for r in b.to_pylist()] == [-(-max(1, len(t or "")) // 576) * 576 for t in texts[:2002]]


def test_exhaustive_comparison_reads_its_members_once(spark):
    from paperloom.llm import op04_minhash as near

    rest = spark.createDataFrame([(7, None, 1, 1), (7, None, 2, 2), (7, None, 3, 3)], "unit long, second long, rep long, comp long").distinct()
    group = [7, 8] + list(range(100, 114))
    classes = spark.createDataFrame([(k, group if k < 3 else [7] + list(range(200, 215)), 5, 5, 5, 5) for k in (1, 2, 3)], "rep long, groups array<long>, k0 long, k1 long, k2 long, k3 long")
    shingles = np.arange(40, dtype=np.uint64).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    sets = spark.createDataFrame([(k, bytearray(shingles)) for k in (1, 2, 3)], "id long, set binary")
    links = near.exhaust(rest, classes, sets)
    # what makes rest isn't run again for the links: members, classes, sets, their counts and their groups are moved
    assert links._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 8
    assert [tuple(r) for r in links.collect()] == [(1, 2)]


def test_components_of_a_tasks_edges_take_no_round(spark, monkeypatch):
    from paperloom.llm import op04_minhash as near

    r = random.Random(3)
    rows = [(a, a + 1) for a in range(100, 160)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(250)]
    edges, label = spark.createDataFrame(rows, "a long, b long").repartition(5), {x: x for e in rows for x in e}
    for _ in rows:
        for a, b in rows:
            label[a] = label[b] = min(label[a], label[b])
    cuts = []
    monkeypatch.setattr(near, "cut_lineage", lambda d, cut=near.cut_lineage: cuts.append(d) or cut(d))
    assert {x["id"]: x["comp"] for x in near.components(edges).collect()} == label and len(cuts) == 1
    monkeypatch.setattr(near, "EDGES_A_TASK", 70)  # several tasks
    assert {x["id"]: x["comp"] for x in near.components(edges).collect()} == label
    assert near.components(edges.limit(0)).count() == 0


def test_near_duplicates_gather_no_side_of_a_join_at_the_driver(spark, documents, monkeypatch):
    from paperloom.llm import op04_minhash as near

    plans = []

    def cut(d, cut=near.cut_lineage):
        plans.append(d)
        return cut(d)

    monkeypatch.setattr(near, "cut_lineage", cut)
    text = [" ".join(f"w{(7 * k + i) % 90}" for i in range(60)) for k in range(12)]
    d = near.resolve(documents([(i, text[i % 12] + f" x{i}") for i in range(60)]))
    assert d.count() == 60
    for plan in [*plans, d]:
        plan.collect()  # then its plan is the last one
        assert "BroadcastExchange" not in plan._jdf.queryExecution().executedPlan().toString()
