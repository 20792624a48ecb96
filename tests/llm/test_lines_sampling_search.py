"""Line dedup, importance resampling and lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import WORDS, prose

from paperloom.llm import op11_line_dedup as lines
from paperloom.llm import op12_importance as importance
from paperloom.llm import op13_lexical_search as search

LONG = "One  LINE of quite some Length"
ROWS = [
    (1, f"{LONG}\nfirst\n{LONG}"),
    (2, f"  {LONG.upper()}\t\nsecond"),
    (3, f"{LONG} \r\nthird\n"),
    (4, f"{LONG}\nfourth"),
    (4, f"{LONG}\nfourth"),
    (5, None),
    (6, ""),
    (None, f"no id\n{LONG}"),
    (None, f"no id either\n{LONG}"),
    (7, "only short\n" * 3),
    (8, "twenty characters ÄÖ\nx"),
    (9, "twenty characters ÄÖ"),
    (10, "twenty characters äö\n\ntwenty characters ÄÖ"),
    (11, "nineteen characters\n"),
    (12, "nineteen characters\n"),
    (13, "nineteen characters\n"),
    (14, "a long text " * 20_000 + f"\n{LONG}"),
]


def brute_lines(rows):
    """Expected (doc_id, kept, n_lines, n_dropped) for rows whose null ids are told apart by their text."""
    held = defaultdict(set)
    name = lambda i, t: (-1, t) if i is None else (i, "")
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(" \t\n\v\f\r").encode().lower()
            if len(k.decode()) >= 20:
                held[k].add(name(i, t))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = []
        for line in own:
            k = line.strip(" \t\n\v\f\r").encode().lower()
            if len(k.decode()) >= 20 and len(held[k]) >= 3 and max(held[k]) != name(i, t):
                continue
            kept.append(line)
        out.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=str)


def decided(index, docs):
    return sorted(((r["doc_id"], r["kept"], r["n_lines"], r["n_dropped"]) for r in index.decide(docs).collect()), key=str)


def test_line_dedup_equals_brute_force(spark, documents):
    index = lines.LineIndex.new(spark)
    index.insert(documents(ROWS))
    assert decided(index, documents(ROWS)) == brute_lines(ROWS)
    empty = lines.LineIndex.new(spark)
    empty.insert(documents([]))
    assert empty.decide(documents([])).count() == 0


def test_line_dedup_of_null_ids_only(spark, documents):
    rows = [(None, f"{LONG}\n{x}") for x in "abc"]
    index = lines.LineIndex.new(spark)
    index.insert(documents(rows))
    got = index.decide(documents(rows)).collect()
    assert sorted(r["n_dropped"] for r in got) == [0, 1, 1]  # one of them, always the same, keeps the line


def test_line_dedup_is_reversible(spark, documents):
    """Any order of insertions and deletions decides as if only the live documents had ever been there; small shards
    make filters grow and be built anew."""
    r = random.Random(3)
    pool = [" ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(8)) for _ in range(60)]
    rows = [(i, "\n".join(r.sample(pool, 5) + [prose(i, 5)])) for i in range(60)]
    index = lines.LineIndex.new(spark, shard_keys=8)
    ids = lambda keep: spark.createDataFrame([(i,) for i in keep], "doc_id long")
    index.insert(documents(rows[:20]))
    index.insert(documents(rows[20:]))
    assert decided(index, documents(rows)) == brute_lines(rows)
    index.delete(ids([*range(30, 60), None]))
    assert decided(index, documents(rows[:30])) == brute_lines(rows[:30])
    index.insert(documents(rows[30:]))
    assert decided(index, documents(rows)) == brute_lines(rows)
    index.delete(ids(range(60)))
    assert index.counts().count() == 0 and index.postings().count() == 0
    assert all(not any(f["slots"]) for f in index.filters().collect())


def test_cuckoo_filter():
    x = np.random.default_rng(1).integers(-(2**63), 2**63, (60_000, 2))
    f = lines.Cuckoo.sized(30_000)
    assert f.insert(x[:30_000, 0], x[:30_000, 1]) and f.contains(x[:30_000, 0], x[:30_000, 1]).all()
    assert f.contains(x[30_000:, 0], x[30_000:, 1]).mean() < 0.001
    f.delete(x[:10_000, 0], x[:10_000, 1])
    assert f.contains(x[10_000:30_000, 0], x[10_000:30_000, 1]).all()
    f.delete(x[10_000:30_000, 0], x[10_000:30_000, 1])
    assert not f.slots.any()
    small = lines.Cuckoo.sized(1)
    assert not small.insert(x[:100, 0], x[:100, 1])


def words12(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_sample(rows, target, longest, percent, least):
    grams = lambda t: [" ".join(w[i : i + n]) for w in [words12(t)] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    s, t = Counter(bucket(g) for _, x in rows for g in grams(x)), Counter(bucket(g) for x in target for g in grams(x))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        own = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in map(bucket, grams(x))]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words12(x))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_importance_equals_brute_force(spark, documents, longest):
    rows = [(i, prose(i, 5 + i) + " Ünï-CODE x_y") for i in range(80)] + [(80, None), (81, ""), (82, "... \n"), (None, prose(1, 40)), (83, "tie " * 40), (84, "tie " * 40), (85, "a-b " * 30_000)]
    target = [prose(2, 50), "tie tie", None, ""]
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(documents(rows), aim, longest=longest, percent=30).collect()
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got), key=str) == brute_sample(rows, target, longest, 30, 20)


def test_importance_of_little(spark, documents):
    aim = spark.createDataFrame([], "text string")
    assert importance.resample(documents([]), aim).count() == 0
    rows = [(1, "few words"), (1, "few words")]
    got = importance.resample(documents(rows), aim).collect()
    assert [r["rank"] for r in got] == [None, None] and got[0] == got[1]
    same = [(5, "equal words " * 15)] * 10
    got = importance.resample(documents(same), aim, percent=50).collect()
    assert sorted(r["rank"] or 0 for r in got) == [0] * 5 + [1, 2, 3, 4, 5]


def test_overlapped_spans():
    n, found = importance.buckets_of("A-b  C\tdé", 3)
    assert n == 4 and found == [zlib.crc32(g.encode()) % 10_000 for g in ("a", "b", "c", "dé", "a b", "b c", "c dé", "a b c", "b c dé")]


def brute_search(rows, items, k):
    docs = [(i, Counter(search.terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total, df = sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in docs:
            m = 50 + (50 * n * len(docs)) // total
            score = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(search.terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if no else i, -s) for rank, (s, no, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, documents, monkeypatch):
    rows = [(i, prose(i, 3 + i % 90) + " the" * (i % 7)) for i in range(400)] + [(500, None), (501, ""), (502, "?!"), (503, "the " * 30_000 + "rare"), (None, prose(3, 20)), (504, prose(3, 20)), (504, prose(3, 20)), (505, "Größe GRÖSSE größe")]
    items = [(1, prose(3, 12)), (2, "the"), (3, None), (4, "nowhere"), (5, "Größe rare rare"), (None, prose(9, 4)), (-7, "alpha1 beta2")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as rank", "3 as score", "4 as side")
    want = brute_search(rows, items, 10)
    got = lambda: sorted((tuple(r) for r in search.search(documents(rows), asked, 10).collect()), key=str)
    assert got() == want
    monkeypatch.setattr(search, "PER_PASS", 2)
    assert got() == want
    assert search.search(documents([]), asked, 10).count() == 0
    assert search.search(documents(rows), asked.limit(0), 10).count() == 0


def test_rows_of_one_query_are_one(spark, documents):
    rows = [(i, prose(i, 30)) for i in range(50)]
    two = spark.createDataFrame([(1, prose(1, 5)), (1, prose(2, 5))], "item_id long, text string")
    assert sorted(map(tuple, search.search(documents(rows), two, 5).collect())) == brute_search(rows, [(1, prose(1, 5) + " " + prose(2, 5))], 5)


def test_bounds_hold_and_exclude():
    """No score exceeds its bound, and a block's later documents are mostly excluded unscored."""
    texts = [prose(i, 20 + i % 60) + " rare" * (i % 9) for i in range(900)]
    counts = [Counter(search.terms(t)) for t in texts]
    sizes = [sum(c.values()) for c in counts]
    norms = np.array([search.norm(n, len(texts), sum(sizes)) for n in sizes])
    df = Counter(t for c in counts for t in c)
    queries = search.Queries([(1, search.terms("rare alpha1 beta3")), (2, search.terms(texts[7]))])
    weights = [search.weight(len(texts), df[t]) for t in queries.words]
    block = search.Block(counts, [(False, i, 0) for i in range(len(texts))], norms)
    bounds = search.upper_bounds(block, queries, np.array(weights, float))
    for q, own in enumerate(queries.terms):
        exact = [sum(weights[t] * search.part(c[queries.words[t]], int(m)) for t in own if queries.words[t] in c) for c, m in zip(counts, norms)]
        assert (bounds[q] >= np.array(exact)).all()
    best = [search.Best(5), search.Best(5)]
    assert search.search_block(block, queries, weights, best) < len(texts)
    assert best[1].rows[0][1] == (False, 7, 0)
