"""Windows, merges, quotes, graphs and sequences: what their queries can't reach."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import graphs, intervals, merges, quotes, records, sequences
from paperloom.session import checkpointed


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- windows


def test_range_join_equals_comparison(spark):
    r = random.Random(1)
    points = [(r.randrange(3), r.randrange(-2000, 2000)) for _ in range(300)] + [(1, 5)] * 50 + [(1, None)]
    windows = [(i, r.randrange(3), lo, lo + int(2 ** r.uniform(0, 12))) for i, lo in enumerate(r.randrange(-3000, 2000) for _ in range(80))] + [(900, 1, 5, 5), (901, 1, 9, 2), (902, 1, None, 4), (903, 1, intervals.EVER, intervals.NEVER), (904, 0, 7, 8)]
    p, w = spark.createDataFrame(points, "key int, moment long"), spark.createDataFrame(windows, "window_id int, key int, lo long, hi long")
    joined = intervals.range_join(p, w, "moment", "lo", "hi", ["key"])
    want = sorted((k, m, i) for k, m in points for i, kk, lo, hi in windows if m is not None and lo is not None and k == kk and lo <= m < hi)
    assert rows(joined.select("key", "moment", "window_id")) == sorted(want, key=str)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.range_join(p, w.limit(0), "moment", "lo", "hi", ["key"]).count() == 0


def test_watermarks_take_every_moment_inside(spark):
    w = spark.createDataFrame([(1, 100, 40_000, "running", 500, 0), (2, 100, 40_000, "complete", 500, 3), (3, 250, 350, "running", None, 1)], "window_id int, lo long, hi long, status string, watermark long, done_count long")
    seen = spark.createDataFrame([(300,), (50_000,), (900,), (40_000,)], "moment long")
    assert rows(intervals.bump_watermarks(w, seen)) == [(1, 900, 2), (2, 500, 3), (3, 300, 2)]


def test_replay_skips_what_is_judged(spark):
    t = spark.createDataFrame([(1, 10, 100, 200), (2, 20, None, 150), (3, 30, None, None)], "topic_id long, revision_id long, from_time long, to_time long")
    p = spark.createDataFrame([(7, 100), (8, 199), (9, 200)], "parse_id long, fetched_at long")
    judged = spark.createDataFrame([(1, 10, 8), (1, 9, 7)], "topic_id long, revision_id long, parse_id long")
    assert rows(intervals.replay(t, p, judged)) == [(1, 10, 7), (2, 20, 7), (3, 30, 7), (3, 30, 8), (3, 30, 9)]


def test_the_ceiling_stops_before_pairs(spark):
    a, b = spark.range(100).withColumnRenamed("id", "parse_id"), spark.range(7).withColumnRenamed("id", "industry")
    assert intervals.judge_all(a, b, 700).count() == 700
    with pytest.raises(ValueError, match="700|pairs"):
        intervals.judge_all(a, b, 699)
    with pytest.raises(ValueError, match="industries"):
        intervals.judge_all(a, b, 10**9, small=6)


# --- merges

COMMAND = "merge_id long, seq long, canonical_id long, merged_id long, canonical_version long, merged_version long"


def in_order(events, commands):
    version, out = dict(events), []
    for m, _, c, e, vc, ve in sorted(commands, key=lambda x: x[1]):
        if c not in version or e not in version:
            out.append((m, "missing"))
        elif version[c] != vc or version[e] != ve:
            out.append((m, "version_conflict"))
        elif c == e:
            out.append((m, "self_merge"))
        else:
            version[e] += 1
            out.append((m, "merged"))
    return sorted(out)


def test_merges_run_as_if_in_order(spark):
    for seed in range(6):
        r = random.Random(seed)
        events = [(i, 1 + r.randrange(2)) for i in range(8)]
        version = dict(events)
        commands = []
        for m in range(25):
            c, e = r.randrange(9), r.randrange(9)
            commands.append((m, m * 3 % 26, c, e, version.get(c, 1) + r.randrange(2), version.get(e, 1) + r.randrange(2)))
        got = merges.decide(spark.createDataFrame(events, "event_id long, row_version long"), spark.createDataFrame(commands, COMMAND), checkpointed)
        assert rows(got.select("merge_id", "outcome")) == sorted(in_order(events, commands), key=str)


def test_merge_order_decides_chains(spark):
    e = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "event_id long, row_version long")
    forth = spark.createDataFrame([(1, 1, 2, 1, 1, 1), (2, 2, 3, 2, 1, 1)], COMMAND)  # A into B, then B into C
    back = spark.createDataFrame([(1, 2, 2, 1, 1, 1), (2, 1, 3, 2, 1, 1)], COMMAND)  # B into C first: B has moved
    assert rows(merges.decide(e, forth, checkpointed).select("merge_id", "outcome")) == [(1, "merged"), (2, "merged")]
    assert rows(merges.decide(e, back, checkpointed).select("merge_id", "outcome")) == [(1, "version_conflict"), (2, "merged")]


def test_chains_resolve_by_doubling(spark):
    n, rounds = 500, []
    chain = spark.range(n).selectExpr("id as event_id", "id + 1 as merged_into")
    ring = spark.createDataFrame([(1001, 1002), (1002, 1003), (1003, 1001)], "event_id long, merged_into long")

    def cut(df):
        rounds.append(1)
        return checkpointed(df)

    got = {r["event_id"]: (r["canonical_id"], r["hops"]) for r in merges.resolve(chain.unionByName(ring), cut).collect()}
    assert all(got[i] == (n, n - i) for i in range(n)) and len(rounds) <= 12
    assert all(got[i][0] is None for i in (1001, 1002, 1003))


def test_undo_restores_or_compensates(spark):
    e = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 5)], "event_id long, row_version long")
    m = spark.createDataFrame([(1, 1, 2, 1, 2), (2, 3, 4, 1, 2), (3, 9, 2, 1, 2)], "merge_id long, canonical_id long, merged_id long, canonical_version long, merged_version long")
    snap = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 4, 40)], "merge_id long, event_id long, claim_id long")
    outcomes, compensations, restored = merges.undo(m, e, snap)
    assert rows(outcomes.select("merge_id", "modifications", "outcome")) == [(1, 0, "undone"), (2, 3, "conflict"), (3, None, "missing")]
    assert rows(compensations) == [(2, 3, "manual re-split required")] and rows(restored) == [(1, 1, 10), (1, 2, 20)]
    log = spark.createDataFrame([(20, 2, 1), (20, 1, 5), (20, 1, 6), (20, 2, 9)], "claim_id long, event_id long, seq long")
    assert rows(merges.membership_intervals(log)) == [(20, 1, 5, 9), (20, 2, 1, 5), (20, 2, 9, None)]


def test_merges_leave_snapshots_and_stale_marks(spark):
    done = spark.createDataFrame([(1, 1, 5, 6, "merged"), (2, 2, 5, 7, "merged"), (3, 3, 5, 8, "version_conflict")], "merge_id long, seq long, canonical_id long, merged_id long, outcome string")
    members = spark.createDataFrame([(5, 50), (6, 60), (7, 70), (8, 80)], "event_id long, claim_id long")
    assert rows(merges.snapshot(done, members)) == [(1, 5, 50), (1, 6, 60), (2, 5, 50), (2, 7, 70)]
    evidence = members.selectExpr("claim_id", "claim_id as evidence_id")
    cites = spark.createDataFrame([(50, 1), (70, 1), (70, 2), (80, 3), (60, 4)], "evidence_id long, report_id long")
    marked = spark.createDataFrame([(4,)], "report_id long")
    assert rows(merges.stale_marks(done, members, evidence, cites, marked)) == [(1, 1), (2, 2)]
    after = merges.apply(spark.createDataFrame([(6, 1, "open", None), (8, 2, "open", None)], "event_id long, row_version long, lifecycle string, merged_into long"), done)
    assert rows(after) == [(6, 2, "merged", 5), (8, 2, "open", None)]


# --- quotes


def find_all(text, quote):
    out, at = [], text.find(quote) if quote else -1
    while at >= 0:
        out.append((at, at + len(quote)))
        at = text.find(quote, at + len(quote))
    return out


QUOTED = [("aaaaa", "aa"), ("a.b a.b", "a.b"), ("日本👍日本", "日本"), ("x", ""), ("", "x"), ("\\E tail \\E", "\\E"), ("end end", "end"), ("(a)(a)", "(a)"), (None, "x"), ("x", None)]


def test_spans_equal_find(spark):
    d = spark.createDataFrame([(i, t, q) for i, (t, q) in enumerate(QUOTED)], "i int, t string, q string")
    got = {r["i"]: [(s["start"], s["end"]) for s in r["s"] or []] for r in d.select("i", quotes.spans(F.col("t"), F.col("q")).alias("s")).collect()}
    assert got == {i: find_all(t or "", q or "") for i, (t, q) in enumerate(QUOTED)}


def test_search_equals_find(spark):
    r = random.Random(2)
    words = "ab abc b bc c ca cab x".split()
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 40)))) for i in range(120)] + [(500, None), (501, ""), (None, "ab abc b bc c"), (7, "c ca cab x ab"), (7, "c ca cab x ab")]
    asked = [(i, t[r.randrange(3) : r.randrange(8, 30)]) for i, (_, t) in enumerate(texts[:60])] + [(900, "x"), (901, ""), (902, "no such words in here"), (903, "ab  b")]
    got = quotes.search(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, quote string"))
    seen, want = set(), []
    for i, t in texts:
        if t and (i, t) not in seen or t and i != 7:
            want += [(q, i, n, *s) for q, quote in asked for n, s in enumerate(find_all(t, quote))]
        seen.add((i, t))
    assert set(rows(got)) == set(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_evidence_gets_all_its_spans(spark):
    e = spark.createDataFrame([(1, 0, "b", "to"), (1, 1, "zz", "to"), (2, 0, "b", "nine")], "claim_id int, ordinal int, block_id string, quote string")
    b = spark.createDataFrame([("b", "to be or not to")], "block_id string, text string")
    assert rows(quotes.locations(e, b)) == [(1, 0, "b", 0, 0, 2), (1, 0, "b", 1, 13, 15)]


# --- graphs


def test_cyclic_proposals_are_rejected_whole(spark):
    edges = [("a", 1, 2, "updates"), ("a", 2, 1, "supports"), ("b", 1, 2, "updates"), ("b", 2, 1, "replaces"), ("b", 7, 8, "supports"), ("c", 3, 3, "extends"), ("d", 1, 2, "updates"), ("d", 2, 3, "updates"), ("d", 3, 4, "updates"), ("d", 4, 2, "extends"), ("e", 1, None, "updates")]
    edges += [("f", i, (i + 1) % 7, "updates") for i in range(7)] + [("g", i, i + s, "updates") for i in range(12) for s in (1, 2)]
    d = spark.createDataFrame(edges, "proposal_id string, from_node long, to_node long, relation string")
    assert rows(graphs.cyclic_proposals(d, checkpointed)) == [("b",), ("c",), ("d",), ("f",)]
    judged = graphs.accepted_edges(d, checkpointed).filter("proposal_id = 'b'")
    assert [r["reason"] for r in judged.collect()] == ["cycle"] * 3
    assert graphs.cyclic_proposals(d.limit(0), checkpointed).count() == 0


def test_long_chains_take_few_rounds(spark):
    rounds = []

    def cut(df):
        rounds.append(1)
        return checkpointed(df)

    chain = spark.range(10_000).selectExpr("'p' as proposal_id", "id as from_node", "id + 1 as to_node", "'updates' as relation")
    assert graphs.cyclic_proposals(chain, cut).count() == 0
    assert len(rounds) <= 3 * 20


# --- sequences


def test_increasing_is_longest():
    r = random.Random(4)
    for _ in range(300):
        v = r.sample(range(12), r.randrange(0, 9))
        kept = sequences.increasing(v)
        best = [0] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max([best[j] for j in range(i) if v[j] < v[i]], default=0)
        assert [v[i] for i in kept] == sorted(v[i] for i in kept) and kept == sorted(kept) and len(kept) == max(best, default=0)


def test_alignment_equals_difflib_where_blocks_differ(spark):
    r = random.Random(5)
    old = [f"line {i}" for i in range(40)]
    for seed in range(3):
        new = old[:]
        for _ in range(6):
            k = r.randrange(len(new))
            new[k : k + r.randrange(3)] = [f"new {seed} {r.random()}"] * r.randrange(3)
        a = spark.createDataFrame([(1, i, t) for i, t in enumerate(old)], "pair_id int, pos int, text string")
        b = spark.createDataFrame([(1, i, t) for i, t in enumerate(new)], "pair_id int, pos int, text string")
        got = {(x["from_pos"], x["to_pos"]) for x in sequences.diff(a, b).collect()}
        gone, come = {f for f, _ in got if f is not None}, {t for _, t in got if t is not None}
        ops = difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes()
        assert gone == {i for tag, i1, i2, *_ in ops if tag != "equal" for i in range(i1, i2)}
        assert come == {j for tag, _, _, j1, j2 in ops if tag != "equal" for j in range(j1, j2)}


def test_a_moved_block_is_a_change(spark):
    a = spark.createDataFrame([(1, i, t) for i, t in enumerate("one two three four five".split())], "pair_id int, pos int, text string")
    b = spark.createDataFrame([(1, i, t) for i, t in enumerate("two three four five one".split())], "pair_id int, pos int, text string")
    assert rows(sequences.diff(a, b).select("change", "from_pos", "to_pos")) == [("moved", 0, None), ("moved", None, 4)]
    assert sequences.diff(a, a).count() == 0


def test_breaks_equal_a_walk():
    r = np.random.default_rng(6)
    for _ in range(300):
        n = int(r.integers(1, 60))
        size, section = r.integers(1, 40, n), np.cumsum(r.random(n) < 0.15)
        got, want, held, room = sequences.break_places(size, section, 100, 60), [], 0, 100
        for i in range(n):
            if i == 0 or section[i] != section[i - 1]:
                start, held, room = True, 0, 100
            else:
                start = held + size[i] > room
                if start:
                    held, room = 0, 60
            held += size[i] + 1
            want.append(start)
        assert got.tolist() == want


def blocks_of(spark, items):
    return spark.createDataFrame([(1, i, f"b{i}", kind, text) for i, (kind, text) in enumerate(items)], "doc_id int, pos int, block_id string, kind string, text string")


def assembled(spark, items):
    return [(r["block_ids"], r["text"]) for r in sequences.assemble(blocks_of(spark, items)).orderBy("ordinal").collect()]


def prose(i, n):
    return " ".join(f"w{i}t{j}" for j in range(n))


def test_chunks_keep_sizes_headings_and_tables(spark):
    size = lambda t: len(t) // 4
    long_ = assembled(spark, [("paragraph", prose(i, 400)) for i in range(12)])
    assert len(long_) >= 3 and all(size(t) <= sequences.MOST for _, t in long_)
    assert {b for ids, _ in long_ for b in ids} == {f"b{i}" for i in range(12)}
    for (_, before), (ids, after) in zip(long_, long_[1:]):
        head = after.split("\n")[0]
        assert before.replace("\n", " ").endswith(head) and 50 <= size(head) <= 110
    huge = assembled(spark, [("paragraph", " ".join(f"big{j}" for j in range(4000)))])
    assert len(huge) >= 4 and all(size(t) <= sequences.MOST for _, t in huge)
    assert {w for _, t in huge for w in t.split()} == {f"big{j}" for j in range(4000)}
    small = assembled(spark, [("heading", "Title"), ("paragraph", "Some text."), ("paragraph", " "), ("paragraph", "More.")])
    assert small == [(["b0", "b1", "b3"], "Title\nSome text.\nMore.")]
    two = assembled(spark, [("paragraph", prose(0, 300)), ("heading", "Next"), ("paragraph", "after")])
    assert [t.split("\n")[0][:4] for _, t in two] == ["w0t0", "Next"] and two[1][0] == ["b1", "b2"]
    big = assembled(spark, [("heading", "H"), ("paragraph", prose(1, 600))])
    assert big[0][1].startswith("H\nw1t0")  # a heading never stands alone
    table = "name|a|b\n" + "\n".join(f"row{i}|{prose(i, 20)}|z" for i in range(120))
    mixed = assembled(spark, [("paragraph", "before"), ("table", table), ("paragraph", "behind")])
    assert mixed[0] == (["b0"], "before") and mixed[-1] == (["b2"], "behind")
    assert len(mixed) > 3 and all(t.startswith("name|a|b\n") and ids == ["b1"] for ids, t in mixed[1:-1])
    assert sum(t.count("row") for _, t in mixed) == 120
    assert sequences.assemble(blocks_of(spark, [("paragraph", "x")]).limit(0)).count() == 0


# --- records


def test_patterns_and_limits(spark):
    d = spark.createDataFrame([(1, "50% off", None), (2, "500 off", "x_Y"), (3, None, "xzy"), (4, "a\\b", "")], "id int, a string, b string")
    hits = lambda n: [r["id"] for r in d.filter(records.like_any(["a", "b"], n)).orderBy("id").collect()]
    assert hits("0% ") == [1, 2] and hits("X_y") == [2, 3] and hits(r"x\_y") == [2] and hits(r"0\%") == [1] and hits("\\\\") == [4] and hits("") == [1, 2, 3, 4]
    many = spark.range(80).selectExpr("id", "id % 7 as moment")
    got = records.unified([("e", many), ("c", many.limit(3))])
    assert got.filter("kind = 'e'").count() == 50 and got.filter("kind = 'e'").agg(F.min("moment")).first()[0] == 2 and got.filter("kind = 'c'").count() == 3
