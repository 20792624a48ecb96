"""Repetitive texts: longest matches by suffix ranks."""

import time

import numpy as np

from paperloom.llm import op06_substring as passages


def test_suffix_ranks_equal_steps(monkeypatch):
    for seed in range(200):
        r = np.random.default_rng(seed)
        n = int(r.integers(2, 80))
        monkeypatch.setattr(passages, "STEPS", int(r.integers(1, 6)))
        key, seg = r.integers(0, int(r.integers(1, 5)), n).astype(np.uint64), np.cumsum(r.random(n) < 0.05)
        length, source = passages.longest_matches(key, seg)
        for i in range(n):
            best = 0
            for j in range(i):
                k = 0
                while i + k < n and seg[i + k] == seg[i] and seg[j + k] == seg[j] and key[i + k] == key[j + k]:
                    k += 1
                best = max(best, k)
            assert length[i] == best
            if best:
                j = source[i]
                assert j < i and (key[j : j + best] == key[i : i + best]).all() and seg[j + best - 1] == seg[j]


def test_a_million_repeated_words_take_seconds(spark, documents):
    phrase = "one two three four five six seven eight nine ten "
    rows = [(1, "word " * 1_000_000), (2, phrase * 50_000), (3, "word " * 30)]
    began = time.time()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in passages.digest(documents(rows)).collect()}
    assert time.time() - began < 90
    # the first window of each distinct sequence stays: 20 words of one, 29 of ten; the third text lies in the first
    assert got == {1: (1_000_000, 999_999), 2: (500_000, 499_990), 3: (30, 30)}
