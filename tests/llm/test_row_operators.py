"""Operators that work row by row: media, BPE, quality rules, secrets."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pytest

from paperloom.llm import op01_media as media
from paperloom.llm import op02_bpe as bpe
from paperloom.llm import op08_quality_rules as rules
from paperloom.llm import op09_secret_scan as secrets

ODD = [(1, None), (2, ""), (3, " \n "), (4, "a"), (4, "a"), (None, "no id"), (5, "x " * 30_000), (6, "日本語 text\x1c ünïcode  end 👍🏽"), (7, "same"), (8, "same")]


def test_media_round_trip(spark, documents):
    got = media.read_media(media.store_media(documents(ODD))).collect()
    assert len(got) == len(ODD)
    by = {(r["doc_id"]): r for r in got}
    for doc_id, text in ODD:
        n, payload = media.padded_payload(text)
        r = by[doc_id]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert sum(c["n_frames"] for c in r["clips"]) == len(payload) // media.UNIT
    assert by[7]["media_sha256"] == by[8]["media_sha256"] and by[7]["feature"] == by[8]["feature"]
    assert media.store_media(documents([])).count() == 0


def test_media_general_decoder_and_shots():
    x = np.random.default_rng(0).integers(0, 256, (3, 24, 24)).astype(np.uint8)
    own = media.encode_frames(x)
    assert all((media.decode_jpeg(f) == s).all() for f, s in zip(own, x))
    seconds, frames = media.read_avi(media.write_avi(own))
    assert seconds == pytest.approx(1 / 25) and frames == own
    no_index = media.write_avi(own).replace(b"idx1", b"JUNK")
    assert media.read_avi(no_index)[1] == own
    dark, light = np.full((20, 24, 24), 10, np.uint8), np.full((15, 24, 24), 200, np.uint8)
    assert media.cuts(media.histograms(np.concatenate([dark, light]), 16)).tolist() == [20]
    assert media.cuts(media.histograms(dark, 16)).tolist() == []


def test_media_baseline_jpeg():
    """A flat 8 x 8 baseline block: one DC difference, then the end of the block."""
    table = lambda kind, size, symbol: b"\xff\xc4" + struct.pack(">H", 20) + bytes([kind]) + bytes([1] + [0] * 15) + bytes([symbol])
    data = (
        b"\xff\xd8\xff\xdb" + struct.pack(">H", 67) + b"\0" + bytes([8] * 64) + table(0, 1, 5) + table(16, 1, 0)
        + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 8, 8, 1) + b"\x01\x11\x00" + b"\xff\xda" + struct.pack(">H", 8) + b"\x01\x01\x00\x00\x3f\x00"
        + bytes([0b01010001, 0b11111111]).replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
    )
    assert (media.decode_jpeg(data) == 128 + 20).all()


def test_bpe_equals_the_library(spark, documents):
    import tiktoken

    library = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})
    got = bpe.encode(documents(ODD)).collect()
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == sorted((str(i), library.encode_ordinary(t or "")) for i, t in ODD)
    assert bpe.encode(documents([])).count() == 0


def test_digests_equal_the_library(spark, documents):
    import tiktoken

    library = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    long_words = [(-1, "漢字" * 40_000), (-2, "aB" * 200_000), (-3, "a" * 100_000 + " b"), (-4, None), (None, "日本 x"), (-5, " \n" * 30_000)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + long_words
    got = bpe.digests(docs.unionByName(spark.createDataFrame(long_words, docs.schema))).collect()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i or 0, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((r["doc_id"] or 0, *list(r)[1:]) for r in got) == sorted(want)


def test_long_merge_equals_the_plain_one():
    import random

    r = random.Random(4)
    for _ in range(300):
        word = "".join(r.choice("abcdeée漢 ' 12") for _ in range(r.randint(1, 60))).encode()
        assert bpe.merge_long(word, bpe.RANKS) == bpe.merge(word, bpe.RANKS)


def test_fast_split_pattern_equals_the_shipped_one():
    import random

    import regex

    exact, r = regex.compile(bpe.PATTERN).findall, random.Random(3)
    pool = [chr(c) for c in range(0x250) if not 0x1C <= c <= 0x1F]
    for _ in range(5000):
        text = "".join(r.choice(pool if r.random() < 0.5 else " a1'_²ª\n\xa0\x85.sve") for _ in range(r.randint(0, 14)))
        assert bpe.splitter(bpe.PATTERN)(text) == exact(text)


def _measures(text):
    w = re.findall(rules.WORD, text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(rules.WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, documents):
    rows = [*[x for x in ODD if x[0] != 5], (9, "a b c a b c d\nx y\nx y\n## ||"), (10, "w " * 100), (11, " ".join(f"w{i}" for i in range(80)))]
    led = rules.ledger(documents(rows))
    got = {(r["doc_id"]): tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in led.collect()}
    assert got == {i: _measures(t) for i, t in rows}
    kept = {r["doc_id"]: r["kept"] for r in rules.apply_policy(led).collect()}
    assert kept[11] and not kept[10] and not kept[1]
    ablation = {r["rule"]: (r["n_rejected"], r["n_only_this"]) for r in rules.ablation(led).collect()}
    assert ablation["few_words"][0] == sum(1 for i, t in rows if _measures(t)[0] < 50)
    assert rules.ledger(documents([])).count() == 0


def _spans(text):
    out = []
    for order, (kind, pattern, group, least) in enumerate([
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16),
    ]):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return ",".join(x[2] for x in sorted(out))


def test_secret_scan_equals_a_plain_scan(spark, documents):
    key = "AKIA" + "Q7" * 8
    rows = [*ODD, (20, f'é👍 Password = "abcdef123456" x {key} y'), (21, "secret: api_key: abcdefghijkl token=short"), (22, "0123456789abcdef" * 3 + " g" + "a" * 15), (23, "AKIAAKIA" + "B" * 12 + " AKIA" + "C" * 13), (24, "token==" + "a" * 20 + " apikey:'" + "Z" * 12)]
    got = secrets.scan(documents(rows)).collect()
    base = {r["doc_id"]: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["ord"] < 3) for r in got}
    assert len(got) == len(rows) and base == {i: _spans(t) for i, t in rows}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(documents(rows)).collect()}
    assert clean[20] == 'é👍 [assign]" x [access] y' and clean[7] == "same" and clean[1] is None
    assert secrets.scan(documents([])).count() == 0


def test_more_kinds_and_clashing_columns(spark, documents):
    planted = {
        30: ("jwt", "eyJ" + "a" * 10 + "." + "b" * 12 + ".sig"), 31: ("pem", "-----BEGIN RSA PRIVATE KEY-----"), 32: ("forge", "ghp_" + "Z9" * 12),
        33: ("chat", "xoxb-" + "1-a" * 5), 34: ("login", "https://me:pass@host"), 35: ("access", "AKIA" + "X" * 16),
    }
    rows = [(i, f"é before {t} after") for i, (_, t) in planted.items()] + [(40, "eyJ.. ghp_short xox- ://a:b")]
    d = documents(rows).selectExpr("*", "5 as _left", "6 as _id", "7 as row", "8 as rules_left", "9 as _row", "'z' as _text", "0 as _packed", "0 as _spans", "0 as rest", "0 as packed")
    got = secrets.scan(d).collect()
    for r in got:
        kinds = {s["kind"] for s in r["spans"]}
        assert (planted[r["doc_id"]][0] in kinds) if r["doc_id"] != 40 else not kinds
        assert (r["_left"], r["_id"], r["row"], r["rules_left"], r["_row"], r["_text"]) == (5, 6, 7, 8, 9, "z")
    assert {r["doc_id"]: r["text"] for r in secrets.redact(d).collect()}[31] == "é before [pem] after"
    from paperloom.llm import op06_substring as passages

    shared = " ".join(f"w{k}" for k in range(25))
    clash = documents([(1, shared), (2, f"x {shared} y")]).selectExpr("*", "6 as _id", "7 as row", "9 as _row", "'z' as _packed", "0 as _spans", "0 as rest", "0 as packed", "1 as spans2")
    left = {r["doc_id"]: r for r in passages.remove_duplicates(clash).collect()}
    assert left[2]["text"] == "x y" and (left[2]["_id"], left[2]["row"], left[2]["_packed"], left[2]["spans"], left[2]["rest"]) == (6, 7, "z", "x", 0)


def test_damaged_media_has_an_error(spark):
    whole = media.write_avi(media.encode_frames(np.zeros((3, 24, 24), np.uint8)))
    bad = [(1, whole), (2, None), (3, b""), (4, b"RIFF\0\0\0\0AVI "), (5, whole[:400]), (6, whole[:-3]), (7, whole.replace(b"\xff\xc3", b"\xff\xc9"))]
    got = {r["doc_id"]: r for r in media.read_media(spark.createDataFrame([(i, 0, x) for i, x in bad], "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["error"] is None and got[1]["payload_bytes"] == 3 * 576
    assert got[2]["error"] == "no media" and got[3]["error"] and got[5]["payload_sha256"] == got[2]["payload_sha256"] is None or got[5]["error"]
    assert got[4]["payload_bytes"] == 0 and got[4]["clips"] == [] and got[7]["error"] and got[7]["clips"] is None
    rows = media.clips(media.store_media(spark.createDataFrame([(1, "dark" * 4000 + "\xff" * 9000)], "doc_id long, text string"))).collect()
    assert sum(r["n_frames"] for r in rows) == -(-34000 // 576) and rows[0]["start_s"] == 0
    assert [r["end_s"] for r in rows][:-1] == [r["start_s"] for r in rows][1:]


def test_ablation_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{sf}/documents.parquet'")
    got = sorted((r["rule"], r["n_rejected"], r["n_only_this"]) for r in rules.ablation_query(spark, sf).collect())
    assert got == sorted(duckdb.sql(rules.ABLATION_ORACLE).fetchall())


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]{16,}") is None
    assert secrets.trigram_query(r"AKIA[A-Z0-9]{14,}") == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in secrets.trigram_query(secrets.RULES[0].regex)
    assert secrets.trigram_query("ab|cd") is None
