import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom.functions import identity, text, timevalue, url


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_normalize_url(spark):
    cases = {
        " HTTP://User@Example.COM:80/a?b=1&&utm_source=x&c=2#frag ": "http://User@example.com/a?b=1&c=2",
        "https://example.com:443": "https://example.com",
        "https://example.com:8443/x?GCLID=1": "https://example.com:8443/x",
        "http://example.com:/x": "http://example.com/x",
        "http://[2001:DB8::1]:80/x": "http://[2001:db8::1]/x",
        "https://example.com/?%75tm_id=3&q=%20": "https://example.com/?q=%20",
        "ftp://example.com/": None,
        "http:///nohost": None,
        "http://example.com:port/": None,
    }
    out = [r[0] for r in values(spark, list(cases), url.normalize_url(F.col("x")))]
    assert out == list(cases.values())
    again = [r[0] for r in values(spark, [x for x in out if x], url.normalize_url(F.col("x")))]
    assert again == [x for x in out if x]


def test_paging_and_prefixes(spark):
    assert values(spark, ["http://a/?page=2&x=1", "http://a/", "http://a/?x=1"], url.next_page(F.col("x"), "page")) == [("http://a/?page=3&x=1",), ("http://a/?page=2",), ("http://a/?x=1&page=2",)]
    assert values(spark, ["http://a/news/1", "http://a/other"], url.path_allowed(F.col("x"), ["/news"])) == [(True,), (False,)]


def test_address_class(spark):
    rows = ["127.0.0.1", "8.8.8.8", "10.0.0.1", "100.64.1.1", "::ffff:10.0.0.1", "2002:0a00:0001::", "fe80::1", "x", None]
    assert [r[0] for r in values(spark, rows, url.address_class(F.col("x")))] == ["loopback", "public", "private", "shared", "private", "private", "link_local", "invalid", None]


def test_time_shapes(spark):
    utc = lambda *a: dt.datetime(*a)
    cases = {
        "on 2024-03-05T10:30:59+08:00": ("instant", utc(2024, 3, 5, 2, 30), None),
        "2024年3月5日 7时": ("instant", utc(2024, 3, 5, 7), None),
        "2024-3-5": ("day", utc(2024, 3, 5), utc(2024, 3, 6)),
        "2024年12月": ("month", utc(2024, 12, 1), utc(2025, 1, 1)),
        "in 2024": ("year", utc(2024, 1, 1), utc(2025, 1, 1)),
        "2026年13月": ("unknown", None, None),
        "soon": ("unknown", None, None),
        None: ("unknown", None, None),
    }
    t = timevalue.parse_time(F.col("x"))
    assert values(spark, list(cases), t["precision"], t["start"], t["end"]) == list(cases.values())


def test_intersection_edges(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    at = lambda p, s, e: timevalue.intersects(F.lit(p), ts(s), ts(e), ts("2024-01-02"), ts("2024-01-03"))
    row = spark.range(1).select(at("instant", "2024-01-02", None), at("instant", "2024-01-03", None), at("day", "2024-01-01", "2024-01-02"), at("unknown", None, None), at("month", "2024-01-01", "2024-02-01")).first()
    assert list(row) == [True, False, False, False, True]


def test_numbers_quotes_and_scripts(spark):
    assert values(spark, ["5 mV and 40% of 1,000.5 nm"], text.numbers_in(F.col("x"))) == [(["5m", "40%", "1,000.5nm"],)]
    assert values(spark, ["aaaa", "日本日本"], text.quote_count(F.col("x"), F.lit("aa")), text.quote_start(F.col("x"), F.lit("本"))) == [(2, -1), (0, 1)]
    assert [r[0] for r in values(spark, ["hello", "你好世界", "こんにちは", "한국어", "привет", "12"], text.script_language(F.col("x")))] == ["en", "zh", "ja", "ko", "ru", "unknown"]
    assert values(spark, ["", "abc", "a" * 40], text.estimate_tokens(F.col("x"))) == [(0,), (1,), (10,)]


def test_normalisation(spark):
    assert values(spark, ["a\r\nb\x01\rcé"], text.normalize_text(F.col("x"))) == [("a\nb\ncé",)]
    assert values(spark, [" a \n\n b  c "], text.collapse(F.col("x")), text.collapse(F.col("x"), True)) == [("a b c", "a\nb c")]
    df = spark.createDataFrame([(bytearray(b"\xe9"), None), (bytearray(b"\xe9"), "latin-1")], "b binary, c string")
    assert [tuple(r[0]) for r in df.select(text.decode_bytes("b", "c")).collect()] == [("�", "utf-8", True), ("é", "latin-1", False)]


def test_identity_and_retry(spark):
    fields = F.create_map(F.lit("work_id"), F.col("x"), F.lit("version"), F.lit("V 2"), F.lit("action"), F.lit("new"))
    key = lambda kind: identity.identity_key(F.lit(kind), fields)
    assert values(spark, [" A  b ", ""], key("paper_version"), key("other")) == [("paper_version|work_id=a b|version=v 2|action=new", None), (None, None)]
    assert [r[0] for r in spark.range(1, 9).select(identity.backoff_seconds(F.col("id"))).collect()] == [30, 60, 120, 240, 480, 960, 1800, 1800]
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert values(spark, ["120", "Mon, 01 Jan 2024 00:01:00 GMT", "x"], identity.retry_after_seconds(F.col("x"), now)) == [(120,), (60,), (None,)]
    with pytest.raises(ValueError):
        identity.job_key("parse", {"owner": F.lit("o")})


def test_identity_components_fold_case_and_any_space(spark):
    texts = ["Straße", " A\u3000\u00a0B \x85c", "ΟΔΟΣ", "οδος", "ﬁne", None, "\x1c x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(identity.component(F.col("t"))).collect()]
    assert got == [" ".join((t or "").split()).casefold() for t in texts]
    with pytest.raises(Exception, match="unknown event type"):
        spark.createDataFrame([("what",)], "t string").select(identity.identity_key(F.col("t"), F.create_map(F.lit("a"), F.lit("b")))).collect()
    rows_ = spark.createDataFrame([("other",), (None,)], "t string").select(identity.identity_key(F.col("t"), F.create_map(F.lit("a"), F.lit("b")))).collect()
    assert [r[0] for r in rows_] == [None, None]
