"""Record operators: what their queries can't reach."""

from pyspark.sql import functions as F

from paperloom.operators import records


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_discovery_moves_boundaries_back_only(spark):
    at = lambda day: F.to_timestamp(F.lit(f"2024-01-{day:02d}"))
    e = spark.createDataFrame([("f", "http://x.org/1#a", 9), ("f", "http://x.org/2", 1), ("f", "http://X.org/3?utm_source=q", 8), ("g", "http://x.org/v", 2), ("f", "http://x.org/4", None), ("f", "nowhere", 9)], "feed string, url string, day int")
    entries = e.select("feed", "url", F.when(F.col("day").isNotNull(), F.make_timestamp(F.lit(2024), F.lit(1), F.col("day"), F.lit(0), F.lit(0), F.lit(0))).alias("published"))
    known = spark.createDataFrame([("f", "http://x.org/3")], "feed string, canonical_url string")
    new, moved = records.discover(entries, known, spark.range(1).select(F.lit("f").alias("feed"), at(10).alias("at")), "feed")
    assert rows(new.select("feed", "canonical_url")) == [("f", "http://x.org/1"), ("f", "http://x.org/4"), ("g", "http://x.org/v")]
    assert rows(moved.select("feed", F.dayofmonth("at"))) == [("f", 8), ("g", 2)]


def test_cited_only_drops_uncited_and_foreign_blocks(spark):
    b = spark.createDataFrame([(1, 1, ["e1"]), (1, 2, []), (1, 3, ["e1", "e9"]), (2, 1, ["e1"]), (3, 1, None)], "answer int, block int, cited array<string>")
    citable = spark.createDataFrame([(1, "e1"), (1, "e2")], "answer int, ref string")
    assert rows(records.cited_only(b, citable, "answer", "ref")) == [(1, 1, "answered"), (2, 0, "insufficient_evidence"), (3, 0, "insufficient_evidence")]


def test_damaged_cursors_are_empty(spark):
    d = spark.createDataFrame([(None,), ("",), ("***",), ("bm90IGpzb24=",)], "c string").select(records.decode_cursor(F.col("c"), "id long").alias("x"))
    assert [r["x"] is None or r["x"]["id"] is None for r in d.collect()] == [True] * 4


def test_blobs_are_stored_once_across_calls(spark, tmp_path):
    from paperloom.sources import readers

    b = spark.createDataFrame([("text/plain", b"a"), ("text/plain", b"a"), ("text/html", b"a"), ("text/plain", b"b")], "media_type string, content binary")
    readers.write_blobs(b, str(tmp_path / "blobs"))
    readers.write_blobs(b.unionByName(spark.createDataFrame([("text/plain", b"c")], b.schema)), str(tmp_path / "blobs"))
    got = readers.read_blobs(spark, str(tmp_path / "blobs"))
    assert got.count() == 4 and got.select("key").distinct().count() == 4
