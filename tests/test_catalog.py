"""Feeds, aliases, watches, settings, reports and timelines: edges that their queries can't reach."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import catalog


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_feeds_fail_by_the_first_check(spark):
    commands = spark.createDataFrame(
        [(1, "HTTP://X.org:80/f#a", "rss", None, None, 60), (2, "http://x.org/f?utm_source=q", "rss", 7, None, 60), (3, "http://x.org/f", "rss", None, "k", 60), (4, "ftp://x", "none", 9, None, 60), (5, "http://y.org", "api", None, None, 60), (6, "http://old.org/", "rss", None, None, 60), (7, "http://z.org/", "rss", 9, None, 60)],
        "seq int, seed_url string, adapter_type string, template_id long, credential_ref string, interval_seconds int",
    )
    templates = spark.createDataFrame([(7,), (7,)], "template_id long")
    parsers = spark.createDataFrame([(1, "rss", 1, True), (2, "rss", 2, True), (3, "rss", 3, False), (4, "api", 1, False)], "parser_version_id long, adapter_type string, version int, published boolean")
    feeds = spark.createDataFrame([("http://old.org/", "public"), ("http://x.org/f", "credential:other")], "seed_url string, access_scope_key string")
    new, outcomes = catalog.create_feeds(commands, templates, parsers, feeds)
    assert rows(outcomes) == [(1, "created"), (2, "already_exists"), (3, "created"), (4, "invalid_url"), (5, "parser_unavailable"), (6, "already_exists"), (7, "template_missing")]
    assert rows(new.select("seq", "seed_url", "access_scope_key", "parser_version_id")) == [(1, "http://x.org/f", "public", 2), (3, "http://x.org/f", "credential:k", 2)]


def test_aliases_fold_case_and_space(spark):
    a = spark.createDataFrame([(1, "Straße  X", "de", 2), (1, "STRASSE x", "en", 1), (2, "strasse X", "de", 3), (2, " ", "de", 4), (3, None, "de", 5)], "entity_id int, alias string, language string, seq int")
    got = catalog.entity_aliases(a)
    assert rows(got) == [(1, "strasse x", "STRASSE x", "en"), (2, "strasse x", "strasse X", "de")]
    names = spark.createDataFrame([(1, "STRASSE X"), (2, "none"), (3, "")], "name_id int, name string")
    assert rows(catalog.entities_named(got, names)) == [(1, 1), (1, 2)]


def test_watches_are_due_once(spark):
    w = spark.createDataFrame([(1, 1, True, None, 60), (2, 1, True, 40, 60), (3, 1, True, 41, 60), (4, 2, True, None, 60), (5, 9, True, None, 60), (6, 1, False, None, 60)], "watch_id int, industry_id int, enabled boolean, at long, interval_seconds int")
    w = w.withColumn("checked_at", F.timestamp_seconds("at"))
    i = spark.createDataFrame([(1, "active"), (2, "paused")], "industry_id int, status string")
    assert rows(catalog.due_watches(w, i, F.timestamp_seconds(F.lit(100)))) == [(1, 1), (2, 1)]


def test_reports_count_every_statement(spark):
    s = spark.createDataFrame([(1, 0, 0, "a", ["x"]), (1, 0, 1, "b", []), (1, 1, 0, "c", ["x", "z"]), (1, 1, 1, "d", None), (2, 0, 0, "e", ["y", "y"])], "report_id int, section int, ordinal int, text string, citations array<string>")
    p = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, "q")], "report_id int, citation_id string")
    kept, compositions = catalog.compose_reports(s, p)
    assert rows(kept.select("report_id", "text")) == [(1, "a"), (2, "e")]
    assert rows(compositions) == [(1, 4, 1, ["b", "c", "d"], 0.25, False), (2, 1, 1, [], 1.0, True), (3, 0, 0, [], 1.0, True)]


def test_merge_groups_are_stars(spark):
    d = spark.createDataFrame([(i, "k" if i < 50 else None if i < 60 else f"o{i}") for i in range(70)], "event_id int, event_key string")
    got = rows(catalog.merge_groups(d))
    assert len(got) == 49 and {b for _, b in got} == {0}


def test_axes_and_literals(spark):
    e = spark.createDataFrame([(1, "unknown", None, 5), (2, "day", 9, 1), (3, "instant", 3, 7)], "event_id int, precision string, s long, d long")
    e = e.select("event_id", "precision", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("d").alias("discovered_at"))
    order = lambda axis: [r["event_id"] for r in catalog.timeline_order(e, axis).orderBy("group_no", F.asc_nulls_last("sort_key"), "event_id").collect()]
    assert order("occurrence") == [3, 2, 1] and order("discovery") == [2, 1, 3]
    with pytest.raises(ValueError):
        catalog.timeline_order(e, "other")
    v = spark.createDataFrame([([0.5, -2.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in v.select(catalog.vector_literal(F.col("v"))).collect()] == ["[0.5,-2.0]", "[]", None]
    assert v.select(catalog.shown_score(F.lit(0.0)).alias("x")).first()["x"].hex() == (0.0).hex()
    s = spark.createDataFrame([("a", '{"days": 5}'), ("b", '{"days": -5}'), ("c", "no"), ("d", None)], "owner string, values string")
    r = spark.createDataFrame([(x,) for x in "abcde"], "owner string")
    assert rows(catalog.settings_of(r, s, "owner", {"days": 90})) == [("a", 5), ("b", 90), ("c", 90), ("d", 90), ("e", 90)]
