"""Registered queries over feeds, entities, watches, reports and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import identity
from paperloom.operators import catalog, relational
from paperloom.plans.catalogue import _revisions, at, query
from paperloom.plans.catalogue import _REV as REVISIONS
from paperloom.plans.commits import ORACLES, QUERIES
from paperloom.tables import load

_FEEDS = r"""c AS (SELECT page_id AS seq, CASE WHEN page_id % 17 = 0 THEN 'mailto:x' ELSE url END AS url, CASE page_id % 5 WHEN 0 THEN 'atom' WHEN 1 THEN 'api' ELSE 'rss' END AS adapter, CASE WHEN page_id % 7 = 0 THEN page_id % 2 END AS template, CASE WHEN page_id % 4 = 0 THEN 'k' || page_id % 2 END AS cred FROM pages),
k AS (SELECT *, CASE WHEN url LIKE 'http%' THEN regexp_replace(regexp_replace(url, '#.*$', ''), '[?].*$', '') END AS canonical, coalesce('credential:' || cred, 'public') AS scope FROM c),
f AS (SELECT *, CASE WHEN canonical IS NULL THEN 'invalid_url' WHEN template = 1 THEN 'template_missing' WHEN adapter = 'api' THEN 'parser_unavailable' WHEN canonical LIKE '%e' AND scope = 'public' THEN 'already_exists' END AS failed FROM k),
o AS (SELECT *, coalesce(failed, CASE WHEN row_number() OVER (PARTITION BY canonical, scope ORDER BY failed IS NOT NULL, seq) > 1 THEN 'already_exists' ELSE 'created' END) AS outcome FROM f)"""


def _feeds(spark: SparkSession, d: str):
    i = F.col("page_id")
    pages = load(spark, d, "pages")
    plain = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), r"[?].*$", "")
    c = pages.select(i.alias("seq"), F.when(i % 17 == 0, "mailto:x").otherwise(plain).alias("seed_url"), F.when(i % 5 == 0, "atom").when(i % 5 == 1, "api").otherwise("rss").alias("adapter_type"), F.when(i % 7 == 0, i % 2).alias("template_id"), F.when(i % 4 == 0, F.concat(F.lit("k"), (i % 2).cast("string"))).alias("credential_ref"), F.lit(600).alias("interval_seconds"))
    templates = spark.range(1).withColumnRenamed("id", "template_id")
    parsers = spark.createDataFrame([(1, "rss", 1, True), (2, "rss", 3, True), (3, "rss", 9, False), (4, "atom", 1, True), (5, "api", 1, False)], "parser_version_id long, adapter_type string, version int, published boolean")
    return catalog.create_feeds(c, templates, parsers, pages.select(plain.alias("seed_url"), F.lit("public").alias("access_scope_key")).filter(F.col("seed_url").like("%e")))


@query(f"WITH {_FEEDS} SELECT seq, outcome FROM o")
def feed_outcomes(spark, d):
    """Every page's address as a feed to be created, with adapters, templates and credentials of all kinds."""
    return _feeds(spark, d)[1]


@query(f"WITH {_FEEDS} SELECT canonical AS seed_url, scope AS access_scope_key, CASE adapter WHEN 'rss' THEN 2 ELSE 4 END::BIGINT AS parser_version_id FROM o WHERE outcome = 'created'")
def created_feeds(spark, d):
    return _feeds(spark, d)[0].select("seed_url", "access_scope_key", "parser_version_id")


_ALIASES = "a AS (SELECT s_nationkey AS entity_id, lower(regexp_replace(s_name, '0', '', 'g')) AS n, s_suppkey AS seq FROM supplier UNION ALL SELECT p_size, lower(p_brand), p_partkey FROM part)"


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    s, p = load(spark, d, "supplier"), load(spark, d, "part")
    rows = s.select(F.col("s_nationkey").alias("entity_id"), F.upper(F.regexp_replace("s_name", "0", "")).alias("alias"), F.col("s_suppkey").alias("seq"))
    rows = rows.unionByName(p.select(F.col("p_size").alias("entity_id"), F.concat(F.lit("  "), F.col("p_brand")).alias("alias"), F.col("p_partkey").alias("seq")))
    return catalog.entity_aliases(rows.withColumn("language", F.lit("en")))


@query(f"WITH {_ALIASES} SELECT DISTINCT entity_id, n AS normalized_alias FROM a")
def entity_alias_keys(spark, d):
    return _aliases(spark, d).select("entity_id", "normalized_alias")


@query(f"WITH {_ALIASES} SELECT DISTINCT p_partkey AS name_id, entity_id FROM part JOIN a ON lower(p_brand) = n")
def entities_named(spark, d):
    """Brands in capitals as names that texts use, and whose they are."""
    names = load(spark, d, "part").select(F.col("p_partkey").alias("name_id"), F.upper("p_brand").alias("name"))
    return catalog.entities_named(_aliases(spark, d), names)


@query("SELECT o_orderkey AS watch_id, o_custkey AS industry_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_orderstatus <> 'P' AND (o_orderpriority = '5-LOW' OR epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate) >= 86400 * (1 + o_orderkey % 900))")
def due_watches(spark, d):
    """Orders as watches, each of one customer; those never checked, and those whose interval is over."""
    o = load(spark, d, "orders")
    w = o.select(F.col("o_orderkey").alias("watch_id"), F.col("o_custkey").alias("industry_id"), (F.col("o_orderstatus") != "P").alias("enabled"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate").cast("timestamp")).alias("checked_at"), (86400 * (1 + F.col("o_orderkey") % 900)).alias("interval_seconds"))
    i = load(spark, d, "customer").select(F.col("c_custkey").alias("industry_id"), F.when(F.col("c_acctbal") > 0, "active").otherwise("paused").alias("status"))
    return catalog.due_watches(w, i, at("1998-01-01 00:00:00"))


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL OR c_custkey % 4 = 0 THEN 90 WHEN c_custkey % 4 = 1 THEN (c_custkey % 60)::INT WHEN c_custkey % 4 = 2 THEN 90 ELSE 90 END AS backfill_days, CASE WHEN c_custkey % 4 = 3 THEN 7 ELSE 30 END AS poll_days FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > -500) ON o_custkey = c_custkey")
def settings_lookup(spark, d):
    """Settings of an order's customer: given, negative, malformed, missing, or no settings at all."""
    i = F.col("c_custkey")
    given = F.when(i % 4 == 1, F.concat(F.lit('{"backfill_days": '), (i % 60).cast("string"), F.lit("}"))).when(i % 4 == 2, '{"backfill_days": -5}').when(i % 4 == 3, '{"backfill_days": "soon", "poll_days": 7}').otherwise("not json")
    settings = load(spark, d, "customer").filter("c_acctbal > -500").select(i.alias("owner"), given.alias("values"))
    rows = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("owner"))
    return catalog.settings_of(rows, settings, "owner", {"backfill_days": 90, "poll_days": 30}).select("o_orderkey", "backfill_days", "poll_days")


@query("SELECT c_custkey AS industry_id, (22 + CASE c_nationkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 0 ELSE -5 END) % 24 AS local_hour, CASE WHEN c_nationkey % 3 = 0 THEN '2024-01-16' ELSE '2024-01-15' END AS local_date FROM customer")
def local_days(spark, d):
    """Customers as industries, nations as their users: the hour and the date on each user's wall."""
    n = F.col("n_nationkey")
    users = load(spark, d, "nation").filter(n % 3 != 1).select(n.alias("user_id"), F.when(n % 3 == 0, "Asia/Shanghai").otherwise("America/New_York").alias("timezone"))
    i = load(spark, d, "customer").select(F.col("c_custkey").alias("industry_id"), F.col("c_nationkey").alias("user_id"))
    return catalog.local_days(i, users, at("2024-01-15 22:30:00")).select("industry_id", "local_hour", "local_date")


@query("WITH k AS (SELECT p_partkey, lower(p_brand) || '|' || lower(p_type) AS key FROM part), f AS (SELECT key, min(p_partkey) AS first FROM k GROUP BY key) SELECT p_partkey AS event_id, first AS into_id FROM k JOIN f USING (key) WHERE p_partkey <> first")
def auto_merge_groups(spark, d):
    """Parts whose brand and type are equal, case aside, as events of one identity: all into the first."""
    key = F.concat_ws("|", identity.component(F.col("p_brand")), identity.component(F.col("p_type")))
    return catalog.merge_groups(load(spark, d, "part").select(F.col("p_partkey").alias("event_id"), key.alias("event_key")))


_STATEMENTS = """s AS (SELECT o_orderkey AS report_id, l_linenumber % 2 AS section, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ordinal, l_linenumber, l_quantity, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
j AS (SELECT *, l_returnflag <> 'N' AND (l_returnflag <> 'R' OR l_quantity <= 25) AS ok FROM s)"""


@query(f"WITH {_STATEMENTS} SELECT report_id, count(*) AS total, count(*) FILTER (ok) AS cited, count(*) FILTER (ok) / count(*) AS coverage, bool_and(ok) AS publishable FROM j GROUP BY report_id")
def report_compositions(spark, d):
    """Lines as statements: some cite nothing, some what isn't in the packet."""
    from pyspark.sql import Window

    li = load(spark, d, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    cites = F.when(F.col("l_returnflag") == "N", F.array().cast("array<string>")).when(F.col("l_returnflag") == "R", F.array(F.lit("e1"), F.when(F.col("l_quantity") > 25, "e9").otherwise("e2"))).otherwise(F.array(F.lit("e1"), F.lit("e1")))
    s = li.select(F.col("l_orderkey").alias("report_id"), (F.col("l_linenumber") % 2).alias("section"), F.row_number().over(order).alias("ordinal"), F.lit("t").alias("text"), cites.alias("citations"))
    packets = load(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.explode(F.array(F.lit("e1"), F.lit("e2"))).alias("citation_id")).join(s.select("report_id").distinct(), "report_id", "left_semi")
    return catalog.compose_reports(s, packets)[1].select("report_id", "total", "cited", "coverage", "publishable")


@query(f"WITH {REVISIONS}, o AS (SELECT event_id, ts + INTERVAL (event_id % 50) HOUR AS found FROM r) SELECT event_id, row_number() OVER (ORDER BY found, event_id) AS place FROM o QUALIFY place <= 300")
def timeline_discovery_axis(spark, d):
    """The first page of the discovery axis: by when things were found, whatever their own time."""
    r = _revisions(spark, d)
    found = F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 50) * 3_600_000_000)
    rows = catalog.timeline_order(r.select("event_id", "precision", F.col("s").alias("start"), found.alias("discovered_at")), "discovery")
    page = relational.page_after(rows.select("event_id", "group_no", "sort_key"), [("group_no", True), ("sort_key", True), ("event_id", True)], None, 300)
    from pyspark.sql import Window

    return page.select("event_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("group_no", "sort_key", "event_id")).cast("long").alias("place"))


@query(f"WITH {REVISIONS} SELECT event_id, CASE WHEN precision = 'unknown' THEN 1 ELSE 0 END AS group_no, epoch_us(s) AS sort_key FROM r")
def timeline_occurrence_keys(spark, d):
    r = _revisions(spark, d).select("event_id", "precision", F.col("s").alias("start"), F.col("ts").alias("discovered_at"))
    return catalog.timeline_order(r, "occurrence").select("event_id", "group_no", "sort_key")


@query("SELECT vec_id, '[' || array_to_string([CASE WHEN x = floor(x) THEN x::BIGINT || '.0' ELSE 'x' END for x in embedding], ',') || ']' AS literal FROM (SELECT vec_id, [label::DOUBLE, vec_id::DOUBLE, -1.0::DOUBLE] AS embedding FROM embeddings)")
def vector_literals(spark, d):
    v = load(spark, d, "embeddings").select("vec_id", F.array(F.col("label").cast("float"), F.col("vec_id").cast("float"), F.lit(-1.0).cast("float")).alias("v"))
    return v.select("vec_id", catalog.vector_literal(F.col("v")).alias("literal"))


__all__ = ["ORACLES", "QUERIES"]
