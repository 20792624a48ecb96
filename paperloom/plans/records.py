"""Queries over the record operators, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import identity, text, timevalue, url
from paperloom.operators import knowledge, queue, records, relational, retrieval
from paperloom.plans.catalogue import ORACLES, QUERIES, query, seconds
from paperloom.tables import Scope, load, scoped

# --- scans, lists, search --------------------------------------------------------------------------------------------


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'src3' AND lang = 'en'")
def scoped_scan(spark, d):
    rows = load(spark, d, "documents").withColumns({"owner_id": F.col("source"), "industry_id": F.col("lang")})
    return scoped(rows, Scope("src3", "en")).select("doc_id", "n_chars")


@query("SELECT doc_id, lang FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)")
def same_content_scan(spark, d):
    """By the secondary key, the content's hash, not by the id."""
    docs = load(spark, d, "documents").withColumn("digest", text.content_hash(F.col("text")))
    return docs.join(docs.filter("doc_id % 10 = 0").select("digest").distinct(), "digest", "left_semi").select("doc_id", "lang")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' AND o_custkey % 7 <> 0")
def filtered_list(spark, d):
    o = load(spark, d, "orders").withColumn("deleted_at", F.when(F.col("o_custkey") % 7 == 0, F.col("o_orderdate")))
    return records.listed(o, {"o_orderstatus": "O", "o_custkey": None}, {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, "deleted_at").select("o_orderkey")


@query("SELECT o_orderkey, o_orderdate::VARCHAR AS moment FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_list(spark, d):
    o = records.listed(load(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": None})
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query("SELECT doc_id FROM documents WHERE text ILIKE '%A_c%5%' OR source ILIKE '%A_c%5%' OR source ILIKE '%SRC1%'")
def two_column_search(spark, d):
    return load(spark, d, "documents").filter(records.like_any(["text", "source"], "A_c%5") | records.like_any(["source"], "SRC1")).select("doc_id")


@query("""SELECT 0 AS ordinal, 'document' AS kind, doc_id AS id, n_chars AS moment FROM documents WHERE text ILIKE '%Ation%'
UNION ALL SELECT 1, 'turn', conv_id * 100 + turn, turn FROM conversations WHERE text ILIKE '%Ation%'""")
def unified_search(spark, d):
    """Every hit of both kinds."""
    hits = lambda name, i, m: load(spark, d, name).filter(records.like_any(["text"], "Ation")).select(F.expr(i).alias("id"), F.col(m).alias("moment"))
    return records.unified([("document", hits("documents", "doc_id", "n_chars")), ("turn", hits("conversations", "conv_id * 100 + turn", "turn"))], None)


@query("SELECT event_id, 'view' AS kind FROM (SELECT event_id FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id LIMIT 50) UNION ALL SELECT event_id, 'click' FROM (SELECT event_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 50)")
def newest_of_each_kind(spark, d):
    e = load(spark, d, "events")
    top = lambda kind: e.filter(F.col("event_type") == kind).orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", F.lit(kind).alias("kind"))
    return top("view").unionByName(top("click"))


# --- joins ---------------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, c_custkey AS document_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3""")
def recall_chain(spark, d):
    """Line items as chunks, orders as parses, customers as captures and documents of one scope."""
    c = load(spark, d, "customer")
    docs = records.listed(c, {"c_mktsegment": "BUILDING", "c_nationkey": 3}).select(F.col("c_custkey").alias("document_id"))
    parses = load(spark, d, "orders").select(F.col("o_orderkey").alias("parse_id"), F.col("o_custkey").alias("capture_id"))
    chunks = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("parse_id"), "l_linenumber")
    return records.chain(chunks, parses, c.select(F.col("c_custkey").alias("capture_id"), F.col("c_custkey").alias("document_id")), docs).select(F.col("parse_id").alias("l_orderkey"), "l_linenumber", "document_id")


_COS = "1 - list_sum([e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE for i in range(1, 65)]) / (sqrt(list_sum([e.embedding[i]::DOUBLE * e.embedding[i] for i in range(1, 65)])) * sqrt(list_sum([q.embedding[i]::DOUBLE * q.embedding[i] for i in range(1, 65)])))"


@query(f"""SELECT doc_id, round({_COS}, 5) AS distance FROM embeddings e JOIN documents ON vec_id = doc_id JOIN labels USING (doc_id), (SELECT embedding FROM embeddings WHERE vec_id = 5) q WHERE lang = 'en' AND quality = 1""")
def vector_chain(spark, d):
    """Vectors of the documents in scope, by distance to one query vector; scope first, so few vectors are measured."""
    v = load(spark, d, "embeddings")
    q = v.filter("vec_id = 5").select(F.col("embedding").alias("q"))  # one row
    docs = load(spark, d, "documents").filter("lang = 'en'").select("doc_id").join(load(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id")
    near = v.withColumnRenamed("vec_id", "doc_id").join(docs, "doc_id").join(F.broadcast(q))
    return near.select("doc_id", F.round(retrieval.cosine_distance(F.col("embedding"), F.col("q")), 5).alias("distance"))


_CURRENT = "p AS (SELECT o_custkey, max(o_orderkey) AS current_id FROM orders GROUP BY o_custkey)"


@query(f"WITH {_CURRENT} SELECT c_custkey, o_orderkey, o_orderstatus FROM customer JOIN p ON c_custkey = p.o_custkey JOIN orders ON o_orderkey = current_id")
def current_revision(spark, d):
    o = load(spark, d, "orders")
    rows = load(spark, d, "customer").join(o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("current_id")), "c_custkey")
    return records.current(rows, o.select("o_orderkey", "o_orderstatus"), "current_id", "o_orderkey").select("c_custkey", F.col("current_id").alias("o_orderkey"), "o_orderstatus")


@query(f"WITH {_CURRENT} SELECT c_custkey, coalesce(o_orderstatus, 'draft') AS status FROM customer LEFT JOIN p ON c_custkey = p.o_custkey LEFT JOIN orders ON o_orderkey = current_id")
def report_views(spark, d):
    """A report may have no revision yet: defaults."""
    o = load(spark, d, "orders")
    rows = load(spark, d, "customer").join(o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("current_id")), "c_custkey", "left")
    return records.current(rows, o.select("o_orderkey", "o_orderstatus"), "current_id", "o_orderkey", False).select("c_custkey", F.coalesce("o_orderstatus", F.lit("draft")).alias("status"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS version FROM orders")
def revision_history(spark, d):
    return records.history(load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "version")


@query("SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def distinct_fanout(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return load(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey").select("l_suppkey", "o_custkey").distinct()


@query("SELECT l_orderkey, l_linenumber, c_name AS origin FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def origin_lookup(spark, d):
    o, c = load(spark, d, "orders").select("o_orderkey", "o_custkey"), load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("origin"))
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").join(o.join(c, "o_custkey"), "o_orderkey").select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "origin")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal > 9000")
def watch_fanout(spark, d):
    """Watches (customers) of active industries (suppliers of high balance)."""
    active = load(spark, d, "supplier").filter("s_acctbal > 9000").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"))
    return records.fan_out(load(spark, d, "customer").select("c_custkey", "c_nationkey"), active, "c_nationkey", "c_custkey").select("c_custkey", "s_suppkey")


@query("SELECT event_id, coalesce(try_cast(regexp_extract(props, '\"k\": ?([0-9]+)', 1) AS INT), 90) AS backfill_days, epoch_us(ts) AS until FROM events")
def settings_defaults(spark, d):
    """A setting of the JSON map with its default, and the start it gives."""
    e = load(spark, d, "events")
    days = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(90))
    return e.select("event_id", days.alias("backfill_days"), F.unix_micros(F.col("ts").cast("timestamp")).alias("until"))


@query("SELECT event_id, floor(epoch(ts - to_days((coalesce(try_cast(regexp_extract(props, '\"k\": ?([0-9]+)', 1) AS INT), 90))::INT)))::BIGINT AS backfill_from FROM events")
def default_backfill(spark, d):
    days = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(90))
    return load(spark, d, "events").select("event_id", seconds(F.col("ts").cast("timestamp") - F.make_dt_interval(days)).alias("backfill_from"))


@query("SELECT l_orderkey, count(*) FILTER (p_size > 25)::BIGINT AS kept, count(*) FILTER (p_size <= 25)::BIGINT AS dropped FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def committed_claims(spark, d):
    known = load(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return records.committed(load(spark, d, "lineitem").select("l_orderkey", "l_partkey"), known, "l_orderkey", "l_partkey")


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey + 1 = b.p_partkey")
def auto_merge_pairs(spark, d):
    """Neighbouring events of one type whose identity components are all equal may merge by themselves."""
    k = load(spark, d, "part").select("p_partkey", F.concat_ws("|", *[identity.component(F.col(c).cast("string")) for c in ("p_brand", "p_type")]).alias("key"))
    a, b = k.select(F.col("p_partkey").alias("a"), "key", (F.col("p_partkey") + 1).alias("b")), k.select(F.col("p_partkey").alias("b"), "key")
    return a.join(b, ["b", "key"]).select("a", "b")


# --- numbers, budgets, runs, watermarks ------------------------------------------------------------------------------------


@query("SELECT conv_id, max(turn) + 1 AS next_seq, min(turn) AS first_seq, count(*) FILTER (role = 'user') AS pending FROM conversations GROUP BY conv_id")
def next_turns(spark, d):
    return records.next_number(load(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 40 AS allowed FROM events")
def call_budget(spark, d):
    return records.within_budget(load(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", [F.col("ts"), F.col("event_id")], 40).select("event_id", "allowed")


@query("""WITH s AS (SELECT unnest(['click', 'view', 'error', 'purchase', 'never']) AS stage) SELECT stage, count(event_id) AS n FROM s LEFT JOIN events ON event_type = stage GROUP BY stage""")
def leak_stages(spark, d):
    stages = spark.createDataFrame([(x,) for x in ("click", "view", "error", "purchase", "never")], "stage string")  # the whole domain
    n = load(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"))
    return stages.join(n, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT user_id, day, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS finished, count(*) AS discovered, count(*) FILTER (event_type = 'error') AS failures,
CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'complete' WHEN count(*) FILTER (event_type = 'error') < count(*) THEN 'partial' ELSE 'failed' END AS status FROM (SELECT *, floor(epoch(date_trunc('day', ts)) / 86400)::BIGINT AS day FROM events) GROUP BY user_id, day""")
def source_runs(spark, d):
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.select("user_id", F.floor(F.unix_seconds("ts") / 86400).alias("day"), F.unix_micros("ts").alias("moment"), "event_type")
    return records.run_summaries(e, ["user_id", "day"], F.col("event_type") == "error")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'missing' WHEN l_returnflag = 'R' THEN 'superfluous' ELSE 'stale' END AS change FROM (SELECT DISTINCT l_orderkey, l_linenumber, first_value(l_returnflag) OVER k AS l_returnflag, first_value(l_linestatus) OVER k AS l_linestatus FROM lineitem WINDOW k AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice))
WHERE (l_linenumber % 3 = 0 AND l_returnflag <> 'R') OR (l_linenumber % 3 <> 0 AND (l_returnflag = 'R' OR l_linestatus = 'F'))""")
def index_drift(spark, d):
    """Chunk ordinals and their versions in the index against those wanted."""
    li = relational.first_by(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.struct(*[-F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]))
    keys = ["l_orderkey", "l_linenumber"]
    existing = li.filter("l_linenumber % 3 <> 0").select(*keys, F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("version"))
    return records.drift(existing, li.filter("l_returnflag <> 'R'").select(*keys, F.lit(2).alias("version")), keys, "version")


@query("""SELECT page_id, host FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id DESC) = 1""")
def latest_capture(spark, d):
    p = load(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return relational.latest(p, ["host"], [F.desc("page_id")])


@query("SELECT p_brand, p_type, max(p_size) AS version, max_by(p_partkey, (p_size, p_partkey)) AS p_partkey FROM part GROUP BY ALL")
def published_parsers(spark, d):
    """The highest published version of each kind."""
    p = load(spark, d, "part").select("p_brand", "p_type", F.col("p_size").alias("version"), "p_partkey")
    return relational.first_by(p, ["p_brand", "p_type"], F.struct("version", "p_partkey")).select("p_brand", "p_type", "version", "p_partkey")


_CANON_URL = "regexp_replace(regexp_replace(url, '#.*$', ''), '[?].*$', '')"


@query(f"""WITH e AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS feed, {_CANON_URL} AS canonical_url, page_id AS n FROM pages), b AS (SELECT feed, max(n) AS edge FROM e WHERE n % 3 = 0 GROUP BY feed)
SELECT feed, canonical_url, min(n) AS published FROM e LEFT JOIN b USING (feed) WHERE edge IS NULL OR n >= edge - 72 GROUP BY feed, canonical_url HAVING (feed, canonical_url) NOT IN (SELECT (feed, canonical_url) FROM e WHERE n % 3 = 0)""")
def discovery_step(spark, d):
    """One page an hour: what a feed shows behind its boundary less 72 hours, and isn't known."""
    new, _ = records.discover(*_discovery(spark, d), "feed")
    return new.select("feed", "canonical_url", (F.unix_seconds("published") / 3600).cast("long").alias("published"))


def _discovery(spark, d):
    e = load(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("feed"), F.regexp_replace("url", "[?#].*$", "").alias("url"), F.timestamp_seconds(F.col("page_id") * 3600).alias("published"))
    known = e.filter(F.unix_seconds("published") / 3600 % 3 == 0)
    return e, known.withColumnRenamed("url", "canonical_url"), known.groupBy("feed").agg(F.max("published").alias("at"))


@query("""WITH e AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS feed, page_id AS n FROM pages), b AS (SELECT feed, max(n) AS edge FROM e WHERE n % 3 = 0 GROUP BY feed)
SELECT feed, least(edge, min(n)) AS at FROM e LEFT JOIN b USING (feed) WHERE edge IS NULL OR n >= edge - 72 GROUP BY feed, edge""")
def discovery_boundaries(spark, d):
    """The boundaries after that step: they only move back."""
    _, moved = records.discover(*_discovery(spark, d), "feed")
    return moved.select("feed", (F.unix_seconds("at") / 3600).cast("long").alias("at"))


# --- events, answers, revisions --------------------------------------------------------------------------------------------



@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 7 ELSE c_nationkey END AS c_nationkey, 2 AS version FROM customer
WHERE (c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING') OR (c_custkey % 3 = 0 AND c_nationkey <> 7)""")
def changed_revisions(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", F.lit(1).alias("version"))
    patch = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "BUILDING").alias("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, 7).alias("c_nationkey"))
    return records.append_changed(c, patch, "c_custkey", ["c_mktsegment", "c_nationkey"])


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, max(l_returnflag = 'N') AS cites FROM lineitem GROUP BY ALL), ok AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 20),
p AS (SELECT b.l_orderkey, l_linenumber, count(*) FILTER (cites) AS n, count(ok.l_partkey) FILTER (cites) AS k FROM b LEFT JOIN ok ON b.l_orderkey = ok.l_orderkey AND b.l_partkey = ok.l_partkey GROUP BY ALL)
SELECT l_orderkey, count(*) FILTER (n > 0 AND n = k) AS kept, CASE WHEN count(*) FILTER (n > 0 AND n = k) = 0 THEN 'insufficient_evidence' ELSE 'answered' END AS status FROM p GROUP BY l_orderkey""")
def cited_answers(spark, d):
    """Orders as answers, their lines as blocks that cite parts; a packet holds the parts of large quantity."""
    li = load(spark, d, "lineitem")
    blocks = li.groupBy("l_orderkey", F.col("l_linenumber").alias("block"), "l_partkey").agg(F.max(F.col("l_returnflag") == "N").alias("c"))
    blocks = blocks.groupBy("l_orderkey", "block").agg(F.collect_set(F.when(F.col("c"), F.col("l_partkey"))).alias("cited"))
    return records.cited_only(blocks, li.filter("l_quantity > 20").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'uncertain' END AS status FROM events")
def sanitised_status(spark, d):
    return load(spark, d, "events").select("event_id", records.sanitised(F.col("event_type"), ("click", "view"), "uncertain").alias("status"))


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS \"group\", CASE WHEN event_id % 7 <> 0 THEN user_id END AS id FROM events")
def cursor_round_trip(spark, d):
    """Cursors back to their fields; every seventh is damaged and gives none."""
    e = load(spark, d, "events")
    c = records.encode_cursor({"group": F.col("event_type"), "id": F.col("user_id")})
    c = F.when(F.col("event_id") % 14 == 0, F.concat(F.lit("*"), c)).when(F.col("event_id") % 7 == 0, F.base64(F.lit("no json"))).otherwise(c)
    return e.select("event_id", records.decode_cursor(c, "group string, id long").alias("c")).select("event_id", "c.group", "c.id")


@query("SELECT conv_id AS claim_id, count(*) AS n_evidence, count(DISTINCT role) AS n_families FROM conversations GROUP BY conv_id")
def evidence_families(spark, d):
    return knowledge.independence(load(spark, d, "conversations").select(F.col("conv_id").alias("claim_id"), F.col("role").alias("origin")))


@query("SELECT event_id, sha256(user_id || '|' || event_type || '|' || props) AS request_hash FROM events")
def request_hashes(spark, d):
    return load(spark, d, "events").select("event_id", text.content_hash(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props")).alias("request_hash"))


@query("""WITH s AS (SELECT event_id AS k, event_type AS body, event_id % 3 > 0 AS live FROM events WHERE event_id % 2 = 0), r AS (SELECT event_id, event_id % 1000 AS k, event_type AS body FROM events)
SELECT event_id AS request_id, CASE WHEN s.k IS NULL OR NOT live THEN 'miss' WHEN s.body = r.body THEN 'replay' ELSE 'conflict' END AS outcome FROM r LEFT JOIN s USING (k)""")
def idempotent_replay(spark, d):
    e, now = load(spark, d, "events"), F.to_timestamp(F.lit("2024-06-01"))
    key = lambda k: [F.lit("o").alias("owner_id"), F.lit("r").alias("route"), k.alias("idempotency_key")]
    until = F.when(F.col("event_id") % 3 > 0, F.to_timestamp(F.lit("2024-07-01"))).otherwise(F.to_timestamp(F.lit("2024-05-01")))
    stored = e.filter("event_id % 2 = 0").select(*key(F.col("event_id")), F.col("event_type").alias("body_hash"), until.alias("expires_at"))
    return relational.replay_guard(e.select(F.col("event_id").alias("request_id"), *key(F.col("event_id") % 1000), F.col("event_type").alias("body_hash")), stored, now)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND k = 'pause' THEN 'P' WHEN o_orderstatus = 'P' AND k = 'resume' THEN 'O' ELSE o_orderstatus END AS o_orderstatus, (o_orderstatus = 'O' AND k = 'pause') OR (o_orderstatus = 'P' AND k = 'resume') AS ok
FROM (SELECT *, CASE o_orderkey % 2 WHEN 0 THEN 'pause' ELSE 'resume' END AS k FROM orders)""")
def status_transitions(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    commands = o.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "pause").otherwise("resume").alias("command"))
    return relational.transition(o, commands, [("O", "pause", "P"), ("P", "resume", "O")], "o_orderkey", "o_orderstatus")


@query("SELECT event_id, seq FROM (SELECT event_id, user_id, event_id AS seq FROM events WHERE user_id = 7) WHERE seq > (SELECT min(event_id) FROM events WHERE user_id = 7) ORDER BY seq LIMIT 100")
def replay_log(spark, d):
    """One subscriber's next batch of 100 after its cursor."""
    log = load(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"))
    first = log.filter("job_id = '7'").agg(F.min("seq")).first()[0] or 0
    return queue.events_after(log, "7", first).select("event_id", "seq")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 5 MINUTES AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1)")
def debounced_topics(spark, d):
    marked = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("topic_id"), F.col("o_orderdate").cast("timestamp").alias("marked_at"))
    running = load(spark, d, "customer").filter("c_nationkey = 1").select(F.col("c_custkey").alias("topic_id"))
    return knowledge.debounced(marked, running, F.to_timestamp(F.lit("1998-01-01 00:00:00"))).select("o_orderkey")


@query("""WITH b AS (SELECT conv_id, turn, text, substring(text, 5, 20) AS quote FROM conversations)
SELECT conv_id, turn, (strpos(text, quote) - 1)::INT AS start, (strpos(text, quote) - 1 + length(quote))::INT AS "end" FROM b WHERE length(quote) > 0 AND (length(text) - length(replace(text, quote, ''))) // length(quote) = 1""")
def quote_spans(spark, d):
    t = load(spark, d, "conversations").withColumn("block_id", F.concat_ws("/", "conv_id", "turn"))
    ev = t.select(F.col("conv_id").alias("claim_id"), F.col("turn").alias("ordinal"), "block_id", F.substring("text", 5, 20).alias("quote"))
    return knowledge.quote_locations(ev, t.select("block_id", "text")).select(F.col("claim_id").alias("conv_id"), F.col("ordinal").alias("turn"), "start", "end")


@query("""WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') / count(*) AS coverage, count(*) FILTER (o_orderpriority = '1-URGENT') AS n FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN n = 0 OR coverage < 0.5 THEN 'insufficient' ELSE 'built' END AS status FROM c""")
def build_statuses(spark, d):
    o = load(spark, d, "orders")
    edges = o.select("o_custkey", F.when(F.col("o_orderpriority") != "1-URGENT", "no_basis").alias("reason"))
    coverage = o.groupBy("o_custkey").agg(F.avg((F.col("o_orderstatus") != "P").cast("double")).alias("coverage"))
    return knowledge.build_status(edges, coverage, "o_custkey")


# --- scalar functions over whole tables ------------------------------------------------------------------------------------


@query(r"SELECT page_id, regexp_matches(url, '^https?://[^/?#]*/(en|fr)(/|$)') AS allowed, regexp_matches(lower(regexp_replace(url, '^[a-z]+://([^?#]*).*$', '\1')), '(^|[./_-])(login|log-in|signin|sign-in|auth|sso|account)([./?_-]|$)') AS login FROM pages")
def url_checks(spark, d):
    u = F.col("url")
    return load(spark, d, "pages").select("page_id", (url.path_allowed(u, ["/en/", "/fr/"])).alias("allowed"), url.looks_like_login(u).alias("login"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=[0-9]+') THEN regexp_replace(url, '([?&]page=)[0-9]+', '\1' || (regexp_extract(url, '[?&]page=([0-9]+)', 1)::BIGINT + 1)) ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'page=2' END AS next FROM pages""")
def next_pages(spark, d):
    return load(spark, d, "pages").select("page_id", url.next_page(F.col("url"), "page").alias("next"))


@query(r"SELECT doc_id, array_to_string([lower(x) for x in regexp_extract_all(text, '[0-9A-Za-z一-鿿][0-9A-Za-z一-鿿+\-.:/]*')], ' ') AS terms, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INT AS tokens FROM documents")
def normalized_terms(spark, d):
    return load(spark, d, "documents").select("doc_id", text.normalize_terms(F.col("text")).alias("terms"), text.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS stamp, epoch(date_trunc('second', ts))::BIGINT - 1704067200 AS after FROM events")
def http_dates(spark, d):
    e = load(spark, d, "events").withColumn("stamp", identity.http_date(F.col("ts").cast("timestamp")))
    return e.select("event_id", "stamp", identity.retry_after_seconds(F.col("stamp"), F.to_timestamp(F.lit("2024-01-01 00:00:00"))).alias("after"))


@query("SELECT doc_id, 'text_plain/' || substring(sha256(text), 1, 2) || '/' || sha256(text) AS key FROM documents")
def content_keys(spark, d):
    return load(spark, d, "documents").select("doc_id", text.content_key(text.content_hash(F.col("text")), F.lit("text/plain")).alias("key"))


@query("SELECT doc_id, CASE WHEN h > 0 AND h / (h + o) > 0.15 THEN 'zh' ELSE 'en' END AS language FROM (SELECT doc_id, len(regexp_extract_all(text, '[㐀-䶿一-鿿豈-﫿]')) AS h, len(regexp_extract_all(text, '\\p{L}')) - len(regexp_extract_all(text, '[㐀-䶿一-鿿豈-﫿]')) AS o FROM documents)")
def chunk_languages(spark, d):
    return load(spark, d, "documents").select("doc_id", text.chunk_language(F.col("text")).alias("language"))


@query("""SELECT event_id, k <> 3 AS valid, CASE k WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts + INTERVAL 1 DAY) END AS bound, CASE k WHEN 1 THEN epoch_us(ts + INTERVAL 1 DAY) END AS stored FROM (SELECT *, event_id % 4 AS k FROM events)""")
def time_bounds(spark, d):
    """Instants, days, unknowns, and days that end before they start, which aren't valid."""
    k, ts = F.col("event_id") % 4, F.col("ts").cast("timestamp")
    p = F.when(k == 0, "instant").when(k == 2, "unknown").otherwise("day")
    s = F.when(k != 2, ts)
    e = F.when(k == 1, ts + F.expr("INTERVAL 1 DAY")).when(k == 3, ts - F.expr("INTERVAL 1 DAY"))
    valid = timevalue.is_valid(p, s, e)
    return load(spark, d, "events").select("event_id", valid.alias("valid"), F.when(valid, F.unix_micros(timevalue.bounds_end(p, s, e))).alias("bound"), F.when(valid, F.unix_micros(timevalue.stored_end(p, e))).alias("stored"))


@query("SELECT event_id, epoch_us(CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) END) AS moment FROM events")
def date_coercion(spark, d):
    """Epoch seconds, ISO dates, and text that is neither."""
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    said = F.when(k == 0, F.unix_seconds(ts).cast("string")).when(k == 1, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.lit("soon"))
    return load(spark, d, "events").select("event_id", F.unix_micros(identity.any_date(said)).alias("moment"))


__all__ = ["ORACLES", "QUERIES"]
