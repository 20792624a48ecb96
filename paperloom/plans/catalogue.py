"""Registered queries over the library's operators, and the same in DuckDB SQL.

The tables stand in for the document application's own: events for revisions and failures, pages for captures,
orders and line items for lineage. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import identity, text, timevalue, url
from paperloom.operators import documents as stages
from paperloom.operators import knowledge, queue, quotes, relational, retrieval
from paperloom.session import checkpointed
from paperloom.sources import html, readers
from paperloom.streaming import streams
from paperloom.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TERMS = ["the", "tion", "ation", "on"]
AS_OF, FROM, TO = "2024-01-20 00:00:00", "2024-01-10 00:00:00", "2024-01-12 00:00:00"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def at(moment: str) -> Column:
    return F.to_timestamp(F.lit(moment))


def seconds(c: str | Column) -> Column:
    return F.unix_seconds((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# --- retrieval -----------------------------------------------------------------------------------------------------

_TOKENS = "SELECT doc_id, [lower(x) for x in regexp_extract_all(text, '[0-9A-Za-z一-鿿][0-9A-Za-z一-鿿+\\-.:/]*')] AS t FROM documents"
_BM25 = f"""
toks AS ({_TOKENS}), terms AS (SELECT unnest({TERMS!r}) AS term),
tf AS (SELECT doc_id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM toks, terms),
facts AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN df USING (term), facts WHERE tf > 0 GROUP BY doc_id)
"""


_ALIAS = "thereation"
_GRAMS = """list_distinct(flatten([[substring('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)] for w in regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')]))"""
_DIST = "1 - list_sum([CAST(e[i] AS DOUBLE) * CAST(q[i] AS DOUBLE) for i in range(1, 65)]) / (sqrt(list_sum([CAST(e[i] AS DOUBLE) * e[i] for i in range(1, 65)])) * sqrt(list_sum([CAST(q[i] AS DOUBLE) * q[i] for i in range(1, 65)])))"
_KNN = f"k AS (SELECT vec_id, label, {_DIST} AS distance FROM (SELECT vec_id, label, embedding AS e, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS q FROM embeddings))"


def _of_vector_0(v: DataFrame, k: int, **more) -> DataFrame:
    return retrieval.nearest_each(v, v.filter("vec_id = 0"), k, **more)


@query(f"WITH {_KNN} SELECT vec_id, round(distance, 5) AS distance FROM k ORDER BY k.distance, vec_id LIMIT 20")
def knn_exact(spark, d):
    return _of_vector_0(load(spark, d, "embeddings"), 20).select(F.col("id").alias("vec_id"), rounded("distance", 5).alias("distance"))


@query(f"""WITH {_KNN}, e AS (SELECT vec_id FROM k ORDER BY distance, vec_id LIMIT 10),
a AS (SELECT vec_id FROM k WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0) ORDER BY distance, vec_id LIMIT 10)
SELECT found, wanted, found / wanted AS recall, found / wanted >= 0.98 AS passes FROM (SELECT count(*) FILTER (vec_id IN (FROM a)) AS found, count(*) AS wanted FROM e)""")
def knn_recall_gate(spark, d):
    v = load(spark, d, "embeddings")
    return retrieval.recall_at_k(_of_vector_0(v, 10), _of_vector_0(v, 10, cell="label")).withColumn("passes", F.col("recall") >= 0.98)


_EACH = f"""qs AS (SELECT vec_id AS query_id, label AS query_label, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
k AS (SELECT query_id, vec_id, label = query_label AS near, round({_DIST}, 9) AS distance FROM (SELECT vec_id, label, embedding AS e, qs.* FROM embeddings, qs))"""


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("vec_id") % 100 == 0)


@query(f"WITH {_EACH} SELECT query_id, vec_id, round(distance, 5) + 0 AS distance, row_number() OVER (PARTITION BY query_id ORDER BY k.distance, vec_id) AS rank FROM k QUALIFY rank <= 20")
def knn_exact_each(spark, d):
    v = load(spark, d, "embeddings")
    return retrieval.nearest_each(v, _queries(v), 20).select("query_id", F.col("id").alias("vec_id"), rounded("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_EACH}, e AS (SELECT query_id, vec_id FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10),
a AS (SELECT query_id, vec_id, 1 AS hit FROM k WHERE near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10)
SELECT query_id, count(hit) AS found, count(*) AS wanted, count(hit) / count(*) AS recall, count(hit) / count(*) >= 0.98 AS passes FROM e LEFT JOIN a USING (query_id, vec_id) GROUP BY query_id""")
def knn_recall_gate_each(spark, d):
    v = load(spark, d, "embeddings")
    q = _queries(v)
    return retrieval.recall_each(retrieval.nearest_each(v, q, 10), retrieval.nearest_each(v, q, 10, cell="label")).withColumn("passes", F.col("recall") >= 0.98)


@query("SELECT count(DISTINCT doc_id) AS gap FROM documents ANTI JOIN embeddings ON doc_id = vec_id")
def embedding_gap(spark, d):
    return load(spark, d, "documents").join(load(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left_anti").agg(F.countDistinct("doc_id").alias("gap"))


@query("SELECT source, lang, count(*) AS hits, max(doc_id) AS newest FROM documents GROUP BY ALL")
def topic_proximity(spark, d):
    return load(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("hits"), F.max("doc_id").alias("newest"))


@query(f"WITH t AS ({_TOKENS}), p AS (SELECT doc_id, unnest(t) AS term FROM t) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM p GROUP BY term")
def postings_statistics(spark, d):
    return retrieval.postings(load(spark, d, "documents")).groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


# --- timeline ------------------------------------------------------------------------------------------------------

_P = "CASE event_id % 4 WHEN 0 THEN 'instant' WHEN 1 THEN 'day' WHEN 2 THEN 'month' ELSE 'unknown' END"
_REV = f"""r AS (SELECT event_id, user_id, ts, {_P} AS precision,
  CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('month', ts) END AS s,
  CASE event_id % 4 WHEN 1 THEN date_trunc('day', ts) + INTERVAL 1 DAY WHEN 2 THEN date_trunc('month', ts) + INTERVAL 1 MONTH END AS e FROM events)"""


def _revisions(spark: SparkSession, d: str) -> DataFrame:
    """events as revisions: user_id is the event, event_id the revision, ts when it was recorded."""
    k = F.col("event_id") % 4
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = F.when(k == 0, F.col("ts")).when(k == 1, F.date_trunc("day", "ts")).when(k == 2, F.date_trunc("month", "ts"))
    end = F.when(k == 1, s + F.expr("INTERVAL 1 DAY")).when(k == 2, s + F.expr("INTERVAL 1 MONTH"))
    name = F.when(k == 0, "instant").when(k == 1, "day").when(k == 2, "month").otherwise("unknown")
    return e.select("event_id", "user_id", "ts", name.alias("precision"), s.alias("s"), end.alias("e"))


@query(f"SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY user_id")
def timeline_asof(spark, d):
    rows = _revisions(spark, d).filter(F.col("ts") <= at(AS_OF)).select("user_id", "event_id", "ts")
    return relational.latest(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


ORACLES["timeline_asof_by_max"] = ORACLES["timeline_asof"]


@query(ORACLES["timeline_asof"])
def timeline_asof_by_max(spark, d):
    rows = _revisions(spark, d).filter(F.col("ts") <= at(AS_OF)).select("user_id", "event_id", "ts")
    return relational.first_by(rows, ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id")


@query(f"""WITH {_REV} SELECT event_id, precision FROM r WHERE CASE precision WHEN 'unknown' THEN FALSE
  WHEN 'instant' THEN s >= TIMESTAMP '{FROM}' AND s < TIMESTAMP '{TO}' ELSE s < TIMESTAMP '{TO}' AND coalesce(e, s) > TIMESTAMP '{FROM}' END""")
def timeline_window(spark, d):
    r = _revisions(spark, d)
    return r.filter(timevalue.intersects(F.col("precision"), F.col("s"), F.col("e"), at(FROM), at(TO))).select("event_id", "precision")


@query(f"""WITH {_REV}, o AS (SELECT event_id, precision = 'unknown' AS late_group, epoch(s)::BIGINT AS start, row_number() OVER (ORDER BY s NULLS LAST, event_id) AS n FROM r)
SELECT event_id, start FROM o WHERE n > 100 AND n <= 200""")
def timeline_keyset(spark, d):
    r = _revisions(spark, d).select("event_id", seconds("s").alias("start"), F.unix_micros("s").alias("key"))
    first = relational.page_after(r, [("key", True), ("event_id", True)], None, 100)
    last = first.orderBy(F.desc_nulls_first("key"), F.desc("event_id")).first()
    return relational.page_after(r, [("key", True), ("event_id", True)], (last["key"], last["event_id"]), 100).select("event_id", "start")


@query(f"""WITH {_REV} SELECT event_id, coalesce(ts + INTERVAL (event_id % 50) HOUR > coalesce(e, s + INTERVAL 1 DAY), FALSE) AS late FROM r""")
def late_discovery(spark, d):
    r = _revisions(spark, d)
    found = F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 50) * 3_600_000_000)
    return r.select("event_id", timevalue.late_discovery(F.col("s"), F.col("e"), found).alias("late"))


@query(r"""SELECT event_id, strftime(ts, '%Y-%m') AS original_text, 'month' AS precision, epoch(date_trunc('month', ts))::BIGINT AS start, epoch(date_trunc('month', ts) + INTERVAL 1 MONTH)::BIGINT AS "end" FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M'), 'instant', epoch(date_trunc('minute', ts))::BIGINT, NULL FROM events WHERE event_id % 2 = 1""")
def time_expressions(spark, d):
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    said = F.concat(F.lit("around "), F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm")))
    t = e.select("event_id", timevalue.parse_time(said).alias("t"))
    return t.select("event_id", "t.original_text", "t.precision", seconds("t.start").alias("start"), seconds("t.end").alias("end"))


# --- documents, text, urls -------------------------------------------------------------------------------------------

_CANON = r"""
u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['scheme', 'net', 'path', 'q']) AS p FROM pages),
c AS (SELECT page_id, p.scheme || '://' || lower(p.net) || p.path AS base,
  array_to_string(list_filter(string_split(p.q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(fbclid|gclid|msclkid|twclid|igshid|yclid|mc_cid|mc_eid|_ga|_gl)(=|$)|^utm_')), '&') AS q FROM u),
n AS (SELECT page_id, base || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical FROM c)
"""


@query(f"WITH {_CANON} SELECT page_id, canonical FROM n")
def url_canonical(spark, d):
    return load(spark, d, "pages").select("page_id", url.normalize_url(F.col("url")).alias("canonical"))


@query(f"WITH {_CANON} SELECT regexp_extract(canonical, '://([^?]*)', 1) AS origin, count(*) AS n_evidence, count(DISTINCT canonical) AS n_urls FROM n GROUP BY 1")
def url_families(spark, d):
    p = load(spark, d, "pages")
    return p.select(url.origin(F.col("url")).alias("origin"), url.normalize_url(F.col("url")).alias("u")).groupBy("origin").agg(F.count("*").alias("n_evidence"), F.countDistinct("u").alias("n_urls"))


@query(f"WITH {_CANON} SELECT canonical AS canonical_url, min(page_id) AS page_id FROM n WHERE canonical NOT IN (SELECT canonical FROM n WHERE page_id % 5 = 0) GROUP BY 1")
def new_candidates(spark, d):
    p = load(spark, d, "pages").withColumn("canonical_url", url.normalize_url(F.col("url")))
    known = p.filter("page_id % 5 = 0")
    return relational.insert_or_ignore(known, p.select("canonical_url", "page_id"), ["canonical_url"], [F.col("page_id")])


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def doc_exact_dedup(spark, d):
    return load(spark, d, "documents").groupBy(text.content_hash(F.col("text"))).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\r\n\f\v]+', ' ', 'g'))) AS digest FROM documents")
def doc_canonical_hash(spark, d):
    return load(spark, d, "documents").select("doc_id", text.content_hash(text.collapse(F.col("text"))).alias("digest"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
SELECT doc_id, pos::INT AS pos, trim(x) AS text FROM l WHERE trim(x) <> ''""")
def line_blocks(spark, d):
    return load(spark, d, "documents").select("doc_id", F.explode(html.plain_blocks(F.col("text"))).alias("b")).select("doc_id", "b.pos", "b.text")


@query("SELECT x AS line, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY x HAVING count(DISTINCT doc_id) > 1")
def repeated_lines(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("line").agg(F.countDistinct("doc_id").alias("docs")).filter("docs > 1")


@query(r"""SELECT doc_id, CASE WHEN n = 0 THEN 'unknown' WHEN l / n < 0.3 THEN 'mixed' ELSE 'en' END AS language FROM (SELECT doc_id, len(regexp_extract_all(substring(text, 1, 4000), '\p{L}')) AS n,
  len(regexp_extract_all(substring(text, 1, 4000), '[A-Za-z]')) AS l FROM documents)""")
def lang_by_script(spark, d):
    return load(spark, d, "documents").select("doc_id", text.script_language(F.col("text")).alias("language"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INT AS tokens FROM documents")
def token_estimate(spark, d):
    return load(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


_NUMBER = text.NUMBER.replace("'", "''")


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct([replace(x, ' ', '') for x in regexp_extract_all(text, '{_NUMBER}')])), '|') AS numbers FROM documents")
def numbers_in_text(spark, d):
    return load(spark, d, "documents").select("doc_id", F.array_join(F.sort_array(text.numbers_in(F.col("text"))), "|").alias("numbers"))


@query("SELECT item_id, doc_id, strpos(d.text, b.text) - 1 AS start, (length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text) AS found FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND b.text <> ''")
def quote_locate(spark, d):
    """The items against all documents, which meet by the rarest pair of words of each."""
    hits = quotes.search(load(spark, d, "documents"), load(spark, d, "benchmark").select("item_id", F.col("text").alias("quote")))
    return hits.groupBy("item_id", "doc_id").agg(F.min("start").cast("long").alias("start"), F.count("*").alias("found"))


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in text.CREDENTIALS) + "], lambda x: x IS NOT NULL), ',') AS kinds FROM documents")
def secret_scan(spark, d):
    return load(spark, d, "documents").select("doc_id", F.array_join(text.credential_kinds(F.col("text")), ",").alias("kinds"))


@query()
def html_blocks(spark, d):
    p = html.parse_html(load(spark, d, "pages").select("page_id", "html"), "html")
    return p.select("page_id", F.posexplode("parsed.blocks").alias("pos", "b")).select("page_id", "pos", "b.block_id", "b.kind", "b.text", "b.section_path", "b.locator")


@query()
def quality_flags(spark, d):
    p = html.parse_html(load(spark, d, "pages").select("page_id", "html"), "html")
    no = F.lit(False)
    a = stages.assess("parsed", F.octet_length("html"), F.lit("text/html"), text.mixed_scripts(F.col("html")), no, no, no, no)
    return p.select("page_id", a.alias("a")).select("page_id", "a.status", "a.scope", F.array_join("a.flags", ",").alias("flags"))


_LINES = "l AS (SELECT doc_id, source, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS text FROM documents)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("pos", F.col("pos") + 1)


_CUT = "CASE WHEN {0} <= 0 THEN 0 WHEN {0} >= n OR strpos(substring(text, {0} + 1), ' ') = 0 THEN n ELSE {0} + strpos(substring(text, {0} + 1), ' ') END"


@query(f"""WITH {_LINES}, b AS (SELECT *, length(text)::BIGINT AS n FROM l WHERE trim(text, ' ') <> ''),
s AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, (sum(n + 1) OVER (PARTITION BY doc_id))::BIGINT AS total FROM b),
z AS (SELECT *, greatest(0, ceil((total - 400) / 2800) - 1)::BIGINT AS last FROM s),
k AS (SELECT *, unnest(generate_series(least(greatest(0, floor((start - 3200) / 2800) + 1)::BIGINT, last), least(floor((start + n - 1) / 2800)::BIGINT, last))) AS ordinal FROM z),
c AS (SELECT *, {_CUT.format("(ordinal * 2800 - start)")} AS f, {_CUT.format("(CASE WHEN ordinal = last THEN n ELSE ordinal * 2800 + 3200 - start END)")} AS t FROM k),
p AS (SELECT *, CASE WHEN t > f THEN substring(text, f + 1, t - f) ELSE '' END AS piece FROM c)
SELECT doc_id, ordinal::INT AS ordinal, string_agg('b' || pos, ',' ORDER BY pos) AS block_ids, string_agg(piece, chr(10) ORDER BY pos) AS text FROM p WHERE trim(piece, ' ') <> '' GROUP BY doc_id, ordinal""")
def chunks(spark, d):
    """Every document's lines as blocks of one section."""
    blocks = _lines(spark, d).select("doc_id", F.lit("").alias("section"), "pos", F.concat(F.lit("b"), "pos").alias("block_id"), "text")
    return stages.chunks(blocks).select("doc_id", "ordinal", F.array_join("block_ids", ",").alias("block_ids"), "text")


_WORDS = "list_distinct(string_split(trim(regexp_replace({}, '\\s+', ' ', 'g'), ' '), ' '))"


@query(f"""WITH {_LINES}, v AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM documents),
h AS (SELECT doc_id, pos, text, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS g FROM l),
a0 AS (SELECT v.doc_id AS pair_id, pos, text, g FROM v JOIN h ON v.prev = h.doc_id), b0 AS (SELECT v.doc_id AS pair_id, pos, text, g FROM v JOIN h USING (doc_id) WHERE prev IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY pair_id, g ORDER BY pos) AS nth FROM a0), b AS (SELECT *, row_number() OVER (PARTITION BY pair_id, g ORDER BY pos) AS nth FROM b0),
x AS (SELECT a.pair_id, a.pos, a.text, b.nth AS same, count(b.nth) OVER (PARTITION BY a.pair_id ORDER BY a.pos) AS gap FROM a LEFT JOIN b USING (pair_id, g, nth)),
y AS (SELECT b.pair_id, b.pos, b.text, a.nth AS same, count(a.nth) OVER (PARTITION BY b.pair_id ORDER BY b.pos) AS gap FROM b LEFT JOIN a USING (pair_id, g, nth)),
p AS (SELECT pair_id, gap, row_number() OVER (PARTITION BY pair_id, gap ORDER BY pos) AS k, text AS from_text FROM x WHERE same IS NULL),
q AS (SELECT pair_id, gap, row_number() OVER (PARTITION BY pair_id, gap ORDER BY pos) AS k, text AS to_text FROM y WHERE same IS NULL),
d AS (SELECT *, coalesce(len(list_intersect({_WORDS.format("from_text")}, {_WORDS.format("to_text")})) >= 0.5 * len(list_distinct(list_concat({_WORDS.format("from_text")}, {_WORDS.format("to_text")}))), FALSE) AND from_text IS NOT NULL AND to_text IS NOT NULL AS alike FROM p FULL JOIN q USING (pair_id, gap, k))
SELECT pair_id, 'changed' AS change, from_text, to_text FROM d WHERE alike UNION ALL SELECT pair_id, 'removed', from_text, NULL FROM d WHERE NOT alike AND from_text IS NOT NULL
UNION ALL SELECT pair_id, 'added', NULL, to_text FROM d WHERE NOT alike AND to_text IS NOT NULL""")
def block_diff(spark, d):
    """Every document against the one before it of the same source, line by line."""
    pairs = load(spark, d, "documents").select("doc_id", F.lag("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("prev")).filter("prev is not null")
    # whole texts meet their pairs, and only then become lines
    docs, pairs = load(spark, d, "documents").select(F.col("doc_id").alias("side"), "text"), pairs.withColumnRenamed("doc_id", "pair_id")
    lines = lambda side: pairs.withColumn("side", F.col(side)).join(docs, "side").select("pair_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return stages.diff_blocks(lines("prev"), lines("pair_id"))


# --- claims, events, graph -------------------------------------------------------------------------------------------

_KEY = "'product_release|release_ref=' || lower(trim(p_brand)) || '|product=' || lower(trim(p_type)) || '|phase=' || p_size || '|version=|region='"


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    fields = F.create_map(F.lit("release_ref"), F.col("p_brand"), F.lit("product"), F.col("p_type"), F.lit("phase"), F.col("p_size").cast("string"))
    return p.select("p_partkey", identity.identity_key(F.lit("product_release"), fields).alias("event_key"))


@query(f"SELECT p_partkey, {_KEY} AS event_key FROM part")
def identity_keys(spark, d):
    return _keyed(spark, d)


@query(f"""WITH k AS (SELECT p_partkey AS proposal_id, {_KEY} AS event_key FROM part), known AS (SELECT DISTINCT event_key FROM k WHERE proposal_id % 10 = 0)
SELECT proposal_id, event_key, CASE WHEN event_key IN (FROM known) THEN 'link' WHEN row_number() OVER (PARTITION BY event_key ORDER BY proposal_id) = 1 THEN 'create' ELSE 'link' END AS action FROM k""")
def event_resolution(spark, d):
    k = _keyed(spark, d).withColumnRenamed("p_partkey", "proposal_id").withColumn("has_candidate", F.lit(False))
    return knowledge.resolve_events(k, k.filter("proposal_id % 10 = 0"))


@query("""WITH e AS (SELECT turn AS ordinal, conv_id AS claim_id, text, CASE turn % 4 WHEN 0 THEN substring(text, 1, 5) WHEN 1 THEN substring(text, 1, 40) WHEN 2 THEN 'not in any block at all' ELSE substring(text, 3, 30) END AS q FROM conversations),
c AS (SELECT *, CASE WHEN length(trim(q)) < 8 THEN 'quote_too_short' WHEN (length(text) - length(replace(text, q, ''))) // length(q) = 0 THEN 'quote_not_found' WHEN (length(text) - length(replace(text, q, ''))) // length(q) > 1 THEN 'quote_ambiguous' END AS code FROM e WHERE claim_id % 3 > 0),
x AS (SELECT claim_id, min_by(code, ordinal) FILTER (code IS NOT NULL) AS code FROM c GROUP BY claim_id)
SELECT i.claim_id, CASE WHEN x.claim_id IS NULL THEN 'no_evidence' ELSE x.code END AS code, 'inference' AS kind FROM (SELECT DISTINCT conv_id AS claim_id FROM conversations) i LEFT JOIN x USING (claim_id)""")
def claim_validation(spark, d):
    t = load(spark, d, "conversations").withColumn("block_id", F.concat_ws("/", "conv_id", "turn"))
    k = F.col("turn") % 4
    quote = F.when(k == 0, F.substring("text", 1, 5)).when(k == 1, F.substring("text", 1, 40)).when(k == 2, "not in any block at all").otherwise(F.substring("text", 3, 30))
    evidence = t.filter("conv_id % 3 > 0").select(F.col("conv_id").alias("claim_id"), F.col("turn").alias("ordinal"), "block_id", quote.alias("quote"))
    claims = t.select(F.col("conv_id").alias("claim_id")).distinct().select("claim_id", F.lit("a claim").alias("text"), F.lit("source_statement").alias("kind"), F.lit("").alias("attribution"))
    return knowledge.validate_claims(claims, evidence, t.select("block_id", "text"))


@query(r"""WITH s AS (SELECT c_custkey AS topic_id, c_acctbal > 0 AS good FROM customer) SELECT topic_id, CASE WHEN good THEN 'direct' ELSE 'uncertain' END AS decision, CASE WHEN good THEN 'given' ELSE 'fallback:no_verdict' END AS reason FROM s""")
def route_topics(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("topic_id"), "c_acctbal")
    verdicts = c.filter("c_acctbal > 0").select("topic_id", F.lit("direct").alias("decision"), F.lit("given").alias("reason"))
    return knowledge.topic_verdicts(c.select("topic_id"), verdicts)


_EDGES = "e AS (SELECT event_id AS edge_id, user_id % 40 AS a, event_id % 37 AS b, CASE event_type WHEN 'click' THEN 'parallel' WHEN 'error' THEN 'refutes' ELSE 'extends' END AS relation, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'inferred' WHEN 2 THEN 'stated' ELSE 'explicit' END AS basis, event_id % 2 AS n FROM events)"


@query(f"""WITH {_EDGES}, o AS (SELECT edge_id, relation, CASE WHEN relation = 'parallel' THEN least(a, b) ELSE a END AS x, CASE WHEN relation = 'parallel' THEN greatest(a, b) ELSE b END AS y,
  CASE WHEN a = b THEN 'self_loop' WHEN basis IN ('', 'stated') THEN 'no_basis' WHEN basis = 'inferred' AND relation = 'refutes' AND n = 0 THEN 'inferred_relation_without_evidence' END AS own FROM e)
SELECT edge_id, coalesce(own, CASE WHEN row_number() OVER (PARTITION BY x, y, relation ORDER BY own IS NOT NULL, edge_id) > 1 THEN 'duplicate_parallel' END) AS reason FROM o""")
def edge_gates(spark, d):
    e = load(spark, d, "events")
    relation = F.when(F.col("event_type") == "click", "parallel").when(F.col("event_type") == "error", "refutes").otherwise("extends")
    basis = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, "inferred").when(F.col("event_id") % 5 == 2, "stated").otherwise("explicit")
    return knowledge.gate_edges(e.select(F.col("event_id").alias("edge_id"), (F.col("user_id") % 40).alias("from_node"), (F.col("event_id") % 37).alias("to_node"), relation.alias("relation"), basis.alias("basis"), (F.col("event_id") % 2).alias("n_evidence")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id AS a, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS b FROM events WHERE event_type IN ('click', 'view') AND value > 45),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT DISTINCT a AS node FROM r WHERE a = b)
SELECT node FROM c UNION SELECT x.b FROM r x JOIN r y ON x.b = y.a WHERE x.a IN (FROM c) AND y.b IN (FROM c)""")
def cycle_check(spark, d):
    """Strong events as edges from users to what they touch: two kinds are ordered relations; the nodes on or between cycles."""
    e = load(spark, d, "events").filter("value > 45")
    relation = F.when(F.col("event_type") == "click", "updates").when(F.col("event_type") == "view", "extends").otherwise("supports")
    edges = e.select(F.col("user_id").alias("from_node"), F.get_json_object("props", "$.k").cast("long").alias("to_node"), relation.alias("relation"))
    return knowledge.cyclic_nodes(edges, checkpointed)


@query("""SELECT DISTINCT c_nationkey AS event_id, l_suppkey AS report_id FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) AND NOT (c_nationkey = 0 AND l_suppkey % 2 = 0)""")
def lineage_stale(spark, d):
    c, o, li = (load(spark, d, t) for t in ("customer", "orders", "lineitem"))
    ec = c.select(F.col("c_nationkey").alias("event_id"), F.col("c_custkey").alias("claim_id"))
    ce = o.select(F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("evidence_id"))
    ci = li.select(F.col("l_orderkey").alias("evidence_id"), F.col("l_suppkey").alias("report_id"))
    stale = load(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.lit(0).alias("event_id"), F.col("s_suppkey").alias("report_id"))
    return knowledge.stale_reports(c.filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("event_id")).distinct(), ec, ce, ci, stale)


@query("""SELECT count(*)::BIGINT AS discovered, (count(*) FILTER (o_orderstatus <> 'O'))::BIGINT AS captured, coalesce((SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders WHERE o_orderstatus <> 'F'), '') AS gaps,
CASE WHEN count(*) = 0 THEN 'unknown' WHEN bool_or(o_orderstatus = 'P') THEN 'partial' WHEN bool_or(o_orderstatus <> 'F') THEN 'pending' ELSE 'complete' END AS status FROM orders""")
def status_coverage(spark, d):
    o = load(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    return knowledge.coverage_status(o.select(F.lit(1).alias("discovered"), (F.col("o_orderstatus") != "O").cast("long").alias("captured"), F.col("o_orderpriority").alias("phase"), status.alias("status")))


@query("SELECT conv_id, count(*) FILTER (len(string_split(text, '.')) - 1 > 1)::BIGINT AS cited, count(*) AS total, cited / total AS coverage FROM conversations GROUP BY conv_id")
def citation_coverage(spark, d):
    t = load(spark, d, "conversations").select("conv_id", (F.size(F.split("text", r"\.")) - 2).alias("n_citations"))
    return knowledge.citation_coverage(t, "conv_id")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_turn,
coalesce(turn = lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1, TRUE) AS serial FROM conversations""")
def conversation_serial(spark, d):
    return knowledge.serial_turns(load(spark, d, "conversations")).select("conv_id", "turn", "parent_turn", "serial")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def context_snapshot(spark, d):
    return knowledge.recent_context(load(spark, d, "conversations"), 4).select("conv_id", "turn", "role")


@query("SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END, 'pending') AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def label_coverage(spark, d):
    q = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return q.select("doc_id", F.coalesce(F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor"), F.lit("pending")).alias("status"))


# --- queue, schedule, versions ---------------------------------------------------------------------------------------


@query("SELECT s_suppkey, s_acctbal > 9000 OR s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000) AS due FROM supplier")
def due_feeds(spark, d):
    active = load(spark, d, "customer").filter("c_mktsegment = 'BUILDING' and c_acctbal > 9000").select(F.col("c_nationkey").alias("s_nationkey"))
    s = relational.exists_flag(load(spark, d, "supplier"), active, ["s_nationkey"], "subscribed")
    return s.select("s_suppkey", ((F.col("s_acctbal") > 9000) | F.col("subscribed")).alias("due"))


@query("SELECT (epoch_us(ts) // 900000000)::BIGINT AS slot, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def schedule_slots(spark, d):
    e = load(spark, d, "events")
    return e.groupBy(identity.schedule_slot(F.col("ts").cast("timestamp"), 900).alias("slot")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 899999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS failures FROM events WHERE event_type = 'error'")
def sliding_failures(spark, d):
    return queue.sliding_failures(load(spark, d, "events").filter("event_type = 'error'"), "user_id", "ts").select("event_id", "failures")


@query("SELECT event_id FROM (SELECT event_id, props, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE props IS DISTINCT FROM b")
def capture_change(spark, d):
    c = load(spark, d, "events").select(F.col("event_id").alias("capture_id"), "user_id", "ts", "props")
    return stages.capture_changes(c, "user_id", "ts", F.col("props")).select(F.col("capture_id").alias("event_id"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 72 HOURS")
def overlap_late_filter(spark, d):
    e = load(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("published"))
    return readers.within_overlap(e, at(AS_OF)).select("event_id")


@query("""SELECT event_id, CASE WHEN k = 'transient' AND a < 5 OR k = 'parser_error' AND a < 2 THEN 'retry_wait' WHEN k = 'cancelled' THEN 'cancelled' WHEN k = 'schema_output' THEN 'running' ELSE 'failed' END AS state,
CASE WHEN k = 'transient' AND a < 5 THEN least(30 * pow(2, a - 1), 1800)::BIGINT WHEN k = 'parser_error' AND a < 2 THEN 30 END AS delay
FROM (SELECT event_id, 1 + event_id % 6 AS a, ['transient', 'parser_error', 'cancelled', 'schema_output', 'access_blocked'][1 + user_id % 5] AS k FROM events)""")
def retry_backoff(spark, d):
    kinds = F.array(*[F.lit(k) for k in ("transient", "parser_error", "cancelled", "schema_output", "access_blocked")])
    state, delay = queue.after_failure(kinds[(F.col("user_id") % 5).cast("int")], 1 + F.col("event_id") % 6, F.lit(None).cast("long"))
    return load(spark, d, "events").select("event_id", state.alias("state"), delay.alias("delay"))


@query("SELECT event_id AS job_id, row_number() OVER (ORDER BY ts, event_id) AS worker, 1 AS attempt FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '2024-01-20 00:00:00' QUALIFY worker <= 8")
def queue_claim(spark, d):
    e = load(spark, d, "events").filter("event_type = 'view'")
    jobs = e.select(F.col("event_id").alias("job_id"), F.lit("queued").alias("state"), F.col("ts").cast("timestamp").alias("available_at"), F.lit(0).alias("attempt"))
    return queue.claim(jobs, 8, at(AS_OF)).select("job_id", F.col("worker").cast("long").alias("worker"), "attempt")


@query("""SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 2::BIGINT AS row_version FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0""")
def merge_versions(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(1).cast("long").alias("row_version"))
    commands = o.filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(7).alias("expected_version"))
    return relational.versioned_update(o, commands, "o_orderkey", "o_totalprice")[0]


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'patched' ELSE c_mktsegment END AS c_mktsegment, (1 + (c_custkey % 4 = 0)::INT)::BIGINT AS row_version FROM customer")
def upsert_decisions(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment", F.lit(1).cast("long").alias("row_version"))
    changes = c.filter("c_custkey % 4 = 0").select("c_custkey", F.lit("patched").alias("c_mktsegment"))
    return relational.upsert(c, changes, ["c_custkey"], ["c_mktsegment"])


@query("""SELECT event_id, strftime(timezone(z, timezone('UTC', ts)), '%Y-%m-%d') AS local_day, hour(timezone(z, timezone('UTC', ts))) AS local_hour FROM (SELECT *, ['Asia/Tokyo', 'Europe/Berlin', 'America/New_York'][1 + user_id % 3] AS z FROM events)""")
def daily_local_window(spark, d):
    zone = F.array(F.lit("Asia/Tokyo"), F.lit("Europe/Berlin"), F.lit("America/New_York"))[(F.col("user_id") % 3).cast("int")]
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    return load(spark, d, "events").select("event_id", F.date_format(local, "yyyy-MM-dd").alias("local_day"), F.hour(local).cast("long").alias("local_hour"))


@query("SELECT doc_id, source FROM documents WHERE text ILIKE '%ation%' ORDER BY doc_id DESC LIMIT 50")
def substring_search(spark, d):
    return load(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("ation"))).orderBy(F.desc("doc_id")).limit(50).select("doc_id", "source")


@query()
def job_states(spark, d):
    """events as commands to jobs (users), folded in order."""
    names = F.array(*[F.lit(x) for x in ("running", "retry_wait", "queued", "waiting_review", "succeeded")])
    e = load(spark, d, "events").filter("event_type <> 'error'").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), names[(F.col("event_id") % 5).cast("int")].alias("to_state"))
    return streams.fold_states(e, "job_id", [F.col("seq")])
