"""Registered queries over commits of extractions and event builds, and over views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import commits, views
from paperloom.plans.advanced import ORACLES, QUERIES
from paperloom.plans.catalogue import query
from paperloom.tables import load

# --- views -------------------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT conv_id, turn, role, text, turn % 4 AS k, CASE WHEN role = 'user' THEN 'unknown' ELSE 'fact' END AS kind FROM conversations)
SELECT conv_id, turn, CASE WHEN k = 1 THEN 'inference:' || text || ':a,b|' || kind || '::7' WHEN text = '' THEN '' ELSE kind || ':' || text || ':' END AS blocks, CASE WHEN k = 2 THEN 'c1,c2' ELSE '' END AS citations FROM m""")
def message_views(spark, d):
    """Every turn as a message: blocks of the manifest in one of four, the content otherwise."""
    k, none = F.col("turn") % 4, F.lit(None).cast("string")
    listed = F.concat(F.lit('{"blocks": ['), F.to_json(F.struct("text", F.lit("inference").alias("kind"), F.array(F.lit("a"), F.lit("b")).alias("citation_ids"))), F.lit(', 5, "x", {"kind": "odd", "text": null, "citation_ids": [], "citations": [7]}]}'))
    manifest = F.when(k == 1, listed).when(k == 2, F.lit('{"blocks": "none", "citations": [{"citation_id": "c1"}, 4, {"other": 1}, {"citation_id": "c2"}]}')).when(k == 3, "not json").otherwise(none)
    m = load(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"), manifest.alias("citation_manifest"))
    v = views.message_views(m)
    text = F.array_join(F.transform("blocks", lambda b: F.concat_ws(":", b["kind"], b["text"], F.array_join(b["citation_ids"], ","))), "|")
    return v.select("conv_id", "turn", text.alias("blocks"), F.array_join("citations", ",").alias("citations"))


@query("""WITH r AS (SELECT c_custkey AS report_id, c_name AS title, CASE WHEN c_custkey % 3 > 0 THEN c_custkey + 100000 END AS rev FROM customer)
SELECT report_id, coalesce(rev, report_id) AS revision_id, CASE WHEN rev IS NULL THEN '' WHEN report_id % 2 = 0 THEN 'fact:' || title || ':x|fact:plain:' ELSE 'inference:' || title || ':1,2' END AS blocks,
CASE WHEN rev IS NULL OR report_id % 5 = 0 THEN 'pending' ELSE 'complete' END AS coverage_status, CASE WHEN rev IS NULL OR report_id % 5 = 0 THEN 0 ELSE 9 END AS processed, rev IS NOT NULL AND report_id % 7 = 0 AS stale FROM r""")
def report_block_views(spark, d):
    """Reports with sections of statements or single blocks, some without a revision or a coverage."""
    i = F.col("report_id")
    r = load(spark, d, "customer").select(F.col("c_custkey").alias("report_id"), F.col("c_name").alias("title")).withColumn("current_revision_id", F.when(i % 3 > 0, i + 100000))
    quoted = F.to_json(F.struct("title"))
    title = F.regexp_extract(quoted, r'^\{"title":(.*)\}$', 1)
    sections = F.concat(F.lit('[{"statements": [{"text": '), title, F.lit(', "citations": ["x"]}, "plain", "", 3]}, {"text": ""}]'))
    single = F.concat(F.lit('[7, {"text": '), title, F.lit(', "kind": "inference", "citation_ids": [1, 2]}]'))
    rev = r.filter("current_revision_id is not null").select(
        F.col("current_revision_id").alias("revision_id"), F.lit(None).cast("timestamp").alias("as_of"), F.when(i % 2 == 0, sections).otherwise(single).alias("content"),
        F.when(i % 5 > 0, '{"status": "complete", "processed": 9, "failed": 1}').otherwise(F.lit(None).cast("string")).alias("coverage"), F.when(i % 7 == 0, '{"stale": true}').otherwise('{"stale": 0}').alias("input_manifest"),
    )
    v = views.report_views(r, rev, F.current_timestamp())
    text = F.array_join(F.transform("blocks", lambda b: F.concat_ws(":", b["kind"], b["text"], F.array_join(b["citation_ids"], ","))), "|")
    return v.select("report_id", "revision_id", text.alias("blocks"), "coverage_status", "processed", "stale")


@query("""SELECT doc_id, 'b' || doc_id AS block_id, text, CASE WHEN doc_id % 3 = 0 THEN 'heading' ELSE 'paragraph' END AS kind, CASE doc_id % 4 WHEN 0 THEN (1 + doc_id % 9)::INT END AS page FROM documents WHERE text <> '' UNION ALL
SELECT doc_id, '7', '12', 'paragraph', NULL FROM documents""")
def source_block_views(spark, d):
    """Stored blocks of every document, with odd kinds, pages that are no whole numbers from 1, and what isn't a block."""
    i = F.col("doc_id")
    page = F.when(i % 4 == 0, (1 + i % 9).cast("string")).when(i % 4 == 1, '"3"').when(i % 4 == 2, "0").otherwise("1.5")
    text = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)
    kind = F.when(i % 3 == 0, "heading").otherwise("odd")
    stored = F.concat(F.lit('[{"block_id": "b'), i.cast("string"), F.lit('", "text": '), text, F.lit(', "kind": "'), kind, F.lit('", "page": '), page, F.lit('}, "x", {"block_id": "", "text": "y"}, {"block_id": "z"}, {"id": 7, "text": 12, "page": -2}]'))
    b = load(spark, d, "documents").select("doc_id", F.explode(views.source_blocks(stored)).alias("b"))
    return b.select("doc_id", "b.block_id", "b.text", "b.kind", "b.page")


# --- commits -----------------------------------------------------------------------------------------------------------

_EVIDENCE = """e AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN substring(text, 1, 5) WHEN 1 THEN substring(text, 1, 40) WHEN 2 THEN 'not in any block at all' ELSE substring(text, 3, 30) END AS q FROM conversations),
c AS (SELECT *, CASE WHEN length(trim(q)) < 8 THEN 'quote_too_short' WHEN (length(text) - length(replace(text, q, ''))) // length(q) = 0 THEN 'quote_not_found' WHEN (length(text) - length(replace(text, q, ''))) // length(q) > 1 THEN 'quote_ambiguous' END AS code FROM e)"""


def _extraction(spark: SparkSession, d: str) -> commits.Extraction:
    t = load(spark, d, "conversations")
    k = F.col("turn") % 4
    claims = t.select(F.col("conv_id").alias("run_id"), F.col("conv_id").alias("parse_id"), F.col("turn").alias("claim_no"), F.lit("a claim").alias("text"), F.lit("source_statement").alias("kind"), F.when(k == 1, "someone").alias("attribution"))
    quote = F.when(k == 0, F.substring("text", 1, 5)).when(k == 1, F.substring("text", 1, 40)).when(k == 2, "not in any block at all").otherwise(F.substring("text", 3, 30))
    block = F.concat(F.lit("b"), F.col("turn").cast("string")).alias("block_id")
    evidence = t.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("claim_no"), F.lit(0).alias("ordinal"), block, quote.alias("quote"), F.lit("supports").alias("relation"))
    origin = F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("o"), (F.col("conv_id") % 10).cast("string")))
    origins = t.select(F.col("conv_id").alias("parse_id"), origin.alias("origin_ref")).distinct()
    families = spark.createDataFrame([(11, "o1")], "family_id long, origin_ref string")
    semantic = t.filter(k == 3).select(F.col("conv_id").alias("run_id"), F.col("turn").alias("claim_no"), F.when(F.col("conv_id") % 2 == 0, "refutes").otherwise("odd").alias("status"))
    return commits.extraction(claims, evidence, t.select(F.col("conv_id").alias("parse_id"), block, "text"), origins, families, semantic)


@query(f"""WITH {_EVIDENCE} SELECT conv_id AS run_id, 'b' || turn AS block_id, strpos(text, q) - 1 AS start, strpos(text, q) - 1 + length(q) AS "end", CASE WHEN turn % 4 <> 3 THEN 'pending' WHEN conv_id % 2 = 0 THEN 'refutes' ELSE 'uncertain' END AS status,
CASE WHEN conv_id % 3 = 0 THEN 'none' WHEN conv_id % 10 = 1 THEN 'known' ELSE 'new' END AS family FROM c WHERE code IS NULL""")
def extraction_evidence(spark, d):
    """Turns as claims with one quote each: the evidence that is committed, with its place, judgement and family."""
    e = _extraction(spark, d).evidence
    family = F.when(F.col("family_id").isNull(), "none").when(F.col("family_id") == 11, "known").otherwise("new")
    return e.select("run_id", "block_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "status", family.alias("family"))


@query(f"WITH {_EVIDENCE} SELECT 'o' || (conv_id % 10) AS origin_ref, 'origin:o' || (conv_id % 10) AS label FROM c WHERE code IS NULL AND conv_id % 3 > 0 AND conv_id % 10 <> 1 GROUP BY conv_id % 10")
def extraction_families(spark, d):
    return _extraction(spark, d).families.select("origin_ref", "label")


@query(f"WITH {_EVIDENCE} SELECT conv_id AS run_id, turn AS claim_no, code FROM c WHERE code IS NOT NULL")
def extraction_rejected(spark, d):
    return _extraction(spark, d).rejected


@query(f"WITH {_EVIDENCE} SELECT conv_id AS run_id, turn AS claim_no, CASE WHEN turn % 4 = 1 THEN 'source_statement' ELSE 'inference' END AS kind FROM c WHERE code IS NULL")
def extraction_claims(spark, d):
    return _extraction(spark, d).claims.select("run_id", "claim_no", "kind")


def _build(spark: SparkSession, d: str) -> commits.EventBuild:
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    i = F.col("o_orderkey")
    fields = F.create_map(F.lit("release_ref"), F.when(i % 3 > 0, F.concat(F.lit("R "), (i % 400).cast("string"))), F.lit("product"), F.lit("P"), F.lit("phase"), F.lit("final"), F.lit("secret"), F.lit("x"))
    p = o.select(
        F.col("o_custkey").alias("run_id"), i.alias("proposal_no"), F.lit("product_release").alias("event_type"), F.lit("t").alias("title"), F.lit("s").alias("summary"), fields.alias("identity"),
        F.when(i % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("one day")).alias("occurred"), F.array(i, i + 1).alias("claim_ids"), F.when(i % 4 == 0, i * 10).alias("candidate_id"),
    )
    committed = o.select(F.col("o_custkey").alias("run_id"), i.alias("claim_id"))
    existing = spark.range(40).select((F.col("id") + 5_000_000).alias("event_id"), F.concat(F.lit("product_release|release_ref=r "), F.col("id").cast("string"), F.lit("|product=p|phase=final|version=|region=")).alias("event_key"))
    return commits.event_build(p, committed, existing)


_PROPOSALS = """q AS (SELECT o_custkey AS run_id, o_orderkey AS i, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 32),
p AS (SELECT *, CASE WHEN i % 3 > 0 THEN i % 400 END AS k, CASE WHEN i % 3 > 0 THEN row_number() OVER (PARTITION BY i % 3 > 0, i % 400 ORDER BY run_id, i) ELSE 1 END AS nth FROM q),
z AS (SELECT *, (k IS NULL OR k >= 40) AND nth = 1 AS created FROM p)"""


@query(f"""WITH {_PROPOSALS} SELECT CASE WHEN k IS NOT NULL THEN 'product_release|release_ref=r ' || k || '|product=p|phase=final|version=|region=' END AS event_key, run_id, CASE WHEN i % 2 = 0 THEN 'day' ELSE 'unknown' END AS precision,
CASE WHEN i % 2 = 0 THEN epoch(date_trunc('day', o_orderdate))::BIGINT END AS occurred FROM z WHERE created""")
def built_events(spark, d):
    """Orders as proposals of customers' runs: the events that are created."""
    return _build(spark, d).events.select("event_key", "run_id", "precision", F.unix_seconds("occurred_start").alias("occurred"))


@query(f"""WITH {_PROPOSALS}, a AS (SELECT run_id, i, k, unnest([i, i + 1]) AS claim_id FROM z), r AS (SELECT a.*, o_orderkey IS NOT NULL AS good FROM a LEFT JOIN orders ON o_orderkey = claim_id AND o_custkey = run_id),
n AS (SELECT run_id, count(*) FILTER (created) AS events_created, count(*) FILTER (NOT created) AS events_linked FROM z GROUP BY run_id)
SELECT n.*, count(*) FILTER (NOT good) AS dropped_claim_references FROM n JOIN r USING (run_id) GROUP BY ALL""")
def build_reports(spark, d):
    return _build(spark, d).reports


@query(f"""WITH {_PROPOSALS}, a AS (SELECT DISTINCT run_id, CASE WHEN k IS NULL THEN 'i' || i ELSE 'k' || k END AS event, unnest([i, i + 1]) AS claim_id FROM z)
SELECT claim_id, count(DISTINCT event) AS events FROM a JOIN orders ON o_orderkey = claim_id AND o_custkey = run_id GROUP BY claim_id""")
def event_claim_links(spark, d):
    return _build(spark, d).links.groupBy("claim_id").agg(F.countDistinct("event_id").alias("events"))


@query(f"WITH {_PROPOSALS} SELECT i * 10 AS candidate_event_id FROM z WHERE created AND k IS NULL AND i % 4 = 0")
def possible_duplicates(spark, d):
    return _build(spark, d).duplicates.select("candidate_event_id")


@query("""WITH x AS (SELECT event_id AS seq, user_id AS parse_id, event_id % 7 AS topic_id, CASE event_type WHEN 'view' THEN 'direct' WHEN 'click' THEN 'background' ELSE 'made up' END AS decision FROM events),
l AS (SELECT parse_id, topic_id, max_by(decision, seq) AS decision FROM x GROUP BY ALL), n AS (SELECT parse_id, topic_id, CASE WHEN decision = 'made up' THEN 'uncertain' ELSE decision END AS decision FROM l)
SELECT parse_id, topic_id, decision, CASE WHEN topic_id < 3 THEN 5 ELSE 1 END AS row_version FROM n WHERE NOT (topic_id < 3 AND decision = 'direct')""")
def route_commits(spark, d):
    """The last decision of every document and topic; what is stored already writes nothing."""
    e = load(spark, d, "events")
    decision = F.when(F.col("event_type") == "view", "direct").when(F.col("event_type") == "click", "background").otherwise("made up")
    x = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("parse_id"), (F.col("event_id") % 7).alias("topic_id"), decision.alias("decision"), F.lit(0.5).alias("confidence"))
    stored = x.filter("topic_id < 3").select("parse_id", "topic_id", F.lit("direct").alias("decision"), F.lit(0.5).alias("confidence"), F.lit(4).alias("row_version")).distinct()
    return commits.route_rows(x, stored).select("parse_id", "topic_id", "decision", F.col("row_version").cast("int").alias("row_version"))


@query("SELECT doc_id AS parse_id, 'b' || pos AS block_id FROM (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS text FROM documents) WHERE trim(text, ' ') <> '' AND pos % 5 = 0")
def uncovered_blocks(spark, d):
    """Lines that no chunk names, if chunks name all but every fifth."""
    from paperloom.plans.catalogue import _lines

    lines = _lines(spark, d).select(F.col("doc_id").alias("parse_id"), "pos", F.concat(F.lit("b"), "pos").alias("block_id"), "text")
    chunks = lines.filter("pos % 5 <> 0").groupBy("parse_id").agg(F.collect_list("block_id").alias("block_ids"))
    return views.uncovered_blocks(lines, chunks)


@query("SELECT o_custkey AS claim_id, l_partkey * 1000000 + l_orderkey * 10 + l_linenumber AS evidence_id, row_number() OVER (PARTITION BY o_custkey ORDER BY l_shipdate, l_partkey * 1000000 + l_orderkey * 10 + l_linenumber) AS nth FROM (SELECT o_custkey, max(o_orderkey) AS rev FROM orders GROUP BY 1) JOIN lineitem ON l_orderkey = rev")
def claim_evidence(spark, d):
    """Customers as claims, their last order as the current revision, its lines as evidence."""
    claims = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("claim_id")).agg(F.max("o_orderkey").alias("current_revision_id"))
    e = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_revision_id"), (F.col("l_partkey") * 1000000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_shipdate").alias("created_at"))
    return views.evidence_of(claims, e).select("claim_id", "evidence_id", F.col("nth").cast("long").alias("nth"))


__all__ = ["ORACLES", "QUERIES"]
