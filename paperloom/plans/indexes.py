"""Registered queries over stored indexes and scoped recall.

An index is built once a session and path, and kept in the shared folder: the queries after the first read only it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import recall as rc
from paperloom.operators import retrieval
from paperloom.operators.text_index import GramIndex, TermIndex
from paperloom.operators.vector_index import VectorIndex, gate_report
from paperloom.plans.catalogue import _ALIAS, _BM25, _DIST, _EACH, _GRAMS, _TOKENS, TERMS, query, rounded
from paperloom.plans.records import ORACLES, QUERIES
from paperloom.tables import load

_BUILT: dict[tuple, object] = {}


def built(kind: str, make: Callable[[DataFrame], object], spark: SparkSession, d: str, table: str):
    key = (spark.sparkContext.applicationId, kind, d)
    if key not in _BUILT:
        _BUILT[key] = make(load(spark, d, table))
    return _BUILT[key]


def term_index(spark: SparkSession, d: str) -> TermIndex:
    return built("terms", TermIndex.build, spark, d, "documents")


def gram_index(spark: SparkSession, d: str) -> GramIndex:
    return built("grams", GramIndex.build, spark, d, "documents")


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 100")
def bm25_topk(spark, d):
    """The best 100 by block bounds; one place more than asked for, since equal rounded scores go by id."""
    index = term_index(spark, d)
    scores = index.scores(TERMS, lists=index.surviving(TERMS, 100))
    return scores.select(F.col("id").alias("doc_id"), rounded("score").alias("score")).orderBy(F.desc("score"), "doc_id").limit(100)


_FUSED = f"""
WITH {_BM25},
a AS (SELECT doc_id, 'bm25' AS channel, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) - 1 AS r FROM bm QUALIFY r < 100),
b AS (SELECT doc_id, 'recent' AS channel, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents QUALIFY r < 100),
f AS (SELECT doc_id, sum(1.0 / (60 + r)) AS score, string_agg(channel || ':' || r, ',' ORDER BY channel, r) AS provenance
  FROM (FROM a UNION ALL FROM b) GROUP BY doc_id)
"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    bm = bm25_topk(spark, d).withColumnRenamed("doc_id", "id")
    long_ = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    hits = retrieval.channel(bm, "bm25", [F.desc("score"), F.col("id")], 100).unionByName(retrieval.channel(long_, "recent", [F.desc("n_chars"), F.col("id")], 100))
    return retrieval.fuse(hits)


@query(_FUSED + "SELECT doc_id, round(score, 9) AS score, provenance FROM f")
def rrf_fusion(spark, d):
    return _fused(spark, d).select(F.col("id").alias("doc_id"), rounded("score", 9).alias("score"), "provenance")


@query(_FUSED + ", o AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) AS position, count(*) OVER () AS total FROM f) SELECT doc_id, position, greatest(total - 100, 0) AS remaining FROM o WHERE position > 50 AND position <= 100")
def rrf_page2(spark, d):
    fused = _fused(spark, d).withColumn("score", F.round("score", 12))
    return retrieval.recall_page(fused, 50, size=50).select(F.col("id").alias("doc_id"), F.col("position").cast("long").alias("position"), F.col("remaining").cast("long").alias("remaining"))


def _tri(aliases: list[str]) -> str:
    asked = " UNION ALL ".join(f"SELECT {n} AS alias_no, '{a}' AS alias, {_GRAMS.format(repr(a))} AS q" for n, a in enumerate(aliases))
    return f"""asked AS ({asked}), g AS (SELECT doc_id, {_GRAMS.format('text')} AS g FROM documents),
tri AS (SELECT alias_no, alias, doc_id, len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))) AS score FROM g, asked WHERE len(g) > 0)"""


@query(f"WITH {_tri([_ALIAS])} SELECT doc_id, round(score, 9) AS score FROM tri WHERE score >= 0.02 ORDER BY tri.score DESC, doc_id LIMIT 50")
def trigram_alias(spark, d):
    return gram_index(spark, d).hits([_ALIAS], 0.02, 50).select(F.col("id").alias("doc_id"), rounded("score", 9).alias("score"))


ALIASES = ["thereation", "nd the", "ciónmente das", "verein tion"]


@query(f"WITH {_tri(ALIASES)} SELECT alias, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY alias_no ORDER BY tri.score DESC, doc_id) AS rank FROM tri WHERE score >= 0.025 QUALIFY rank <= 50")
def trigram_aliases(spark, d):
    hits = gram_index(spark, d).hits(ALIASES, 0.025, 50)
    return hits.select("alias", F.col("id").alias("doc_id"), rounded("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


# --- approximate neighbours ------------------------------------------------------------------------------------------


def _asked(v: DataFrame) -> DataFrame:
    return v.filter(F.col("vec_id") % 100 == 0)


def vector_index(spark: SparkSession, d: str) -> VectorIndex:
    def make(v: DataFrame) -> VectorIndex:
        index = VectorIndex.build(v)
        index.calibrate(_asked(v), 10)
        return index

    return built("vectors", make, spark, d, "embeddings")


def ann_neighbours(spark, d):
    """Every hundredth vector's ten neighbours by the index. It is approximate, so no SQL; the gate has."""
    v = load(spark, d, "embeddings")
    got = vector_index(spark, d).search(_asked(v), 10)
    return got.select("query_id", F.col("id").alias("vec_id"), rounded("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


query()(ann_neighbours)


@query(f"""WITH {_EACH}, e AS (SELECT query_id, vec_id FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10)
SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, TRUE AS passes FROM e""")
def ann_gate(spark, d):
    """The switch of the index: its recall over all queries against the exact neighbours; SQL has the exact side."""
    return gate_report(vector_index(spark, d).recall(_asked(load(spark, d, "embeddings")), 10)).select("queries", F.col("wanted").cast("long").alias("wanted"), "passes")


# --- recall within a scope -------------------------------------------------------------------------------------------

OWNER, INDUSTRY, TOPIC = "o1", "en", "src3"


def scope_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """documents as chunks: two of one parse, two parses' captures of one document, whose first chunk names the industry."""
    owner = F.lit(OWNER).alias("owner_id")
    chunks = docs.select(owner, F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 2).alias("parse_id"))
    parses = chunks.select("owner_id", "parse_id", (F.col("parse_id") + 7).alias("capture_id")).distinct()
    captures = parses.select("owner_id", "capture_id", F.floor(F.col("parse_id") / 2).alias("document_id"))
    documents = docs.groupBy(F.floor(F.col("doc_id") / 4).alias("document_id")).agg(F.min_by("lang", "doc_id").alias("industry_id"), (F.max("n_chars") >= 200).alias("active"))
    return chunks, parses, captures, documents.select(owner, "document_id", "industry_id", "active")


def chain(spark: SparkSession, d: str) -> DataFrame:
    return rc.scope_chain(*scope_tables(load(spark, d, "documents")), OWNER, INDUSTRY)


_CHAIN = f"""own AS (SELECT doc_id // 4 AS document_id FROM documents GROUP BY 1 HAVING min_by(lang, doc_id) = '{INDUSTRY}' AND max(n_chars) >= 200),
chain AS (SELECT doc_id AS chunk_id, doc_id // 2 AS parse_id, doc_id // 4 AS document_id FROM documents WHERE doc_id // 4 IN (FROM own))"""
_HIT_B = "hb AS (SELECT 'bm25' AS channel, document_id, parse_id, chunk_id, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank0 FROM bm JOIN chain ON doc_id = chunk_id QUALIFY rank0 < 100)"
_HIT_A = """ha0 AS (SELECT alias_no, document_id, parse_id, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY alias_no ORDER BY round(score, 9) DESC, chunk_id) AS n FROM tri JOIN chain ON doc_id = chunk_id WHERE tri.score >= 0.025 QUALIFY n <= 50),
ha AS (SELECT 'alias' AS channel, document_id, parse_id, chunk_id, score, row_number() OVER (ORDER BY alias_no, n) - 1 AS rank0 FROM ha0)"""
_HIT_S = f"""hs AS (SELECT 'semantic' AS channel, document_id, parse_id, chunk_id, 1 - far AS score, row_number() OVER (ORDER BY 1 - far DESC, chunk_id) - 1 AS rank0
  FROM (SELECT vec_id, round({_DIST}, 9) AS far FROM (SELECT vec_id, embedding AS e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) AS q FROM embeddings)) JOIN chain ON vec_id = chunk_id QUALIFY rank0 < 100)"""
_HIT_P = f"""hp AS (SELECT 'proximity' AS channel, document_id, parse_id, NULL::BIGINT AS chunk_id, 1.0::DOUBLE AS score, row_number() OVER (ORDER BY newest DESC, document_id, parse_id) - 1 AS rank0
  FROM (SELECT doc_id // 4 AS document_id, doc_id // 2 AS parse_id, max(n_chars) AS newest FROM documents WHERE source = '{TOPIC}' AND doc_id // 4 IN (FROM own) GROUP BY ALL) QUALIFY rank0 < 100)"""
_ALL_HITS = f"WITH {_BM25}, {_tri(ALIASES)}, {_CHAIN}, {_HIT_B}, {_HIT_A}, {_HIT_S}, {_HIT_P}, hits AS (FROM hb UNION ALL FROM ha UNION ALL FROM hs UNION ALL FROM hp)"


def _channels(spark: SparkSession, d: str) -> dict[str, DataFrame | None]:
    docs, vectors = load(spark, d, "documents"), load(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    inside = chain(spark, d)
    links = docs.select(F.col("source").alias("topic_id"), F.floor(F.col("doc_id") / 4).alias("document_id"), F.floor(F.col("doc_id") / 2).alias("parse_id"), F.col("n_chars").alias("updated_at"))
    return {
        rc.SEMANTIC: rc.semantic_hits(vectors, inside, vectors.orderBy("chunk_id").limit(1), 100),
        rc.BM25: rc.bm25_hits(term_index(spark, d), inside, TERMS, 100),
        rc.ALIAS: rc.alias_hits(gram_index(spark, d), inside, ALIASES, 0.025, 50),
        rc.PROXIMITY: rc.proximity_hits(links, inside, TOPIC, 100),
    }


@query(f"WITH {_CHAIN} SELECT chunk_id, parse_id, document_id FROM chain")
def recall_scope(spark, d):
    return chain(spark, d)


@query(f"{_ALL_HITS} SELECT channel, document_id, parse_id, chunk_id, round(score, 6) AS score, rank0 FROM hits")
def recall_hits(spark, d):
    """Every channel's hits in the scope: terms, vectors, aliases, and the topic's own documents."""
    hits = rc.recall(_channels(spark, d)).hits
    return hits.select("channel", "document_id", "parse_id", "chunk_id", rounded("score").alias("score"), F.col("rank0").cast("long").alias("rank0"))


_PAGE = """, f AS (SELECT document_id, round(sum(1.0 / (60 + rank0)), 12) AS score, string_agg(channel || ':' || rank0, ',' ORDER BY channel, rank0) AS provenance FROM hits GROUP BY document_id),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, document_id) AS position FROM f)"""


@query(f"{_ALL_HITS} {_PAGE} SELECT document_id, round(score, 9) AS score, provenance, position FROM o WHERE position > 20 AND position <= 60 AND document_id NOT IN (SELECT document_id FROM hp)")
def recall_scoped_page(spark, d):
    """The second page of the fused order, without the documents that the topic has already."""
    channels = _channels(spark, d)
    page = rc.recall(channels, 20, channels[rc.PROXIMITY], 40)
    return page.rows.select("document_id", rounded("score", 9).alias("score"), "provenance", "position")


@query(f"{_ALL_HITS}, h AS (SELECT * FROM hits WHERE channel <> 'semantic') SELECT channel, count(*) AS hits, count(DISTINCT document_id) AS of_documents, greatest((SELECT count(DISTINCT document_id) FROM h) - 100, 0) AS remaining FROM h GROUP BY channel")
def recall_coverage(spark, d):
    """Without a query vector the semantic channel is skipped, and the manifest says so."""
    page = rc.recall(_channels(spark, d) | {rc.SEMANTIC: None})
    return page.coverage.select("channel", "hits", "of_documents", "remaining")


@query(f"{_ALL_HITS} SELECT 1::BIGINT AS job_id, channel, parse_id, chunk_id, rank0 + 1 AS rank FROM hits WHERE chunk_id IS NULL OR (parse_id, chunk_id) NOT IN (SELECT (parse_id, chunk_id) FROM hb) QUALIFY row_number() OVER (PARTITION BY parse_id, chunk_id ORDER BY channel, rank0) = 1")
def recall_recorded(spark, d):
    """A page's hits that aren't recorded yet, where the term channel's were recorded before."""
    channels = _channels(spark, d)
    stored = channels[rc.BM25].withColumn("job_id", F.lit(1).cast("long"))
    return rc.new_hits(stored, rc.recall(channels).hits, 1).select("job_id", "channel", "parse_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


__all__ = ["ORACLES", "QUERIES"]
