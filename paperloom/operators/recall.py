"""Recall within a scope: every channel goes through the chain chunk, parse, capture, industry document before its limit.

A channel gives hits (channel, document_id, parse_id, chunk_id, score, rank0, reason). ``recall`` runs the channels that a query
can have, fuses every hit, and gives a page with its manifest; ``new_hits`` is what of a page is to be recorded.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators import retrieval
from paperloom.operators.text_index import GramIndex, TermIndex

HIT = "channel string, document_id long, parse_id long, chunk_id long, score double, rank0 int, reason string"
BM25, SEMANTIC, ALIAS, PROXIMITY = "bm25", "semantic", "alias", "proximity"
NO_VECTOR = "skipped_no_embedding"


def scope_chain(chunks: DataFrame, parses: DataFrame, captures: DataFrame, documents: DataFrame, owner: str, industry: str) -> DataFrame:
    """(chunk_id, parse_id, document_id) of the owner's chunks whose document is active in the industry.

    Every join is on the owner and the next table's own key, so no row multiplies; the scope prunes each table at its
    scan, and documents first.
    """
    own = lambda d, *c: d.filter(F.col("owner_id") == owner).select("owner_id", *c)
    d = own(documents.filter((F.col("industry_id") == industry) & F.col("active")), "document_id")
    d = own(captures, "capture_id", "document_id").join(d, ["owner_id", "document_id"])
    d = own(parses, "parse_id", "capture_id").join(d, ["owner_id", "capture_id"])
    return own(chunks, "chunk_id", "parse_id").join(d, ["owner_id", "parse_id"]).select("chunk_id", "parse_id", "document_id")


def _ranked(hits: DataFrame, channel: str, k: int, reason: Column, order: list[Column] | None = None) -> DataFrame:
    """The channel's first k hits of the scope."""
    order = order or [F.desc("score"), F.col("chunk_id")]
    top = hits.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(F.lit(channel)).orderBy(*order)) - 1
    return top.select(F.lit(channel).alias("channel"), "document_id", "parse_id", "chunk_id", F.col("score").cast("double").alias("score"), rank.cast("int").alias("rank0"), reason.alias("reason"))


def bm25_hits(index: TermIndex, chain: DataFrame, terms: list[str], k: int) -> DataFrame:
    """Ids of the index are chunk ids. Scores count over the whole index, hits only within the scope."""
    d = index.scores(terms).select(F.col("id").alias("chunk_id"), F.round("score", 9).alias("score")).join(chain, "chunk_id")
    return _ranked(d, BM25, k, F.lit("terms: " + " ".join(dict.fromkeys(t.strip().lower() for t in terms if t.strip()))))


def semantic_hits(vectors: DataFrame, chain: DataFrame, query: DataFrame, k: int, id_col: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """query: one row (id, vector). Score is 1 - cosine distance; chunks without a vector are a gap, not a hit."""
    inside = vectors.select(F.col(id_col).alias("chunk_id"), F.col(column).alias("v")).join(chain, "chunk_id")
    asked = query.select(F.col(id_col).alias("chunk_id"), F.col(column).alias("v"))
    near = retrieval.nearest_each(inside.select("chunk_id", "v"), asked, k, "chunk_id", "v")
    d = near.select(F.col("id").alias("chunk_id"), (1 - F.col("distance")).alias("score")).join(chain, "chunk_id")
    return _ranked(d, SEMANTIC, k, F.lit("cosine"))


def alias_hits(index: GramIndex, chain: DataFrame, aliases: list[str], threshold: float, k: int) -> DataFrame:
    """One search an alias, each with the channel's limit, one after the other in the aliases' order."""
    d = index.hits(aliases, threshold).drop("rank").withColumnRenamed("id", "chunk_id").join(chain, "chunk_id").withColumn("score", F.round("score", 9))
    each = Window.partitionBy("alias_no").orderBy(F.desc("score"), "chunk_id")
    d = d.withColumn("n", F.row_number().over(each)).filter(F.col("n") <= k)
    return _ranked(d, ALIAS, k * max(1, len(aliases)), F.concat(F.lit("alias: "), F.col("alias")), [F.col("alias_no"), F.col("n")])


def proximity_hits(links: DataFrame, chain: DataFrame, topic: str, k: int) -> DataFrame:
    """links: (topic_id, document_id, parse_id, updated_at), the topic's accepted documents; those of the scope, newest first.

    A hit is a document's, without a chunk, and scores 1.0.
    """
    d = links.filter(F.col("topic_id") == topic).groupBy("document_id", "parse_id").agg(F.max("updated_at").alias("newest"))
    d = d.join(chain.select("document_id", "parse_id").distinct(), ["document_id", "parse_id"], "left_semi")
    d = d.withColumns({"chunk_id": F.lit(None).cast("long"), "score": F.lit(1.0)})
    return _ranked(d, PROXIMITY, k, F.lit(f"topic: {topic}"), [F.desc("newest"), F.col("document_id"), F.col("parse_id")])


def fuse(hits: DataFrame, k: int = retrieval.RRF_K) -> DataFrame:
    """(document_id, score, provenance): the sum of 1 / (k + rank) over every hit of every channel; none is dropped."""
    why = F.array_sort(F.collect_list(F.struct("channel", "rank0", "chunk_id")))
    text = F.transform(why, lambda h: F.concat_ws(":", h["channel"], h["rank0"]))
    return hits.groupBy("document_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank0"))).alias("score"), F.array_join(text, ",").alias("provenance"))


@dataclass
class Page:
    rows: DataFrame
    hits: DataFrame
    coverage: DataFrame
    manifest: dict = field(default_factory=dict)


def recall(channels: dict[str, DataFrame | None], offset: int = 0, seen: DataFrame | None = None, size: int = retrieval.PAGE) -> Page:
    """A page of the fused order. A channel that is None can't be asked (no query vector): it is named as skipped.

    ``seen`` (document_id) are documents of earlier pages: they leave the page, not the order, so offsets stay.
    """
    asked = {name: hits for name, hits in channels.items() if hits is not None}
    if not asked:
        raise ValueError("no channel can be asked")
    hits = None
    for d in asked.values():
        hits = d if hits is None else hits.unionByName(d)
    order = [F.desc("score"), F.col("document_id")]
    fused = fuse(hits).withColumn("score", F.round("score", 12))
    page = fused.orderBy(*order).offset(offset).limit(size)
    page = page.withColumn("position", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + offset).cast("long"))
    page = page if seen is None else page.join(seen.select("document_id").distinct(), "document_id", "left_anti")
    total = fused.agg(F.count("*").alias("documents"))
    counts = hits.groupBy("channel").agg(F.count("*").alias("hits"), F.countDistinct("document_id").alias("of_documents"))
    coverage = counts.join(F.broadcast(total)).withColumn("remaining", F.greatest(F.col("documents") - (offset + size), F.lit(0)))  # one row of totals
    skipped = {name: NO_VECTOR for name, d in channels.items() if d is None}
    return Page(page, hits, coverage, {"channels": list(asked), "skipped": skipped, "cursor": {"offset": offset + size}})


def new_hits(stored: DataFrame, page_hits: DataFrame, job: int) -> DataFrame:
    """What is to be recorded of a job's hits (job_id, channel, parse_id, chunk_id, rank, score, reason).

    The first hit of a job, parse and chunk is recorded; one without a chunk counts once a parse within the page. A chunk that the job has
    recorded already is left out; a null chunk never conflicts with a stored one, as in SQL.
    """
    d = page_hits.select(F.lit(job).cast("long").alias("job_id"), "channel", "parse_id", "chunk_id", (F.col("rank0") + 1).alias("rank"), "score", "reason")
    first = Window.partitionBy("job_id", "parse_id", "chunk_id").orderBy("channel", "rank")
    d = d.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    return d.join(stored.select("job_id", "parse_id", "chunk_id"), ["job_id", "parse_id", "chunk_id"], "left_anti").select("job_id", "channel", "parse_id", "chunk_id", "rank", "score", "reason")
