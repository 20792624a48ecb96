"""Hybrid retrieval: postings and BM25, exact neighbours, trigram aliases, proximity; fusion and pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import TERM, query_terms, trigram_similarity, trigrams

K1, B = 1.5, 0.75
RRF_K = 60
PAGE = 100
#: Vectors and queries that are scored at once.
VECTORS, QUERIES = 4096, 256
_NO_ID = 2**63 - 1


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), F.lower)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, dl) of every term: the index table."""
    d = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    d = d.select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return d.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def _occurrences(word: str) -> Column:
    return F.size(F.filter("t", lambda x: x == word))


def bm25(docs: DataFrame, terms: list[str], k1: float = K1, b: float = B, id_col: str = "doc_id", text_col: str = "text", require_all: bool = False) -> DataFrame:
    """(id, score > 0). Only the query's terms leave the scan; document lengths are summed, not moved.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)).
    """
    asked = list(dict.fromkeys(t.strip().lower() for t in terms if t.strip()))
    d = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    d = d.select("id", F.size("t").alias("dl"), *[_occurrences(w).alias(f"tf{k}") for k, w in enumerate(asked)])
    facts = d.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{k}") > 0).cast("long")).alias(f"df{k}") for k in range(len(asked))])
    hit = F.lit(False)
    for k in range(len(asked)):
        hit = hit | (F.col(f"tf{k}") > 0)
    scored = d.filter(hit).join(F.broadcast(facts))  # one row of totals
    total, every = F.lit(0.0), F.lit(True)
    for k in range(len(asked)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        total = total + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        every = every & (tf > 0)
    return (scored.filter(every) if require_all else scored).select("id", total.alias("score"))


def cosine_distance(a: Column, b: Column) -> Column:
    wide = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(wide(a), wide(b)) / (F.sqrt(dot(wide(a), wide(a))) * F.sqrt(dot(wide(b), wide(b))))


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Exact neighbours by cosine distance; rows without a vector never match."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = vectors.filter(F.col(column).isNotNull()).select(F.col(id_col).alias("id"), cosine_distance(F.col(column), q).alias("distance"))
    return d.orderBy("distance", "id").limit(k)


def _blocks(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """Blocks of at most size rows (id, row, cell, v): a row each, with the columns' values as bytes; v as unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                v = np.array(part.column("v").to_pylist(), np.float64)
                length = np.sqrt((v * v).sum(1))
                good = length > 0  # without a direction nothing is near
                if not good.any():
                    continue
                own = [part.column(c).to_numpy()[good].tobytes() for c in ("id", "row", "cell")]
                own.append((v[good] / length[good, None]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in own], [f"{prefix}{c}" for c in ("id", "row", "cell", "v")])

    return rows.mapInArrow(run, ", ".join(f"{prefix}{c} binary" for c in ("id", "row", "cell", "v")))


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", column: str = "embedding", cell: str | None = None) -> DataFrame:
    """(query_id, query_row, id, distance, rank): the exact k neighbours of every query among all vectors, by (distance, id).

    Blocks of queries meet blocks of vectors. A task keeps the best k of each of its queries, and only these are ranked.
    Distances are cosine distances to nine digits, so that equal vectors tie. ``query_row`` tells queries of one id
    apart. With ``cell`` only vectors equal to the query in that column are candidates.
    """

    def rows(d: DataFrame) -> DataFrame:
        own = F.xxhash64(cell) if cell else F.lit(0).cast("long")
        d = d.filter(F.col(column).isNotNull() & (F.col(cell).isNotNull() if cell else F.lit(True)))
        return d.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(column).alias("row"), own.alias("cell"), F.col(column).cast("array<double>").alias("v"))

    def best(q: np.ndarray, ids: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, far, q))
        q, ids, far = q[order], ids[order], far[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[top], ids[top], far[top]

    def near(part: pa.RecordBatch, at: int, kept: dict) -> None:
        """Keeps the best of one block of vectors for one block of queries; nothing else outlives the call."""
        of = lambda c, kind=np.int64: np.frombuffer(part.column(c)[at].as_buffer(), kind)
        key, ids = (part.column("qid")[at].as_py(), part.column("qrow")[at].as_py(), part.column("qcell")[at].as_py()), of("vid")
        n = len(key[0]) // 8
        far = of("qv", np.float64).reshape(n, -1) @ of("vv", np.float64).reshape(len(ids), -1).T
        np.subtract(1, far, out=far)
        np.round(far, 9, out=far)
        far += 0.0
        if cell:
            far[of("qcell")[:, None] != of("vcell")] = np.inf
        last = np.partition(far, k - 1, axis=1)[:, k - 1 : k].copy() if len(ids) > k else np.full((n, 1), np.inf)
        i, j = np.nonzero((far <= last) & (far < np.inf))
        new = (i, ids[j], far[i, j])
        kept[key] = best(*(np.concatenate(x) for x in zip(kept[key], new))) if key in kept else best(*new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[bytes, bytes, bytes], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                near(batch, at, kept)
            del batch
        for (qid, qrow, _), (i, ids, far) in kept.items():
            own = [np.frombuffer(x, np.int64)[i] for x in (qid, qrow)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, ids, far)], ["query_id", "query_row", "id", "distance"])

    asked = _blocks(rows(queries).dropDuplicates(["id", "row", "cell"]), QUERIES, "q")
    d = _blocks(rows(vectors), VECTORS, "v").crossJoin(asked).mapInArrow(run, "query_id long, query_row long, id long, distance double")
    w = Window.partitionBy("query_id", "query_row").orderBy("distance", "id")
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(real("query_id"), "query_row", real("id"), "distance", "rank")


def recall_each(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """query_id, found, wanted, recall of every query that has exact neighbours (rows of ``nearest_each``)."""
    keys = ["query_id", "query_row", "id"]
    hit = approximate.select(*keys).distinct().withColumn("hit", F.lit(1))
    d = exact.select(*keys).distinct().join(hit, keys, "left").groupBy("query_id", "query_row").agg(F.count("hit").alias("found"), F.count("*").alias("wanted"))
    return d.select("query_id", "found", "wanted", (F.col("found") / F.col("wanted")).alias("recall"))


def alias_hits(docs: DataFrame, aliases: list[str], threshold: float, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per alias the k texts of the highest trigram similarity above the threshold."""
    d = docs.select(F.col(id_col).alias("id"), trigrams(F.col(text_col)).alias("g"))
    d = d.select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("alias_no"), F.lit(a).alias("alias"), trigram_similarity(F.col("g"), trigrams(F.lit(a))).alias("score")) for n, a in enumerate(aliases)])).alias("h"))
    d = d.select("id", "h.*").filter(F.col("score") >= threshold)
    w = Window.partitionBy("alias_no").orderBy(F.desc("score"), "id")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def channel(hits: DataFrame, name: str, order: list[Column], k: int) -> DataFrame:
    """(id, channel, rank0): a channel's first k hits. The limit is the channel's own parameter."""
    top = hits.orderBy(*order).limit(k)
    return top.withColumn("rank0", F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order)) - 1).select("id", F.lit(name).alias("channel"), "rank0")


def fuse(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion over every hit of every channel: (id, score, provenance); nothing is dropped."""
    return hits.groupBy("id").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank0"))).alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("channel", "rank0"))), lambda h: F.concat_ws(":", h["channel"], h["rank0"])), ",").alias("provenance"),
    )


def recall_page(fused: DataFrame, offset: int, seen: DataFrame | None = None, size: int = PAGE) -> DataFrame:
    """Rows offset..offset+size of the whole fused order, without those seen, with how many remain after it."""
    rows = fused if seen is None else fused.join(seen.select("id"), "id", "left_anti")
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc("score"), "id").offset(offset).limit(size)
    ranked = page.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")) + offset)
    return ranked.join(F.broadcast(total)).withColumn("remaining", F.greatest(F.col("total") - (offset + size), F.lit(0))).drop("total")


def recall_at_k(exact: DataFrame, approximate: DataFrame, key: str = "id") -> DataFrame:
    """One row: found, wanted, recall; 1.0 where nothing is wanted."""
    e = exact.select(key).distinct()
    found = e.join(approximate.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("found"))
    d = e.agg(F.count("*").alias("wanted")).join(found)
    return d.select("found", "wanted", F.when(F.col("wanted") == 0, 1.0).otherwise(F.col("found") / F.col("wanted")).alias("recall"))


__all__ = ["alias_hits", "bm25", "channel", "cosine_distance", "fuse", "nearest", "nearest_each", "postings", "query_terms", "recall_at_k", "recall_each", "recall_page"]
