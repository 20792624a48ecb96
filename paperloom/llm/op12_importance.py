"""Importance resampling towards a target distribution, with hashed n-grams.

A text is lower-cased (A-Z only) and its separators are collapsed to single spaces; one scan of the result with
``finditer(overlapped=True)`` and lookarounds at word boundaries then gives the span of every n-gram, whose bytes are
counted by CRC. The scan runs once: a document's buckets are written as two bytes each, and both the corpus counts and
the weights are sums over these. A bucket's gain is its log ratio between target and corpus; a document's weight is the
mean gain of its features; adding Gumbel noise from a hash of the id and taking the highest scores draws without
replacement.

Ranks need no global sort: scores are whole numbers of a bounded range, so the histogram of scores (its size is bounded
by ``ln`` of the counts and by the 32 bits of the noise, whatever the input) tells how many documents stand above each.

Defined results: a null or empty text has no feature and weight 0; a null id hashes as an empty one and stands after all
ids of its score; equal scores go by id, then by a hash of the text; repeated rows are documents of their own; very long
texts are scanned whole; an empty target or an empty table counts nothing (an empty table gives no rows); only id and
text are read, so further columns can't clash.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import cut_lineage, map_arrow, row_key, table, text_of

BUCKETS = 10_000
LONGEST, LEAST_WORDS, PERCENT, SEED = 1, 20, 10, 2024
_SEPARATORS = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def gram_pattern(n: int) -> regex.Pattern:
    """n words, one space apart, from a word's beginning to a word's end."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def buckets_of(text: str, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[int, list[int]]:
    """The number of words, and the bucket of every run of 1 to ``longest`` words."""
    line = _SEPARATORS.sub(b" ", text.encode().lower()).strip(b" ")
    out: list[int] = []
    n_words = 0
    for n in range(1, longest + 1):
        found = [zlib.crc32(m[0]) % buckets for m in gram_pattern(n).finditer(line, overlapped=True)]
        n_words = len(found) if n == 1 else n_words
        out += found
    return n_words, out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, row, n_words, grams: the buckets as little-endian unsigned 16-bit integers."""
    if buckets > 1 << 16:
        raise ValueError("buckets are stored in 16 bits")

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [buckets_of(t, longest, buckets) for t in batch.column("t").to_pylist()]
        grams = pa.array([np.array(found, "<u2").tobytes() for _, found in rows], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([n for n, _ in rows], pa.int64()), grams], ["doc_id", "row", "n_words", "grams"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"), text_of(text_col).alias("t"))
    return map_arrow(rows, scan, "doc_id long, row long, n_words long, grams binary")


def _joined(grams: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(grams.to_pylist()), "<u2")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket: one row for each bucket and task travels, and one each to the driver."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_joined(batch.column("grams")), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    sums = found.select("grams").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the corpus."""
    n = len(corpus)
    s_all, t_all = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(found: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, row, n_words, n_features, weight, score. The gains are one number for each bucket."""

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = pc.binary_length(batch.column("grams")).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        sums = np.concatenate([[0], np.cumsum(gain[_joined(batch.column("grams"))])])
        ends = np.cumsum(sizes)
        weight = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
        score = weight + np.array([noise(i, seed) for i in batch.column("doc_id").to_pylist()], np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("n_words"), pa.array(sizes), pa.array(weight), pa.array(score)], ["doc_id", "row", "n_words", "n_features", "weight", "score"])

    return map_arrow(found, weigh, "doc_id long, row long, n_words long, n_features long, weight long, score long")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank: 1, 2, 3... for the drawn documents by score, then id; null for the others."""
    levels = sorted(scored.filter(F.col("n_words") >= least_words).groupBy("score").count().collect(), reverse=True)  # one row a score
    wanted = percent * sum(r["count"] for r in levels) // 100
    above, ahead = 0, []
    for r in levels:
        if above >= wanted:
            break
        ahead.append((r["score"], above))
        above += r["count"]
    if not ahead:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    enough, cut = F.col("n_words") >= least_words, ahead[-1][0]
    drawn = scored.filter(enough & (F.col("score") >= cut))
    offsets = scored.sparkSession.createDataFrame(ahead, "score long, above long")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    drawn = drawn.join(F.broadcast(offsets), "score").withColumn("rank", F.col("above") + F.row_number().over(order))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*scored.columns, "rank")
    return drawn.unionByName(scored.filter(~enough | (F.col("score") < cut)).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document with its features, weight, score and, if it is drawn, its rank."""
    found = cut_lineage(features(docs, id_col, text_col, longest))
    goal = features(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text")), longest=longest)
    gain = gains(bucket_counts(found), bucket_counts(goal))
    return draw(cut_lineage(scores(found, gain, seed)), percent, least_words)


def query(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
