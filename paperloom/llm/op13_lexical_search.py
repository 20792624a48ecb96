"""Ranked lexical search: the k best documents of every query by a whole-number BM25, with bit-sliced Bloom signatures.

The documents of a task are taken in blocks of similar size. A block's signature is a Bloom filter for each document,
stored by slices: one bitmap over the block's documents for each bit of the filter. A term is looked up by the AND of its
slices, which may overestimate but never miss a document. Besides its terms, a document enters each term that it has at
least 2 and at least 4 times, so the slices also bound how often a term occurs. The weighted sums of these bitmaps, with
each document's own length norm, give an upper bound of its score for each query. A document is excluded only if that
bound is below the task's k-th best exact score so far; all others are scored exactly from their term counts.

Two passes read the texts: one counts documents, terms and each query term's documents exactly, one searches. A task
gives at most k rows for each query; these meet in two steps, so no group gets the rows of all tasks at once. Queries are
taken in blocks of at most about ``PER_PASS``, whose terms are all that is sent to the executors.

Defined results: a null or empty text has no term, neither as document nor as query (such a query has no row); rows that
share a query id are one query with the terms of all of them; repeated documents are documents of their own, equal
scores go by id (a null id last), then by a hash of the text; very long texts are searched whole; empty tables give no
rows; only ids and texts are read, so further columns can't clash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import LAST_ID, row_key, table, text_of

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: The weights of length and of the term count's saturation, in hundredths and thousandths.
LENGTH, K1 = 50, 20
SCALE = 1_000_000_000
#: Queries a pass, about: a bound on what is sent to the executors.
PER_PASS = 2_000
#: A block has at most so many documents and bytes of text; its slices at most so many bits.
BLOCK_ROWS, BLOCK_BYTES, BLOCK_BITS = 1_024, 16 << 20, 1 << 27
#: A term that a document has at least so many times enters its signature once more.
LEVELS = (1, 2, 4)
#: Bits of the filter for each entry, and slices a term.
BITS, SLICES = 16, 3
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def terms(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())


def norm(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - LENGTH + (LENGTH * n * n_docs) // n_terms


def part(tf, m):
    """What a term of weight 1 adds to a score."""
    return (SCALE * tf) // (1000 * tf + K1 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Documents of similar size: term counts, lengths, and the signature by slices."""

    def __init__(self, counts: list[Counter], keys: list[tuple], norms: np.ndarray):
        self.counts, self.keys, self.norms = counts, keys, norms
        entries = [[zlib.crc32(t) ^ (0x9E3779B1 * level & 0xFFFFFFFF) for t, tf in c.items() for level, least in enumerate(LEVELS) if tf >= least] for c in counts]
        self.bits = BITS << max(1, max(map(len, entries)) - 1).bit_length()
        at = np.repeat(np.arange(len(counts)), [len(x) for x in entries])
        rows = places(np.array([x for e in entries for x in e], np.uint64), self.bits)
        set_ = np.zeros((self.bits, len(counts)), bool)
        for s in range(SLICES):
            set_[rows[:, s], at] = True
        self.slices = np.packbits(set_, axis=1)

    def present(self, hashes: np.ndarray) -> np.ndarray:
        """Bytes 0 and 1, a row for each hash and a column for each document: 1 where the document may have the entry."""
        rows = places(hashes, self.bits)
        found = self.slices[rows[:, 0]]
        for s in range(1, SLICES):
            found &= self.slices[rows[:, s]]
        return np.unpackbits(found, axis=1, count=len(self.counts))

    def steps(self) -> np.ndarray:
        """For each level and document: how much more a term of weight 1 can add once it is at that level."""
        tops = [part(nxt - 1, self.norms) + 1 for nxt in LEVELS[1:]] + [np.full(len(self.norms), SCALE // 1000)]
        tops = np.array(tops, float)
        return np.diff(tops, axis=0, prepend=0)


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The slices of each hash; bits is a power of two."""
    return ((hashes[:, None] * _MIX[None, :]) >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)


class Queries:
    """Terms of each query as positions in one vocabulary."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]]):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.terms = [np.array(sorted(self.vocabulary.setdefault(t, len(self.vocabulary)) for t in set(own)), np.int64) for _, own in items]
        self.words = list(self.vocabulary)
        crc = np.array([zlib.crc32(t) for t in self.words], np.uint64)
        self.hashes = [crc ^ np.uint64(0x9E3779B1 * level & 0xFFFFFFFF) for level in range(len(LEVELS))]


def upper_bounds(block: Block, queries: Queries, weights: np.ndarray) -> np.ndarray:
    """No document's score for a query exceeds its bound: queries x documents."""
    out = np.zeros((len(queries.terms), len(block.counts)))
    for step, hashes in zip(block.steps(), queries.hashes):
        bits = block.present(hashes)
        for q, own in enumerate(queries.terms):
            out[q] += (weights[own] @ bits[own]) * step
    return out


class Best:
    """The k best documents of one query so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        return self.rows[-1][0] if len(self.rows) >= self.k else 1

    def add(self, rows: list[tuple]) -> None:
        self.rows = sorted(self.rows + rows, key=lambda r: (-r[0], *r[1]))[: self.k]


def search_block(block: Block, queries: Queries, weights: list[int], best: list[Best]) -> int:
    """Score exactly what the bounds don't exclude, highest bounds first; how many documents that were."""
    bounds, scored = upper_bounds(block, queries, np.array(weights, float)), 0
    for q, own in enumerate(queries.terms):
        order = np.flatnonzero(bounds[q] >= best[q].least)
        order = order[np.argsort(-bounds[q][order], kind="stable")]
        pairs = [(queries.words[t], weights[t]) for t in own.tolist()]
        for some in np.split(order, range(64, len(order), 64)):
            if not len(some) or bounds[q][some[0]] < best[q].least:
                break
            rows = []
            for d in some.tolist():
                counts, m = block.counts[d], int(block.norms[d])
                score = sum(w * part(counts[t], m) for t, w in pairs if t in counts)
                if score > 0:
                    rows.append((score, block.keys[d]))
            scored += len(some)
            best[q].add(rows)
    return scored


def blocks(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[Block]:
    """The documents of a task, a limited number of bytes at a time, by the number of their distinct terms."""
    held, size = [], 0

    def cut() -> Iterator[Block]:
        held.sort(key=lambda x: len(x[0]))
        while held:
            most = BLOCK_BITS // (BITS * 4 * len(held[-1][0]))
            own = [held.pop() for _ in range(min(len(held), BLOCK_ROWS, max(1, most)))]
            yield Block([x[0] for x in own], [x[1] for x in own], np.array([norm(x[2], n_docs, n_terms) for x in own], np.int64))

    for batch in batches:
        for doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "t"))):
            if found := terms(text):
                held.append((Counter(found), (doc_id is None, LAST_ID if doc_id is None else doc_id, row), len(found)))
                size += len(text)
            if size >= BLOCK_BYTES or len(held) >= 4 * BLOCK_ROWS:
                yield from cut()
                size = 0
    yield from cut()


def corpus_counts(rows: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, list[int]]:
    """Documents with a term, terms in all, and each vocabulary term's documents."""
    v = len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(v + 2, np.int64)
        for batch in batches:
            for text in batch.column("t").to_pylist():
                if found := terms(text):
                    total[v:] += (1, len(found))
                    total[[vocabulary[t] for t in vocabulary.keys() & set(found)]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["at", "n"])

    out = [0] * (v + 2)
    for r in rows.select("t").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # one row a term
        out[r["at"]] = r["n"]
    return out[v], out[v + 1], out[:v]


def _one_pass(rows: DataFrame, queries: Queries, k: int) -> DataFrame:
    n_docs, n_terms, df = corpus_counts(rows, queries.vocabulary)
    weights = [weight(n_docs, n) for n in df]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries.ids]
        for block in blocks(batches, n_docs, max(1, n_terms)):
            search_block(block, queries, weights, best)
        found = [(queries.ids[q], None if key[0] else key[1], key[2], score) for q, b in enumerate(best) for score, key in b.rows]
        columns = list(zip(*found)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "row", "score"])

    found = rows.mapInArrow(search, "item_id long, doc_id long, row long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    # task numbers in a square: first the k best of a side's tasks, then of all sides
    found = found.withColumn("side", F.floor(F.sqrt(F.spark_partition_id())))
    first = Window.partitionBy("item_id", "side").orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 for every item."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"), text_of(text_col).alias("t"))
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), text_of(item_text).alias("t"))
    passes = max(1, -(-asked.count() // PER_PASS))
    out: DataFrame | None = None
    for p in range(passes):
        own: dict[int | None, list[bytes]] = {}
        for r in asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).toLocalIterator():
            own.setdefault(r["item_id"], []).extend(terms(r["t"]))
        found = _one_pass(rows, Queries([(i, t) for i, t in own.items() if t]), k)
        out = found if out is None else out.unionByName(found)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs
), scored AS (
  SELECT item_id, tf.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN lengths ON lengths.doc_id = tf.doc_id, total GROUP BY item_id, tf.doc_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
