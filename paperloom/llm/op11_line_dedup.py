"""Incremental line dedup: sharded cuckoo filters backed by exact reference-count tables.

A ``LineIndex`` lives in a folder of the shared storage, as Parquet tables with a version for every change:

``postings``  one row for each line key and document that holds it: the references, from which every count can be told
``counts``    the keys of at least ``min_docs`` documents with their exact number and their last document
``filters``   for each shard of the key space, a cuckoo filter of the keys in ``counts``

``insert`` appends references, ``delete`` takes those of given ids out again. Both recount only the keys they touch;
keys that reach ``min_docs`` enter their shard's filter, keys that fall below leave it (which cuckoo filters allow), and
a filter that gets too full is built anew from the exact table. Deleting what was inserted gives back the same
decisions. ``decide`` sends each reference to its shard's filter first: those not in it are settled without a look-up;
only the rest are checked against the exact counts, so a false positive of the filter changes nothing.

Keys are 128-bit hashes of lines (one collision to be expected among about 2e19 lines). Hot lines: counts are combined
before they move, and a shard with many references is dealt to several groups, each with a copy of its filter.

Defined results: a null or empty text is one empty line and loses nothing; rows with one id are one document, of
null ids each text is a document of its own, smaller than all others; repeated rows get equal results; a line that a
document repeats stays or goes as a whole; very long texts are split whole; an empty table gives none; of the carried
columns only id and text are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import map_arrow, row_key, shared_folder, table, text_of

STRIP = " \t\n\v\f\r"
MIN_CHARS, MIN_DOCS = 20, 3
#: Keys a shard's filter is made for, and references that one task probes at once.
SHARD_KEYS, GROUP_ROWS = 1 << 16, 1 << 18
#: The rows of the table of shards are at most so many; beyond it the filters get larger instead.
MOST_SHARDS = 1 << 14
POSTING = "h1 long, h2 long, doc_id long, row long"
KEY = ["h1", "h2"]
FILTER = "shard int, keys long, full boolean, slots binary"


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The stripped line with A-Z in lower case, if it has ``min_chars`` code points."""
    line = line.strip(STRIP)
    return line.encode().lower() if len(line) >= min_chars else None


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class Cuckoo:
    """Buckets of four 16-bit fingerprints (0: free). Every key has two buckets, either told from the other."""

    SLOTS = 4

    def __init__(self, slots: np.ndarray):
        self.slots = slots.reshape(-1, self.SLOTS)
        self.mask = len(self.slots) - 1

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(np.zeros(cls.SLOTS << max(2, math.ceil(math.log2(max(1, keys) / 3.2))), np.uint16))

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(h2 & 0xFFFF, 1).astype(np.uint16), (h1 >> 16) & self.mask

    def _other(self, marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ ((marks.astype(np.int64) * 0x5BD1E995) & self.mask)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        marks, at = self._places(h1, h2)
        return (self.slots[at] == marks[:, None]).any(1) | (self.slots[self._other(marks, at)] == marks[:, None]).any(1)

    def _put(self, marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Fill free slots; which of the marks found none."""
        order = np.argsort(at, kind="stable")
        first = np.concatenate([[True], at[order][1:] != at[order][:-1]])
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        free = self.slots[at[order]] == 0
        fits = rank < free.sum(1)
        slot = (np.cumsum(free, 1) == (rank + 1)[:, None]).argmax(1)
        self.slots[at[order][fits], slot[fits]] = marks[order][fits]
        left = np.ones(len(at), bool)
        left[order[fits]] = False
        return left

    def insert(self, h1: np.ndarray, h2: np.ndarray, rounds: int = 500) -> bool:
        """Add keys that aren't in yet; False if one of them found no place (the filter must then be built larger)."""
        marks, at = self._places(h1, h2)
        random = np.random.default_rng(len(marks))
        for _ in range(rounds):
            for _ in range(2):
                if not len(marks):
                    return True
                left = self._put(marks, at)
                marks, at = marks[left], self._other(marks, at)[left]
            _, one = np.unique(at, return_index=True)  # one eviction a bucket and round
            slot = random.integers(0, self.SLOTS, len(one))
            out = self.slots[at[one], slot].copy()
            self.slots[at[one], slot] = marks[one]
            marks[one] = out
            at[one] = self._other(out, at[one])
        return not len(marks)

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Take out keys that are in."""
        marks, at = self._places(h1, h2)
        for mark, one, two in zip(marks.tolist(), at.tolist(), self._other(marks, at).tolist()):
            for bucket in (one, two):
                if len(found := np.flatnonzero(self.slots[bucket] == mark)):
                    self.slots[bucket, found[0]] = 0
                    break


def postings_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, doc_id, row: each key of each row of docs once."""

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, which = [], []
        for i, text in enumerate(batch.column("t").to_pylist()):
            own = {key_hash(k) for line in text.split("\n") if (k := line_key(line, min_chars)) is not None}
            hashes += own
            which += [i] * len(own)
        h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        ids = batch.select(["doc_id", "row"]).take(pa.array(which, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), ids.column(0), ids.column(1)], ["h1", "h2", "doc_id", "row"])

    return map_arrow(_rows(docs, id_col, text_col), split, POSTING)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row, t: row tells documents without an id apart and is null for all others."""
    own_id = F.col(id_col).cast("long")
    return docs.select(own_id.alias("doc_id"), F.when(own_id.isNull(), row_key(id_col, text_col)).alias("row"), text_of(text_col).alias("t"))


def count_keys(postings: DataFrame) -> DataFrame:
    """h1, h2, docs, last_id, last_row: distinct documents of each key and the largest of them."""
    return postings.dropDuplicates([*KEY, "doc_id", "row"]).groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last_id"), F.max("row").alias("last_row"))


class LineIndex:
    def __init__(self, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS):
        self.spark, self.folder, self.min_docs, self.min_chars, self.shard_keys = spark, folder.rstrip("/"), min_docs, min_chars, shard_keys
        self.version, self.shards = 0, 0
        self.refs: list[str] = []

    @classmethod
    def new(cls, spark: SparkSession, **settings) -> LineIndex:
        return cls(spark, f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}", **settings)

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}-{self.version}"
        df.write.parquet(path)
        return path

    def postings(self) -> DataFrame:
        """References of the live documents."""
        return self.spark.read.schema(POSTING).parquet(*self.refs) if self.refs else self.spark.createDataFrame([], POSTING)

    def counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/counts-{self.version}")

    def filters(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/filters-{self.version}")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add documents. An id that is in already gets these lines besides those it has."""
        first = not self.refs
        self.version += 1
        self.refs = [*self.refs, self._write(postings_of(docs, id_col, text_col, self.min_chars), "postings")]
        self._refresh(None if first else self.spark.read.parquet(self.refs[-1]).select(*KEY).distinct())

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Take out the documents of these ids (a null one names none) and all that they counted for."""
        if not self.refs:
            return
        self.version += 1
        gone = ids.select(F.col(id_col).cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull()).distinct()
        touched = self.spark.read.parquet(self._write(self.postings().join(gone, "doc_id", "left_semi").select(*KEY).distinct(), "touched"))
        self.refs = [self._write(self.postings().join(gone, "doc_id", "left_anti"), "postings")]
        self._refresh(touched)

    def _refresh(self, touched: DataFrame | None) -> None:
        """Count the touched keys (None: all) anew and bring counts and filters up to date."""
        counted = self.postings() if touched is None else self.postings().join(touched, KEY, "left_semi")
        now = count_keys(counted).filter(F.col("docs") >= self.min_docs)
        if touched is None:
            self._write(now, "counts")
            return self._build()
        before = self.spark.read.parquet(f"{self.folder}/counts-{self.version - 1}")
        self._write(before.join(touched, KEY, "left_anti").unionByName(now), "counts")
        old, new = before.select(*KEY), self.counts().select(*KEY)
        changes = new.join(old, KEY, "left_anti").withColumn("sign", F.lit(1)).unionByName(old.join(new, KEY, "left_anti").withColumn("sign", F.lit(-1)))
        filters = self.spark.read.parquet(f"{self.folder}/filters-{self.version - 1}")
        update = filters.groupBy("shard").cogroup(self._sharded(changes).groupBy("shard")).applyInArrow(_changed, FILTER)
        path = self._write(update, "filters")
        if self.spark.read.parquet(path).filter("full").take(1):
            self.version += 1
            for name in ("counts",):
                self._write(self.spark.read.parquet(f"{self.folder}/{name}-{self.version - 1}"), name)
            self._build()

    def _sharded(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", (F.col("h1").bitwiseAND(F.lit(self.shards - 1))).cast("int"))

    def _build(self) -> None:
        """All filters from the exact table."""
        keys = self.counts().count()
        self.shards = min(MOST_SHARDS, 1 << max(0, math.ceil(math.log2(max(1, keys) / self.shard_keys))))
        every = self.spark.range(self.shards).select(F.col("id").cast("int").alias("shard"))
        added = self._sharded(self.counts().select(*KEY)).withColumn("sign", F.lit(1))
        empty = every.select("shard", F.lit(0).cast("long").alias("keys"), F.lit(False).alias("full"), F.lit(b"").alias("slots"))
        self._write(empty.groupBy("shard").cogroup(added.groupBy("shard")).applyInArrow(_changed, FILTER), "filters")

    def suspects(self) -> DataFrame:
        """References whose key its shard's filter may hold; a shard with many of them is dealt to several groups."""
        rows = self._sharded(self.postings())
        sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("deals"))  # at most MOST_SHARDS rows
        sizes = F.broadcast(sizes)
        rows = rows.join(sizes, "shard").withColumn("deal", F.pmod(F.xxhash64("doc_id", "row", "h2"), F.col("deals")).cast("int")).drop("deals")
        filters = self.filters().join(sizes, "shard").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
        return filters.groupBy("shard", "deal").cogroup(rows.groupBy("shard", "deal")).applyInArrow(_probed, POSTING)

    def losses(self) -> DataFrame:
        """doc_id, row, drop: for documents that lose lines, the hashes of these."""
        found = self.suspects().join(self.counts(), KEY)
        held = F.when(F.col("last_id").isNull(), F.col("row") != F.col("last_row")).otherwise(F.coalesce(F.col("doc_id") != F.col("last_id"), F.lit(True)))
        return found.filter(held).groupBy("doc_id", "row").agg(F.collect_set(F.struct(*KEY)).alias("drop"))

    def decide(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, kept, n_lines, n_dropped for documents of the index."""
        min_chars = self.min_chars
        rows, lost = _rows(docs, id_col, text_col).alias("a"), self.losses().alias("b")
        same = (F.coalesce(F.col("a.doc_id"), F.col("a.row")) == F.coalesce(F.col("b.doc_id"), F.col("b.row"))) & (F.col("a.doc_id").isNull() == F.col("b.doc_id").isNull())
        packed = F.col("b.drop")
        joined = rows.join(lost, same, "left").select("a.doc_id", "a.t", F.transform(packed, lambda x: x["h1"]).alias("d1"), F.transform(packed, lambda x: x["h2"]).alias("d2"))

        def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, d1, d2 in zip(*(batch.column(c).to_pylist() for c in ("t", "d1", "d2"))):
                lines = text.split("\n")
                if d1:
                    drop = {np.array(x, "<i8").tobytes() for x in zip(d1, d2)}
                    kept = [x for x in lines if (k := line_key(x, min_chars)) is None or key_hash(k) not in drop]
                else:
                    kept = lines
                out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
            kept_, n, dropped = zip(*out)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept_, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "kept", "n_lines", "n_dropped"])

        return map_arrow(joined, keep, "doc_id long, kept string, n_lines long, n_dropped long")


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(n).to_numpy() for n in names]


def _changed(filters: pa.Table, changes: pa.Table) -> pa.Table:
    """A shard's filter after its changes; full if it should be built larger."""
    shard, keys, slots = (filters.column(c)[0].as_py() for c in ("shard", "keys", "slots"))
    h1, h2, sign = _columns(changes, "h1", "h2", "sign")
    held = Cuckoo(np.frombuffer(slots, np.uint16).copy()) if slots else Cuckoo.sized(len(h1))
    held.delete(h1[sign < 0], h2[sign < 0])
    keys += int(sign.sum())
    full = keys > 0.9 * held.slots.size or not held.insert(h1[sign > 0], h2[sign > 0])
    return pa.table({"shard": pa.array([shard], pa.int32()), "keys": pa.array([keys], pa.int64()), "full": [full], "slots": pa.array([held.slots.tobytes()], pa.binary())})


def _probed(filters: pa.Table, rows: pa.Table) -> pa.Table:
    rows = rows.select(["h1", "h2", "doc_id", "row"])
    if not rows.num_rows:
        return rows
    held = Cuckoo(np.frombuffer(filters.column("slots")[0].as_py(), np.uint16))
    return rows.filter(pa.array(held.contains(*_columns(rows, "h1", "h2"))))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = LineIndex.new(spark)
    index.insert(docs)
    return index.decide(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), counted AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM keyed k LEFT JOIN counted c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
