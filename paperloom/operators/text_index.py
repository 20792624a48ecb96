"""Stored inverted lists: term postings for BM25 with block bounds, and gram postings for trigram similarity.

Both are one layout: a row for each key and block of documents (a document's block is a hash of it), with the places of the
key's documents in the block; one more row a block holds the documents themselves. Rows lie in folders by a hash of the key
and are sorted by key, so a search reads only the folders and row groups of the keys it asks for, and no text. The build reads
every text once, a bounded number of documents a task, and packs a block's lists before they are moved; a search never does.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.text import TERM
from paperloom.operators.retrieval import K1, B
from paperloom.session import shared_folder

#: Documents of a block, about; folders of keys, at most.
BLOCK, FOLDERS = 512, 64
#: An entry is a document's place in its block, times ENTRY, and the key's count there.
LISTS, ENTRY = "key string, block long, n int, most int, least int, entries array<long>", 1 << 32
#: A block's documents: the ids of all, then their text hashes, then their sizes; no text has this key.
EVERY = "\0"
#: Blocks whose texts one task splits, and whose lists one task writes; pieces of a block, which has more only of repeated rows.
SPLIT, SLOT, PIECES = 8, 256, 1 << 20
#: A block is cut into pieces at this many entries, or at four times its documents.
MOST_ENTRIES = 1_000_000
#: A block is skipped only if its bound is so far below the k-th score: scores that round alike to six digits are ties.
SLACK = 1e-5
_TERM = re.compile(TERM)
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def term_counts(text: str) -> tuple[int, dict[str, int]]:
    """The number of terms, and how often each lower-cased term occurs."""
    found = Counter(_TERM.findall(text))
    lower: Counter = Counter()
    for term, n in found.items():
        lower[term.lower()] += n
    return sum(lower.values()), lower


@lru_cache(1 << 15)
def _grams_of(word: str) -> tuple[str, ...]:
    padded = f"  {word} "
    return tuple(padded[i : i + 3] for i in range(len(padded) - 2))


def gram_sizes(lowered: str) -> tuple[int, dict[str, int]]:
    """The number of different grams of a lower-cased text, and the grams."""
    grams = dict.fromkeys((gram for word in set(_WORD.findall(lowered)) for gram in _grams_of(word)), 1)
    return len(grams), grams


class _Block:
    """The lists of a piece of a block while its documents come in."""

    def __init__(self):
        self.ids, self.rows, self.sizes = [], [], []
        self.numbers: defaultdict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.keys, self.places, self.counts = array("i"), array("i"), array("i")

    def add(self, id_: int | None, row: int, size: int, own: dict[str, int]) -> None:
        self.keys.extend(map(self.numbers.__getitem__, own))
        self.places.extend(repeat(len(self.ids), len(own)))
        self.counts.extend(own.values())
        self.ids.append(id_)
        self.rows.append(row)
        self.sizes.append(size)

    def packed(self, block: int) -> pa.RecordBatch:
        """A row for each key, and the documents' row first."""
        docs, sizes = len(self.ids), np.array(self.sizes, np.int32)
        keys, places, counts = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (self.keys, self.places, self.counts))
        order = np.argsort(keys, kind="stable")
        places, counts = places[order], counts[order]
        n = np.bincount(keys, minlength=len(self.numbers))
        starts = np.cumsum(n) - n
        most, least = (f.reduceat(x, starts) if len(n) else x[:0] for f, x in ((np.maximum, counts), (np.minimum, sizes[places])))
        own = pa.array([*self.ids, *self.rows, *self.sizes], pa.int64())
        entries = pa.concat_arrays([own, pa.array(places.astype(np.int64) * ENTRY + counts)])
        offsets = np.concatenate([[0, 3 * docs], 3 * docs + np.cumsum(n)]).astype(np.int32)
        first = lambda x, rest: pa.array(np.concatenate([[x], rest]).astype(np.int32))
        columns = [pa.array([EVERY, *self.numbers], pa.string()), pa.array(np.full(len(n) + 1, block, np.int64)), first(docs, n), first(0, most), first(sizes.min(), least)]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), entries)], ["key", "block", "n", "most", "least", "entries"])


@dataclass
class Lists:
    """A row for each key and block: (folder, key, block, n, most, least, entries)."""

    spark: SparkSession
    path: str
    folders: int

    @classmethod
    def write(cls, docs: DataFrame, id_col: str, text_col: str, split: Callable[[str], tuple[int, dict[str, int]]], folder: str | None, lowered: bool = False, block: int = BLOCK) -> Lists:
        spark = docs.sparkSession
        path = f"{folder or shared_folder(spark)}/lists-{uuid.uuid4().hex}"
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), (F.lower(text) if lowered else text).alias("t"))
        n_docs = docs.count()
        blocks, folders = max(1, -(-n_docs // block)), max(1, min(FOLDERS, n_docs // 1000))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, piece, held = None, 0, _Block()
            for batch in batches:
                for i in range(batch.num_rows):
                    id_, row, t, own_block = (batch.column(c)[i].as_py() for c in ("id", "row", "t", "block"))
                    if held.ids and (own_block != at or len(held.ids) >= 4 * block or len(held.keys) >= MOST_ENTRIES):
                        yield held.packed(at * PIECES + piece)
                        piece, held = piece + 1 if own_block == at else 0, _Block()
                    at = own_block
                    held.add(id_, row, *split(t))
            if held.ids:
                yield held.packed(at * PIECES + piece)

        # tasks have a bounded number of documents at any size, and those of a block come one after the other
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "row"), F.lit(blocks)))
        rows = rows.repartition(-(-blocks // SPLIT), "block").sortWithinPartitions("block", "id", "row")
        lists = rows.mapInArrow(run, LISTS).withColumn("folder", F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(folders)).cast("int"))
        # a task has a folder's keys of SLOT blocks
        slots = -(-blocks // SLOT)
        slot = F.pmod(F.floor(F.col("block") / PIECES), F.lit(slots))
        dealt = lists.repartition(folders * slots, "folder", slot).sortWithinPartitions("folder", "key", "block")
        dealt.write.partitionBy("folder").parquet(path)
        return cls(spark, path, folders)

    def folder_of(self, key: str) -> int:
        return zlib.crc32(key.encode()) % self.folders

    def read(self, keys: list[str]) -> DataFrame:
        """The lists of these keys; only their folders and row groups are read."""
        d = self.spark.read.schema(f"{LISTS}, folder int").parquet(self.path)
        return d.filter(F.col("folder").isin(sorted({self.folder_of(k) for k in keys})) & F.col("key").isin(keys))

    def entries(self, lists: DataFrame) -> DataFrame:
        """(key, block, place, id, row, count, size) of each document of the lists; block and place tell documents apart."""
        docs = self.read([EVERY]).select("block", F.col("n").alias("_n"), F.col("entries").alias("_docs"))

        def each(e):
            place = F.shiftright(e, 32).cast("int")
            own = [F.get("_docs", place + F.col("_n") * k) for k in range(3)]
            return F.struct(place.alias("place"), own[0].alias("id"), own[1].alias("row"), e.bitwiseAND(F.lit(ENTRY - 1)).cast("int").alias("count"), own[2].cast("int").alias("size"))

        return lists.select("key", "block", "entries").join(docs, "block").select("key", "block", F.inline(F.transform("entries", each)))

    def documents_of(self, keys: list[str]) -> dict[str, int]:
        return {r["key"]: r["docs"] for r in self.read(keys).groupBy("key").agg(F.sum("n").alias("docs")).collect()}  # one number for each asked key

    def totals(self) -> tuple[int, int]:
        """Documents, and the sum of their sizes."""
        d = self.read([EVERY]).agg(F.sum("n").alias("docs"), F.sum(F.aggregate(F.slice("entries", F.col("n") * 2 + 1, F.col("n")), F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")).first()
        return d["docs"] or 0, d["total"] or 0


class TermIndex:
    """BM25 over stored postings, with the same scores as ``retrieval.bm25``."""

    def __init__(self, lists: Lists):
        self.lists = lists
        self.docs, total = lists.totals()
        self.average = total / max(1, self.docs)

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, block: int = BLOCK) -> TermIndex:
        return cls(Lists.write(docs, id_col, text_col, term_counts, folder, block=block))

    def _share(self, count: str, size: str, k1: float, b: float):
        return F.col(count) * (k1 + 1) / (F.col(count) + k1 * (1 - b + b * F.col(size) / F.lit(max(self.average, 1e-9))))

    def _idf(self, terms: list[str]):
        """The weight of each asked term as a column; terms that no document has get none."""
        out, held = F.lit(None).cast("double"), self.lists.documents_of(terms)
        for term, df in held.items():
            out = F.when(F.col("key") == term, F.lit(math.log(1 + (self.docs - df + 0.5) / (df + 0.5)))).otherwise(out)
        return out

    def scores(self, terms: list[str], k1: float = K1, b: float = B, require_all: bool = False, lists: DataFrame | None = None) -> DataFrame:
        """(id, row, score > 0) of every document that has a term (or all of them)."""
        asked = list(dict.fromkeys(t.strip().lower() for t in terms if t.strip()))
        d = self.lists.entries(lists if lists is not None else self.lists.read(asked))
        d = d.withColumn("part", self._idf(asked) * self._share("count", "size", k1, b))
        d = d.groupBy("block", "place").agg(F.first("id").alias("id"), F.first("row").alias("row"), F.sum("part").alias("score"), F.count("*").alias("terms"))
        return (d.filter(F.col("terms") == len(asked)) if require_all else d).select("id", "row", "score")

    def best(self, terms: list[str], k: int, k1: float = K1, b: float = B, seeds: int = 4) -> DataFrame:
        """(id, row, score) of the k best. Blocks whose bound is below the k-th score of the best-bounded blocks aren't read."""
        asked = list(dict.fromkeys(t.strip().lower() for t in terms if t.strip()))
        return self._top(self.scores(asked, k1, b, lists=self.surviving(asked, k, k1, b, seeds)), k)

    def _top(self, scored: DataFrame, k: int) -> DataFrame:
        return scored.orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row").limit(k)

    def surviving(self, asked: list[str], k: int, k1: float = K1, b: float = B, seeds: int = 4) -> DataFrame:
        """The lists of the blocks that may hold one of the k best: bounds are read without the documents."""
        lists = self.lists.read(asked)
        bounds = lists.select("block", (self._idf(asked) * self._share("most", "least", k1, b)).alias("bound"), "n").groupBy("block").agg(F.sum("bound").alias("bound"), F.max("n").alias("n"))
        order, held = bounds.orderBy(F.desc("bound"), "block"), []
        for r in order.limit(max(seeds, -(-2 * k // BLOCK))).collect():  # a few blocks by parameter
            held.append(r["block"])
        if not held:
            return lists
        first = self._top(self.scores(asked, k1, b, lists=lists.filter(F.col("block").isin(held))), k).agg(F.count("*"), F.min("score")).first()
        if first[0] < k:
            return lists
        return lists.join(bounds.filter(F.col("bound") >= first[1] - SLACK).select("block"), "block", "left_semi")


class GramIndex:
    """Trigram similarity over stored gram lists."""

    def __init__(self, lists: Lists):
        self.lists = lists

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> GramIndex:
        return cls(Lists.write(docs, id_col, text_col, gram_sizes, folder, lowered=True))

    def hits(self, aliases: list[str], threshold: float, k: int | None = None, within: DataFrame | None = None) -> DataFrame:
        """(alias_no, alias, id, row, score, rank) of the documents at or above the threshold, per alias in order.

        A document needs at least T = ceil(threshold * |query|) of the query's grams, so it has one of the query's
        |query| - T + 1 rarest: these lists give the candidates, and only for them the other lists are counted.
        ``within`` (id, row) keeps documents of a scope before the k best are taken.
        """
        out: DataFrame | None = None
        for no, alias in enumerate(aliases):
            grams = list(gram_sizes(alias.lower())[1])
            if not grams:
                continue
            held = self.lists.documents_of(grams)
            need = max(1, math.ceil(threshold * len(grams) - 1e-9))
            rare = sorted(grams, key=lambda g: (held.get(g, 0), g))[: len(grams) - need + 1]
            small = F.col("size") <= F.lit(len(grams) / threshold + 1e-9) if threshold > 0 else F.lit(True)
            d = self.lists.entries(self.lists.read(rare)).filter(small)
            if common := [g for g in grams if g not in rare]:
                rest = self.lists.entries(self.lists.read(common)).filter(small)
                d = d.unionByName(rest.join(d.select("block", "place").distinct(), ["block", "place"], "left_semi"))
            d = d.groupBy("block", "place").agg(F.first("id").alias("id"), F.first("row").alias("row"), F.count("*").alias("same"), F.first("size").alias("size"))
            d = d.select("id", "row", (F.col("same") / (len(grams) + F.col("size") - F.col("same"))).alias("score")).filter(F.col("score") >= threshold)
            d = d.withColumns({"alias_no": F.lit(no), "alias": F.lit(alias)})
            out = d if out is None else out.unionByName(d)
        if out is None:
            return self.lists.spark.createDataFrame([], "alias_no int, alias string, id long, row long, score double, rank int")
        if within is not None:
            out = out.join(within.select("id", "row"), ["id", "row"], "left_semi")
        w = Window.partitionBy("alias_no").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
        out = out.withColumn("rank", F.row_number().over(w)).select("alias_no", "alias", "id", "row", "score", "rank")
        return out if k is None else out.filter(F.col("rank") <= k)
