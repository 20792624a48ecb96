"""Byte-level BPE with Spark's higher-order functions.

The words of a bounded sample of documents are encoded first. Then documents of one task are gathered to blocks of a
bounded number of characters. A block holds its other distinct words (matches of the split pattern) as arrays of
byte tokens, and every document as positions in the list of both. Ranked merges are folded over each distinct word once:
the state is the word's tokens and the ranks of its neighbours, looked up in a literal rank map; every step merges the
first pair of lowest rank. Documents then take their words' ids by position, and decoding joins the ids' byte pieces.

The rank map is an array of small maps, found by a hash of the pair, because Spark searches a map entry by entry.
Vocabulary entries that merges alone don't reach (none in the shipped ranks) are looked up as whole words, as the
tiktoken library does. The fold costs the square of a word's length, so words above ``LONG`` bytes (text without blanks)
are merged from a heap in their task instead, which gives the same ids.

Defined results: a null text is an empty one and has no tokens; a null id is passed through; repeated rows are
encoded alike; a text larger than a block is a block of its own; an empty table gives no rows; only id and text are
read, so further columns can't clash.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import map_arrow, table, text_of

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Characters of text in one block.
BLOCK = 16_000_000
#: Documents whose words are folded before all others, and the characters of one at most.
SAMPLE, SAMPLE_CHARACTERS = 16_000, 20_000
#: Bytes of a word that the fold takes at most.
LONG = 128
BUCKETS = 1 << 17
_NO_RANK = 2**31 - 1


@functools.lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def pair_ranks(path: str) -> dict[tuple[int, int], int]:
    """The token that two tokens merge to, for all splits of the vocabulary's entries."""
    ranks = read_ranks(path)
    out = {}
    for word, rank in ranks.items():
        for k in range(1, len(word)):
            a, b = ranks.get(word[:k]), ranks.get(word[k:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


def merge(word: bytes, path: str) -> list[int]:
    """The plain merge of one word; tells which entries merges reach."""
    ranks, pairs = read_ranks(path), pair_ranks(path)
    t = [ranks[bytes([c])] for c in word]
    while len(t) > 1:
        best = min((pairs.get(p, _NO_RANK), k) for k, p in enumerate(zip(t, t[1:])))
        if best[0] == _NO_RANK:
            break
        t[best[1] : best[1] + 2] = [best[0]]
    return t


def merge_long(word: bytes, path: str) -> list[int]:
    """As ``merge``, from a heap of pairs over linked tokens: for words that would stall the fold."""
    ranks, pairs = read_ranks(path), pair_ranks(path)
    t: list[int | None] = [ranks[bytes([c])] for c in word]
    n = len(t)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(t, t[1:])) if (r := pairs.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, k, a, b = heapq.heappop(heap)
        right = after[k]
        if t[k] != a or right >= n or t[right] != b:
            continue  # one of the two was merged since
        t[k], t[right], after[k] = rank, None, after[right]
        if after[k] < n:
            before[after[k]] = k
        for left in (before[k], k):
            if left >= 0 and after[left] < n and (r := pairs.get((t[left], t[after[left]]))) is not None:
                heapq.heappush(heap, (r, left, t[left], t[after[left]]))
    return [x for x in t if x is not None]


@functools.lru_cache(maxsize=2)
def unreached(path: str) -> dict[bytes, int]:
    return {w: r for w, r in read_ranks(path).items() if merge(w, path) != [r]}


def _bucket(a: int, b: int) -> int:
    return (a * 40503 + b * 977) & (BUCKETS - 1)


def literals(spark: SparkSession, path: str) -> DataFrame:
    """One row: the buckets of the rank map. Its size is bounded by the vocabulary."""
    buckets: list[dict[int, int]] = [{} for _ in range(BUCKETS)]
    for (a, b), rank in pair_ranks(path).items():
        buckets[_bucket(a, b)][a << 17 | b] = rank
    return spark.createDataFrame([(buckets,)], "ranks array<map<bigint,int>>")


#: The shipped pattern for the standard library's engine, which is faster; equal to it on characters below U+0250
#: without the four separators that only that engine takes for white space. Letters, digits and blanks are spelled out.
_L, _D, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t-\r\x20\x85\xa0"
_LATIN = re.compile(rf" ?[{_L}]+| ?[{_D}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}{_D}]+|\s+(?!\S)|\s+")
_NOT_LATIN = re.compile("[^\x00-\x1b\x20-ɏ]")


@functools.lru_cache(maxsize=2)
def splitter(pattern: str):
    """A function from a text to the pattern's matches."""
    import regex

    exact = regex.compile(pattern).findall
    if pattern != PATTERN:
        return exact
    return lambda text: exact(text) if _NOT_LATIN.search(text) else _LATIN.findall(text)


def _lists(sizes: np.ndarray, values) -> pa.ListArray:
    values = pa.array(values) if isinstance(values, np.ndarray) else values
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


BLOCK_SCHEMA = "words array<array<int>>, known array<array<int>>, docs array<struct<doc_id:bigint,at:array<int>>>"


class Known:
    """Words whose ids are known already: a dictionary of places in one flat array."""

    def __init__(self, words: list[str], size: np.ndarray, flat: np.ndarray):
        self.place = {w: k for k, w in enumerate(words)}
        self.size, self.end, self.flat = size, np.cumsum(size), flat

    def of(self, places: list[int]) -> pa.ListArray:
        size = self.size[places]
        start = np.repeat(self.end[places] - size, size)
        return _lists(size, self.flat[start + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)])


def _byte_tokens(words: list[str], path: str) -> pa.ListArray:
    """Tokens to fold: a word's bytes; its ids where they need no fold (whole entries, long words)."""
    ranks, whole = read_ranks(path), unreached(path)
    byte = np.array([ranks[bytes([c])] for c in range(256)], np.int32)
    raw = [w.encode() for w in words]
    size = np.array([len(x) for x in raw], np.int64)
    if not len(size):
        return _lists(size, np.zeros(0, np.int32))
    if not whole and size.max() <= LONG:
        return _lists(size, byte[np.frombuffer(b"".join(raw), np.uint8)])
    one = lambda w: np.array([whole[w]] if w in whole else merge_long(w, path), np.int32) if w in whole or len(w) > LONG else byte[np.frombuffer(w, np.uint8)]
    tokens = list(map(one, raw))
    return _lists(np.array([len(x) for x in tokens], np.int64), np.concatenate(tokens))


def blocks(docs: DataFrame, known, path: str = RANKS, pattern: str = PATTERN, block: int = BLOCK) -> DataFrame:
    """docs (doc_id and positions of their words), the ids of known words, and the other distinct words' byte tokens.

    known is a broadcast of ``Known``. Words that need no fold have their ids as tokens; folding them again changes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, cache = splitter(pattern), known.value

        def flush(own: dict[str, int], ids: list, held: list[np.ndarray]) -> pa.RecordBatch:
            place = np.array([cache.place.get(w, -1) for w in own], np.int64)
            old = place >= 0
            number = np.where(old, np.cumsum(old) - 1, old.sum() + np.cumsum(~old) - 1).astype(np.int32)
            at = number[np.concatenate(held)] if len(number) else np.zeros(0, np.int32)
            docs_ = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), _lists(np.array([len(x) for x in held]), at)], ["doc_id", "at"])
            fresh = [w for w, o in zip(own, old.tolist()) if not o]
            one = lambda n, x: _lists(np.array([n]), x)
            return pa.RecordBatch.from_arrays(
                [one(len(fresh), _byte_tokens(fresh, path)), one(int(old.sum()), cache.of(place[old].tolist())), one(len(ids), docs_)], ["words", "known", "docs"]
            )

        own: dict[str, int] = {}
        ids, held, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                t = text.as_py()
                if size and size + len(t) > block:
                    yield flush(own, ids, held)
                    own, ids, held, size = {}, [], [], 0
                held.append(np.array([own.setdefault(w, len(own)) for w in find(t)], np.int32))
                ids.append(doc_id)
                size += len(t) + 1
        if held:
            yield flush(own, ids, held)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, BLOCK_SCHEMA)


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def fold_merges(tokens: Column, ranks: Column) -> Column:
    """array<int>: ranked merges folded over one word's tokens."""

    def rank(a: Column, b: Column) -> Column:
        bucket = (a * 40503 + b * 977).bitwiseAND(F.lit(BUCKETS - 1))
        key = a.cast("bigint") * (1 << 17) + b
        return F.coalesce(F.try_element_at(ranks[bucket], key), F.lit(_NO_RANK))

    neighbours = F.transform(F.slice(tokens, F.lit(2), F.size(tokens)), lambda b, i: rank(tokens[i], b))

    def step(acc: Column, _: Column) -> Column:
        t, r = acc["t"], acc["r"]

        def at(m: Column) -> Column:
            def merged(p: Column) -> Column:  # pair p is merged: token p becomes m, token p + 1 goes
                new_t = F.filter(F.transform(t, lambda x, i: F.when(i == p, m).otherwise(x)), lambda x, i: i != p + 1)
                beside = lambda x, i: F.when(i == p - 1, rank(t[i], m)).when(i == p + 1, rank(m, t[i + 1])).otherwise(x)
                new_r = F.filter(F.transform(r, beside), lambda x, i: i != p)
                return F.struct(new_t.alias("t"), new_r.alias("r"))

            return F.when((m == _NO_RANK) | m.isNull(), acc).otherwise(_let(F.array_position(r, m).cast("int") - 1, merged))

        return _let(F.array_min(r), at)

    return _let(neighbours, lambda n: F.aggregate(n, F.struct(tokens.alias("t"), n.alias("r")), step, lambda acc: acc["t"]))


def known_words(docs: DataFrame, vocabulary: DataFrame, path: str, pattern: str, sample: int = SAMPLE) -> Known:
    """The words of a bounded sample of documents, folded once, so that blocks needn't fold them again.

    It only saves work: what it lacks is folded in its block. Its size is bounded by about ``sample`` different texts
    of at most ``SAMPLE_CHARACTERS`` characters; repeated rows are chosen together and add no word.
    """
    share = sample / max(1, docs.count())
    some = docs.select(F.xxhash64("doc_id", "text").alias("k"), text_of().alias("text")).filter(F.length("text") <= SAMPLE_CHARACTERS)
    if share < 1:
        some = some.filter(F.pmod("k", F.lit(1 << 20)) < int(share * (1 << 20)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, words = splitter(pattern), set()
        for batch in batches:
            for text in batch.column("text"):
                words.update(find(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string())], ["word"])

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = batch.column("list").to_pylist()
        tokens = pa.concat_arrays([_byte_tokens(w, path) for w in words])
        return pa.RecordBatch.from_arrays([batch.column("list"), _lists(np.array([len(w) for w in words]), tokens)], ["list", "tokens"])

    lists = some.mapInArrow(split, "word string").groupBy(F.pmod(F.hash("word"), F.lit(48)).alias("k")).agg(F.collect_set("word").alias("list"))
    d = map_arrow(lists, listed, "list array<string>, tokens array<array<int>>").withColumn("ranks", vocabulary.select("ranks").scalar())
    got = d.select("list", _folded("tokens")).toArrow().combine_chunks()
    if not got.num_rows:
        return Known([], np.zeros(0, np.int64), np.zeros(0, np.int32))
    words, ids = (got.column(k).combine_chunks().flatten() for k in (0, 1))
    return Known(words.to_pylist(), np.diff(ids.offsets.to_numpy()).astype(np.int64), ids.flatten().to_numpy())


def _folded(column: str) -> Column:
    ranks = F.col("ranks")
    return F.transform(column, lambda w: F.when(F.size(w).between(2, LONG), fold_merges(w, ranks)).otherwise(w)).alias("ids")


def _blocks_with_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (structs of doc_id and places of words) and ids (of every word) of each block."""
    vocabulary = literals(docs.sparkSession, path)
    known = docs.sparkSession.sparkContext.broadcast(known_words(docs, vocabulary, path, pattern))
    b = blocks(docs, known, path, pattern).withColumn("ranks", vocabulary.select("ranks").scalar())
    return b.select("docs", "known", _folded("words").alias("folded")).select("docs", F.concat("known", "folded").alias("ids"))


def _per_document(block: pa.RecordBatch, row: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of the documents of one block."""
    words = block.column("ids")[row].values
    flat, edge = words.values.to_numpy(), words.offsets.to_numpy()
    start, size = edge[:-1].astype(np.int64), np.diff(edge).astype(np.int64)
    docs = block.column("docs")[row].values
    for doc_id, at in zip(docs.field("doc_id").to_pylist(), docs.field("at")):
        place = at.values.to_numpy() if len(at) else np.zeros(0, np.int32)
        n = size[place]
        ends = np.cumsum(n)
        yield doc_id, flat[np.repeat(start[place] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def _over_documents(blocks_: DataFrame, one, schema: str, columns: list[tuple[str, pa.DataType]]) -> DataFrame:
    """one(doc_id, ids) for every document of the blocks, a bounded number of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held = []
                for doc_id, ids in _per_document(batch, row):
                    held.append(one(doc_id, ids))
                    if len(held) == 1000:
                        yield _batch(held, columns)
                        held = []
                if held:
                    yield _batch(held, columns)

    return blocks_.mapInArrow(run, schema)


def _batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), columns)], [n for n, _ in columns])


def encode(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids: as the tiktoken library encodes ordinary text."""
    columns = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]
    return _over_documents(_blocks_with_ids(docs, path, pattern), lambda i, ids: (i, ids), "doc_id long, ids array<int>", columns)


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        out[rank] = word
    return out


def decode(ids, path: str = RANKS) -> bytes:
    """The binary pieces of the ids, joined."""
    return b"".join(map(_pieces(path).__getitem__, ids))


def digests(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def one(doc_id, ids: np.ndarray) -> tuple:
        return doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(ids.tolist(), path)).hexdigest()

    columns = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _over_documents(_blocks_with_ids(docs, path, pattern), one, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
