"""Substring dedup by relative Lempel-Ziv parsing against anchored reference blocks.

Every window of 20 words is filed under its anchor: the smallest hash of its six-word grams. Equal windows have equal
anchors, so the reference block of an anchor holds every earlier occurrence of its windows, and a document's consecutive
windows of one anchor form one segment that is sent to one block: every document meets every block that can hold a
match of it.

In a block the segments are parsed greedily, in order of (doc_id, row, start), against those before them: a factor is the
longest match that begins at a position, with its source, and the next one begins where it ends. At that boundary, and
at the segment's ends, the windows across it are checked by themselves: each that occurs earlier begins a factor of its
own. Factors are at least 20 words long; those that meet or overlap make one duplicate span.

Within a task, windows that repeat in the same chunk of documents are settled before the shuffle (as factors of their
first source): only their first occurrence travels, so that groups of copies shrink by the chunk's size before they meet.
Anchors that many documents of a bounded sample share (a licence line in a third of all documents) are split by the
window's hash, so no block is large; the sample only decides how blocks are laid out, never what is found.

Hashes: words by 64 bits, windows by 48 bits within an anchor of 64 bits.

Defined results: a null text has no words; a null id counts as the largest; rows that repeat an id with one text are
one document (they don't make each other duplicates), with different texts they are different documents, ordered by
``row_key``; texts under 20 words lose nothing; very long texts are hashed whole, their spans merged per document; an
empty table gives none. Carried columns keep their names, whatever they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import LAST_ID, map_arrow, row_key, table, text_of

WINDOW, GRAM = 20, 6
#: Anchors are hot that this share of all documents have, or so many documents; a sample of at least so many tells.
HOT, HOT_ROWS, SAMPLE = 0.01, 20_000, 5_000
#: Of hot anchors at most so many, the commonest, are split.
MOST_HOT = 1 << 20
#: Matches grow by single windows up to so many.
STEPS = 24
#: Words that a task handles at once.
CHUNK = 1_000_000
CACHE = 500_000
#: Segments parsed together; their blocks are numbered by 16 bits.
MOST_ROWS = 10_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RNG = np.random.default_rng(20)
_OF_WINDOW = _RNG.integers(1, 1 << 63, WINDOW, np.uint64) * np.uint64(2) + np.uint64(1)
_OF_GRAM = _RNG.integers(1, 1 << 63, GRAM, np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(h: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A hash of every len(factors) neighbours."""
    n = len(h) - len(factors) + 1
    out = np.zeros(n, np.uint64)
    for k, f in enumerate(factors):
        out += h[k : k + n] * f
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    reach, out = 1, x
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return out if reach == width else np.minimum(out[: len(x) - width + 1], out[width - reach :])


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs, from flags that are true where one begins."""
    start = np.flatnonzero(breaks)
    return start, np.diff(np.append(start, len(breaks)))


def _anchored(h: np.ndarray, whole: np.ndarray | slice, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and anchor of the windows; a hot anchor is mixed with the window's hash."""
    window = rolling(h, _OF_WINDOW)[whole]
    anchor = sliding_min(rolling(h, _OF_GRAM), WINDOW - GRAM + 1)[whole]
    if len(hot):
        k = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
        anchor = np.where(hot[k] == anchor, mix(anchor ^ window), anchor)
    return window, anchor


_SOURCE = pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64())])
SOURCE = "source struct<doc_id:bigint,row:bigint,start:bigint>"


def _chunk_segments(ids: np.ndarray, keys: np.ndarray, words: list[np.ndarray], hot: np.ndarray) -> pa.RecordBatch | None:
    """Segments and settled factors of documents in order of (id, row): anchor, doc_id, row, start, n, hashes, source.

    Columns are built from arrays, not from lists of objects, and what is done with is let go: a chunk's
    working memory adds to that of the executor's other tasks.
    """
    sizes = np.array([len(w) for w in words])
    h = np.concatenate(words)
    words.clear()
    total = len(h)
    if total < WINDOW:
        return None
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    whole = np.flatnonzero(doc[: total - WINDOW + 1] == doc[WINDOW - 1 :])  # windows within one document
    if not len(whole):
        return None
    window, anchor = _anchored(h, whole, hot)
    del h
    doc = doc[whole]
    start = whole - (np.cumsum(sizes) - sizes)[doc]
    del whole
    # settle what repeats in this chunk; position order is (id, row, start) order
    order = np.argsort(window, kind="stable").astype(np.int32)
    same = np.zeros(len(order), bool)
    same[1:] = (window[order[1:]] == window[order[:-1]]) & (anchor[order[1:]] == anchor[order[:-1]])
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order), dtype=np.int32)))]
    source, again = np.zeros(len(order), np.int32), np.zeros(len(order), bool)
    source[order], again[order] = lead, same
    del order, lead, same
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    known = np.cumsum(fresh)[doc]  # rows of one id and text are the same document
    settled = again & ((known != known[source]) | (start != start[source]))
    del known, again
    breaks = np.ones(len(doc), bool)
    breaks[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    seg, n = _runs(breaks)
    keep = np.add.reduceat(~settled, seg) > 0
    raw = (window >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[np.repeat(keep, n), :6].tobytes()
    del window
    seg, n = seg[keep], n[keep]
    anchor = anchor[seg].view(np.int64)
    breaks[1:] = (settled[1:] != settled[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (settled[1:] & (source[1:] != source[:-1] + 1))
    run, m = _runs(breaks)
    bad = settled[run]
    run, m = run[bad], m[bad]
    at, from_ = np.concatenate([seg, run]), np.concatenate([np.zeros(len(seg), np.int32), source[run]])
    none = np.arange(len(at)) < len(seg)
    offsets = np.concatenate([[0], 6 * np.cumsum(n), np.full(len(run), len(raw))]).astype(np.int32)
    hashes = pa.Array.from_buffers(pa.binary(), len(at), [pa.py_buffer(np.packbits(none, bitorder="little")), pa.py_buffer(offsets), pa.py_buffer(raw)])
    of = doc[from_]
    source = pa.StructArray.from_arrays([pa.array(x) for x in (ids[of], keys[of], start[from_])], fields=list(_SOURCE), mask=pa.array(none))
    anywhere = mix((run + 1).astype(np.uint64)).view(np.int64)  # settled factors only pass through
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (np.concatenate([anchor, anywhere]), ids[doc[at]], keys[doc[at]], start[at].astype(np.int32), np.concatenate([n, m]).astype(np.int32))] + [hashes, source],
        ["anchor", "doc_id", "row", "start", "n", "hashes", "source"],
    )


def segments(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """anchor, doc_id, row, start, n, hashes, source of docs (doc_id, row, text).

    Settled factors have a source and no hashes. hot: the sorted anchors to split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()

        def flush(ids: list[int], keys: list[int], words: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((np.array(keys, np.int64), np.array(ids, np.int64)))
            own = [words[k] for k in order]
            words.clear()
            out = _chunk_segments(np.array(ids, np.int64)[order], np.array(keys, np.int64)[order], own, hot)
            for k in range(0, out.num_rows if out else 0, MOST_ROWS):
                yield out.slice(k, MOST_ROWS)

        ids: list[int] = []
        keys: list[int] = []
        words: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text")):
                own = text.as_py().encode().split()
                if len(own) < WINDOW:
                    continue
                ids.append(doc_id)
                keys.append(key)
                words.append(np.fromiter(map(cache.__getitem__, own), np.uint64, len(own)))
                held += len(own)
                if held > CHUNK:
                    yield from flush(ids, keys, words)
                    ids, keys, words, held = [], [], [], 0
        if ids:
            yield from flush(ids, keys, words)

    return docs.mapInArrow(run, f"anchor long, doc_id long, row long, start int, n int, hashes binary, {SOURCE}")


def hot_anchors(docs: DataFrame, sample: int = SAMPLE, share: float = HOT) -> np.ndarray:
    """Sorted anchors to split, a layout hint of bounded size: those that about ``share`` of all documents have, or ``HOT_ROWS``
    documents where that is less. The sample grows with the corpus so that 20 of it stand for ``HOT_ROWS``."""
    n = docs.count()
    sample = min(n, max(sample, -(-20 * n // HOT_ROWS)))
    part = min(1.0, sample / max(1, n))
    some = docs if part == 1 else docs.filter(F.pmod(F.xxhash64("row", "doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for text in batch.column("text"):
                own = text.as_py().encode().split()
                if len(own) >= WINDOW:
                    h = np.fromiter(map(cache.__getitem__, own), np.uint64, len(own))
                    each = np.unique(_anchored(h, slice(None), np.zeros(0, np.uint64))[1])
                    yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64))], ["anchor"])

    least = max(20, int(min(share * sample, HOT_ROWS * sample / max(1, n))))
    often = some.select("text").mapInArrow(run, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    often = often.orderBy(F.desc("n"), "anchor").limit(MOST_HOT)
    return np.sort(np.array([r["anchor"] for r in often.select("anchor").collect()], np.int64).view(np.uint64))


def longest_matches(key: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window the length of the longest match that begins earlier, and where one begins.

    key: windows in order, equal keys for equal windows of one block; seg: the segment of each; matches end with their
    segments. Matches grow window by window: the class of a match of length k + 1 is that of length k and the next
    window. Only windows whose match goes on, and those they may match, stay in work. Longer matches than ``STEPS``
    come from repetitive texts, of which every window goes on; they are found by suffix ranks instead of one step a window.
    """
    n = len(key)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    first = np.unique(key, return_index=True, return_inverse=True)
    first = first[1][first[2]]  # the first equal window of each
    at, own, k = np.arange(n), first, 1
    while len(at):
        _, lead, group, size = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
        shared = size[group] > 1
        at, origin = at[shared], at[lead[group]][shared]
        if k == STEPS and len(at):
            whole = np.ones(len(at), bool)
            whole[1:] = (at[1:] != at[:-1] + 1) | (seg[at[1:]] != seg[at[:-1]])
            more, before = longest_previous(origin, np.cumsum(whole))
            found = more > 0
            length[at[found]], source[at[found]] = more[found] + k - 1, at[before[found]]
            break
        later = at > origin
        length[at[later]], source[at[later]] = k, origin[later]
        further = at + k < n
        further[further] = seg[at[further] + k] == seg[at[further]]
        at, origin = at[further], origin[further]
        own, k = origin * n + first[at + k], k + 1
    return length, source


def longest_previous(symbol: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every position the longest match that begins earlier and stays in its run, and where it begins.

    Positions are ranked by their first 1, 2, 4, 8... symbols, each rank from two of the one before, until runs end or all differ: a
    logarithmic number of sorts, however repetitive the symbols are. The longest earlier match is that with one of the two
    nearest earlier positions in the order of the last ranks.
    """
    n = len(symbol)
    edges = np.append(np.flatnonzero(np.diff(run, prepend=run[0] - 1)), n)
    end = np.repeat(edges[1:], np.diff(edges))
    place = np.arange(n)
    ranks = [np.unique(symbol, return_inverse=True)[1]]
    k, longest = 1, int(np.diff(edges).max())
    while k < longest and ranks[-1].max() + 1 < n:
        second = np.where(place + k < end, ranks[-1][np.minimum(place + k, n - 1)] + 1, 0)
        ranks.append(np.unique(ranks[-1] * (n + 1) + second, return_inverse=True)[1])
        k *= 2
    order = np.argsort(ranks[-1], kind="stable").tolist()
    above, below = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for near, way in ((above, order), (below, order[::-1])):
        stack: list[int] = []
        for i in way:
            while stack and stack[-1] > i:
                stack.pop()
            if stack:
                near[i] = stack[-1]
            stack.append(i)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for near in (above, below):
        i = np.flatnonzero(near >= 0)
        j, common = near[i], np.zeros(len(i), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            x, y = i + common, j + common
            open_ = (x < end[i]) & (y < end[j])
            same = open_ & (ranks[level][np.minimum(x, n - 1)] == ranks[level][np.minimum(y, n - 1)])
            common += np.where(same, np.minimum(1 << level, end[i] - x), 0)
        better = common > length[i]
        length[i[better]], source[i[better]] = common[better], j[better]
    return length, source


class _Block:
    """Segments of the block that goes on in the next batch, but for those that one factor covers."""

    def __init__(self):
        self.anchor, self.value, self.size = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.rows = np.zeros((0, 3), np.int64)  # doc_id, row, start of each segment


def factors(parts: DataFrame) -> DataFrame:
    """doc_id, row, start, n (windows), source: the blocks' factors, in order of (anchor, doc_id, row, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last = _Block(), None
        for batch in (b.slice(k, MOST_ROWS) for b in batches for k in range(0, b.num_rows, MOST_ROWS)):
            settled = batch.column("hashes").is_null().to_numpy(zero_copy_only=False)
            if settled.any():
                pass_on = batch.filter(pa.array(settled))
                yield pa.RecordBatch.from_arrays([pass_on.column("doc_id"), pass_on.column("row"), pass_on.column("start").cast(pa.int64()), pass_on.column("n").cast(pa.int64()), pass_on.column("source")], ["doc_id", "row", "start", "n", "source"])
            own = batch.filter(pa.array(~settled))
            if not own.num_rows:
                continue
            anchor = own.column("anchor").to_numpy()
            rows = np.stack([own.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "row", "start")], 1)
            size = own.column("n").to_numpy().astype(np.int64)
            wide = np.zeros((int(size.sum()), 8), np.uint8)
            wide[:, :6] = np.frombuffer(b"".join(own.column("hashes").to_pylist()), np.uint8).reshape(-1, 6)
            value = wide.view(np.uint64).ravel()
            # rows of one id, text and place are the same document
            again = np.zeros(len(rows), bool)
            again[1:] = (anchor[1:] == anchor[:-1]) & (rows[1:] == rows[:-1]).all(1)
            again[0] = last == (anchor[0], *rows[0])
            last = (anchor[-1], *rows[-1])
            if again.any():
                value, size, rows, anchor = value[np.repeat(~again, size)], size[~again], rows[~again], anchor[~again]
                if not len(rows):
                    continue
            old = 0
            if block.anchor == anchor[0]:
                old = len(block.rows)
                value, size = np.concatenate([block.value, value]), np.concatenate([block.size, size])
                rows, anchor = np.concatenate([block.rows, rows]), np.concatenate([np.full(old, anchor[0]), anchor])
            number = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
            begin = np.cumsum(size) - size
            seg = np.repeat(np.arange(len(rows)), size)
            key = (number[seg].astype(np.uint64) << np.uint64(48)) | value
            length, source = longest_matches(key, seg)
            out, k = [], int(begin[old])
            hits = np.flatnonzero(length > 0)
            for i in hits[np.searchsorted(hits, k) :].tolist():
                if i >= k:
                    out.append(i)
                    k = i + int(length[i])
            f = np.array(out, np.int64)
            if len(f):
                g, src = seg[f], source[f]
                from_ = rows[seg[src]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[g, 0]), pa.array(rows[g, 1]), pa.array(rows[g, 2] + f - begin[g]), pa.array(length[f]),
                     pa.StructArray.from_arrays([pa.array(from_[:, 0]), pa.array(from_[:, 1]), pa.array(from_[:, 2] + src - begin[seg[src]])], fields=list(_SOURCE))],
                    ["doc_id", "row", "start", "n", "source"],
                )
            stay = (number == number[-1]) & (length[begin] < size)
            block.anchor, block.rows, block.size, block.value = anchor[-1], rows[stay], size[stay], value[np.repeat(stay, size)]

    return parts.mapInArrow(run, f"doc_id long, row long, start long, n long, {SOURCE}")


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (LAST_ID if null), row, start, n, source: every factor of every document."""
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc_id"), row_key(id_col, text_col).alias("row"), text_of(text_col).alias("text"))
    return factors(segments(d, hot_anchors(d)).repartition("anchor").sortWithinPartitions("anchor", "doc_id", "row", "start"))


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, spans: array<struct<start, n>> of windows (start, number of windows) that occur earlier."""
    return parse(docs, id_col, text_col).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def covered(n_words: int, spans) -> np.ndarray:
    """True for words under a duplicate window."""
    edge = np.zeros(n_words + 1, np.int64)
    for s in spans or ():
        edge[s["start"]] += 1
        edge[min(n_words, s["start"] + s["n"] + WINDOW - 1)] -= 1
    return np.cumsum(edge[:-1]) > 0


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rest (a struct of all columns but the text), packed (the compressed text; it is moved once), spans."""

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=1)
        packed = [None if x is None else press.compress(x.encode()) for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("rest"), batch.column("id"), batch.column("row"), pa.array(packed, pa.binary())], ["rest", "id", "row", "packed"])

    rest = F.struct(*[c for c in docs.columns if c != text_col]) if len(docs.columns) > 1 else F.struct(F.lit(1).alias("none"))
    d = docs.select(rest.alias("rest"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), row_key(id_col, text_col).alias("row"))
    spans = duplicate_spans(docs, id_col, text_col).withColumnRenamed("doc_id", "id")
    packed = map_arrow(d, pack, f"rest {d.schema['rest'].dataType.simpleString()}, id long, row long, packed binary")
    return packed.join(spans, ["id", "row"], "left").select("rest", "packed", "spans")


def _unpack(packed: bytes | None) -> str | None:
    return None if packed is None else zstandard.ZstdDecompressor().decompress(packed).decode()


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for packed, spans in zip(batch.column("packed"), batch.column("spans")):
            words = (_unpack(packed.as_py()) or "").encode().split()
            gone = covered(len(words), spans.as_py())
            kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        a, b, c = zip(*out)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    d = with_spans(docs.select(F.col("doc_id").cast("long"), "text")).select("rest.doc_id", "packed", "spans")
    return map_arrow(d, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without(text: str, spans) -> str:
    """The text without duplicate words, each gone with the white space after it; unchanged if nothing goes."""
    marks = [m.span() for m in _WORD.finditer(text)]
    gone = covered(len(marks), spans).tolist()
    ends = [m[0] for m in marks[1:]] + [len(text)]
    return text[: marks[0][0] if marks else 0] + "".join(text[m[0] : e] for m, e, g in zip(marks, ends, gone) if not g)


def remove_duplicates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with duplicate spans taken out; a text of which no word is left becomes empty."""
    columns = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for packed, spans in zip(batch.column("packed"), batch.column("spans")):
            text = _unpack(packed.as_py())
            texts.append(without(text, spans.as_py()) if spans.is_valid else text)
        rest = batch.column("rest")
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else rest.field(c) for c in columns], columns)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(with_spans(docs, text_col=text_col), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM later)),
kept AS (
  SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.j) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM w) u ANTI JOIN gone ON u.doc_id = gone.doc_id AND u.j = gone.j
  GROUP BY u.doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
