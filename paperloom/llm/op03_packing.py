"""Packing tokenised documents into sequences by linear grouping and best fit.

Documents become pieces of at most ``capacity`` tokens. What the packing depends on is only how many pieces have
each length: at most ``capacity`` numbers, however large the corpus. From this histogram the plan is made:

1. lengths above an eighth of the capacity are sorted, cut into groups of equal cardinality, and rounded up to the
   largest of their group;
2. the few rounded sizes are packed by configurations (sets of up to four sizes) that are optimised one after the
   other and used as often as the sizes' demand allows;
3. actual lengths take the rounded places, so places become tighter;
4. what is left, and all small pieces, go by best fit, longest first, into the tightest room.

The plan is a list of (how many sequences, their lengths). Spark then ranks the pieces within each length (salted,
so that a length that a third of all pieces share spreads) and looks every piece's place up in the plan.

Rounding costs at most one group's range of lengths a piece, before actual lengths take their places: 256 groups
round 0.3 % of the tokens of the sample tables up, and leave 0.2 % more sequences than full ones would be. The plan's
size is bounded by the capacity, not by the corpus: every step uses up a length, a group or a class, so it has a few
thousand rows, and ``MOST_PLAN`` is checked before it is broadcast.

Defined results: a null text is an empty one, a piece of one token; a null id is passed through; repeated rows are
packed each; an empty table gives no rows; a very long text is encoded whole; only id and text are read, so further
columns can't clash. Ids are those of the tokenizers library by its defaults (the vocabulary's special token in a text
is one id): texts of Latin characters are encoded by tiktoken with the same vocabulary, which gives the same ids faster;
texts with other characters or the special token by tokenizers.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import cut_lineage, map_arrow, table, text_of

CAPACITY = 1024
END_ID = 2
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
GROUPS = 256
#: Rows of a plan at most.
MOST_PLAN = 200_000
SPECIAL = "<|endoftext|>"
#: Configurations with more room than this share of the capacity are left to best fit.
MOST_SLACK = 0.05
Class = tuple[int, list[int]]
_NOT_LATIN = re.compile("[^\\x00-ɏ]")


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: str, ranks: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("latin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    exact = Tokenizer.from_file(vocabulary)

    def encode(text: str) -> list[int]:
        if _NOT_LATIN.search(text) or SPECIAL in text:
            return exact.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return fast.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. Of a longer document only the first piece may be shorter."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = _encoder(vocabulary, ranks)
        rows, out = [], []
        for row, text in enumerate(batch.column("text")):
            ids = np.array([*encode(text.as_py()), END_ID], "<u4")
            first = len(ids) % capacity or capacity
            for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                start = max(0, stop - capacity) if k else 0
                rows.append(row)
                out.append((k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
        piece, start, length, crc = zip(*out)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the plan, from the histogram of lengths ----------------------------------------------------------------------


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded size, [[length, count], ...] from long to short) of groups of equal cardinality."""
    each = -(-sum(counts.values()) // groups) if counts else 1
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if room == 0:
                if not out or out[-1][0] != length:
                    out.append((length, []))
                room = each
            k = min(n, room)
            if out[-1][1] and out[-1][1][-1][0] == length:
                out[-1][1][-1][1] += k
            else:
                out[-1][1].append([length, k])
            n, room = n - k, room - k
    return out


def _fullest(sizes: np.ndarray, room: int) -> tuple[int, ...]:
    """Up to three of the ascending sizes that fill the room best; fewer, larger ones where that is as good."""
    s = sizes[: np.searchsorted(sizes, room, "right")]
    if not len(s):
        return ()
    best: tuple[int, ...] = (int(s[-1]),)
    if best[0] == room:
        return best

    def partner(left: np.ndarray) -> np.ndarray:
        at = np.searchsorted(s, left, "right") - 1
        return np.where(at >= 0, s[at], -(1 << 30))

    pair = s + partner(room - s)
    k = len(s) - 1 - int(pair[::-1].argmax())
    if pair[k] > sum(best):
        best = (int(s[k]), int(pair[k] - s[k]))
    if sum(best) == room:
        return best
    two = s[:, None] + s[None, :]
    three = two + partner(room - two)
    i, j = np.unravel_index(int(three.argmax()), three.shape)
    if three[i, j] > sum(best):
        best = (int(s[i]), int(s[j]), int(three[i, j] - two[i, j]))
    return best


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, np.ndarray]]:
    """Sequential optimisation of configurations: (how many, pieces of each size).

    The longest size still wanted gets the companions that fill its sequence best, as often as the demand allows;
    every step uses up a size. A size that no configuration fills well is left to best fit.
    """
    place = {s: k for k, s in enumerate(sizes)}
    left = dict(zip(sizes, demand))
    out: list[tuple[int, np.ndarray]] = []
    for longest in sorted(sizes, reverse=True):
        while left[longest] > 0:
            open_ = np.array(sorted(s for s in left if 0 < left[s] and s <= longest))
            chosen = _fullest(open_, capacity - longest)
            if capacity - longest - sum(chosen) > capacity * MOST_SLACK:
                break
            config = np.zeros(len(sizes), int)
            for s in (longest, *chosen):
                config[place[s]] += 1
            many = min(left[s] // int(config[place[s]]) for s in {longest, *chosen})
            if not many:  # one piece short of its copies
                break
            for s in {longest, *chosen}:
                left[s] -= many * int(config[place[s]])
            out.append((many, config))
    return out


def substitute(patterns: list[tuple[int, np.ndarray]], groups: list[tuple[int, list[list[int]]]]) -> tuple[list[Class], dict[int, int]]:
    """Actual lengths take the rounded places, long ones first; returns sequences and the lengths left over."""
    queues = [[list(x) for x in runs[::-1]] for _, runs in groups]
    out: list[Class] = []
    for many, pattern in patterns:
        used = [(g, int(c)) for g, c in enumerate(pattern) if c]
        while many > 0 and all(sum(x[1] for x in queues[g]) >= c for g, c in used):
            step = min(many, *(queues[g][-1][1] // c for g, c in used))
            contents: list[int] = []
            for g, c in used:
                if step:
                    contents += [queues[g][-1][0]] * c
                    queues[g][-1][1] -= step * c
                else:
                    for _ in range(c):
                        contents.append(queues[g][-1][0])
                        queues[g][-1][1] -= 1
                        if not queues[g][-1][1]:
                            queues[g].pop()
                if queues[g] and not queues[g][-1][1]:
                    queues[g].pop()
            out.append((max(1, step), contents))
            many -= max(1, step)
    left: dict[int, int] = {}
    for queue in queues:
        for length, n in queue:
            left[length] = left.get(length, 0) + n
    return out, left


def best_fit(classes: list[Class], counts: dict[int, int], capacity: int) -> list[Class]:
    """Longest first, each into the tightest sequence with room; sequences alike are handled together."""
    rooms: dict[int, list[Class]] = {}
    sizes: list[int] = []

    def put(many: int, contents: list[int]) -> None:
        room = capacity - sum(contents)
        if room not in rooms:
            insort(sizes, room)
        rooms.setdefault(room, []).append((many, contents))

    for many, contents in classes:
        put(many, contents)
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            k = bisect_left(sizes, length)
            if k == len(sizes):
                put(n if length > capacity // 2 else -(-n // (capacity // length)), [])
                continue
            room = sizes[k]
            many, contents = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                sizes.pop(k)
            copies = room // length
            full = min(many, n // copies)
            if full:
                put(full, contents + [length] * copies)
                n -= full * copies
            if many > full and n and n < copies:
                put(1, contents + [length] * n)
                n, full = 0, full + 1
            if many > full:
                put(many - full, contents)
    return [x for room in sorted(rooms) for x in rooms[room] if x[1]]


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Class]:
    """Sequences alike by number, from how many pieces have each length."""
    whole = counts.get(capacity, 0)
    rest = {k: n for k, n in counts.items() if n and k < capacity}
    large = {k: n for k, n in rest.items() if k > capacity // 8}
    grouped = linear_groups(large, groups)
    patterns = configurations([g[0] for g in grouped], [sum(n for _, n in g[1]) for g in grouped], capacity) if grouped else []
    classes, left = substitute(patterns, grouped)
    for length, n in rest.items():
        if length <= capacity // 8:
            left[length] = left.get(length, 0) + n
    return ([(whole, [capacity])] if whole else []) + best_fit(classes, left, capacity)


def places(plan: list[Class]) -> np.ndarray:
    """Rows (length << 40 | first rank, first sequence, offset, ranks), sorted: where each rank of a length goes."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for many, contents in plan:
        offset = 0
        for length in contents:
            first = ranks.get(length, 0)
            rows.append((length << 40 | first, sequence, offset, many))
            ranks[length] = first + many
            offset += length
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


# --- Spark --------------------------------------------------------------------------------------------------------


def ranked(rows: DataFrame, counts: DataFrame, salts: int) -> DataFrame:
    """Adds ``rank``: gapless from 0 within each length. counts: length, salt, n."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("length", "salt", before.alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return rows.withColumn("local", local).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local"))


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = cut_lineage(pieces(docs, capacity))
    salts = max(256, cut.count() // 200_000)
    # salted by place: ids may be missing and texts repeated, so that hashes of them would not spread a hot length
    rows = cut.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    counts = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows_of_plan = places(make_plan(histogram, capacity))
    if len(rows_of_plan) > MOST_PLAN:
        raise ValueError(f"the plan has {len(rows_of_plan)} rows")
    plan = cut.sparkSession.sparkContext.broadcast(rows_of_plan)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        rank, length = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
        at = plan.value
        k = np.searchsorted(at[:, 0], length << 40 | rank, "right") - 1
        rest = rank - (at[k, 0] & ((1 << 40) - 1))
        own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.RecordBatch.from_arrays([*own, pa.array(at[k, 1] + rest), pa.array(at[k, 2])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_arrow(ranked(rows, counts, salts), place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
