"""Order in documents: aligned blocks of two versions, and chunks that break where sections, tables and sizes say."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
TARGET, MOST, OVERLAP, PER_TOKEN = 800, 1200, 100, 4
DIGEST = r"\s+"


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by piles."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        tops[pile : pile + 1] = [v]
        at[pile : pile + 1] = [i]
        before.append(at[pile - 1] if pile else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pair_id, a, b): places of equal blocks that keep their order, as many as possible.

    Blocks (pair_id, pos, digest) are equal by digest and occurrence; of these, the longest sequence that ascends in both
    versions is kept, so a block that moved is not the same. A pair's matches are one document's blocks.
    """

    def nth(side: DataFrame, place: str) -> DataFrame:
        return side.select("pair_id", "digest", F.col("pos").alias(place), F.row_number().over(Window.partitionBy("pair_id", "digest").orderBy("pos")).alias("nth"))

    m = nth(old, "a").join(nth(new, "b"), ["pair_id", "digest", "nth"])
    m = m.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("m"))
    m = m.select("pair_id", F.transform("m", lambda x: x["a"].cast("long")).alias("a"), F.transform("m", lambda x: x["b"].cast("long")).alias("b"))
    kind = m.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, rows = [], [], []
            for i, (x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                kept = increasing(y)
                a += [x[k] for k in kept]
                b += [y[k] for k in kept]
                rows += [i] * len(kept)
            yield pa.RecordBatch.from_arrays([batch.column("pair_id").take(pa.array(rows, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["pair_id", "a", "b"])

    return m.mapInArrow(run, f"pair_id {kind}, a long, b long")


def _unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What isn't aligned, of blocks (pair_id, pos, text, digest, old) whose pairs lie together: see ``diff``."""

    def settle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        ids, old = t["pair_id"].to_pylist(), t["old"].to_pylist()
        pos, digest = t["pos"].fill_null(-(1 << 63)).to_pylist(), t["digest"].to_pylist()
        gaps, ks, froms, tos, moved = [], [], [], [], []
        end = 0
        while end < len(ids):
            start = end
            while end < len(ids) and ids[end] == ids[start]:
                end += 1
            sides = [sorted((i for i in range(start, end) if old[i] == side), key=pos.__getitem__) for side in (True, False)]
            same: set[int] = set()
            if ids[start] is not None:  # a missing pair has nothing in common
                waiting: dict[int, list[int]] = {}
                for j in reversed(sides[1]):
                    waiting.setdefault(digest[j], []).append(j)
                m = [(i, waiting[digest[i]].pop()) for i in sides[0] if waiting.get(digest[i])]
                for x in increasing([pos[j] for _, j in m]):
                    same.update(m[x])
            left: list[dict[tuple[int, int], int]] = []
            for rows in sides:
                gap, k, own = 0, 0, {}
                for i in rows:
                    if i in same:
                        gap, k = gap + 1, 0
                    else:
                        k += 1
                        own[gap, k] = i
                left.append(own)
            gone, come = ({digest[i] for i in own.values()} for own in left)
            places = list(left[0]) + [x for x in left[1] if x not in left[0]]
            pairs = [(x, left[0].get(x), left[1].get(x)) for x in places]
            if ids[start] is None:
                pairs, gone, come = [(x, i, None) for x, i in left[0].items()] + [(x, None, j) for x, j in left[1].items()], set(), set()
            for (gap, k), i, j in pairs:
                if i is not None and j is not None and digest[i] == digest[j]:
                    continue  # the same after all, told by another occurrence
                gaps.append(gap)
                ks.append(k)
                froms.append(i)
                tos.append(j)
                moved.append((i is not None and digest[i] in come, j is not None and digest[j] in gone))
        f, to = pa.array(froms, pa.int64()), pa.array(tos, pa.int64())
        own = [t["pair_id"].take(pc.coalesce(f, to)), pa.array(gaps, pa.int64()), pa.array(ks, pa.int64()), t["pos"].take(f), t["pos"].take(to), t["text"].take(f), t["text"].take(to)]
        own += [pa.array([m[n] for m in moved], pa.bool_()) for n in (0, 1)]
        names = ["pair_id", "gap", "k", "from_pos", "to_pos", "from_text", "to_text", "from_moved", "to_moved"]
        return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in own], names)

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("pair_id").to_pylist()
        if held and last != ids[0]:
            yield settle(held)
            held = []
        cut, last = len(ids) - 1, ids[-1]
        while cut and ids[cut - 1] == last:
            cut -= 1
        if cut:
            yield settle([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield settle(held)


def diff(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """(pair_id, gap, k, change, from_pos, to_pos, from_text, to_text) of two versions' blocks (pair_id, pos, text).

    Between the same aligned blocks, what is left on both sides is paired in order: ``changed`` where at least ``least`` of
    the distinct words are shared, else one ``removed`` and one ``added``. Order counts: a block that moved is removed at its
    old place and added at its new one, marked ``moved`` on both if the same text stands on the other side of the pair.
    """

    def numbered(side: DataFrame) -> DataFrame:
        return side.select("pair_id", F.col("pos").cast("long").alias("pos"), "text", F.xxhash64(F.trim(F.regexp_replace("text", DIGEST, " "))).alias("digest"))

    # both sides move once, together; all else stays within a pair's rows
    both = numbered(old).withColumn("old", F.lit(True)).unionByName(numbered(new).withColumn("old", F.lit(False))).repartition("pair_id").sortWithinPartitions("pair_id")
    kind = both.schema["pair_id"].dataType.simpleString()
    d = both.mapInArrow(_unlike, f"pair_id {kind}, gap long, k long, from_pos long, to_pos long, from_text string, to_text string, from_moved boolean, to_moved boolean")
    words = lambda c: F.array_distinct(F.split(F.trim(F.regexp_replace(c, DIGEST, " ")), " "))
    alike = F.coalesce(F.size(F.array_intersect(words("from_text"), words("to_text"))) >= least * F.size(F.array_union(words("from_text"), words("to_text"))), F.lit(False))
    none, no_place = F.lit(None).cast("string"), F.lit(None).cast("long")
    row = lambda change, fp, tp, f, t: F.struct(change.alias("change"), fp.alias("from_pos"), tp.alias("to_pos"), f.alias("from_text"), t.alias("to_text"))
    name = lambda moved, change: F.when(F.col(moved), "moved").otherwise(change)
    removed = F.when(F.col("from_text").isNotNull(), row(name("from_moved", "removed"), F.col("from_pos"), no_place, F.col("from_text"), none))
    added = F.when(F.col("to_text").isNotNull(), row(name("to_moved", "added"), no_place, F.col("to_pos"), none, F.col("to_text")))
    changed = row(F.lit("changed"), F.col("from_pos"), F.col("to_pos"), F.col("from_text"), F.col("to_text"))
    return d.select("pair_id", "gap", "k", F.inline(F.when(alike, F.array(changed)).otherwise(F.array_compact(F.array(removed, added)))))


# --- chunks ----------------------------------------------------------------------------------------------------------


def tokens(size: Column) -> Column:
    """Estimated tokens of so many characters."""
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(size / PER_TOKEN)).cast("int"))


def break_places(size: np.ndarray, section: np.ndarray, first: int, further: int) -> np.ndarray:
    """True where a chunk starts, for units of so many characters (each with a line break) in sections that stand together.

    From every unit a pointer tells where a chunk that begins there would end: before the first unit that exceeds the room,
    at the section's end at the latest, and never without a unit. A section's first chunk has room for ``first``
    characters, those after it, which begin with an overlap, for ``further``. The chunks' starts are what the pointers reach
    from a section's first break, found by doubling them.
    """
    n = len(size)
    if not n:
        return np.zeros(0, bool)
    at = np.arange(n)
    opens = np.diff(section, prepend=section[0] - 1) != 0
    edges = np.append(np.flatnonzero(opens), n)
    end = np.repeat(edges[1:], np.diff(edges))
    total = np.concatenate([[0], np.cumsum(size + 1)])

    def after(room: int) -> np.ndarray:
        return np.minimum(np.maximum(np.searchsorted(total, total[at] + room + 1, "right") - 1, at + 1), end)

    jump = np.append(np.where(after(further) < end, after(further), n), n)
    start = after(first)[opens]
    reached = np.zeros(n + 1, bool)
    reached[start[start < end[opens]]] = True
    while True:
        new = reached.copy()
        new[jump[reached]] = True
        new[n] = False
        jump = jump[jump]
        if (new == reached).all() and (jump == n).all():
            break
        reached = new
    return reached[:n] | opens


def _pieces(blocks: DataFrame) -> DataFrame:
    """Units of blocks: whole ones, or of oversized prose the windows of about the target, cut at blanks, with an overlap."""
    width, step = TARGET * PER_TOKEN, (TARGET - OVERLAP) * PER_TOKEN
    size = F.char_length("text")
    big = (tokens(size) > MOST - OVERLAP) & (F.col("kind") != "table")  # so that it fits with an overlap before it
    last = F.greatest(F.lit(0), F.ceil((size - width) / step).cast("int"))
    d = blocks.withColumn("piece", F.explode(F.sequence(F.lit(0), F.when(big, last).otherwise(0))))

    def cut(at: Column) -> Column:
        """The place after the next blank from there; the text's ends stay."""
        blank = F.call_function("instr", F.call_function("substring", F.col("text"), at + 1), F.lit(" "))
        return F.when(at <= 0, 0).when((at >= size) | (blank == 0), size).otherwise(at + blank)

    lo, hi = cut((F.col("piece") * step).cast("int")), F.when(F.col("piece") == last, size).otherwise(cut((F.col("piece") * step + width).cast("int")))
    own = F.trim(F.call_function("substring", F.col("text"), lo + 1, hi - lo))
    return d.withColumn("text", F.when(big, own).otherwise(F.col("text"))).filter(F.col("text") != "")


def _table_parts(tables: DataFrame) -> DataFrame:
    """Groups of rows that fit the target, each under the header line."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    d = tables.withColumn("lines", lines).filter(F.size("lines") > 0)
    d = d.withColumns({"head": F.col("lines")[0], "body": F.when(F.size("lines") > 1, F.slice("lines", F.lit(2), F.size("lines"))).otherwise(F.col("lines"))})
    room = F.floor((TARGET - tokens(F.char_length("head")) - 1) / F.array_max(F.transform("body", lambda x: tokens(F.char_length(x)))))
    d = d.withColumn("rows", F.greatest(F.lit(1), room).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.size("body") - 1) / F.col("rows")).cast("int"))))
    return d.withColumn("text", F.concat_ws("\n", F.col("head"), F.array_join(F.slice("body", F.col("piece") * F.col("rows") + 1, F.col("rows")), "\n")))


def assemble(blocks: DataFrame) -> DataFrame:
    """(doc_id, ordinal, block_ids, text) chunks of blocks (doc_id, pos, block_id, kind, text), in order from 0.

    A heading starts a chunk and stays with what follows; tables never join prose and repeat their header; a chunk ends before the
    unit that would exceed the target, and none exceeds the maximum but by a single word or table row. The next chunk of the same section begins with
    the last words, about ``OVERLAP`` tokens, of the one before, and names their blocks.
    """
    d = blocks.withColumn("text", F.trim("text")).filter(F.col("text") != "")
    cols = ["doc_id", "pos", "piece", "block_id", "kind", "text"]
    units = _pieces(d.filter(F.col("kind") != "table")).select(*cols).unionByName(_table_parts(d.filter(F.col("kind") == "table")).select(*cols))
    entry = F.struct("pos", "piece", "block_id", F.col("kind").alias("kind"), F.char_length("text").alias("size"), "text")
    docs = units.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("u"))  # one document's units
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", *[F.col(f"u.{c}").alias(c) for c in ("block_id", "kind", "size", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = {c: batch.column(c).flatten() for c in ("block_id", "kind", "size", "text")}
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("size").offsets.to_numpy()))
            if not len(row):
                continue
            name = flat["kind"].to_numpy(zero_copy_only=False)
            table, heading = name == "table", name == "heading"
            new_doc = np.diff(row, prepend=-1) != 0
            # sections: documents, headings, tables and what follows them
            opens = new_doc | table | np.append(False, table[:-1]) | heading
            section = np.cumsum(opens)
            size = flat["size"].to_numpy().astype(np.int64)
            starts = break_places(size, section, TARGET * PER_TOKEN, (TARGET - OVERLAP) * PER_TOKEN)
            # a section's heading doesn't stand alone: what follows comes in, though it exceeds the target
            alone = starts & np.append(False, heading[:-1]) & ~opens
            starts &= ~alone
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(np.cumsum(starts), pa.int64()), pa.array(section, pa.int64()), pa.array(np.arange(len(row)), pa.int64()), flat["block_id"], flat["text"]],
                ["doc_id", "chunk", "section", "unit", "block_id", "text"],
            )

    placed = docs.mapInArrow(run, f"doc_id {kind}, chunk long, section long, unit long, block_id string, text string")
    parts = F.sort_array(F.collect_list(F.struct("unit", "block_id", "text")))
    c = placed.groupBy("doc_id", "chunk", "section").agg(parts.alias("p"))
    c = c.select("doc_id", "chunk", "section", F.array_distinct(F.transform("p", lambda x: x["block_id"])).alias("own_ids"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("own"), "p")
    order = Window.partitionBy("doc_id").orderBy("chunk")
    follows = F.lag("section").over(order) == F.col("section")
    c = c.withColumns({"prev": F.when(follows, F.lag("own").over(order)), "prev_parts": F.when(follows, F.lag("p").over(order))})
    tail = F.regexp_replace(F.right("prev", F.lit(OVERLAP * PER_TOKEN + 1)), r"^\S*\s+", "")
    tail = F.when(F.char_length("prev") <= OVERLAP * PER_TOKEN, F.col("prev")).otherwise(tail)
    tail = F.when(F.col("prev").isNotNull(), F.regexp_replace(F.trim(tail), r"\s+", " "))
    # blocks of the overlap: those after whose start no more than its length follows
    reach = F.transform("prev_parts", lambda x, i: F.struct(x["block_id"].alias("id"), F.aggregate(F.slice("prev_parts", i + 2, F.size("prev_parts")), F.lit(0), lambda s, y: s + F.char_length(y["text"]) + 1).alias("after")))
    tail_ids = F.transform(F.filter(reach, lambda x: x["after"] < F.char_length("tail")), lambda x: x["id"])
    c = c.withColumn("tail", tail)
    ids = F.array_distinct(F.concat(F.coalesce(tail_ids, F.array().cast("array<string>")), F.col("own_ids")))
    number = F.row_number().over(order) - 1
    return c.select("doc_id", number.alias("ordinal"), ids.alias("block_ids"), F.concat_ws("\n", F.when(F.col("tail") != "", F.col("tail")), "own").alias("text"))
