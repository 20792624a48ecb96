"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

``TABLES`` groups of ``DEPTH`` minhashes are computed per distinct shingle set. A band key combines a pair of
groups, so 16 groups of 2 (32 minhashes) stand for 120 tables of 4 (480 minhashes): a pair of sets of similarity
0.75 misses all tables with probability 4e-5. Groups that no other set shares can't make a common band and are dropped
before pairs are formed.

1. Documents of equal shingle sets are one class. Classes are numbered, since ids may be missing or repeated with other
   texts; ids only order documents and name components.
2. Round one compares every member of a band with the band's first; round two with the band's hub, the member
   that shares the most bands with others; only members of different components are compared again. Components are
   found after each round.
3. What is left, members of one band in different components, is compared exhaustively, so no link is lost to the
   choice of partners: members of a band's first group (of the band itself where that group is large) meet in pairs of
   blocks of bounded size, where each pair is checked in the lowest groups it shares. First only 256-bit sketches of 64
   minhashes meet, which tell the members that may be near another one (a pair at 0.75 fails them with probability about
   1e-8); only these get their sets, and only links leave the tasks.
4. Every link is confirmed on both full sets, as 48-bit cuts of the 64-bit hashes that ``n_shingles`` counts, which keeps the sets a
   quarter smaller in memory: two sets of n shingles share a false one with probability n * n / 2**48, 4e-7 for 10,000, and a
   single one moves a decision only at the threshold itself.

Components are found within a task's edges first; what tasks have in common takes rounds, which replace labels by their labels'
labels, so paths halve in every round. Shuffle files of finished rounds are released between the phases, since many small ones
would otherwise wait for the driver's JVM to collect garbage.

Both sides of every join grow with the input, so all are merge joins: else a side below the broadcast threshold, which Spark
measures before an explode makes it many times larger, is collected by the driver.

Rows out: one per document with its component. Copies and bands are never expanded into all their pairs unless they
stay unconnected.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; a null id counts as
the largest; rows that repeat an id (or have none) and differ in their sets are documents of their own; of a component
with several sets under its smallest id one set is kept; rows equal in id and set are kept or dropped alike; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import LAST_ID, cut_lineage, map_arrow, release, row_key, table, text_of
from paperloom.llm.op06_substring import WordHashes, mix, rolling

WORDS = 5
TABLES, DEPTH = 16, 2
SKETCHED = 64
#: Of 64 sketched minhashes, two sets of similarity 0.75 agree in 49 on average, with a deviation of 3.4.
LEAST_AGREEMENT = 29
#: Members of a block in the exhaustive comparison.
BLOCK = 512
#: Edges that one task of a components round takes.
EDGES_A_TASK = 50_000
_RNG = np.random.default_rng(4)
_KEYS = _RNG.integers(0, 1 << 63, SKETCHED, np.uint64)
_OF_SHINGLE = _RNG.integers(1, 1 << 62, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0x9FB21C651E98DF25)


def shingle_set(text: str | None, cache: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles of the text with A-Z in lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        return mix(np.array([reduce(lambda a, b: (a * 0x9E3779B97F4A7C15 + int(b) + 1) % (1 << 64), h.tolist(), len(h))], np.uint64))
    return np.unique(rolling(h, _OF_SHINGLE))


def minhashes(s: np.ndarray) -> np.ndarray:
    out = np.full(SKETCHED, np.iinfo(np.uint64).max)
    for k in range(0, len(s), 4096):
        x = (s[k : k + 4096, None] ^ _KEYS) * _M
        x = (x ^ (x >> np.uint64(28))) * _M
        out = np.minimum(out, x.min(0))
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """id, row, n_shingles, digest (of the set; null if empty), groups (long each), k0..k3 (the sketch)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache, sizes, digests, groups, sketches = WordHashes(), [], [], [], []
        tag = np.arange(TABLES, dtype=np.uint64)
        shift = np.arange(16, dtype=np.uint64) * np.uint64(4)
        for text in batch.column("text"):
            s = shingle_set(text.as_py(), cache)
            sizes.append(len(s))
            if not len(s):
                digests.append(None)
                groups.append(None)
                sketches.append([0] * 4)
                continue
            m = minhashes(s)
            own = m[: TABLES * DEPTH].reshape(TABLES, DEPTH)
            value = mix(own[:, 0] * np.uint64(0x9E3779B97F4A7C15) + own[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) + tag)
            groups.append(value.view(np.int64).tolist())
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sketches.append((((m & np.uint64(15)).reshape(4, 16)) << shift).sum(1, dtype=np.uint64).view(np.int64).tolist())
        k = np.array(sketches, np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(groups, pa.list_(pa.int64())), *[pa.array(k[:, i]) for i in range(4)]],
            ["id", "row", "n_shingles", "digest", "groups", "k0", "k1", "k2", "k3"],
        )

    return map_arrow(docs, run, "id long, row long, n_shingles long, digest binary, groups array<long>, k0 long, k1 long, k2 long, k3 long")


def agreement(a: str, b: str) -> Column:
    """How many of the 64 sketched minhashes two rows share."""
    terms = []
    for i in range(4):
        x = f"({a}.k{i} ^ {b}.k{i})"
        terms.append(f"bit_count(~({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & 1229782938247303441L)")
    return F.expr(" + ".join(terms))


def _joined(x: DataFrame, y: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join of which no side is broadcast, however small Spark takes it to be."""
    return x.join(y.hint("merge"), on, how)


def bands(classes: DataFrame) -> DataFrame:
    """(rep, unit, second, band) of the pairs of groups that other classes share too; unit is the pair's first group."""
    postings = classes.select("rep", F.posexplode("groups").alias("g", "key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    own = _joined(postings, shared, "key", "left_semi").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("g", "key"))).alias("own")).filter(F.size("own") > 1)
    pairs = F.flatten(F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, TABLES), lambda y: F.struct(x["key"].alias("unit"), y["key"].alias("second"), F.xxhash64(x["key"], y["key"]).alias("band")))))
    return own.select("rep", F.inline(pairs))


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, comp) over all edges (a, b) of a task: roots with a smaller neighbour are hung below it until none has one."""
    both = [np.concatenate([b.column(c).to_numpy() for c in ("a", "b")]).reshape(2, -1) for b in batches]
    if not both:
        return
    edges = np.concatenate(both, 1)
    ids, at = np.unique(edges, return_inverse=True)
    x, y = at.reshape(edges.shape)
    root = np.arange(len(ids))
    while (root[x] != root[y]).any():
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["id", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over edges (a, b), for every id that has an edge.

    As many tasks as the edges need make stars of their own edges. One task's stars are the components; of several, labels
    spread to neighbours, and every label is replaced by its own label, until none changes. The rounds run in as many tasks,
    so that few edges don't leave many small files.
    """
    parts = edges.count() // EDGES_A_TASK + 1
    own = cut_lineage(edges.select("a", "b").coalesce(parts).mapInArrow(stars, "id long, comp long"))
    if parts == 1:
        release(edges.sparkSession)
        return own
    both = cut_lineage(own.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionAll(own.select(F.col("comp").alias("a"), F.col("id").alias("b"))).distinct()).coalesce(parts)
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "id").coalesce(parts))
    while True:
        near = _joined(both, labels.select(F.col("id").alias("b"), F.col("comp").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        spread = _joined(labels, near.withColumnRenamed("a", "id"), "id").select("id", F.col("comp").alias("before"), F.least("comp", "other").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        after = cut_lineage(_joined(spread, jump, "comp", "left").select("id", "before", F.least("comp", F.coalesce("further", "comp")).alias("comp")).coalesce(parts))
        labels = after.select("id", "comp")
        if after.filter("before <> comp").isEmpty():
            release(edges.sparkSession)
            return labels


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, set): 48-bit shingle hashes, sorted, of the classes wanted (rep, id, row), laid out by their number."""

    def press(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=1)
        packed = pa.array([z.compress((x or "").encode()) for x in batch.column("text").to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), packed], ["id", "row", "packed"])

    def shingle(batch: pa.RecordBatch) -> pa.RecordBatch:
        z, cache, out = zstandard.ZstdDecompressor(), WordHashes(), []
        for packed in batch.column("packed"):
            s = np.unique(shingle_set(z.decompress(packed.as_py()).decode(), cache) >> np.uint64(16))
            out.append(s.view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "set"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = _joined(map_arrow(docs, press, "id long, row long, packed binary"), wanted, ["id", "row"]).select(F.col("rep").alias("id"), "packed")
    return map_arrow(packed.repartition(parts, "id").dropDuplicates(["id"]), shingle, "id long, set binary")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have a similarity of 0.75 or more."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            a, b = (_wide(v.as_py()) for v in (x, y))
            ok.append(_linked(a, b))
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    d = _joined(pairs, sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    d = _joined(d, sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return map_arrow(d.select("a", "b", "x", "y"), run, "a long, b long")


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 4 * len(small) < 3 * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _sketch_filter(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    side = lambda c: classes.select(F.col("rep").alias(c), *[F.col(f"k{i}") for i in range(4)]).alias(f"s{c}")
    d = _joined(_joined(pairs.alias("p"), side("a"), "a"), side("b"), "b")
    return d.filter(agreement("sa", "sb") >= LEAST_AGREEMENT).select("a", "b")


def _meet(rest: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """run for every pair of blocks of about BLOCK members of a group: columns of rows, own (block), x and y.

    rows are the members of rest with what run needs of them; groups are counted in rest alone."""
    sizes = rest.groupBy("unit", "second").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    d = _joined(rows, sizes.withColumnsRenamed({"unit": "u", "second": "v"}), (F.col("unit") == F.col("u")) & F.col("second").eqNullSafe(F.col("v"))).drop("u", "v")
    d = d.withColumn("own", F.pmod(F.xxhash64("rep", "unit"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return d.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).groupBy("unit", "second", "x", "y").applyInArrow(run, schema)


def _alike(t: pa.RecordBatch):
    """Yields (i, js): members of different components that agree in enough minhashes, each pair in one place."""
    rep, comp, own = (t.column(c).to_numpy() for c in ("rep", "comp", "own"))
    x, y, unit, second = (t.column(c)[0].as_py() for c in ("x", "y", "unit", "second"))
    group = np.array(t.column("groups").to_pylist(), np.int64).reshape(len(rep), -1)
    sketch = np.stack([t.column(f"k{i}").to_numpy() for i in range(4)], 1).view(np.uint64)
    ones = np.uint64(0x1111111111111111)
    for i in np.flatnonzero(own == x).tolist():
        j = np.flatnonzero((own == y) & (comp != comp[i]) & ((rep > rep[i]) if x == y else True))
        if not len(j):
            continue
        z = sketch[j] ^ sketch[i]
        z = ~(z | z >> np.uint64(1) | z >> np.uint64(2) | z >> np.uint64(3)) & ones
        j = j[np.bitwise_count(z).sum(1) >= LEAST_AGREEMENT]
        same = group[j] == group[i]
        # each pair once: in the lowest group that both share, and in the next one where that group is split
        here = (same.sum(1) > 1) & (group[i][same.argmax(1)] == unit)
        if second is not None:
            same[np.arange(len(j)), same.argmax(1)] = False
            here &= group[i][same.argmax(1)] == second
        if here.any():
            yield i, j[here]


def exhaust(rest: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different components among the members (rep, comp) of one group (unit, second) of rest."""

    def near(table_: pa.Table) -> pa.Table:
        t = table_.combine_chunks().to_batches()[0]
        hit = np.zeros(t.num_rows, bool)
        for i, j in _alike(t):
            hit[i] = hit[j] = True
        return pa.Table.from_batches([t.select(["unit", "second", "rep", "comp"]).filter(pa.array(hit))])

    def link(table_: pa.Table) -> pa.Table:
        t = table_.combine_chunks().to_batches()[0]
        rep, comp = t.column("rep").to_numpy(), t.column("comp").to_numpy()
        wide, parent = [None] * len(rep), {c: c for c in comp.tolist()}

        def top(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        links: list[tuple[int, int]] = []
        for i, js in _alike(t):
            for k in js.tolist():
                if top(comp[i]) == top(comp[k]):
                    continue
                for q in (i, k):
                    if wide[q] is None:
                        wide[q] = _wide(t.column("set")[q].as_py())
                if _linked(wide[i], wide[k]):
                    links.append((min(rep[i], rep[k]), max(rep[i], rep[k])))
                    parent[top(comp[i])] = top(comp[k])
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    signed = lambda members: _joined(members, classes.select("rep", "groups", "k0", "k1", "k2", "k3"), "rep")
    close = cut_lineage(_meet(rest, signed(rest), near, "unit long, second long, rep long, comp long").distinct())
    return _meet(close, _joined(signed(close), sets.withColumnRenamed("id", "rep"), "rep"), link, "a long, b long")


def resolve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (LAST_ID if null), row (``row_key``), n_shingles, digest, component_id, kept; one row per document."""
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), row_key(id_col, text_col).alias("row"), text_of(text_col).alias("text"))
    signed = cut_lineage(signatures(d))
    some = signed.filter("digest is not null")
    classes = some.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("lead"), *[F.first(c).alias(c) for c in ("groups", "k0", "k1", "k2", "k3")])
    classes = cut_lineage(classes.select("digest", "lead.id", "lead.row", "groups", "k0", "k1", "k2", "k3", F.monotonically_increasing_id().alias("rep")))
    every = bands(classes)
    shared = every.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("first")).filter("n > 1")
    members = cut_lineage(_joined(every, shared, "band"))
    degree = members.groupBy("rep").agg(F.sum("n").alias("degree"))
    hubs = _joined(members.filter("n > 2"), degree, "rep").groupBy("band").agg(F.expr("max_by(rep, struct(degree, -rep))").alias("hub"))
    sketched = classes.select("rep", "k0", "k1", "k2", "k3")
    sets = cut_lineage(_sets(d, _joined(classes.select("rep", "id", "row"), members.select("rep"), "rep", "left_semi")))
    release(docs.sparkSession)

    def pair(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    checked = cut_lineage(_sketch_filter(members.filter("rep <> first").select(*pair("rep", "first")).distinct(), sketched))
    links = cut_lineage(confirm(checked, sets))
    comp = components(links)

    # round two, between components only
    def placed(rows: DataFrame, column: str) -> DataFrame:
        own = comp.select(F.col("id").alias(column), F.col("comp").alias(f"{column}_comp"))
        return _joined(rows, own, column, "left").withColumn(f"{column}_comp", F.coalesce(f"{column}_comp", column))

    apart = placed(placed(_joined(members, hubs, "band").select("rep", "hub").distinct(), "rep"), "hub").filter("rep_comp <> hub_comp")
    more = _sketch_filter(_joined(apart.select(*pair("rep", "hub")).distinct(), checked, ["a", "b"], "left_anti"), sketched)
    more = cut_lineage(more)
    links = links.unionAll(cut_lineage(confirm(more, sets)))
    checked = checked.unionAll(more)
    comp = components(links)
    # the rest: bands that still hold several components
    lone = placed(members.select("unit", "second", "band", "rep"), "rep")
    mixed = lone.groupBy("band").agg(F.min("rep_comp").alias("lo"), F.max("rep_comp").alias("hi")).filter("lo <> hi").select("band")
    rest = cut_lineage(_joined(lone, mixed, "band", "left_semi").select("unit", "second", "rep", F.col("rep_comp").alias("comp")))
    hot = rest.groupBy("unit", "rep").count().groupBy("unit").agg(F.count("*").alias("n"))
    # dealing to blocks repeats a member once a block, splitting by band at most once for every other group
    hot = hot.filter(F.col("n") > (TABLES - 1) * BLOCK).select("unit")
    whole = _joined(rest, hot, "unit", "left_anti").select("unit", F.lit(None).cast("long").alias("second"), "rep", "comp").distinct()
    rest = cut_lineage(whole.unionByName(_joined(rest, hot, "unit", "left_semi").distinct()))
    found = cut_lineage(exhaust(rest, classes, sets))
    release(docs.sparkSession)
    if not found.isEmpty():
        comp = components(links.unionAll(found))

    # a component is named by its smallest id; of equal ids the smallest digest leads
    linked = cut_lineage(_joined(comp.withColumnRenamed("id", "rep"), classes.select("rep", "id", "digest"), "rep"))
    heads = linked.groupBy("comp").agg(F.min(F.struct("id", "digest")).alias("head"))
    named = _joined(linked, heads, "comp").select("rep", F.col("head.id").alias("head_id"), (F.col("digest") == F.col("head.digest")).alias("leads"))
    own = _joined(classes.select("digest", "rep", F.col("id").alias("lead_id")), named, "rep", "left")
    own = own.select("digest", F.coalesce("head_id", "lead_id").alias("component_id"), F.coalesce("leads", F.lit(True)).alias("leads"))
    told = _joined(some.select("id", "row", "n_shingles", "digest"), own, "digest")
    told = told.select("id", "row", "n_shingles", "digest", "component_id", (F.col("leads") & (F.col("id") == F.col("component_id"))).alias("kept"))
    none = signed.filter("digest is null").select("id", "row", "n_shingles", "digest", F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return told.unionAll(none)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per document."""
    real = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return resolve(docs, id_col, text_col).select(real("id").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"), "kept")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
