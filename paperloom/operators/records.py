"""Records of the document application: scoped lists, pointer and revision joins, merges, drift, watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.url import normalize_url

#: Pairs of a product by a key that a task makes.
PAIRS = 4_000_000


def listed(rows: DataFrame, equals: dict[str, object], within: dict[str, list] | None = None, deleted: str | None = None) -> DataFrame:
    """Rows by optional equalities (None asks for nothing), IN lists, and without soft-deleted ones."""
    for name, value in equals.items():
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    for name, values in (within or {}).items():
        rows = rows.filter(F.col(name).isin(*values))
    return rows.filter(F.col(deleted).isNull()) if deleted else rows


def like_any(columns: list[str], needle: str) -> Column:
    """Case-insensitive substring search over several columns. The needle is a pattern: % is any text, _ any character, and
    a backslash makes the next character an ordinary one."""
    pattern, rest = "", iter(f"%{needle}%")
    for c in rest:
        if c == "\\":
            c = next(rest)
            pattern += f"\\{c}" if c in "%_\\" else c
        else:
            pattern += c
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return found


def unified(kinds: list[tuple[str, DataFrame]], most: int | None = 50) -> DataFrame:
    """(ordinal, kind, id, moment) of several hit lists (id, moment), each kind after the other, of each the ``most`` newest, or all."""
    out = None
    for n, (kind, hits) in enumerate(kinds):
        hits = hits if most is None else hits.orderBy(F.desc_nulls_last("moment"), "id").limit(most)
        part = hits.select(F.lit(n).alias("ordinal"), F.lit(kind).alias("kind"), "id", "moment")
        out = part if out is None else out.unionByName(part)
    return out


def chain(chunks: DataFrame, parses: DataFrame, captures: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk to document: inner joins over parse_id, capture_id and document_id, documents already in scope.

    Every key is the next table's own, so no row multiplies; the scope prunes documents first.
    """
    d = captures.join(documents, "document_id").select("capture_id", "document_id")
    return chunks.join(parses.join(d, "capture_id"), "parse_id")


def fan_out(left: DataFrame, right: DataFrame, key: str, cut: str, pairs: int = PAIRS) -> DataFrame:
    """Every row of left with every row of right of its key, so many pairs a task, however few keys there are.

    The pairs of a key are counted first. Its left rows are dealt by ``cut`` to as many blocks as its pairs need, and its right
    rows meet each of these; there are as many tasks as all pairs need. A null key meets nothing.
    """
    n, m = (d.groupBy(key).agg(F.count("*").alias(c)) for d, c in ((left, "_n"), (right, "_m")))
    sizes = n.join(m, key).select(key, (F.col("_n") * F.col("_m")).alias("_pairs"))
    sizes = sizes.withColumn("_blocks", F.ceil(F.col("_pairs") / pairs))
    tasks = sizes.agg(F.coalesce(F.ceil(F.sum("_pairs") / pairs), F.lit(1)).cast("int")).first()[0]
    x = left.join(sizes.select(key, "_blocks"), key).withColumn("_block", F.pmod(F.xxhash64(cut), F.col("_blocks"))).drop("_blocks")
    y = right.join(sizes.select(key, "_blocks"), key).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    return x.repartition(tasks, key, "_block").join(y.repartition(tasks, key, "_block"), [key, "_block"]).drop("_block")


def current(rows: DataFrame, revisions: DataFrame, pointer: str, key: str, required: bool = True) -> DataFrame:
    """Rows with their current revision's columns; without one they go, or stay with nulls."""
    r = revisions.withColumnRenamed(key, pointer)
    return rows.join(r, pointer, "inner" if required else "left")


def history(revisions: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Adds version (1 is the newest) within each key."""
    return revisions.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def committed(claims: DataFrame, known: DataFrame, owner: str, claim: str) -> DataFrame:
    """(owner, kept, dropped): claims that are known are kept, the others counted."""
    d = claims.join(known.select(claim).distinct().withColumn("_known", F.lit(1)), claim, "left")
    return d.groupBy(owner).agg(F.count("_known").alias("kept"), (F.count("*") - F.count("_known")).alias("dropped"))


def drift(existing: DataFrame, wanted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change): entries missing, superfluous, or of another value than wanted."""
    a, b = existing.select(*keys, F.col(value).alias("_old"), F.lit(1).alias("_a")), wanted.select(*keys, F.col(value).alias("_new"), F.lit(1).alias("_b"))
    d = a.join(b, keys, "full_outer")
    change = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "superfluous").when(~F.col("_old").eqNullSafe(F.col("_new")), "stale")
    return d.withColumn("change", change).filter("change is not null").select(*keys, "change")


def next_number(log: DataFrame, key: str, number: str, pending: Column) -> DataFrame:
    """(key, next_seq, first_seq, pending): the number to give next, the oldest kept, and what waits."""
    return log.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_seq"), F.min(number).alias("first_seq"), F.count(F.when(pending, 1)).alias("pending"))


def within_budget(calls: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """Adds whether a call is among the first ``most`` of its key."""
    return calls.withColumn("allowed", F.row_number().over(Window.partitionBy(key).orderBy(*order)) <= most)


def append_changed(current_: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """New revisions (key, fields, version) of rows whose patch (nulls keep the value) changes a field."""
    p = patches.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    d = current_.join(p, key)
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~F.coalesce(f"_{f}", f).eqNullSafe(F.col(f))
    return d.filter(changed).select(key, *[F.coalesce(f"_{f}", f).alias(f) for f in fields], (F.col("version") + 1).alias("version"))


def cited_only(blocks: DataFrame, citable: DataFrame, answer: str, evidence: str) -> DataFrame:
    """(answer, kept, status): blocks that cite only evidence of the answer's packet stay; insufficient if none does.

    blocks: answer, block, cited (array). Uncited blocks and blocks that cite something else are dropped.
    """
    each = blocks.select(answer, "block", F.explode_outer("cited").alias(evidence))
    known = citable.select(answer, evidence).distinct().withColumn("_known", F.lit(1))
    per = each.join(known, [answer, evidence], "left").groupBy(answer, "block").agg((F.count(evidence) > 0).alias("any"), (F.count(evidence) == F.count("_known")).alias("all"))
    kept = F.count(F.when(F.col("any") & F.col("all"), 1))
    return per.groupBy(answer).agg(kept.alias("kept")).withColumn("status", F.when(F.col("kept") == 0, "insufficient_evidence").otherwise("answered"))


def sanitised(value: Column, allowed: tuple[str, ...], fallback: str) -> Column:
    """The value in the vocabulary, else the fallback."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(fallback))


def encode_cursor(fields: dict[str, Column]) -> Column:
    """An opaque cursor: base64 of the fields as JSON."""
    return F.base64(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])))


def decode_cursor(cursor: Column, schema: str) -> Column:
    """The cursor's fields; a malformed one has none (a struct of nulls)."""
    text = F.decode(F.try_to_binary(F.coalesce(cursor, F.lit("")), F.lit("base64")), "utf-8")
    return F.from_json(F.coalesce(text, F.lit("{}")), schema)


def run_summaries(log: DataFrame, key: list[str], failed: Column) -> DataFrame:
    """(key, started, finished, discovered, failures, status) of source runs; failed runs are partial or failed."""
    d = log.groupBy(*key).agg(F.min("moment").alias("started"), F.max("moment").alias("finished"), F.count("*").alias("discovered"), F.count(F.when(failed, 1)).alias("failures"))
    return d.withColumn("status", F.when(F.col("failures") == 0, "complete").when(F.col("failures") < F.col("discovered"), "partial").otherwise("failed"))


def canonical(entries: DataFrame) -> DataFrame:
    """Adds canonical_url, null where url isn't an absolute http(s) URL."""
    return entries.withColumn("canonical_url", normalize_url(F.col("url")))


def discover(entries: DataFrame, known: DataFrame, boundary: DataFrame, feed: str, hours: int = 72) -> tuple[DataFrame, DataFrame]:
    """(new candidates, next boundaries) of one discovery step. entries: feed, url, published; known: feed, canonical_url;
    boundary: feed, at.

    Entries older than a feed's boundary less the overlap are history and dropped; undated ones stay. What is known by
    its canonical URL is skipped, and URLs without one are no candidates. The boundary is the oldest moment
    that a feed has shown inside the overlap, so it only moves back.
    """
    d = canonical(entries).join(boundary, feed, "left")
    fresh = d.filter(F.col("at").isNull() | F.col("published").isNull() | (F.col("published") >= F.col("at") - F.expr(f"INTERVAL {hours} HOURS")))
    found = fresh.filter("canonical_url is not null").groupBy(feed, "canonical_url").agg(F.min("url").alias("url"), F.min("published").alias("published"))
    new = found.join(known.select(feed, "canonical_url").distinct(), [feed, "canonical_url"], "left_anti")
    moved = fresh.groupBy(feed).agg(F.min("published").alias("_oldest"))
    return new, boundary.join(moved, feed, "full_outer").select(feed, F.least("at", "_oldest").alias("at"))
