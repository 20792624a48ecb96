"""Claims, events, routes, lineage, evolution edges, coverage and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import numbers_in, quote_count, quote_start

MIN_QUOTE = 8


def validate_claims(claims: DataFrame, evidence: DataFrame, blocks: DataFrame, least: int = MIN_QUOTE) -> DataFrame:
    """(claim_id, code, kind): code is null for accepted claims; the first failing evidence decides.

    claims: claim_id, text, kind, attribution; evidence: claim_id, ordinal, block_id, quote; blocks: block_id, text.
    A statement of a source that names no source is kept as an inference.
    """
    e = evidence.join(blocks.select("block_id", F.col("text").alias("block")), "block_id", "left")
    n = quote_count(F.col("block"), F.col("quote"))
    code = (
        F.when(F.col("block").isNull(), "block_missing")
        .when(F.char_length(F.trim("quote")) < least, "quote_too_short")
        .when(n == 0, "quote_not_found")
        .when(n > 1, "quote_ambiguous")
    )
    per = e.withColumn("code", code).groupBy("claim_id").agg(
        F.min_by("code", F.when(F.col("code").isNotNull(), F.col("ordinal"))).alias("code"),
        F.array_distinct(F.flatten(F.collect_list(numbers_in(F.col("quote"))))).alias("quoted"),
    )
    d = claims.join(per, "claim_id", "left")
    unsupported = F.size(F.array_except(numbers_in(F.col("text")), F.col("quoted"))) > 0
    verdict = F.when(F.col("quoted").isNull(), "no_evidence").when(F.col("code").isNotNull(), F.col("code")).when(unsupported, "numeric_unsupported")
    kind = F.when((F.col("kind") == "source_statement") & (F.trim(F.coalesce("attribution", F.lit(""))) == ""), "inference").otherwise(F.col("kind"))
    return d.select("claim_id", verdict.alias("code"), kind.alias("kind"))


def quote_locations(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds start (from 0) and end of quotes that occur once."""
    e = evidence.join(blocks.select("block_id", F.col("text").alias("block")), "block_id")
    start = quote_start(F.col("block"), F.col("quote"))
    return e.filter(quote_count(F.col("block"), F.col("quote")) == 1).select("claim_id", "ordinal", "block_id", start.alias("start"), (start + F.char_length("quote")).alias("end"))


def resolve_events(proposals: DataFrame, existing: DataFrame) -> DataFrame:
    """(proposal_id, event_key, action): link to a known event, create for the first of a key, link the rest.

    Proposals without a key create; with a candidate they are possible duplicates.
    """
    known = existing.select("event_key").distinct().withColumn("_known", F.lit(True))
    d = proposals.join(known, "event_key", "left")
    n = F.row_number().over(Window.partitionBy("event_key").orderBy("proposal_id"))
    keyed = d.filter("event_key is not null").withColumn("_n", n)
    action = F.when(F.col("_known"), "link").when(F.col("_n") == 1, "create").otherwise("link")
    free = d.filter("event_key is null").select("proposal_id", "event_key", F.when(F.col("has_candidate"), "possible_duplicate").otherwise("create").alias("action"))
    return keyed.select("proposal_id", "event_key", action.alias("action")).unionByName(free)


def topic_verdicts(topics: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every topic once: its verdict, or uncertain with the fallback's reason; verdicts of other topics go."""
    d = topics.join(verdicts, "topic_id", "left")
    return d.select("topic_id", F.coalesce("decision", F.lit("uncertain")).alias("decision"), F.coalesce("reason", F.lit("fallback:no_verdict")).alias("reason"))


def independence(evidence: DataFrame) -> DataFrame:
    """(claim_id, n_evidence, n_families): reposts of one origin are one family."""
    return evidence.groupBy("claim_id").agg(F.count("*").alias("n_evidence"), F.countDistinct("origin").alias("n_families"))


def gate_edges(edges: DataFrame) -> DataFrame:
    """(edge_id, reason): null for accepted edges. edges: edge_id, from_node, to_node, relation, basis, n_evidence.

    ``parallel`` is symmetric; of equal edges the first by id stays.
    """
    symmetric = F.col("relation") == "parallel"
    a = F.when(symmetric, F.least("from_node", "to_node")).otherwise(F.col("from_node"))
    b = F.when(symmetric, F.greatest("from_node", "to_node")).otherwise(F.col("to_node"))
    own = (
        F.when(F.col("from_node") == F.col("to_node"), "self_loop")
        .when(~F.coalesce("basis", F.lit("")).isin("explicit", "inferred"), "no_basis")
        .when((F.col("basis") == "inferred") & F.col("relation").isin("validates", "refutes", "applies") & (F.col("n_evidence") == 0), "inferred_relation_without_evidence")
    )
    d = edges.withColumns({"a": a, "b": b, "own": own})
    n = F.row_number().over(Window.partitionBy("a", "b", "relation").orderBy(F.col("own").isNotNull(), "edge_id"))
    return d.withColumn("n", n).select("edge_id", F.coalesce("own", F.when(F.col("n") > 1, "duplicate_parallel")).alias("reason"))


#: Relations that must not form a cycle.
ORDERED = ("updates", "replaces", "extends")


def cyclic_nodes(edges: DataFrame, cut) -> DataFrame:
    """Nodes on a cycle of (from_node, to_node, relation), or between two: a proposal with any is rejected as a whole.

    Only the ordered relations count. Edges whose start nothing leads to, or whose end leads nowhere, are peeled off
    from both ends until none is left. cut() stores a round's edges (a checkpoint); a layer of the graph is one round.
    """
    left = cut(edges.filter(F.col("relation").isin(*ORDERED)).select("from_node", "to_node").distinct())
    size = left.count()
    while size:
        fed = left.join(left.select(F.col("to_node").alias("from_node")).distinct(), "from_node", "left_semi")
        left = cut(fed.join(left.select(F.col("from_node").alias("to_node")).distinct(), "to_node", "left_semi").select("from_node", "to_node"))
        before, size = size, left.count()
        if size == before:
            break
    return left.select(F.explode(F.array("from_node", "to_node")).alias("node")).distinct()


def build_status(edges: DataFrame, coverage: DataFrame, key: str, floor: float = 0.5) -> DataFrame:
    """(key, status): insufficient without an accepted edge or below the coverage floor, else built."""
    n = edges.filter("reason is null").groupBy(key).agg(F.count("*").alias("n"))
    d = coverage.join(n, key, "left")
    return d.select(key, F.when(F.coalesce("n", F.lit(0)) == 0, "insufficient").when(F.col("coverage") < floor, "insufficient").otherwise("built").alias("status"))


def coverage_status(batches: DataFrame) -> DataFrame:
    """One row: totals, phases with gaps, status unknown, partial, pending or complete."""
    d = batches.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("discovered"), F.lit(0)).alias("discovered"),
        F.coalesce(F.sum("captured"), F.lit(0)).alias("captured"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("status") != "complete", F.col("phase")))), ",").alias("gaps"),
        F.coalesce(F.max(F.col("status") == "failed"), F.lit(False)).alias("failed"),
        F.coalesce(F.max(F.col("status") != "complete"), F.lit(False)).alias("open"),
    )
    status = F.when(F.col("n") == 0, "unknown").when(F.col("failed"), "partial").when(F.col("open"), "pending").otherwise("complete")
    return d.select("discovered", "captured", "gaps", status.alias("status"))


def citation_coverage(statements: DataFrame, key: str) -> DataFrame:
    """(key, cited, total, coverage): statements(key, n_citations); 1.0 where there are none."""
    d = statements.groupBy(key).agg(F.sum((F.col("n_citations") > 0).cast("long")).alias("cited"), F.count("n_citations").alias("total"))
    return d.withColumn("coverage", F.when(F.col("total") == 0, 1.0).otherwise(F.col("cited") / F.col("total")))


def serial_turns(turns: DataFrame) -> DataFrame:
    """Adds parent_turn (the latest earlier assistant turn) and whether the turn directly follows its predecessor."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    parent = F.last(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumns({"parent_turn": parent, "serial": F.coalesce(F.col("turn") == F.lag("turn").over(w) + 1, F.lit(True))})


def recent_context(turns: DataFrame, n: int = 12) -> DataFrame:
    """The last n turns of every conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def stale_reports(changed: DataFrame, event_claims: DataFrame, claim_evidence: DataFrame, citations: DataFrame, stale: DataFrame) -> DataFrame:
    """New (event_id, report_id) marks: reports that cite evidence of claims of changed events, each pair once."""
    pairs = changed.select("event_id").join(event_claims, "event_id").join(claim_evidence, "claim_id").join(citations, "evidence_id").select("event_id", "report_id").distinct()
    return pairs.join(stale, ["event_id", "report_id"], "left_anti")


def debounced(marked: DataFrame, running: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Topics due for a rebuild: marked long enough ago, nothing running."""
    return marked.filter(F.col("marked_at") <= now - F.expr(f"INTERVAL {minutes} MINUTES")).join(running, "topic_id", "left_anti")
