"""Event merges in order: version checks, chains, snapshots, stale marks, and undo with compensation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ("missing", "version_conflict", "self_merge", "merged")


def decide(events: DataFrame, commands: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(merge_id, seq, canonical_id, merged_id, outcome) as if the commands ran one after the other by seq.

    events: event_id, row_version; commands: merge_id, seq (unique), canonical_id, merged_id, canonical_version, merged_version. A
    merge raises the merged event's version, so a later command that expects the old one conflicts: after B into C, A
    into B does; after A into B, B into C doesn't. Versions are checked before self-merges.

    A command is settled once no earlier unsettled one could still merge either of its events away, so a round settles the first of
    every event at once, with all later ones that expect a version which has passed; the rounds are as many as commands that wait
    for each other in a row. cut() stores a round.
    """
    v = events.select("event_id", "row_version")
    d = commands.join(v.select(F.col("event_id").alias("canonical_id"), F.col("row_version").alias("_c")), "canonical_id", "left")
    d = d.join(v.select(F.col("event_id").alias("merged_id"), F.col("row_version").alias("_m")), "merged_id", "left")
    gone = F.col("_c").isNull() | F.col("_m").isNull()
    # what can't succeed whatever the others do: the version only grows
    never = gone | (F.col("_c") > F.col("canonical_version")) | (F.col("_m") > F.col("merged_version"))
    keep = ["merge_id", "seq", "canonical_id", "merged_id"]
    done = d.filter(never).select(*keep, F.when(gone, "missing").otherwise("version_conflict").alias("outcome"))
    left = cut(d.filter(~never))
    settled: list[DataFrame] = [done]
    while left.take(1):
        first = left.groupBy(F.col("merged_id").alias("event_id")).agg(F.min("seq").alias("_first"))
        r = left.join(first.withColumnsRenamed({"event_id": "canonical_id", "_first": "_fc"}), "canonical_id", "left").join(first.withColumnsRenamed({"event_id": "merged_id", "_first": "_fm"}), "merged_id")
        ready = (F.coalesce(F.col("_fc"), F.col("seq")) >= F.col("seq")) & (F.col("_fm") >= F.col("seq"))
        same = (F.col("_c") == F.col("canonical_version")) & (F.col("_m") == F.col("merged_version"))
        outcome = F.when(~same, "version_conflict").when(F.col("canonical_id") == F.col("merged_id"), "self_merge").otherwise("merged")
        r = cut(r.withColumn("outcome", F.when(ready, outcome)).drop("_fc", "_fm"))
        settled.append(r.filter("outcome is not null").select(*keep, "outcome"))
        # a round merges an event away once at most; it counts for later commands only
        raised = r.filter("outcome = 'merged'").select(F.col("merged_id").alias("event_id"), F.col("seq").alias("_at"))
        left = r.filter("outcome is null").drop("outcome")
        left = left.join(raised.withColumnsRenamed({"event_id": "canonical_id", "_at": "_ac"}), "canonical_id", "left").join(raised.withColumnsRenamed({"event_id": "merged_id", "_at": "_am"}), "merged_id", "left")
        up = lambda v, at: F.col(v) + F.coalesce((F.col(at) < F.col("seq")).cast("int"), F.lit(0))
        left = cut(left.withColumns({"_c": up("_c", "_ac"), "_m": up("_m", "_am")}).drop("_ac", "_am"))
        # a version that has passed what is expected never comes back
        late = (F.col("_c") > F.col("canonical_version")) | (F.col("_m") > F.col("merged_version"))
        settled.append(left.filter(late).select(*keep, F.lit("version_conflict").alias("outcome")))
        left = left.filter(~late)
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def resolve(pointers: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(event_id, canonical_id, hops) of (event_id, merged_into): the end of each chain, by doubling the pointers.

    A chain of n merges takes log2(n) rounds. Events that were merged in a ring have no end: their canonical_id is null.
    """
    now = cut(pointers.select("event_id", F.col("merged_into").alias("canonical_id"), F.lit(1).cast("long").alias("hops")))
    limit = now.count()
    reach = 1
    while reach <= limit:
        step = now.select(F.col("event_id").alias("canonical_id"), F.col("canonical_id").alias("_next"), F.col("hops").alias("_more"))
        d = now.join(step, "canonical_id", "left")
        nxt = cut(d.select("event_id", F.coalesce("_next", "canonical_id").alias("canonical_id"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"), F.col("_next").isNotNull().alias("_moved")))
        moved = nxt.filter("_moved").take(1)
        now, reach = nxt.drop("_moved"), 2 * reach
        if not moved:
            return now
    return now.withColumn("canonical_id", F.when(F.col("hops") <= limit, F.col("canonical_id")))


def snapshot(outcomes: DataFrame, memberships: DataFrame) -> DataFrame:
    """(merge_id, event_id, claim_id): what both events of a merge held, which an undo restores. memberships: event_id, claim_id."""
    both = outcomes.filter("outcome = 'merged'").select("merge_id", F.explode(F.array("canonical_id", "merged_id")).alias("event_id"))
    return both.join(memberships, "event_id").select("merge_id", "event_id", "claim_id")


def apply(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Events (event_id, row_version, lifecycle, merged_into) after the merges; the last merge of an event names its canonical one."""
    m = outcomes.filter("outcome = 'merged'").groupBy(F.col("merged_id").alias("event_id")).agg(F.max_by("canonical_id", "seq").alias("_into"), F.count("*").alias("_up"))
    d = events.join(m, "event_id", "left")
    merged = F.col("_into").isNotNull()
    return d.select("event_id", (F.col("row_version") + F.coalesce("_up", F.lit(0))).alias("row_version"), F.when(merged, "merged").otherwise(F.col("lifecycle")).alias("lifecycle"), F.coalesce("_into", "merged_into").alias("merged_into"))


def stale_marks(outcomes: DataFrame, memberships: DataFrame, claim_evidence: DataFrame, citations: DataFrame, marked: DataFrame) -> DataFrame:
    """(report_id, merge_id): reports that cite evidence of claims of either event, each once, by its first merge, if not marked yet."""
    both = outcomes.filter("outcome = 'merged'").select("merge_id", "seq", F.explode(F.array("canonical_id", "merged_id")).alias("event_id"))
    d = both.join(memberships, "event_id").join(claim_evidence, "claim_id").join(citations, "evidence_id")
    return d.groupBy("report_id").agg(F.min_by("merge_id", "seq").alias("merge_id")).join(marked, "report_id", "left_anti")


def undo(merges: DataFrame, events: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, compensations, restored memberships) of undoing merges (merge_id, canonical_id, merged_id, canonical_version, merged_version).

    The versions are those right after the merge. If either event was edited since, nothing is overwritten: the undo
    is a conflict and leaves a compensation row for review. A merge whose events are gone is missing.
    """
    v = events.select("event_id", "row_version")
    d = merges.join(v.select(F.col("event_id").alias("canonical_id"), F.col("row_version").alias("_c")), "canonical_id", "left")
    d = d.join(v.select(F.col("event_id").alias("merged_id"), F.col("row_version").alias("_m")), "merged_id", "left")
    edits = F.greatest(F.col("_c") - F.col("canonical_version"), F.lit(0)) + F.greatest(F.col("_m") - F.col("merged_version"), F.lit(0))
    edits = F.when(F.col("_c").isNotNull() & F.col("_m").isNotNull(), edits)
    d = d.withColumn("modifications", edits)
    outcome = F.when(edits.isNull(), "missing").when(edits > 0, "conflict").otherwise("undone")
    outcomes = d.select("merge_id", "canonical_id", "merged_id", "modifications", outcome.alias("outcome"))
    compensations = outcomes.filter("outcome = 'conflict'").select("merge_id", F.col("modifications").alias("post_merge_modifications"), F.lit("manual re-split required").alias("action"))
    restored = snapshots.join(outcomes.filter("outcome = 'undone'").select("merge_id"), "merge_id", "left_semi")
    return outcomes, compensations, restored


def membership_intervals(log: DataFrame) -> DataFrame:
    """(claim_id, event_id, since, until) of a log (claim_id, event_id, seq): a claim belongs to an event until the next entry moves it.

    An undo appends the entries of its snapshot, so the earlier membership comes back as a further interval.
    """
    w = Window.partitionBy("claim_id").orderBy("seq")
    moved = log.withColumn("_before", F.lag("event_id").over(w)).filter(~F.col("event_id").eqNullSafe(F.col("_before")))
    return moved.select("claim_id", "event_id", F.col("seq").alias("since"), F.lead("seq").over(w).alias("until"))
