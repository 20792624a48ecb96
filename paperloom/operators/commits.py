"""What an extraction and an event build commit, each as one set of tables with ids that a repeated commit gives again.

An id is a hash of what a row is about (its run, its number), so committing a run twice writes nothing new
(``relational.insert_or_ignore`` on the id), and links can be formed before anything is stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import identity, timevalue
from paperloom.operators import knowledge, quotes

# Fixed values.
SEMANTIC = ("pending", "supports", "refutes", "uncertain")
IDENTITY_FIELDS = (
    "work_id", "version", "action", "release_ref", "product", "phase", "region", "attribute", "change_ref", "effective_window",
    "announcement_ref", "counterparty", "result_key", "conditions", "correction_ref", "target_ref",
)
MOST_PROPOSALS = 32
DECISIONS = ("direct", "background", "uncertain", "unrelated")


def key(*parts: Column | str) -> Column:
    return F.xxhash64(*parts)


@dataclass
class Extraction:
    families: DataFrame
    claims: DataFrame
    evidence: DataFrame
    rejected: DataFrame


def extraction(claims: DataFrame, evidence: DataFrame, blocks: DataFrame, origins: DataFrame, families: DataFrame, semantic: DataFrame) -> Extraction:
    """The tables of committed runs.

    claims: run_id, parse_id, claim_no, text, kind, attribution; evidence: run_id, claim_no, ordinal, block_id, quote, relation;
    blocks: parse_id, block_id, text; origins: parse_id, origin_ref; families: family_id, origin_ref; semantic: run_id,
    claim_no, status (a second judgement; without one evidence is pending, an odd one uncertain).

    Only valid claims are written, with the one place of each quote; reposts of one origin share a family, which is new only for
    the first. Rejected claims are kept with the code that decided.
    """
    c = claims.withColumn("claim_id", key(F.lit("claim"), "run_id", "claim_no"))
    e = evidence.join(c.select("run_id", "claim_no", "claim_id", "parse_id"), ["run_id", "claim_no"])
    # a block belongs to its parse: ids of blocks repeat across parses
    place = lambda d: F.concat_ws("\x1f", d["parse_id"], d["block_id"])
    b = blocks.select(place(blocks).alias("block_id"), "text")
    e = e.withColumn("own_block", F.col("block_id")).withColumn("block_id", F.concat_ws("\x1f", "parse_id", "own_block"))
    judged = knowledge.validate_claims(c.select("claim_id", "text", "kind", "attribution"), e.select("claim_id", "ordinal", "block_id", "quote"), b)
    c = c.drop("kind").join(judged, "claim_id")
    accepted, rejected = c.filter("code is null"), c.filter("code is not null").select("run_id", "claim_no", "code")

    o = origins.filter(F.coalesce(F.col("origin_ref"), F.lit("")) != "").select("parse_id", "origin_ref").distinct()
    known = families.select("origin_ref", F.col("family_id").alias("_known"))
    o = o.join(known, "origin_ref", "left").withColumn("family_id", F.coalesce("_known", key(F.lit("family"), "origin_ref")))
    used = accepted.select("parse_id").distinct()
    new = o.filter("_known is null").join(used, "parse_id", "left_semi").groupBy("family_id", "origin_ref").agg(F.concat(F.lit("origin:"), F.substring("origin_ref", 1, 120)).alias("label"))

    s = semantic.select("run_id", "claim_no", F.when(F.col("status").isin(*SEMANTIC), F.col("status")).otherwise("uncertain").alias("status"))
    spans = quotes.locations(e.select("claim_id", "ordinal", "block_id", "quote"), b).filter("nth = 0").select("claim_id", "ordinal", "start", "end")
    w = accepted.select("claim_id", "run_id", "claim_no", "parse_id").join(s, ["run_id", "claim_no"], "left").join(o.select("parse_id", "family_id"), "parse_id", "left")
    out = w.join(e.select("claim_id", "ordinal", "own_block", "quote", "relation"), "claim_id").join(spans, ["claim_id", "ordinal"])
    out = out.select(key(F.lit("evidence"), "claim_id", "ordinal").alias("evidence_id"), "claim_id", "run_id", "parse_id", F.col("own_block").alias("block_id"), "start", "end", "quote", "relation", F.coalesce("status", F.lit("pending")).alias("status"), "family_id")
    return Extraction(new, accepted.select("claim_id", "run_id", "parse_id", "claim_no", "text", "kind", "attribution"), out, rejected)


@dataclass
class EventBuild:
    events: DataFrame
    links: DataFrame
    duplicates: DataFrame
    reports: DataFrame


def event_build(proposals: DataFrame, committed: DataFrame, existing: DataFrame) -> EventBuild:
    """The tables of event builds.

    proposals: run_id, proposal_no, event_type, title, summary, identity (map), occurred, claim_ids, candidate_id; committed: run_id,
    claim_id; existing: event_id, event_key.

    Of a run the first ``MOST_PROPOSALS`` proposals count. Claim ids that the run didn't commit are dropped and counted; identity
    fields outside the allowed names are left out; the time is parsed from its words and may be unknown. A key that is known links, the first
    proposal of a new key creates its event and the others link to it, and a proposal without a key always creates one, with
    its candidate noted as a possible duplicate. Links to one event are kept once.
    """
    order = Window.partitionBy("run_id").orderBy("proposal_no")
    fields = F.map_filter(F.coalesce("identity", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*IDENTITY_FIELDS) & (F.trim(F.coalesce(v, F.lit(""))) != ""))
    p = proposals.withColumn("event_key", identity.identity_key(F.col("event_type"), fields)).drop("identity")
    p = p.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= MOST_PROPOSALS)
    p = p.withColumns({"proposal_id": key(F.lit("proposal"), "run_id", "proposal_no"), "time": timevalue.parse_time(F.col("occurred"))})
    known = existing.filter("event_key is not null").groupBy("event_key").agg(F.min("event_id").alias("_known"))
    p = p.join(known, "event_key", "left")
    # the first of a key is aggregated: a common key's proposals needn't meet in one task
    place = F.struct("run_id", "_n")
    firsts = p.filter("event_key is not null").groupBy("event_key").agg(F.min(place).alias("_least"))
    p = p.join(firsts, "event_key", "left").withColumn("_first", F.col("event_key").isNull() | F.col("_least").eqNullSafe(place))
    new_id = F.when(F.col("event_key").isNotNull(), key(F.lit("event"), "event_key")).otherwise(key(F.lit("event"), "proposal_id"))
    p = p.withColumns({"event_id": F.coalesce("_known", new_id), "created": F.col("_known").isNull() & F.col("_first")})
    rationale = F.when(F.col("event_key").isNotNull(), F.concat(F.lit("strong identity key: "), F.col("event_key"))).otherwise("no strong identity key; independent event")
    events = p.filter("created").select(
        "event_id", key(F.lit("revision"), "event_id").alias("revision_id"), F.lit(1).alias("version"), "event_type", "title", "summary", "event_key", rationale.alias("rationale"),
        F.col("time.precision").alias("precision"), F.col("time.start").alias("occurred_start"), timevalue.stored_end(F.col("time.precision"), F.col("time.end")).alias("occurred_end"), "run_id",
    )
    asked = p.select("run_id", "proposal_id", "event_id", F.explode("claim_ids").alias("claim_id")).distinct()
    real = committed.select("run_id", "claim_id").distinct().withColumn("_real", F.lit(1))
    asked = asked.join(real, ["run_id", "claim_id"], "left")
    links = asked.filter("_real = 1").select("event_id", "claim_id").distinct()
    duplicates = p.filter("created and event_key is null and candidate_id is not null").select("event_id", F.col("candidate_id").alias("candidate_event_id"), F.lit("weak identity; similarity candidate only").alias("reason"))
    dropped = asked.groupBy("run_id").agg(F.count(F.when(F.col("_real").isNull(), 1)).alias("dropped_claim_references"))
    counts = p.groupBy("run_id").agg(F.count(F.when(F.col("created"), 1)).alias("events_created"), F.count(F.when(~F.col("created"), 1)).alias("events_linked"))
    return EventBuild(events, links, duplicates, counts.join(dropped, "run_id", "left").fillna(0, ["dropped_claim_references"]))


def route_rows(decisions: DataFrame, stored: DataFrame) -> DataFrame:
    """(parse_id, topic_id, decision, confidence, row_version) to be written: a decision outside the vocabulary is uncertain, one that
    equals what is stored writes nothing, and a change raises the version. The last of equal keys by seq counts."""
    last = Window.partitionBy("parse_id", "topic_id").orderBy(F.desc("seq"))
    d = decisions.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "seq")
    d = d.withColumn("decision", F.when(F.col("decision").isin(*DECISIONS), F.col("decision")).otherwise("uncertain"))
    s = stored.select("parse_id", "topic_id", F.col("decision").alias("_old"), F.col("confidence").alias("_was"), F.col("row_version").alias("_v"))
    d = d.join(s, ["parse_id", "topic_id"], "left")
    changed = F.col("_v").isNull() | ~F.col("decision").eqNullSafe(F.col("_old")) | ~F.col("confidence").eqNullSafe(F.col("_was"))
    return d.filter(changed).select("parse_id", "topic_id", "decision", "confidence", (F.coalesce("_v", F.lit(0)) + 1).alias("row_version"))
