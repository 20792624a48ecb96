"""Stored JSON to views: source blocks, answer blocks, messages and reports, with defaults for what is missing or malformed.

JSON is read as variants, so a number, a text and a list that look alike are told apart; what isn't JSON is nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ANSWER_KINDS = ("fact", "inference", "unknown")
SOURCE_KINDS = ("paragraph", "heading", "table", "caption")
MESSAGE_STATUS = {"ok": "ready", "insufficient_evidence": "partial"}
NO_COVERAGE = ("pending", 0, 0)

ANSWER = "array<struct<text:string,kind:string,citation_ids:array<string>>>"
SOURCE = "array<struct<block_id:string,text:string,kind:string,page:int>>"


def message_status(outcome: Column) -> Column:
    """The message's status of an answer's outcome; another outcome fails instead of being stored."""
    out = F.raise_error(F.concat(F.lit("unknown answer status "), F.coalesce(outcome, F.lit("null")))).cast("string")
    for name, status in MESSAGE_STATUS.items():
        out = F.when(outcome == name, status).otherwise(out)
    return out


def _json(text: Column) -> Column:
    return F.try_parse_json(text)


def _kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT...; null for nothing."""
    return F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)


def _at(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _items(value: Column) -> Column:
    """The elements of a list that are objects."""
    return F.filter(F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: _kind_of(x) == "OBJECT")


def _said(value: Column, *names: str) -> Column:
    """The first of these that says anything, as text: not null, false, 0 or empty."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        text, kind = F.try_variant_get(value, f"$.{name}", "string"), _kind_of(_at(value, name))
        empty = text.isNull() | (text == "") | ((kind == "BOOLEAN") & (text == "false")) | (kind.isin("BIGINT", "DECIMAL", "DOUBLE") & (text.try_cast("double") == 0))
        out = F.when(~F.coalesce(empty, F.lit(True)), text).otherwise(out)
    return out


def _ids(value: Column, *names: str) -> Column:
    """The first list of these that has an element, as texts."""
    lists = [F.coalesce(F.try_variant_get(value, f"$.{n}", "array<string>"), F.array().cast("array<string>")) for n in names]
    out = lists[-1]
    for one in reversed(lists[:-1]):
        out = F.when(F.size(one) > 0, one).otherwise(out)
    return out


def source_blocks(text: Column) -> Column:
    """Blocks of a stored parse: those with an id (or block_id) and a text; an odd kind is a paragraph, an odd page none."""

    def block(x: Column) -> Column:
        kind, page = F.try_variant_get(x, "$.kind", "string"), F.try_variant_get(x, "$.page", "int")
        whole = (_kind_of(_at(x, "page")) == "BIGINT") & (page >= 1)
        return F.struct(
            F.coalesce(_said(x, "block_id", "id"), F.lit("")).alias("block_id"),
            F.coalesce(_said(x, "text"), F.lit("")).alias("text"),
            F.when(kind.isin(*SOURCE_KINDS), kind).otherwise("paragraph").alias("kind"),
            F.when(whole, page).alias("page"),
        )

    return F.filter(F.transform(_items(_json(text)), block), lambda b: (b["block_id"] != "") & (b["text"] != "")).cast(SOURCE)


def _answer(x: Column, kind: Column, *ids: str) -> Column:
    return F.struct(F.coalesce(_said(x, "text"), F.lit("")).alias("text"), kind.alias("kind"), _ids(x, *ids).alias("citation_ids"))


def _answer_kind(x: Column, otherwise: Column) -> Column:
    kind = F.try_variant_get(x, "$.kind", "string")
    return F.when(kind.isin(*ANSWER_KINDS), kind).otherwise(otherwise)


def report_blocks(content: Column) -> Column:
    """A report's content flattened: the statements of its sections as facts, and blocks that stand by themselves."""

    def of_item(x: Column) -> Column:
        listed = _at(x, "statements")
        statements = F.filter(F.coalesce(F.try_variant_get(listed, "$", "array<variant>"), F.array().cast("array<variant>")), lambda s: (_kind_of(s) == "OBJECT") | ((_kind_of(s) == "STRING") & (F.try_variant_get(s, "$", "string") != "")))
        facts = F.transform(statements, lambda s: F.when(_kind_of(s) == "OBJECT", _answer(s, F.lit("fact"), "citations", "citation_ids")).otherwise(F.struct(F.try_variant_get(s, "$", "string").alias("text"), F.lit("fact").alias("kind"), F.array().cast("array<string>").alias("citation_ids"))))
        own = F.when(_said(x, "text").isNotNull(), F.array(_answer(x, _answer_kind(x, F.lit("fact")), "citation_ids", "citations"))).otherwise(F.array().cast(ANSWER))
        return F.when(_kind_of(listed) == "ARRAY", facts.cast(ANSWER)).otherwise(own.cast(ANSWER))

    return F.flatten(F.transform(_items(_json(content)), of_item))


def message_views(messages: DataFrame) -> DataFrame:
    """Messages (message_id, role, content, citation_manifest) with blocks and citation_ids.

    The manifest's blocks count; without any the content is one block. A block of an odd kind is unknown from a user and a
    fact from anyone else.
    """
    v = _json(F.col("citation_manifest"))
    default = F.when(F.col("role") == "user", "unknown").otherwise("fact")
    blocks = F.transform(_items(_at(v, "blocks")), lambda x: _answer(x, _answer_kind(x, default), "citation_ids", "citations")).cast(ANSWER)
    plain = F.when(F.coalesce(F.col("content"), F.lit("")) != "", F.array(F.struct(F.col("content").alias("text"), default.alias("kind"), F.array().cast("array<string>").alias("citation_ids")))).otherwise(F.array().cast(ANSWER))
    cited = F.filter(F.transform(_items(_at(v, "citations")), lambda x: F.try_variant_get(x, "$.citation_id", "string")), lambda x: x.isNotNull())
    return messages.withColumns({"blocks": F.when(F.size(blocks) > 0, blocks).otherwise(plain.cast(ANSWER)), "citations": cited})


def report_views(reports: DataFrame, revisions: DataFrame, now: Column) -> DataFrame:
    """(report_id, revision_id, title, as_of, blocks, coverage_status, processed, failed, stale): a report without a revision has none yet.

    reports: report_id, title, current_revision_id; revisions: revision_id, as_of, content, coverage, input_manifest (JSON).
    """
    r = revisions.select(F.col("revision_id").alias("current_revision_id"), F.lit(True).alias("_has"), "as_of", "content", "coverage", "input_manifest")
    d = reports.join(r, "current_revision_id", "left")
    coverage, manifest = _json(F.col("coverage")), _json(F.col("input_manifest"))
    status, processed, failed = NO_COVERAGE
    given = _kind_of(coverage) == "OBJECT"
    one = lambda name, kind, default: F.when(given, F.try_variant_get(coverage, f"$.{name}", kind)).otherwise(F.lit(default))
    stale = _said(manifest, "stale").isNotNull()
    has = F.col("_has").isNotNull()
    return d.select(
        "report_id",
        F.when(has, F.col("current_revision_id")).otherwise(F.col("report_id")).alias("revision_id"),
        "title",
        F.when(has, F.col("as_of")).otherwise(now).alias("as_of"),
        report_blocks(F.col("content")).alias("blocks"),
        one("status", "string", status).alias("coverage_status"),
        one("processed", "int", processed).alias("processed"),
        one("failed", "int", failed).alias("failed"),
        F.coalesce(stale, F.lit(False)).alias("stale"),
    )


def uncovered_blocks(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(parse_id, block_id) of blocks with text that no chunk (parse_id, block_ids) names."""
    named = chunks.select("parse_id", F.explode("block_ids").alias("block_id")).distinct()
    return blocks.filter(F.trim("text") != "").select("parse_id", "block_id").join(named, ["parse_id", "block_id"], "left_anti")


def evidence_of(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of each claim's current revision, numbered by when it was created (evidence_id for equal moments)."""
    from pyspark.sql import Window

    d = claims.select("claim_id", F.col("current_revision_id").alias("claim_revision_id")).join(evidence, "claim_revision_id")
    return d.withColumn("nth", F.row_number().over(Window.partitionBy("claim_id").orderBy("created_at", "evidence_id")))
