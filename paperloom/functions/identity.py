"""Keys: event identity, idempotency, retry and schedule arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (required, optional) components in the order of serialisation; other events are never keyed.
COMPONENTS = {
    "paper_version": (("work_id", "version", "action"), ()),
    "product_release": (("release_ref", "product", "phase"), ("version", "region")),
    "product_change": (("product", "attribute", "change_ref"), ("effective_window",)),
    "commercial_announcement": (("announcement_ref", "counterparty", "action"), ()),
    "research_result": (("work_id", "result_key"), ("conditions",)),
    "correction": (("correction_ref", "target_ref"), ()),
    "retraction": (("correction_ref", "target_ref"), ()),
}
# The parts of each job kind's key.
JOB_KINDS = {
    "discover": ("owner", "feed", "schedule_slot", "config_version"),
    "fetch": ("owner", "discovery_item", "refresh_epoch"),
    "parse": ("owner", "capture", "parser_version"),
    "index": ("owner", "parse", "chunker_version", "embedding_version"),
    "route": ("owner", "industry", "parse", "industry_revision", "analysis_version"),
    "topic_recall": ("industry", "topic_revision", "window", "index_generation"),
    "extract": ("industry", "parse", "extraction_version"),
    "event_build": ("industry", "extraction_commit", "event_policy_version"),
    "evolution_build": ("industry", "topic_revision", "input_manifest_hash"),
    "report_build": ("industry", "report_type", "period", "input_manifest_hash"),
    "archive_answer": ("industry", "message_id"),
    "investigate": ("industry", "message_id", "request_version"),
    "reclassify": ("industry", "config_revision", "replay_window"),
    "apply_review": ("industry", "review_id", "decision_version"),
    "watch_check": ("industry", "watch", "schedule_slot"),
    "source_poll": ("owner", "feed", "mode", "idempotency_key"),
}
BACKOFF_FLOOR, BACKOFF_CAP = 30, 1800


def component(value: Column) -> Column:
    """White space of any kind to single blanks, case folded: by way of upper case, which spells out ß and ligatures."""
    flat = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s\x0B\x1C-\x1F\x85\p{Z}]+", " "))
    # sigma in between: it has no final form then, and the optimizer keeps both case changes
    return F.lower(F.translate(F.upper(flat), "Σ", "σ"))


def identity_key(event_type: Column, fields: Column) -> Column:
    """``type|name=value|...``; null if a required component is empty or the type is null or ``other``; an unknown type
    fails. fields is a map."""
    key = F.when(event_type.isNotNull() & (event_type != "other"), F.raise_error(F.concat(F.lit("unknown event type "), event_type))).cast("string")
    for kind, (required, optional) in COMPONENTS.items():
        value = {n: component(fields[n]) for n in (*required, *optional)}
        text = F.concat_ws("|", F.lit(kind), *[F.concat(F.lit(f"{n}="), v) for n, v in value.items()])
        whole = F.lit(True)
        for n in required:
            whole = whole & (value[n] != "")
        key = F.when(event_type == kind, F.when(whole, text)).otherwise(key)
    return key


def job_key(kind: str, parts: dict[str, Column]) -> Column:
    """``kind:a/b/...``; the parts must be exactly the kind's."""
    names = JOB_KINDS[kind]
    if set(parts) != set(names):
        raise ValueError(f"a {kind} key needs exactly {list(names)}")
    return F.concat(F.lit(f"{kind}:"), F.concat_ws("/", *[parts[n].cast("string") for n in names]))


def backoff_seconds(attempt: Column) -> Column:
    """30 s doubling with every attempt, at most 1800 s."""
    return F.least(F.lit(BACKOFF_FLOOR) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(BACKOFF_CAP))).cast("long")


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds, or an HTTP date less now; null if it is neither, never negative."""
    date = F.try_to_timestamp(F.regexp_extract(header, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(F.trim(header).try_cast("long"), F.unix_seconds(date) - F.unix_seconds(now))
    return F.when(seconds.isNotNull(), F.greatest(seconds, F.lit(0)))


def http_date(moment: Column) -> Column:
    return F.date_format(moment, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def schedule_slot(moment: Column, interval_seconds: int) -> Column:
    return F.floor(F.unix_seconds(moment) / interval_seconds)


def any_date(value: Column) -> Column:
    """Epoch seconds or an ISO date."""
    return F.coalesce(F.timestamp_seconds(value.try_cast("double")), F.try_to_timestamp(value))
