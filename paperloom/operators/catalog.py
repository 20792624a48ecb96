"""Feeds, entities, settings, watches, reports and timelines of the document application, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.identity import component
from paperloom.functions.url import normalize_url


def create_feeds(commands: DataFrame, templates: DataFrame, parsers: DataFrame, feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new feeds, outcomes) of commands (seq, seed_url, adapter_type, template_id, credential_ref, interval_seconds), in order of seq.

    A feed's seed is canonical, its parser the newest published one of its adapter, and its scope ``public`` or its
    credential's; seed and scope are unique. The first check that fails names the outcome: invalid_url, template_missing,
    parser_unavailable, already_exists (in feeds, or by an earlier command that succeeds), else created.

    templates: template_id; parsers: parser_version_id, adapter_type, version, published; feeds: seed_url, access_scope_key.
    """
    newest = parsers.filter("published").groupBy("adapter_type").agg(F.max_by("parser_version_id", F.struct("version", "parser_version_id")).alias("parser_version_id"))
    d = commands.withColumn("canonical", normalize_url(F.col("seed_url")))
    d = d.withColumn("access_scope_key", F.when(F.col("credential_ref").isNull(), "public").otherwise(F.concat(F.lit("credential:"), F.col("credential_ref"))))
    d = d.join(templates.select("template_id").distinct().withColumn("_template", F.lit(1)), "template_id", "left").join(newest, "adapter_type", "left")
    taken = feeds.select(F.col("seed_url").alias("canonical"), "access_scope_key").distinct().withColumn("_taken", F.lit(1))
    d = d.join(taken, ["canonical", "access_scope_key"], "left")
    failed = (
        F.when(F.col("canonical").isNull(), "invalid_url")
        .when(F.col("template_id").isNotNull() & F.col("_template").isNull(), "template_missing")
        .when(F.col("parser_version_id").isNull(), "parser_unavailable")
        .when(F.col("_taken").isNotNull(), "already_exists")
    )
    first = F.row_number().over(Window.partitionBy("canonical", "access_scope_key").orderBy(F.col("_failed").isNotNull(), "seq"))
    d = d.withColumn("_failed", failed).withColumn("_n", first)
    d = d.withColumn("outcome", F.coalesce("_failed", F.when(F.col("_n") > 1, "already_exists"), F.lit("created")))
    new = d.filter("outcome = 'created'").select("seq", F.col("canonical").alias("seed_url"), "adapter_type", "template_id", "access_scope_key", "parser_version_id", "interval_seconds", F.lit("active").alias("status"))
    return new, d.select("seq", "outcome")


def entity_aliases(aliases: DataFrame) -> DataFrame:
    """(entity_id, normalized_alias, alias, language) of aliases (entity_id, alias, language, seq): the first of each entity and case-folded alias."""
    d = aliases.withColumn("normalized_alias", component(F.col("alias"))).filter("normalized_alias <> ''")
    w = Window.partitionBy("entity_id", "normalized_alias").orderBy("seq")
    return d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("entity_id", "normalized_alias", "alias", "language")


def entities_named(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """(name_id, entity_id) for names (name_id, name) by equal case-folded aliases; a name may be several entities'."""
    n = names.select("name_id", component(F.col("name")).alias("normalized_alias")).filter("normalized_alias <> ''")
    # a name id has one set of aliases, and each set its entities once, so the pairs need no distinct
    n = n.groupBy("name_id").agg(F.array_sort(F.collect_set("normalized_alias")).alias("own"))
    known = aliases.select("entity_id", "normalized_alias").distinct()
    sets = n.select("own").distinct().select("own", F.explode("own").alias("normalized_alias")).join(known, "normalized_alias")
    sets = sets.groupBy("own").agg(F.collect_set("entity_id").alias("entities"))
    return n.join(sets, "own").select("name_id", F.explode("entities").alias("entity_id"))


def due_watches(watches: DataFrame, industries: DataFrame, now: Column) -> DataFrame:
    """Watches of active industries that are due: enabled, and never checked or checked an interval ago.

    watches: watch_id, industry_id, enabled, checked_at, interval_seconds; industries: industry_id (its key), status. Each watch meets its
    one industry.
    """
    active = industries.filter("status = 'active'").select("industry_id")
    waits = F.col("checked_at").isNull() | (F.unix_seconds(now) - F.unix_seconds("checked_at") >= F.col("interval_seconds"))
    return watches.filter(F.col("enabled") & waits).join(active, "industry_id").select("watch_id", "industry_id")


def settings_of(rows: DataFrame, settings: DataFrame, key: str, defaults: dict[str, int]) -> DataFrame:
    """rows with a column for each setting of their owner (settings: key, values as JSON); a missing, malformed or
    negative number is the default, and so is everything of an owner without settings."""
    s = settings.select(key, F.col("values").alias("_values"))
    d = rows.join(s, key, "left")
    for name, default in defaults.items():
        value = F.get_json_object("_values", f"$.{name}").try_cast("int")
        d = d.withColumn(name, F.when(value >= 0, value).otherwise(F.lit(default)))
    return d.drop("_values")


def local_days(industries: DataFrame, users: DataFrame, moment: Column) -> DataFrame:
    """(industry_id, user_id, local_hour, local_date) of every industry at a moment, on its user's wall (industries: industry_id, user_id;
    users: user_id, timezone; an unknown user's is UTC)."""
    d = industries.join(users, "user_id", "left")
    local = F.from_utc_timestamp(moment, F.coalesce("timezone", F.lit("UTC")))
    return d.select("industry_id", "user_id", F.hour(local).alias("local_hour"), F.date_format(local, "yyyy-MM-dd").alias("local_date"))


def merge_groups(keyed: DataFrame, id_col: str = "event_id") -> DataFrame:
    """(id, into_id): events whose identity keys are equal merge into the one with the smallest id; rows without a key never do.

    Every member is paired with its group's first, so a group of n gives n - 1 rows, not n * n.
    """
    d = keyed.filter("event_key is not null")
    first = d.groupBy("event_key").agg(F.min(id_col).alias("into_id"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return d.join(first, "event_key").filter(F.col(id_col) != F.col("into_id")).select(id_col, "into_id")


def compose_reports(statements: DataFrame, packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept statements, compositions) of statements (report_id, section, ordinal, text, citations).

    A statement is kept if it cites something, and all that it cites is in the report's packet (report_id, citation_id). compositions:
    report_id, total, cited, coverage (1.0 without statements), unsupported (texts in order), publishable.
    """
    key = ["report_id", "section", "ordinal"]
    each = statements.select(*key, F.explode(F.array_distinct("citations")).alias("citation_id"))
    ok = each.join(packets.select("report_id", "citation_id").distinct().withColumn("_in", F.lit(1)), ["report_id", "citation_id"], "left")
    ok = ok.groupBy(*key).agg((F.count("*") == F.count("_in")).alias("_supported"))
    d = statements.join(ok, key, "left").withColumn("_supported", F.coalesce("_supported", F.lit(False)))
    unsupported = F.transform(F.array_sort(F.collect_list(F.when(~F.col("_supported"), F.struct("section", "ordinal", "text")))), lambda x: x["text"])
    c = d.groupBy("report_id").agg(F.count("*").alias("total"), F.count(F.when(F.col("_supported"), 1)).alias("cited"), unsupported.alias("unsupported"))
    every = packets.select("report_id").union(statements.select("report_id")).distinct().join(c, "report_id", "left")
    every = every.select("report_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("cited", F.lit(0)).alias("cited"), F.coalesce("unsupported", F.array().cast("array<string>")).alias("unsupported"))
    coverage = F.when(F.col("total") == 0, 1.0).otherwise(F.col("cited") / F.col("total"))
    return d.filter("_supported").drop("_supported"), every.withColumn("coverage", coverage).withColumn("publishable", F.col("cited") == F.col("total"))


def timeline_order(events: DataFrame, axis: str) -> DataFrame:
    """Adds group_no and sort_key: on the ``occurrence`` axis known starts first, then unknown ones; on the ``discovery`` axis
    everything by when it was discovered. events: precision, start, discovered_at. Ties go by the event's id."""
    if axis not in ("occurrence", "discovery"):
        raise ValueError(f"unknown axis {axis!r}")
    if axis == "discovery":
        return events.withColumns({"group_no": F.lit(0), "sort_key": F.unix_micros(F.col("discovered_at").cast("timestamp"))})
    known = (F.col("precision") != "unknown") & F.col("start").isNotNull()
    return events.withColumns({"group_no": F.when(known, 0).otherwise(1), "sort_key": F.when(known, F.unix_micros(F.col("start").cast("timestamp")))})


def vector_literal(vector: Column) -> Column:
    """``[0.1,0.2]``; null for a missing vector."""
    return F.when(vector.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("double").cast("string")), ","), F.lit("]")))


def shown_score(raw: Column) -> Column:
    """A distance-like score, where less is better, as one where more is better; no negative zero."""
    return -raw + 0.0
