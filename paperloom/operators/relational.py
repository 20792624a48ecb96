"""Keyed tables without row locks: upserts, versions, latest rows, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Incoming rows that are new, the first of each key. A key with a null never conflicts, as in SQL."""
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    keyed, free = incoming.filter(whole), incoming.filter(~whole)
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
    return first.join(existing.select(*key), key, "left_anti").select(incoming.columns).unionByName(free)


def upsert(existing: DataFrame, changes: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Changes win; row_version goes up by one, from 1 for new rows. changes has one row per key."""
    a, b = existing.alias("a"), changes.select(*key, *values, F.lit(True).alias("_new")).alias("b")
    d = a.join(b, key, "full_outer")
    new = F.col("b._new").isNotNull()
    return d.select(
        *key,
        *[F.when(new, F.col(f"b.{v}")).otherwise(F.col(f"a.{v}")).alias(v) for v in values],
        (F.coalesce(F.col("a.row_version"), F.lit(0)) + F.when(new, 1).otherwise(0)).cast("long").alias("row_version"),
    )


def versioned_update(existing: DataFrame, commands: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(applied rows, conflicts): a command applies only where expected_version is the row's version."""
    c = commands.select(key, F.col(value).alias("_value"), "expected_version")
    d = existing.join(c, key)
    applied = d.filter("row_version = expected_version").select(key, F.col("_value").alias(value), (F.col("row_version") + 1).alias("row_version"))
    conflicts = d.filter("row_version <> expected_version").select(key, "row_version", "expected_version")
    return applied, conflicts


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def first_by(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """As latest(), by one aggregation without a sort: the row with the largest order per key."""
    rest = F.struct(*[c for c in df.columns if c not in key])
    return df.groupBy(*key).agg(F.max_by(rest, order).alias("r")).select(*key, "r.*")


def exists_flag(df: DataFrame, other: DataFrame, key: list[str], name: str) -> DataFrame:
    """Adds whether other has the key; a row is never doubled."""
    seen = other.select(*key).distinct().withColumn("_seen", F.lit(True))
    return df.join(seen, key, "left").withColumn(name, F.col("_seen").isNotNull()).drop("_seen")


def page_after(df: DataFrame, order: list[tuple[str, bool]], after: tuple | None, limit: int) -> DataFrame:
    """Keyset page: rows strictly after the last one seen, in the order (column, ascending), nulls last."""
    if after is not None:
        beyond: Column = F.lit(False)
        same: Column = F.lit(True)
        for (name, ascending), value in zip(order, after):
            c = F.col(name)
            if value is None:
                step = F.lit(False)
            else:
                step = ((c > F.lit(value)) if ascending else (c < F.lit(value))) | c.isNull()
            beyond = beyond | (same & F.coalesce(step, F.lit(False)))
            same = same & c.eqNullSafe(F.lit(value))
        df = df.filter(beyond)
    return df.orderBy(*[F.asc_nulls_last(n) if a else F.desc_nulls_last(n) for n, a in order]).limit(limit)


def transition(rows: DataFrame, commands: DataFrame, legal: list[tuple[str, str, str]], key: str, state: str) -> DataFrame:
    """(key, state, ok): the state after each command; an illegal one leaves it. legal: (from, command, to)."""
    table = rows.sparkSession.createDataFrame(legal, "from_state string, command string, to_state string")
    d = rows.join(commands, key).join(F.broadcast(table), (F.col(state) == F.col("from_state")) & (commands["command"] == table["command"]), "left")
    return d.select(key, F.coalesce("to_state", state).alias(state), F.col("to_state").isNotNull().alias("ok"))


def replay_guard(requests: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """(request_id, outcome): replay the stored response, conflict on another body, or miss (also when expired)."""
    key = ["owner_id", "route", "idempotency_key"]
    s = stored.select(*key, F.col("body_hash").alias("_hash"), F.col("expires_at").alias("_until"))
    d = requests.join(s, key, "left")
    live = F.col("_hash").isNotNull() & (F.col("_until") > now)
    return d.select("request_id", F.when(~F.coalesce(live, F.lit(False)), "miss").when(F.col("_hash") == F.col("body_hash"), "replay").otherwise("conflict").alias("outcome"))
