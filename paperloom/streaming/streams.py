"""Structured Streaming: discovery dedup, slots, late data, and the job state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.queue import TRANSITIONS


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_counts(events: DataFrame, ts: str, key: str, minutes: int = 15, late_hours: int = 72) -> DataFrame:
    """(slot, key, n) per half-open slot; the watermark is the running maximum less late_hours."""
    d = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", f"{late_hours} hours")
    return d.groupBy(F.window("_ts", f"{minutes} minutes").alias("w"), key).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("slot"), key, "n")


def first_seen(events: DataFrame, ts: str, keys: list[str], late_hours: int = 72) -> DataFrame:
    """Each key once while its state lives."""
    d = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", f"{late_hours} hours")
    return d.dropDuplicatesWithinWatermark(keys).drop("_ts")


def fold_states(commands: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """(key, state, applied, refused): each job's commands folded in order from ``queued``; illegal ones are refused.

    commands: key, seq, to_state. The batch twin of the keyed state machine.
    """
    steps = F.transform(F.array_sort(F.collect_list(F.struct("seq", "to_state"))), lambda s: s["to_state"])
    d = commands.groupBy(key).agg(steps.alias("steps"))

    def step(acc: Column, to: Column) -> Column:
        ok = F.lit(False)
        for a, targets in TRANSITIONS.items():
            ok = ok | ((acc["state"] == a) & to.isin(*targets))
        return F.struct(F.when(ok, to).otherwise(acc["state"]).alias("state"), (acc["applied"] + ok.cast("int")).alias("applied"), (acc["refused"] + (~ok).cast("int")).alias("refused"))

    first = F.struct(F.lit("queued").alias("state"), F.lit(0).alias("applied"), F.lit(0).alias("refused"))
    return d.withColumn("r", F.aggregate("steps", first, step)).select(key, "r.state", "r.applied", "r.refused")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a memory table and return it; for tests and small reports."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
