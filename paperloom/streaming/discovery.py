"""Incremental discovery: list pages of a stream become candidates, fetches, runs and boundaries, each poll once and whole.

``DiscoverySink.apply`` is for ``foreachBatch``. Everything a poll changes is written into folders of one attempt, and one
last small write names the attempt as the poll's. Readers take named attempts only: a job that dies between the writes leaves
nothing visible, and a poll that comes again, in whatever batch, is skipped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import records

TABLES = {
    "candidates": "feed_id string, canonical_url string, url string, title string, published timestamp, poll int",
    "fetches": "feed_id string, canonical_url string, epoch int",
    "runs": "feed_id string, poll int, pages int, items long, created long, invalid long, outcome string, before timestamp, after timestamp",
    "boundaries": "feed_id string, at timestamp, poll int",
}
LOG = "poll int, attempt string"


class DiscoverySink:
    def __init__(self, spark: SparkSession, folder: str, hours: int = 72):
        self.spark, self.folder, self.hours = spark, folder.rstrip("/"), hours
        for name, schema in {"log": LOG, **{t: f"{s}, attempt string" for t, s in TABLES.items()}}.items():
            # an empty first part, so that every table can be read
            self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.folder}/{name}")

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/log")

    def read(self, name: str) -> DataFrame:
        """Rows of committed polls."""
        rows = self.spark.read.schema(f"{TABLES[name]}, attempt string").option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}")
        return rows.join(self.log().select("attempt"), "attempt", "left_semi").drop("attempt")

    def boundaries(self) -> DataFrame:
        return self.read("boundaries").groupBy("feed_id").agg(F.max_by("at", "poll").alias("at"))

    def apply(self, entries: DataFrame, batch_id: int) -> None:
        """Polls one after the other, each in one commit; batch_id may repeat or differ after a restart."""
        entries = entries.persist()
        try:
            for poll in sorted(r[0] for r in entries.select("poll").distinct().collect()):  # numbers of a batch's polls
                if not self.log().filter(F.col("poll") == poll).take(1):
                    self._step(entries.filter(F.col("poll") == poll), poll)
        finally:
            entries.unpersist()

    def _step(self, e: DataFrame, poll: int) -> None:
        attempt = uuid.uuid4().hex
        found = e.filter("url is not null")
        before = self.boundaries()
        known = self.read("candidates").select("feed_id", "canonical_url")
        new, after = records.discover(found.select("feed_id", "url", "published"), known, before, "feed_id", self.hours)
        titles = found.groupBy("feed_id", "url").agg(F.min("title").alias("title"))
        new = new.join(titles, ["feed_id", "url"], "left").withColumn("poll", F.lit(poll))
        self._write("candidates", new, attempt)
        written = self.spark.read.schema(TABLES["candidates"]).parquet(f"{self.folder}/candidates/{attempt}")
        # a monitored page is fetched at every poll, everything else once
        always = records.canonical(found.filter("kind = 'page_monitor'")).select("feed_id", "canonical_url").distinct()
        once = written.select("feed_id", "canonical_url").join(always, ["feed_id", "canonical_url"], "left_anti")
        self._write("fetches", once.withColumn("epoch", F.lit(0)).unionByName(always.withColumn("epoch", F.lit(poll))), attempt)
        self._write("boundaries", after.filter("at is not null").withColumn("poll", F.lit(poll)), attempt)
        created = written.groupBy("feed_id").agg(F.count("*").alias("created"))
        bad = records.canonical(found).filter("canonical_url is null").groupBy("feed_id").agg(F.count("*").alias("invalid"))
        runs = e.groupBy("feed_id").agg(F.max("page_no").alias("pages"), F.count("url").alias("items"), F.max_by("exhausted", "page_no").alias("done"))
        runs = runs.join(created, "feed_id", "left").join(bad, "feed_id", "left").join(before.withColumnRenamed("at", "before"), "feed_id", "left").join(after.withColumnRenamed("at", "after"), "feed_id", "left")
        runs = runs.withColumns({"created": F.coalesce("created", F.lit(0)), "invalid": F.coalesce("invalid", F.lit(0)), "poll": F.lit(poll)})
        outcome = F.when(~F.col("done"), "partial").when((F.col("pages") == 1) & (F.col("created") == 0), "no_change").otherwise("success")
        self._write("runs", runs.withColumn("outcome", outcome), attempt)
        self._commit(poll, attempt)

    def _write(self, name: str, rows: DataFrame, attempt: str) -> None:
        schema = self.spark.createDataFrame([], TABLES[name]).schema
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], F.lit(attempt).alias("attempt")).write.parquet(f"{self.folder}/{name}/{attempt}")

    def _commit(self, poll: int, attempt: str) -> None:
        self.spark.createDataFrame([(poll, attempt)], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")


def run(spark: SparkSession, source: str, sink: DiscoverySink, checkpoint: str, **limits: int) -> None:
    """Processes all polls that are there; call it again for later ones."""
    from paperloom.sources.paged import CapturedLists

    spark.dataSource.register(CapturedLists)
    stream = spark.readStream.format("captured_lists").option("path", source).options(**limits).load()
    query = stream.writeStream.foreachBatch(sink.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
