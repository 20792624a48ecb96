"""The corpus pipeline: documents to packed sequences in five stages.

Every stage takes the columns of ``documents`` (doc_id, text, lang, source, n_chars) and, but for the last, returns
them; further columns of its input are dropped. Each works on all rows its predecessor kept.

Defined results, of every stage: an empty table gives an empty one; nulls in any column pass (a null text is an empty
one, which language identification rejects); ids may be missing or repeated, rows are judged by what they hold, and of
rows equal in id and shingle set near-dedup keeps one; ties go to the smallest id, then to the smallest text hash;
texts of any length are taken whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import op03_packing, op04_minhash, op06_substring, op07_language_id, op09_secret_scan
from paperloom.llm.common import LAST_ID, cut_lineage, row_key, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Language models, sets and packings have no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long")
    )


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification accepts; ``lang`` becomes the language found."""
    d = _documents(docs)
    # what decides is hashed in place of the id, which may be missing or repeated; equal rows are judged alike
    decides = [F.col(c) for c in ("doc_id", "text", "lang", "source")]
    d = d.withColumn("_key", F.xxhash64(*[c.isNull() for c in decides], *decides))
    found = op07_language_id.identify(op07_language_id.documents_evidence(d.withColumn("doc_id", F.col("_key")))).filter("accepted")
    found = found.groupBy(F.col("doc_id").alias("_key")).agg(F.first("language").alias("_lang"))
    return d.join(found, "_key").select("doc_id", "text", F.col("_lang").alias("lang"), "source", "n_chars")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates; of rows equal in id and shingle set one."""
    d = _documents(docs).withColumns({"_id": F.coalesce("doc_id", F.lit(LAST_ID)), "_row": row_key("doc_id")})
    kept = op04_minhash.resolve(d).filter("kept").groupBy(F.col("id").alias("_id"), "digest").agg(F.min("row").alias("_row"))
    return d.join(kept.hint("merge"), ["_id", "_row"], "left_semi").dropDuplicates(["_id", "_row"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier; documents of which nothing is left go."""
    d = op06_substring.remove_duplicates(_documents(docs).withColumn("_had", F.length("text")))
    had = F.coalesce(F.col("_had"), F.lit(0))
    left = F.coalesce(F.length("text"), F.lit(0))
    n_chars = F.when(left == had, F.col("n_chars")).otherwise(left.cast("long"))
    return d.filter((left > 0) | (had == 0)).select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by their kind in brackets."""
    d = op09_secret_scan.redact(_documents(docs))
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return d.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    return op03_packing.pack(_documents(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def _delete(spark: SparkSession, folder: str) -> None:
    """Remove a stage's rows once the next stage's are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    cut_lineage(spark.range(0))  # sets the shared folder where the session has none
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            _delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
