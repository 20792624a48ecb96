"""What the training-data operators share: table access, words, checkpoints, Arrow batches."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are none of the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Null ids sort after all others while documents are compared.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(id_col: str, text_col: str = "text") -> Column:
    """With the id it tells documents apart: 64 bits of the text, and of whether there is an id."""
    return F.xxhash64(F.col(id_col).isNull(), text_of(text_col))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def stretches(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows whose values of a string or binary column have at most so many bytes, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    k, before = 0, 0
    while k < batch.num_rows:
        end = max(k + 1, int(np.searchsorted(size, before + most, "right")))
        yield batch.slice(k, end - k)
        k, before = end, int(size[end - 1])


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, by: str | None = None, most: int = 1 << 20) -> DataFrame:
    """Apply fn to every Arrow batch; fn sees whole rows and holds one batch at a time, or with ``by`` a stretch of it with
    at most so many bytes in that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in stretches(batch, by, most) if by else [batch]:
                if part.num_rows and (out := fn(part)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only in local mode without one (tests) a new temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="paperloom-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished work deleted now: Spark does so once the driver's JVM collects their handles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
