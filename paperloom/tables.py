"""Scoped table access: nothing is read without an owner."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    owner_id: str
    industry_id: str | None = None


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scoped(df: DataFrame, scope: Scope | None) -> DataFrame:
    """Rows of the scope. Without a scope, or without the scope's columns, it fails instead of reading all."""
    if scope is None or not scope.owner_id:
        raise PermissionError("a scope with an owner is required")
    if "owner_id" not in df.columns or (scope.industry_id and "industry_id" not in df.columns):
        raise PermissionError("the table has no scope columns")
    out = df.filter(F.col("owner_id") == scope.owner_id)
    return out.filter(F.col("industry_id") == scope.industry_id) if scope.industry_id else out
