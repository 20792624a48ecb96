"""Captured sources as tables: feeds, sitemaps, API lists, golden samples, blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import content_key
from paperloom.functions.url import normalize_url, path_allowed

ALLOWED = {
    "rss": {"url", "lookback_hours"},
    "atom": {"url", "lookback_hours"},
    "api_list": {"endpoint", "items_path", "fields", "page_size"},
    "html_list": {"url", "item_selector", "page_parameter"},
    "sitemap": {"url", "path_prefixes", "max_items"},
    "page_monitor": {"url"},
}


def check_config(kind: str, config: dict) -> None:
    """Unknown kinds and keys fail."""
    if kind not in ALLOWED:
        raise ValueError(f"unknown source kind {kind!r}")
    if extra := set(config) - ALLOWED[kind]:
        raise ValueError(f"{kind}: unknown keys {sorted(extra)}")


def read_feed(spark: SparkSession, path: str, kind: str = "rss") -> DataFrame:
    """url, title, published of captured RSS or Atom files."""
    if kind == "rss":
        df = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string").load(path)
        at = F.try_to_timestamp(F.regexp_extract("pubDate", r"(\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("dd MMM yyyy HH:mm:ss"))
        return df.select(F.trim("link").alias("url"), F.trim("title").alias("title"), at.alias("published"))
    df = spark.read.format("xml").option("rowTag", "entry").schema("title string, link struct<_href:string,_VALUE:string>, updated string").load(path)
    return df.select(F.col("link._href").alias("url"), F.trim("title").alias("title"), F.try_to_timestamp("updated").alias("published"))


def within_overlap(entries: DataFrame, boundary: Column, hours: int = 72) -> DataFrame:
    """Entries not older than the boundary less the overlap; undated ones stay. The boundary only ever moves back."""
    return entries.filter(F.col("published").isNull() | (F.col("published") >= boundary - F.expr(f"INTERVAL {hours} HOURS")))


def read_sitemap(spark: SparkSession, path: str, prefixes: list[str]) -> DataFrame:
    df = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    d = df.select(F.trim("loc").alias("url"), F.try_to_timestamp("lastmod").alias("published"))
    return d.filter(path_allowed(F.col("url"), prefixes)) if prefixes else d


def api_items(responses: DataFrame, body: str, items_path: str, fields: dict[str, str]) -> DataFrame:
    """One row per item of JSON responses; fields maps names to dot paths, missing ones are null."""
    items = F.from_json(F.get_json_object(body, f"$.{items_path}"), "array<string>")
    d = responses.select(F.explode(items).alias("item"))
    return d.select(*[F.get_json_object("item", f"$.{path}").alias(name) for name, path in fields.items()])


def new_candidates(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Entries whose canonical URL isn't known, one row each."""
    d = entries.withColumn("canonical_url", normalize_url(F.col("url"))).filter("canonical_url is not null")
    return d.dropDuplicates(["canonical_url"]).join(known.select("canonical_url"), "canonical_url", "left_anti")


def read_golden(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(folder)


def write_blobs(blobs: DataFrame, path: str) -> None:
    """Content-addressed: key, media_type, content; equal contents once, also across calls."""
    digest = F.sha2("content", 256)
    out = blobs.select(content_key(digest, F.col("media_type")).alias("key"), "media_type", "content").dropDuplicates(["key"])
    empty = blobs.sparkSession.createDataFrame([], out.schema)
    empty.write.mode("append").parquet(path)  # so that there is something to read
    stored = blobs.sparkSession.read.schema(out.schema).parquet(path).select("key")
    out.join(stored, "key", "left_anti").write.mode("append").parquet(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def classify_fetch(status: Column, content_length: Column, final_url_is_login: Column, visible_chars: Column, scripts: Column, max_bytes: int = 10_000_000) -> Column:
    """captured, no_change, access_denied, error or browser_unavailable (a shell that needs scripts)."""
    return (
        F.when(status == 304, "no_change")
        .when(status.isin(401, 403) | final_url_is_login, "access_denied")
        .when((status >= 400) | (content_length > max_bytes), "error")
        .when((visible_chars < 200) & (scripts >= 1), "browser_unavailable")
        .otherwise("captured")
    )
