"""Quotes in texts: every non-overlapping span, for given pairs and for many quotes against all texts.

A quote of at least three words holds pairs of neighbouring whole words (its first and last word may be parts of longer
ones in the text). The rarest of its pairs, by one count over the texts, is the key of an equality join: only texts with that pair
are compared with the quote. Quotes without such a pair are few short ones; they go to every task, up to a stated number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many quotes without a pair of whole words; more fail instead of growing what every task holds.
MOST_SHORT = 10_000


def spans(text: Column, quote: Column) -> Column:
    """array<struct<start, end>> of the occurrences that don't overlap, leftmost first, in code points; none for an empty quote."""
    pattern = F.concat(F.lit(r"\Q"), F.replace(quote, F.lit("\\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    size = F.char_length(quote)
    between = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    before = F.slice(between, F.lit(1), F.greatest(F.size(between) - 1, F.lit(0)))
    # each span starts after all gaps up to it and the quotes before it
    found = F.transform(before, lambda gap, i: F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x) + i * size)
    out = F.transform(found, lambda s: F.struct(s.alias("start"), (s + size).alias("end")))
    return F.when((size > 0) & F.contains(text, quote), out).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def locations(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """(claim_id, ordinal, block_id, nth, start, end): all spans of each evidence quote in the block that it names."""
    e = evidence.join(blocks.select("block_id", F.col("text").alias("_block")), "block_id")
    d = e.select("claim_id", "ordinal", "block_id", F.posexplode(spans(F.col("_block"), F.col("quote"))).alias("nth", "s"))
    return d.select("claim_id", "ordinal", "block_id", "nth", "s.start", "s.end")


def word_pairs(words: Column) -> Column:
    """Hashes of neighbouring words; fewer than two words have none."""
    last = F.size(words) - 1
    return F.when(last > 0, F.zip_with(F.slice(words, F.lit(1), last), F.slice(words, F.lit(2), last), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def _words(text: Column) -> Column:
    return F.split(text, " ", -1)


def search(texts: DataFrame, quotes: DataFrame, id_col: str = "doc_id", text_col: str = "text", quote_id: str = "item_id", quote_col: str = "quote") -> DataFrame:
    """(quote id, id, nth, start, end) of every span of every quote in every text.

    Texts are cut into words at blanks only, so a pair of a quote's inner words stands as it is in every text that holds the quote.
    """
    q = quotes.select(F.col(quote_id), F.col(quote_col).alias("_quote")).filter(F.col("_quote") != "")
    parts = _words(F.col("_quote"))
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    q = q.withColumn("_pairs", F.array_distinct(word_pairs(inner))).withColumn("_short", F.size("_pairs") == 0)
    t = texts.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_row"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    asked = q.filter(~F.col("_short")).select(quote_id, "_quote", F.explode("_pairs").alias("_pair"))
    held = t.select("_id", "_row", F.explode(F.array_distinct(word_pairs(_words(F.col("_text"))))).alias("_pair"))
    held = held.join(asked.select("_pair").distinct(), "_pair", "left_semi")
    counts = held.groupBy("_pair").agg(F.count("*").alias("_n"))
    rare = asked.join(counts, "_pair").groupBy(quote_id, "_quote").agg(F.min_by("_pair", F.struct("_n", "_pair")).alias("_pair"), F.count("*").alias("_known"))
    # a quote with a pair that no text has can't occur
    rare = rare.join(q.select(quote_id, "_quote", F.size("_pairs").alias("_all")), [quote_id, "_quote"]).filter(F.col("_known") == F.col("_all"))
    pairs = held.join(rare.select(quote_id, "_quote", "_pair"), "_pair").select(quote_id, "_quote", "_id", "_row")
    same = (F.coalesce(F.col("t._id"), F.col("t._row")) == F.coalesce(F.col("p._id"), F.col("p._row"))) & (F.col("t._row") == F.col("p._row"))
    found = t.alias("t").join(pairs.distinct().alias("p"), same).select(quote_id, "t._id", F.posexplode(spans(F.col("t._text"), F.col("p._quote"))).alias("nth", "s"))
    found = found.select(quote_id, F.col("_id").alias(id_col), "nth", "s.start", "s.end")
    return found.unionByName(_scan(t, q.filter("_short").select(quote_id, "_quote"), id_col, quote_id))


def _scan(t: DataFrame, short: DataFrame, id_col: str, quote_id: str) -> DataFrame:
    """All spans of quotes without a pair, which every task holds."""
    own = [(r[0], r[1]) for r in short.limit(MOST_SHORT + 1).collect()]
    if len(own) > MOST_SHORT:
        raise ValueError(f"more than {MOST_SHORT} quotes of fewer than two inner words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches if own else ():
            rows = []
            for i, text in zip(b.column("_id").to_pylist(), b.column("_text").to_pylist()):
                for quote, words in own:
                    at, nth = text.find(words), 0
                    while at >= 0:
                        rows.append((quote, i, nth, at, at + len(words)))
                        at, nth = text.find(words, at + len(words)), nth + 1
            if rows:
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], [quote_id, id_col, "nth", "start", "end"])

    return t.select(F.col("_id").cast("long"), "_text").mapInArrow(run, f"{quote_id} long, {id_col} long, nth int, start int, end int")
