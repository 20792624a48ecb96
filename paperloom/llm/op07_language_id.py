"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined for every document: the likelihood of its character trigrams, the language it
declares, the suffix of its address, and a prior of its host. The languages are those that enough documents declare.
The trigram model, the reliability of declarations, the suffix table and the priors are all grouped aggregations over
every document; the host prior is smoothed towards its suffix's distribution and that one towards the corpus.

A document is rejected if its text has fewer than ``min_letters`` letters, or if no language reaches
``min_posterior``. A document that declares a language which is not modelled, and whose text lies far from every model (its mean
trigram likelihood is far below that of texts which declare the language they resemble), keeps what it declares, with
posterior 1. Without such a declaration, or with a short text, it is given the nearest language modelled.

Suffix and host meet in one table with a row for each host, so documents are joined once, by host. Hosts with a thousandth of all
documents or more, of which there are a thousand at most, are told to every task; only documents of other hosts are shuffled.

Defined results: a null or empty text has no letters and is rejected with language null; a null or unknown
declaration, address or host is evidence of its own category; where no document declares a language all texts with
letters are ``und``; rows pass one to one, repeated rows alike; very long texts are read whole, in slices of bounded
size; on an empty table the result is empty. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut_lineage, table, text_of

BUCKETS = 1 << 15
#: Characters of a text that are looked at together.
SLICE = 1 << 17


@dataclass(frozen=True)
class Config:
    #: The modelled languages; None takes every tag that ``least_share`` of the declaring documents declare.
    languages: tuple[str, ...] | None = None
    #: Bounds the number of languages, and with it what the driver holds, by its inverse.
    least_share: float = 0.005
    #: Trigrams of one text are strongly dependent; it counts as at most so many independent ones.
    most_evidence: float = 60.0
    smoothing: float = 0.5
    #: Pseudo-counts of the level above in the suffix's and the host's distribution.
    prior_strength: float = 20.0
    min_letters: int = 1
    min_posterior: float = 0.5
    #: A text of at least so many trigrams is far from a model that is so many deviations above it.
    far_trigrams: int = 50
    far_deviations: float = 4.0
    #: Hosts with at least this share of the documents are hot.
    hot_share: float = 0.001


@functools.lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """str.isalpha of every code point."""
    return np.fromiter((chr(x).isalpha() for x in range(0x110000)), bool, 0x110000)


def _slices(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Trigram buckets of the lower-case text, white space as one blank, and its letters, in slices of bounded size.

    Slices share their last two characters, so that the buckets are those of the whole text.
    """
    low, before, blank = text.lower(), "", True
    for at in range(0, len(low), SLICE):
        raw = low[at : at + SLICE]
        part = " ".join(raw.split())
        if part:
            part = f"{' ' if blank or raw[0].isspace() else ''}{part}"
            blank = raw[-1].isspace()
        else:
            blank = True
        last = at + SLICE >= len(low)
        c = np.frombuffer(f"{before}{part}{' ' if last and (part or before) else ''}".encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = int(_alphabet()[c[len(before) :]].sum())
        before = f"{before}{part}"[-2:]
        if len(c) < 3:
            yield np.zeros(0, np.int32), letters
            continue
        x = c.astype(np.uint64)
        h = x[:-2] * np.uint64(0x9E3779B97F4A7C15)
        h ^= x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= x[2:] * np.uint64(0x165667B19E3779F9)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h >>= np.uint64(49)
        yield h.astype(np.int32), letters


def declared_language(column: Column) -> Column:
    """The primary tag in lower case, ``none`` if there is none."""
    tag = F.lower(F.regexp_extract(F.coalesce(column.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1))
    return F.when(tag == "", "none").otherwise(tag)


def declared_languages(rows: DataFrame, config: Config) -> tuple[str, ...]:
    """The tags declared often enough, in order; ``und`` alone where nothing is declared."""
    told = rows.filter("declared <> 'none'").groupBy("declared").agg(F.count("*").alias("n"))  # tags of two or three letters
    often = told.join(F.broadcast(told.agg(F.sum("n").alias("all"))), F.col("n") >= config.least_share * F.col("all"))  # one row
    return tuple(sorted(r["declared"] for r in often.collect())) or ("und",)


def address_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def markup_language(html: Column) -> Column:
    """What ``<html lang=...>`` declares."""
    return F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)


def evidence(docs: DataFrame, text: Column | None = None, declared: Column | None = None, url: Column | None = None, host: Column | None = None) -> DataFrame:
    """doc_id, text, declared, suffix, host. Without an address the suffix is empty."""
    from_url = address_host(url) if url is not None else F.lit("")
    return docs.select(
        "doc_id",
        (text if text is not None else text_of()).alias("text"),
        declared_language(declared if declared is not None else F.lit(None)).alias("declared"),
        F.regexp_extract(from_url, r"\.([a-z]{2,})$", 1).alias("suffix"),
        F.coalesce(host, from_url).alias("host") if host is not None else from_url.alias("host"),
    )


def trigram_model(rows: DataFrame, config: Config) -> np.ndarray:
    """log P(bucket | language) of shape (buckets, languages), counted over all documents by what they declare.

    Every task adds up its documents and emits each language's buckets once; what reaches the driver is bounded
    by languages x buckets.
    """
    languages = config.languages

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("declared").to_pylist()):
                own = total[place[lang]]
                for b, _ in _slices(text.as_py()):
                    own += np.bincount(b, minlength=BUCKETS)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[k, b])], ["k", "bucket", "n"])

    known = rows.filter(F.col("declared").isin(*languages)).select("text", "declared")
    counts = known.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.full((BUCKETS, len(languages)), config.smoothing)
    n[counts.bucket.to_numpy(int), counts.k.to_numpy(int)] += counts.n.to_numpy(float)
    return np.log(n / n.sum(0))


def likelihoods(rows: DataFrame, model: np.ndarray, config: Config) -> DataFrame:
    """Adds letters, trigrams, ``fit`` (the best language's mean log likelihood of a trigram), ``ll`` (tempered log
    likelihoods, 0 at the best language) and ``guess`` by the text alone."""
    model32 = model.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ll, letters, sizes, fits = [], [], [], []
            for text in batch.column("text"):
                s, n, size = np.zeros(model32.shape[1]), 0, 0
                for b, own in _slices(text.as_py()):
                    s += model32[b].sum(0, dtype=np.float64)
                    n, size = n + own, size + len(b)
                sizes.append(size)
                fits.append(float(s.max()) / max(1, size))
                s *= min(1.0, config.most_evidence / max(1, size))
                ll.append((s - s.max()).tolist())
                letters.append(n)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "tag", "declared", "suffix", "host")), pa.array(letters, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fits, pa.float64()), pa.array(ll, pa.list_(pa.float64()))],
                ["doc_id", "tag", "declared", "suffix", "host", "letters", "trigrams", "fit", "ll"],
            )

    out = rows.mapInArrow(run, "doc_id long, tag string, declared string, suffix string, host string, letters long, trigrams long, fit double, ll array<double>")
    return out.withColumn("guess", F.expr("int(array_position(ll, 0.0D)) - 1"))


def identify(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, language, posterior, letters, accepted for rows of ``evidence``."""
    config = replace(config, languages=config.languages or declared_languages(rows, config))
    n = len(config.languages)
    modelled = F.col("declared").isin(*config.languages, "none")
    rows = rows.withColumn("tag", F.col("declared")).withColumn("declared", F.when(modelled, F.col("declared")).otherwise("other"))
    scored = cut_lineage(likelihoods(rows, trigram_model(rows, config), config))
    told = scored.filter(F.col("letters") >= config.min_letters)
    # bounded: declarations are the modelled languages, other and none
    seen = told.groupBy("declared", "guess").agg(F.count("*").alias("n")).collect()
    confusion: dict[str, np.ndarray] = {d: np.ones(n) for d in (*config.languages, "other", "none")}
    for r in seen:
        confusion[r["declared"]][r["guess"]] += r["n"]
    total = sum(confusion.values())
    says = F.create_map(*[x for d, c in confusion.items() for x in (F.lit(d), F.array(*[F.lit(float(v)) for v in np.log(c / total)]))])
    corpus = F.array(*[F.lit(float(v)) for v in total / total.sum()])

    def smoothed(counts: Column, above: Column) -> Column:
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + config.prior_strength
        return F.transform(counts, lambda x, i: (x + config.prior_strength * above[i]) / size)

    # a row for each host; the suffixes' counts are sums of these
    places = [f"c{k}" for k in range(n)]
    by_place = cut_lineage(told.groupBy("suffix", "host").agg(*[F.sum((F.col("guess") == k).cast("double")).alias(c) for k, c in enumerate(places)], F.count("*").alias("size")))
    summed = lambda key, name: by_place.groupBy(key).agg(F.array(*[F.sum(c) for c in places]).alias(name))
    hosts = by_place.select("suffix", "host", "size").join(summed("suffix", "by_suffix"), "suffix").join(summed("host", "by_host"), "host")
    hosts = hosts.select("suffix", "host", smoothed(F.col("by_host"), smoothed(F.col("by_suffix"), corpus)).alias("prior"), "size")
    hosts = cut_lineage(hosts)
    documents = told.count()
    hot = hosts.filter(F.col("size") >= max(2.0, config.hot_share * documents)).drop("size")
    told_hot = scored.join(F.broadcast(hot), ["suffix", "host"], "left")  # a bounded number of hosts
    rest = hosts.drop("size").withColumnRenamed("prior", "own_prior")
    cold = told_hot.filter("prior is null").drop("prior").join(rest, ["suffix", "host"], "left").withColumn("prior", F.coalesce("own_prior", corpus)).drop("own_prior")
    d = told_hot.filter("prior is not null").unionByName(cold)
    d = d.withColumn("said", says[F.col("declared")])
    # log posterior: the host's prior already holds its suffix's, so that evidence counts once
    joint = F.transform("ll", lambda x, i: x + F.log(F.col("prior")[i]) + F.col("said")[i])
    d = d.withColumn("joint", joint).withColumn("top", F.array_max("joint"))
    best = F.array_position("joint", F.col("top")).cast("int")
    posterior = 1 / F.aggregate("joint", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    enough = F.col("letters") >= config.min_letters
    names = F.array(*[F.lit(x) for x in config.languages])
    # how texts fit that declare what they resemble; one row a language
    typical = told.filter((F.col("trigrams") >= config.far_trigrams) & (F.col("declared") == F.element_at(names, F.col("guess") + 1)))
    least = [-float("inf")] * n
    for r in typical.groupBy("guess").agg(F.avg("fit").alias("mean"), F.stddev_pop("fit").alias("spread")).collect():
        least[r["guess"]] = r["mean"] - config.far_deviations * max(r["spread"], 0.05)
    far = enough & (F.col("declared") == "other") & (F.col("trigrams") >= config.far_trigrams) & (F.col("fit") < F.array(*[F.lit(x) for x in least])[F.col("guess")])
    found = F.when(far, F.col("tag")).when(enough, F.element_at(names, best))
    d = d.select("doc_id", "letters", found.alias("language"), F.when(far, 1.0).when(enough, posterior).otherwise(0.0).alias("posterior"))
    return d.withColumn("accepted", enough & (F.col("posterior") >= config.min_posterior))


def documents_evidence(docs: DataFrame) -> DataFrame:
    """The corpus table: ``lang`` is what a document declares, ``source`` stands for its host."""
    return evidence(docs, declared=F.col("lang"), host=F.coalesce(F.col("source"), F.lit("")))


def pages_evidence(pages: DataFrame) -> DataFrame:
    """Raw pages: the markup declares the language, the address gives suffix and host."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return evidence(pages.withColumn("doc_id", F.col("page_id")), text=text, declared=markup_language(F.col("html")), url=F.col("url"))


def query(spark, sf_dir: str) -> DataFrame:
    return identify(documents_evidence(table(spark, sf_dir, "documents")))


def pages_query(spark, sf_dir: str) -> DataFrame:
    """All pages: what the markup declares, the address suffix and the host's prior all act."""
    found = identify(pages_evidence(table(spark, sf_dir, "pages")))
    return found.select(F.col("doc_id").alias("page_id"), "language", "posterior", "letters", "accepted")
