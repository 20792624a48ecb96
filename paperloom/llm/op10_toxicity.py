"""Toxicity by multiple-instance learning: sentence scores are trained from document labels.

A document is a bag of sentences. A sentence's score is a logistic function of its words (hashed words and word
beginnings); the document's score is their noisy-or, ``1 - prod(1 - p)``, so one bad sentence is enough and the
labels of documents train the scores of sentences. Scoring also tells the worst sentence and how many offend.

The weights are fitted on at most ``max_labelled`` labelled documents (chosen by a hash of the id), a documented
bound; scoring covers every document and whole texts.

Defined results: a null or empty text has no sentence and scores 0; a null id is never held out from scoring and
never trained on; repeated rows score alike, of a repeated labelled id the smallest text trains; without labelled rows
all weights are 0 and only texts of many sentences pass 0.5; very long texts are scored whole; an empty table gives no
rows; further columns aren't read and can't clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import map_arrow, table

#: Size of the hashed feature space.
DIMENSIONS = 1 << 18
#: At most so many labelled documents are used for fitting.
MAX_LABELLED = 6_000
#: Features tied to the labels by less than this log-likelihood ratio get no weight: a rare word can't be learnt by heart.
LEAST_ASSOCIATION = 15.0
#: Word caches are emptied beyond so many entries.
CACHE = 400_000
BREAK = b"\x01"
FOLDS = 5
PUNCTUATION = b".,;:!?\"'()[]{}|*#$%&<>"
ENDS = (b".", b"!", b"?", b"\x01")


def held_out(doc_id) -> F.Column:
    """True for the fold that is never trained on."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def tokens(text: str) -> list[bytes]:
    return text.lower().replace("\n", " \x01 ").encode().split()


#: A word gives itself and its beginnings of these lengths as features.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
WIDTH = 1 + len(BEGINNINGS)
#: Places of the weight that stays 0 and of the bias.
NONE, BIAS = DIMENSIONS, DIMENSIONS + 1


def features(word: bytes) -> list[int]:
    """Hashed word and beginnings, without punctuation around it; NONE fills up."""
    core = word.strip(PUNCTUATION).decode("utf-8", "ignore")
    if not core or word == BREAK:
        return [NONE] * WIDTH
    starts = [zlib.crc32(f"p{core[:n]}".encode()) % DIMENSIONS if len(core) >= n else NONE for n in BEGINNINGS]
    return [zlib.crc32(f"w{core}".encode()) % DIMENSIONS, *starts]


#: Marks the end of a sentence in a cached weight; far beyond any sum of weights.
_END = float(1 << 20)


class _Weights(dict):
    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > CACHE:
            self.clear()
        value = float(self.weights[features(word)].sum())
        out = self[word] = value + (_END if word.endswith(ENDS) else 0.0)
        return out


def _bags(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Per document: its distinct words, and the word and the sentence of every token, as little-endian int32."""
    words, which, where = [], [], []
    for text in batch.column("text").to_pylist():
        row = tokens(text or "")
        own: dict[bytes, int] = {}
        at = np.array([own.setdefault(w, len(own)) for w in row], np.int32)
        ends = np.array([w.endswith(ENDS) for w in row], bool)
        sentence = np.concatenate([[0], np.cumsum(ends)[:-1]]).astype(np.int32) if row else np.zeros(0, np.int32)
        words.append(b" ".join(own))
        which.append(at.tobytes())
        where.append(sentence.tobytes())
    columns = [pa.array(x, pa.binary()) for x in (words, which, where)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *columns], ["doc_id", "label", "words", "which", "sentence"])


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """doc_id, label, text of at most about ``limit`` labelled documents outside the held-out fold, chosen by hash."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    share = limit / max(1, rows.count())
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # about `limit` rows of two numbers, a documented bound; of a repeated id the smallest text trains
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def _association(seen: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio between a feature's presence in documents and their label."""
    n = np.array([[(y == 0).sum()], [(y > 0).sum()]], float)
    total = n.sum()
    out = np.zeros(seen.shape[1])
    for label_ in (0, 1):
        for count, share in ((seen[label_], seen.sum(0)), (n[label_] - seen[label_], total - seen.sum(0))):
            expected = np.maximum(share * n[label_] / total, 1e-9)
            out += 2 * np.where(count > 0, count * np.log(np.maximum(count, 1e-9) / expected), 0)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_LABELLED, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (and the bias) of the sentence model, by mini-batch gradient steps on the noisy-or likelihood."""
    bags = map_arrow(sample(docs, labels, label, limit), _bags, "doc_id long, label int, words binary, which binary, sentence binary").toPandas().sort_values("doc_id")
    weights = np.zeros(DIMENSIONS + 2)
    weights[BIAS] = -4.0
    if bags.empty:
        return weights
    known: dict[bytes, int] = {}
    own = [np.array([known.setdefault(w, len(known)) for w in words.split()], np.int32) for words in bags.words]
    x = [o[np.frombuffer(b, np.int32)] for o, b in zip(own, bags.which)]
    s = [np.frombuffer(b, np.int32) for b in bags.sentence]
    y = bags.label.to_numpy()
    of_word = np.array([features(w) for w in known] or [[NONE] * WIDTH], np.int32)
    seen = np.zeros((2, DIMENSIONS + 2))
    for o, label_ in zip(own, y):
        seen[int(label_ > 0), np.unique(of_word[o])] += 1
    of_word[_association(seen, y)[of_word] < LEAST_ASSOCIATION] = NONE
    rng, squares = np.random.default_rng(seed), np.full(DIMENSIONS + 2, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for chunk in np.array_split(order, max(1, len(order) // 200)):
            n_sentences = [int(s[i][-1]) + 1 if len(s[i]) else 1 for i in chunk]
            base = np.concatenate([[0], np.cumsum(n_sentences)])
            rows = np.concatenate([s[i] + base[k] for k, i in enumerate(chunk)])
            words, inverse = np.unique(np.concatenate([x[i] for i in chunk]), return_inverse=True)
            z = weights[BIAS] + np.bincount(rows, weights[of_word[words]].sum(1)[inverse], base[-1])
            doc = np.repeat(np.arange(len(chunk)), n_sentences)
            log_none = -np.bincount(doc, np.logaddexp(0, z), len(chunk))
            any_ = np.maximum(-np.expm1(log_none), 1e-9)
            pull = np.where(y[chunk] == 1, -np.exp(log_none) / any_, 1.0)
            dz = pull[doc] * np.exp(-np.logaddexp(0, -z)) / len(chunk)
            per_word = np.bincount(inverse, dz[rows], len(words))
            g = np.bincount(of_word[words].ravel(), np.repeat(per_word, WIDTH), DIMENSIONS + 2)
            g[BIAS] = dz.sum()
            g[:DIMENSIONS] += 1e-4 * weights[:DIMENSIONS]
            g[NONE] = 0
            squares += g * g
            weights -= 0.2 * g / np.sqrt(squares)
    return weights


def score_with(weights: np.ndarray):
    """A batch function: doc_id, score, number of offending sentences, and the worst one (index, words, score)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache, out = _Weights(weights), []
        for text in batch.column("text").to_pylist():
            words = tokens(text or "")
            if not words:
                out.append((0.0, 0, None, None))
                continue
            v = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
            ends = v > _END / 2
            v -= ends * _END
            ends[-1] = True
            stop = np.flatnonzero(ends)
            start = np.concatenate([[0], stop[:-1] + 1])
            z = weights[BIAS] + np.add.reduceat(v, start)
            p = np.exp(-np.logaddexp(0, -z))
            doc = float(-np.expm1(-np.logaddexp(0, z).sum()))
            k = int(z.argmax())
            bad = int((p >= 0.5).sum())
            worst = b" ".join(words[start[k] : stop[k] + 1]).decode() if bad else None
            out.append((doc, bad, worst, float(p[k])))
        score, n, worst, top = zip(*out)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(n, pa.int32()), pa.array(worst, pa.string()), pa.array(top, pa.float64())],
            ["doc_id", "score", "n_offending", "worst_sentence", "worst_score"],
        )

    return run


SCORED = "doc_id long, score double, n_offending int, worst_sentence string, worst_score double"


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Every document's score and its worst sentence (lower case, null if none offends)."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text")), score_with(weights.astype(np.float32)), SCORED)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = score(docs, fit(docs, labels))
    return rows.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_offending",
        "worst_sentence",
    )
