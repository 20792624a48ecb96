"""Quality classifier by co-training of two views.

The content view sees the text only: the shapes of its tokens (letters, capitals, digits and symbols, runs shortened)
and their repetition. The metadata view sees what a page tells about itself and no text: source, declared language and
declared length. Each view is a logistic regression. In every round each view labels the documents that have no label;
those it is confident of for the first time leave the pool and teach the other view. Confidence is calibrated, in every
round, on labelled documents that train neither view: a view that tells nothing teaches nothing. At the end the views are
calibrated together on these documents, and added up to score every document.

The pool is every unlabelled document. What it teaches reaches the driver as sums: the gradient and the curvature of the
content view's loss, for one step a round, and counts by category for the metadata view; both are bounded by the
number of features. Only the labelled rows that
fit the views are bounded (``max_labelled``, chosen by a hash of the id). Features are stored once; a round reads them.
In which round a document was taught is told by the views of the rounds before, so nothing is kept per document.

Defined results: null or empty texts have a zero content view and are scored by the rest; null metadata is a category of
its own; rows that repeat a labelled id train once; without labels of both classes every document scores 0.5; very
long texts are read whole; rows pass one to one; an empty table gives none; further columns aren't read and can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut_lineage, map_arrow, table
from paperloom.llm.op10_toxicity import held_out

CONTENT, META = 128, 256
#: Places of sources, languages and lengths in the metadata view: it has at most their product of categories.
SOURCES, LANGUAGES = 100, 56
MAX_LABELLED = 8_000
ROUNDS = 3
#: A view teaches what it holds for this likely.
CONFIDENT = 0.95
#: What all taught documents weigh together, as a share of the labelled ones.
TAUGHT_WEIGHT = 0.3
CACHE = 400_000
_SHAPE = bytes(
    ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256)
)
_LONG_RUN = re.compile(rb"(.)\1{2,}", re.DOTALL)


def shape(word: bytes) -> bytes:
    """Character classes with runs cut to two: ``the###`` is ``aa##``."""
    return _LONG_RUN.sub(rb"\1\1", word.translate(_SHAPE))


class _Shapes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        out = self[word] = zlib.crc32(shape(word)) % (CONTENT - 8)
        return out


def content_view(text: str, shapes: _Shapes) -> np.ndarray:
    words = text.encode().split()
    x = np.zeros(CONTENT, np.float32)
    if words:
        n = len(words)
        counts = np.bincount(np.fromiter(map(shapes.__getitem__, words), np.int64, n), minlength=CONTENT - 8)
        x[: CONTENT - 8] = np.sqrt(counts / n)
        lines = [line for line in text.split("\n") if line.strip()]
        x[CONTENT - 8] = min(n, 200) / 200
        x[CONTENT - 7] = len(set(words)) / n
        x[CONTENT - 6] = 1 - len(set(lines)) / max(1, len(lines))
        triples = set(zip(words, words[1:], words[2:]))
        x[CONTENT - 5] = 1 - len(triples) / max(1, n - 2)
    return x


def meta_view(source, lang, n_chars) -> bytes:
    """The places of source, language and length (as a rounded logarithm) among the view's features."""
    size = 0 if n_chars is None else 1 + int(2 * np.log2(1 + max(0, n_chars)))
    return bytes((zlib.crc32(f"s{source}".encode()) % SOURCES, SOURCES + zlib.crc32(f"l{lang}".encode()) % LANGUAGES, min(META - 1, SOURCES + LANGUAGES + size)))


def one_hot(meta: np.ndarray) -> np.ndarray:
    out = np.zeros((len(meta), META), np.float32)
    out[np.arange(len(meta))[:, None], meta] = 1
    return out


@dataclass
class Views:
    content: np.ndarray
    meta: np.ndarray
    sure: np.ndarray  # slope and bias that calibrate each view's margins

    def margins(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log odds by either view."""
        (a, b), (c, d) = self.sure
        return a * _margin(self.content, content) + b, c * _margin(self.meta, one_hot(meta)) + d


@dataclass
class Model:
    views: Views
    mix: np.ndarray  # weights of the two views' margins, and the bias
    taught: list[tuple[float, float]] = field(default_factory=list)  # documents taught to content and metadata, by round

    def score(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return _logistic(self.mix[0] * _margin(self.views.content, content) + self.mix[1] * _margin(self.views.meta, one_hot(meta)) + self.mix[2])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _margin(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)


def _regress(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 12) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x = _with_one(x)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        g, h = _curvature(x, y, weight, w, ridge)
        w -= np.linalg.solve(h, g)
    return w


def _curvature(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, ridge: float = 1e-3, bound: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss at w, or the curvature's upper bound for any w."""
    penalty = np.full(len(w), ridge * weight.sum())
    penalty[-1] = 1e-9
    p = _logistic(x @ w)
    h = (x * (weight * (0.25 if bound else p * (1 - p)))[:, None]).T @ x
    h[np.diag_indices_from(h)] += penalty + 1e-6
    return x.T @ (weight * (p - y)) + penalty * w, h


def first_confident(margins: list[np.ndarray]) -> np.ndarray:
    """The label (1, 0) that a view gave a document in the first round it was confident; -1 if in none."""
    least = np.log(CONFIDENT / (1 - CONFIDENT))
    out = np.full(len(margins[0]), -1)
    for m in margins:
        out = np.where((out < 0) & (np.abs(m) >= least), (m > 0).astype(int), out)
    return out


@dataclass
class Lessons:
    """What unlabelled documents teach: for the content view the documents, the gradient and the bound of the curvature of their loss;
    for the metadata view counts by (category, label)."""

    n: float
    gradient: np.ndarray
    curvature: np.ndarray
    counts: dict[tuple[int, int], int]


def lessons(content: np.ndarray, meta: np.ndarray, rounds: list[Views]) -> Lessons:
    """What these unlabelled documents teach after the rounds so far."""
    both = [v.margins(content, meta) for v in rounds]
    by_content, by_meta = first_confident([m[0] for m in both]), first_confident([m[1] for m in both])
    told = by_meta >= 0
    x = _with_one(content[told])
    p = _logistic(x @ rounds[-1].content)
    sure = by_content >= 0
    category = (meta[sure].astype(np.int64) << np.array([16, 8, 0])).sum(1)
    keys, n = np.unique(np.stack([category, by_content[sure]], 1), axis=0, return_counts=True)
    counts = {(int(c), int(label)): int(k) for (c, label), k in zip(keys, n)}
    return Lessons(float(told.sum()), x.T @ (p - by_meta[told]), x.T @ x / 4, counts)


def co_train(content: np.ndarray, meta: np.ndarray, y: np.ndarray, teach, rounds: int = ROUNDS) -> Model:
    """y is 0 or 1; teach(views of all rounds so far) gives the pool's lessons. A quarter of the rows only calibrates."""
    if len(y) < 8 or y.min() == y.max():
        return Model(Views(np.zeros(CONTENT + 1), np.zeros(META + 1), np.zeros((2, 2))), np.zeros(3))
    hold = np.arange(len(y)) % 4 == 3
    x, m, t = content[~hold], one_hot(meta[~hold]), y[~hold]
    ones = np.ones(len(t))

    def calibrated(c: np.ndarray, d: np.ndarray) -> Views:
        return Views(c, d, np.stack([_regress(z[:, None], y[hold], np.ones(hold.sum())) for z in (_margin(c, content[hold]), _margin(d, one_hot(meta[hold])))]))

    views, taught = [calibrated(_regress(x, t, ones), _regress(m, t, ones))], []
    for _ in range(rounds):
        told = teach(views)
        counts, total = told.counts, sum(told.counts.values())
        taught.append((told.n, float(total)))
        if not told.n and not total:
            break
        # content: one step over labelled and taught rows; by the bound of the curvature, so that it can't overshoot
        w = views[-1].content
        g, h = _curvature(_with_one(x), t, ones, w, bound=True)
        each = min(1.0, TAUGHT_WEIGHT * len(t) / max(1.0, told.n))
        w = w - np.linalg.solve(h + each * told.curvature, g + each * told.gradient)
        # metadata: counted categories are rows with weights
        each = min(1.0, TAUGHT_WEIGHT * len(t) / max(1, total))
        keys = np.array([[c >> 16, c >> 8 & 255, c & 255] for c, _ in counts], np.int64).reshape(-1, 3)
        labels, weight = np.array([label for _, label in counts]), each * np.array(list(counts.values()), float)
        views.append(calibrated(w, _regress(np.vstack([m, one_hot(keys)]), np.concatenate([t, labels]), np.concatenate([ones, weight]))))
    last = views[-1]
    margins = np.stack([_margin(last.content, content[hold]), _margin(last.meta, one_hot(meta[hold]))], 1)
    return Model(last, _regress(margins, y[hold], np.ones(hold.sum())), taught)


# --- Spark --------------------------------------------------------------------------------------------------------


def features(docs: DataFrame) -> DataFrame:
    """doc_id, content (compressed), meta: both views of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shapes, press = _Shapes(), zstandard.ZstdCompressor(level=1)
        columns = [batch.column(c) for c in ("text", "source", "lang", "n_chars")]
        a = [press.compress(content_view(t.as_py() or "", shapes).astype(np.float16).tobytes()) for t in columns[0]]
        b = [meta_view(s, n, k) for s, n, k in zip(*(c.to_pylist() for c in columns[1:]))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["doc_id", "content", "meta"])

    needed = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    return map_arrow(needed, run, "doc_id long, content binary, meta binary")


def _read(content: list[bytes], meta: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    z = zstandard.ZstdDecompressor()
    c = np.frombuffer(b"".join(map(z.decompress, content)), np.float16).reshape(-1, CONTENT).astype(np.float32)
    return c, np.frombuffer(b"".join(meta), np.uint8).reshape(-1, 3)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k in range(0, batch.num_rows, 512):
        part = batch.slice(k, 512)
        yield _read(part.column("content").to_pylist(), part.column("meta").to_pylist())


def pool_lessons(pool: DataFrame, rounds: list[Views]) -> Lessons:
    """``lessons`` of a whole pool of features: every task adds up its own, sums meet by feature or category."""
    size = CONTENT + 1
    upper = np.triu_indices(size)  # the curvature is symmetric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(1 + size + len(upper[0])), {}
        for batch in batches:
            for content, meta in _slices(batch):
                own = lessons(content, meta, rounds)
                sums += np.concatenate([[own.n], own.gradient, own.curvature[upper]])
                for key, many in own.counts.items():
                    counts[key] = counts.get(key, 0) + many
        at = np.flatnonzero(sums)
        keys = [*at.tolist(), *(1 << 32 | c << 1 | label for c, label in counts)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([*sums[at].tolist(), *map(float, counts.values())], pa.float64())], ["key", "value"])

    got = pool.select("content", "meta").mapInArrow(run, "key long, value double").groupBy("key").agg(F.sum("value").alias("value")).collect()
    sums, counts, curvature = np.zeros(1 + size + len(upper[0])), {}, np.zeros((size, size))
    for r in got:
        if r["key"] >> 32:
            c = r["key"] & 0xFFFFFFFF
            counts[c >> 1, c & 1] = int(r["value"])
        else:
            sums[r["key"]] = r["value"]
    curvature[upper] = curvature.T[upper] = sums[1 + size :]
    return Lessons(float(sums[0]), sums[1 : 1 + size], curvature, dict(sorted(counts.items())))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and the stored features of all documents (doc_id, label, content, meta)."""
    told = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    stored = cut_lineage(features(docs).join(told, "doc_id", "left").select("doc_id", "label", "content", "meta"))
    usable = stored.filter(F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    share = max_labelled / max(1, told.filter(~held_out(F.col("doc_id"))).count())
    if share < 1:
        usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = usable.groupBy("doc_id").agg(F.max("label").alias("label"), F.min(F.struct("content", "meta")).alias("v")).select("doc_id", "label", "v.*").toPandas().sort_values("doc_id")
    pool = stored.filter("label is null")
    content, meta = _read(rows.content.tolist(), rows.meta.tolist())
    return co_train(content, meta, rows.label.to_numpy(int), lambda views: pool_lessons(pool, views), rounds), stored


def score(stored: DataFrame, model: Model) -> DataFrame:
    """doc_id, the calibrated score, and the margins of both views, from stored features."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [np.stack([model.score(c, m), _margin(model.views.content, c), _margin(model.views.meta, one_hot(m))]) for c, m in _slices(batch)]
        x = np.hstack(out).astype(np.float64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v) for v in x]], ["doc_id", "score", "content_margin", "meta_margin"])

    return map_arrow(stored.select("doc_id", "content", "meta"), run, "doc_id long, score double, content_margin double, meta_margin double")


def query(spark, sf_dir: str) -> DataFrame:
    model, stored = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score(stored, model).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        "content_margin",
        "meta_margin",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        (F.col("score") >= 0.5).alias("kept"),
    )
