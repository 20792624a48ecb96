"""An approximate index for nearest neighbours: coarse cells, lists of residual codes, exact rescoring, and its gate.

``VectorIndex.build`` fits the cells on a bounded sample and files every vector under its nearest cell, as a one-byte code
for each dimension of what remains. ``search`` reads only the lists of a query's nearest cells, keeps the best by code, and
ranks these by their exact distances. ``calibrate`` doubles the number of cells that are read until the recall of a sample of
queries passes the gate; ``choose`` is the switch: the index answers only if it passes, the exact search otherwise.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators import retrieval
from paperloom.session import shared_folder

#: An approximate generation answers only if it finds this share of the exact neighbours.
GATE = 0.98
#: Cells are fitted on about so many vectors; there are at most so many cells.
SAMPLE, MOST_CELLS = 20_000, 1_024
#: Vectors of a stored block, and queries that meet it at once.
BLOCK, QUERIES = 4_096, 256
_NO_ID = 2**63 - 1


def _rows(d: DataFrame, id_col: str, column: str) -> DataFrame:
    """id, row, v of the rows that have a vector with a direction; row tells vectors of one id apart."""
    v = F.col(column).cast("array<double>")
    d = d.filter(F.col(column).isNotNull() & F.exists(v, lambda x: x != 0))
    return d.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(column).alias("row"), v.alias("v"))


def _units(column: pa.Array) -> np.ndarray:
    v = np.stack(column.to_numpy(zero_copy_only=False))
    return v / np.sqrt((v * v).sum(1))[:, None]


def _nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every vector and its cosine, some rows at a time: the driver holds no matrix of all pairs."""
    own, fit = np.zeros(len(v), np.int64), np.zeros(len(v))
    for at in range(0, len(v), QUERIES):
        near = v[at : at + QUERIES] @ centres.T
        own[at : at + QUERIES], fit[at : at + QUERIES] = near.argmax(1), near.max(1)
    return own, fit


def fit_cells(v: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means; an empty cell moves to the vector that fits its own worst."""
    random = np.random.default_rng(seed)
    centres = v[random.choice(len(v), min(cells, len(v)), replace=False)]
    for _ in range(rounds):
        own, fit = _nearest(v, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        length = np.sqrt((sums * sums).sum(1))
        worst = iter(np.argsort(fit))
        for cell in np.flatnonzero(length == 0):
            sums[cell], length[cell] = v[next(worst)], 1
        centres = sums / length[:, None]
    return centres


@dataclass
class VectorIndex:
    vectors: DataFrame
    id_col: str
    column: str
    path: str
    centres: np.ndarray
    scale: np.ndarray
    probes: int

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", cells: int | None = None, folder: str | None = None) -> VectorIndex:
        """Files every vector. The sample (about ``SAMPLE`` rows, by a hash) only decides where the cells lie."""
        spark = vectors.sparkSession
        rows = _rows(vectors, id_col, column)
        n = rows.count()
        share = min(1.0, SAMPLE / max(1, n))
        some = rows.filter(F.pmod(F.xxhash64("id", "row"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("v").toArrow()
        path = f"{folder or shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
        if some.num_rows:
            v = _units(some.column("v").combine_chunks())
            centres = fit_cells(v, cells or max(1, min(MOST_CELLS, round(math.sqrt(n)))))
            scale = np.maximum(np.abs(v - centres[_nearest(v, centres)[0]]).max(0), 1e-9) / 127
        else:
            centres, scale = np.zeros((0, 0)), np.zeros(0)
        index = cls(vectors, id_col, column, path, centres, scale, max(1, len(centres) // 8))
        if len(centres):
            index._file(rows, n)
        return index

    def _file(self, rows: DataFrame, n: int) -> None:
        centres, scale = self.centres, self.scale

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = _units(b.column("v"))
                    cell = (v @ centres.T).argmax(1)
                    codes = np.clip(np.rint((v - centres[cell]) / scale), -127, 127).astype(np.int8)
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column("id"), b.column("row"), pa.array([c.tobytes() for c in codes], pa.binary())], ["cell", "id", "row", "code"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = b.column("cell").to_numpy()
                edges = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
                for lo, hi in zip(edges, edges[1:]):
                    for at in range(lo, hi, BLOCK):
                        own = b.slice(at, min(BLOCK, hi - at))
                        parts = [own.column(c).to_numpy().tobytes() for c in ("id", "row")] + [b"".join(own.column("code").to_pylist())]
                        yield pa.RecordBatch.from_arrays([pa.array([cell[at]], pa.int32()), *[pa.array([x], pa.binary()) for x in parts]], ["cell", "ids", "rows", "codes"])

        coded = rows.mapInArrow(encode, "cell int, id long, row long, code binary")
        # by range of cell and id: near lists lie together, and a cell with a third of all vectors is cut like any other
        dealt = coded.repartitionByRange(max(1, -(-n // (64 * BLOCK))), "cell", "id", "row").sortWithinPartitions("cell", "id")
        dealt.mapInArrow(pack, "cell int, ids binary, rows binary, codes binary").write.parquet(self.path)

    def describe(self) -> str:
        return json.dumps({"cells": len(self.centres), "probes": self.probes, "dimensions": len(self.scale)})

    def search(self, queries: DataFrame, k: int, probes: int | None = None, rescore: int | None = None, id_col: str | None = None, column: str | None = None) -> DataFrame:
        """(query_id, query_row, id, distance, rank), as ``retrieval.nearest_each`` gives them, of the probed lists."""
        spark, centres, scale = self.vectors.sparkSession, self.centres, self.scale
        if not len(centres):
            return spark.createDataFrame([], "query_id long, query_row long, id long, distance double, rank int")
        probes, rescore = min(probes or self.probes, len(centres)), rescore or 4 * k + 16
        asked = _rows(queries, id_col or self.id_col, column or self.column).dropDuplicates(["id", "row"])

        def nearest_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = _units(b.column("v"))
                    far = -(v @ centres.T)
                    cells = np.argpartition(far, probes - 1, axis=1)[:, :probes] if probes < len(centres) else np.tile(np.arange(len(centres)), (len(v), 1))
                    at = np.repeat(np.arange(len(v)), probes)
                    taken = b.select(["id", "row"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel(), pa.int32()), taken.column(0), taken.column(1), pa.array([v[i].tobytes() for i in at], pa.binary())], ["cell", "qid", "qrow", "q"])

        probed = asked.mapInArrow(nearest_cells, "cell int, qid long, qrow long, q binary")
        slots = max(1, -(-asked.count() // QUERIES))
        packed = probed.groupBy("cell", F.pmod(F.xxhash64("qid", "qrow"), F.lit(slots)).alias("slot")).agg(F.collect_list(F.struct("qid", "qrow", "q")).alias("qs")).drop("slot")
        wanted = [r[0] for r in packed.select("cell").distinct().collect()]  # at most MOST_CELLS numbers: what the scan has to read
        lists = spark.read.schema("cell int, ids binary, rows binary, codes binary").parquet(self.path).filter(F.col("cell").isin(wanted))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for cell, ids, rows_, codes, qs in zip(*(b.column(c).to_pylist() for c in ("cell", "ids", "rows", "codes", "qs"))):
                    ids, rows_ = np.frombuffer(ids, np.int64), np.frombuffer(rows_, np.int64)
                    code = np.frombuffer(codes, np.int8).reshape(len(ids), -1)
                    q = np.stack([np.frombuffer(x["q"]) for x in qs])
                    near = np.round((q @ centres[cell])[:, None] + (q * scale) @ code.T, 9)
                    # the best by (near, id): ids ascend within a block, so of equal ones the first are taken
                    cut = np.partition(near, len(ids) - rescore, axis=1)[:, len(ids) - rescore, None] if rescore < len(ids) else np.full((len(q), 1), -np.inf)
                    ties, above = near == cut, near > cut
                    at, j = np.nonzero(above | (ties & (np.cumsum(ties, 1) <= rescore - above.sum(1)[:, None])))
                    own = [np.array([x[c] for x in qs], np.int64)[at] for c in ("qid", "qrow")]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, ids[j], rows_[j], near[at, j])], ["qid", "qrow", "id", "row", "near"])

        # a query is as many rows as it probes cells; Spark takes it for one and would collect all of them in the driver
        found = lists.join(packed.hint("merge"), "cell").mapInArrow(scan, "qid long, qrow long, id long, row long, near double")
        each = Window.partitionBy("qid", "qrow").orderBy(F.desc("near"), "id")
        found = found.withColumn("n", F.row_number().over(each)).filter(F.col("n") <= rescore).select("qid", "qrow", "id", "row")
        exact = found.join(_rows(self.vectors, self.id_col, self.column), ["id", "row"])
        exact = exact.join(asked.select(F.col("id").alias("qid"), F.col("row").alias("qrow"), F.col("v").alias("qv")), ["qid", "qrow"])

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    far = np.round(1 - (_units(b.column("qv")) * _units(b.column("v"))).sum(1), 9) + 0.0
                    yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("qrow"), b.column("id"), pa.array(far)], ["query_id", "query_row", "id", "distance"])

        d = exact.select("qid", "qrow", "id", "v", "qv").mapInArrow(measure, "query_id long, query_row long, id long, distance double")
        w = Window.partitionBy("query_id", "query_row").orderBy("distance", "id")
        real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
        return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(real("query_id"), "query_row", real("id"), "distance", "rank")

    def recall(self, queries: DataFrame, k: int, probes: int | None = None, exact: DataFrame | None = None) -> DataFrame:
        """query_id, found, wanted, recall against the exact search."""
        return retrieval.recall_each(exact or retrieval.nearest_each(self.vectors, queries, k, self.id_col, self.column), self.search(queries, k, probes))

    def calibrate(self, queries: DataFrame, k: int, gate: float = GATE, most: int = 200) -> float:
        """Sets probes to the least doubling that passes the gate for about ``most`` of the queries; their mean recall."""
        share = most / max(1, queries.count())
        some = queries if share >= 1 else queries.filter(F.pmod(F.xxhash64(self.id_col), F.lit(1 << 20)) < int(share * (1 << 20)))
        exact = retrieval.nearest_each(self.vectors, some, k, self.id_col, self.column).persist()
        try:
            while True:
                mean = self.recall(some, k, exact=exact).agg(F.sum("found") / F.sum("wanted")).first()[0]
                if mean is None or mean >= gate or self.probes >= len(self.centres):
                    return 1.0 if mean is None else mean
                self.probes = min(len(self.centres), 2 * self.probes)
        finally:
            exact.unpersist()

    def choose(self, queries: DataFrame, k: int, gate: float = GATE) -> DataFrame:
        """The index's answer if a calibration on these queries passes the gate, else the exact one."""
        if self.calibrate(queries, k, gate) >= gate:
            return self.search(queries, k)
        return retrieval.nearest_each(self.vectors, queries, k, self.id_col, self.column)


def gate_report(recalls: DataFrame, gate: float = GATE) -> DataFrame:
    """One row: queries, wanted, found, recall, passes; an empty set passes."""
    d = recalls.agg(F.count("*").alias("queries"), F.coalesce(F.sum("wanted"), F.lit(0)).alias("wanted"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"))
    recall = F.when(F.col("wanted") == 0, 1.0).otherwise(F.col("found") / F.col("wanted"))
    return d.withColumn("recall", recall).withColumn("passes", F.col("recall") >= gate)
