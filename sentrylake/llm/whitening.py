"""Whitening of embeddings by TSQR: no covariance matrix is formed.

Entries become integers, so their sums are exact whatever the order of addition, and n * x - S, rows centred and scaled by n, are
exact integers too. Each task folds its centred rows, a piece at a time, into one upper triangle by QR; triangles are merged by
QR in a tree of FAN_IN; the SVD of the last one has the eigenvectors of the covariance as its right vectors, and its squared
singular values over n are their eigenvalues. What meets in a task, or comes to the driver, are triangles and sums, whose size
depends on the number of dimensions alone.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.work import ship
from sentrylake.work import drop, written

#: Steps of an entry's unit, and what is added to each.
SCALE, SHIFT = 64, 1_000_000
#: Rows that one QR takes at a time, and triangles that one task merges.
PIECE, FAN_IN = 4096, 16
_SAFE = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """n rows of sums' length; unit components as rows, with their eigenvalues, falling; trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def integers(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are whole vectors of the width, and their entries as integers. A null, an infinity, NaN, or what no 62 bits can
    hold makes a row none."""
    keep = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False).to_numpy(zero_copy_only=False).copy()
    flat = vectors.filter(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(flat * SCALE)
        good = (np.abs(scaled) < _SAFE).all(1)  # false for NaN
    keep[keep] = good
    return keep, scaled[good].astype(np.int64) + SHIFT


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as long as they fit, 64-bit integers, else Python's."""
    most = max((abs(int(x.min())), abs(int(x.max())))) if x.size else 0
    if n * most < _SAFE and max(map(abs, sums), default=0) < _SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(y: np.ndarray) -> pa.Array:
    """The sum of squares of each row, exact; null where it has more than 38 digits."""
    most = max((abs(int(y.min())), abs(int(y.max())))) if y.size else 0
    if y.dtype != object and most**2 * y.shape[1] < _SAFE:
        return pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
    exact = (sum(int(v) ** 2 for v in row) for row in y)
    return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _read(df: DataFrame, vector: str) -> Column:
    return df[vector].cast("array<double>")


def _node() -> int:
    return TaskContext.get().partitionId()


def _sums(df: DataFrame, vector: str) -> tuple[int, list[int]]:
    """Rows of the commonest length (the larger one of two), and their exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            vectors = batch.column(0)
            for width in pc.unique(pc.list_value_length(vectors)).to_pylist():
                if width:
                    _, x = integers(vectors, width)
                    own = held.setdefault(width, [0, np.zeros(width, np.int64), np.zeros(width, np.int64)])
                    own[0] += len(x)
                    own[1] += (x >> 32).sum(0)
                    own[2] += (x & 0xFFFFFFFF).sum(0)
        for width, (n, high, low) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width, width)), pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(high), pa.array(low)], ["width", "pos", "n", "high", "low"])

    parts = df.select(_read(df, vector).alias("v")).mapInArrow(run, "width long, pos long, n long, high long, low long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    total = written(parts.groupBy("width", "pos").agg(F.sum("n").alias("n"), *exact), "sums")
    best = total.where("pos = 0").orderBy(F.desc("n"), F.desc("width")).first()
    if best is None or not best["n"]:
        drop(total)
        return 0, []
    rows = total.where(F.col("width") == best["width"]).orderBy("pos").collect()  # one for each dimension
    drop(total)
    return best["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def _tree(level: DataFrame, merge: Callable[[pd.DataFrame], dict], schema: str) -> dict | None:
    """The one row that merging leaves, FAN_IN nodes at a time; each level is a written table."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"node": key[0], **merge(rows.sort_values("node"))}])

    level = written(level, "level")
    while level.count() > 1:
        up = written(level.groupBy(F.floor(F.col("node") / FAN_IN).alias("up")).applyInPandas(run, f"node long, {schema}"), "level")
        drop(level)
        level = up
    last = level.first()
    drop(level)
    return last and last.asDict()


def _centred(vectors: pa.Array, n: int, sums: list[int]) -> np.ndarray:
    return deviations(integers(vectors, len(sums))[1], n, sums).astype(np.float64) / n


def fit(df: DataFrame, vector: str = "embedding", most: int = 32) -> Whitening:
    """The whitening of all whole vectors, with the components of most variance.

    A null vector, one that holds a null, NaN or an infinity, and one of another length than the commonest, aren't fitted. A
    direction without variance is no component: equal vectors, a single one, or none leave no components."""
    ship(df.sparkSession)
    n, sums = _sums(df, vector)
    width = len(sums)
    nothing = Whitening(n, sums, np.zeros((0, width)), np.zeros(0), 0.0)
    if not n:
        return nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for i in range(0, batch.num_rows, PIECE):
                r = triangle(np.vstack([r, _centred(batch.column(0).slice(i, PIECE), n, sums)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([_node()]), pa.array([r.ravel()])], ["node", "r"])

    def merge(rows: pd.DataFrame) -> dict:
        return {"r": triangle(np.vstack([np.asarray(r).reshape(-1, width) for r in rows["r"]])).ravel()}

    top = _tree(df.select(_read(df, vector).alias("v")).mapInArrow(run, "node long, r array<double>"), merge, "r array<double>")
    _, s, right = np.linalg.svd(np.array(top["r"]).reshape(-1, width), full_matrices=False)
    rank = int((s > s[0] * max(n, width) * np.finfo(float).eps).sum()) if s[0] > 0 else 0
    kept = min(rank, most)
    return Whitening(n, sums, right[:kept], s[:kept] ** 2 / n, float((s**2).sum() / n)) if kept else nothing


def whitened(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The id, deviation (exact sum over dimensions of (n * x - S) ** 2) and whitened (one number for each component) of each row
    with a whole vector of the model's length; other rows aren't returned. Ids of any type, null or repeated, are carried along;
    other columns aren't read. Without rows to fit there are none to return."""
    ship(df.sparkSession)
    n, sums = model.n, model.sums
    turn = (model.components / np.sqrt(model.eigenvalues)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PIECE):
                piece = batch.slice(i, PIECE)
                keep, x = integers(piece.column(1), len(sums))
                y = deviations(x, n, sums)
                z = y.astype(np.float64) / max(n, 1) @ turn
                lists = pa.ListArray.from_arrays(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1], pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column(0).filter(pa.array(keep)), squares(y), lists], ["id", "deviation", "whitened"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), _read(df, vector).alias("v"))
    found = rows.where(F.size("v") == len(sums) if n else F.lit(False)).mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")
    return found.withColumnRenamed("id", id_col)


def identity_error(rows: DataFrame, components: int) -> float | None:
    """The largest absolute entry of the covariance of whitened() rows, less the identity. Each task's co-moments are about its
    own mean, and merged in a tree."""
    if not components:
        return None

    def one(z: np.ndarray) -> dict:
        mean = z.mean(0)
        return {"n": len(z), "mean": mean, "m2": ((z - mean).T @ (z - mean)).ravel()}

    def both(a: dict, b: dict) -> dict:
        n, gap = a["n"] + b["n"], np.asarray(b["mean"]) - np.asarray(a["mean"])
        m2 = np.asarray(a["m2"]) + np.asarray(b["m2"]) + (np.outer(gap, gap) * (a["n"] * b["n"] / n)).ravel()
        return {"n": n, "mean": np.asarray(a["mean"]) + gap * (b["n"] / n), "m2": m2}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                own = one(batch.column(0).flatten().to_numpy().reshape(batch.num_rows, components))
                held = both(held, own) if held else own
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_node()]), pa.array([held["n"]]), pa.array([held["mean"]]), pa.array([held["m2"]])], ["node", "n", "mean", "m2"])

    def merge(rows: pd.DataFrame) -> dict:
        found = rows.to_dict("records")
        held = found[0]
        for other in found[1:]:
            held = both(held, other)
        return {k: held[k] for k in ("n", "mean", "m2")}

    schema = "n long, mean array<double>, m2 array<double>"
    top = _tree(rows.select("whitened").mapInArrow(run, f"node long, {schema}"), merge, schema)
    return float(np.abs(np.array(top["m2"]).reshape(components, -1) / top["n"] - np.eye(components)).max())
