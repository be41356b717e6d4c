"""Embedding whitening: the covariance of distinct vectors weighted by their multiplicity; each whitened once, then joined back."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.llm.common import exact, join_back
from itembank.session import materialize

#: Fixed values of the grid that entries are put on.
STEPS, SHIFT = 64, 1_000_000
#: An eigenvalue at most so many times the largest is rounding: the component has no variance.
NO_VARIANCE = 1e-12
LONG = 2**63


def _grid(c: Column) -> Column:
    """floor(64 c) + 1000000 of an entry; what no long can hold becomes the nearest that one can."""
    value = F.floor(c.cast("double") * STEPS)
    far = float(2**62)
    return F.when(F.abs(c.cast("double")) * STEPS < far, value + SHIFT).otherwise(F.when(c > 0, F.lit(2**62)).otherwise(F.lit(-(2**62))))


def vectors(rows: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key and x, array<long>, of the rows that have a vector of finite entries."""
    own = exact(rows, key, column).toDF("key", "vector")
    whole = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return own.where(whole).select("key", F.transform("vector", _grid).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _long_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact weighted sums by dimension, as digits, one row a dimension and task."""
    total: list[int] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x, w = _matrix(batch.column(0)), batch.column(1).to_numpy()
        if float(np.abs(x.astype(float)).max()) * float(w.sum()) >= LONG / 2:
            x, w = x.astype(object), w.astype(object)
        sums = [int(v) for v in w @ x]
        total = [a + b for a, b in zip(total, sums, strict=True)] if total else sums
    yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "s": pa.array([str(v) for v in total], pa.string())})


@dataclass(frozen=True)
class Space:
    """n, exact sums by dimension, and the projection (dimensions x components) with its eigenvalues; of bounded size."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in doubles: the nearest whole mean goes first, exactly."""
        near = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)
        rest = np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, near, strict=True)])
        gap = x.astype(float) - near if np.abs(x.astype(float)).max(initial=0) > 2.0**60 else (x - near).astype(float)
        return gap - rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact; null where no long holds it."""
        most = float(np.abs(self.centred(x)).max(initial=0)) * self.n + self.n
        if most**2 * x.shape[1] < LONG / 2 and float(np.abs(x).max(initial=0)) * self.n < LONG / 2 and max(map(abs, self.sums)) < LONG / 2:
            gap = x * self.n - np.array(self.sums, dtype=np.int64)
            return [int(v) for v in (gap * gap).sum(axis=1)]
        gaps = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return [v if v < LONG else None for v in (int((g * g).sum()) for g in gaps)]


def _gram(centre: object, column: int, size: int) -> object:
    """A map that adds up w (v - c)(v - c)^T over its batches and gives one row per matrix row and task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        seen = False
        for batch in batches:
            if batch.num_rows:
                v, w = centre(_matrix(batch.column(column))), batch.column(1).to_numpy().astype(float)
                total += (v * w[:, None]).T @ v
                seen = True
        if seen:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    return add


def _added(size: int) -> object:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)) if batch.num_rows else (), strict=True):
                total[i] = total[i] + row if i in total else row.copy()
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(total), pa.int32()), "row": pa.array(list(total.values()), pa.list_(pa.float64()))})

    return add


def _covariance(table: DataFrame, centre: object, column: int, size: int, n: int) -> np.ndarray:
    """The weighted matrix over n: tasks add their part, matrix rows are added by row; size^2 doubles come back."""
    kind = "i int, row array<double>"
    parts = table.mapInArrow(_gram(centre, column, size), kind)
    rows = parts.repartition("i").mapInArrow(_added(size), kind).collect()
    out = np.zeros((size, size))
    for r in rows:
        out[r["i"]] = r["row"]
    return out / n


def _common_length(rows: DataFrame) -> int | None:
    counts = rows.groupBy(F.size("x").alias("d")).count()
    most = counts.agg(F.max_by("d", F.struct("count", "d")).alias("d")).head()
    return most["d"] if most else None


def distinct_vectors(x: DataFrame, weights: str = "counts") -> DataFrame:
    """Each different x once: x, weight, copies and a 128-bit key; copies are counted before the shuffle."""
    if weights not in ("counts", "one"):
        raise ValueError("weights must be 'counts' or 'one'")
    grouped = x.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    weight = F.col("copies") if weights == "counts" else F.lit(1).cast("long")
    return grouped.select("x", weight.alias("weight"), "copies", *_key())


def _key() -> list[Column]:
    return [F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(1), F.col("x")).alias("k2")]


def fit(distinct: DataFrame, components: int = 32) -> Space:
    """Mean and principal axes of distinct vectors with weights; two passes, the second over centred vectors."""
    sums = distinct.select("x", "weight").mapInArrow(_long_sums, "i int, s string")
    total = sums.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    n = distinct.agg(F.sum("weight")).head()[0]
    s = tuple(int(r["s"]) for r in sorted(total, key=lambda r: r["i"]))
    blank = Space(n, s, np.zeros((len(s), 0)), np.zeros(0), 0.0)
    v = _covariance(distinct.select("x", "weight"), blank.centred, 0, len(s), n)
    values, axes = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    axes = axes[:, order] * np.where(axes[np.abs(axes[:, order]).argmax(axis=0), order] < 0, -1.0, 1.0)
    return Space(n, s, axes, np.maximum(values[order], 0.0), float(np.trace(v)))


def whiten(rows: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 32, weights: str = "counts") -> DataFrame:
    """Per remaining row and component: key, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or infinite entries or NaN give nothing, and neither
    do vectors of another length than the most frequent one (the longest of them on ties): they
    have no entry in some dimension, or one in a dimension that is none. Null keys and repeated
    rows stay, each with its own results. Other columns are not read.

    A component without variance (of fewer different vectors than dimensions, or of a constant
    table) has whitened and explained 0 and does not count in identity_error. An empty table gives
    no row. deviation is null where it passes a long.

    Identical vectors are grouped by partial aggregates, weighted by their copies (`counts`) or
    once (`one`), and whitened once. Rows find the result by a 128-bit hash of the vector;
    results of vectors with many copies are broadcast (512 at most), so no key fills one task.
    Driver: a matrix of dimensions x dimensions.
    """
    spark = rows.sparkSession
    x = vectors(rows, key, column)
    kind = dict(rows.dtypes)[key]
    size = _common_length(x)
    if size is None:
        empty = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], empty)
    x = x.where(F.size("x") == size)
    distinct = materialize(distinct_vectors(x, weights), "distinct-vectors")
    space = fit(distinct, components)
    k = space.axes.shape[1]
    live = space.values > NO_VARIANCE * max(float(space.values.max(initial=0)), 1e-300)
    scale = np.where(live, 1 / np.sqrt(np.where(live, space.values, 1.0)), 0.0)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _matrix(batch.column(0))
            z = (space.centred(own) @ space.axes) * scale
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(z), pa.list_(pa.float64())), *[batch.column(i) for i in range(1, 5)], pa.array(space.deviation(own), pa.int64())],
                names=["z", "weight", "copies", "k1", "k2", "deviation"],
            )

    done = distinct.select("x", "weight", "copies", "k1", "k2").mapInArrow(
        apply, "z array<double>, weight long, copies long, k1 long, k2 long, deviation long"
    )
    done = materialize(done, "whitened-vectors")
    error = _identity_error(done, live, space.n, k)
    rows_in = done.agg(F.sum("copies")).head()[0]
    found = join_back(x.select("key", *_key()), done.drop("weight"), ["k1", "k2"], "copies", rows_in)
    explained = np.where(live, space.values, 0.0) / (space.trace or 1.0)
    each = F.posexplode("z").alias("at", "whitened")
    out = found.select("key", "deviation", each)
    return out.select(
        F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(space.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.lit([float(e) for e in explained]), F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def _identity_error(done: DataFrame, live: np.ndarray, n: int, k: int) -> float:
    """The largest entry of |covariance of the whitened vectors - identity|, over components with variance."""
    if not live.any():
        return 0.0
    at = F.posexplode("z").alias("i", "v")
    means = done.select("weight", at).groupBy("i").agg((F.sum(F.col("v") * F.col("weight")) / n).alias("m")).collect()
    mean = np.zeros(k)
    for r in means:
        mean[r["i"]] = r["m"]
    cov = _covariance(done.select("z", "weight"), lambda z: z - mean, 0, k, n)
    return float(np.abs(cov - np.eye(k))[np.ix_(live, live)].max())
