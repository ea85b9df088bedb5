"""Operator 11: embedding whitening by TSQR (tall and skinny QR).

Vectors become whole numbers, x = floor(256 * c). The model is fitted on each distinct x once: their
number n and exact sums S by dimension come first. Then every partition centres its rows by S / n and
reduces them to the R factor of their QR decomposition, batch by batch; R factors are merged FAN at a
time, in a tree, by the QR of one above the other. The singular values and right vectors of the last R
give the eigenvalues and eigenvectors of the covariance, which is never formed. What a task holds is a
batch of rows and FAN matrices of the square of the dimensions.

A row is centred as (x - S div n) - (S mod n) / n, so that no digit is lost to a large mean. The
deviation, the sum of (n * x - S)^2, is exact: its value modulo 2^64 is computed in whole numbers and
holds wherever a floating-point estimate says that it fits in a long.

Defined cases: null vectors and those with null, NaN or infinite entries are left out; vectors shorter
than the longest are continued with zeros (empty ones too); entries beyond a long's range become its
ends; a deviation beyond a long is null; fewer dimensions than components give fewer components; a
component without variance (its eigenvalue is not above the rounding of the largest one; all of them if
n is 1) has explained 0 and whitened null, and identity_error is over the others, null if there are
none. Repeated rows and null ids each keep their rows; an empty table gives an empty result; columns
other than the id and the vector are not read. Of equal eigenvalues the order is that of the SVD.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.storage import materialise, scope

SCALE = 256
COMPONENTS = 4
FAN = 16
#: Bytes of centred rows that one QR takes.
QR_BYTES = 8 << 20
#: Beyond this a difference of two longs might not fit in a long.
WIDE = 1 << 61


def whole(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """id, x (array of long) of the rows that are kept."""
    c = F.col(f"`{vector}`").cast("array<double>")
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    kept = vectors.where(c.isNotNull() & F.forall(c, lambda e: F.coalesce(fine(e), F.lit(False))))
    return kept.select(F.col(f"`{id_}`").alias("id"), F.transform(c, lambda e: F.floor(e * SCALE).cast("long")).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass(frozen=True)
class Centre:
    """n rows with sums S by dimension, as S div n and S mod n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(n: int, sums: list[int]) -> Centre:
        return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n."""
        if x.size and max(abs(int(x.max())), abs(int(x.min())), *(abs(int(w)) for w in self.whole)) > WIDE:
            return (x.astype(np.longdouble) - self.whole - self.rest / np.longdouble(self.n)).astype(float)
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of (n * x - S)^2, exact; null beyond a long."""
        about = self.n * self.rows(x)
        about = np.einsum("ij,ij->i", about, about)
        low = (x.astype(np.uint64) - self.whole.astype(np.uint64)) * np.uint64(self.n) - self.rest.astype(np.uint64)
        return pa.array((low * low).sum(axis=1, dtype=np.uint64).view(np.int64), mask=about > float(1 << 63) * (1 - 1e-9))


def centre(fit: DataFrame, dims: int) -> Centre | None:
    """n and the exact sums of the rows of fit (x); None without rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1, dtype=np.int32)), pa.array(np.append(high, 0)), pa.array(np.append(low, n))], names=["dim", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(19,0)")).alias(c)
    sums = fit.select("x").mapInArrow(partial, "dim int, high long, low long").groupBy("dim").agg(exact("high"), exact("low")).collect()  # a row for each dimension
    total = {r.dim: (int(r.high) << 32) + int(r.low) for r in sums}
    return Centre.of(total[dims], [total[i] for i in range(dims)]) if total.get(dims) else None


def _stacked(rs: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(rs), mode="r")


def triangle(fit: DataFrame, mid: Centre) -> np.ndarray:
    """The R factor of all centred rows of fit (x)."""
    dims = len(mid.whole)
    step = max(dims, QR_BYTES // (8 * dims))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            for at in range(0, len(x), step):
                part = mid.rows(x[at : at + step])
                r = _stacked([part] if r is None else [r, part])
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["block", "r"])

    def merge(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        blobs = table.column("r").to_pylist()
        r = _stacked([np.frombuffer(blobs[i]).reshape(-1, dims) for i in order.tolist()])
        return pa.table({"block": pa.array([int(table.column("block")[0].as_py()) // FAN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    schema = "block long, r binary"
    level = materialise(fit.select("x").mapInArrow(leaves, schema), "whitening-r")
    top = level.agg(F.max("block")).first()[0]
    while top:
        level, top = level.groupBy(F.expr(f"block div {FAN}")).applyInArrow(merge, schema), top // FAN
    return np.frombuffer(level.first().r).reshape(-1, dims)  # one matrix of dims squared at most


def components_of(r: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (k rows), square roots of their eigenvalues (0: no variance), shares of the trace."""
    _, s, v = np.linalg.svd(r)
    s = np.append(s, np.zeros(v.shape[0] - len(s)))
    live = s > s[0] * max(r.shape) * np.finfo(float).eps
    trace = float((s * s).sum())
    share = np.where(live, s * s / trace if trace else 0.0, 0.0)
    return v[:k], np.where(live, s / np.sqrt(n), 0.0)[:k], share[:k]


def whiten(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for each row that is kept and each component."""
    spark = vectors.sparkSession
    rows = whole(vectors, id_, vector)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    shape = rows.agg(F.max(F.size("x")).alias("most"), F.min(F.size("x")).alias("least")).first()
    dims = shape.most or 0
    if not dims:
        return spark.createDataFrame([], schema)
    if shape.least < dims:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))
    with scope(spark):
        fit = materialise(rows.select("x").distinct(), "whitening-fit")
        mid = centre(fit, dims)
        axes, root, share = components_of(triangle(fit, mid), mid.n, min(components, dims))
        k = len(root)
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = np.where(root[:, None] > 0, axes / root[:, None], 0.0).T
        live = [i for i in range(k) if root[i] > 0]

        def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = mid.rows(_matrix(batch.column("x"), dims)) @ scaled
                yield pa.RecordBatch.from_arrays([pa.array(y[:, i]) for i in live], names=[f"w{i}" for i in live])

        error = None
        if live:
            white = fit.mapInArrow(projected, ", ".join(f"w{i} double" for i in live))
            # covar_pop centres before it multiplies
            gaps = [F.abs(F.covar_pop(f"w{i}", f"w{j}") - (1.0 if i == j else 0.0)) for i in live for j in live if i <= j]
            error = white.agg(F.array_max(F.array(*gaps)).alias("error")).first().error

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            y, far = mid.rows(x) @ scaled, mid.deviations(x)
            place = pa.array(np.repeat(np.arange(len(x)), k))
            dead = np.tile(root == 0, len(x))
            whitened = pa.array(y.ravel(), mask=dead)
            constant = lambda v, t: pa.array(np.tile(v, len(x)), t)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(place), constant(np.arange(1, k + 1), pa.int32()), constant([mid.n] * k, pa.int64()), far.take(place), whitened, constant(share, pa.float64()), pa.array([error] * (len(x) * k), pa.float64())],
                names=[id_, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(answer, schema)
