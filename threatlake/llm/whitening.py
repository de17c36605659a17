"""Whitening of embeddings by weighted multiplicity covariance.

Identical vectors are grouped, the fit weighs a distinct vector by its count (or by one),
partial centred products are summed by Spark, and every distinct vector is whitened once
and joined back to its rows. Only sums of the vector's dimensions reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, release, small_batches

SCALE, OFFSET = 64, 1_000_000
#: Components that are returned at most; the feature, not a guard.
COMPONENTS = 32
#: Largest size of an entry times SCALE: beyond it a double has no fraction left to floor.
LARGEST = float(2**52)
#: Eigenvalues below this share of the largest have no direction to whiten.
LEAST_SHARE = 1e-12
#: Vectors of a numpy step.
STEP = 4_096


def integers(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """_id, _x (the vector as longs) and its digest _k; rows whose vector has no such form are left out."""
    entry = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).alias("_id"), entry.alias("_v")).where("_v is not null and size(_v) > 0")
    fits = F.forall("_v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) * SCALE < LARGEST), F.lit(False)))
    rows = rows.where(fits).select("_id", F.transform("_v", lambda c: F.floor(c * SCALE) + F.lit(OFFSET)).alias("_x"))
    return rows.withColumn("_k", F.unhex(F.sha2(F.array_join(F.col("_x").cast("array<string>"), ","), 256)))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column, all of one length, as rows."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)
    release()


def exact_sums(groups: DataFrame, weight: str) -> tuple[int, list[int]]:
    """Weighted number of vectors and their sums by dimension, in whole numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in steps(batches):
            x, w = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            if float(np.abs(x).max(initial=0)) * float(w.sum()) >= 2**62:
                x, w = x.astype(object), w.astype(object)
            got = (w @ x).astype(object)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["p", "s"])

    small_batches(groups)
    sums = groups.select("_x", weight).mapInArrow(partial, "p int, s decimal(38,0)").groupBy("p").agg(F.sum("s").alias("s")).orderBy("p").collect()
    return int(groups.agg(F.sum(weight)).first()[0]), [int(r.s) for r in sums]


def added(groups: DataFrame, column: str, weight: str, product: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of a product of vectors and weights: a task adds up its batches, Spark the tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in steps(batches):
            got = product(matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    small_batches(groups)
    parts = groups.select(column, weight).mapInArrow(partial, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c.v).alias("row")).orderBy("i").collect()
    return np.array([r.row for r in rows], np.float64)


def covariance(groups: DataFrame, column: str, weight: str, centred: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """Weighted covariance of a vector column, divisor n; vectors are centred before they are multiplied."""

    def product(m: np.ndarray, w: np.ndarray) -> np.ndarray:
        m = centred(m)
        return (m * w[:, None]).T @ m

    return added(groups, column, weight, product) / n


def basis(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance, falling, and their unit eigenvectors as columns, with the
    greatest entry of each positive. At most `most`; none for values that are nil."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > max(values[0], 0) * LEAST_SHARE).sum()))
    values, vectors = values[:k], vectors[:, :k]
    at = np.abs(vectors).argmax(0)
    return values, vectors * np.where(vectors[at, range(k)] < 0, -1.0, 1.0)


def whiten(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", weights: str = "counts", most: int = COMPONENTS) -> DataFrame:
    """One row per kept row of `vectors`: id_col, size (entries), n, copies, deviation, whitened (array), explained (array), identity_error.

    Left out: rows whose vector is null, empty or holds a null, a non-finite entry, or one of
    2^46 or more, which has no exact whole-number form. Vectors of different lengths lie in
    different spaces, so each length is fitted on its own. `weights`: "counts" fits every
    row, "one" every distinct vector once. deviation is decimal(38,0), exact: n times a
    vector less the sum of all, squared and summed. Dimensions or directions without
    variance have no component, so there may be fewer than `most`, none for a single
    distinct vector. Null and repeated ids and repeated rows give a row each; ties of
    eigenvalues are broken the same way for all rows. Other columns are ignored, whatever
    their names. An empty table gives no rows.

    To the driver: sums and the covariance, the square of the length of a vector (bounded by
    the table's width, not by its rows).
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights: counts or one")
    scratch = Scratch(spark, "whiten")
    rows = integers(vectors, id_col, vector)
    groups = rows.groupBy("_k").agg(F.count("*").alias("_n"), F.first("_x").alias("_x")).select("*", F.size("_x").alias("_size"), F.lit(1).cast("long").alias("_one"))
    groups = scratch.keep(groups, "groups")
    out = None
    for size in [r._size for r in groups.select("_size").distinct().orderBy("_size").collect()]:
        done = _one_length(scratch, groups.where(F.col("_size") == size), size, "_n" if weights == "counts" else "_one", most)
        out = done if out is None else out.unionByName(done)
    scratch.drop("groups")
    if out is None:
        return rows.select(F.col("_id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in _COLUMNS.items())).limit(0)
    return rows.select("_k", "_id").join(out, "_k").select(F.col("_id").alias(id_col), *_COLUMNS)


_COLUMNS = {"size": "int", "n": "long", "copies": "long", "deviation": "decimal(38,0)", "whitened": "array<double>", "explained": "array<double>", "identity_error": "double"}


def _one_length(scratch: Scratch, groups: DataFrame, size: int, weight: str, most: int) -> DataFrame:
    """The distinct vectors of one length with all result columns, written."""
    n, sums = exact_sums(groups, weight)
    base, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
    share = np.array([r / n for r in rest])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - base).astype(np.float64) - share  # the difference of whole numbers is exact

    v = covariance(groups, "_x", weight, centred, n)
    values, vectors = basis(v, most)
    k = len(values)
    scale = vectors / np.sqrt(values)
    trace = float(np.trace(v))

    def squares(x: np.ndarray) -> list[Decimal]:
        """Exact: in longs where no sum can leave their range, else in Python's whole numbers."""
        d = x - base
        if (float(np.abs(d).max(initial=0)) + 1) ** 2 * float(n) ** 2 * size < 2**62:
            return [Decimal(int(t)) for t in ((d * n - np.array(rest, np.int64)) ** 2).sum(1)]
        wide = d.astype(object) * n - np.array(rest, object)
        return [t if t < 10**38 else None for t in map(Decimal, (wide**2).sum(1))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            x = matrix(batch.column("_x"))
            w = centred(x) @ scale
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_k", "_n", "_one")), pa.array(squares(x), pa.decimal128(38, 0)), pa.array(list(w), pa.list_(pa.float64()))],
                names=["_k", "_n", "_one", "deviation", "whitened"],
            )

    small_batches(groups)
    done = groups.select("_k", "_x", "_n", "_one").mapInArrow(apply, "_k binary, _n long, _one long, deviation decimal(38,0), whitened array<double>")
    done = scratch.keep(done, f"whitened-{size}")
    error = 0.0
    if k:
        middle = added(done, "whitened", weight, lambda m, w: (w @ m)[None, :])[0] / n
        error = float(np.abs(covariance(done, "whitened", weight, lambda m: m - middle, n) - np.eye(k)).max())
    explained = F.array(*(F.lit(float(e / trace)) for e in values)) if k else F.array().cast("array<double>")
    return done.select("_k", F.lit(size).alias("size"), F.lit(n).cast("long").alias("n"), F.col("_n").alias("copies"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def by_component(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per row and component: id_col, component, n, deviation (long; null beyond its range), whitened, explained, identity_error."""
    cells = F.posexplode(F.arrays_zip("whitened", "explained")).alias("p", "c")
    return whitened.select(F.col(id_col), "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "identity_error", cells).select(
        id_col, (F.col("p") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error"
    )
