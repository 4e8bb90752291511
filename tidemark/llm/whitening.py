"""Whitening of embeddings by a compensated covariance.

The covariance is that of different vectors, each counted once. Its centre comes first, from exact sums of whole numbers. Then each task sums up the outer products of its
centred vectors in double-double: a product's rounding error (by Dekker's splitting) and a sum's (by Knuth's) are kept in a second double, so the sum is as good as one of twice the
digits. Tasks hand on both parts of their rows of the matrix, which are merged row by row, in the order of the tasks, by the same additions. The
eigenvectors are those of LAPACK's tridiagonal divide and conquer (syevd, behind numpy.linalg.eigh), of a matrix whose size is that of a vector squared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, saved

#: Doubles that one product of a block of vectors takes.
DOUBLES_AT_ONCE = 60_000
#: The columns that whiten() adds.
ADDED = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
#: Whole numbers up to here are exact as doubles.
EXACT = 2.0**52


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum as a double, and what rounding took from it."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two doubles of half the digits each, whose sum is a."""
    t = a * 134217729.0  # 2**27 + 1
    high = t - (t - a)
    return high, a - high


def add(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two numbers of a high and a low part, to twice the digits of the larger one."""
    s, e = two_sum(x[0], y[0])
    e += x[1] + y[1]
    t = s + e
    return t, e - (t - s)


def products(high: np.ndarray, low: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns i times columns j of numbers of a high and a low part."""
    upper, lower = halves(high)
    a, b = high[:, i], high[:, j]
    p = a * b
    ui, uj, li, lj = upper[:, i], upper[:, j], lower[:, i], lower[:, j]
    e = ((ui * uj - p) + ui * lj + li * uj) + li * lj + (a * low[:, j] + low[:, i] * b)
    t = p + e
    return t, e - (t - p)


def total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the rows, halving them step by step."""
    while len(high) > 1:
        if len(high) % 2:
            high, low = np.pad(high, ((0, 1), (0, 0))), np.pad(low, ((0, 1), (0, 0)))
        n = len(high) // 2
        high, low = add((high[:n], low[:n]), (high[n:], low[n:]))
    return high[0], low[0]


def centred(x: np.ndarray, sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole vectors less sums / n, as high and low parts; what one double can't hold of the centre is in the low part."""
    whole = [s // n for s in sums]
    rest = [s % n for s in sums]
    high, low = two_sum(x - np.array(whole, float), -np.array([r / n for r in rest]))
    # r / n is rounded too: the error is (r - n * (r / n)) / n
    return high, low - np.array([float(r * q - n * p) / (n * q) for r, (p, q) in zip(rest, ((r / n).as_integer_ratio() for r in rest))])


def deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """The sum of (n x - sums) ** 2 of each vector, exact; none where it is beyond a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 2**62:
        d = n * x - np.array(sums, np.int64)
        if x.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < 2**63:
            return (d * d).sum(1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return [v if v < 2**63 else None for v in (d * d).sum(1).tolist()]


def upper(dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(dim)


def covariance(vectors: DataFrame, dim: int, n: int, parts) -> tuple[np.ndarray, np.ndarray]:
    """High and low parts of the covariance, divisor n, of the vectors in the first column; parts makes centred high and low parts of a block of them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = upper(dim)
        acc = np.zeros(len(i)), np.zeros(len(i))
        rows = max(1, DOUBLES_AT_ONCE // len(i))
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for a in range(0, len(x), rows):
                acc = add(acc, total(*products(*parts(x[a : a + rows]), i, j)))
        ends = np.searchsorted(i, np.arange(dim + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in acc]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), *lists], ["row", "high", "low"])

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["task"].to_pylist(), table["high"].to_pylist(), table["low"].to_pylist()))
        high, low = total(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        return pa.table({"row": table["row"].slice(0, 1), "high": pa.array([high.tolist()]), "low": pa.array([low.tolist()])})

    kind = "row int, high array<double>, low array<double>"
    tasks = vectors.mapInArrow(partial, kind).withColumn("task", F.spark_partition_id())
    out = np.zeros((dim, dim)), np.zeros((dim, dim))
    for r in tasks.groupBy("row").applyInArrow(merge, kind).collect():  # as many rows as a vector has entries
        for m, v in zip(out, (r["high"], r["low"])):
            m[r["row"], r["row"] :] = m[r["row"] :, r["row"]] = v
    # divided by n with the rest of the division, so both parts stay right
    q = out[0] / n
    p, e = _times(q, float(n))
    return two_sum(q, ((out[0] - p) - e + out[1]) / n)


def _times(a: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(np.array(b))
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass(frozen=True)
class Whitening:
    """n different vectors, their sums by dimension, and the components by falling variance: each a row that projects, its variance, and its share of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """The whitened entries of whole vectors; not a number for components without variance."""
        high, low = centred(x, self.sums, self.n)
        with np.errstate(invalid="ignore", divide="ignore"):
            scale = np.where(self.variances > 0, 1 / np.sqrt(self.variances), np.nan)
        return (high @ self.vectors.T + low @ self.vectors.T) * scale


def whole(vector: Column, scale: int, offset: int) -> Column:
    """floor(scale * entry) + offset of each entry, as long; null for vectors that are null or hold entries that are null, not finite, or too large to be exact."""
    entry = F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("double") + offset)
    fits = F.forall(vector, lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < (EXACT - abs(offset)) / scale), F.lit(False)))
    return F.when(vector.isNotNull() & fits, F.transform(entry, lambda v: v.cast("bigint")))


def sums_of(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number and exact sums by dimension of the vectors in the first column."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            n += len(x)
            for a in range(0, len(x), 1000):
                sums = [s + t for s, t in zip(sums, x[a : a + 1000].sum(0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array([n] * dim), pa.array(sums, pa.decimal128(38, 0))], ["dimension", "n", "total"])

    told = vectors.mapInArrow(partial, "dimension int, n long, total decimal(38,0)").groupBy("dimension").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
    rows = sorted(told.collect(), key=lambda r: r["dimension"])  # as many as a vector has entries
    return (rows[0]["n"], [int(r["total"]) for r in rows]) if rows else (0, [0] * dim)


def fit_whitening(distinct: DataFrame, dim: int, components: int) -> Whitening:
    """The components of different whole vectors, in the first column."""
    n, sums = sums_of(distinct, dim)
    high, _ = covariance(distinct, dim, n, lambda x: centred(x, sums, n))
    values, vectors = np.linalg.eigh(high)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components].T
    trace = math.fsum(np.diag(high).tolist())
    values = np.where(values > trace * dim * np.finfo(float).eps, values, 0.0)
    return Whitening(n, sums, vectors, values, values / trace if trace > 0 else np.zeros(len(values)))


def identity_error(distinct: DataFrame, dim: int, model: Whitening) -> float:
    """The largest entry, in size, of the covariance of the whitened different vectors less the identity, over components with variance; zero if none has any."""
    own = np.flatnonzero(model.variances > 0)
    k = len(own)
    if not k:
        return 0.0

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = model.of(_matrix(batch.column(0), dim))[:, own]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, k, dtype=np.int32)), pa.array(y.reshape(-1)))], ["y"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(k), np.zeros(k)
        for batch in batches:
            y = _matrix(batch.column(0), k)
            if len(y):
                acc = add(acc, total(y, np.zeros_like(y)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(acc[0] + acc[1])], ["component", "total"])

    whitened, mean = distinct.mapInArrow(narrow, "y array<double>"), np.zeros(k)
    for r in whitened.mapInArrow(partial, "component int, total double").groupBy("component").agg(F.sum("total").alias("total")).collect():
        mean[r["component"]] = r["total"] / model.n
    high, _ = covariance(whitened, k, model.n, lambda y: two_sum(y, np.broadcast_to(-mean, y.shape)))
    return float(np.abs(high - np.eye(k)).max())


def whitened_udf(model: Whitening, dim: int):
    """whole vector -> whitened entries and deviation"""

    @F.arrow_udf("whitened array<double>, deviation long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            x = _matrix(vectors, dim)
            y = model.of(x)
            flat = y.reshape(-1)
            values = pa.array(flat, mask=np.isnan(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, max(1, y.shape[1]), dtype=np.int32) if len(y) else np.zeros(1, np.int32)), values)
            yield pa.StructArray.from_arrays([lists, pa.array(deviations(x, model.sums, model.n), pa.int64())], ["whitened", "deviation"])

    return run


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64, offset: int = 1_000_000, components: int = 16, extra: list[str] | None = None) -> DataFrame:
    """Of each row with a usable vector and each component: the key, component (from 1 by falling variance), n, deviation, whitened, explained and identity_error.

    Entries c become the whole numbers x = floor(scale * c) + offset. The fit takes each different x once: n vectors with sums S. deviation is the sum over dimensions of
    (n x - S) ** 2, exact, null beyond a long; whitened is x - S / n on the component over the root of its variance, null for a component without variance (as where
    all vectors are equal); explained is the component's share of all variance, zero if there is none. identity_error, one value, tells how far the covariance of what came out is from the identity.

    Rows go whose vector is null, empty, or holds entries that are null, not finite or beyond 2 ** 52 once scaled. The vectors' length is the commonest (of several the
    largest); rows of another length go. Repeated rows and equal vectors give repeated results; null keys stay; columns in extra that bear a name it adds go. Vectors shorter than `components` have as many
    components as entries. An empty table gives an empty result. Other columns in extra are carried along. The different vectors are written to the shared folder once. What the driver gets are
    matrices of a vector's length squared, of any number of rows.
    """
    spark = df.sparkSession
    keep = [c for c in dict.fromkeys([key, *(extra or [])]) if c not in ADDED and not c.startswith("_w_")]
    rows = df.select(*keep, whole(F.col(vector), scale, offset).alias("_w_x")).where("_w_x is not null")
    lengths = rows.groupBy(F.size("_w_x").alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return rows.where("false").select(*keep, *[F.lit(None).cast(kind).alias(c) for c, kind in ADDED.items()])
    dim = lengths["dim"]
    rows = rows.where(F.size("_w_x") == dim)
    distinct = saved(rows.select("_w_x").distinct(), "vectors")
    model = fit_whitening(distinct, dim, components)
    error = identity_error(distinct, dim, model)
    out = rows.select(*keep, whitened_udf(model, dim)("_w_x").alias("_w_told"))
    out = out.select(*keep, F.col("_w_told")["deviation"].alias("deviation"), F.posexplode(F.col("_w_told")["whitened"]).alias("_w_k", "whitened"))
    share = F.array(*[F.lit(float(v)) for v in model.explained])
    return out.select(*keep, (F.col("_w_k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("_w_k")).alias("explained"), F.lit(error).alias("identity_error"))


by_value(__name__)
