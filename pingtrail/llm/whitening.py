"""Whitening of embeddings by a covariance that is weighted with multiplicities (operator 13)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (ArrayType, BinaryType, DecimalType, DoubleType, IntegerType, LongType, StructField,
                               StructType)

from pingtrail.llm.common import map_arrow, stored

# Entries beyond this size could not be summed exactly.
LARGEST = 2.0 ** 40


def finite(vector: str) -> Column:
    """The vector is there, not empty, and has neither null nor non-finite entries."""
    c = F.col(vector)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(True))


def _quantised(vectors: DataFrame, vector: str, scale: int, offset: int) -> DataFrame:
    """id and x, the quantised vector as little-endian 64-bit integers."""
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            values = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if len(values) and np.abs(values).max() > LARGEST:
                raise ArithmeticError("an entry is too large to be summed exactly")
            flat = values.astype("<i8") + offset
            ends = np.cumsum(sizes)
            return {"id": batch.column(0), "x": [flat[e - s:e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]}

        return work

    schema = StructType([StructField("id", vectors.schema["id"].dataType), StructField("x", BinaryType())])
    return map_arrow(vectors.where(finite(vector)).select("id", vector), make, schema)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(-1, dimensions)


def _summed(distinct: DataFrame, start: Callable[[], np.ndarray], add: Callable[[np.ndarray, pa.RecordBatch], None], kind: str) -> dict[int, float]:
    """Sums over all rows, entry by entry: each task adds into one array and hands on its entries, which Spark sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = start(), False
        for batch in batches:
            if batch.num_rows:
                add(total, batch)
                seen = True
        if seen:
            flat = total.ravel()
            keep = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(flat[keep])], names=["entry", "value"])

    parts = distinct.select("x", "weight").mapInArrow(run, f"entry long, value {kind}")
    return {r.entry: r.value for r in parts.groupBy("entry").agg(F.sum("value").alias("value")).collect()}


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", *, components: int = 8, weights: str = "counts",
           scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries c become x = floor(scale * c) + offset. Equal x are one distinct vector with a count, and everything below works on distinct
    vectors: sums S and the covariance (centred with the exact n * x - S before multiplying, divisor n) are weighted with the
    counts, or with one each for ``weights="one"``; each distinct vector is projected on the leading eigenvectors and
    divided by the roots of their eigenvalues once. Rows then meet their distinct vector again by x.

    deviation is the exact sum of (n * x - S)^2 as decimal(38, 0). explained is an eigenvalue's share of the trace.
    identity_error, the same in all rows, is the largest entry of the covariance of the whitened vectors less the identity.
    The sign of a component is such that its largest entry is positive.

    Only S and the covariance reach the driver, in size d and d * d for d dimensions whatever the number of rows.

    Vectors that are null, empty or hold null or non-finite entries are dropped. Components without variance (at rounding level)
    are left out, so one vector alone, or equal ones only, give no row; fewer dimensions give fewer components. Repeated rows and
    null ids come out as often as they go in. An empty table gives an empty result. Vectors of several lengths raise a
    ValueError, entries beyond 2^40 after scaling an ArithmeticError. Other columns are not read.
    """
    if weights not in ("counts", "one"):
        raise ValueError(weights)
    spark = vectors.sparkSession
    rows = stored(_quantised(vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector")), "vector", scale, offset), "whiten-rows")
    weight = F.count(F.lit(1)) if weights == "counts" else F.max(F.lit(1).cast("long"))
    distinct = stored(rows.groupBy("x").agg(weight.alias("weight")), "whiten-distinct")
    facts = distinct.agg(F.sum("weight").alias("n"), F.min(F.length("x")).alias("low"), F.max(F.length("x")).alias("high")).first()
    out = StructType([StructField(vec_id, vectors.schema[vec_id].dataType), StructField("component", IntegerType()), StructField("n", LongType()),
                      StructField("deviation", DecimalType(38, 0)), StructField("whitened", DoubleType()), StructField("explained", DoubleType()),
                      StructField("identity_error", DoubleType())])
    if facts.n is None:
        return spark.createDataFrame([], out)
    if facts.low != facts.high:
        raise ValueError(f"vectors of {facts.low // 8} to {facts.high // 8} entries")
    n, d = facts.n, facts.high // 8

    def add_sums(total: np.ndarray, batch: pa.RecordBatch) -> None:
        total += batch.column(1).to_numpy() @ _matrix(batch.column(0), d)

    found = _summed(distinct, lambda: np.zeros(d, dtype=np.int64), add_sums, "long")
    sums = np.array([found.get(i, 0) for i in range(d)], dtype=np.int64)

    def add_products(total: np.ndarray, batch: pa.RecordBatch) -> None:
        centred = (n * _matrix(batch.column(0), d) - sums) / n
        total += (centred * batch.column(1).to_numpy()[:, None]).T @ centred

    found = _summed(distinct, lambda: np.zeros((d, d)), add_products, "double")
    covariance = np.array([found.get(i, 0.0) for i in range(d * d)]).reshape(d, d) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    kept = int((values > max(values[0], 0) * d * 2.0 ** -50).sum())
    k = min(components, kept)
    if not k:
        return spark.createDataFrame([], out)
    trace = float(np.trace(covariance))
    axes = axes[:, :k] * np.sign(axes[np.abs(axes[:, :k]).argmax(0), np.arange(k)])
    roots = np.sqrt(values[:k])

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            away = n * _matrix(batch.column(0), d) - sums
            if float(np.abs(away).max(initial=0)) ** 2 * d < 2.0 ** 62:
                deviation = pa.array((away * away).sum(1)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([Decimal(sum(v * v for v in row)) for row in away.tolist()], pa.decimal128(38, 0))
            return {"x": batch.column(0), "weight": batch.column(1), "deviation": deviation, "y": list((away / n) @ axes / roots)}

        return work

    schema = StructType([*distinct.schema, StructField("deviation", DecimalType(38, 0)), StructField("y", ArrayType(DoubleType()))])
    white = stored(map_arrow(distinct, make, schema), "whiten-vectors")
    y = [F.get("y", F.lit(i)) for i in range(k)]
    means = white.agg(*(F.sum(F.col("weight") * y[i]) / n for i in range(k))).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = white.agg(*(F.sum(F.col("weight") * (y[i] - means[i]) * (y[j] - means[j])) / n for i, j in pairs)).first()
    error = max(abs(v - (i == j)) for (i, j), v in zip(pairs, products, strict=True))

    explained = F.array(*(F.lit(float(v / trace)) for v in values[:k]))
    back = rows.join(white.drop("weight"), "x").select("id", "deviation", F.posexplode("y").alias("at", "whitened"))
    return back.select(F.col("id").alias(vec_id), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
