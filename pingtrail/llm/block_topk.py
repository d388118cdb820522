"""Exact top-k by inner product with block-at-a-time pruning (operator 5)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pingtrail.llm.common import map_arrow, stored
from pingtrail.llm.multi_index import _codebook

# Documents of a block, blocks of a shard, queries that pass a shard together, vectors that the order is fitted on.
BLOCK, SHARD_BLOCKS, CHUNK, SAMPLE, CODES = 128, 64, 512, 10_000, 64
EXACT = 2.0 ** 53
LOWEST = np.iinfo(np.int64).min


def complete(vector: str) -> Column:
    """The vector is there and holds no null or non-finite component."""
    c = F.col(vector)
    return c.isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def products(queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point only where every sum stays exact."""
    if not queries.size or not docs.size:
        return np.zeros((len(queries), len(docs)), dtype=np.int64)
    if float(np.abs(queries).max()) * float(np.abs(docs).max()) * queries.shape[1] < EXACT:
        return (queries @ docs.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return (whole(queries) @ whole(docs).T).astype(np.int64)  # beyond 64 bits this raises an OverflowError


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest score that each block can give each query: the summed best of its term maxima and minima."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def _best(scores: np.ndarray, ids: np.ndarray, copies: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return tuple(np.take_along_axis(a, order, 1) for a in (scores, ids, copies))


def search(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
    """The best ``k`` different rows of these blocks for each query: scores, ids and copies, unused places with the lowest score.

    Blocks hold ids, vectors and how often each row occurs. Copies can only lift the k-th score, so leaving them to the
    ranking loses nothing.

    Each query takes its blocks in falling order of bound and stops at the first one whose bound is below its k-th
    score so far, or below ``floor``, a score known to be reached by k documents. Equal bounds are still scored, as
    a smaller id wins a tie.
    """
    low = np.array([values.min(0) for _, values, _ in blocks])
    high = np.array([values.max(0) for _, values, _ in blocks])
    bound = bounds(queries, low, high)
    slack = np.abs(bound) * 1e-12 + 1  # the bound is in floating point
    order = np.argsort(-bound, axis=1, kind="stable")
    scores = np.full((len(queries), k), LOWEST + 1, dtype=np.int64)
    ids = np.full((len(queries), k), np.iinfo(np.int64).max, dtype=np.int64)
    copies = np.zeros((len(queries), k), dtype=np.int64)
    active = np.arange(len(queries))
    for step in range(len(blocks)):
        least = np.maximum(scores[active, -1], floor[active])
        at = order[active, step]
        active = active[bound[active, at] + slack[active, at] >= least]
        if not len(active):
            break
        at = order[active, step]
        for b in np.unique(at):
            rows = active[at == b]
            names, values, times = blocks[b]
            found = products(queries[rows], values)
            found[own[rows][:, None] == names[None]] = LOWEST + 1
            better = (found >= np.maximum(scores[rows, -1], floor[rows])[:, None]).any(1)
            rows, found = rows[better], found[better]
            if len(rows):
                together = [np.concatenate([old[rows], np.broadcast_to(new, found.shape)], 1) for old, new in ((scores, found), (ids, names), (copies, times))]
                scores[rows], ids[rows], copies[rows] = _best(*together, k)
    return scores, ids, copies


def _pack(kind: int, names: np.ndarray, values: np.ndarray, more: np.ndarray) -> tuple:
    """``more`` holds the copies of a block's rows, or the floors of a chunk's queries."""
    return kind, values.shape[1], names.astype("<i8").tobytes(), values.astype("<f8").tobytes(), more.astype("<i8").tobytes()


def _build(k: int, every: int):
    """Rows in order become blocks; the queries among them become chunks with the k-th score within their own block."""

    def run(batches):
        schema = pa.schema([("kind", pa.int32()), ("size", pa.int32()), ("names", pa.binary()), ("vals", pa.binary()), ("more", pa.binary())])
        size, names, values, times, chunk = None, [], [], [], []

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        def block():
            ids, matrix = np.array(names, dtype=np.int64), np.array(values).reshape(len(names), size)
            asks = np.flatnonzero(ids % every == 0)
            floor = np.full(len(asks), LOWEST + 1, dtype=np.int64)
            if len(asks) and len(np.unique(ids)) > k:
                found = products(matrix[asks], matrix)
                found[ids[asks][:, None] == ids[None]] = LOWEST + 1
                floor = np.sort(found, 1)[:, -k]
            chunk.extend(zip(ids[asks], matrix[asks], floor, strict=True))
            return _pack(0, ids, matrix, np.array(times, dtype=np.int64))

        def asked():
            return _pack(1, np.array([c[0] for c in chunk]), np.array([c[1] for c in chunk]).reshape(len(chunk), size), np.array([c[2] for c in chunk]))

        for batch in batches:
            rows = []
            for name, value, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if names and (len(value) != size or len(names) >= BLOCK):
                    rows.append(block())
                    names, values, times = [], [], []
                    if chunk and (len(chunk) >= CHUNK or len(value) != size):
                        rows.append(asked())
                        chunk = []
                size = len(value)
                names.append(name)
                values.append(value)
                times.append(copies)
            if rows:
                yield table(rows)
        if names:
            rows = [block()]
            if chunk:
                rows.append(asked())
            yield table(rows)

    return run


def _answer(k: int):
    """A shard's blocks come first and stay, then chunks of queries stream past them."""

    def run(batches):
        schema = pa.schema([("query_id", pa.int64()), ("query", pa.binary()), ("vec_id", pa.int64()), ("score", pa.int64()), ("copies", pa.int64())])
        shard, blocks = None, []
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for i, at in enumerate(zip(columns["size"], columns["shard"], strict=True)):
                if at != shard:
                    shard, blocks = at, []
                names = np.frombuffer(columns["names"][i], "<i8")
                values = np.frombuffer(columns["vals"][i], "<f8").reshape(len(names), at[0])
                more = np.frombuffer(columns["more"][i], "<i8")
                if columns["kind"][i] == 0:
                    blocks.append((names, values, more))
                elif blocks:
                    scores, ids, copies = search(values, names, more, blocks, k)
                    good = (scores > LOWEST + 1) & (scores >= more[:, None])
                    query = pa.array([hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in values], pa.binary())
                    each = np.repeat(np.arange(len(names)), good.sum(1))
                    yield pa.RecordBatch.from_arrays([pa.array(names[each]), query.take(pa.array(each)), pa.array(ids[good]), pa.array(scores[good]),
                                                      pa.array(copies[good])], schema=schema)

    return run


def top_k(vectors: DataFrame, k: int = 5, *, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The ``k`` highest integer inner products of every query: query_id, rank, vec_id, score; ties to the smaller id.

    Components become ``floor(scale * x)``. Queries are the rows whose id is divisible by ``every``, candidates all
    rows with another id than the query's. Rows are ordered by nearest code (fitted on a bounded sample), so that
    ranges of that order hold similar vectors; ``BLOCK`` rows in that order are one block with its forward index. A query's own
    block gives a score that k documents reach. Then each shard of blocks takes the queries past it, block by
    block in falling order of bound, until the bound falls below the k-th score; the shards' results are merged.

    Vectors that are null or hold a null or non-finite component, and rows with a null id, take no part. Only vectors of one
    length are compared; an empty vector scores 0 with any other empty one. A repeated row is a candidate as often as it
    occurs and asks once; rows of one id with different vectors ask one by one, each with a ranking of its own. With
    fewer candidates all are returned. An empty table gives an empty result. Scores must fit 64 bits, else an error is raised.
    """
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(complete("v"), F.lit(False)))
    rows = rows.withColumn("size", F.size("v"))
    codes: dict[int, np.ndarray] = {}
    for row in rows.groupBy("size").count().collect():
        sample = rows.where(F.col("size") == row["size"]).select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        points = np.array([r.v for r in sample])
        codes[row["size"]] = _codebook(points, min(CODES, len(points)), np.random.default_rng(5)) if row["size"] else points

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = {"id": batch.column(0), "v": [], "code": [], "size": batch.column(2)}
            for value in batch.column(1).to_pylist():
                v = np.array(value, dtype=np.float64)
                centres = codes[len(v)]
                out["code"].append(int(((centres ** 2).sum(1) - 2 * centres @ v).argmin()) if len(v) else 0)
                out["v"].append(np.floor(scale * v))
            return out

        return work

    coded = map_arrow(rows, make, "id long, v array<double>, code int, size int")
    coded = coded.groupBy("size", "code", "id", "v").agg(F.count(F.lit(1)).alias("copies"))
    coded = stored(coded, "topk-rows")
    built = (coded.repartitionByRange("size", "code", "id").sortWithinPartitions("size", "code", "id").select("id", "v", "copies")
             .mapInArrow(_build(k, every), "kind int, size int, names binary, vals binary, more binary"))
    built = stored(built, "topk-blocks")
    shards = {r["size"]: max(1, -(-r["count"] // SHARD_BLOCKS)) for r in built.where("kind = 0").groupBy("size").count().collect()}
    if not shards:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    number = F.coalesce(*[F.when(F.col("size") == s, n) for s, n in shards.items()])
    blocks = built.where("kind = 0").withColumn("shard", F.pmod(F.xxhash64("names"), number).cast("int"))
    chunks = built.where("kind = 1").withColumn("shard", F.explode(F.sequence(F.lit(0), number - 1)))
    answers = (blocks.unionByName(chunks).repartition("size", "shard").sortWithinPartitions("size", "shard", "kind")
               .mapInArrow(_answer(k), "query_id long, query binary, vec_id long, score long, copies long"))
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    best = answers.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    best = best.withColumn("before", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies")).where(F.col("before") < k)
    ranks = F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.lit(k)))
    return best.select("query_id", F.explode(ranks.cast("array<int>")).alias("rank"), "vec_id", "score")
