"""Near-duplicate vectors by an inverted multi-index (operator 3)."""

from __future__ import annotations

import hashlib
import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pingtrail.llm.common import component_of_class, map_arrow, stored

# Distinct vectors that the codebooks and the reach of the traversal are fitted on, at most.
SAMPLE = 20_000
# Wanted distinct vectors a cell, and most home vectors that are compared as one block.
PER_CELL, BLOCK = 256, 1024
MOST_CODES = 1024


def usable(vector: str) -> Column:
    """The vector is there, not empty, without null or non-finite components, and not zero."""
    c = F.col(vector)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda x: x != 0)


@dataclass(frozen=True)
class MultiIndex:
    """Independent codebooks of the two halves of unit vectors; a cell of the product grid is ``i * codes + j``."""

    left: np.ndarray
    right: np.ndarray
    reach: float  # the traversal stops at cells that are farther than the home cell by more than this

    def costs(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each half to its codes, less the smallest one."""
        half = units.shape[1] // 2
        out = []
        for part, codes in ((units[:, :half], self.left), (units[:, half:], self.right)):
            d = (part ** 2).sum(1)[:, None] - 2 * part @ codes.T + (codes ** 2).sum(1)[None]
            out.append(d - d.min(1, keepdims=True))
        return out[0], out[1]

    def home(self, units: np.ndarray) -> np.ndarray:
        a, b = self.costs(units)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def visits(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Cells of one vector by multi-sequence traversal: nearest first, as long as they are within reach."""
        by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        cost_a, cost_b = a[by_a], b[by_b]
        heap, pushed, out = [(cost_a[0] + cost_b[0], 0, 0)], {(0, 0)}, []
        while heap and heap[0][0] <= self.reach:
            _, i, j = heapq.heappop(heap)
            out.append(int(by_a[i]) * len(self.right) + int(by_b[j]))
            for i2, j2 in ((i + 1, j), (i, j + 1)):
                if i2 < len(a) and j2 < len(b) and (i2, j2) not in pushed:
                    pushed.add((i2, j2))
                    heapq.heappush(heap, (cost_a[i2] + cost_b[j2], i2, j2))
        return out


def _codebook(points: np.ndarray, codes: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = points[rng.choice(len(points), codes, replace=False)]
    for _ in range(rounds):
        nearest = ((centres ** 2).sum(1)[None] - 2 * points @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=codes)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def fit(units: np.ndarray, vectors: int, cosine: float, recall: float, seed: int = 7) -> MultiIndex:
    """Codebooks from sampled unit vectors, and the reach at which the traversal finds ``recall`` of the neighbours.

    The grid gets about ``PER_CELL`` of ``vectors`` a cell. The reach is measured: each sampled vector is turned by the widest
    allowed angle in random directions and in those of single axes, and the reach covers the wanted share of the cells
    where these neighbours lie.
    """
    rng = np.random.default_rng(seed)
    half = units.shape[1] // 2
    codes = int(min(MOST_CODES, max(1, round(math.sqrt(vectors / PER_CELL))), len(units)))
    index = MultiIndex(_codebook(units[:, :half], codes, rng), _codebook(units[:, half:], codes, rng), 0.0)
    trial = units[rng.choice(len(units), min(4000, len(units)), replace=False)]
    directions = np.where((np.arange(len(trial)) % 4 == 0)[:, None], np.eye(units.shape[1])[rng.integers(0, units.shape[1], len(trial))],
                          rng.normal(size=trial.shape))
    directions -= (directions * trial).sum(1, keepdims=True) * trial
    lengths = np.linalg.norm(directions, axis=1, keepdims=True)
    turned = cosine * trial + math.sqrt(max(0.0, 1 - cosine * cosine)) * directions / np.where(lengths > 0, lengths, 1)
    a, b = index.costs(trial)
    cell = index.home(turned)
    rows = np.arange(len(trial))
    needed = a[rows, cell // len(index.right)] + b[rows, cell % len(index.right)]
    return MultiIndex(index.left, index.right, float(np.quantile(needed, recall, method="higher")))


def _spanning(linked: np.ndarray) -> np.ndarray:
    """Smallest reachable row of each row of a symmetric link matrix."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(cosine: float):
    """Streams units (home block first, then its visitors): neighbours found by class, and links that keep what is connected."""

    def run(batches):
        unit, homes, block, counts, names, label, seen = None, [], None, None, [], None, None
        schema = pa.schema([("class", pa.binary()), ("found", pa.int64()), ("other", pa.binary())])

        def rows(items):
            cls, found, other = zip(*items, strict=True) if items else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(found, pa.int64()), pa.array(other, pa.binary())], schema=schema)

        def close_homes():
            nonlocal block, counts, names, label, seen
            names = [h[0] for h in homes]
            copies = np.array([h[1] for h in homes], dtype=np.int64)
            block = np.array([h[2] for h in homes])
            linked = block @ block.T >= cosine
            np.fill_diagonal(linked, False)
            counts = linked @ copies
            label = _spanning(linked)
            seen = copies
            return [(names[i], 0, names[label[i]]) for i in range(len(names)) if label[i] != i]

        def visit(guests):
            matrix = np.array([g[2] for g in guests])
            linked = matrix @ block.T >= cosine
            out = []
            copies = np.array([g[1] for g in guests], dtype=np.int64)
            counts[:] += copies @ linked
            for i in np.flatnonzero(linked.any(1)):
                near = np.flatnonzero(linked[i])
                for k, root in enumerate(np.unique(label[near])):
                    out.append((guests[i][0], int(seen[near].sum()) if k == 0 else 0, names[root]))
            return out

        def finish():
            return [(n, int(c), None) for n, c in zip(names, counts, strict=True) if c]

        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keys = list(zip(cols["bucket"].to_pylist(), cols["cell"].to_pylist(), cols["block"].to_pylist(), strict=True))
            guest, cls, copies = cols["guest"].to_pylist(), cols["class"].to_pylist(), cols["copies"].to_pylist()
            unitv = [np.frombuffer(v, dtype=np.float64) for v in cols["unit"].to_pylist()]
            items, waiting = [], []
            for i, key in enumerate(keys):
                if key != unit:
                    if waiting:
                        items += visit(waiting)
                        waiting = []
                    if unit is not None:
                        items += (close_homes() if block is None and homes else []) + (finish() if homes else [])
                    unit, homes, block, counts, names = key, [], None, None, []
                row = cls[i], copies[i], unitv[i]
                if not guest[i]:
                    homes.append(row)
                elif homes:
                    if block is None:
                        items += close_homes()
                    waiting.append(row)
            if waiting:
                items += visit(waiting)
            if items:
                yield rows(items)
        if homes:
            yield rows((close_homes() if block is None else []) + finish())

    return run


def near_duplicate_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", *,
                           cosine: float = 0.98, recall: float = 0.9995) -> DataFrame:
    """One row a vector: its id, n_links, component_id and kept, for links of ``cosine`` or more within a label.

    Codebooks are fitted on a bounded sample (``SAMPLE`` distinct vectors); every vector is indexed. Equal vectors of a label are one
    class with a number of copies. A class lies in its home cell and visits, by multi-sequence traversal, the cells within
    the reach that gives the wanted recall; a pair of cells is visited from the smaller to the larger one only. Home classes of a
    cell are split into blocks of about ``BLOCK`` by hash, and visitors stream past a block, so neither a crowded cell
    nor a vector with very many neighbours is gathered anywhere. Every pair met is verified by its cosine in double precision.
    Blocks give numbers of neighbours and the links that keep them connected, not all pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with nothing.
    Only vectors of one length are compared. Repeated rows count as vectors of their own. Null ids can be
    members and name no component. An empty table gives an empty result. Other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    fit_for_use = F.col("label").isNotNull() & usable("v")
    rows = rows.withColumn("ok", F.coalesce(fit_for_use, F.lit(False)))

    def make_units():
        def work(batch: pa.RecordBatch) -> dict:
            ids, labels, values = (c for c in batch.columns)
            units, names, buckets = [], [], []
            for lab, value in zip(labels.to_pylist(), values.to_pylist(), strict=True):
                v = np.array(value, dtype=np.float64)
                name = hashlib.md5(repr(lab).encode() + b"|" + (v + 0.0).tobytes()).digest()
                v = v / np.abs(v).max()  # squares of tiny or huge components must not vanish or overflow
                units.append((v / np.linalg.norm(v)).tobytes())
                names.append(name)
                buckets.append(f"{lab}|{len(v)}")
            return {"id": ids, "bucket": buckets, "class": names, "unit": units}

        return work

    id_type = vectors.schema[vec_id].dataType.simpleString()
    good = stored(map_arrow(rows.where("ok").select("id", "label", "v"), make_units,
                            f"id {id_type}, bucket string, class binary, unit binary"), "vectors")
    classes = stored(good.groupBy("class").agg(F.first("bucket").alias("bucket"), F.first("unit").alias("unit"),
                                               F.count(F.lit(1)).alias("copies")), "vector-classes")
    indexes: dict[int, MultiIndex] = {}
    for row in classes.groupBy(F.octet_length("unit").alias("size")).count().collect():
        sample = (classes.where(F.octet_length("unit") == row["size"]).select("unit", "class").orderBy("class").limit(SAMPLE).collect())
        indexes[row["size"]] = fit(np.array([np.frombuffer(r.unit, np.float64) for r in sample]), row["count"], cosine, recall)

    def make_visits():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("row", "cell", "guest")}
            units = batch.column(batch.schema.get_field_index("unit")).to_pylist()
            for i, raw in enumerate(units):
                index, unit = indexes[len(raw)], np.frombuffer(raw, np.float64)[None]
                a, b = index.costs(unit)
                home = int(a[0].argmin()) * len(index.right) + int(b[0].argmin())
                cells = [c for c in index.visits(a[0], b[0]) if c > home]
                out["row"] += [i] * (1 + len(cells))
                out["cell"] += [home, *cells]
                out["guest"] += [False] + [True] * len(cells)
            taken = pa.array(out["row"], pa.int64())
            return {c: batch.column(k).take(taken) for k, c in enumerate(batch.schema.names)} | {"cell": out["cell"], "guest": out["guest"]}

        return work

    placed = stored(map_arrow(classes, make_visits, "class binary, bucket string, unit binary, copies long, cell long, guest boolean"), "vector-cells")
    crowd = placed.where("NOT guest").groupBy("bucket", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    at = placed.join(crowd, ["bucket", "cell"])  # cells without a home vector need no visit
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    homes = at.where("NOT guest").withColumn("own", own)
    across = homes.where("own + 1 < blocks").withColumn("guest", F.lit(True)).withColumn(
        "block", F.explode(F.sequence(F.col("own") + 1, F.col("blocks") - 1)))
    guests = at.where("guest").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["bucket", "cell", "block", "guest", "class", "copies", "unit"]
    units = homes.withColumn("block", F.col("own")).select(columns).unionByName(across.select(columns)).unionByName(guests.select(columns))
    met = (units.repartition("bucket", "cell", "block").sortWithinPartitions("bucket", "cell", "block", "guest")
           .mapInArrow(_compare(cosine), "class binary, found long, other binary"))
    met = stored(met, "vector-links")
    found = met.groupBy("class").agg(F.sum("found").alias("found"))
    edges = met.where("other IS NOT NULL").select(F.col("class").alias("a"), F.col("other").alias("b"))
    members = component_of_class(good, edges, "vectors", id_column="id", class_column="class")
    linked = (good.join(found, "class", "left").join(members, "class", "left")
              .select("id", (F.coalesce("found", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id")))
    bare = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(bare).select(F.col("id").alias(vec_id), "n_links", "component_id",
                                           F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
