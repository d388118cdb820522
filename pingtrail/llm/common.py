"""Table reading, shared storage, bounded samples and connected components for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

# Batches handed to Python workers: rows and bytes, whichever is reached first.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; only one-machine sessions without it get a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pingtrail-llm-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, and the planner sees its true size."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow_parts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: StructType | str) -> DataFrame:
    """Map each record batch to any number of batches by the generator that ``make`` returns in each task (set-up is done once a task)."""
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, target = make(), to_arrow_schema(schema)
        for batch in batches:
            for out in work(batch):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
                     for c, f in ((out[f.name], f) for f in target)], schema=target)

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: StructType | str) -> DataFrame:
    """Map record batches by the function that ``make`` returns in each task; None gives nothing."""
    def one_each():
        work = make()
        return lambda batch: (out for out in [work(batch)] if out is not None)

    return map_arrow_parts(df, one_each, schema)


def remainder_of_id(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def winning_hashes(pairs: DataFrame, per_group: int, most_groups: int = 1000) -> DataFrame:
    """At most ``per_group`` text hashes of each group, picked by content so that copies count once.

    ``pairs`` has columns label and hash. The hashes of a label are dealt into ``per_group`` cells and the smallest of a
    cell stays, so only numbers are aggregated and no label is gathered anywhere. The result is a local table of
    ``per_group * most_groups`` rows at most; more labels raise an error.
    """
    chosen = (pairs.where("label IS NOT NULL AND hash IS NOT NULL")
              .groupBy("label", F.pmod("hash", F.lit(per_group)).alias("cell")).agg(F.min("hash").alias("hash")).select("label", "hash"))
    rows = chosen.limit(per_group * most_groups + 1).collect()
    if len(rows) > per_group * most_groups:
        raise ValueError(f"more than {most_groups} labels")
    return pairs.sparkSession.createDataFrame(rows, chosen.schema)


def texts_of(docs: DataFrame, text: str, winners: DataFrame) -> DataFrame:
    """label, hash and text of the winning hashes, each once; the bounded winners come to the texts, which do not move."""
    hashed = docs.select(F.col(text).alias("text")).where("text IS NOT NULL").withColumn("hash", F.xxhash64("text"))
    return hashed.join(F.broadcast(winners), "hash").dropDuplicates(["label", "hash"]).select("label", "hash", "text")


def cut_by_content(data: bytes, most: int = 256, block: int = 1 << 16) -> Iterator[bytes]:
    """``data`` in pieces of some 50 bytes, ``most`` at most, that end where the last eight bytes have a certain hash.

    Ends are after white space, or anywhere in scripts without it (eight bytes beyond ASCII). Equal passages fall into equal
    pieces wherever they stand, but for the pieces at their borders.
    """
    start = 0
    for at in range(0, len(data), block):
        begin = max(0, at - 7)
        codes = np.frombuffer(data[begin:at + block], dtype=np.uint8)
        n = max(0, len(codes) - 7)
        eight, wide = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
        for i in range(8):
            eight = eight << np.uint64(8) | codes[i:i + n]
            wide &= codes[i:i + n] >= 0x80
        mixed = eight * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)
        blank = codes[7:] <= 0x20
        ends = np.flatnonzero(blank & (mixed < 8) | wide & (mixed == 0)) + begin + 8
        for end in [*ends.tolist(), *([len(data)] if at + block >= len(data) else [])]:
            for cut in range(start, end, most):
                yield data[cut:min(cut + most, end)]
            start = end


def water_level(sizes: list[int], total: int) -> int:
    """The largest share that each of ``sizes`` may take so that all shares together stay within ``total``."""
    left = total
    for i, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - i) > left:
            return left // (len(sizes) - i)
        left -= n
    return max(sizes, default=0)


def sampled_pieces(sample: DataFrame, encoded: Callable[[str], bytes], total_bytes: int, name: str) -> dict:
    """For each label the parts that its sampled texts give to a dictionary of at most ``total_bytes``, in order of text hash.

    ``sample`` has label, hash and text. Whole texts are cut by content, and a piece that occurs in several places of a label
    counts once, in the text of least hash. If a label's pieces are too many, each text gives the pieces of least hash, up to
    a share that is the same for all its texts and leaves no room that longer texts could use.
    """
    schema = StructType([sample.schema["label"], sample.schema["hash"], StructField("at", LongType()), StructField("piece", BinaryType())])

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            row, at, piece = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for k, part in enumerate(cut_by_content(encoded(text))):
                    row.append(i)
                    at.append(k)
                    piece.append(part)
            index = pa.array(row, pa.int64())
            return {"label": batch.column(0).take(index), "hash": batch.column(1).take(index), "at": at, "piece": piece}

        return work

    cut = map_arrow(sample.select("label", "hash", "text"), make, schema)
    once = cut.groupBy("label", "piece").agg(F.min(F.struct("hash", "at")).alias("first")).select("label", "first.*", "piece")
    once = stored(once, name)
    sizes = defaultdict(list)
    for r in once.groupBy("label", "hash").agg(F.sum(F.length("piece")).alias("n")).collect():
        sizes[r.label].append(r.n)
    rooms = once.sparkSession.createDataFrame([(k, water_level(v, total_bytes)) for k, v in sizes.items()],
                                              StructType([once.schema["label"], StructField("room", LongType())]))
    picked = Window.partitionBy("label", "hash").orderBy(F.xxhash64("piece"), "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = once.withColumn("before", F.sum(F.length("piece")).over(picked) - F.length("piece")).join(F.broadcast(rooms), "label")
    # cut in the JVM: one long text must not reach the driver whole
    taken = placed.where("before < room").select("label", "hash", "at", F.expr("substring(piece, 1, int(room - before))").alias("piece"))
    found: dict = defaultdict(lambda: defaultdict(bytes))
    for r in sorted(taken.collect(), key=lambda r: (r.label, r.hash, r["at"])):
        found[r.label][r.hash] += bytes(r.piece)
    return {label: list(parts.values()) for label, parts in found.items()}


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge: columns node, root.

    ``edges`` has columns a and b of one orderable type. Each round every node points at its smallest
    neighbour, pointers are followed once, and the edges are contracted to the pointers; pairs that met
    vanish, so the edge table shrinks each round. Edges and pointers stay distributed and are written to
    shared storage each round.
    """
    edges = stored(edges.select("a", "b").where("a <> b").dropDuplicates(["a", "b"]), f"{name}-edges")
    roots: DataFrame | None = None
    for round_no in range(most_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = stored(least, f"{name}-least{round_no}")
        onward = least.select(F.col("a").alias("m"), F.col("m").alias("m2"))
        point = stored(least.join(onward, "m").select("a", F.col("m2").alias("m")), f"{name}-point{round_no}")
        if roots is None:
            roots = point.select(F.col("a").alias("node"), F.col("m").alias("root"))
        else:
            moved = roots.join(point.select(F.col("a").alias("root"), "m"), "root", "left")
            roots = stored(moved.select("node", F.coalesce("m", "root").alias("root")), f"{name}-roots{round_no}")
        pa_, pb = point.select("a", F.col("m").alias("ra")), point.select(F.col("a").alias("b"), F.col("m").alias("rb"))
        met = edges.join(pa_, "a").join(pb, "b").where("ra <> rb")
        edges = stored(met.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
                       .dropDuplicates(["a", "b"]), f"{name}-edges{round_no}")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if roots is None:
        roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def component_of_class(rows: DataFrame, edges: DataFrame, name: str, *, id_column: str, class_column: str) -> DataFrame:
    """Columns ``class_column``, copies, component_id of the classes that have several rows or a link.

    ``rows`` has a row's id and class; equal classes belong together, ``edges`` (a, b) link classes. The component id is
    the smallest id among all rows that can be reached. Classes left out are alone with their own id.
    """
    sizes = stored(rows.groupBy(class_column).agg(F.count(F.lit(1)).alias("copies"), F.min(id_column).alias("least_id")), f"{name}-classes")
    roots = components(edges, name).select(F.col("node").alias(class_column), "root")
    rooted = stored(roots.join(sizes, class_column), f"{name}-rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = rooted.join(least, "root").select(class_column, "copies", "component_id")
    alone = sizes.where("copies > 1").join(rooted.select(class_column), class_column, "left_anti")
    return stored(linked.unionByName(alone.select(class_column, "copies", F.col("least_id").alias("component_id"))), f"{name}-members")
