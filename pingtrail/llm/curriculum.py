"""Mixing sources to target weights by a curriculum that changes over training (operator 11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pingtrail.llm.common import stored

WORDS = r"[^\x20\x09-\x0D]+"
# Rows that one task makes of one repeated row at a time.
REPEATS = 10_000


def words(text: str = "text") -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def ramp(weight: Column, tilt: Column) -> Column:
    """A schedule that goes straight from ``weight * (1 + tilt)`` to ``weight * (1 - tilt)``; its integral is ``weight``."""
    def knot(time, w):
        return F.struct(F.lit(time).alias("time"), w.cast("double").alias("weight"))

    return F.array(knot(0.0, weight * (1 + tilt)), knot(1.0, weight * (1 - tilt)))


def cycled(source_rank: Column) -> Column:
    """Weights 1, 2, 3, repeating; the lightest sources come late, the heaviest early."""
    turn = (source_rank % 3).cast("int")
    return ramp((turn + 1).cast("double"), (turn - 1) * F.lit(0.5))


def _ranked(sources: DataFrame) -> DataFrame:
    """``source_rank`` from 0 by code point, null last; no task sees more than its range of the sources."""
    placed = stored(sources.orderBy(F.col("key.source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()), "mix-sources")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    first = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    return (placed.join(F.broadcast(first), "part")
            .withColumn("source_rank", F.col("first") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "place", "first"))


def _integrated(sources: DataFrame) -> DataFrame:
    """``cums``, the integral of the schedule up to each knot, and ``weight``, the whole of it."""
    areas = F.expr("transform(slice(knots, 2, size(knots) - 1), (k, i) -> (k.time - knots[i].time) * (k.weight + knots[i].weight) / 2)")
    return (sources.withColumn("areas", areas)
            .withColumn("cums", F.expr("transform(knots, (k, i) -> aggregate(slice(areas, 1, i), 0D, (s, a) -> s + a))"))
            .withColumn("weight", F.expr("element_at(cums, -1)")).drop("areas"))


def _targets(sources: DataFrame, total: int | None, most_repeats: int) -> DataFrame:
    """``target`` of each source: its share by weight, at most its cap; the excess is shared again by weight.

    The water level is found by Newton steps from below. Each is one aggregate over the sources that gives three numbers.
    """
    cap = F.col("source_size") * most_repeats
    sums = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight"),
                       F.min(F.array_min(F.transform("knots", lambda k: k["weight"]))).alias("least")).first()
    if sums.least is not None and sums.least < 0:
        raise ValueError("a schedule has a negative weight")
    share, open_weight, count = (total if total is not None else sums.size) or 0, sums.weight or 0.0, -1
    free = share
    while True:
        full = (cap <= F.col("weight") * F.lit(float(free)) / F.lit(open_weight)) if open_weight else F.lit(True)
        found = sources.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("capped"),
                            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        if found.n == count or not found.weight:
            break
        free, open_weight, count = share - found.capped, found.weight, found.n
    level = F.col("weight") * F.lit(float(free)) / F.lit(open_weight) if open_weight else F.lit(0.0)
    return sources.withColumn("target", F.when(F.col("weight") > 0, F.when(full, cap.cast("double")).otherwise(level)).otherwise(0.0))


def _time(used: Column) -> Column:
    """The time at which the share ``used`` of a source's demand is reached: the inverse of the schedule's integral.

    Inside a segment the weight is a straight line and its integral a parabola; of its two solutions this form has no cancellation.
    """
    area = used * F.col("weight")
    at = F.least(F.size(F.filter("cums", lambda c: c <= area)), F.size("cums") - 1)
    low, high = F.get("knots", at - 1), F.get("knots", at)
    rest = area - F.get("cums", at - 1)
    slope = F.coalesce(F.try_divide(high["weight"] - low["weight"], high["time"] - low["time"]), F.lit(0.0))
    root = F.sqrt(F.greatest(low["weight"] * low["weight"] + 2 * slope * rest, F.lit(0.0)))
    return low["time"] + F.coalesce(F.try_divide(2 * rest, low["weight"] + root), F.lit(0.0))


def curriculum_mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", size: Column | None = None,
                   schedule=cycled, total: int | None = None, most_repeats: int = 3) -> DataFrame:
    """One row a document in order of its first training position: doc_id, source, size, source_size, source_rank, target,
    taken, position and placements (an array of position and words, one for each time that it is read).

    ``schedule`` gives, for a source's rank (from 0, by code point, null last), its weight over the time from 0 to 1 as knots
    of a broken line. The integral of the schedule is the source's weight; by it the sources share ``total`` (by default the size
    of all documents), each up to ``most_repeats`` times its own size, the excess going to the others. A source's documents stand
    in order of the MD5 of their id and are read over and over until the target (rounded to a whole number) is reached; the last
    one is cut there. The copy that begins after a share u of the target has the position where the integral of the schedule
    reaches u of its whole, so at every moment the sources are drawn as their weights then demand.

    Built-in functions only. Places in a source are sums over cells of about the square root of its documents, so a source
    with a third of all rows is cut like the others; equal rows are counted first and placed together. The text is read once,
    for the sizes. A null or empty text has size 0: it takes nothing and has no position, as documents beyond the target; such rows
    come last. Null ids are placed as the empty text; repeated rows are placed one after the other; a null source is a source.
    An empty table gives an empty result. Other columns are not read. The same rows give the same result.
    """
    size = words() if size is None else size
    plain = docs.select(F.col(doc_id).alias("id"), F.struct(F.col(source).alias("source")).alias("key"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    rows = stored(plain.groupBy("id", "key", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-rows")
    sources = _ranked(rows.groupBy("key").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("members")))
    sources = stored(_integrated(sources.withColumn("knots", schedule(F.col("source_rank")))), "mix-schedules")
    sources = (_targets(sources, total, most_repeats).withColumn("goal", F.floor(F.col("target") + 0.5))
               .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0).cast("long")))
               .withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size"))
               .withColumn("cells", F.ceil(F.sqrt("members"))))
    sources = stored(sources, "mix-targets")

    order = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    dealt = rows.join(sources.select("key", "cells"), "key").withColumn("order", order)
    dealt = dealt.withColumn("cell", F.shiftright(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.col("cells"), 32))
    words_here = F.col("size") * F.col("rows")
    earlier = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("key", "cell").agg(F.sum(words_here).alias("words")).select(
        "key", "cell", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("key", "cell").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (dealt.withColumn("inside", F.sum(words_here).over(inside) - words_here).join(first, ["key", "cell"])
              .select("id", "key", "size", "rows", "order", (F.col("first") + F.col("inside")).alias("start")))
    placed = stored(placed, "mix-places")
    chunks = (placed.where("rows > 1").withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(REPEATS).cast("long"))))
              .repartition("id", "from"))
    each = chunks.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("rows"), F.col("from") + REPEATS) - 1)))
    each = each.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).select(*placed.columns)
    one = placed.where("rows = 1").unionByName(each).join(sources, "key")

    last = F.least(F.greatest(F.col("rest") - F.col("start"), F.lit(0)), F.col("size"))
    reads = F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda k: F.struct(
        _time((k * F.col("source_size") + F.col("start")) / F.greatest("goal", F.lit(1))).alias("position"),
        F.when(k < F.col("passes"), F.col("size")).otherwise(last).alias("words")))
    mixed = (one.withColumn("placements", F.filter(reads, lambda r: r["words"] > 0))
             .withColumn("position", F.get("placements", F.lit(0))["position"])
             .orderBy(F.col("position").asc_nulls_last(), "order", "size"))
    return mixed.select(F.col("id").alias(doc_id), F.col("key.source").alias(source if source != doc_id else "source"), "size", "source_size", "source_rank",
                        "target", (F.col("size") * F.col("passes") + last).alias("taken"), "position", "placements")


def training_order(mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row for each reading of a document, sorted by range of its position: doc_id, position, words, reading (from 0)."""
    read = mixed.select(F.col(doc_id), F.posexplode("placements").alias("reading", "read"))
    return read.select(doc_id, "read.position", "read.words", "reading").orderBy("position", doc_id, "reading")
