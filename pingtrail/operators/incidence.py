"""Dense form of the incidence of tags and points: numbered points, and one bitmap a tag and block of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pingtrail.operators.aggregates import incidence
from pingtrail.session import measured

POINT = ["tsCorrected", "recvDeployLat", "recvDeployLon"]


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Append numbers from 1 without gaps in the order of ``order``, nulls first; rows differ in these columns.

    Range partitions are sorted and written once, each row with its place in its partition. A second pass counts the rows of
    each partition; only these counts, one a partition, come together to give each partition its first number.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = measured(ranged).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("_part", "n")).alias("sizes"))
    firsts = sizes.select(F.explode(F.transform("sizes", lambda p: F.struct(
        p["_part"].alias("_part"),
        F.aggregate(F.filter("sizes", lambda q: q["_part"] < p["_part"]), F.lit(1).cast("bigint"), lambda n, q: n + q["n"]).alias("_first"),
    )))).select("col.*")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(measured(firsts), "_part").withColumn(out, F.col("_first") + within).drop("_at", "_part", "_first")


def incidence_points(kept: DataFrame, keys: list[str] = POINT) -> DataFrame:
    """The columns of the dense form: each point of a sparse incidence with point_id, from 1 in order of ``keys``, and n_tags.

    Points that only left-out tags have are not there, so no column is zero.
    """
    return numbered(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tags")), keys, "point_id")


def incidence_blocks(kept: DataFrame, points: DataFrame, keys: list[str] = POINT, tag: str = "motusTagID") -> DataFrame:
    """The rows of the dense form in blocks: tag, block, bits, n_present; blocks without presence are left out.

    ``kept`` is a sparse incidence and ``points`` its numbered points. Bit (point_id - 1) % 32768 of block
    1 + (point_id - 1) div 32768 is set where the tag is present. Cells are shuffled as numbers, at most 32,768 a (tag, block),
    and become bitmaps in the order they are sorted in: a task holds one bitmap at a time, and bitmaps are neither shuffled nor
    sorted. Shuffled as bitmaps, sparse ones would compress so well that one task got gigabytes of them. Null coordinates are
    values like others.
    """
    point = F.struct(*keys).alias("_point")
    placed = kept.select(tag, point).join(points.select(point, "point_id"), "_point").select(
        tag, F.bitmap_bucket_number("point_id").alias("block"), F.bitmap_bit_position("point_id").alias("_at"))
    blocks = placed.repartition(tag, "block").groupBy(tag, "block").agg(F.bitmap_construct_agg("_at").alias("bits"))
    return blocks.withColumn("n_present", F.bitmap_count("bits"))


def dense_incidence(
    df: DataFrame, keys: list[str] = POINT, min_points: int = 5, tag: str = "motusTagID",
) -> tuple[DataFrame, DataFrame]:
    """Blocks and points of the tags with ``min_points`` points or more; nothing is pivoted or gathered."""
    kept = measured(incidence(df, keys, min_points, tag).select(tag, *keys))
    points = measured(incidence_points(kept, keys))
    return incidence_blocks(kept, points, keys, tag), points


def set_in_both(a: str, b: str) -> Column:
    """Number of bits set in both of two bitmaps of 4 KiB: words of 8 bytes are met where both have a bit."""
    def part(bits: str, at: Column, n: int) -> Column:
        return F.substr(F.col(bits), at, F.lit(n))

    def filled(n: int):
        none = F.unhex(F.lit("00" * n))
        return lambda at: (part(a, at, n) != none) & (part(b, at, n) != none)

    def word(bits: str, at: Column) -> Column:
        return F.conv(F.hex(part(bits, at, 8)), 16, -10).cast("bigint")

    # runs of 64 bytes first, as sparse bitmaps have few of them
    runs = F.filter(F.sequence(F.lit(1), F.lit(4033), F.lit(64)), filled(64))
    words = F.filter(F.flatten(F.transform(runs, lambda at: F.sequence(at, at + 56, F.lit(8)))), filled(8))
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda n, at: n + F.bit_count(word(a, at).bitwiseAND(word(b, at))))


def tag_sums(blocks: DataFrame, points: DataFrame, tag: str = "motusTagID") -> DataFrame:
    """Per tag: n_points by bit counts, and n_alone, its points that no other tag has, from the points' own sums.

    The points of one tag only form a bitmap a block, one bit a point; these are written once, so that the planner knows their
    size, and joined to the tags' blocks by block number. Both bitmaps of a (tag, block) are met in their row, so they are not
    sorted and no bit is unpacked into rows.
    """
    single = measured(points.where("n_tags = 1").groupBy(F.bitmap_bucket_number("point_id").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("point_id")).alias("alone")))
    met = blocks.join(single, "block", "left").withColumn(
        "n_alone", F.when(F.col("alone").isNull(), F.lit(0).cast("bigint")).otherwise(set_in_both("bits", "alone")))
    return met.groupBy(tag).agg(F.sum("n_present").alias("n_points"), F.sum("n_alone").alias("n_alone"))
