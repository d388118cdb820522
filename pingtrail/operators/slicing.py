"""Ordered per-key computations that survive a key holding a large share of the rows.

A plain ``Window.partitionBy(key)`` puts all rows of one key in one task. Here each key's time line
is cut into slices of ``slice_s`` seconds, the window runs per (key, slice), and only a bounded
number of edge values per slice is reconciled across slices. The shuffle key is therefore
(key, slice): a hot key is spread over as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from pingtrail.functions.timeutil import micros, us_of

HOUR = 3600.0


def slice_of(ts: str, slice_s: float) -> Column:
    us = micros(ts)
    step = F.lit(us_of(slice_s))
    return (us - F.pmod(us, step)) / step


def with_slice(df: DataFrame, ts: str, slice_s: float) -> DataFrame:
    """Append ``_slice``. It is never null, so a join on it infers no null filter on one side only,
    which would keep the two readings of a sliced table from sharing their exchange."""
    return df.withColumn("_slice", F.coalesce(slice_of(ts, slice_s).cast("bigint"), F.lit(0)))


def with_neighbours(
    df: DataFrame,
    key: list[str],
    ts: str,
    order: list[Column],
    reach: int,
    derive: Callable[[WindowSpec], dict[str, Column]],
    slice_s: float = HOUR,
    sliced: bool = False,
) -> DataFrame:
    """Append lag/lead columns of at most ``reach`` rows, exactly as over the whole key.

    ``order`` must start with ``ts`` ascending. Rows with ``reach`` neighbours on both sides inside
    their slice are finished there. For the first and last ``reach`` rows of a slice, the first and
    last 2 x ``reach`` rows of all slices form a short sequence per key in which their neighbours
    are still adjacent: a slice's head follows the previous slice's tail, and its own next rows are
    kept too. Both branches read the same exchange. ``sliced`` rows have their ``_slice`` already, as stored tables do.
    """
    near = Window.partitionBy(*key, "_slice").orderBy(*order)
    far = Window.partitionBy(*key).orderBy(*order)
    names = list(derive(near))
    one = F.lit(1)

    def ends(n: int) -> Column:
        return F.lag(one, n).over(near).isNull() | F.lead(one, n).over(near).isNull()

    marked = (df if sliced else with_slice(df, ts, slice_s)).withColumns(
        {**derive(near), "_edge": ends(reach), "_rim": ends(2 * reach)}
    )
    inner = marked.where(~F.col("_edge"))
    rim = marked.where("_rim").drop(*names).withColumns(derive(far)).where("_edge")
    return inner.unionByName(rim).drop("_edge", "_rim", "_slice")


def with_halo(
    df: DataFrame,
    key: list[str],
    ts: str,
    order: list[Column],
    halo_s: float,
    derive: Callable[[WindowSpec], dict[str, Column]],
    slice_s: float = HOUR,
) -> DataFrame:
    """Append lag/lead columns that only matter up to ``halo_s`` seconds away.

    Rows within ``halo_s`` of a slice border are lent to the slice beyond it, so every row meets all
    its neighbours in that range: one exchange and one window, no second pass. A neighbour further
    away may be missing (null), so conditions must treat null as "too far".
    """
    us, step, halo = micros(ts), us_of(slice_s), us_of(halo_s)
    cell = lambda c: F.floor(c / F.lit(step)).cast("bigint")
    lent = df.withColumn("_slice", F.explode(F.sequence(cell(us - halo), cell(us + halo))))
    near = Window.partitionBy(*key, "_slice").orderBy(*order)
    seen = lent.withColumns(derive(near))
    return seen.where(F.col("_slice") == cell(us)).drop("_slice")


def running_total(
    df: DataFrame,
    key: list[str],
    order: list[Column],
    value: str,
    out: str,
    slice_col: str = "_slice",
) -> DataFrame:
    """Inclusive running sum of ``value`` per key: sum inside the slice plus earlier slices' total.

    The per-key window only sees one row per slice.
    """
    near = (
        Window.partitionBy(*key, slice_col)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*key)
        .orderBy(slice_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = df.groupBy(*key, slice_col).agg(F.sum(value).alias("_total"))
    base = totals.select(
        *key, slice_col, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base")
    )
    local = df.withColumn("_local", F.sum(value).over(near))
    return (
        local.join(base, [*key, slice_col])
        .withColumn(out, F.col("_local") + F.col("_base"))
        .drop("_local", "_base")
    )
