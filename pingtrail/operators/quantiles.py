"""Exact quantiles without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pingtrail.session import measured

ACCURACY = 100_000


def group_quantiles(
    df: DataFrame, by: list[str], value: str, taus: list[float], accuracy: int = ACCURACY
) -> DataFrame:
    """(by.., tau, quantile): exact quantiles, linear interpolation between order statistics.

    A mergeable sketch of fixed size brackets each wanted rank within 8 n / accuracy positions. Only
    values inside a bracket, collapsed to (value, count), are then ranked exactly; the rest are
    merely counted, by their number and the value next to the bracket. Two passes of partial aggregates,
    and the ranked part is a small fixed share of the rows; the way is the same for groups of any size. The brackets
    (one row per group) are written by the first pass. A bracket that missed its rank would raise an error.
    """
    data = df.select(*by, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    # sketch error 1 / accuracy, plus the neighbouring ranks of the interpolation
    margin = 4.0 / accuracy
    probs = [p for t in taus for p in (max(t - margin, 0.0), min(t + margin, 1.0))]
    # the extremes are taken exactly, so that the outer brackets are surely closed
    sketch = data.groupBy(*by).agg(
        F.percentile_approx("v", probs, accuracy).alias("_p"),
        F.min("v").alias("_min"), F.max("v").alias("_max"), F.count(F.lit(1)).alias("_n"),
    )

    def edge(outer: bool, extreme: str, i: int) -> Column:
        return F.col(extreme) if outer else F.col("_p")[i]

    # taus may share a bracket; each distinct one is ranked once
    brackets = F.array_distinct(
        F.array(
            *[
                F.struct(
                    edge(t <= margin, "_min", 2 * i).alias("lo"),
                    edge(t >= 1 - margin, "_max", 2 * i + 1).alias("hi"),
                )
                for i, t in enumerate(taus)
            ]
        )
    )
    wanted = measured(sketch.select(*by, F.col("_n"), brackets.alias("_b")))
    if by:
        on = None
        for c in by:
            same = data[c].eqNullSafe(wanted[c])
            on = same if on is None else on & same
        rows = data.join(wanted, on).drop(*[wanted[c] for c in by])
    else:
        # one row: read as scalar subqueries, so the data side keeps its partitioning
        rows = data.withColumns(
            {"_n": wanted.select("_n").scalar(), "_b": wanted.select("_b").scalar()}
        )
    # a record per row and bracket; on either side of it rows are only counted, and the nearest value kept: interpolation
    # may need the one order statistic next to the bracket
    spread = rows.select(*by, "_n", "v", F.explode("_b").alias("b"))
    side = F.when(F.col("v") < F.col("b.lo"), -1).when(F.col("v") > F.col("b.hi"), 1).otherwise(0)
    counts = spread.withColumn("_side", side).groupBy(
        *by, "_n", "b", "_side", F.when(F.col("_side") == 0, F.col("v")).alias("x")
    ).agg(F.count(F.lit(1)).alias("c"), F.max("v").alias("_most"), F.min("v").alias("_least"))
    upto = (
        Window.partitionBy(*by, "_n", "b").orderBy("_side", "x")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last = F.sum("c").over(upto) - 1
    placed = counts.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("c") + 1).select(
        *by, "_n", "b",
        F.when(F.col("_side") < 0, F.col("_most")).when(F.col("_side") > 0, F.col("_least"))
        .otherwise(F.col("x")).alias("x"),
        F.when(F.col("_side") < 0, F.col("_last")).otherwise(F.col("_first")).alias("_from"),
        F.when(F.col("_side") > 0, F.col("_first")).otherwise(F.col("_last")).alias("_to"),
    )

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank <= F.col("_to")), F.col("x")))

    h = [(F.col("_n") - 1) * float(t) for t in taus]
    picked = placed.groupBy(*by, "_n", "b").agg(
        *[value_at(F.floor(x)).alias(f"_lo{i}") for i, x in enumerate(h)],
        *[value_at(F.ceil(x)).alias(f"_hi{i}") for i, x in enumerate(h)],
    )
    results = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(float(t)).alias("tau"),
                    (F.col(f"_lo{i}") + (x - F.floor(x)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
                    .alias("quantile"),
                )
                for i, (t, x) in enumerate(zip(taus, h))
            ]
        )
    )
    # null where a bracket lacks the ranks; all brackets that hold them agree
    return picked.select(*by, results.alias("r")).groupBy(
        *by, F.col("r.tau").alias("tau")
    ).agg(
        F.coalesce(F.max("r.quantile"), F.raise_error("a bracket missed its rank").cast("double")).alias("quantile")
    )


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """min, quartiles, mean, max and null count of each numeric column, one row per column."""
    long = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                    for c in columns
                ]
            )
        ).alias("s")
    ).select("s.*")
    basic = long.groupBy("column").agg(
        F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"),
        F.count_if(F.col("v").isNull()).alias("nulls"),
    )
    quartiles = group_quantiles(long, ["column"], "v", [0.25, 0.5, 0.75])
    wide = quartiles.groupBy("column").agg(
        *[
            F.max(F.when(F.col("tau") == t, F.col("quantile"))).alias(name)
            for t, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
        ]
    )
    return basic.join(wide, "column", "left").select(
        "column", "min", "q1", "median", "mean", "q3", "max", "nulls"
    )
