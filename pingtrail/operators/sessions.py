"""Gap-based events, station transitions, near-simultaneous detections, pooling and bursts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from pingtrail.functions.timeutil import (
    cut, from_micros, micros, round_time, us_of,
)
from pingtrail.operators.slicing import HOUR, with_halo, with_neighbours, with_slice
from pingtrail.session import checkpointed


#: A key as two columns that are never null.
KEYED = ["_k", "_void"]


def keyed(df: DataFrame, key: str) -> list[Column]:
    """``KEYED`` for a key of numbers or text: its value and whether it is missing.

    Windows and joins on these need no null-safe rewriting, so they share one partitioning and sort as plain columns do.
    """
    filler = F.lit(0).cast(df.schema[key].dataType)
    return [F.coalesce(F.col(key), filler).alias("_k"), F.col(key).isNull().alias("_void")]


def session_marks(
    df: DataFrame, key: str, ts: str, gap: float, slice_s: float = HOUR
) -> DataFrame:
    """(_k, _void, _t, event_id) for each distinct time of a key; a new event starts after a gap > ``gap``.

    The event of a ping depends on its time only, so copies and same-instant pings collapse before
    any window. Windows run per (key, slice); each slice hands on its first and last time and its
    number of starts, one row, from which the numbering offset of the slice follows. Pings without a key
    are a group of their own; a ping without a time has no mark.
    """
    timed = df.where(F.col(ts).isNotNull()).select(*keyed(df, key), F.col(ts).alias("_t")).distinct()
    marks = with_slice(timed, "_t", slice_s)
    near = Window.partitionBy(*KEYED, "_slice").orderBy("_t")
    upto = near.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wide = us_of(gap)
    start = (micros("_t") - micros(F.lag("_t").over(near)) > wide).cast("int")
    local = marks.withColumn("_start", F.coalesce(start, F.lit(0))).withColumn(
        "_n", F.sum("_start").over(upto)
    )
    return local.join(_slice_bases(local, "_t", gap), [*KEYED, "_slice"]).select(
        *KEYED, "_t", (F.col("_base") + F.col("_n")).alias("event_id")
    )


def sessionize(
    df: DataFrame,
    key: str = "motusTagID",
    ts: str = "ts",
    gap: float = 2.5,
    slice_s: float = HOUR,
) -> DataFrame:
    """Append ``event_id``, numbered from 1 per key in time order; identity is (key, event_id).

    Pings without a key are numbered as one group; a ping without a time stays with a null number.
    """
    marks = session_marks(df, key, ts, gap, slice_s)
    timed = df.select("*", *keyed(df, key), F.col(ts).alias("_t"))
    return timed.join(marks, [*KEYED, "_t"], "left").drop(*KEYED, "_t")


def sessionize_sliced(stored: DataFrame, ts: str = "ts", gap: float = 2.5) -> DataFrame:
    """``sessionize`` for a table that ``sinks.write_sliced`` stored: pings stay in their buckets, nothing but slices is shuffled.

    Windows run over the stored (key, slice) groups; each slice hands on one row, from which its first number follows.
    """
    near = Window.partitionBy(*KEYED, "_slice").orderBy(ts)
    upto = near.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = (micros(ts) - micros(F.lag(ts).over(near)) > us_of(gap)).cast("int")
    local = stored.withColumn("_start", F.coalesce(start, F.lit(0))).withColumn("_n", F.sum("_start").over(upto))
    based = local.join(_slice_bases(local, ts, gap), [*KEYED, "_slice"], "left")
    number = F.when(F.col(ts).isNotNull(), F.col("_base") + F.col("_n"))
    return based.withColumn("event_id", number).drop(*KEYED, "_slice", "_start", "_n", "_base")


def _slice_bases(local: DataFrame, ts: str, gap: float) -> DataFrame:
    """(_k, _void, _slice, _base): the number of the event that each slice's first ping belongs to."""
    edges = local.groupBy(*KEYED, "_slice").agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.sum("_start").alias("_starts")
    ).where("_first IS NOT NULL")
    by_slice = Window.partitionBy(*KEYED).orderBy("_slice")
    jump = micros("_first") - micros(F.lag("_last").over(by_slice))
    edges = edges.withColumn("_opens", F.when(jump <= us_of(gap), 0).otherwise(1))
    done = F.sum(F.col("_opens") + F.col("_starts")).over(
        by_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return edges.select(*KEYED, "_slice", (done - F.col("_starts")).alias("_base"))


def event_counts(events: DataFrame, key: str = "motusTagID") -> DataFrame:
    """Per event: first and last time, pings, distinct towers and (tower, port) antennas.

    Pings combine to antennas first, so that an event of any length arrives as a few records; null
    counts as a value. Towers and events then share one exchange.
    """
    return _counted(events, [key, "event_id"])


def _counted(events: DataFrame, event: list[str]) -> DataFrame:
    antennas = events.groupBy(*event, "recvDeployName", "port").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("n_pings"),
    )
    towers = antennas.repartition(*event).groupBy(*event, "recvDeployName").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.sum("n_pings").alias("n_pings"), F.count(F.lit(1)).alias("w_antennas"),
    )
    return towers.groupBy(*event).agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.sum("n_pings").alias("n_pings"), F.count(F.lit(1)).alias("w_towers"),
        F.sum("w_antennas").alias("w_antennas"),
    )


def with_event_counts(events: DataFrame, key: str = "motusTagID") -> DataFrame:
    """Attach the tower and antenna counts of the event to each of its rows."""
    # numbers count from 1, so 0 stands for none
    tagged = events.select("*", *keyed(events, key), F.coalesce("event_id", F.lit(0)).alias("_e"))
    counts = _counted(tagged, [*KEYED, "_e"]).select(*KEYED, "_e", "w_towers", "w_antennas")
    return tagged.join(counts, [*KEYED, "_e"]).drop(*KEYED, "_e")


def transitions(
    df: DataFrame, key: str = "motusTagID", ts: str = "ts", slice_s: float = HOUR
) -> DataFrame:
    """Rows whose station differs from the previous row's in (ts, station, signal desc) order.

    Among rows sharing key, time and station only the first can be a transition, so they are
    reduced to it by a combining aggregate before the ordered pass. Rows without a key are one group.
    """
    return _transitions(df, [key], [key], ts, slice_s, sliced=False)


def transitions_sliced(stored: DataFrame, ts: str = "ts") -> DataFrame:
    """``transitions`` for a table that ``sinks.write_sliced`` stored; only the rims of slices are shuffled."""
    return _transitions(stored, KEYED, [*KEYED, "_slice"], ts, HOUR, sliced=True).drop(*KEYED)


def _transitions(
    df: DataFrame, key: list[str], group: list[str], ts: str, slice_s: float, sliced: bool
) -> DataFrame:
    same = [*group, ts, "recvDeployName"]
    row = F.struct(*[c for c in df.columns if c not in same])
    strongest = F.struct(F.isnull("sig"), -F.col("sig"), F.col("hitID"))
    firsts = (
        df.groupBy(*same)
        .agg(F.min_by(row, strongest).alias("_row"))
        .select(*same, "_row.*")
    )
    order = [F.col(ts).asc(), F.col("recvDeployName").asc_nulls_last()]
    seen = with_neighbours(
        firsts, key, ts, order, 1,
        lambda w: {"_prev": F.lag("recvDeployName").over(w)}, slice_s, sliced,
    )
    return seen.where(F.col("recvDeployName") != F.col("_prev")).drop("_prev")


def _order(df: DataFrame, ts: str) -> list[Column]:
    rest = [c for c in ("recvDeployName", "hitID") if c in df.columns]
    return [F.col(ts).asc(), *[F.col(c).asc_nulls_last() for c in rest]]


def near_simultaneous(
    df: DataFrame,
    back: float = 5,
    fwd: float = 4.9,
    key: str = "motusTagID",
    slice_s: float = HOUR,
) -> DataFrame:
    """Antenna rows, time rounded to the second, close to the previous or the next row of the key.

    Feed it :func:`transitions`; rows without a bearing are removed here, after that step.
    """
    rounded = df.where(F.col("antBearing").isNotNull()).withColumn("ts", round_time("ts", 1))
    now = micros("ts")
    seen = with_halo(
        rounded, [key], "ts", _order(df, "ts"), max(back, fwd),
        lambda w: {
            "_back": now - micros(F.lag("ts").over(w)),
            "_fwd": now - micros(F.lead("ts").over(w)),
        },
        slice_s,
    )
    close = (F.col("_back") < us_of(back)) | F.col("_fwd").between(-us_of(fwd), us_of(fwd))
    return seen.where(close).drop("_back", "_fwd")


def run_of_three(
    df: DataFrame, window: float = 4, key: str = "motusTagID", slice_s: float = HOUR
) -> DataFrame:
    """Rows within ``window`` of both neighbours, or of the second row before or after."""
    now = micros("ts")
    seen = with_halo(
        df, [key], "ts", _order(df, "ts"), window,
        lambda w: {
            "_b1": now - micros(F.lag("ts").over(w)),
            "_b2": now - micros(F.lag("ts", 2).over(w)),
            "_f1": micros(F.lead("ts").over(w)) - now,
            "_f2": micros(F.lead("ts", 2).over(w)) - now,
        },
        slice_s,
    )
    w = us_of(window)
    both = (F.col("_b1") < w) & (F.col("_f1") < w)
    return seen.where(both | (F.col("_b2") < w) | (F.col("_f2") < w)).drop(
        "_b1", "_b2", "_f1", "_f2"
    )


def lag_bins(
    df: DataFrame,
    n: int = 10,
    lo: float = -1,
    hi: float = 2,
    key: str = "motusTagID",
    slice_s: float = HOUR,
) -> DataFrame:
    """Append ``lag_diff1..n`` (seconds) and ``bin1..n``, the (lo, hi] interval holding each."""
    now = micros("ts")
    seen = with_neighbours(
        df, [key], "ts", _order(df, "ts"), n,
        lambda w: {
            f"lag_diff{k}": (now - micros(F.lag("ts", k).over(w))) / 1e6 for k in range(1, n + 1)
        },
        slice_s,
    )
    return seen.withColumns(
        {f"bin{k}": cut(f"lag_diff{k}", [lo, hi]) for k in range(1, n + 1)}
    )


def bursts_literal(df: DataFrame, n: int = 10, shift: float = -1, **kw) -> DataFrame:
    """Rows with any of the lag bins filled, time shifted. Same rows as :func:`bursts`."""
    binned = lag_bins(df, n, **kw)
    kept = binned.where(reduce(or_, [F.col(f"bin{k}").isNotNull() for k in range(1, n + 1)]))
    moved = kept.withColumn("ts", from_micros(micros("ts") + us_of(shift)))
    return moved.select(*df.columns)


def bursts(
    df: DataFrame,
    max_gap: float = 2,
    shift: float = -1,
    key: str = "motusTagID",
    slice_s: float = HOUR,
) -> DataFrame:
    """Rows at most ``max_gap`` s after the previous row of the key, time shifted by ``shift`` s.

    Differences to the k-th previous row are non-negative and grow with k, so testing ten of them
    reduces to testing the first.
    """
    now = micros("ts")
    seen = with_halo(
        df, [key], "ts", _order(df, "ts"), max_gap,
        lambda w: {"_gap": now - micros(F.lag("ts").over(w))}, slice_s,
    )
    kept = seen.where(F.col("_gap") <= us_of(max_gap)).drop("_gap")
    return kept.withColumn("ts", from_micros(now + us_of(shift)))


def pool(
    df: DataFrame,
    every: float = 5,
    min_n: int = 3,
    distinct_stations: bool = False,
    key: str = "motusTagID",
) -> DataFrame:
    """Rows (or distinct stations) per key and rounded time, pools of at least ``min_n``."""
    rounded = df.select(key, round_time("ts", every).alias("ts"), "recvDeployName")
    if distinct_stations:
        rounded = rounded.distinct()
    return rounded.groupBy(key, "ts").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)


def _next_after_span(marks: DataFrame, key: str, span_us: int, slice_s: float) -> DataFrame:
    """(key, t, nxt): the key's first mark later than ``t + span``.

    Marks and questions (``t + span``) are laid on one time line and read backwards, so that the
    last mark seen is the answer; a slice without a later mark takes the head of the next slice.
    """
    t, none = F.col("t"), F.lit(None).cast("bigint")
    laid = marks.select(key, t.alias("at"), t.alias("mark"), none.alias("asks"))
    asked = marks.select(key, (t + span_us).alias("at"), none.alias("mark"), t.alias("asks"))
    line = laid.unionByName(asked)
    step = us_of(slice_s)
    cell = ((F.col("at") - F.pmod("at", F.lit(step))) / step).cast("bigint")
    # never null, for the reason given in with_slice
    line = line.withColumn("_slice", F.coalesce(cell, F.lit(0)))
    # backwards; at equal times the question comes first, so an equal mark is not its answer
    near = (
        Window.partitionBy(key, "_slice")
        .orderBy(F.col("at").desc(), F.col("asks").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = line.withColumn("_seen", F.last("mark", ignorenulls=True).over(near))
    heads = line.groupBy(key, "_slice").agg(F.min("mark").alias("_head"))
    later = (
        Window.partitionBy(key).orderBy(F.col("_slice").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    follow = heads.select(
        key, "_slice", F.last("_head", ignorenulls=True).over(later).alias("_follow")
    )
    return (
        local.where("asks IS NOT NULL")
        .join(follow, [key, "_slice"])
        .select(key, F.col("asks").alias("t"), F.coalesce("_seen", "_follow").alias("nxt"))
    )


def burst_starts(
    df: DataFrame, span: float = 300, key: str = "motusTagID", slice_s: float = HOUR
) -> DataFrame:
    """(key, t): start of each anchored burst, in epoch microseconds.

    A burst takes every ping up to ``span`` s after its first one; the next ping starts the next.
    That is the orbit of a key's first ping under "first ping after t + span". Pings more than
    ``span`` after their predecessor always start a burst and seed the orbits; the chains between
    seeds are followed by pointer doubling, so a chain of n bursts takes log2(n) rounds of joins on
    the unique (key, t), whatever the skew. Each round is checkpointed. Pings without a key form a
    group like any other; pings without a time are in no burst.
    """
    return _keyed_burst_starts(df, span, key, slice_s).select(f"{key}.{key}", "t")


def _keyed_burst_starts(df: DataFrame, span: float, key: str, slice_s: float) -> DataFrame:
    """``burst_starts`` with the key in a struct, which is never null, so that joins keep the group without a key."""
    span_us = us_of(span)
    marks = df.select(F.struct(key).alias(key), micros("ts").alias("t")).where("t IS NOT NULL").distinct()
    links = _next_after_span(marks, key, span_us, slice_s)
    timed = marks.withColumn("_ts", from_micros("t"))
    gaps = with_halo(
        timed, [key], "_ts", [F.col("t").asc()], span,
        lambda w: {"_prev": F.lag("t").over(w)}, slice_s,
    )
    seeds = gaps.where(F.col("_prev").isNull() | (F.col("t") - F.col("_prev") > span_us))
    on = checkpointed(seeds.select(key, "t"))
    # a chain ends at the next seed: its orbit starts there anyway, and no link can skip it
    landing = on.select(key, F.col("t").alias("nxt"))
    jumps = links.where("nxt IS NOT NULL").join(landing, [key, "nxt"], "left_anti")
    jumps = checkpointed(jumps.select(key, "t", "nxt"))
    while True:
        # `on` holds the orbit nodes fewer than 2^i links from a seed, `jumps` the 2^i-link hops
        reached = checkpointed(
            jumps.join(on, [key, "t"], "left_semi").select(key, F.col("nxt").alias("t"))
        )
        if reached.isEmpty():
            return on
        on = on.unionByName(reached)
        hop = jumps.select(key, F.col("t").alias("nxt"), F.col("nxt").alias("_far"))
        jumps = checkpointed(
            jumps.join(hop, [key, "nxt"]).select(key, "t", F.col("_far").alias("nxt"))
        )


def anchored_bursts(
    df: DataFrame, span: float = 300, key: str = "motusTagID", slice_s: float = HOUR
) -> DataFrame:
    """(key, burst start and end, towers in the burst, station, its strongest signal).

    Pings without a key form a group like any other; pings without a time are in no burst.
    """
    starts = _keyed_burst_starts(df, span, key, slice_s).withColumnRenamed("t", "_start")
    pings = df.select(
        F.struct(key).alias(key), micros("ts").alias("t"), "recvDeployName", "sig"
    ).where("t IS NOT NULL")
    span_us = us_of(span)
    # starts of a key are more than one span apart, so a ping's burst began in its own or the
    # previous span-wide cell, and it is the only start that covers the ping
    cell = F.floor(F.col("_start") / span_us).cast("bigint")
    spread = starts.withColumn("_cell", F.explode(F.array(cell, cell + 1)))
    joined = pings.withColumn("_cell", F.floor(F.col("t") / span_us).cast("bigint")).join(
        spread, [key, "_cell"]
    ).where((F.col("t") >= F.col("_start")) & (F.col("t") <= F.col("_start") + span_us))
    stations = joined.groupBy(key, "_start", "recvDeployName").agg(
        F.max("sig").alias("max_sig"), F.max("t").alias("_end")
    )
    whole = Window.partitionBy(key, "_start")
    return stations.select(
        f"{key}.{key}",
        from_micros("_start").alias("burst_start"),
        from_micros(F.max("_end").over(whole)).alias("burst_end"),
        F.count(F.lit(1)).over(whole).alias("n_towers"),
        "recvDeployName",
        "max_sig",
    )


def silences(
    df: DataFrame, min_silence: float = 3 * 86400, key: str = "motusTagID", slice_s: float = HOUR
) -> DataFrame:
    """Last pings before at least ``min_silence`` s without any, with the next ping (null if none).

    Of the pings of one instant only the last can precede a silence; a combining aggregate leaves
    just that one before the ordered pass.
    """
    others = [c for c in df.columns if c not in (key, "ts")]
    latest = F.struct(*[c for c in ("recvDeployName", "hitID") if c in others])
    lasts = df.groupBy(key, "ts").agg(F.max_by(F.struct(*others), latest).alias("_row")).select(
        key, "ts", "_row.*"
    )
    seen = with_neighbours(
        lasts, [key], "ts", [F.col("ts").asc()], 1, lambda w: {"nxt": F.lead("ts").over(w)}, slice_s
    )
    quiet = micros("nxt") - micros("ts") >= us_of(min_silence)
    return seen.where(F.col("nxt").isNull() | quiet)
