"""Interval and post-event joins. Both always carry an equality key, so no nested loop is planned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pingtrail.functions.timeutil import micros, us_of


# Cells of one level that make a cell of the next one, as a power of two; levels that a decomposition may use.
RADIX_BITS, LEVELS = 4, 15


def _cover(lo: str, hi: str) -> Column:
    """The largest whole cells that cover the cells ``lo`` to ``hi``: an array of level and cell.

    A level gives the cells at either end that do not fill a cell of the next level, under two times the radix.
    """
    up, down = f"shiftright(a.lo + {(1 << RADIX_BITS) - 1}, {RADIX_BITS})", f"(shiftright(a.hi + 1, {RADIX_BITS}) - 1)"

    def cells(first: str, last: str) -> str:
        return (f"transform(if({first} <= {last}, sequence({first}, {last}), array()), "
                "c -> named_struct('level', l, 'cell', c))")

    return F.expr(f"""aggregate(sequence(0, {LEVELS}),
        named_struct('lo', {lo}, 'hi', {hi}, 'cells', cast(array() as array<struct<level: int, cell: bigint>>)),
        (a, l) -> CASE WHEN a.lo > a.hi THEN a
            WHEN {up} > {down} THEN named_struct('lo', 1L, 'hi', 0L, 'cells', concat(a.cells, {cells('a.lo', 'a.hi')}))
            ELSE named_struct('lo', {up}, 'hi', {down}, 'cells', concat(a.cells,
                {cells('a.lo', f'({up} * {1 << RADIX_BITS} - 1)')}, {cells(f'(({down} + 1) * {1 << RADIX_BITS})', 'a.hi')})) END,
        a -> a.cells)""")


def interval_cells(right: DataFrame, start: str, end: str, cell_s: float, span: tuple[int, int]) -> DataFrame:
    """``right`` with one row for each cell of ``_level`` and ``_cell`` that its interval needs, O(log) of its length.

    Level 0 has cells of ``cell_s`` seconds, each further one cells sixteen times as long. A null start or end is open: it reaches
    to the end of ``span``, the first and last cell that points lie in.
    """
    step = us_of(cell_s)
    cell = lambda c: F.floor(micros(c) / step).cast("bigint")
    open_or_ordered = F.coalesce(F.col(start) <= F.col(end), F.lit(True))
    bounded = right.where(open_or_ordered).withColumns({
        "_lo": F.greatest(F.coalesce(cell(start), F.lit(span[0])), F.lit(span[0])),
        "_hi": F.least(F.coalesce(cell(end), F.lit(span[1])), F.lit(span[1])),
    })
    covered = bounded.withColumn("_cover", F.explode(_cover("_lo", "_hi")))
    return covered.withColumns({"_level": F.col("_cover.level"), "_cell": F.col("_cover.cell")}).drop("_lo", "_hi", "_cover")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    ts: str,
    start: str,
    end: str,
    cell_s: float = 3600.0,
) -> DataFrame:
    """Rows of ``left`` with each row of ``right`` of the same key whose [start, end] holds ``ts``.

    Intervals are covered by cells of several sizes (``interval_cells``) and the join is on (key, level, cell), so
    a key with many rows and many intervals neither meets in one task nor enumerates all its pairs, and a session of
    ten years costs some dozen rows. A point gives one row for each level that any interval uses. A null start or end
    is open; an interval that ends before it starts, and a point without a time, match nothing. Two small jobs run first: the time span of
    the points and the levels in use.
    """
    step = us_of(cell_s)
    point = F.floor(micros(ts) / step).cast("bigint")
    first, last = left.agg(F.min(point), F.max(point)).first()
    if first is None:
        first, last = 0, -1
    spread = interval_cells(right, start, end, cell_s, (first, last))
    levels = sorted(r[0] for r in spread.select("_level").distinct().collect())  # at most LEVELS + 1
    if not levels:
        levels = [0]
    at = left.withColumn("_point", point).withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
    at = at.withColumn("_cell", F.expr(f"shiftright(_point, _level * {RADIX_BITS})")).drop("_point")
    joined = at.join(spread, [*on, "_level", "_cell"])
    inside = F.coalesce(F.col(ts) >= F.col(start), F.lit(True)) & F.coalesce(F.col(ts) <= F.col(end), F.lit(True))
    return joined.where(inside).drop("_level", "_cell")


def after_event(
    df: DataFrame,
    events: DataFrame,
    on: str = "motusTagID",
    ts: str = "ts",
    event_ts: str = "last_ts",
    minutes: float = 30,
) -> DataFrame:
    """Rows later than their key's event by at most ``minutes``; ``events`` has one row per key."""
    joined = df.join(events, on)
    lag = micros(ts) - micros(event_ts)
    return joined.where((lag > 0) & (lag <= us_of(minutes * 60)))
