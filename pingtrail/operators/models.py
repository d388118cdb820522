"""Regressions whose data pass is an aggregate. Only a handful of sums ever reach the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from pingtrail.operators.quantiles import group_quantiles
from pingtrail.session import checkpointed, measured

__all__ = [
    "bootstrap_bca", "bootstrap_slope", "breakpoint", "count_fits", "count_profile", "group_quantiles", "ols", "poisson_glm",
    "quantile_fit", "quantile_lines", "segmented",
]


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept, R2, residual standard error, AIC of y ~ x."""
    used = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = used.agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        (F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)).alias("rss"),
        F.regr_sxx(y, x).alias("sxx"),
    )
    n, rss = F.col("n"), F.col("rss")
    sigma2 = F.try_divide(rss, n - 2)  # null for two rows, as are the errors
    return sums.select(
        "n", "slope", "intercept", "r2",
        F.sqrt(sigma2).alias("sigma"),
        F.sqrt(F.try_divide(sigma2, F.col("sxx"))).alias("slope_se"),
        # Gaussian log-likelihood; slope, intercept and variance are the three parameters
        (n * (F.log(F.lit(2 * math.pi)) + F.log(F.try_divide(rss, n)) + 1) + 2 * 3).alias("aic"),
    )


def poisson_glm(
    df: DataFrame, x: str, y: str, factor: str, quasi: bool = False, tol: float = 1e-10,
    max_iter: int = 50,
) -> DataFrame:
    """(term, estimate, std_error) of the log-linear count model y ~ x + factor.

    The intercept is the alphabetically first level with any count; other levels are differences from it. For a
    given slope each level's intercept has a closed form, so Newton's method runs on the slope
    alone: one aggregate per level and step, however many levels there are. ``quasi`` scales errors
    by the square root of the Pearson dispersion. A level whose counts are all 0 has no finite
    intercept: its estimate is -infinity and its error null, and it says nothing about the slope.
    """
    used = checkpointed(
        df.select(
            F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
            F.col(factor).cast("string").alias("g"),
        ).dropna()
    )

    def per_level(beta: float) -> DataFrame:
        mu = F.exp(F.lit(beta) * F.col("x"))
        return used.groupBy("g").agg(
            F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("xy"),
            F.sum(mu).alias("s0"), F.sum(mu * F.col("x")).alias("s1"),
            F.sum(mu * F.col("x") * F.col("x")).alias("s2"),
            F.count(F.lit(1)).alias("n"),
        )

    beta = 0.0
    for _ in range(max_iter):
        mean = F.col("s1") / F.col("s0")
        step = per_level(beta).agg(
            F.sum(F.col("xy") - F.col("y") * mean).alias("score"),
            F.sum(F.col("y") * (F.col("s2") / F.col("s0") - mean * mean)).alias("info"),
        ).first()
        if not step["info"]:
            raise ValueError("the slope is not identified within levels")
        move = step["score"] / step["info"]
        # a long step could overflow exp()
        beta += max(-1.0, min(1.0, move))
        if abs(move) < tol * max(1.0, abs(beta)):
            break
    else:
        raise ValueError(f"no convergence after {max_iter} steps")

    levels = per_level(beta).withColumns(
        {
            "alpha": F.when(F.col("y") > 0, F.log(F.col("y") / F.col("s0"))).otherwise(F.lit(float("-inf"))),
            "mean": F.col("s1") / F.col("s0"),
        }
    )
    info = levels.agg(
        F.sum(F.col("y") * (F.col("s2") / F.col("s0") - F.col("mean") * F.col("mean"))).alias("i"),
        F.count_if(F.col("y") > 0).alias("k"), F.sum(F.when(F.col("y") > 0, F.col("n"))).alias("n"),
        F.min(F.when(F.col("y") > 0, F.col("g"))).alias("base"),
    ).first()
    base = levels.where(F.col("g") == info["base"]).select("alpha", "mean", "y").first()
    scale = 1.0
    if quasi:
        fitted = used.join(measured(levels.select("g", "alpha")), "g")
        mu = F.exp(F.col("alpha") + beta * F.col("x"))
        pearson = fitted.where("alpha > double('-Infinity')").agg(
            F.sum((F.col("y") - mu) * (F.col("y") - mu) / mu)
        ).first()[0]
        scale = math.sqrt(pearson / (info["n"] - info["k"] - 1))
    var = 1.0 / info["i"]
    spread = F.col("mean") - base["mean"]
    terms = levels.select(
        F.when(F.col("g") == info["base"], "(Intercept)").otherwise(F.col("g")).alias("term"),
        F.when(F.col("g") == info["base"], F.col("alpha"))
        .otherwise(F.col("alpha") - base["alpha"]).alias("estimate"),
        (
            scale * F.sqrt(
                F.when(F.col("g") == info["base"],
                       F.try_divide(F.lit(1.0), "y") + var * F.col("mean") * F.col("mean"))
                .otherwise(F.try_divide(F.lit(1.0), "y") + 1.0 / base["y"] + var * spread * spread)
            )
        ).alias("std_error"),
    )
    slope = df.sparkSession.range(1).select(
        F.lit(x).alias("term"), F.lit(beta).alias("estimate"),
        F.lit(scale * math.sqrt(var)).alias("std_error"),
    )
    return slope.unionByName(terms)


def quantile_fit(
    df: DataFrame, x: str, y: str, tau: float = 0.5, iters: int = 500, eps: float = 1e-6,
    tol: float = 1e-5,
) -> DataFrame:
    """One row (tau, intercept, slope): linear quantile regression by reweighted least squares.

    Each step is one global aggregate of five sums over a checkpointed two-column table. Without two
    different x, or if the steps do not settle, a ValueError is raised.
    """
    used = checkpointed(
        df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    )
    a = b = None
    for _ in range(iters):
        if a is None:
            w = F.lit(1.0)
        else:
            r = F.col("y") - (a + b * F.col("x"))
            side = F.when(r >= 0, F.lit(float(tau))).otherwise(F.lit(1.0 - tau))
            w = side / F.greatest(F.abs(r), F.lit(eps))
        s = used.withColumn("w", w).agg(
            F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("x"),
            F.sum(F.col("w") * F.col("y")).alias("y"),
            F.sum(F.col("w") * F.col("x") * F.col("x")).alias("xx"),
            F.sum(F.col("w") * F.col("x") * F.col("y")).alias("xy"),
        ).first()
        det = s["w"] * s["xx"] - s["x"] ** 2 if s["w"] else 0.0
        if not det > 1e-12 * s["w"] * s["xx"]:
            raise ValueError("the slope is not identified: x is constant")
        slope = (s["w"] * s["xy"] - s["x"] * s["y"]) / det
        intercept = (s["y"] - slope * s["x"]) / s["w"]
        settled = a is not None and abs(slope - b) + abs(intercept - a) < tol
        a, b = intercept, slope
        if settled:
            break
    else:
        raise ValueError(f"no settled line after {iters} steps")
    return df.sparkSession.range(1).select(
        F.lit(float(tau)).alias("tau"), F.lit(a).alias("intercept"), F.lit(b).alias("slope")
    )


def quantile_lines(df: DataFrame, x: str, y: str, taus: list[float], most_rows: int = 20_000) -> DataFrame:
    """One row (tau, intercept, slope) for each of ``taus``, 0 and 1 included: exact linear quantile regressions, all in the same passes.

    Equal (x, y) are counted first. For 0 < tau < 1 each fit keeps a band of residuals in which its line must lie. Rows above or below
    the band enter as sums alone, as only their side matters. Of the rows in the band at most about ``most_rows`` a fit, picked by
    hash, reach the driver, where their fit is solved exactly; it narrows the band to a few per cent of its rows. Once all rows of the band
    are there the line is final if every row outside lies on its side, which one more pass checks. If not, the band is made wider
    and twice as many rows may be fetched. So the number of passes grows with the logarithm of the rows.

    tau 0 and 1 are the limits: of all lines below (above) every row the one with the least sum of residuals. It runs along
    the edge of the convex hull at the mean of x, which is found by bridging: the row farthest beyond the line through a left and a
    right row replaces the one on its side, until no row lies beyond.

    Rows with a null or NaN are not used. Without any row the result is empty; with one x only a ValueError is raised. Where several
    lines are equally good one of them is returned.
    """
    if any(not 0 <= t <= 1 for t in taus):
        raise ValueError("tau must be from 0 to 1")
    spark = df.sparkSession
    values = df.select(F.nanvl(F.col(x).cast("double"), F.lit(None)).alias("x"), F.nanvl(F.col(y).cast("double"), F.lit(None)).alias("y")).dropna()
    used = measured(values.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    whole = used.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"),
                     F.sum(F.col("x") * F.col("n")).alias("x")).first()
    schema = "tau double, intercept double, slope double"
    if not whole["rows"]:
        return spark.createDataFrame([], schema)
    if whole["low"] == whole["high"]:
        raise ValueError("the slope is not identified: x is constant")
    lines = {t: _hull_edge(used, 1 if t == 0 else -1, whole["x"] / whole["n"]) for t in {t for t in taus if t in (0, 1)}}
    bands = {t: (0.0, 0.0, -math.inf, math.inf) for t in {t for t in taus if 0 < t < 1}}
    limits = dict.fromkeys(bands, most_rows)

    def widen(t: float, centre: tuple[float, float]) -> None:
        low, high = bands[t][2:]
        wider = 4 * max((abs(v) for v in (low, high) if math.isfinite(v)), default=0.0) + 1e-9
        bands[t] = (*centre, -wider if math.isfinite(low) else low, wider if math.isfinite(high) else high)
        limits[t] *= 2

    for step in range(60):
        todo = [t for t in sorted(bands) if t not in lines]
        if not todo:
            break
        sums = _around(used, [(bands[t], None) for t in todo])
        chosen = _inside(used, [(bands[t], s["rows"], limits[t]) for t, s in zip(todo, sums, strict=True)], step)
        found = {}
        for t, s, rows in zip(todo, sums, chosen, strict=True):
            line = _small_fit(t, rows, s["above"], s["above_x"], s["below"], s["below_x"])
            if line is None:  # the line is not in the band
                widen(t, bands[t][:2])
            elif s["rows"] <= limits[t]:
                found[t] = line
            else:  # a part of the band: narrow it around the new line
                rest = sorted(q - line[0] - line[1] * p for p, q, _ in rows)
                at, reach = sum(r < 0 for r in rest), int(3 * math.sqrt(len(rest) * limits[t] / most_rows)) + 2
                bands[t] = (*line, rest[at - reach] if at >= reach else -math.inf, rest[at + reach] if at + reach < len(rest) else math.inf)
                if 4 * reach > len(rest):  # too few rows to narrow it by
                    limits[t] *= 2
        checks = _around(used, [(bands[t], found[t]) for t in found]) if found else []
        for (t, line), check in zip(found.items(), checks, strict=True):
            if check["wrong"]:
                widen(t, line)
            else:
                lines[t] = line
    else:
        raise ValueError("no settled lines")
    return spark.createDataFrame([(float(t), *map(float, lines[t])) for t in taus], schema)


def _residual(line) -> Column:
    return F.col("y") - F.lit(float(line[0])) - F.lit(float(line[1])) * F.col("x")


def _around(used: DataFrame, bands: list) -> list[dict]:
    """For each band the rows in it, count and sum of x above and below it, and the rows outside that lie on the wrong side of a line."""
    out = []
    for i, (band, line) in enumerate(bands):
        r, n = _residual(band), F.col("n")
        above, below = r > band[3], r < band[2]
        parts = {"rows": F.count_if(~above & ~below), "above": F.sum(F.when(above, n)), "above_x": F.sum(F.when(above, n * F.col("x"))),
                 "below": F.sum(F.when(below, n)), "below_x": F.sum(F.when(below, n * F.col("x")))}
        if line is not None:
            parts["wrong"] = F.count_if((above & (_residual(line) < 0)) | (below & (_residual(line) > 0)))
        out += [F.coalesce(c, F.lit(0)).alias(f"{k}_{i}") for k, c in parts.items()]
    row = used.agg(*out).first()
    return [{k: row[f"{k}_{i}"] for k in ("rows", "above", "above_x", "below", "below_x", *(["wrong"] if bands[i][1] is not None else []))} for i in range(len(bands))]


def _inside(used: DataFrame, bands: list, step: int) -> list[list[tuple[float, float, float]]]:
    """(x, y, weight) of the rows of each band, or of about as many as its limit, by hash, with weights to make up for the rest."""
    draw = F.pmod(F.xxhash64("x", "y", F.lit(step)), F.lit(1 << 30))
    picks = []
    for i, (band, rows, limit) in enumerate(bands):
        r = _residual(band)
        here = (r >= band[2]) & (r <= band[3])
        picks.append(F.when(here if rows <= limit else here & (draw < int((1 << 30) * limit / rows)), F.lit(i)))
    found: list[list] = [[] for _ in bands]
    for row in used.select(F.explode(F.array_compact(F.array(*picks))).alias("fit"), "x", "y", "n").collect():
        scale = max(1.0, bands[row["fit"]][1] / bands[row["fit"]][2])
        found[row["fit"]].append((row["x"], row["y"], row["n"] * scale))
    return found


def _small_fit(tau: float, rows: list, above: float, above_x: float, below: float, below_x: float) -> tuple[float, float] | None:
    """Exact fit of a few weighted rows beside many whose side of the line is known; None if these pull it away without end.

    The loss is convex in the slope (with the best intercept for each), so its slope is halved in on; the best line then
    runs through two of the rows next to it.
    """
    if not rows:
        return None
    x, y, w = (np.array(c, dtype=float) for c in zip(*rows, strict=True))
    lean, lean_x = tau * above - (1 - tau) * below, tau * above_x - (1 - tau) * below_x
    target = tau * w.sum() + lean
    if not 0 < target < w.sum():
        return None

    def at(b: float):
        r = y - b * x
        order = np.argsort(r, kind="stable")
        k = min(int(np.searchsorted(np.cumsum(w[order]), target * (1 - 1e-14))), len(order) - 1)
        a = r[order[k]]
        pull = np.where(r > a, tau, tau - 1) * w
        pull[r == a] = 0
        tie = r == a
        rest = -lean - pull.sum()  # what the rows on the line must pull
        return a, -(pull @ x + rest * np.average(x[tie], weights=w[tie])) - lean_x

    def loss(a: float, b: float) -> float:
        r = y - a - b * x
        return float(w @ (np.maximum(tau * r, (tau - 1) * r)) - lean * a - lean_x * b)

    spread = (y.max() - y.min() + 1e-300) / max(x.max() - x.min(), 1e-300)
    low, high = -spread, spread
    for _ in range(60):
        if at(low)[1] <= 0 <= at(high)[1]:
            break
        low, high = 2 * low, 2 * high
    else:
        return None
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if at(middle)[1] > 0:
            high = middle
        else:
            low = middle
    best = min(((loss(at(b)[0], b), at(b)[0], b) for b in (low, high)))
    near = np.argsort(np.abs(y - best[1] - best[2] * x), kind="stable")[:6]
    for i in near:
        for j in near:
            if x[i] < x[j]:
                b = (y[j] - y[i]) / (x[j] - x[i])
                best = min(best, (loss(y[i] - b * x[i], b), y[i] - b * x[i], b))
    return float(best[1]), float(best[2])


def _hull_edge(used: DataFrame, side: int, middle: float) -> tuple[float, float]:
    """The line along the lower (side 1) or upper (side -1) convex hull of all rows at ``middle``; a pass for each corner it moves over."""
    height = F.col("y") * side
    ends = used.agg(F.min_by(F.struct("x", "y"), F.struct("x", height)).alias("a"), F.min_by(F.struct("x", "y"), F.struct(-F.col("x"), height)).alias("b")).first()
    left, right = (ends["a"]["x"], ends["a"]["y"] * side), (ends["b"]["x"], ends["b"]["y"] * side)
    while True:
        slope = (right[1] - left[1]) / (right[0] - left[0])
        beyond = height - F.lit(slope) * F.col("x")
        far = used.agg(F.min_by(F.struct("x", "y"), beyond).alias("p"), F.min(beyond).alias("d")).first()
        point = (far["p"]["x"], far["p"]["y"] * side)
        if far["d"] >= min(left[1] - slope * left[0], right[1] - slope * right[0]) or point in (left, right):
            return side * (left[1] - slope * left[0]), side * slope
        if point[0] <= middle:
            left = point
        else:
            right = point


def breakpoint(df: DataFrame, x: str, y: str, grid: list[float]) -> DataFrame:
    """One row (psi, rss, intercept, slope, slope_change): best single-break fit over ``grid``.

    Rows are reduced to one record of sums per grid cell; the hinge sums of every candidate follow
    from them, so the grid never multiplies the rows.
    """
    grid = sorted(grid)
    used = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    # number of candidates below x
    cell = F.size(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: g < F.col("x")))
    xc, yc = F.col("x"), F.col("y")
    cells = used.groupBy(cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(xc).alias("sx"), F.sum(yc).alias("sy"),
        F.sum(xc * xc).alias("sxx"), F.sum(xc * yc).alias("sxy"), F.sum(yc * yc).alias("syy"),
    )
    candidates = F.explode(
        F.array(*[
            F.struct(F.lit(i + 1).alias("first"), F.lit(float(g)).alias("psi"))
            for i, g in enumerate(grid)
        ])
    )
    above = F.col("cell") >= F.col("c.first")
    over = lambda e: F.sum(F.when(above, e).otherwise(0.0))
    psi = F.col("c.psi")
    sums = cells.withColumn("c", candidates).groupBy(psi.alias("psi")).agg(
        F.sum("n").alias("n"), F.sum("sx").alias("x"), F.sum("sy").alias("y"),
        F.sum("sxx").alias("xx"), F.sum("sxy").alias("xy"), F.sum("syy").alias("yy"),
        over(F.col("sx") - psi * F.col("n")).alias("h"),
        over(F.col("sxx") - 2 * psi * F.col("sx") + psi * psi * F.col("n")).alias("hh"),
        over(F.col("sxx") - psi * F.col("sx")).alias("xh"),
        over(F.col("sxy") - psi * F.col("sy")).alias("hy"),
    )
    n = F.col("n")
    centred = sums.select(
        "psi", "n", "x", "y", "h",
        (F.col("xx") - F.col("x") * F.col("x") / n).alias("cxx"),
        (F.col("hh") - F.col("h") * F.col("h") / n).alias("chh"),
        (F.col("xh") - F.col("x") * F.col("h") / n).alias("cxh"),
        (F.col("xy") - F.col("x") * F.col("y") / n).alias("cxy"),
        (F.col("hy") - F.col("h") * F.col("y") / n).alias("chy"),
        (F.col("yy") - F.col("y") * F.col("y") / n).alias("cyy"),
    )
    det = F.col("cxx") * F.col("chh") - F.col("cxh") * F.col("cxh")
    b1 = (F.col("cxy") * F.col("chh") - F.col("chy") * F.col("cxh")) / det
    b2 = (F.col("chy") * F.col("cxx") - F.col("cxy") * F.col("cxh")) / det
    fits = centred.where(det > 1e-9 * F.col("cxx") * F.col("chh")).withColumns(
        {"slope": b1, "slope_change": b2}
    )
    rss = F.col("cyy") - F.col("slope") * F.col("cxy") - F.col("slope_change") * F.col("chy")
    intercept = (
        F.col("y") - F.col("slope") * F.col("x") - F.col("slope_change") * F.col("h")
    ) / n
    fits = fits.select("psi", rss.alias("rss"), intercept.alias("intercept"), "slope", "slope_change")
    best = F.min_by(F.struct(*fits.columns), F.struct("rss", "psi"))
    return fits.agg(best.alias("b")).select("b.*")


def segmented(df: DataFrame, x: str, y: str, cells: int = 256) -> DataFrame:
    """One row (n, psi, psi_se, rss, intercept, slope, slope_change): the least-squares line of two joined pieces, its break free to lie anywhere.

    Between two neighbouring values of x the best break has a closed form: where the lines fitted on either side cross, if they cross
    there, else one of the two values. So all candidates follow from sums over the rows up to each value, and no start value or grid is
    needed. Equal x become one record of sums first. Sums run in two levels: within about ``cells`` ranges of x, cut at its
    quantiles, and over the totals of the ranges, of which there are ``cells`` at most.

    psi_se is the error of the crossing of two lines with independent errors; null with four rows or fewer, or one x on a side. Of equally
    good breaks the smallest counts. Rows with a null or NaN are not used. With fewer than three different x the result is empty.
    """
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    used = measured(df.select(value(x).alias("x"), value(y).alias("y")).dropna().groupBy("x").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy")))
    schema = "n long, psi double, psi_se double, rss double, intercept double, slope double, slope_change double"
    spark = df.sparkSession
    means = used.agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("x"), F.sum("y").alias("y")).first()
    if means["values"] < 3:
        return spark.createDataFrame([], schema)
    x0, y0 = means["x"] / means["n"], means["y"] / means["n"]
    cuts = sorted(set(used.approxQuantile("x", [i / cells for i in range(1, cells)], 0.2 / cells)))
    n, at, up = F.col("n"), F.col("x") - x0, F.col("y") - y0 * F.col("n")
    cell = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("x")))
    sums = used.select(
        cell.alias("cell"), at.alias("at"), n.cast("double").alias("n"), (n * at).alias("x"), up.alias("y"), (n * at * at).alias("xx"), (at * up).alias("xy"),
        (F.col("yy") - 2 * y0 * F.col("y") + y0 * y0 * n).alias("yy"))
    names = ("n", "x", "y", "xx", "xy", "yy")
    in_cell = Window.partitionBy("cell").orderBy("at")
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    totals = measured(sums.groupBy("cell").agg(*[F.sum(c).alias(c) for c in names], F.min("at").alias("first")))
    whole = totals.agg(*[F.sum(c).alias(c) for c in names]).first()
    offsets = totals.select("cell", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}_0") for c in names],
                            F.lead("first").over(Window.orderBy("cell")).alias("next_cell"))
    left = sums.select("cell", "at", *[F.sum(c).over(in_cell).alias(c) for c in names], F.lead("at").over(in_cell).alias("next"))
    left = left.join(F.broadcast(offsets), "cell").select(
        F.col("at"), F.coalesce("next", "next_cell").alias("next"), *[(F.col(c) + F.col(f"{c}_0")).alias(c) for c in names]).where("next IS NOT NULL")
    a = {c: F.col(c) for c in names}
    b = {c: F.lit(whole[c]) - F.col(c) for c in names}

    def centred(s: dict) -> tuple[Column, Column, Column]:
        return s["xx"] - s["x"] * s["x"] / s["n"], s["xy"] - s["x"] * s["y"] / s["n"], s["yy"] - s["y"] * s["y"] / s["n"]

    def line(s: dict) -> dict[str, Column]:
        cxx, cxy, cyy = centred(s)
        # one value of x alone leaves rounding errors of its sums
        slope = F.when(cxx > 1e-12 * (s["xx"] + 1e-300), cxy / cxx)
        return {"b": slope, "a": (s["y"] - slope * s["x"]) / s["n"], "rss": cyy - slope * cxy, "m": s["x"] / s["n"], "cxx": F.when(slope.isNotNull(), cxx), "n": s["n"]}

    sides = left.select("*", F.struct(*[c.alias(k) for k, c in line(a).items()]).alias("l"), F.struct(*[c.alias(k) for k, c in line(b).items()]).alias("r"))
    cross = F.try_divide(F.col("l.a") - F.col("r.a"), F.col("r.b") - F.col("l.b"))
    free = F.when((cross > F.col("at")) & (cross < F.col("next")), F.struct(
        (F.col("l.rss") + F.col("r.rss")).alias("rss"), cross.alias("psi"), F.col("l.a").alias("a"), F.col("l.b").alias("b"), (F.col("r.b") - F.col("l.b")).alias("d")))
    # the break at the value itself: a hinge that the rows to the right of it share
    psi = F.col("at")
    h, hh = b["x"] - psi * b["n"], b["xx"] - 2 * psi * b["x"] + psi * psi * b["n"]
    xh, hy = b["xx"] - psi * b["x"], b["xy"] - psi * b["y"]
    total = whole["n"]
    cxx, cxy, cyy = whole["xx"] - whole["x"] ** 2 / total, whole["xy"] - whole["x"] * whole["y"] / total, whole["yy"] - whole["y"] ** 2 / total
    chh, cxh, chy = hh - h * h / total, xh - h * whole["x"] / total, hy - h * whole["y"] / total
    det = F.lit(cxx) * chh - cxh * cxh
    slope, change = (F.lit(cxy) * chh - chy * cxh) / det, (chy * F.lit(cxx) - F.lit(cxy) * cxh) / det
    fixed = F.when(det > 1e-9 * F.lit(cxx) * chh, F.struct(
        (F.lit(cyy) - slope * F.lit(cxy) - change * chy).alias("rss"), psi.alias("psi"),
        ((F.lit(whole["y"]) - slope * F.lit(whole["x"]) - change * h) / total).alias("a"), slope.alias("b"), change.alias("d")))
    best = sides.select(F.explode(F.array_compact(F.array(free, fixed))).alias("f"), "l", "r").agg(F.min_by(F.struct("f", "l", "r"), F.col("f")).alias("k")).select("k.*")
    rest = lambda s: 1 / F.col(f"{s}.n") + F.try_divide((F.col("f.psi") - F.col(f"{s}.m")) * (F.col("f.psi") - F.col(f"{s}.m")), F.col(f"{s}.cxx"))
    error = F.sqrt(F.greatest(F.col("f.rss"), F.lit(0.0)) / (total - 4) * (rest("l") + rest("r"))) if total > 4 else F.lit(None).cast("double")
    return best.where("f IS NOT NULL").select(
        F.lit(means["n"]).alias("n"), (F.col("f.psi") + x0).alias("psi"), F.try_divide(error, F.abs(F.col("f.d"))).alias("psi_se"),
        F.greatest(F.col("f.rss"), F.lit(0.0)).alias("rss"), (F.col("f.a") - F.col("f.b") * x0 + y0).alias("intercept"),
        F.col("f.b").alias("slope"), F.col("f.d").alias("slope_change"))


def _cluster_sums(df: DataFrame, x: str, y: str, cluster: str) -> DataFrame:
    used = df.select(
        F.col(cluster).cast("string").alias("g"), F.col(x).cast("double").alias("x"),
        F.col(y).cast("double").alias("y"),
    ).dropna()
    return used.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"),
        F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"),
    )


_SUMS = ("n", "x", "y", "xx", "xy")


def _slope(n, x, y, xx, xy) -> Column:
    det = n * xx - x * x
    return F.when(det > 0, (n * xy - x * y) / det)


def _replicates(per: DataFrame, reps: int, seed: int) -> DataFrame:
    """(rep, slope): the slope of all clusters as replicate 0, and of ``reps`` draws of clusters with Poisson(1) weights.

    A weight depends on the MD5 of "seed:replicate:cluster" alone, so that draws are the same in any partitioning.
    """
    drawn = per.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    name = F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), "g")
    u = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    weight, tail, mass = F.lit(0), 0.0, math.exp(-1.0)
    for k in range(1, 12):
        tail += mass
        weight = weight + (u >= tail).cast("int")
        mass /= k
    drawn = drawn.withColumn("w", F.when(F.col("rep") == 0, F.lit(1)).otherwise(weight))
    sums = drawn.groupBy("rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in _SUMS])
    return sums.select("rep", _slope(*map(F.col, _SUMS)).alias("slope"))


def bootstrap_slope(
    df: DataFrame, x: str, y: str, cluster: str, reps: int = 1000, level: float = 0.95,
    seed: int = 17,
) -> DataFrame:
    """One row (estimate, lower, upper, reps): percentile interval of the slope of y ~ x.

    Whole clusters are resampled with Poisson(1) weights drawn from a hash of (replicate, cluster).
    Rows are first reduced to one record of sums per cluster; only those are replicated.
    """
    slopes = _replicates(_cluster_sums(df, x, y, cluster), reps, seed)
    side = (1 - level) / 2
    boot = F.when(F.col("rep") > 0, F.col("slope"))
    # `reps` values in all, so the built-in exact percentile is safe here
    return slopes.agg(
        F.max(F.when(F.col("rep") == 0, F.col("slope"))).alias("estimate"),
        F.percentile(boot, side).alias("lower"),
        F.percentile(boot, 1 - side).alias("upper"),
        F.count(boot).alias("reps"),
    )


def bootstrap_bca(
    df: DataFrame, x: str, y: str, cluster: str, reps: int = 1000, level: float = 0.95, seed: int = 17,
) -> DataFrame:
    """One row (estimate, bias, acceleration, lower, upper, reps): bias-corrected and accelerated interval of the slope of y ~ x.

    Draws are those of :func:`bootstrap_slope`. The bias correction is the normal quantile of the share of draws below the estimate,
    those equal to it counting half. The acceleration comes from the slopes without one cluster, each from the total sums less the
    cluster's own, so no row is read again. Draws and left-out slopes without a slope (one x only) are not used. Where all draws lie on one
    side of the estimate, or no cluster can be left out, bounds are null. The driver sees one row of totals and one of moments.
    """
    per = measured(_cluster_sums(df, x, y, cluster))
    slopes = measured(_replicates(per, reps, seed))
    total = per.agg(*[F.sum(c).alias(c) for c in _SUMS]).first()
    out = per.select(_slope(*[F.lit(total[c]) - F.col(c) for c in _SUMS]).alias("v")) if total["n"] else per.select(F.lit(None).cast("double").alias("v"))
    mean = out.agg(F.avg("v")).first()[0]
    off = F.lit(mean) - F.col("v")
    cubes, squares = out.agg(F.sum(off * off * off), F.sum(off * off)).first()
    estimate = slopes.where("rep = 0").agg(F.max("slope")).first()[0]
    boot = slopes.where("rep > 0 AND slope IS NOT NULL")
    below, equal, n = boot.agg(F.count_if(F.col("slope") < F.lit(estimate)), F.count_if(F.col("slope") == F.lit(estimate)), F.count(F.lit(1))).first()
    share = (below + equal / 2) / n if n else 0.0
    if not 0 < share < 1 or not squares:
        schema = "estimate double, bias double, acceleration double, lower double, upper double, reps long"
        return df.sparkSession.createDataFrame([(estimate, None, None, None, None, n)], schema)
    normal = NormalDist()
    bias, acceleration = normal.inv_cdf(share), cubes / (6 * squares**1.5)

    def at(p: float) -> float:
        z = bias + normal.inv_cdf(p)
        return normal.cdf(bias + z / (1 - acceleration * z))

    side = (1 - level) / 2
    return boot.agg(
        F.lit(estimate).alias("estimate"), F.lit(bias).alias("bias"), F.lit(acceleration).alias("acceleration"),
        F.percentile("slope", at(side)).alias("lower"), F.percentile("slope", at(1 - side)).alias("upper"),
        F.count(F.lit(1)).alias("reps"),
    )


def count_profile(df: DataFrame, column: str, shift: float = 1.0) -> DataFrame:
    """Moments of the shifted count and the negative-binomial and gamma parameters they imply."""
    c = F.col(column) + shift
    mean, var = F.col("mean"), F.col("var")
    return df.agg(
        F.count(column).alias("n"), F.avg(c).alias("mean"), F.var_samp(c).alias("var")
    ).select(
        "n", "mean", "var",
        F.when(var > mean, mean * mean / (var - mean)).alias("nb_size"),
        mean.alias("nb_mu"),
        F.try_divide(mean * mean, var).alias("gamma_shape"),
        F.try_divide(mean, var).alias("gamma_rate"),
    )


def _polygamma(x, order: int, log=F.log):
    """Digamma (order 0) or trigamma (order 1) of a positive column or number: eight steps of the recurrence, then the asymptotic series."""
    shift, x8 = 0.0, x + 8
    for i in range(8):
        shift = shift + (1 / (x + i) if order == 0 else 1 / ((x + i) * (x + i)))
    r = 1 / (x8 * x8)
    if order == 0:
        return log(x8) - 0.5 / x8 - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132))))) - shift
    return 1 / x8 + r / 2 + r / x8 * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * (5 / 66))))) + shift


def _settle(start: float, step, tol: float = 1e-12, max_iter: int = 100) -> float:
    """Newton's method for a positive number, on its logarithm and by at most one unit a step."""
    at = start
    for _ in range(max_iter):
        move = max(-1.0, min(1.0, step(at)))
        at *= math.exp(move)
        if abs(move) < tol:
            return at
    raise ValueError(f"no convergence after {max_iter} steps")


def count_fits(df: DataFrame, column: str, shift: float = 1.0) -> DataFrame:
    """One row of maximum-likelihood fits of the shifted count, with standard errors: n, nb_size, nb_size_se, nb_mu, nb_mu_se,
    gamma_shape, gamma_shape_se, gamma_rate, gamma_rate_se.

    Values are counted once; each Newton step for the negative binomial's size is one aggregate over the different values, with digamma
    and trigamma as column arithmetic. The gamma shape needs two sums alone. Null counts are not used. Without a finite maximum the
    columns of a family are null: for the negative binomial unless values are whole, not negative and vary by more than their mean
    (divisor n), for the gamma unless values are positive and not all equal.
    """
    c = F.col(column).cast("double") + shift
    used = measured(df.select(F.nanvl(c, F.lit(None)).alias("v")).dropna().groupBy("v").agg(F.count(F.lit(1)).alias("k")))
    v, k = F.col("v"), F.col("k")
    s = used.agg(
        F.sum("k").alias("n"), F.sum(k * v).alias("sum"), F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.abs(v - F.floor(v))).alias("part"),
        F.sum(F.when(v > 0, k * F.log(v))).alias("logs"),
    ).first()
    n = s["n"] or 0
    size = size_se = mu = mu_se = shape = shape_se = rate = rate_se = None
    mean = s["sum"] / n if n else 0.0
    spread = used.agg(F.sum(k * (v - mean) * (v - mean))).first()[0] / n if n else 0.0
    if n and s["low"] >= 0 and not s["part"] and spread > mean:
        def moments(r: float):
            row = used.agg(
                F.sum(k * (_polygamma(v + r, 0) - _polygamma(r, 0, math.log))).alias("first"),
                F.sum(k * (_polygamma(v + r, 1) - _polygamma(r, 1, math.log))).alias("second")).first()
            score = row["first"] + n * math.log(r / (r + mean))
            return score, row["second"] + n * (1 / r - 1 / (r + mean))

        def towards(r: float) -> float:
            # in t = log r the score is r * g and its slope r * g + r^2 * g'
            score, slope = moments(r)
            bend = r * score + r * r * slope
            return -r * score / bend if bend < 0 else math.copysign(0.5, score)

        size, mu = _settle(mean * mean / (spread - mean), towards), mean
        size_se, mu_se = 1 / math.sqrt(-moments(size)[1]), math.sqrt(mu * (1 + mu / size) / n)
    if n and s["low"] > 0 and s["high"] > s["low"]:
        gap = math.log(mean) - s["logs"] / n

        def closer(a: float) -> float:
            return -(math.log(a) - _polygamma(a, 0, math.log) - gap) / (1 - a * _polygamma(a, 1, math.log))

        shape = _settle((3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap), closer)
        rate = shape / mean
        # inverse of the information of (shape, rate)
        bend = _polygamma(shape, 1, math.log)
        left = n * (shape * bend - 1)
        shape_se, rate_se = math.sqrt(shape / left), rate * math.sqrt(bend / left)
    row = (n, size, size_se, mu, mu_se, shape, shape_se, rate, rate_se)
    names = ("nb_size", "nb_size_se", "nb_mu", "nb_mu_se", "gamma_shape", "gamma_shape_se", "gamma_rate", "gamma_rate_se")
    return df.sparkSession.createDataFrame([row], "n long, " + ", ".join(f"{c} double" for c in names))
