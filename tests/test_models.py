"""Fits against numpy and Spark ML."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pingtrail.operators import models


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(11)
    rows = []
    for g, level in (("b", 0.3), ("a", 1.2), ("c", 2.0)):
        x = rng.uniform(0, 12, 120 if g != "c" else 400)
        rows += [(g, float(v), int(k)) for v, k in zip(x, rng.poisson(np.exp(level - 0.08 * x)))]
    return rows, spark.createDataFrame(rows, "g STRING, x DOUBLE, y INT").repartition(5)


def test_ols(spark, counts):
    rows, df = counts
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    slope, intercept = np.polyfit(x, y, 1)
    rss = ((y - intercept - slope * x) ** 2).sum()
    n = len(y)
    fit = models.ols(df, "x", "y").first()
    assert (fit["slope"], fit["intercept"]) == pytest.approx((slope, intercept))
    assert fit["aic"] == pytest.approx(n * (np.log(2 * np.pi) + np.log(rss / n) + 1) + 6)
    assert fit["sigma"] == pytest.approx(np.sqrt(rss / (n - 2)))


def test_poisson_against_ml(spark, counts):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    _, df = counts
    wide = df.select(
        "y", "x", *[(F.col("g") == g).cast("double").alias(f"g{g}") for g in ("b", "c")]
    )
    data = VectorAssembler(inputCols=["x", "gb", "gc"], outputCol="features").transform(wide)
    ml = GeneralizedLinearRegression(family="poisson", link="log", labelCol="y", tol=1e-10).fit(data)
    got = {r["term"]: r for r in models.poisson_glm(df, "x", "y", "g").collect()}
    est = [got[t]["estimate"] for t in ("x", "b", "c", "(Intercept)")]
    se = [got[t]["std_error"] for t in ("x", "b", "c", "(Intercept)")]
    assert est == pytest.approx([*ml.coefficients, ml.intercept], abs=1e-6)
    assert se == pytest.approx(ml.summary.coefficientStandardErrors, rel=1e-5)
    quasi = {r["term"]: r for r in models.poisson_glm(df, "x", "y", "g", quasi=True).collect()}
    mu = ml.transform(data).select(((F.col("y") - F.col("prediction")) ** 2
                                    / F.col("prediction")).alias("p")).agg(F.sum("p")).first()[0]
    scale = np.sqrt(mu / (640 - 4))
    assert quasi["x"]["estimate"] == got["x"]["estimate"]
    assert quasi["b"]["std_error"] == pytest.approx(scale * se[1], rel=1e-6)


def test_quantile_fit(spark):
    x = np.arange(400) % 20
    y = 3 + 0.5 * x + np.where(np.arange(400) % 4 == 0, 8.0, (np.arange(400) % 7 - 3) / 50)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x DOUBLE, y DOUBLE")
    fit = models.quantile_fit(df, "x", "y", 0.4).first()

    def loss(a, b):
        r = y - a - b * x
        return np.where(r >= 0, 0.4 * r, -0.6 * r).sum()

    mine = loss(fit["intercept"], fit["slope"])
    # no nearby line is better
    for da, db in ((0.01, 0), (-0.01, 0), (0, 0.002), (0, -0.002), (0.01, -0.002), (-0.01, 0.002)):
        assert mine <= loss(fit["intercept"] + da, fit["slope"] + db) + 1e-3


def _loss(tau, rows, a, b):
    x, y = np.array(rows).T
    r = y - a - b * x
    return float(np.maximum(tau * r, (tau - 1) * r).sum())


def _brute_lines(rows, taus):
    """Some best line runs through two rows: all of these are tried."""
    lines = [(y1 - (y2 - y1) / (x2 - x1) * x1, (y2 - y1) / (x2 - x1)) for x1, y1 in set(rows) for x2, y2 in set(rows) if x1 < x2]
    out = {}
    for t in taus:
        if 0 < t < 1:
            out[t] = min(_loss(t, rows, a, b) for a, b in lines)
        else:
            side = 1 if t == 0 else -1
            fit = [(sum(side * (y - a - b * x) for x, y in rows)) for a, b in lines if min(side * (y - a - b * x) for x, y in rows) >= -1e-9]
            out[t] = min(fit)
    return out


TAUS = [i / 10 for i in range(11)]


@pytest.mark.parametrize("most_rows", [50, 20_000])
def test_quantile_lines_against_all_pairs(spark, most_rows):
    rng = np.random.default_rng(most_rows)
    for kind in range(3):
        x = rng.integers(0, 7, 100).astype(float) if kind else rng.uniform(-3, 9, 100)
        y = np.round(2 + 0.4 * x + rng.standard_t(2, 100) * (1 + np.abs(x) / 3), 1 if kind == 2 else 12)
        rows = [(float(a), float(b)) for a, b in zip(x, y)]
        df = spark.createDataFrame([*rows, (None, 1.0), (1.0, None), (float("nan"), 2.0)], "x DOUBLE, y DOUBLE")
        lines = models.quantile_lines(df, "x", "y", TAUS, most_rows).collect()
        want = _brute_lines(rows, TAUS)
        assert [r["tau"] for r in lines] == TAUS
        for r in lines:
            t, a, b = r["tau"], r["intercept"], r["slope"]
            if 0 < t < 1:
                assert _loss(t, rows, a, b) == pytest.approx(want[t], rel=1e-9), (kind, t)
            else:
                side = 1 if t == 0 else -1
                rest = [side * (q - a - b * p) for p, q in rows]
                assert min(rest) >= -1e-9 and sum(rest) == pytest.approx(want[t], rel=1e-9)


def test_quantile_lines_narrow_large_bands(spark):
    # more rows than reach the driver; known answer: the rows lie on parallel lines, equally many on each
    df = spark.range(200_000).select((F.col("id") % 1000 / 100.0).alias("x"), F.floor(F.col("id") / 1000).alias("k"))
    df = df.select("x", (3 - 0.25 * F.col("x") + F.col("k") / 10).alias("y"))
    got = {r["tau"]: (r["intercept"], r["slope"]) for r in models.quantile_lines(df, "x", "y", [0.0, 0.25 + 1e-4, 0.9 + 1e-4, 1.0], 2000).collect()}
    assert [v for t in sorted(got) for v in got[t]] == pytest.approx([3, -0.25, 3 + 5.0, -0.25, 3 + 18.0, -0.25, 3 + 19.9, -0.25], abs=1e-6)


def test_quantile_lines_of_odd_tables(spark):
    empty = spark.createDataFrame([(None, 1.0)], "x DOUBLE, y DOUBLE")
    assert models.quantile_lines(empty, "x", "y", TAUS).collect() == []
    with pytest.raises(ValueError):
        models.quantile_lines(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x DOUBLE, y DOUBLE"), "x", "y", TAUS)
    two = models.quantile_lines(spark.createDataFrame([(0.0, 1.0), (2.0, 5.0)] * 3, "x DOUBLE, y DOUBLE"), "x", "y", TAUS).collect()
    assert all((r["intercept"], r["slope"]) == pytest.approx((1, 2)) for r in two)


def test_breakpoint(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 10, 500)
    y = 1 + 0.5 * x + 2.0 * np.maximum(x - 6.2, 0) + rng.normal(0, 0.1, 500)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x DOUBLE, y DOUBLE")
    grid = [round(0.2 * i, 1) for i in range(5, 45)]
    fit = models.breakpoint(df, "x", "y", grid).first()
    best = None
    for psi in grid:
        m = np.column_stack([np.ones_like(x), x, np.maximum(x - psi, 0)])
        beta, *_ = np.linalg.lstsq(m, y, rcond=None)
        rss = ((y - m @ beta) ** 2).sum()
        if best is None or rss < best[0]:
            best = (rss, psi, *beta)
    assert fit["psi"] == best[1]
    assert [fit[c] for c in ("rss", "intercept", "slope", "slope_change")] == pytest.approx(
        [best[0], *best[2:]], rel=1e-5
    )


def test_bootstrap(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(60):
        x = rng.uniform(0, 10, 12)
        rows += [(f"t{g}", float(a), float(b)) for a, b in zip(x, 2 + 0.7 * x + rng.normal(0, 1, 12))]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE, y DOUBLE")
    a = models.bootstrap_slope(df, "x", "y", "g", reps=400).first()
    assert a["reps"] == 400 and a["lower"] < a["estimate"] < a["upper"]
    assert a["estimate"] == pytest.approx(np.polyfit([r[1] for r in rows], [r[2] for r in rows], 1)[0])
    # the width is close to the textbook standard error
    assert (a["upper"] - a["lower"]) / 3.92 == pytest.approx(1 / np.sqrt(720 * 100 / 12), rel=0.35)
    again = models.bootstrap_slope(df.repartition(3), "x", "y", "g", reps=400).first()
    assert (again["lower"], again["upper"]) == pytest.approx((a["lower"], a["upper"]))


def test_count_profile(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 1, 3, 9, None)], "n INT")
    row = models.count_profile(df, "n").first()
    shifted = np.array([1, 2, 2, 4, 10])
    mean, var = shifted.mean(), shifted.var(ddof=1)
    assert row["n"] == 5 and row["mean"] == pytest.approx(mean)
    assert row["nb_size"] == pytest.approx(mean**2 / (var - mean))
    assert row["gamma_rate"] == pytest.approx(mean / var)


def test_degenerate_data_gives_null_or_a_clear_error(spark):
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0), (2.0, 2.0)], "x DOUBLE, y DOUBLE")
    row = models.count_profile(flat, "x").first()
    assert row["mean"] == 3.0 and row["gamma_shape"] is None and row["gamma_rate"] is None
    assert models.ols(flat, "x", "y").first()["slope_se"] is None
    two = models.ols(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x DOUBLE, y DOUBLE"), "x", "y").first()
    assert two["slope"] == pytest.approx(2.0) and two["sigma"] is None
    with pytest.raises(ValueError):
        models.quantile_fit(flat, "x", "y")
    zero = spark.createDataFrame([(0.0,), (0.0,)], "x DOUBLE")
    from pingtrail.operators.aggregates import dispersion
    assert dispersion(zero, "x").first()["ratio"] is None


def test_poisson_level_of_zeros(spark, counts):
    _, df = counts
    zeros = spark.createDataFrame([("0", float(i), 0) for i in range(9)], "g STRING, x DOUBLE, y INT")
    plain = {r["term"]: r for r in models.poisson_glm(df, "x", "y", "g").collect()}
    got = {r["term"]: r for r in models.poisson_glm(df.unionByName(zeros), "x", "y", "g", quasi=True).collect()}
    assert got["0"]["estimate"] == float("-inf") and got["0"]["std_error"] is None
    for term, row in plain.items():
        assert got[term]["estimate"] == pytest.approx(row["estimate"])


def test_quantile_fit_raises_when_unsettled(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 17)) for i in range(60)], "x DOUBLE, y DOUBLE")
    with pytest.raises(ValueError):
        models.quantile_fit(df, "x", "y", iters=2)


@pytest.mark.parametrize("accuracy", [100, 100_000])
def test_quantiles_take_one_way_for_any_size(spark, accuracy):
    rng = np.random.default_rng(4)
    groups = {n: rng.integers(0, n, n).astype(float) for n in (1, 2, 3, 4, 5, 6, 7, 11, 100, 3000)}
    df = spark.createDataFrame([(n, float(v)) for n, vs in groups.items() for v in vs], "g INT, v DOUBLE").repartition(7)
    taus = [0.0, 0.05, 0.25, 0.37, 0.5, 0.75, 0.9, 1.0]
    got = {(r["g"], r["tau"]): r["quantile"] for r in models.group_quantiles(df, ["g"], "v", taus, accuracy).collect()}
    for n, vs in groups.items():
        for t in taus:
            assert got[n, t] == pytest.approx(np.quantile(vs, t))


def _plain_draws(rows, reps, seed=17):
    """Slopes of all clusters and of each draw, and the slopes without one cluster, by plain Python."""
    import hashlib
    import math

    clusters = sorted({r[0] for r in rows})
    sums = {g: np.array([(1, x, y, x * x, x * y) for c, x, y in rows if c == g]).sum(axis=0) for g in clusters}
    tails = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(11)])

    def slope(s):
        return (s[0] * s[4] - s[1] * s[2]) / (s[0] * s[3] - s[1] ** 2)

    def weight(rep, g):
        return int((int(hashlib.md5(f"{seed}:{rep}:{g}".encode()).hexdigest()[:8], 16) / 2**32 >= tails).sum())

    whole = sum(sums.values())
    return slope(whole), [slope(sum(weight(i, g) * sums[g] for g in clusters)) for i in range(1, reps + 1)], [slope(whole - s) for s in sums.values()]


def test_bootstrap_bca_against_plain_python(spark):
    from statistics import NormalDist

    rng = np.random.default_rng(3)
    rows = []
    for g in range(25):
        x = rng.uniform(0, 10, 200 if g == 0 else 6)  # one cluster holds more than half of the rows
        rows += [(f"t{g}", float(a), float(b)) for a, b in zip(x, 1 + 0.3 * x + rng.exponential(2 + g / 5, len(x)))]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), ("t1", None, 1.0)], "g STRING, x DOUBLE, y DOUBLE").repartition(6)
    got = models.bootstrap_bca(df, "x", "y", "g", reps=300).first()
    estimate, draws, left_out = _plain_draws(rows, 300)
    normal, off = NormalDist(), np.mean(left_out) - np.array(left_out)
    bias = normal.inv_cdf(np.mean(np.array(draws) < estimate))
    a = (off**3).sum() / (6 * (off**2).sum() ** 1.5)
    ends = [normal.cdf(bias + (bias + z) / (1 - a * (bias + z))) for z in (normal.inv_cdf(0.025), normal.inv_cdf(0.975))]
    want = [estimate, bias, a, *np.quantile(draws, ends), 300]
    assert list(got) == pytest.approx(want, rel=1e-9)
    plain = models.bootstrap_slope(df, "x", "y", "g", reps=300).first()
    assert (plain["lower"], plain["upper"]) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975])), rel=1e-9)


def test_bootstrap_bca_without_spread(spark):
    schema = "g STRING, x DOUBLE, y DOUBLE"
    line = [(f"t{i // 3}", float(i), 2.0 * i) for i in range(9)]
    got = models.bootstrap_bca(spark.createDataFrame(line[:3], schema), "x", "y", "g", reps=20).first()
    assert got["estimate"] == pytest.approx(2) and got["lower"] is None
    empty = models.bootstrap_bca(spark.createDataFrame([], schema), "x", "y", "g", reps=20).first()
    assert empty["estimate"] is None and empty["upper"] is None and empty["reps"] == 0


def test_count_fits_are_the_best_of_a_fine_search(spark):
    import math

    rng = np.random.default_rng(6)
    counts = [int(v) for v in rng.negative_binomial(1.7, 0.2, 900)]
    df = spark.createDataFrame([(v,) for v in [*counts, None]], "n INT").repartition(5)
    got = models.count_fits(df, "n").first()
    data = np.array(counts) + 1.0
    n, mean = len(data), data.mean()

    def nb(r):
        return sum(math.lgamma(v + r) - math.lgamma(r) - math.lgamma(v + 1) for v in data) + n * r * math.log(r / (r + mean)) + data.sum() * math.log(mean / (r + mean))

    def gamma(a):
        return n * (a * math.log(a / mean) - math.lgamma(a)) + (a - 1) * np.log(data).sum() - a * n

    def best(f, low, high):
        ratio = (math.sqrt(5) - 1) / 2
        for _ in range(80):
            p, q = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, q) if f(p) > f(q) else (p, high)
        return (low + high) / 2

    def bend(f, at):
        h = at * 1e-3
        return -(f(at + h) - 2 * f(at) + f(at - h)) / h**2

    r, a = best(nb, 0.1, 50), best(gamma, 0.1, 50)
    assert got["n"] == 900 and got["nb_mu"] == pytest.approx(mean) and got["gamma_rate"] == pytest.approx(a / mean, rel=1e-5)
    assert (got["nb_size"], got["gamma_shape"]) == pytest.approx((r, a), rel=1e-5)
    assert nb(got["nb_size"]) >= nb(r) - 1e-6 and gamma(got["gamma_shape"]) >= gamma(a) - 1e-6
    # the rate is at its best for each shape, so the bend of the profile gives the shape's error
    assert got["gamma_shape_se"] == pytest.approx(1 / math.sqrt(bend(gamma, a)), rel=1e-3)
    assert got["nb_size_se"] == pytest.approx(1 / math.sqrt(bend(nb, r)), rel=1e-3)


def test_count_fits_without_a_maximum(spark):
    def fit(values):
        return models.count_fits(spark.createDataFrame([(v,) for v in values], "n DOUBLE"), "n", 0.0).first()

    even = fit([4.0, 5.0, 5.0, 6.0])
    assert even["nb_size"] is None and even["gamma_shape"] > 0
    assert fit([0.0, 9.0, 9.0, 40.0])["gamma_shape"] is None and fit([0.5, 9.0, 40.0])["nb_size"] is None
    assert fit([3.0, 3.0])["gamma_rate"] is None
    nothing = fit([None])
    assert nothing["n"] == 0 and nothing["nb_mu"] is None and nothing["gamma_shape"] is None


def _hinge(x, y, psi):
    m = np.column_stack([np.ones_like(x), x, np.maximum(x - psi, 0)])
    beta, *_ = np.linalg.lstsq(m, y, rcond=None)
    return ((y - m @ beta) ** 2).sum(), beta


@pytest.mark.parametrize("kind", ["continuous", "ties", "noise"])
def test_segmented_beats_every_break_of_a_fine_search(spark, kind):
    rng = np.random.default_rng(len(kind))
    x = rng.uniform(100, 110, 300) if kind != "ties" else rng.integers(0, 12, 300) + 0.0
    mid = 106.2 if kind != "ties" else 6.4
    y = rng.normal(0, 0.4, 300) + (0 if kind == "noise" else 1 + 0.5 * x - 1.5 * np.maximum(x - mid, 0))
    df = spark.createDataFrame([*((float(a), float(b)) for a, b in zip(x, y)), (None, 1.0), (1.0, None), (float("nan"), 2.0)], "x DOUBLE, y DOUBLE")
    for cells in (3, 256):
        fit = models.segmented(df, "x", "y", cells).first()
        rss, beta = _hinge(x, y, fit["psi"])
        assert fit["n"] == 300 and fit["rss"] == pytest.approx(rss, rel=1e-7)
        assert [fit["intercept"], fit["slope"], fit["slope_change"]] == pytest.approx(beta, rel=1e-4, abs=1e-6)
        grid = np.linspace(x.min(), x.max(), 1500)[1:-1]
        assert fit["rss"] <= min(_hinge(x, y, p)[0] for p in grid) * (1 + 1e-9)
    if kind != "noise":
        assert fit["psi"] == pytest.approx(mid, abs=0.2)
        # the linearised model: break as a fourth parameter
        m = np.column_stack([np.ones_like(x), x, np.maximum(x - fit["psi"], 0), -fit["slope_change"] * (x > fit["psi"])])
        assert fit["psi_se"] == pytest.approx(np.sqrt(np.linalg.inv(m.T @ m)[3, 3] * fit["rss"] / 296), rel=1e-5)


def test_segmented_of_odd_tables(spark):
    fit = lambda rows: models.segmented(spark.createDataFrame(rows, "x DOUBLE, y DOUBLE"), "x", "y").collect()
    assert fit([]) == [] and fit([(1.0, 1.0), (2.0, 3.0), (2.0, 4.0)]) == []
    row = fit([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 1.0), (4.0, 0.0)])[0]
    assert (row["psi"], row["slope"], row["slope_change"]) == pytest.approx((2, 1, -2)) and row["rss"] == pytest.approx(0, abs=1e-9)
