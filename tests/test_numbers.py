import math

import numpy as np
import pytest

from sparkloom.functions import distributions as dist
from sparkloom.functions import special as sp
from sparkloom.functions import statistics as st
from sparkloom.operators import ml, raster, regression
from sparkloom.operators import window as win


@pytest.mark.parametrize("value,want", [
    (sp.gammainc(2.5, 1.7), 0.3614300), (sp.betainc(2, 3, 0.4), 0.5248), (sp.ndtri(0.975), 1.959963984540054), (sp.kolmogorov_sf(1.0), 0.26999967),
    (dist.cdf("t", 2.0, {"df": 5}), 0.9490302605850709), (dist.sf("chi2", 3.84, {"df": 1}), 0.05004352), (dist.ppf("t", 0.975, {"df": 10}), 2.2281388519649385),
    (dist.cdf("binomial", 3, {"n": 10, "p": 0.5}), 0.171875), (dist.pdf("poisson", 2, {"mu": 3.0}), 0.22404180765538775), (dist.ppf("poisson", 0.5, {"mu": 4.0}), 4.0),
    (st.fisher_exact([[8, 2], [1, 5]])["p"], 0.03496503496503495), (st.binom_test(3, 15, 0.1, "greater")["p"], 0.184061),
])
def test_known_values(value, want):
    assert value == pytest.approx(want, rel=1e-5)


def test_inverse_undoes_cdf():
    for name, params in (("normal", {}), ("t", {"df": 3.0}), ("chi2", {"df": 4.0}), ("f", {"df1": 3.0, "df2": 9.0})):
        for q in (0.01, 0.3, 0.5, 0.9, 0.999):
            assert dist.cdf(name, dist.ppf(name, q, params), params) == pytest.approx(q, abs=1e-9)


def test_shapiro_of_a_published_sample():
    w = st.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w["w"] == pytest.approx(0.79, abs=0.005) and w["p"] == pytest.approx(0.0067, abs=0.0015)


def test_least_squares_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 1.5 + x @ [2.0, -3.0] + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    for solver in ("normal", "qr", "lstsq"):
        assert regression.ols(df, ["a", "b"], "y", solver=solver)["coefficients"] == pytest.approx(want.tolist(), rel=1e-8)
    with pytest.raises(ValueError, match="rank"):
        regression.ols(df.withColumn("c", df.a * 2), ["a", "c"], "y")


def test_partial_autocorrelation_of_a_geometric_decay():
    assert win.pacf_of([1, 0.5, 0.25, 0.125]) == pytest.approx([1, 0.5, 0, 0], abs=1e-12)


def test_clusters_of_two_lines():
    x = np.array([[0, 0], [0, 1], [0, 2], [9, 0], [9, 1]], float)
    for linkage in ("single", "complete", "average"):
        assert ml.hierarchical(x, 2, linkage) == [0, 0, 0, 1, 1]


def test_shortest_path_cuts_no_corner():
    free = {(x, y) for x in range(3) for y in range(3)} - {(1, 0)}
    path, cost = raster.shortest_path(free, (0, 0), (2, 0))
    assert cost == 40 and path[0] == (0, 0) and path[-1] == (2, 0)
    assert raster.shortest_path(free - {(1, 1), (1, 2)}, (0, 0), (2, 0)) is None


def test_wilson_interval():
    low, high = st.ci_proportion(45, 100)
    assert (low, high) == (pytest.approx(0.356, abs=1e-3), pytest.approx(0.5475, abs=1e-3))
    assert math.isclose(st.ci_proportion(0, 10, method="wald")[0], 0.0)


def test_hex_moves_are_fewest():
    path = raster.hex_moves((500.0, 500.0), (500.0, 275.0), 75)
    assert path == [1, 1, 1]
    assert len(raster.hex_moves((500.0, 500.0), (760.0, 500.0), 75)) == 4
    assert raster.hex_moves((10.0, 10.0), (-500.0, 10.0), 75) is None


@pytest.mark.parametrize("solver", ["normal", "qr", "lstsq"])
def test_ols_on_columns_far_from_zero(spark, solver):
    import numpy as np

    from sparkloom.operators import regression

    rng = np.random.default_rng(3)
    x = np.column_stack([1e6 + rng.random(1000), rng.normal(size=1000)])
    y = 3 + 2 * x[:, 0] - x[:, 1] + rng.normal(size=1000)
    w = rng.uniform(0.5, 2, 1000)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(d)) for (a, b), c, d in zip(x, y, w)], "a double, b double, y double, w double").repartition(5)
    for weight in (None, "w"):
        own = np.ones(1000) if weight is None else w
        moved = x - (own @ x) / own.sum()
        slopes = np.linalg.lstsq(moved * np.sqrt(own)[:, None], (y - own @ y / own.sum()) * np.sqrt(own), rcond=None)[0]
        fit = regression.ols(df, ["a", "b"], "y", weight=weight, solver=solver)
        assert np.allclose(fit["coefficients"][1:], slopes, rtol=1e-7)
        design = np.column_stack([np.ones(1000), moved]) * np.sqrt(own)[:, None]
        rss = ((y - own @ y / own.sum() - moved @ slopes) ** 2 * own).sum()
        se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss / 997)
        assert np.isclose(fit["rss"], rss) and np.allclose(fit["stderr"][1:], se[1:], rtol=1e-6)
    with pytest.raises(ValueError, match="rank deficient"):
        regression.ols(df.selectExpr("a", "2 * a as b", "y"), ["a", "b"], "y", solver=solver)


def test_shapiro_refuses_constants():
    from sparkloom.functions import statistics

    with pytest.raises(ValueError):
        statistics.shapiro([2.0] * 10)


@pytest.mark.parametrize("n,budget,authored", [(3, None, []), (5, 2, [1, 4]), (6, 0, []), (7, 99, [2]), (4, None, [0, 1, 2, 3])])
def test_golden_assignment_is_the_sequential_one(spark, n, budget, authored):
    import math
    import random

    from sparkloom.operators import applications as app

    rng, names = random.Random(n), [f"f{i}" for i in range(n)]
    rows = [(i, rng.choice([None, *"abcdefgh"]), names[rng.choice(authored)] if authored and rng.random() < 0.3 else rng.choice([None, "unknown"])) for i in range(60)]
    phi, k, used, lead, want = (1 + math.sqrt(5)) / 2, 0, {a for _, _, a in rows if a in names}, {}, {}
    spread, placed = math.ceil(n / 2) if budget is None else min(budget, n), 0
    for i, key, own in rows:
        if own in names:
            want[i] = (own, "authored")
        else:
            fresh = placed < spread and len(used) < n
            family = None if fresh else lead.get(key)
            if family is None:
                tried = 0
                while True:
                    family = names[math.floor((k + 1) * phi % 1 * n) % n]
                    k += 1
                    if family not in used or tried == n:
                        break
                    tried += 1
            placed += 1
            used.add(family)
            want[i] = (family, "spread" if fresh else "grouped")
        if key is not None:
            lead.setdefault(key, want[i][0])
    df = spark.createDataFrame(rows, "id long, k string, own string").repartition(4)
    got = app.golden_assign(df, "k", "id", names, budget, "own")
    assert {r.id: (r.family, r.phase) for r in got.collect()} == want
    assert {r.family: r.n for r in app.golden_histogram(got, names).collect()} == {f: sum(v[0] == f for v in want.values()) for f in names}


@pytest.mark.parametrize("unit", [1e-3, 1.0, 1e7])
def test_ar_fit_does_not_depend_on_unit_and_level(spark, unit):
    rng = np.random.default_rng(3)
    y = [0.0, 0.0]
    for e in rng.normal(size=60):
        y.append(0.5 * y[-1] - 0.3 * y[-2] + e)
    y = np.array(y)
    df = spark.createDataFrame([(k, float(unit * (1000 + v))) for k, v in enumerate(y)], "k long, v double")
    want = np.linalg.lstsq(np.column_stack([np.ones(60), y[1:-1], y[:-2]]), y[2:], rcond=None)[0]
    fit = win.ar_fit(df, "v", ["k"], 2)
    assert fit["coefficients"] == pytest.approx(list(want[1:]), rel=1e-6) and fit["intercept"] == pytest.approx(unit * (want[0] + 1000 * (1 - want[1] - want[2])), rel=1e-6)
    ahead = want[0] + want[1] * y[-1] + want[2] * y[-2]
    assert win.ar_forecast(fit, 1) == pytest.approx([unit * (1000 + ahead)], rel=1e-9)
    with pytest.raises(ValueError, match="singular"):
        win.ar_fit(df.selectExpr("k", "7e9 as v"), "v", ["k"], 1)
