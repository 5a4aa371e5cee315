"""P-values and intervals against published results: R's documentation examples and widely reprinted outputs on `mtcars` and `sleep`."""

import numpy as np
import pytest

from sparkloom.functions import statistics as st

MPG = [21, 21, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4, 14.7, 32.4, 30.4, 33.9, 21.5, 15.5, 15.2, 13.3, 19.2, 27.3, 26, 30.4, 15.8, 19.7, 15, 21.4]
WT = [2.62, 2.875, 2.32, 3.215, 3.44, 3.46, 3.57, 3.19, 3.15, 3.44, 3.44, 4.07, 3.73, 3.78, 5.25, 5.424, 5.345, 2.2, 1.615, 1.835, 2.465, 3.52, 3.435, 3.84, 3.845, 1.935, 2.14, 1.513, 3.17, 2.77, 3.57, 2.78]
CYL = [6, 6, 4, 6, 8, 6, 8, 4, 4, 6, 6, 8, 8, 8, 8, 8, 8, 4, 4, 4, 4, 8, 8, 8, 8, 4, 4, 4, 8, 6, 8, 4]
AM = [1] * 3 + [0] * 14 + [1] * 3 + [0] * 5 + [1] * 7
SLEEP = [0.7, -1.6, -0.2, -1.2, -0.1, 3.4, 3.7, 0.8, 0.0, 2.0], [1.9, 0.8, 1.1, 0.1, -0.1, 4.4, 5.5, 1.6, 4.6, 3.4]


@pytest.fixture(scope="module")
def cars(spark):
    return spark.createDataFrame([(float(m), w, str(c), str(a)) for m, w, c, a in zip(MPG, WT, CYL, AM)], "mpg double, wt double, cyl string, am string")


def near(value, published, digits=4):
    return value == pytest.approx(published, rel=10.0**-digits * 5)


def test_t_tests(spark, cars):
    m = st.moments(cars, "mpg", "am")
    assert near(st.ttest_ind(m["0"], m["1"], False)["p"], 0.001374, 3)
    whole = (32, float(np.mean(MPG)), float(np.var(MPG, ddof=1)))
    assert near(st.ttest_1samp(whole, 20.0)["p"], 0.9328)
    assert st.ci_mean(whole) == pytest.approx((17.91768, 22.26357), abs=1e-4)
    a, b = ((10, float(np.mean(x)), float(np.var(x, ddof=1))) for x in SLEEP)
    assert near(st.ttest_ind(a, b)["p"], 0.07919) and near(st.ttest_ind(a, b, False)["p"], 0.07939)
    less, more = st.ttest_ind(a, b, alternative="less")["p"], st.ttest_ind(a, b, alternative="greater")["p"]
    assert near(less, 0.07919 / 2) and less + more == pytest.approx(1)
    assert st.ci_diff_means(a, b) == pytest.approx((-3.3654832, 0.2054832), abs=1e-5)
    pairs = spark.createDataFrame(list(zip(*SLEEP)), "x double, y double")
    assert near(st.ttest_rel(pairs, "x", "y")["p"], 0.002833, 3)


def test_rank_tests(cars):
    assert near(st.mannwhitneyu(cars, "mpg", "am")["p"], 0.001871, 3)
    k = st.kruskal(cars, "mpg", "cyl")
    assert near(k["p"], 2.566e-06, 3)


def test_variances_and_groups(cars):
    m = st.moments(cars, "mpg", "cyl")
    assert near(st.bartlett(m)["t"], 8.3934) and near(st.bartlett(m)["p"], 0.01505, 3)
    assert near(st.f_oneway(m)["p"], 4.98e-09, 2)


def test_shapiro_and_correlation(cars):
    s = st.shapiro(MPG)
    assert near(s["w"], 0.94756) and near(s["p"], 0.1229, 3)
    assert near(st.pearson_p(cars, "mpg", "wt")["p"], 1.294e-10, 3)


def test_counts():
    party = np.array([[762, 327, 468], [484, 239, 477]])
    assert near(st.chi2_contingency(party)["p"], 2.954e-07, 3)
    tea = [[3, 1], [1, 3]]
    assert near(st.fisher_exact(tea)["p"], 0.4857) and near(st.fisher_exact(tea, "greater")["p"], 0.2429)
    assert near(st.binom_test(682, 925, 0.75)["p"], 0.3825, 3)


def test_several_tests_at_once(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.04,), (0.05,), (None,)], "p double")
    for method, want in (("benjamini-hochberg", [0.05] * 5), ("holm", [0.05, 0.08, 0.09, 0.09, 0.09]), ("bonferroni", [0.05, 0.1, 0.15, 0.2, 0.25])):
        out = st.multipletests(df, "p", method=method).filter("p is not null").orderBy("p").collect()
        assert [r.adjusted for r in out] == pytest.approx(want), method
    assert st.multipletests(df, "p").filter("adjusted is null").count() == 1
