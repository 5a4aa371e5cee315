"""Descriptive statistics, tests, intervals and regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..functions import statistics as st
from ..operators import regression as reg
from .core import r
from .registry import query


def one(t, digits: int = 8, /, **values):
    """A row of numbers."""
    names = list(values)
    row = tuple(float(v) if v is not None else None for v in values.values())
    df = t.spark.createDataFrame([row], ", ".join(f"{n} double" for n in names))
    return df.select(*(r(n, digits).alias(n) for n in names))


@query("describe", """
    SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 4) + 0.0 AS mean, median(l_quantity) AS median, min(l_quantity) AS min, max(l_quantity) AS max, round(var_samp(l_quantity), 4) + 0.0 AS variance, round(stddev_samp(l_quantity), 4) + 0.0 AS stdev,
      quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.75) AS q75, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqr,
      round(avg(((l_quantity - m) / s) ^ 3), 4) + 0.0 AS skew, round(avg(((l_quantity - m) / s) ^ 4) - 3, 4) + 0.0 AS kurtosis
    FROM lineitem JOIN (SELECT l_returnflag, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY 1""")
def describe(t):
    out = st.describe(t.lineitem, "l_quantity", ["l_returnflag"])
    return out.withColumns({c: r(c) for c in ("mean", "variance", "stdev", "skew", "kurtosis")})


@query("bias_corrected", """
    SELECT round(sqrt(n * (n - 1.0)) / (n - 2) * g, 6) + 0.0 AS skew, round(((n + 1) * k + 6) * (n - 1) / ((n - 2.0) * (n - 3)), 6) + 0.0 AS kurtosis, round(v * n / (n - 2), 4) + 0.0 AS var2 FROM
    (SELECT count(*) AS n, avg(((c_acctbal - m) / s) ^ 3) AS g, avg(((c_acctbal - m) / s) ^ 4) - 3 AS k, any_value(s * s) AS v FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer))""")
def bias_corrected(t):
    return t.customer.agg(r(st.skewness("c_acctbal", False), 6).alias("skew"), r(st.kurtosis("c_acctbal", False), 6).alias("kurtosis"), r(st.variance("c_acctbal", 2)).alias("var2"))


@query("means", "SELECT round(exp(avg(ln(l_quantity))), 6) + 0.0 AS gmean, round(count(*) / sum(1 / l_quantity), 6) + 0.0 AS hmean, round(stddev_samp(l_quantity) / sqrt(count(*)), 6) + 0.0 AS sem FROM lineitem")
def means(t):
    return t.lineitem.agg(r(st.gmean("l_quantity"), 6).alias("gmean"), r(st.hmean("l_quantity"), 6).alias("hmean"), r(st.sem("l_quantity"), 6).alias("sem"))


@query("quantiles", "SELECT unnest([0.1, 0.5, 0.9, 0.99])::DOUBLE AS q, round(unnest(quantile_cont(o_totalprice, [0.1, 0.5, 0.9, 0.99])), 4) + 0.0 AS x FROM orders")
def quantiles(t):
    qs = [0.1, 0.5, 0.9, 0.99]
    return t.orders.agg(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), st.quantile("o_totalprice", qs).alias("x")).alias("z")).select(F.inline("z").alias("q", "x")).select("q", r("x").alias("x"))


@query("mode", "SELECT p_size AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def mode(t):
    return st.mode(t.part, "p_size")


@query("zscores", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w, 6) + 0.0 AS z FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def zscores(t):
    return st.zscores(t.customer, "c_acctbal", "z", ["c_mktsegment"]).select("c_custkey", r("z", 6).alias("z"))


@query("trimmed_mean", "SELECT round(avg(l_extendedprice), 4) + 0.0 AS trimmed_mean FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) AS k, count(*) OVER () AS n FROM lineitem) WHERE k > floor(n * 0.1) AND k <= n - floor(n * 0.1)")
def trimmed_mean(t):
    return st.trimmed_mean(t.lineitem, "l_extendedprice", 0.1).select(r("trimmed_mean").alias("trimmed_mean"))


@query("winsorize", """
    SELECT l_orderkey, l_linenumber, least(greatest(l_extendedprice, lo), hi) AS x FROM lineitem, (SELECT min(l_extendedprice) FILTER (k > floor(n * 0.1)) AS lo, max(l_extendedprice) FILTER (k <= n - floor(n * 0.1)) AS hi FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) AS k, count(*) OVER () AS n FROM lineitem))""")
def winsorize(t):
    return st.winsorize(t.lineitem, "l_extendedprice", "x").select("l_orderkey", "l_linenumber", "x")


@query("mad", "SELECT round(median(abs(o_totalprice - m)), 4) + 0.0 AS mad FROM orders, (SELECT median(o_totalprice) AS m FROM orders)")
def mad(t):
    return st.median_abs_deviation(t.orders, "o_totalprice").select(r("mad").alias("mad"))


_SEG = "SELECT c_mktsegment, count(*)::DOUBLE AS p, sum(c_custkey)::DOUBLE AS q FROM customer GROUP BY 1"


@query("entropy", f"SELECT round(-sum(p / s * ln(p / s)) / ln(2), 8) + 0.0 AS entropy FROM ({_SEG}), (SELECT count(*) AS s FROM customer)")
def entropy(t):
    g = t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("p"))
    return st.entropy(g, "p", base=2).select(r("entropy", 8).alias("entropy"))


@query("divergence", f"SELECT round(sum(p / s * ln(p / s / (q / z))), 8) + 0.0 AS entropy FROM ({_SEG}), (SELECT count(*) AS s, sum(c_custkey) AS z FROM customer)")
def divergence(t):
    g = t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("p"), F.sum("c_custkey").alias("q"))
    return st.entropy(g, "p", other="q").select(r("entropy", 8).alias("entropy"))


@query("histogram", "WITH b AS (SELECT unnest(range(0, 10)) AS bin), x AS (SELECT least(floor((l_quantity - 1) / 4.9), 9)::BIGINT AS bin, count(*) AS c FROM lineitem GROUP BY 1) SELECT b.bin, round((1 + b.bin * 4.9)::DOUBLE, 6) AS low, coalesce(c, 0) AS count, round((coalesce(c, 0) / (4.9 * (SELECT sum(c) FROM x)))::DOUBLE, 8) + 0.0 AS density FROM b LEFT JOIN x USING (bin)")
def histogram(t):
    return st.histogram(t.lineitem, "l_quantity").select("bin", r("low", 6).alias("low"), "count", r("density", 8).alias("density"))


@query("ecdf", "SELECT DISTINCT l_quantity AS x, round(cume_dist() OVER (ORDER BY l_quantity), 8) + 0.0 AS cdf FROM lineitem")
def ecdf(t):
    return st.ecdf(t.lineitem, "l_quantity").select("x", r("cdf", 8).alias("cdf"))


@query("ecdf_inverse", "SELECT min(x) AS x FROM (SELECT l_quantity AS x, cume_dist() OVER (ORDER BY l_quantity) AS c FROM lineitem) WHERE c >= 0.75")
def ecdf_inverse(t):
    return st.ecdf_inverse(t.lineitem, "l_quantity", 0.75)


@query("correlation", "SELECT round(corr(l_quantity, l_extendedprice), 8) + 0.0 AS pearson, round(covar_samp(l_quantity, l_extendedprice), 2) + 0.0 AS cov, round(covar_pop(l_quantity, l_extendedprice), 2) + 0.0 AS cov0 FROM lineitem")
def correlation(t):
    a = ("l_quantity", "l_extendedprice")
    return t.lineitem.agg(r(st.pearson(*a), 8).alias("pearson"), r(st.covariance(*a), 2).alias("cov"), r(st.covariance(*a, ddof=0), 2).alias("cov0"))


_RANKS = "(SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)"


@query("spearman", f"SELECT round(corr(a, b), 8) + 0.0 AS spearman FROM {_RANKS}")
def spearman(t):
    return st.spearman(t.lineitem, "l_quantity", "l_extendedprice").select(r("spearman", 8).alias("spearman"))


@query("kendall", "SELECT round(sum(sign(a.s_acctbal - b.s_acctbal) * sign(a.s_nationkey - b.s_nationkey)) / sqrt(sum((a.s_acctbal <> b.s_acctbal)::INT) * sum((a.s_nationkey <> b.s_nationkey)::INT)::DOUBLE), 8) + 0.0 AS tau FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey")
def kendall(t):
    return st.kendall(t.supplier, "s_acctbal", "s_nationkey", "s_suppkey", bound=False).select(r("tau", 8).alias("tau"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem" for a in _COLS for b in _COLS))
def correlation_matrix(t):
    return st.correlation_matrix(t.lineitem, _COLS).withColumn("r", r("r", 6))


_TWO = "FROM lineitem WHERE l_returnflag IN ('A', 'R')"


def two(t):
    return t.lineitem.filter(F.col("l_returnflag").isin("A", "R"))


@query("ttest_ind", f"SELECT round((ma - mr) / sqrt(((na - 1) * va + (nr - 1) * vr) / (na + nr - 2) * (1.0 / na + 1.0 / nr)), 6) + 0.0 AS t, (na + nr - 2)::DOUBLE AS df FROM (SELECT avg(l_quantity) FILTER (l_returnflag = 'A') AS ma, avg(l_quantity) FILTER (l_returnflag = 'R') AS mr, var_samp(l_quantity) FILTER (l_returnflag = 'A') AS va, var_samp(l_quantity) FILTER (l_returnflag = 'R') AS vr, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nr {_TWO})")
def ttest_ind(t):
    m = st.moments(two(t), "l_quantity", "l_returnflag")
    x = st.ttest_ind(m["A"], m["R"])
    return one(t, 6, t=x["t"], df=x["df"])


@query("ttest_welch", f"SELECT round((ma - mr) / sqrt(va / na + vr / nr), 6) + 0.0 AS t, round((va / na + vr / nr) ^ 2 / ((va / na) ^ 2 / (na - 1) + (vr / nr) ^ 2 / (nr - 1)), 4) + 0.0 AS df FROM (SELECT avg(l_quantity) FILTER (l_returnflag = 'A') AS ma, avg(l_quantity) FILTER (l_returnflag = 'R') AS mr, var_samp(l_quantity) FILTER (l_returnflag = 'A') AS va, var_samp(l_quantity) FILTER (l_returnflag = 'R') AS vr, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nr {_TWO})")
def ttest_welch(t):
    m = st.moments(two(t), "l_quantity", "l_returnflag")
    x = st.ttest_ind(m["A"], m["R"], equal_var=False)
    return one(t, 6, t=x["t"], df=round(x["df"], 4))


@query("ttest_1samp", "SELECT round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 6) + 0.0 AS t FROM lineitem")
def ttest_1samp(t):
    return one(t, 6, t=st.ttest_1samp(st.moments(t.lineitem, "l_quantity")["all"], 25)["t"])


@query("ttest_rel", "SELECT round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 6) + 0.0 AS t FROM lineitem")
def ttest_rel(t):
    return one(t, 6, t=st.ttest_rel(t.lineitem, "l_discount", "l_tax")["t"])


@query("chi2_contingency", """
    WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS o FROM orders GROUP BY 1, 2), g AS (SELECT x.a, y.b, coalesce(o, 0) AS o FROM (SELECT DISTINCT a FROM c) x CROSS JOIN (SELECT DISTINCT b FROM c) y LEFT JOIN c ON c.a = x.a AND c.b = y.b),
    e AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM g) SELECT round(sum((o - e) ^ 2 / e), 6) + 0.0 AS chi2 FROM e""")
def chi2_contingency(t):
    return one(t, 6, chi2=st.chi2_contingency(st.contingency(t.orders, "o_orderstatus", "o_orderpriority"))["chi2"])


@query("chisquare", "SELECT round(sum((o - e) ^ 2 / e), 6) + 0.0 AS chi2 FROM (SELECT count(*) AS o, avg(count(*)) OVER () AS e FROM customer GROUP BY c_mktsegment)")
def chisquare(t):
    counts = [x["count"] for x in t.customer.groupBy("c_mktsegment").count().collect()]
    return one(t, 6, chi2=st.chisquare(counts)["chi2"])


_SSW = "SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1"


@query("f_oneway", f"WITH g AS ({_SSW}), z AS (SELECT avg(c_acctbal) AS gm, count(*) AS nn FROM customer) SELECT round((sum(n * (m - gm) ^ 2) / (count(*) - 1)) / (sum((n - 1) * v) / (any_value(nn) - count(*))), 6) + 0.0 AS f, round(sum(n * (m - gm) ^ 2) / (sum(n * (m - gm) ^ 2) + sum((n - 1) * v)), 8) + 0.0 AS eta2 FROM g, z")
def f_oneway(t):
    m = st.moments(t.customer, "c_acctbal", "c_mktsegment")
    return one(t, 8, f=round(st.f_oneway(m)["f"], 6), eta2=st.eta_squared(m))


@query("mannwhitney", f"SELECT sum(r) FILTER (l_returnflag = 'A') - count(*) FILTER (l_returnflag = 'A') * (count(*) FILTER (l_returnflag = 'A') + 1) / 2.0 AS u FROM (SELECT l_returnflag, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r {_TWO})")
def mannwhitney(t):
    return one(t, 6, u=st.mannwhitneyu(two(t), "l_quantity", "l_returnflag")["u"])


@query("kruskal", "WITH r AS (SELECT l_returnflag AS g, l_quantity AS v, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem), s AS (SELECT g, count(*)::DOUBLE AS n, sum(r) AS t FROM r GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM r), k AS (SELECT sum(c ^ 3 - c) AS k FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY v)) SELECT round((12 / (any_value(n.n) * (any_value(n.n) + 1)) * sum(t * t / s.n) - 3 * (any_value(n.n) + 1)) / (1 - any_value(k.k) / (any_value(n.n) ^ 3 - any_value(n.n))), 4) + 0.0 AS h FROM s, n, k")
def kruskal(t):
    return one(t, 4, h=st.kruskal(t.lineitem, "l_quantity", "l_returnflag")["h"])


@query("levene", "WITH d AS (SELECT c_mktsegment AS g, abs(c_acctbal - m) AS d FROM customer JOIN (SELECT c_mktsegment, median(c_acctbal) AS m FROM customer GROUP BY 1) USING (c_mktsegment)), g AS (SELECT g, count(*) AS n, avg(d) AS m, var_samp(d) AS v FROM d GROUP BY 1), z AS (SELECT avg(d) AS gm, count(*) AS nn FROM d) SELECT round((sum(n * (m - gm) ^ 2) / (count(*) - 1)) / (sum((n - 1) * v) / (any_value(nn) - count(*))), 6) + 0.0 AS w FROM g, z")
def levene(t):
    return one(t, 6, w=st.levene(t.customer, "c_acctbal", "c_mktsegment")["w"])


@query("bartlett", f"WITH g AS ({_SSW}), p AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS s, sum(n) AS nn, count(*) AS k FROM g) SELECT round(((any_value(nn) - any_value(k)) * ln(any_value(s)) - sum((n - 1) * ln(v))) / (1 + (sum(1.0 / (n - 1)) - 1.0 / (any_value(nn) - any_value(k))) / (3.0 * (any_value(k) - 1))), 6) + 0.0 AS t FROM g, p")
def bartlett(t):
    return one(t, 6, t=st.bartlett(st.moments(t.customer, "c_acctbal", "c_mktsegment"))["t"])


@query("ks_2samp", f"SELECT round(max(abs(a - r)), 8) + 0.0 AS d FROM (SELECT DISTINCT l_quantity, count(*) FILTER (l_returnflag = 'A') OVER w / (count(*) FILTER (l_returnflag = 'A') OVER ())::DOUBLE AS a, count(*) FILTER (l_returnflag = 'R') OVER w / (count(*) FILTER (l_returnflag = 'R') OVER ())::DOUBLE AS r {_TWO} WINDOW w AS (ORDER BY l_quantity))")
def ks_2samp(t):
    return one(t, 8, d=st.ks_2samp(two(t), "l_quantity", "l_returnflag")["d"])


@query("ks_1samp")
def ks_1samp(t):
    return one(t, 8, **{k: v for k, v in st.ks_1samp(t.customer, "c_acctbal", params={"mean": 4500.0, "sd": 3000.0}).items()})


@query("wilcoxon", "WITH d AS (SELECT l_discount - l_tax AS d FROM lineitem WHERE l_discount <> l_tax), r AS (SELECT d, rank() OVER (ORDER BY round(abs(d), 6)) + (count(*) OVER (PARTITION BY round(abs(d), 6)) - 1) / 2.0 AS r FROM d) SELECT least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w FROM r")
def wilcoxon(t):
    df = t.lineitem.filter("l_discount <> l_tax").select(F.round(F.col("l_discount") - F.col("l_tax"), 6).alias("d"), F.lit(0.0).alias("z"))
    return one(t, 4, w=st.wilcoxon(df, "d", "z")["w"])


@query("shapiro")
def shapiro(t):
    x = [v[0] for v in t.customer.orderBy(F.xxhash64("c_custkey"), "c_custkey").select("c_acctbal").limit(5000).collect()]
    return one(t, 8, **st.shapiro(x))


@query("pvalues")
def pvalues(t):
    m = st.moments(two(t), "l_quantity", "l_returnflag")
    b = st.binom_test(t.orders.filter("o_orderstatus = 'F'").count(), t.orders.count())
    f = st.fisher_exact([[8, 2], [1, 5]])
    return one(t, 8, t=st.ttest_ind(m["A"], m["R"])["p"], mwu=st.mannwhitneyu(two(t), "l_quantity", "l_returnflag")["p"], binom=b["p"], fisher=f["p"], odds=f["odds_ratio"], r=st.pearson_p(t.lineitem, "l_quantity", "l_discount")["p"])


@query("multipletests", "WITH p AS (SELECT s_suppkey AS k, (s_suppkey * 37 % 101) / 101.0::DOUBLE AS p FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS m FROM p) SELECT k, round(least(1, min(p * m / i) OVER (ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) + 0.0 AS adjusted FROM r")
def multipletests(t):
    p = t.supplier.select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 37 % 101 / 101.0).alias("p"))
    return st.multipletests(p, "p", tie=["k"]).select("k", r("adjusted", 8).alias("adjusted"))


@query("holm", "WITH p AS (SELECT s_suppkey AS k, (s_suppkey * 37 % 101) / 101.0::DOUBLE AS p FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS m FROM p) SELECT k, round(least(1, max(p * (m - i + 1)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) + 0.0 AS adjusted FROM r")
def holm(t):
    p = t.supplier.select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 37 % 101 / 101.0).alias("p"))
    return st.multipletests(p, "p", method="holm", tie=["k"]).select("k", r("adjusted", 8).alias("adjusted"))


@query("effect_sizes", "SELECT round((ma - mr) / sqrt(((na - 1) * va + (nr - 1) * vr) / (na + nr - 2)), 8) + 0.0 AS d, round((ma - mr) / sqrt(((na - 1) * va + (nr - 1) * vr) / (na + nr - 2)) * (1 - 3 / (4.0 * (na + nr) - 9)), 8) + 0.0 AS g, round((ma - mr) / sqrt(vr), 8) + 0.0 AS delta FROM (SELECT avg(l_quantity) FILTER (l_returnflag = 'A') AS ma, avg(l_quantity) FILTER (l_returnflag = 'R') AS mr, var_samp(l_quantity) FILTER (l_returnflag = 'A') AS va, var_samp(l_quantity) FILTER (l_returnflag = 'R') AS vr, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nr " + _TWO + ")")
def effect_sizes(t):
    m = st.moments(two(t), "l_quantity", "l_returnflag")
    return one(t, 8, d=st.cohens_d(m["A"], m["R"]), g=st.hedges_g(m["A"], m["R"]), delta=st.glass_delta(m["A"], m["R"]))


@query("cramers_v", """
    WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS o FROM orders GROUP BY 1, 2), g AS (SELECT x.a, y.b, coalesce(o, 0) AS o FROM (SELECT DISTINCT a FROM c) x CROSS JOIN (SELECT DISTINCT b FROM c) y LEFT JOIN c ON c.a = x.a AND c.b = y.b),
    e AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM g) SELECT round(sqrt(sum((o - e) ^ 2 / e) / (sum(o) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 8) + 0.0 AS v FROM e""")
def cramers_v(t):
    return one(t, 8, v=st.cramers_v(st.contingency(t.orders, "o_orderstatus", "o_orderpriority")))


@query("intervals")
def intervals(t):
    m = st.moments(two(t), "l_quantity", "l_returnflag")
    a, b, c, d = st.ci_mean(m["A"]), st.ci_diff_means(m["A"], m["R"]), st.ci_proportion(45, 100), st.ci_variance(m["A"])
    return one(t, 6, mean_low=a[0], mean_high=a[1], diff_low=b[0], diff_high=b[1], share_low=c[0], share_high=c[1], var_low=d[0], var_high=d[1], rank_biserial=st.rank_biserial(two(t), "l_quantity", "l_returnflag"), omega2=st.omega_squared(m))


@query("wald_interval", "SELECT round(p - 1.959963984540054 * sqrt(p * (1 - p) / n), 8) + 0.0 AS low, round(p + 1.959963984540054 * sqrt(p * (1 - p) / n), 8) + 0.0 AS high FROM (SELECT avg((o_orderstatus = 'F')::INT) AS p, count(*) AS n FROM orders)")
def wald_interval(t):
    low, high = st.ci_proportion(t.orders.filter("o_orderstatus = 'F'").count(), t.orders.count(), method="wald")
    return one(t, 8, low=low, high=high)


@query("bootstrap")
def bootstrap(t):
    return st.bootstrap(t.customer, "c_acctbal", "c_custkey", seed=5, resamples=50)


@query("distribution_columns")
def distribution_columns(t):
    x = t.supplier.select("s_suppkey", (F.col("s_acctbal") / 4000 - 1).alias("z"))
    return x.select("s_suppkey", *(dist.column(k, "normal", F.col("z")).alias(k) for k in ("pdf", "cdf", "sf")), dist.column("ppf", "t", F.lit(0.9), {"df": 5.0}).alias("t90"))


@query("distribution_draws")
def distribution_draws(t):
    return dist.draws(t.spark, "poisson", 200, seed=3, params={"mu": 4.0})


@query("linregress", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) + 0.0 AS intercept, round(corr(l_quantity, l_extendedprice), 8) + 0.0 AS r FROM lineitem")
def linregress(t):
    f = reg.linregress(t.lineitem, "l_quantity", "l_extendedprice")
    return one(t, 8, slope=round(f["slope"], 6), intercept=round(f["intercept"], 4), r=f["r"])


for solver in ("normal", "qr", "lstsq"):

    @query(f"ols_{solver}", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) + 0.0 AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) + 0.0 AS r2 FROM lineitem")
    def fitted(t, solver=solver):
        f = reg.ols(t.lineitem, ["l_quantity"], "l_extendedprice", solver=solver)
        return one(t, 6, slope=round(f["coefficients"][1], 4), intercept=round(f["coefficients"][0], 2), r2=f["r2"])


@query("ols_residuals", "SELECT l_orderkey, l_linenumber, round(l_extendedprice - a - b * l_quantity, 3) + 0.0 AS residual FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)")
def ols_residuals(t):
    f = reg.ols(t.lineitem, ["l_quantity"], "l_extendedprice")
    return reg.with_residuals(t.lineitem, f, "l_extendedprice").select("l_orderkey", "l_linenumber", r("residual", 3).alias("residual"))


@query("ols_weighted", "SELECT round((sw * swxy - swx * swy) / (sw * swxx - swx ^ 2), 4) + 0.0 AS slope FROM (SELECT sum(l_tax + 1) AS sw, sum((l_tax + 1) * l_quantity) AS swx, sum((l_tax + 1) * l_extendedprice) AS swy, sum((l_tax + 1) * l_quantity ^ 2) AS swxx, sum((l_tax + 1) * l_quantity * l_extendedprice) AS swxy FROM lineitem)")
def ols_weighted(t):
    f = reg.ols(t.lineitem.withColumn("w", F.col("l_tax") + 1), ["l_quantity"], "l_extendedprice", weight="w")
    return one(t, 4, slope=f["coefficients"][1])


@query("ridge", "SELECT round(regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 100), 4) + 0.0 AS slope FROM lineitem")
def ridge(t):
    return one(t, 4, slope=reg.ridge(t.lineitem, ["l_quantity"], "l_extendedprice", 100.0)["coefficients"][1])


@query("ols_two", """
    WITH m AS (SELECT avg(l_quantity) AS a, avg(l_tax) AS b, avg(l_extendedprice) AS y FROM lineitem), c AS (SELECT l_quantity - a AS a, l_tax - b AS b, l_extendedprice - y AS y FROM lineitem, m),
    s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_, sum(y * y) AS yy, count(*) AS n FROM c), f AS (SELECT *, (bb * ay - ab * by_) / (aa * bb - ab ^ 2) AS p, (aa * by_ - ab * ay) / (aa * bb - ab ^ 2) AS q FROM s)
    SELECT round(m.y - p * m.a - q * m.b, 3) + 0.0 AS intercept, round(p, 4) + 0.0 AS quantity, round(q, 3) + 0.0 AS tax, round(sqrt((yy - p * ay - q * by_) / (n - 3) * bb / (aa * bb - ab ^ 2)), 6) + 0.0 AS stderr, round((p * ay + q * by_) / yy, 8) + 0.0 AS r2 FROM f, m""")
def ols_two(t):
    f = reg.ols(t.lineitem, ["l_quantity", "l_tax"], "l_extendedprice", solver="qr")
    out = one(t, 8, intercept=f["coefficients"][0], quantity=f["coefficients"][1], tax=f["coefficients"][2], stderr=f["stderr"][1], r2=f["r2"])
    return out.select(r("intercept", 3).alias("intercept"), r("quantity", 4).alias("quantity"), r("tax", 3).alias("tax"), r("stderr", 6).alias("stderr"), "r2")


@query("ols_many")
def ols_many(t):
    f = reg.ols(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    rows = [(n, *map(float, x)) for n, *x in zip(f["names"], f["coefficients"], f["stderr"], f["t"], f["pvalues"], strict=True)]
    return t.spark.createDataFrame(rows, "name string, coefficient double, stderr double, t double, p double")


@query("logistic")
def logistic(t):
    df = t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    f = reg.logistic(df, ["l_quantity", "l_discount"], "y")
    return t.spark.createDataFrame(list(zip(f["names"], f["coefficients"], f["stderr"], strict=True)), "name string, coefficient double, stderr double")


@query("theil_sen", "SELECT round(median((b.s_acctbal - a.s_acctbal) / (b.s_suppkey - a.s_suppkey)), 6) + 0.0 AS slope FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey")
def theil_sen(t):
    return reg.theil_sen(t.supplier, "s_suppkey", "s_acctbal", "s_suppkey", bound=False).select(r("slope", 6).alias("slope"))


@query("siegel_slopes", "SELECT round(median(m), 6) + 0.0 AS slope FROM (SELECT a.s_suppkey, median((b.s_acctbal - a.s_acctbal) / (b.s_suppkey - a.s_suppkey)) AS m FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey GROUP BY 1)")
def siegel_slopes(t):
    return reg.siegel_slopes(t.supplier, "s_suppkey", "s_acctbal", "s_suppkey", bound=False).select(r("slope", 6).alias("slope"))


@query("ablation")
def ablation(t):
    return reg.ablation(t.lineitem, {"size": ["l_quantity"], "terms": ["l_discount", "l_tax"]}, "l_extendedprice", ["l_orderkey", "l_linenumber"])
