"""Descriptive statistics, tests, intervals and effect sizes.

Spark computes the sufficient statistics in one pass (moments, counts, rank sums); the tail probability is a
scalar on the driver. Per-column results are DataFrames of one row; test results are dicts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.transform import average_ranks
from ..table import bounded, double, with_position, with_running
from . import distributions as dist
from . import special as sp

#: Rows that an operator which compares all pairs takes at most.
PAIR_ROWS = 20_000

# descriptive -----------------------------------------------------------------------------------------


def variance(column: str, ddof: int = 0) -> Column:
    n = F.count(column)
    return F.when(n > ddof, F.var_pop(double(column)) * n / (n - ddof))


def stdev(column: str, ddof: int = 0) -> Column:
    return F.sqrt(variance(column, ddof))


def quantile(column: str, q: float | Sequence[float]) -> Column:
    """Linear interpolation between order statistics, exact."""
    return F.percentile(double(column), F.lit(q) if isinstance(q, (int, float)) else F.array(*map(F.lit, q)))


def iqr(column: str) -> Column:
    q = quantile(column, [0.25, 0.75])
    return q[1] - q[0]


def skewness(column: str, bias: bool = True) -> Column:
    """Third standardised moment; 0 for a constant."""
    n, g = F.count(column), F.coalesce(F.skewness(double(column)), F.when(F.count(column) > 0, F.lit(0.0)))
    return g if bias else F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(column: str, bias: bool = True, fisher: bool = True) -> Column:
    """Excess (fisher) or plain fourth standardised moment; -3 excess for a constant."""
    n, g = F.count(column), F.coalesce(F.kurtosis(double(column)), F.when(F.count(column) > 0, F.lit(-3.0)))
    k = g if bias else F.when(n > 3, ((n + 1) * g + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return k if fisher else k + 3


def sem(column: str) -> Column:
    return F.stddev_samp(double(column)) / F.sqrt(F.count(column))


def gmean(column: str) -> Column:
    return F.exp(F.avg(F.ln(_positive(column))))


def hmean(column: str) -> Column:
    return F.count(column) / F.sum(1 / _positive(column))


def _positive(column: str) -> Column:
    x = double(column)
    return F.when(x <= 0, F.raise_error(F.lit(f"{column} has a value that isn't positive")).cast("double")).otherwise(x)


def describe(df: DataFrame, column: str, by: Sequence[str] = (), bias: bool = True, fisher: bool = True) -> DataFrame:
    x, q = double(column), quantile(column, [0.25, 0.5, 0.75])
    return df.groupBy(*by).agg(
        F.count(column).alias("n"), F.avg(x).alias("mean"), q[1].alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("stdev"),
        q[0].alias("q25"), q[2].alias("q75"), (q[2] - q[0]).alias("iqr"), skewness(column, bias).alias("skew"), kurtosis(column, bias, fisher).alias("kurtosis"),
    )


def mode(df: DataFrame, column: str) -> DataFrame:
    """The most common value, ties to the smallest, with its count."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(1)


def zscores(df: DataFrame, column: str, as_: str, by: Sequence[str] = (), ddof: int = 0) -> DataFrame:
    """Distance from the mean in standard deviations, of each group of `by`; without groups one row of sums is broadcast."""
    mean, spread, n = F.avg(double(column)), F.var_pop(double(column)), F.count(column)
    if by:
        w = Window.partitionBy(*by)
        return df.withColumn(as_, _standardised(double(column), mean.over(w), spread.over(w), n.over(w), ddof))
    one = df.agg(mean.alias("m__"), spread.alias("v__"), n.alias("n__"))
    return df.crossJoin(F.broadcast(one)).withColumn(as_, _standardised(double(column), F.col("m__"), F.col("v__"), F.col("n__"), ddof)).drop("m__", "v__", "n__")  # one row


def _standardised(x: Column, mean: Column, variance: Column, n: Column, ddof: int) -> Column:
    return F.try_divide(x - mean, F.nullif(F.sqrt(variance * n / (n - ddof)), F.lit(0.0)))


def _order_statistics(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with the cumulated count before (lo) and up to (hi) each, and the total n."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(double(column).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    return with_running(counts, ["x"], {"hi": ("sum", "c")}).withColumn("lo", F.col("hi") - F.col("c")).crossJoin(F.broadcast(total))  # one row


def trimmed_mean(df: DataFrame, column: str, cut: float) -> DataFrame:
    """Mean without the int(n * cut) least and greatest values."""
    s = _order_statistics(df, column).withColumn("k", F.floor(F.col("n") * cut))
    kept = F.greatest(F.lit(0), F.least("hi", F.col("n") - F.col("k")) - F.greatest("lo", "k"))
    return s.agg(F.try_divide(F.sum(F.col("x") * kept), F.sum(kept).cast("double")).alias("trimmed_mean"))


def winsorize(df: DataFrame, column: str, as_: str, low: float = 0.1, high: float = 0.1) -> DataFrame:
    """Values beyond the int(n * limit)-th order statistic of each end are set to it."""
    s = _order_statistics(df, column)
    a, b = F.floor(F.col("n") * low), F.col("n") - F.floor(F.col("n") * high)
    bounds = s.agg(F.min(F.when((F.col("lo") <= a) & (F.col("hi") > a), F.col("x"))).alias("a__"), F.max(F.when((F.col("lo") < b) & (F.col("hi") >= b), F.col("x"))).alias("b__"))
    return df.crossJoin(F.broadcast(bounds)).withColumn(as_, F.when(F.col(column).isNotNull(), F.least(F.greatest(double(column), "a__"), "b__"))).drop("a__", "b__")  # one row


def median_abs_deviation(df: DataFrame, column: str, scale: float = 1.0) -> DataFrame:
    centre = df.agg(F.median(double(column)).alias("m__"))
    return df.crossJoin(F.broadcast(centre)).agg((F.median(F.abs(double(column) - F.col("m__"))) / scale).alias("mad"))  # one row


def entropy(df: DataFrame, weight: str, base: float | None = None, other: str | None = None) -> DataFrame:
    """Shannon entropy of the normalised weights, or with `other` their divergence from it (infinite where it is 0 and the weight isn't)."""
    total = df.agg(F.sum(double(weight)).alias("p__"), *([F.sum(double(other)).alias("q__")] if other else []))
    rows = df.crossJoin(F.broadcast(total)).withColumn("p", double(weight) / F.col("p__"))  # one row
    if other:
        q = double(other) / F.col("q__")
        term = F.when(F.col("p") == 0, 0.0).when(q == 0, F.lit(math.inf)).otherwise(F.col("p") * F.ln(F.try_divide(F.col("p"), q)))
    else:
        term = F.when(F.col("p") == 0, 0.0).otherwise(-F.col("p") * F.ln("p"))
    return rows.agg((F.sum(term) / (math.log(base) if base else 1.0)).alias("entropy"))


def histogram(df: DataFrame, column: str, bins: int = 10, bounds: tuple[float, float] | None = None) -> DataFrame:
    """bin, low, high, count, density of equal widths; the last bin is closed, values outside are ignored, a constant has width 1."""
    lo, hi = bounds or df.agg(F.min(double(column)), F.max(double(column))).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin long, low double, high double, count long, density double")
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    width = (hi - lo) / bins
    inside = df.filter(double(column).between(lo, hi)).groupBy(F.least(F.floor((double(column) - lo) / width), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    total = inside.agg(F.sum("c").alias("t"))
    out = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(inside), "bin", "left").crossJoin(F.broadcast(total))  # `bins` rows at most, one row
    c = F.coalesce("c", F.lit(0)).cast("long")
    return out.select("bin", (lo + F.col("bin") * width).alias("low"), (lo + (F.col("bin") + 1) * width).alias("high"), c.alias("count"), F.try_divide(c, F.col("t") * width).alias("density"))


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """x, cdf, sf of the distinct values."""
    return _order_statistics(df, column).select("x", (F.col("hi") / F.col("n")).alias("cdf"), (1 - F.col("hi") / F.col("n")).alias("sf"))


def ecdf_inverse(df: DataFrame, column: str, q: float) -> DataFrame:
    return ecdf(df, column).filter(F.col("cdf") >= q - 1e-12).agg(F.min("x").alias("x"))


# correlation -----------------------------------------------------------------------------------------


def covariance(x: str, y: str, ddof: int = 1) -> Column:
    both = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return F.covar_samp(double(x), double(y)) if ddof == 1 else F.covar_pop(double(x), double(y)) * both / (both - ddof)


def pearson(x: str, y: str) -> Column:
    """Correlation; a constant sample is an error."""
    flat = (F.var_pop(double(x)) == 0) | (F.var_pop(double(y)) == 0)
    return F.when(flat, F.raise_error(F.lit("a sample is constant")).cast("double")).otherwise(F.try_divide(F.covar_pop(double(x), double(y)), F.stddev_pop(double(x)) * F.stddev_pop(double(y))))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_ranks(average_ranks(df.select(x, y), x, "rx__"), y, "ry__")
    return ranked.agg(pearson("rx__", "ry__").alias("spearman"))


def inversions(values: np.ndarray) -> int:
    """Pairs i < j with values[i] > values[j], in n log n: from the highest bit of the ranks down, a pair counts at the bit that parts it."""
    _, rank = np.unique(values, return_inverse=True)
    rank, at, total = rank.astype(np.int64), np.arange(len(values)), 0
    for bit in reversed(range(int(rank.max(initial=0)).bit_length())):
        high = rank >> (bit + 1)  # equal ones lie together, in their first order
        new = np.concatenate([[True], high[1:] != high[:-1]])
        start = np.maximum.accumulate(np.where(new, at, 0))
        one = (rank >> bit) & 1
        ones = np.concatenate([[0], np.cumsum(one)])
        before = ones[:-1] - ones[start]
        total += int(before[one == 0].sum())
        zeros = np.bincount(np.cumsum(new) - 1, weights=1 - one).astype(np.int64)[np.cumsum(new) - 1]
        to, moved = np.where(one == 1, start + zeros + before, at - before), np.empty_like(rank)
        moved[to] = rank
        rank = moved
    return total


def columns_of(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns as arrays of doubles on the driver, 8 bytes a cell; rows with a null among them are left out."""
    table = df.select(*(double(c).alias(f"c{i}") for i, c in enumerate(columns))).na.drop("any").toArrow()
    return [table.column(i).to_numpy() for i in range(len(columns))]


def kendall(df: DataFrame, x: str, y: str, key: str, bound: bool = True) -> DataFrame:
    """tau-b. It refuses more than PAIR_ROWS rows, unless told not to: then all pairs count by sorting, in n log n, over the two
    columns on the driver, 16 bytes a row; keys are unique."""
    if bound:
        df = bounded(df, PAIR_ROWS, "kendall")
    df = df.filter(F.col(key).isNotNull())
    a, b = columns_of(df, x, y)
    order = np.lexsort([b, a])
    a, b = a[order], b[order]
    pairs = lambda *cols: sum(n * (n - 1) // 2 for n in np.unique(np.stack(cols), axis=1, return_counts=True)[1].tolist())
    apart = lambda col: len(col) * (len(col) - 1) // 2 - pairs(col)
    down = inversions(b)
    up = len(a) * (len(a) - 1) // 2 - pairs(a) - pairs(b) + pairs(a, b) - down
    low = math.sqrt(apart(*columns_of(df, x))) * math.sqrt(apart(*columns_of(df, y)))
    odd = any(np.isnan(c).any() or max((c == np.inf).sum(), (c == -np.inf).sum()) > 1 for c in (a, b)) and len(a) > 1
    return df.sparkSession.createDataFrame([(math.nan if odd else (up - down) / low if low else None,)], "tau double")


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """a, b, r of all pairs of columns, in one pass over the rows (or their ranks)."""
    if method == "spearman":
        for c in columns:
            df = average_ranks(df, c, f"r__{c}")
        df = df.select(*(F.col(f"r__{c}").alias(c) for c in columns))
    one = df.agg(*(pearson(a, b).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j))
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.lit(1.0) if i == j else F.col(f"{min(i, j)}_{max(i, j)}")).alias("r")) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return one.select(F.inline(F.array(*cells)))


# tests -----------------------------------------------------------------------------------------------


def moments(df: DataFrame, value: str, group: str | None = None) -> dict:
    """{group: (n, mean, sample variance)}; one row per group reaches the driver, so groups must be few."""
    key = F.col(group) if group else F.lit("all")
    rows = df.filter(F.col(value).isNotNull()).groupBy(key.alias("g")).agg(F.count(value).alias("n"), F.avg(double(value)).alias("m"), F.var_samp(double(value)).alias("v")).collect()
    return {r["g"]: (r["n"], r["m"], r["v"]) for r in sorted(rows, key=lambda r: str(r["g"]))}


def ttest_1samp(m: tuple, popmean: float = 0.0, alternative: str = "two-sided") -> dict:
    n, mean, var = m
    t = (mean - popmean) / math.sqrt(var / n)
    return {"t": t, "df": n - 1, "p": dist.tail("t", t, alternative, {"df": n - 1})}


def ttest_ind(a: tuple, b: tuple, equal_var: bool = True, alternative: str = "two-sided") -> dict:
    (n1, m1, v1), (n2, m2, v2) = a, b
    if equal_var:
        df = n1 + n2 - 2
        se = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / df * (1 / n1 + 1 / n2))
    else:
        df = (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
        se = math.sqrt(v1 / n1 + v2 / n2)
    t = (m1 - m2) / se
    return {"t": t, "df": df, "p": dist.tail("t", t, alternative, {"df": df})}


def ttest_rel(df: DataFrame, x: str, y: str, alternative: str = "two-sided") -> dict:
    return ttest_1samp(moments(df.select((double(x) - double(y)).alias("d")), "d")["all"], 0.0, alternative)


def chisquare(observed: Sequence[float], expected: Sequence[float] | None = None, ddof: int = 0) -> dict:
    o = np.asarray(observed, float)
    e = np.full(len(o), o.mean()) if expected is None else np.asarray(expected, float)
    if abs(e.sum() - o.sum()) > 1e-8 * max(1, o.sum()):
        raise ValueError("expected counts don't sum to the observed ones")
    x, df = float(((o - e) ** 2 / e).sum()), len(o) - 1 - ddof
    return {"chi2": x, "df": df, "p": dist.sf("chi2", x, {"df": df})}


def contingency(df: DataFrame, a: str, b: str) -> np.ndarray:
    """Counts of the pairs of two columns with few values."""
    rows = df.groupBy(a, b).count().collect()
    xs, ys = sorted({r[0] for r in rows}, key=str), sorted({r[1] for r in rows}, key=str)
    out = np.zeros((len(xs), len(ys)))
    for r in rows:
        out[xs.index(r[0]), ys.index(r[1])] = r["count"]
    return out


def chi2_contingency(table: np.ndarray, correction: bool = True) -> dict:
    """Independence; Yates' correction with one degree of freedom."""
    o = np.asarray(table, float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    df = (o.shape[0] - 1) * (o.shape[1] - 1)
    d = np.abs(o - e)
    if df == 1 and correction:
        d = d - np.minimum(0.5, d)
    x = float((d**2 / e).sum())
    return {"chi2": x, "df": df, "p": dist.sf("chi2", x, {"df": df}) if df else 1.0, "expected": e}


def f_oneway(groups: dict) -> dict:
    n = sum(g[0] for g in groups.values())
    grand = sum(g[0] * g[1] for g in groups.values()) / n
    between, within = sum(g[0] * (g[1] - grand) ** 2 for g in groups.values()), sum((g[0] - 1) * (g[2] or 0) for g in groups.values())
    d1, d2 = len(groups) - 1, n - len(groups)
    f = between / d1 / (within / d2)
    return {"f": f, "df1": d1, "df2": d2, "p": dist.sf("f", f, {"df1": d1, "df2": d2}), "between": between, "within": within}


def rank_sums(df: DataFrame, value: str, group: str) -> tuple[dict, float]:
    """{group: (n, sum of average ranks)} and the sum of t^3 - t over ties."""
    ranked = average_ranks(df.filter(F.col(value).isNotNull()).select(group, value), value, "r__")
    sums = {r[0]: (r[1], r[2]) for r in ranked.groupBy(group).agg(F.count(F.lit(1)), F.sum("r__")).collect()}
    ties = ranked.groupBy(value).count().agg(F.sum(F.pow(F.col("count").cast("double"), 3) - F.col("count"))).first()[0]
    return dict(sorted(sums.items(), key=lambda kv: str(kv[0]))), float(ties or 0)


def mannwhitneyu(df: DataFrame, value: str, group: str, alternative: str = "two-sided", use_continuity: bool = True) -> dict:
    """U of the first group (in the order of names) with the tie-corrected normal approximation."""
    sums, ties = rank_sums(df, value, group)
    (n1, r1), (n2, _) = sums.values()
    n, u = n1 + n2, r1 - n1 * (n1 + 1) / 2
    s = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    centre = n1 * n2 / 2
    stat = {"two-sided": max(u, n1 * n2 - u), "greater": u, "less": n1 * n2 - u}[alternative]
    z = (stat - centre - (0.5 if use_continuity else 0)) / s
    p = sp.ndtr(-z) * (2 if alternative == "two-sided" else 1)
    return {"u": u, "z": z, "p": min(1.0, p), "n1": n1, "n2": n2}


def rank_biserial(df: DataFrame, value: str, group: str) -> float:
    m = mannwhitneyu(df, value, group)
    return 2 * m["u"] / (m["n1"] * m["n2"]) - 1


def kruskal(df: DataFrame, value: str, group: str) -> dict:
    sums, ties = rank_sums(df, value, group)
    n = sum(c for c, _ in sums.values())
    h = 12 / (n * (n + 1)) * sum(r * r / c for c, r in sums.values()) - 3 * (n + 1)
    h /= 1 - ties / (n**3 - n)
    return {"h": h, "df": len(sums) - 1, "p": dist.sf("chi2", h, {"df": len(sums) - 1})}


def levene(df: DataFrame, value: str, group: str, center: str = "median") -> dict:
    f = F.median if center == "median" else F.avg
    centre = df.groupBy(F.col(group).alias("g__")).agg(f(double(value)).alias("c__"))
    dev = df.join(centre, F.col(group).eqNullSafe(F.col("g__"))).select(F.col(group), F.abs(double(value) - F.col("c__")).alias("d__"))
    out = f_oneway(moments(dev, "d__", group))
    return {"w": out["f"], "df1": out["df1"], "df2": out["df2"], "p": out["p"]}


def bartlett(groups: dict) -> dict:
    k, n = len(groups), sum(g[0] for g in groups.values())
    pooled = sum((g[0] - 1) * g[2] for g in groups.values()) / (n - k)
    top = (n - k) * math.log(pooled) - sum((g[0] - 1) * math.log(g[2]) for g in groups.values())
    x = top / (1 + (sum(1 / (g[0] - 1) for g in groups.values()) - 1 / (n - k)) / (3 * (k - 1)))
    return {"t": x, "df": k - 1, "p": dist.sf("chi2", x, {"df": k - 1})}


def shapiro(values: Sequence[float]) -> dict:
    """Royston's W and p for 3 to 5000 values (a bounded sample on the driver)."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if not 3 <= n <= 5000:
        raise ValueError("the sample must have 3 to 5000 values")
    if x[0] == x[-1]:
        raise ValueError("all values are equal")
    m = dist.normal_scores(n)
    u = 1 / math.sqrt(n)
    a = np.zeros(n)
    if n == 3:
        a[:] = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    else:
        c = m / math.sqrt(m @ m)
        # Royston's polynomial corrections of the outermost weights (fixed values)
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
            phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[-2:], a[:2] = (second, last), (-last, -second)
        else:
            phi = (m @ m - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
            a[-1], a[0] = last, -last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return {"w": w, "p": max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))}
    ln, y = math.log(n), math.log(max(1 - w, 1e-300))
    if n <= 11:  # Royston's normalising polynomials (fixed values)
        g = -2.273 + 0.459 * n
        if y >= g:
            return {"w": w, "p": 0.0}
        y = -math.log(g - y)
        mu, sigma = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return {"w": w, "p": sp.ndtr(-(y - mu) / sigma)}


def ks_1samp(df: DataFrame, column: str, name: str = "normal", params: dict | None = None, alternative: str = "two-sided") -> dict:
    s = _order_statistics(df, column).withColumn("f", dist.column("cdf", name, F.col("x"), params))
    up, down, n = s.agg(F.max(F.col("hi") / F.col("n") - F.col("f")), F.max(F.col("f") - F.col("lo") / F.col("n")), F.first("n")).first()
    if alternative == "two-sided":
        d = max(up, down)
        return {"d": d, "p": min(1.0, 2 * sp.smirnov_sf(d, n)) if n < 100 else sp.kolmogorov_sf(d * math.sqrt(n)), "n": n}
    d = up if alternative == "greater" else down
    return {"d": d, "p": sp.smirnov_sf(d, n), "n": n}


def ks_2samp(df: DataFrame, column: str, group: str, alternative: str = "two-sided") -> dict:
    """Of the two groups in the order of their names, by running counts over distinct values."""
    names = sorted(r[0] for r in df.select(group).distinct().limit(3).collect())
    if len(names) != 2:
        raise ValueError("there must be two groups")
    first = F.col(group) == names[0]
    per = df.filter(F.col(column).isNotNull()).groupBy(double(column).alias("x")).agg(F.sum(first.cast("long")).alias("a"), F.sum((~first).cast("long")).alias("b"))
    n1, n2 = per.agg(F.sum("a"), F.sum("b")).first()
    gap = with_running(per, ["x"], {"up_a": ("sum", "a"), "up_b": ("sum", "b")}).select((F.col("up_a") / n1 - F.col("up_b") / n2).alias("g"))
    up, down = gap.agg(F.max("g"), F.max(-F.col("g"))).first()
    if alternative == "two-sided":
        d = max(up, down)
        return {"d": d, "p": sp.kolmogorov_sf(d * math.sqrt(n1 * n2 / (n1 + n2)))}
    d = max(0.0, up if alternative == "greater" else down)
    return {"d": d, "p": sp.two_sample_one_sided_sf(d, n1, n2)}


def wilcoxon(df: DataFrame, x: str, y: str | None = None, popmean: float = 0.0, correction: bool = False, alternative: str = "two-sided") -> dict:
    """Signed ranks of the differences that aren't zero, normal approximation with ties."""
    d = df.select((double(x) - (double(y) if y else F.lit(popmean))).alias("d")).filter("d <> 0").select("d", F.abs("d").alias("a"))
    ranked = average_ranks(d, "a", "r")
    n, plus, minus = ranked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0))).first()
    ties = ranked.groupBy("a").count().agg(F.sum(F.pow(F.col("count").cast("double"), 3) - F.col("count"))).first()[0] or 0.0
    s = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    gap = plus - n * (n + 1) / 4
    step = 0.5 * (np.sign(gap) if alternative == "two-sided" else 1 if alternative == "greater" else -1) if correction else 0.0
    z = (gap - step) / s
    return {"w": min(plus, minus) if alternative == "two-sided" else plus, "z": z, "p": dist.tail("normal", z, alternative, {}), "n": n}


def pearson_p(df: DataFrame, x: str, y: str, alternative: str = "two-sided") -> dict:
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r, n = both.agg(pearson(x, y), F.count(F.lit(1))).first()
    t = r * math.sqrt((n - 2) / max(1e-300, 1 - r * r))
    return {"r": r, "n": n, "p": dist.tail("t", t, alternative, {"df": n - 2})}


def binom_test(successes: int, n: int, p: float = 0.5, alternative: str = "two-sided") -> dict:
    pr = {"n": n, "p": p}
    if alternative == "greater":
        value = 1 - dist.cdf("binomial", successes - 1, pr)
    elif alternative == "less":
        value = dist.cdf("binomial", successes, pr)
    else:
        here = dist.pdf("binomial", successes, pr) * (1 + 1e-7)
        value = sum(q for q in (dist.pdf("binomial", k, pr) for k in range(n + 1)) if q <= here)
    return {"p": min(1.0, value), "share": successes / n if n else None}


def fisher_exact(table: Sequence[Sequence[int]], alternative: str = "two-sided") -> dict:
    (a, b), (c, d) = table
    n1, n2, m = a + b, c + d, a + c
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = {k: math.exp(log(n1, k) + log(n2, m - k) - log(n1 + n2, m)) for k in range(max(0, m - n2), min(m, n1) + 1)}
    if alternative == "greater":
        value = sum(v for k, v in p.items() if k >= a)
    elif alternative == "less":
        value = sum(v for k, v in p.items() if k <= a)
    else:
        value = sum(v for v in p.values() if v <= p[a] * (1 + 1e-7))
    return {"odds_ratio": a * d / (b * c) if b * c else math.inf, "p": min(1.0, value)}


def multipletests(df: DataFrame, p: str, alpha: float = 0.05, method: str = "benjamini-hochberg", tie: Sequence[str] = ()) -> DataFrame:
    """Adds adjusted and rejected. Null p-values stay null."""
    m = df.agg(F.count(p)).first()[0]
    live, none = df.filter(F.col(p).isNotNull()), df.filter(F.col(p).isNull())
    ranked = with_position(live, [p, *tie], "k__").withColumn("k__", F.col("k__") + 1)
    if method == "bonferroni":
        ranked = ranked.withColumn("adjusted", F.col(p) * m)
    elif method == "holm":
        ranked = with_running(ranked, ["k__"], {"adjusted": ("max", F.col(p) * (m - F.col("k__") + 1))})
    elif method == "benjamini-hochberg":
        ranked = with_running(ranked, [F.col("k__").desc()], {"adjusted": ("min", F.col(p) * m / F.col("k__"))})
    else:
        raise ValueError(f"unknown method {method!r}; there are benjamini-hochberg, holm, bonferroni")
    ranked = ranked.drop("k__").withColumn("adjusted", F.least("adjusted", F.lit(1.0)))
    out = ranked.unionByName(none.withColumn("adjusted", F.lit(None).cast("double")))
    return out.withColumn("rejected", F.col("adjusted") <= alpha)


# intervals and effect sizes --------------------------------------------------------------------------


def ci_mean(m: tuple, level: float = 0.95) -> tuple[float, float]:
    n, mean, var = m
    h = dist.ppf("t", (1 + level) / 2, {"df": n - 1}) * math.sqrt(var / n)
    return mean - h, mean + h


def ci_diff_means(a: tuple, b: tuple, level: float = 0.95) -> tuple[float, float]:
    t = ttest_ind(a, b, equal_var=False)
    h = dist.ppf("t", (1 + level) / 2, {"df": t["df"]}) * math.sqrt(a[2] / a[0] + b[2] / b[0])
    return a[1] - b[1] - h, a[1] - b[1] + h


def ci_proportion(successes: int, n: int, level: float = 0.95, method: str = "wilson") -> tuple[float, float]:
    z, p = sp.ndtri((1 + level) / 2), successes / n
    if method == "wald":
        h = z * math.sqrt(p * (1 - p) / n)
        return max(0.0, p - h), min(1.0, p + h)
    centre, h = (p + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return centre - h, centre + h


def ci_variance(m: tuple, level: float = 0.95) -> tuple[float, float]:
    n, _, var = m
    return (n - 1) * var / dist.ppf("chi2", (1 + level) / 2, {"df": n - 1}), (n - 1) * var / dist.ppf("chi2", (1 - level) / 2, {"df": n - 1})


def bootstrap(df: DataFrame, column: str, key: str, seed: int, resamples: int = 200, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean by Poisson resampling: each row is drawn a Poisson(1) number of times in each
    resample, so rows never move and only `resamples` sums are shuffled. (low, high, estimate, resamples)."""
    u = lambda r: (F.pmod(F.xxhash64(F.lit(seed), r, F.col(key)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cuts, total = [], 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        cuts.append(total)
    times = lambda r: F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda acc, c: acc + (u(r) > c).cast("int"))
    draws = df.filter(F.col(column).isNotNull()).select(key, double(column).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("r")).withColumn("t", times(F.col("r")))
    means = draws.groupBy("r").agg((F.sum(F.col("v") * F.col("t")) / F.sum("t")).alias("m"))
    a = (1 - level) / 2
    q = F.percentile("m", F.array(F.lit(a), F.lit(1 - a)))
    return means.agg(q[0].alias("low"), q[1].alias("high"), F.avg("m").alias("estimate"), F.count("m").alias("resamples"))


def cohens_d(a: tuple, b: tuple) -> float:
    return (a[1] - b[1]) / math.sqrt(((a[0] - 1) * a[2] + (b[0] - 1) * b[2]) / (a[0] + b[0] - 2))


def hedges_g(a: tuple, b: tuple) -> float:
    return cohens_d(a, b) * (1 - 3 / (4 * (a[0] + b[0]) - 9))


def glass_delta(a: tuple, control: tuple) -> float:
    return (a[1] - control[1]) / math.sqrt(control[2])


def eta_squared(groups: dict) -> float:
    f = f_oneway(groups)
    return f["between"] / (f["between"] + f["within"])


def omega_squared(groups: dict) -> float:
    f = f_oneway(groups)
    ms = f["within"] / f["df2"]
    return (f["between"] - f["df1"] * ms) / (f["between"] + f["within"] + ms)


def cramers_v(table: np.ndarray) -> float:
    x = chi2_contingency(table, correction=False)["chi2"]
    t = np.asarray(table)
    return math.sqrt(x / (t.sum() * (min(t.shape) - 1)))
