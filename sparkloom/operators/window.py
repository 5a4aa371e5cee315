"""Window functions and time series. A series is a column in the order of `order`, one series per value of `partition`."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..table import double, neighbourhoods, ordered, require, up_to_here

WINDOW_FUNCTIONS = ("cumsum", "cummean", "cummax", "cummin", "cumcount", "lag", "lead", "rank", "dense_rank", "row_number", "share")


def window(df: DataFrame, fn: str, column: str | None, as_: str, order: Sequence[str], partition: Sequence[str] = (), offset: int = 1) -> DataFrame:
    """Adds one column. rank and dense_rank order by `column`; the others by `order`. Numeric kinds refuse nulls; share refuses a zero sum."""
    if fn not in WINDOW_FUNCTIONS:
        raise ValueError(f"unknown window function {fn!r}; there are {', '.join(WINDOW_FUNCTIONS)}")
    require(df, [*order, *partition, *([column] if column else [])])
    w, here = ordered(order, partition), up_to_here(order, partition)
    if fn in ("row_number", "cumcount"):
        n = F.row_number().over(w)
        return df.withColumn(as_, (n if fn == "row_number" else n - 1).cast("long"))
    if fn in ("lag", "lead"):
        return df.withColumn(as_, (F.lag if fn == "lag" else F.lead)(column, offset).over(w))
    if fn in ("rank", "dense_rank"):
        by = Window.partitionBy(*partition).orderBy(F.col(column).asc_nulls_first())
        return df.withColumn(as_, (F.rank() if fn == "rank" else F.dense_rank()).over(by).cast("long"))
    x = F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{column} has a null")).cast("double")).otherwise(double(column))
    if fn == "share":
        total = F.sum(x).over(Window.partitionBy(*partition))
        return df.withColumn(as_, F.when(total == 0, F.raise_error(F.lit(f"{column} sums to zero")).cast("double")).otherwise(x / total))
    return df.withColumn(as_, {"cumsum": F.sum, "cummean": F.avg, "cummax": F.max, "cummin": F.min}[fn](x).over(here))


def rolling(df: DataFrame, column: str, as_: str, order: Sequence[str], partition: Sequence[str] = (), fn: str = "mean", width: int = 3, min_periods: int | None = None, center: bool = False) -> DataFrame:
    """A fixed width of rows; null cells are skipped, and fewer than min_periods (default: the width) give null."""
    least = width if min_periods is None else min_periods
    before = (width - 1) // 2 if center else width - 1
    return _framed(df, column, as_, fn, least, ordered(order, partition).rowsBetween(-before, width - 1 - before))


def expanding(df: DataFrame, column: str, as_: str, order: Sequence[str], partition: Sequence[str] = (), fn: str = "mean", min_periods: int = 1) -> DataFrame:
    return _framed(df, column, as_, fn, min_periods, up_to_here(order, partition))


def _framed(df, column, as_, fn, least, w) -> DataFrame:
    x = double(column)
    kinds: dict[str, Callable[[], Column]] = {
        "mean": lambda: F.avg(x), "sum": lambda: F.sum(x), "min": lambda: F.min(x), "max": lambda: F.max(x), "median": lambda: F.percentile(x, F.lit(0.5)),
        "var": lambda: F.var_samp(x), "std": lambda: F.stddev_samp(x), "count": lambda: F.count(x),
    }
    if fn not in kinds:
        raise ValueError(f"unknown function {fn!r}; there are {', '.join(kinds)}")
    return df.withColumn(as_, F.when(F.count(x).over(w) >= least, kinds[fn]().over(w).cast("double")))


def difference(df: DataFrame, column: str, as_: str, order: Sequence[str], partition: Sequence[str] = (), lag: int = 1, times: int = 1) -> DataFrame:
    w = ordered(order, partition)
    out = df.withColumn(as_, double(column))
    for _ in range(times):
        out = out.withColumn(as_, F.col(as_) - F.lag(as_, lag).over(w))
    return out


def integrate(df: DataFrame, column: str, as_: str, order: Sequence[str], partition: Sequence[str] = (), start: float = 0.0) -> DataFrame:
    """Running total from start; a null cell gives null, and the total goes on."""
    return df.withColumn(as_, F.when(F.col(column).isNotNull(), F.lit(start) + F.sum(double(column)).over(up_to_here(order, partition))))


def pct_change(df: DataFrame, column: str, as_: str, order: Sequence[str], partition: Sequence[str] = (), periods: int = 1) -> DataFrame:
    base = F.lag(double(column), periods).over(ordered(order, partition))
    return df.withColumn(as_, F.try_divide(double(column) - base, F.nullif(base, F.lit(0.0))))


def interpolate(df: DataFrame, column: str, x: str, as_: str, order: Sequence[str], partition: Sequence[str] = (), limit_direction: str = "none") -> DataFrame:
    """Linear fill of interior holes along x; the ends are filled forward, backward, both or not."""
    w, point = ordered(order, partition), F.when(F.col(column).isNotNull(), F.struct(double(x).alias("x"), double(column).alias("y")))
    before, after = F.last(point, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(point, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = df.withColumn("b__", before).withColumn("a__", after)
    line = F.col("b__.y") + (double(x) - F.col("b__.x")) * F.try_divide(F.col("a__.y") - F.col("b__.y"), F.col("a__.x") - F.col("b__.x"))
    ends = [c for c, kinds in ((F.col("b__.y"), ("forward", "both")), (F.col("a__.y"), ("backward", "both"))) if limit_direction in kinds]
    inside = F.when(F.col("b__").isNotNull() & F.col("a__").isNotNull(), line)
    return out.withColumn(as_, F.coalesce(double(column), inside, *ends)).drop("b__", "a__")


def per_series(df: DataFrame, order: Sequence[str], partition: Sequence[str], schema: str | T.StructType, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """A recurrence that needs a whole series in order: one pandas call per series, which must fit one task. Without a partition the table is
    one series; a recurrence has no other order than its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values(list(order), kind="stable"))

    if not partition:
        return df.withColumn("all__", F.lit(1)).groupBy("all__").applyInPandas(lambda pdf: run(pdf.drop(columns="all__")), schema)
    return df.groupBy(*partition).applyInPandas(run, schema)


def ewma(df: DataFrame, column: str, as_: str, order: Sequence[str], partition: Sequence[str] = (), alpha: float = 0.3, span: float | None = None, adjust: bool = True, fn: str = "mean") -> DataFrame:
    """Exponentially weighted mean, var or std. adjust weighs all points by age (its variance is corrected for the reliability of the weights)."""
    a = 2 / (span + 1) if span is not None else alpha

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, w, w2, mean, var, seen = [], 0.0, 0.0, 0.0, 0.0, False
        for v in pdf[column].to_numpy(float):
            if np.isnan(v):
                out.append(np.nan if not seen else out[-1])
                continue
            if adjust:
                w, w2 = w * (1 - a) + 1, w2 * (1 - a) ** 2 + 1
                d = v - mean
                mean += d / w
                var = var * (1 - a) + d * (v - mean)
                spread = w - w2 / w
                here = {"mean": mean, "var": var / spread if spread > 1e-15 else np.nan}
            else:
                d = v - mean if seen else 0.0
                mean = mean + a * d if seen else v
                var = (1 - a) * (var + a * d * d) if seen else 0.0
                here = {"mean": mean, "var": var}
            seen = True
            out.append(here["mean"] if fn == "mean" else here["var"] if fn == "var" else np.sqrt(here["var"]))
        return pdf.assign(**{as_: out})

    return per_series(df, order, partition, T.StructType([*df.schema, T.StructField(as_, T.DoubleType())]), run)


def smoothing(df: DataFrame, column: str, order: Sequence[str], partition: Sequence[str] = (), alpha: float = 0.3, beta: float | None = None, phi: float = 1.0, horizon: int = 3) -> DataFrame:
    """Simple exponential smoothing, or with beta a (damped) linear trend. One row per series: level, trend, sse, fitted, forecast."""
    schema = T.StructType([*(df.schema[c] for c in partition), T.StructField("level", T.DoubleType()), T.StructField("trend", T.DoubleType()), T.StructField("sse", T.DoubleType()), T.StructField("fitted", T.ArrayType(T.DoubleType())), T.StructField("forecast", T.ArrayType(T.DoubleType()))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[column].dropna().to_numpy(float)
        keys = {c: [pdf[c].iloc[0]] for c in partition}
        if not len(x):
            return pd.DataFrame(columns=[f.name for f in schema])
        level, trend, fitted, sse = x[0], (x[1] - x[0] if beta is not None and len(x) > 1 else 0.0), [x[0]], 0.0
        for v in x[1:]:
            guess = level + phi * trend
            fitted.append(guess)
            sse += (v - guess) ** 2
            new = alpha * v + (1 - alpha) * guess
            if beta is not None:
                trend = beta * (new - level) + (1 - beta) * phi * trend
            level = new
        steps = np.cumsum([phi ** (h + 1) for h in range(horizon)])
        return pd.DataFrame({**keys, "level": [level], "trend": [trend], "sse": [sse], "fitted": [fitted], "forecast": [[float(level + s * trend) for s in steps]]})

    return per_series(df, order, partition, schema, run)


def seasonal_decompose(df: DataFrame, column: str, order: Sequence[str], partition: Sequence[str] = (), period: int = 4, model: str = "additive") -> DataFrame:
    """Adds trend (centred moving average, twice for an even period), seasonal (centred means of the phases) and resid."""
    w, x = ordered(order, partition), double(column)
    half = period // 2
    whole = F.count(x).over(w.rowsBetween(-half, half)) == 2 * half + 1
    if period % 2:
        trend = F.avg(x).over(w.rowsBetween(-half, half))
    else:
        trend = (F.sum(x).over(w.rowsBetween(-half, half - 1)) + F.sum(x).over(w.rowsBetween(-half + 1, half))) / (2 * period)
    out = df.withColumn("trend", F.when(whole, trend)).withColumn("phase__", F.pmod(F.row_number().over(w) - 1, F.lit(period)))
    out = out.withColumn("d__", x - F.col("trend") if model == "additive" else F.try_divide(x, F.nullif(F.col("trend"), F.lit(0.0))))
    means = out.groupBy(*partition, "phase__").agg(F.avg("d__").alias("m__"))
    centre = F.avg("m__").over(Window.partitionBy(*partition))
    means = means.withColumn("seasonal", F.col("m__") - centre if model == "additive" else F.col("m__") / centre).drop("m__")
    out = out.join(means, [*partition, "phase__"])
    resid = x - F.col("trend") - F.col("seasonal") if model == "additive" else F.try_divide(x, F.col("trend") * F.col("seasonal"))
    return out.withColumn("resid", resid).drop("phase__", "d__")


def acf(df: DataFrame, column: str, order: Sequence[str], nlags: int = 10, adjusted: bool = False) -> DataFrame:
    """(lag, acf) for lags 0 .. nlags of one series."""
    return cross_correlation(df, column, column, order, nlags, adjusted).select("lag", F.col("ccf").alias("acf"))


def cross_correlation(df: DataFrame, x: str, y: str, order: Sequence[str], nlags: int = 10, adjusted: bool = False) -> DataFrame:
    """(lag, ccf): x led by lag against y, over the standard deviations of the whole series."""
    centre = df.agg(F.avg(double(x)).alias("mx__"), F.avg(double(y)).alias("my__"), F.sqrt(F.var_pop(double(x)) * F.var_pop(double(y))).alias("s__"), F.count(F.lit(1)).alias("n__"))
    c = df.crossJoin(F.broadcast(centre)).select(*order, (double(x) - F.col("mx__")).alias("u"), (double(y) - F.col("my__")).alias("v"), "s__", "n__")  # one row
    lags = [F.sum(F.col(f"u{k}") * F.col("v")).alias(f"k{k}") for k in range(nlags + 1)]
    c, w = neighbourhoods(c, order, after=nlags)
    led = c.select("u", "v", "s__", "n__", "halo__", *(F.lead("u", k).over(w).alias(f"u{k}") for k in range(nlags + 1))).filter("not halo__")
    one = led.agg(F.first("s__").alias("s"), F.first("n__").alias("n"), *lags)
    cells = F.array(*(F.struct(F.lit(k).cast("long").alias("lag"), F.try_divide(F.col(f"k{k}"), F.nullif(F.col("s"), F.lit(0.0)) * ((F.col("n") - k) if adjusted else F.col("n"))).alias("ccf")) for k in range(nlags + 1)))
    return one.select(F.inline(cells))


def pacf_of(acf_values: Sequence[float]) -> list[float]:
    """Partial autocorrelations of autocorrelations r0 .. rk, by the Levinson-Durbin recursion."""
    r, out, phi = list(acf_values), [1.0], []
    for k in range(1, len(r)):
        top = r[k] - sum(phi[j] * r[k - 1 - j] for j in range(k - 1))
        low = 1 - sum(phi[j] * r[j + 1] for j in range(k - 1))
        a = top / low
        phi = [phi[j] - a * phi[k - 2 - j] for j in range(k - 1)] + [a]
        out.append(a)
    return out


def pacf(df: DataFrame, column: str, order: Sequence[str], nlags: int = 10) -> DataFrame:
    rows = sorted(tuple(r) for r in acf(df, column, order, nlags).collect())  # nlags + 1 rows
    return df.sparkSession.createDataFrame([(k, v) for (k, _), v in zip(rows, pacf_of([v for _, v in rows]), strict=True)], "lag long, pacf double")


def ar_fit(df: DataFrame, column: str, order: Sequence[str], p: int = 1, intercept: bool = True) -> dict:
    """Least squares on p lags: Spark sums the products, the driver solves p equations. coefficients, intercept, sigma2, r2, last.

    With an intercept, the products are of centred columns, and each column is scaled to length 1 before the rank is taken, so neither
    the unit nor the level of the series makes a design singular.
    """
    near, w = neighbourhoods(df.select(*order, double(column).alias("y")), order, before=p)
    lags = near.select("y", "halo__", *(F.lag("y", k).over(w).alias(f"x{k}") for k in range(1, p + 1))).filter("not halo__").drop("halo__").na.drop()
    terms = [f"x{k}" for k in range(1, p + 1)]
    first = lags.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in ["y", *terms])).first()
    n, mean = first["n"], {c: first[c] or 0.0 for c in ["y", *terms]}
    off = {c: F.col(c) - (mean[c] if intercept else 0.0) for c in ["y", *terms]}
    sums = lags.agg(F.sum(off["y"] * off["y"]).alias("yy"), F.sum((F.col("y") - mean["y"]) * (F.col("y") - mean["y"])).alias("tss"), *(F.sum(off[a] * off[b]).alias(f"{a}_{b}") for a in terms for b in [*terms, "y"])).first()
    gram, right = np.array([[sums[f"{a}_{b}"] for b in terms] for a in terms], float).reshape(p, p), np.array([sums[f"{a}_y"] for a in terms], float)
    scale, level = np.sqrt(np.diag(gram)), np.array([mean[c] for c in terms])
    free = n - len(terms) - int(intercept)
    if free < 0 or not (scale > (1e-12 * np.abs(level) * np.sqrt(n) if intercept else 0)).all() or (p and np.linalg.matrix_rank(gram / np.outer(scale, scale)) < p):
        raise ValueError("the lagged design is singular")
    beta = np.linalg.solve(gram / np.outer(scale, scale), right / scale) / scale
    rss, tss = sums["yy"] - beta @ right, sums["tss"]
    last = [r[0] for r in df.orderBy(*(F.col(c).desc() for c in order)).select(double(column)).limit(p).collect()]
    return {"intercept": float(mean["y"] - beta @ level) if intercept else 0.0, "coefficients": [float(b) for b in beta], "sigma2": float(rss / free) if free > 0 else None, "r2": float(1 - rss / tss) if tss > 0 else None, "last": last, "n": n}


def ar_forecast(fit: dict, horizon: int = 3) -> list[float]:
    past, out = list(fit["last"]), []
    for _ in range(horizon):
        out.append(fit["intercept"] + sum(c * v for c, v in zip(fit["coefficients"], past, strict=False)))
        past.insert(0, out[-1])
    return out


def membership_runs(df: DataFrame, day: str, member: str, partition: Sequence[str] = (), end: str | None = None) -> DataFrame:
    """Gaps and islands over dates: start, last, days of each run of member days; a gap of more than a day splits.

    end: the day that the observation ends; a run that reaches it is open.
    """
    days = df.filter(F.col(member)).select(*partition, F.to_date(day).alias("day")).distinct()
    island = F.date_sub(F.col("day"), F.row_number().over(Window.partitionBy(*partition).orderBy("day")))
    out = days.withColumn("island", island).groupBy(*partition, "island").agg(F.min("day").alias("start"), F.max("day").alias("last"), F.count(F.lit(1)).alias("days")).drop("island")
    return out.withColumn("open", F.lit(False) if end is None else F.col("last") >= F.to_date(F.lit(end)))


def sessions(df: DataFrame, ts: str, partition: Sequence[str], gap_seconds: int) -> DataFrame:
    """Adds session (0-based): a pause longer than the gap, between times rounded to seconds (halves to even), begins a new one."""
    w = Window.partitionBy(*partition).orderBy(ts)
    second = F.rint(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    pause = second - F.lag(second).over(w)
    return df.withColumn("new__", F.coalesce((pause > gap_seconds).cast("int"), F.lit(0))).withColumn("session", F.sum("new__").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new__")
