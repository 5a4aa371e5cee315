"""Column transforms: rescaling, ranks, bins, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..table import double, numeric, require, with_running


def _with_aggregates(df: DataFrame, *columns: Column) -> DataFrame:
    """One row of aggregates beside every row: its size is fixed, so it is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*columns)))


def standardize(df: DataFrame, column: str, as_: str | None = None, ddof: int = 0) -> DataFrame:
    """(x - mean) / stdev; a column without spread is an error."""
    numeric(df, column)
    x, spread = double(column), F.sqrt(F.var_pop(double(column)) * F.count(column) / (F.count(column) - ddof))
    out = _with_aggregates(df, F.avg(x).alias("m__"), spread.alias("s__"))
    z = F.when(F.col("s__") == 0, F.raise_error(F.lit(f"{column} has no spread")).cast("double")).otherwise((x - F.col("m__")) / F.col("s__"))
    return out.withColumn(as_ or f"{column}_z", z).drop("m__", "s__")


def normalize(df: DataFrame, column: str, as_: str | None = None) -> DataFrame:
    """Rescaled to [0, 1]; a constant column is an error."""
    numeric(df, column)
    out = _with_aggregates(df, F.min(double(column)).alias("lo__"), F.max(double(column)).alias("hi__"))
    y = F.when(F.col("hi__") == F.col("lo__"), F.raise_error(F.lit(f"{column} is constant")).cast("double")).otherwise((double(column) - F.col("lo__")) / (F.col("hi__") - F.col("lo__")))
    return out.withColumn(as_ or f"{column}_norm", y).drop("lo__", "hi__")


def average_ranks(df: DataFrame, column: str, as_: str, partition: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Ranks from 1; ties share the mean rank; null stays null.

    Distinct values are counted first and only they are ordered, so one row per value is ranked however often it
    repeats; without a partition that goes by ranges of the values, so no task sees them all.
    """
    require(df, [column, *partition])
    counts = df.filter(F.col(column).isNotNull()).groupBy(*partition, F.col(column).alias("value__")).agg(F.count(F.lit(1)).alias("n__"))
    order = F.col("value__").desc() if descending else F.col("value__").asc()
    if partition:
        before = F.coalesce(F.sum("n__").over(Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        counts, before = with_running(counts, [order], {"upto__": ("sum", "n__")}), F.col("upto__") - F.col("n__")
    ranks = counts.select(*(F.col(c).alias(f"p__{c}") for c in partition), "value__", (before + (F.col("n__") + 1) / 2).cast("double").alias(as_))
    test = F.col(column) == F.col("value__")
    for c in partition:
        test = test & F.col(c).eqNullSafe(F.col(f"p__{c}"))
    return df.join(ranks, test, "left").select(*df.columns, as_)


def edges(df: DataFrame, column: str, bins: int = 4, rule: str = "width") -> list[float]:
    """Edges of equal width or of quantiles (repeated ones once). A handful of numbers on the driver."""
    x = double(column)
    if rule == "width":
        lo, hi = df.agg(F.min(x), F.max(x)).first()
        return [] if lo is None else [lo + (hi - lo) * k / bins for k in range(bins)] + [hi]
    if rule != "quantile":
        raise ValueError(f"unknown rule {rule!r}; there are width and quantile")
    found = df.agg(F.percentile(x, F.array(*(F.lit(k / bins) for k in range(bins + 1))))).first()[0]
    return sorted(set(found or []))


def bin_column(df: DataFrame, column: str, as_: str | None = None, bins: int = 4, rule: str = "width", labels: Sequence[str] | None = None) -> DataFrame:
    """Left-closed bins, the last closed at both ends; the label is [a, b) with six significant digits unless given."""
    at = edges(df, column, bins, rule)
    names = list(labels or [f"[{a:g}, {b:g})" for a, b in zip(at[:-1], at[1:], strict=True)])
    if labels and len(labels) != len(at) - 1:
        raise ValueError(f"{len(at) - 1} bins have {len(labels)} labels")
    out = F.lit(None).cast("string")
    for k in range(len(at) - 2, -1, -1):
        inside = double(column) >= at[k]
        inside = inside & ((double(column) <= at[k + 1]) if k == len(at) - 2 else (double(column) < at[k + 1]))
        out = F.when(inside, F.lit(names[k])).otherwise(out)
    return df.withColumn(as_ or f"{column}_bin", out)


def outliers(df: DataFrame, column: str, as_: str | None = None, rule: str = "iqr", k: float = 1.5, threshold: float = 3.0) -> DataFrame:
    """Adds a flag and the bounds low, high. iqr: k interquartile ranges outside the quartiles; zscore: threshold standard deviations."""
    x = double(column)
    if rule == "iqr":
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
        low, high = q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])
    elif rule == "zscore":
        low, high = F.avg(x) - threshold * F.stddev_pop(x), F.avg(x) + threshold * F.stddev_pop(x)
    else:
        raise ValueError(f"unknown rule {rule!r}; there are iqr and zscore")
    out = _with_aggregates(df, low.alias("low"), high.alias("high"))
    return out.withColumn(as_ or f"{column}_outlier", F.coalesce((x < F.col("low")) | (x > F.col("high")), F.lit(False)))
