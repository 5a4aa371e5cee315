"""Grouped aggregation, reshaping, and constraint-style counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..table import double, numeric_columns, require, unique

AGGREGATES = ("count", "count_missing", "sum", "mean", "median", "min", "max", "var", "std", "nunique", "first", "last")


def aggregate(kind: str, column: str | None, order: Sequence[str] = ()) -> Column:
    """One of AGGREGATES over the cells that aren't null; var and std are of a sample (fewer than two: null).

    first and last follow `order`; a struct of the order and the cell makes them deterministic.
    """
    if kind not in AGGREGATES:
        raise ValueError(f"unknown aggregate {kind!r}; there are {', '.join(AGGREGATES)}")
    if kind == "count" and column is None:
        return F.count(F.lit(1))
    if kind == "count_missing":
        return F.lit(0).cast("long") if column is None else F.coalesce(F.sum(F.col(column).isNull().cast("long")), F.lit(0))
    if column is None:
        raise ValueError(f"{kind} needs a column")
    c = F.col(column)
    if kind in ("first", "last"):
        if not order:
            return F.first(c, True) if kind == "first" else F.last(c, True)
        at = F.when(c.isNotNull(), F.struct(*order))
        return F.min_by(c, at) if kind == "first" else F.max_by(c, at)
    plain = {"count": F.count, "nunique": F.countDistinct, "min": F.min, "max": F.max}
    if kind in plain:
        return plain[kind](c)
    return {"sum": F.sum, "mean": F.avg, "median": F.median, "var": F.var_samp, "std": F.stddev_samp}[kind](double(c))


def group_by(df: DataFrame, by: Sequence[str], aggregates: Sequence[Mapping], order: Sequence[str] = (), sort: bool = False) -> DataFrame:
    """aggregates: {"column", "fn", "as"}, named column_fn by default. Null keys are a group; no rows give no groups, with or without keys."""
    names = [a.get("as") or f"{a.get('column') or 'rows'}_{a['fn']}" for a in aggregates]
    unique([*by, *names])
    require(df, [*by, *(a["column"] for a in aggregates if a.get("column"))])
    columns = [aggregate(a["fn"], a.get("column"), order).alias(n) for a, n in zip(aggregates, names, strict=True)]
    if not by:
        return df.agg(F.count(F.lit(1)).alias("rows__"), *columns).filter("rows__ > 0").drop("rows__")
    out = df.groupBy(*by).agg(*columns)
    return out.orderBy(*(F.col(c).asc_nulls_first() for c in by)) if sort else out


def salted_sum(df: DataFrame, by: Sequence[str], column: str, name: str, salts: int = 32) -> DataFrame:
    """A sum in two shuffles, for keys of which one holds a large share of rows and whose partial sums stay many."""
    part = df.withColumn("salt__", F.pmod(F.monotonically_increasing_id(), F.lit(salts))).groupBy(*by, "salt__").agg(F.sum(double(column)).alias("part__"))
    return part.groupBy(*by).agg(F.sum("part__").alias(name))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None, variable: str = "variable", value: str = "value", drop_missing: bool = False) -> DataFrame:
    values = list(values or [c for c in df.columns if c not in ids])
    require(df, [*ids, *values])
    out = df.unpivot(list(ids), values, variable, value)
    return out.filter(F.col(value).isNotNull()) if drop_missing else out


def pivot(df: DataFrame, index: str, columns: str, values: str, agg: str = "sum", heads: Sequence | None = None, fill=None, most: int = 10_000, order: Sequence[str] = ()) -> DataFrame:
    """Long to wide, one aggregate; heads in order, a null head is named ''. fill goes where a combination has no rows at all.

    Heads are looked up unless given; more than `most` are an error, as each is a column.
    """
    require(df, [index, columns, values])
    if heads is None:
        found = [r[0] for r in df.select(columns).distinct().limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"column {columns!r} has more than {most} values")
        heads = sorted(found, key=lambda v: (v is not None, v))
    out = df.groupBy(index, F.col(columns).alias("head__")).agg(aggregate(agg, values, order).alias("cell__"))
    wide = [F.max(F.when(F.col("head__").eqNullSafe(F.lit(h)), F.struct(F.col("cell__"))))["cell__"].alias(f"c{k}__") for k, h in enumerate(heads)]
    seen = [F.max(F.when(F.col("head__").eqNullSafe(F.lit(h)), F.lit(1))).alias(f"n{k}__") for k, h in enumerate(heads)]
    grouped = out.groupBy(index).agg(*wide, *seen)
    pick = lambda k: F.when(F.col(f"n{k}__").isNull(), F.lit(fill)).otherwise(F.col(f"c{k}__")) if fill is not None else F.col(f"c{k}__")
    return grouped.select(index, *(pick(k).alias("" if h is None else str(h)) for k, h in enumerate(heads)))


def crosstab(df: DataFrame, index: str, columns: str, margins: bool = False) -> DataFrame:
    """Counts of pairs as a wide table, 0 for absent ones; margins add a row and a column `total`."""
    require(df, [index, columns])
    counts = df.groupBy(F.col(index).cast("string").alias(index), F.col(columns).cast("string").alias(columns)).count()
    heads = sorted(r[0] or "" for r in counts.select(columns).distinct().collect())
    named = counts.withColumn(columns, F.coalesce(F.col(columns), F.lit("")))
    wide = named.groupBy(index).pivot(columns, heads).agg(F.sum("count")).fillna(0, heads)
    if not margins:
        return wide
    wide = wide.withColumn("total", sum((F.col(f"`{h}`") for h in heads), F.lit(0)))
    total = wide.agg(*(F.sum(f"`{h}`").alias(h) for h in [*heads, "total"])).select(F.lit("total").alias(index), *(F.col(f"`{h}`") for h in [*heads, "total"]))
    return wide.unionByName(total)


def missing(df: DataFrame, strategy: str = "drop", columns: Sequence[str] | None = None, how: str = "any", value=None, order: Sequence[str] = (), partition: Sequence[str] = ()) -> DataFrame:
    """drop (any/all), constant, mean, median, forward or backward; a column without cells is left alone."""
    columns = list(columns or df.columns)
    require(df, [*columns, *order])
    if strategy == "drop":
        return df.na.drop(how, subset=columns)
    if strategy == "constant":
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(value).cast(df.schema[c].dataType)) for c in columns})
    if strategy in ("mean", "median"):
        f = F.avg if strategy == "mean" else F.median
        centre = df.agg(*(f(double(c)).alias(f"m__{c}") for c in columns))
        return df.crossJoin(F.broadcast(centre)).select(*(F.coalesce(double(c), F.col(f"m__{c}")).alias(c) if c in columns else F.col(c) for c in df.columns))  # one row
    if strategy not in ("forward", "backward"):
        raise ValueError(f"unknown strategy {strategy!r}; there are drop, constant, mean, median, forward, backward")
    w = Window.partitionBy(*partition).orderBy(*order)
    if strategy == "forward":
        return df.withColumns({c: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in columns})
    return df.withColumns({c: F.first(c, True).over(w.rowsBetween(0, Window.unboundedFollowing)) for c in columns})


def missing_report(df: DataFrame) -> DataFrame:
    """column, missing, present, fraction of each column, and complete rows, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.greatest(*(F.col(c).isNull().cast("int") for c in df.columns), F.lit(0)) == 0, 1).otherwise(0)).alias("complete"), *(F.count(c).alias(f"p__{c}") for c in df.columns))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"p__{c}").alias("present")) for c in df.columns))
    out = one.select("n", "complete", F.inline(cells))
    return out.select("column", (F.col("n") - F.col("present")).alias("missing"), "present", F.try_divide(F.col("n") - F.col("present"), F.col("n")).alias("fraction"), F.coalesce("complete", F.lit(0)).cast("long").alias("complete_rows"))


def shape(df: DataFrame) -> DataFrame:
    """column, kind (empty, boolean, number or text) and the number of rows; a typed column is never mixed."""
    kinds = {c: "boolean" if t == "boolean" else "text" if t == "string" else "number" if c in numeric_columns(df) else t for c, t in df.dtypes}
    one = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(f"p__{c}") for c in df.columns))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.when(F.col(f"p__{c}") == 0, F.lit("empty")).otherwise(F.lit(kinds[c])).alias("kind")) for c in df.columns))
    return one.select(F.inline(cells), "rows").select("column", "kind", "rows")


def describe_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: n, missing, distinct, mean, stdev (sample), min, q25, median, q75, max; numbers are null for other columns."""
    columns = list(columns or df.columns)
    require(df, columns)
    numbers = set(numeric_columns(df))
    out = []
    for c in columns:
        x = double(c) if c in numbers else F.lit(None).cast("double")
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        out += [F.count(c).alias(f"n__{c}"), F.countDistinct(c).alias(f"d__{c}"), F.struct(F.avg(x).alias("mean"), F.stddev_samp(x).alias("stdev"), F.min(x).alias("min"), q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"), F.max(x).alias("max")).alias(f"s__{c}")]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *out)
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit("number" if c in numbers else "text").alias("kind"), F.col(f"n__{c}").alias("n"), (F.col("rows") - F.col(f"n__{c}")).alias("missing"), F.col(f"d__{c}").alias("distinct"), F.col(f"s__{c}").alias("s")) for c in columns))
    return one.select(F.inline(cells)).select("column", "kind", "n", "missing", "distinct", "s.*")
