"""Shared checks and helpers: named columns, explicit row order, two-valued predicates."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name of the column that carries the order of rows; DataFrames themselves have none.
POSITION = "_pos"


def require(df: DataFrame, columns: Iterable[str]) -> None:
    """ValueError that names what is present where a column isn't."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown column {', '.join(map(repr, missing))}; there are {', '.join(map(repr, df.columns))}")


def unique(names: Sequence[str]) -> None:
    twice = sorted({n for n in names if list(names).count(n) > 1})
    if twice:
        raise ValueError(f"column name given twice: {', '.join(map(repr, twice))}")


def numeric(df: DataFrame, *columns: str) -> None:
    require(df, columns)
    for c in columns:
        if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)):
            raise ValueError(f"column {c!r} is {df.schema[c].dataType.simpleString()}, not numeric")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def double(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def with_position(df: DataFrame, order: Sequence[str] = (), name: str = POSITION) -> DataFrame:
    """Adds a 0-based position in the order of `order`, or in the order of the partitions as they are read.

    No task sees the whole table: rows are dealt to ranges of the order (equal keys to one) and sorted there, and each
    partition's offset, the sum of the counts before it, is added. Only one count per partition reaches the driver.
    """
    marked = _in_ranges(df, order)
    counts, offsets, at = sorted(tuple(r) for r in marked.groupBy("part__").count().collect()), [], 0
    for part, n in counts:
        offsets.append((part, at))
        at += n
    before = df.sparkSession.createDataFrame(offsets, "part__ int, before__ long")
    return marked.join(F.broadcast(before), "part__").select(*(f"`{c}`" for c in df.columns), (F.col("before__") + F.col("row__")).alias(name))


def _in_ranges(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """df with part__, the range of the order that a row is in, and row__, its place there; cut from its lineage, so both stay."""
    base = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    pid = F.spark_partition_id()
    return checkpointed(base.select("*", pid.alias("part__"), (F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)).alias("row__")))


def with_running(df: DataFrame, order: Sequence[str | Column], columns: dict[str, tuple[str, str | Column]]) -> DataFrame:
    """Adds running values over the whole table in the order of `order`: name -> ("sum", "max" or "min", of what), up to and with each row.

    No task sees the whole table: each range of the order is accumulated by itself, and what the ranges before it
    come to, one row per range, is combined on the driver and added.
    """
    marked = _in_ranges(df.withColumns({f"v__{k}": (F.col(c) if isinstance(c, str) else c) for k, (_, c) in columns.items()}), order)
    kinds = {k: getattr(F, fn) for k, (fn, _) in columns.items()}
    join = {"sum": lambda x, y: x + y, "max": max, "min": min}
    parts = sorted((r.asDict() for r in marked.groupBy("part__").agg(*(f(f"v__{k}").alias(k) for k, f in kinds.items())).collect()), key=lambda r: r["part__"])
    carry, rows = dict.fromkeys(columns), []
    for part in parts:
        rows.append((part["part__"], *carry.values()))
        for k, (fn, _) in columns.items():
            carry[k] = part[k] if carry[k] is None else carry[k] if part[k] is None else join[fn](carry[k], part[k])
    kind = marked.groupBy("part__").agg(*(f(f"v__{k}").alias(f"c__{k}") for k, f in kinds.items())).schema
    before = df.sparkSession.createDataFrame(rows, kind)
    w = Window.partitionBy("part__").orderBy("row__").rowsBetween(Window.unboundedPreceding, 0)
    out = marked.join(F.broadcast(before), "part__")
    for k, (fn, _) in columns.items():
        own, carried = kinds[k](f"v__{k}").over(w), F.col(f"c__{k}")
        both = own + carried if fn == "sum" else (F.greatest if fn == "max" else F.least)(own, carried)
        out = out.withColumn(k, F.coalesce(both, own, carried))
    return out.drop("part__", "row__", *(f"v__{k}" for k in columns), *(f"c__{k}" for k in columns))


def neighbourhoods(df: DataFrame, order: Sequence[str], before: int = 0, after: int = 0, rows: int = 100_000) -> tuple[DataFrame, WindowSpec]:
    """df in blocks of consecutive rows with copies, marked halo__, of up to `before` rows before and `after` rows after each block, and
    the window over which lag and lead see them. Drop halo__ rows after the last use. No task sees more than a block."""
    numbered = with_position(df, order, "pos__")
    block = F.floor(F.col("pos__") / rows)
    own = numbered.select("*", block.alias("block__"), F.lit(False).alias("halo__"))
    if after:
        own = own.unionByName(numbered.filter((F.col("pos__") % rows < after) & (F.col("pos__") >= rows)).select("*", (block - 1).alias("block__"), F.lit(True).alias("halo__")))
    if before:
        own = own.unionByName(numbered.filter(F.col("pos__") % rows >= rows - before).select("*", (block + 1).alias("block__"), F.lit(True).alias("halo__")))
    return own, Window.partitionBy("block__").orderBy("pos__")


def ordered(order: Sequence[str], partition: Sequence[str] = ()) -> WindowSpec:
    w = Window.partitionBy(*partition) if partition else Window.partitionBy()
    return w.orderBy(*order)


def up_to_here(order: Sequence[str], partition: Sequence[str] = ()) -> WindowSpec:
    return ordered(order, partition).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder of spark.checkpoint.dir (a temporary one only where none is set on one machine)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def broadcastable(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast hint where df has at most `rows` rows, counted; else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded(df: DataFrame, rows: int, what: str) -> DataFrame:
    """df, if it has at most `rows` rows; an operator that compares all pairs refuses more."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"{what} compares all pairs of rows, so it takes {rows} at most; pass a sample")
    return df


#: Rows of one key that a join leaves in one task at least, and the most keys that are hot.
KEY_ROWS, HOT_KEYS = 1000, 100_000


def salted_join(rows: DataFrame, unique: DataFrame, keys: list[str], counts: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """`rows` joined with `unique` (one row for each key), hot keys dealt by a hash of the column `by`.

    counts: (keys, n), how many of `rows` have each key. A key with more rows than the greater of KEY_ROWS and one
    HOT_KEYSth of all rows is hot, so fewer than HOT_KEYS are, whatever the input: that bounds what is broadcast.
    Their rows go to as many tasks as they fill, and the one row that they meet is copied as often.
    """
    total, largest = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    most = max(KEY_ROWS, total // HOT_KEYS)
    if largest <= most:
        return rows.join(unique, keys, how)
    hot = counts.filter(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("salts"))
    hot, salts = F.broadcast(hot), F.coalesce("salts", F.lit(1))
    left = rows.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("salts")
    right = unique.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, [*keys, "salt"], how).drop("salt")
