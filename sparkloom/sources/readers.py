"""Sources and sinks: CSV and JSON tables, stores of addressed values, packed arrays, fixtures, synthetic matrices."""

from __future__ import annotations

import base64
import posixpath
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..table import unique


def safe_path(root: str, path: str) -> str:
    """root/path; a path that leaves the root is an error."""
    joined = posixpath.normpath(posixpath.join(root, path))
    if path.startswith("/") or "://" in path or not (joined + "/").startswith(root.rstrip("/") + "/"):
        raise ValueError(f"path {path!r} leaves {root!r}")
    return joined


def typed(column: str, missing: Sequence[str] = ()) -> dict[str, Column]:
    """What a text column could be: each kind's typed column, null where a cell isn't of it."""
    cell = F.trim(F.col(column))
    cell = F.when(F.lower(cell).isin([m.lower() for m in missing] + [""]), None).otherwise(cell)
    return {
        "boolean": F.when(F.lower(cell).isin("true", "false"), F.lower(cell) == "true"), "long": F.when(cell.rlike(r"^[+-]?\d+$"), cell.try_cast("bigint")),
        "double": F.when(cell.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), cell.try_cast("double")), "string": cell,
    }


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", missing: Sequence[str] = ()) -> DataFrame:
    """RFC 4180 with a trimmed header; a column is the narrowest of boolean, bigint, double and string that fits all
    its cells, after the missing spellings are nulls. A ragged line is an error. One pass infers all columns."""
    raw = spark.read.csv(path, header=True, sep=delimiter, quote='"', escape='"', multiLine=True, mode="FAILFAST", inferSchema=False)
    names = [c.strip() for c in raw.columns]
    unique(names)
    raw = raw.toDF(*names)
    kinds = {c: typed(c, missing) for c in names}
    counts = raw.agg(*(F.count(col).alias(f"{k}__{i}") for i, c in enumerate(names) for k, col in kinds[c].items())).first()
    pick = lambda i: next(k for k in ("boolean", "long", "double", "string") if counts[f"{k}__{i}"] == counts[f"string__{i}"])
    return raw.select(*(kinds[c][pick(i) if counts[f"string__{i}"] else "string"].alias(c) for i, c in enumerate(names)))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, or a table {"columns": [..], "rows": [[..]]}."""
    df = spark.read.json(path, multiLine=True, mode="FAILFAST")
    if set(df.columns) >= {"columns", "rows"}:
        names = df.select("columns").first()[0]
        rows = df.select(F.explode("rows").alias("r"))
        return rows.select(*(F.col("r")[i].alias(n) for i, n in enumerate(names)))
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def register(df: DataFrame, name: str, caption: str = "") -> DataFrame:
    """A named table with a caption."""
    df.createOrReplaceTempView(name)
    return df.withMetadata(df.columns[0], {"caption": caption}) if caption else df


def save_store(values: DataFrame, path: str) -> None:
    """Merge (address, value) into a store: what is new wins, the rest stays. Written beside and read as a union."""
    values.select("address", "value", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def load_store(spark: SparkSession, path: str) -> DataFrame:
    """(address, value): the latest write of each address."""
    rows = spark.read.parquet(path)
    return rows.groupBy("address").agg(F.max_by("value", "at").alias("value"))


def significant(column: Column, digits: int = 12) -> Column:
    """Rounded to significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(column))))
    return F.when(column == 0, F.lit(0.0)).otherwise(F.round(column * scale) / scale)


def pack(values: np.ndarray) -> dict:
    a = np.ascontiguousarray(values, "<f8")
    return {"dtype": "float64", "order": "C", "shape": list(a.shape), "b64": base64.b64encode(a.tobytes()).decode()}


def unpack(packed: dict) -> np.ndarray:
    return np.frombuffer(base64.b64decode(packed["b64"]), "<f8").reshape(packed["shape"])


@F.pandas_udf(T.BinaryType())
def pack_column(arrays: pd.Series) -> pd.Series:
    """Little-endian doubles of an array column."""
    return arrays.map(lambda a: np.asarray(a, "<f8").tobytes(), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unpack_column(packed: pd.Series) -> pd.Series:
    return packed.map(lambda b: np.frombuffer(b, "<f8"), na_action="ignore")


#: Small tables that examples and tests use: (schema, rows).
FIXTURES = {
    "basket": ("item string, shelf string, units bigint, price double, fresh boolean", [("pear", "a", 3, 1.5, True), ("plum", "a", 1, None, True), ("leek", "b", 7, 0.5, None), ("kale", "b", 2, 2.25, False), ("fig", None, 4, 3.0, True)]),
    "gaps": ("step bigint, reading double", [(0, None), (1, 2.0), (2, None), (3, 6.0), (4, None)]),
    "trades": ("t double, sym string, px double", [(1.0, "x", 10.0), (2.0, "y", 20.0), (3.0, "x", 11.0), (None, "x", 12.0)]),
    "quotes": ("t double, sym string, bid double", [(0.5, "x", 9.5), (1.0, "x", 9.9), (2.5, "y", 19.0), (3.5, "x", 10.5), (None, "x", 1.0)]),
}


def builtin(spark: SparkSession, name: str) -> DataFrame:
    if name not in FIXTURES:
        raise ValueError(f"unknown table {name!r}; there are {', '.join(FIXTURES)}")
    schema, rows = FIXTURES[name]
    return spark.createDataFrame(rows, schema)


def synthetic(spark: SparkSession, rows: int, columns: int, seed: int, kind: str = "normal") -> DataFrame:
    """A seeded matrix (i, j, v): normal, uniform, integers, or sorted (rising along each column)."""
    grid = spark.range(rows * columns).select((F.col("id") / columns).cast("long").alias("i"), F.pmod("id", F.lit(columns)).alias("j"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "i", "j"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    w = (F.pmod(F.xxhash64(F.lit(seed + 1), "i", "j"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = F.sqrt(-2 * F.ln(u)) * F.cos(2 * np.pi * w)
    values = {"normal": normal, "uniform": u, "integers": F.floor(u * 100).cast("double"), "sorted": u}
    if kind not in values:
        raise ValueError(f"unknown kind {kind!r}; there are {', '.join(values)}")
    out = grid.withColumn("v", values[kind])
    if kind == "sorted":
        out = out.withColumn("v", F.sum("v").over(Window.partitionBy("j").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return out


