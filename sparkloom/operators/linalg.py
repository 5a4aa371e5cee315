"""Linear algebra. A matrix is rows (i, j, v); a vector is rows (i, v). Products and sums run in Spark; factorisations
of k x k matrices run on the driver, behind a check of their size, as tall matrices reach it as their k x k gram."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..table import neighbourhoods, with_running

#: Side of a matrix that the driver factorises at most.
MOST = 4096


def entries(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """(i, j, v) of a table with one row per matrix row."""
    return df.select(F.col(row).alias("i"), F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("j", "v"))


def from_arrays(df: DataFrame, row: str, array: str) -> DataFrame:
    return df.select(F.col(row).alias("i"), F.posexplode(array).alias("j", "v")).select("i", "j", F.col("v").cast("double").alias("v"))


def to_numpy(m: DataFrame, most: int = MOST) -> np.ndarray:
    """A small matrix on the driver; larger than most x most is an error. Rows and columns in the order of their numbers."""
    r, c = m.agg(F.countDistinct("i"), F.countDistinct("j")).first()
    if max(r, c) > most:
        raise ValueError(f"a {r} x {c} matrix is over {most} x {most}")
    return m.toPandas().pivot(index="i", columns="j", values="v").fillna(0.0).sort_index().sort_index(axis=1).to_numpy(float)


def from_numpy(spark, a: np.ndarray) -> DataFrame:
    a = np.atleast_2d(np.asarray(a, float))
    i, j = np.indices(a.shape)
    return spark.createDataFrame(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": a.ravel()}), "i long, j long, v double")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.select("i", F.col("j").alias("k"), F.col("v").alias("u")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("w"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("u") * F.col("w")).alias("v"))


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """A'A of the columns of a tall table, in one pass."""
    k = len(columns)
    r = df.agg(*(F.sum(F.col(columns[i]).cast("double") * F.col(columns[j]).cast("double")).alias(f"{i}_{j}") for i in range(k) for j in range(i, k))).first()
    return np.array([[r[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], float)


def gram_of_arrays(df: DataFrame, array: str) -> DataFrame:
    """(i, j, v) of A'A where each row of A is an array: products are summed map-side, so d * d rows a task are shuffled."""
    x = F.transform(array, lambda v: v.cast("double"))
    cells = df.select(x.alias("x")).select("x", F.posexplode("x").alias("i", "u")).select("i", "u", F.posexplode("x").alias("j", "w"))
    return cells.groupBy("i", "j").agg(F.sum(F.col("u") * F.col("w")).alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def trace(m: DataFrame) -> DataFrame:
    return m.filter("i = j").agg(F.sum("v").alias("trace"))


def norm(m: DataFrame, kind: str = "fro") -> DataFrame:
    """1 (largest column sum), inf (largest row sum), fro, 2 (of a vector as fro)."""
    if kind in ("fro", "2"):
        return m.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    if kind not in ("1", "inf"):
        raise ValueError(f"unknown norm {kind!r}; there are 1, 2, inf, fro")
    return m.groupBy("j" if kind == "1" else "i").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm"))


def outer(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every product of two vectors (i, v); the result has that many entries by definition."""
    return a.crossJoin(b.select(F.col("i").alias("j"), F.col("v").alias("w"))).select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def _square(a: np.ndarray) -> np.ndarray:
    if a.shape[0] != a.shape[1]:
        raise ValueError(f"a {a.shape[0]} x {a.shape[1]} matrix isn't square")
    return a


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(_square(a), b)


def lstsq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=None)[0]


def eig(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a symmetric matrix, falling; each vector's largest entry is positive."""
    w, v = np.linalg.eigh(_square(a))
    w, v = w[::-1], v[:, ::-1]
    return w, v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])


def svd_values(a: np.ndarray) -> np.ndarray:
    return np.linalg.svd(a, compute_uv=False)


def svd_values_of_gram(g: np.ndarray) -> np.ndarray:
    """Singular values of a tall matrix from its gram."""
    return np.sqrt(np.maximum(np.linalg.eigvalsh(g)[::-1], 0))


def cholesky(a: np.ndarray) -> np.ndarray:
    if not np.allclose(a, a.T):
        raise ValueError("the matrix isn't symmetric")
    return np.linalg.cholesky(a)


def inv(a: np.ndarray) -> np.ndarray:
    return np.linalg.inv(_square(a))


def pinv(a: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(a)


def qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reduced, with a positive diagonal."""
    q, r = np.linalg.qr(a)
    s = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * s, r * s[:, None]


def matrix_rank(a: np.ndarray) -> int:
    return int(np.linalg.matrix_rank(a))


def fft(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(values)
    if n & (n - 1):
        raise ValueError(f"{n} isn't a power of two")
    f = np.fft.fft(values)
    return f.real, f.imag


# vectors ---------------------------------------------------------------------------------------------


def cumsum(df: DataFrame, value: str = "v", order: str = "i") -> DataFrame:
    return with_running(df, [order], {"cumsum": ("sum", value)})


def diff(df: DataFrame, value: str = "v", order: str = "i", times: int = 1) -> DataFrame:
    out, w = neighbourhoods(df.withColumn("diff", F.col(value).cast("double")), [order], before=times)
    for _ in range(times):
        out = out.withColumn("diff", F.col("diff") - F.lag("diff").over(w))
    return out.filter(F.col("diff").isNotNull() & ~F.col("halo__")).drop("pos__", "block__", "halo__")


def gradient(df: DataFrame, value: str = "v", order: str = "i") -> DataFrame:
    """Central differences, one-sided at the ends."""
    rows, w = neighbourhoods(df, [order], before=1, after=1)
    x = F.col(value).cast("double")
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    out = rows.withColumn("gradient", F.when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2))
    return out.filter(~F.col("halo__")).drop("pos__", "block__", "halo__")


def convolve(df: DataFrame, kernel: list[float], value: str = "v", order: str = "i", mode: str = "full") -> DataFrame:
    """(k, v) of the convolution of a long vector with a short kernel: each value is spread to len(kernel) sums."""
    n = df.agg(F.min(order), F.count(F.lit(1))).first()
    spread = df.select(F.col(order).alias("at"), F.col(value).cast("double").alias("x"), F.posexplode(F.array(*map(F.lit, map(float, kernel)))).alias("m", "w"))
    out = spread.groupBy((F.col("at") - n[0] + F.col("m")).alias("k")).agg(F.sum(F.col("x") * F.col("w")).alias("v"))
    if mode == "full":
        return out
    start = (len(kernel) - 1) // 2
    return out.filter(F.col("k").between(start, start + n[1] - 1)).select((F.col("k") - start).alias("k"), "v")


def correlate(df: DataFrame, kernel: list[float], value: str = "v", order: str = "i") -> DataFrame:
    """(k, v), valid part: sums of kernel times the values from k on."""
    n = df.agg(F.count(F.lit(1))).first()[0]
    full = convolve(df, kernel[::-1], value, order)
    return full.filter(F.col("k").between(len(kernel) - 1, n - 1)).select((F.col("k") - len(kernel) + 1).alias("k"), "v")


def interp(x: Column, xp: list[float], fp: list[float]) -> Column:
    """Piecewise linear through (xp, fp), clamped at the ends."""
    out = F.lit(float(fp[-1]))
    for k in range(len(xp) - 2, -1, -1):
        line = fp[k] + (x - xp[k]) * ((fp[k + 1] - fp[k]) / (xp[k + 1] - xp[k]))
        out = F.when(x < xp[k + 1], line).otherwise(out)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x <= xp[0], F.lit(float(fp[0]))).otherwise(out)


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Between two arrays."""
    gap = F.zip_with(a, b, lambda p, q: p.cast("double") - q.cast("double"))
    if metric == "euclidean":
        return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, d: s + d * d))
    if metric == "cityblock":
        return F.aggregate(gap, F.lit(0.0), lambda s, d: s + F.abs(d))
    raise ValueError(f"unknown metric {metric!r}; there are euclidean and cityblock")


def pairwise(queries: DataFrame, base: DataFrame, key: str, array: str, metric: str = "euclidean", block: int = 20_000) -> DataFrame:
    """(a, b, distance) of a stated set of query rows against all rows. Up to `block` queries, counted, are broadcast; more are dealt
    into blocks, each of which meets every row in a join by the block's number."""
    q, y = queries.select(F.col(key).alias("a"), F.col(array).alias("x")), base.select(F.col(key).alias("b"), F.col(array).alias("y"))
    blocks = -(-q.count() // block)
    if blocks <= 1:
        met = y.crossJoin(F.broadcast(q))
    else:
        met = y.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(q.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int")), "block")
    return met.select("a", "b", distance(F.col("x"), F.col("y"), metric).alias("distance"))
