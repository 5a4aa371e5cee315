"""Machine learning: models whose fit is a few passes of sums run in Spark; those that are sequential or quadratic by
nature run on a bounded sample on the driver and score in Arrow batches. MLlib trains the tree ensembles."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..table import checkpointed, double, require, salted_join, with_position, with_running
from . import linalg
from .regression import ols, predict
from .transform import average_ranks

#: Rows of a sample that the driver works on at most.
SAMPLE = 2_000


# splits ----------------------------------------------------------------------------------------------


def shuffled(df: DataFrame, key: Sequence[str], seed: int, partition: Sequence[str] = ()) -> DataFrame:
    """Adds n__, a row number from 1 in the order of a seeded hash of the key, of each partition or by ranges of the hash."""
    if not partition:
        hashed = df.withColumn("hash__", F.xxhash64(F.lit(seed), *key))
        return with_position(hashed, ["hash__", *key], "n__").withColumn("n__", F.col("n__") + 1).drop("hash__")
    return df.withColumn("n__", F.row_number().over(Window.partitionBy(*partition).orderBy(F.xxhash64(F.lit(seed), *key), *key)))


def train_test_split(df: DataFrame, key: Sequence[str], seed: int, test_size: float = 0.25, stratify: str | None = None) -> DataFrame:
    """Adds is_test for exactly round(n * test_size) rows, of each stratum where one is given."""
    part = [stratify] if stratify else []
    n = F.count(F.lit(1)).over(Window.partitionBy(*part)) if part else F.lit(df.count())
    return shuffled(df, key, seed, part).withColumn("is_test", F.col("n__") <= F.bround(n * test_size)).drop("n__")


def kfold(df: DataFrame, key: Sequence[str], seed: int, k: int = 5) -> DataFrame:
    """Adds fold 0 .. k-1 whose sizes differ by one at most."""
    return shuffled(df, key, seed).withColumn("fold", F.pmod(F.col("n__") - 1, F.lit(k))).drop("n__")


def subset(df: DataFrame, positions: DataFrame, position: str) -> DataFrame:
    """Rows at the given positions; a position that is listed twice gives its row twice."""
    return positions.join(df, position)


# nearest neighbours ----------------------------------------------------------------------------------


def knn_predict(train: DataFrame, queries: DataFrame, key: str, array: str, target: str, k: int = 5, metric: str = "euclidean", weights: str = "uniform", task: str = "classify") -> DataFrame:
    """(key, prediction): neighbours by distance, then key; vote ties go to the smallest label.

    Exact and brute: blocks of queries meet blocks of rows as arrays. Products find the rows that can be among the k best of a block,
    differences measure these, and only the k best of each pair of blocks leave a task.
    """
    if metric not in ("euclidean", "cityblock"):
        raise ValueError(f"unknown metric {metric!r}; there are euclidean and cityblock")
    q = packed(queries.withColumn("none__", F.lit(None).cast("int")), key, array, "none__", BLOCK_ROWS)
    t = packed(train, key, array, target, BLOCK_ROWS)
    schema = train.select(F.col(key).alias("q__"), F.col(key).alias("t__"), F.col(target).alias("y__"), F.lit(0.0).alias("d__")).schema
    like = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    matrix, _ = kernels()

    def nearest(batches):
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (kq, xq, _), (kt, xt, yt) = pickle.loads(a), pickle.loads(b)
                fine_q, fine_t = matrix(xq)[0], matrix(xt)[0]
                by_key, out = np.empty(len(kt), np.int64), {"q__": [], "t__": [], "y__": [], "d__": []}
                by_key[sorted(range(len(kt)), key=lambda i: (kt[i] is not None, kt[i]))] = np.arange(len(kt))
                for dim in sorted(set(fine_q) & set(fine_t) - {-1}):
                    i, j = np.flatnonzero(fine_q == dim), np.flatnonzero(fine_t == dim)
                    u, v = np.array([xq[r] for r in i], float).reshape(len(i), dim), np.array([xt[r] for r in j], float).reshape(len(j), dim)
                    uu, vv = (u * u).sum(axis=1)[:, None], (v * v).sum(axis=1)[None, :]
                    for p, row in enumerate(uu + vv - 2 * (u @ v.T) if metric == "euclidean" else [None] * len(i)):
                        near = np.arange(len(j))
                        if row is not None and len(j) > k and np.isfinite(row).all():
                            slack = 1e-9 * (uu[p, 0] + vv[0])  # far above the error of the products
                            near = np.flatnonzero(row - slack <= np.partition(row + slack, k - 1)[k - 1])
                        d = np.zeros(len(near))
                        for c in range(dim):  # in the order of the cells, as SQL sums
                            gap = u[p, c] - v[near, c]
                            d += gap * gap if metric == "euclidean" else np.abs(gap)
                        d = np.sqrt(d) if metric == "euclidean" else d
                        for r in np.lexsort([by_key[j[near]], d])[:k]:
                            at = j[near[r]]
                            for name, value in zip(out, (kq[i[p]], kt[at], yt[at], float(d[r])), strict=True):
                                out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, like)

    part = q.select(F.col("data").alias("a")).crossJoin(t.select(F.col("data").alias("b"))).mapInArrow(nearest, schema)
    best = part.withColumn("n__", F.row_number().over(Window.partitionBy("q__").orderBy("d__", "t__"))).filter(F.col("n__") <= k)
    w = F.lit(1.0) if weights == "uniform" else 1 / (F.col("d__") + 1e-12)
    if task == "regress":
        return best.groupBy(F.col("q__").alias(key)).agg((F.sum(w * double("y__")) / F.sum(w)).alias("prediction"))
    votes = best.groupBy("q__", "y__").agg(F.sum(w).alias("v__"))
    return votes.withColumn("n__", F.row_number().over(Window.partitionBy("q__").orderBy(F.desc("v__"), "y__"))).filter("n__ = 1").select(F.col("q__").alias(key), F.col("y__").alias("prediction"))


# naive Bayes -----------------------------------------------------------------------------------------


def gaussian_nb_fit(df: DataFrame, x: Sequence[str], target: str, var_smoothing: float = 1e-9) -> dict:
    """Class shares, means and population variances, plus a share of the largest variance of any feature."""
    rows = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"), *(F.avg(double(c)).alias(f"m_{c}") for c in x), *(F.var_pop(double(c)).alias(f"v_{c}") for c in x)).collect()
    extra = var_smoothing * max(df.agg(*(F.var_pop(double(c)) for c in x)).first())
    total = sum(r["n"] for r in rows)
    return {"x": list(x), "classes": {r[target]: {"prior": r["n"] / total, "mean": [r[f"m_{c}"] for c in x], "var": [r[f"v_{c}"] + extra for c in x]} for r in sorted(rows, key=lambda r: r[target])}}


def gaussian_nb_predict(df: DataFrame, model: dict, as_: str = "prediction") -> DataFrame:
    scores = []
    for label, c in model["classes"].items():
        s = F.lit(math.log(c["prior"]) - 0.5 * sum(math.log(2 * math.pi * v) for v in c["var"]))
        for name, m, v in zip(model["x"], c["mean"], c["var"], strict=True):
            s = s - F.pow(double(name) - m, 2) / (2 * v)
        scores.append(F.struct(s.alias("s"), F.lit(-len(scores)).alias("first"), F.lit(label).alias("label")))
    return df.withColumn(as_, F.array_max(F.array(*scores))["label"])


def multinomial_nb_fit(df: DataFrame, x: Sequence[str], target: str, alpha: float = 1.0) -> dict:
    rows = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"), *(F.sum(double(c)).alias(c) for c in x)).collect()
    total = sum(r["n"] for r in rows)
    return {"x": list(x), "classes": {r[target]: {"prior": math.log(r["n"] / total), "log": [math.log((r[c] + alpha) / (sum(r[k] for k in x) + alpha * len(x))) for c in x]} for r in sorted(rows, key=lambda r: r[target])}}


def multinomial_nb_predict(df: DataFrame, model: dict, as_: str = "prediction") -> DataFrame:
    scores = [F.struct(sum((double(n) * w for n, w in zip(model["x"], c["log"], strict=True)), F.lit(c["prior"])).alias("s"), F.lit(-k).alias("first"), F.lit(label).alias("label")) for k, (label, c) in enumerate(model["classes"].items())]
    return df.withColumn(as_, F.array_max(F.array(*scores))["label"])


# linear models ---------------------------------------------------------------------------------------


def _vectors(df: DataFrame, x: Sequence[str]) -> DataFrame:
    require(df, x)
    return VectorAssembler(inputCols=list(x), outputCol="features__").transform(df)


def linreg_fit(df: DataFrame, x: Sequence[str], target: str, l2: float = 0.0, fit_intercept: bool = True) -> dict:
    return ols(df, x, target, fit_intercept, lam=l2)


linreg_predict = predict


def softmax_fit(df: DataFrame, x: Sequence[str], target: str, l2: float = 0.0, epochs: int = 100):
    """Multinomial logistic regression; targets are 0 .. classes-1."""
    return LogisticRegression(featuresCol="features__", labelCol=target, family="multinomial", regParam=l2, maxIter=epochs).fit(_vectors(df, x))


def logreg_fit(df: DataFrame, x: Sequence[str], target: str, l2: float = 0.0, epochs: int = 100):
    return LogisticRegression(featuresCol="features__", labelCol=target, family="auto", regParam=l2, maxIter=epochs).fit(_vectors(df, x))


def model_predict(model, df: DataFrame, x: Sequence[str], as_: str = "prediction", proba: str | None = None) -> DataFrame:
    out = model.transform(_vectors(df, x))
    keep = [*df.columns, F.col(model.getPredictionCol()).alias(as_)]
    if proba:
        from pyspark.ml.functions import vector_to_array

        keep.append(vector_to_array("probability").alias(proba))
    return out.select(*keep)


def lasso_fit(df: DataFrame, x: Sequence[str], target: str, alpha: float = 0.1, max_iter: int = 1000, tol: float = 1e-10) -> dict:
    """Coordinate descent on the products of centred columns: two passes over the rows, then k x k work. Loss: rss / 2n + alpha |b|."""
    from .regression import centred, products

    moved, z, means, y_mean, n, _ = centred(df, x, target, True, None)
    xx, xy, _ = products(moved, z)
    b = np.zeros(len(x))
    for _ in range(max_iter):
        before = b.copy()
        for j in range(len(b)):
            rho = xy[j] - xx[j] @ b + xx[j, j] * b[j]
            b[j] = np.sign(rho) * max(abs(rho) - alpha * n, 0) / xx[j, j] if xx[j, j] > 0 else 0.0
        if np.abs(b - before).max() < tol:
            break
    return {"names": ["intercept", *x], "coefficients": [float(y_mean - means @ b), *b.tolist()]}


def lasso_path(df: DataFrame, x: Sequence[str], target: str, alphas: Sequence[float] = (0.001, 0.01, 0.1, 1.0)) -> DataFrame:
    fits = [(float(a), lasso_fit(df, x, target, a)) for a in alphas]
    rows = [(a, n, c) for a, f in fits for n, c in zip(f["names"], f["coefficients"], strict=True)]
    return df.sparkSession.createDataFrame(rows, "alpha double, name string, coefficient double")


# trees -----------------------------------------------------------------------------------------------


def tree_fit(df: DataFrame, x: Sequence[str], target: str, max_depth: int = 5, bins: int = 32, min_leaf: int = 1, seed: int = 0):
    return DecisionTreeRegressor(featuresCol="features__", labelCol=target, maxDepth=max_depth, maxBins=bins, minInstancesPerNode=min_leaf, seed=seed).fit(_vectors(df, x))


def forest_fit(df: DataFrame, x: Sequence[str], target: str, n_trees: int = 10, max_depth: int = 6, seed: int = 0, task: str = "classify"):
    kind = RandomForestClassifier if task == "classify" else RandomForestRegressor
    return kind(featuresCol="features__", labelCol=target, numTrees=n_trees, maxDepth=max_depth, seed=seed).fit(_vectors(df, x))


def forest_oob(df: DataFrame, x: Sequence[str], target: str, key: Sequence[str], n_trees: int = 10, max_depth: int = 6, seed: int = 0) -> DataFrame:
    """Out-of-bag accuracy of a voting forest whose trees are fitted on Poisson bootstraps by a seeded hash: (rows, accuracy)."""
    votes = None
    for k in range(n_trees):
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *key), F.lit(1 << 20)) / float(1 << 20)
        times = sum(((u > c).cast("int") for c in np.cumsum([math.exp(-1) / math.factorial(i) for i in range(8)]).tolist()), F.lit(0))
        bag = df.withColumn("t__", times)
        tree = tree_fit(bag.filter("t__ > 0").withColumn("e__", F.explode(F.sequence(F.lit(1), F.col("t__")))).drop("e__"), x, target, max_depth, seed=seed + k)
        out = model_predict(tree, bag.filter("t__ = 0"), x, "p__").select(*key, F.col(target).alias("y__"), F.round("p__").alias("p__"))
        votes = out if votes is None else votes.union(out)
    tally = votes.groupBy(*key, "y__", "p__").count()
    best = tally.withColumn("n__", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("count"), "p__"))).filter("n__ = 1")
    return best.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("y__") == F.col("p__")).cast("double")).alias("accuracy"))


def gbm_fit(df: DataFrame, x: Sequence[str], target: str, n_trees: int = 25, rate: float = 0.1, max_depth: int = 2, task: str = "regress", seed: int = 0):
    kind = GBTRegressor if task == "regress" else GBTClassifier
    return kind(featuresCol="features__", labelCol=target, maxIter=n_trees, stepSize=rate, maxDepth=max_depth, seed=seed).fit(_vectors(df, x))


# sequential models on a bounded sample ---------------------------------------------------------------


def local_sample(df: DataFrame, x: Sequence[str], target: str | None, key: Sequence[str], rows: int = SAMPLE) -> tuple[np.ndarray, np.ndarray | None]:
    """At most `rows` rows, in the order of a hash of the key, as numpy arrays."""
    pdf = df.select(*(double(c).alias(f"x{i}") for i, c in enumerate(x)), *([F.col(target).alias("y")] if target else []), *(F.col(k).alias(f"k{i}") for i, k in enumerate(key))).orderBy(F.xxhash64(*(f"k{i}" for i in range(len(key)))), *(f"k{i}" for i in range(len(key)))).limit(rows).toPandas()
    return pdf[[f"x{i}" for i in range(len(x))]].to_numpy(float), pdf["y"].to_numpy() if target else None


def perceptron_fit(x: np.ndarray, y: np.ndarray, rate: float = 1.0, epochs: int = 30, seed: int = 0) -> dict:
    """Rosenblatt's rule in a seeded order; y is 0 or 1."""
    w, rng = np.zeros(x.shape[1] + 1), np.random.default_rng(seed)
    z, s = np.column_stack([np.ones(len(x)), x]), np.where(y > 0, 1, -1)
    for _ in range(epochs):
        wrong = 0
        for i in rng.permutation(len(x)):
            if s[i] * (z[i] @ w) <= 0:
                w += rate * s[i] * z[i]
                wrong += 1
        if not wrong:
            break
    return {"weights": w.tolist()}


def perceptron_predict(df: DataFrame, model: dict, x: Sequence[str], as_: str = "prediction") -> DataFrame:
    w = model["weights"]
    return df.withColumn(as_, (sum((double(c) * b for c, b in zip(x, w[1:], strict=True)), F.lit(w[0])) > 0).cast("int"))


def mlp_fit(x: np.ndarray, y: np.ndarray, hidden: int = 8, rate: float = 0.05, epochs: int = 200, batch: int = 16, seed: int = 0, task: str = "regress") -> dict:
    """One hidden tanh layer, mini-batch gradient descent; identity or logistic output."""
    rng = np.random.default_rng(seed)
    a, b, c, d = rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), 0.0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            i = order[at : at + batch]
            h = np.tanh(x[i] @ a + b)
            out = h @ c + d
            gap = ((1 / (1 + np.exp(-out)) if task == "classify" else out) - y[i]) / len(i)
            back = np.outer(gap, c) * (1 - h * h)
            a, b, c, d = a - rate * x[i].T @ back, b - rate * back.sum(0), c - rate * h.T @ gap, d - rate * gap.sum()
    return {"a": a, "b": b, "c": c, "d": float(d), "task": task}


def mlp_predict(df: DataFrame, model: dict, x: Sequence[str], as_: str = "prediction") -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(*columns: pd.Series) -> pd.Series:
        m = held.value
        out = np.tanh(np.column_stack(columns) @ m["a"] + m["b"]) @ m["c"] + m["d"]
        return pd.Series(1 / (1 + np.exp(-out)) if m["task"] == "classify" else out)

    return df.withColumn(as_, of(*(double(c) for c in x)))


# clustering ------------------------------------------------------------------------------------------


def kmeans(df: DataFrame, array: str, k: int, seed: int, key: str, max_iter: int = 100, tol: float = 1e-10, sample: int = SAMPLE) -> dict:
    """Lloyd's steps over all rows from k-means++ centres of a bounded sample; an empty cluster keeps its centre.
    Each step shuffles k * (d + 1) numbers a task and fetches as many."""
    first = df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(sample).select(array).toPandas()[array]
    x, rng = np.array(first.tolist(), float), np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < k:
        gap = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=gap / gap.sum())] if gap.sum() else x[rng.integers(len(x))])
    centres, rounds = np.array(centres), 0
    for rounds in range(1, max_iter + 1):  # noqa: B007
        held = df.sparkSession.sparkContext.broadcast(centres)

        def partial(batches, held=held):
            """Of each batch the rows and sums of every cluster, as (cluster, dim, v); dim -1 holds the rows."""
            for batch in batches:
                rows = np.array(batch.column(0).to_pylist(), float).reshape(batch.num_rows, -1)
                if not len(rows):
                    continue
                near = np.argmin((held.value**2).sum(1) - 2 * rows @ held.value.T, axis=1)
                one_hot = np.eye(len(held.value))[near]
                sums = np.column_stack([one_hot.sum(0), one_hot.T @ rows])
                c, dim = np.indices(sums.shape)
                yield pa.RecordBatch.from_arrays([pa.array(c.ravel()), pa.array(dim.ravel() - 1), pa.array(sums.ravel())], names=["cluster", "dim", "v"])

        sums = df.select(array).mapInArrow(partial, "cluster long, dim long, v double").groupBy("cluster", "dim").agg(F.sum("v").alias("v")).toPandas()
        table = sums.pivot(index="cluster", columns="dim", values="v").sort_index().to_numpy(float) if len(sums) else np.zeros((k, 1))
        new = np.where(table[:, :1] > 0, table[:, 1:] / np.maximum(table[:, :1], 1), centres) if len(sums) else centres
        held.unpersist()
        move = float(((new - centres) ** 2).sum())
        centres = new
        if move <= tol:
            break
    return {"centres": centres.tolist(), "iterations": rounds}


def kmeans_predict(df: DataFrame, model: dict, array: str) -> DataFrame:
    """Adds cluster and distance to the nearest centre, ties to the first."""
    best = F.array_min(F.array(*(F.struct(linalg.distance(F.col(array), F.array(*map(F.lit, c))).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(model["centres"]))))
    return df.withColumn("best__", best).withColumn("cluster", F.col("best__.k")).withColumn("distance", F.col("best__.d")).drop("best__")


def pca(df: DataFrame, array: str, n_components: int, whiten: bool = False) -> dict:
    """From the d x d covariance, summed in Spark; each component's largest entry is positive."""
    n = df.count()
    d = df.select(F.size(array)).first()[0]
    mean = np.array(df.agg(*(F.avg(F.element_at(array, i + 1).cast("double")) for i in range(d))).first(), float)
    g = linalg.to_numpy(linalg.gram_of_arrays(df, array))
    w, v = linalg.eig((g - n * np.outer(mean, mean)) / max(1, n - 1))
    w = np.maximum(w, 0)
    parts = v[:, :n_components] / (np.sqrt(w[:n_components]) if whiten else 1.0)
    return {"mean": mean.tolist(), "components": parts.T.tolist(), "explained": w[:n_components].tolist(), "ratio": (w[:n_components] / w.sum()).tolist() if w.sum() else [0.0] * n_components}


def pca_transform(df: DataFrame, model: dict, array: str, as_: str = "scores") -> DataFrame:
    centred = F.zip_with(F.col(array), F.array(*map(F.lit, model["mean"])), lambda x, m: x.cast("double") - m)
    dot = lambda c: F.aggregate(F.zip_with(centred, F.array(*map(F.lit, c)), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(as_, F.array(*(dot(c) for c in model["components"])))


def hierarchical(x: np.ndarray, k: int = 2, linkage: str = "single") -> list[int]:
    """Agglomeration of a bounded sample by single, complete or average linkage; clusters numbered by their first row."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    members, size = {i: [i] for i in range(len(x))}, np.ones(len(x))
    while len(members) > k:
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        row = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])}[linkage]
        row[~np.isfinite(d[i]) | ~np.isfinite(d[j])] = np.inf
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
        size[i] += size[j]
        members[i] += members.pop(j)
    out = [0] * len(x)
    for c, rows in enumerate(sorted(members.values(), key=min)):
        for r in rows:
            out[r] = c
    return out


#: Pairs of sites that `dbscan` compares one by one, at most, before it looks at smaller boxes.
DIRECT = 20_000_000

#: Cells, and places asked around in all their cells, that are broadcast, at most.
FEW_CELLS, FEW_ASKED = 100_000, 500_000

#: Links of cells that the driver joins to clusters, at most; more are joined in rounds.
FEW_LINKS = 300_000


def dbscan(df: DataFrame, key: str, x: str, y: str, eps: float, min_samples: int = 4) -> DataFrame:
    """(key, cluster, kind) in the plane: a row is core if its neighbourhood, itself included, has min_samples rows;
    cluster is the least key of connected core rows, the least such of a border row, -1 is noise.

    Pairs within eps aren't listed. Cells of a grid have a diagonal below eps, so the rows of one are all neighbours: a
    cell of min_samples rows is core throughout, and only rows of emptier cells, fewer than min_samples each, are held
    against the rows around them. Cells with core rows are what is linked, by boxes that shrink until they tell.
    Rows without a finite place are noise. Where rows share a key, their neighbourhoods add up and all are linked.
    """
    from .graph import components

    if not eps > 0:
        raise ValueError(f"eps is {eps}, not positive")
    p = df.select(F.col(key).alias("k"), double(x).alias("x"), double(y).alias("y"))
    finite = F.coalesce((F.abs("x") < math.inf) & (F.abs("y") < math.inf), F.lit(False))
    x0, x1, y0, y1 = (v or 0.0 for v in p.filter(finite).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())
    side = 0.7 * eps
    if not max(x1 - x0, y1 - y0) / side < 2**46:
        raise ValueError(f"places span more than 2**46 cells for eps {eps}, which doubles can't tell apart")
    vx, vy, at, site, rows_of = (F.col("x") - x0) / side, (F.col("y") - y0) / side, ["gx", "gy"], ["x", "y", "gx", "gy"], F.count(F.lit(1))
    rows = p.filter(finite).select("*", F.floor(vx).alias("gx"), F.floor(vy).alias("gy"), (vx - F.floor(vx)).alias("fx"), (vy - F.floor(vy)).alias("fy"), F.xxhash64("k", "x", "y").alias("h"))
    rows = checkpointed(rows)
    cells = checkpointed(rows.groupBy(*at).agg(rows_of.alias("n")))

    def of_cell(rows, values, counts=None):
        """rows with the values of their cells."""
        if cells.count() <= FEW_CELLS:
            return rows.join(F.broadcast(values), at)
        return salted_join(rows, values, at, rows.groupBy(*at).agg(rows_of.alias("n")) if counts is None else counts, "h")

    placed = of_cell(rows, cells.withColumnRenamed("n", "seen"), cells)
    lone = placed.filter(F.col("seen") < min_samples).drop("seen")
    seen = _within(lone.select(*site).distinct(), rows.select(*site, "h"), eps).groupBy("qx", "qy").agg(rows_of.alias("seen"))
    lone = lone.join(seen, (F.col("x") == F.col("qx")) & (F.col("y") == F.col("qy"))).select(*placed.columns)
    held = placed.filter(F.col("seen") >= min_samples).union(lone).filter(F.col("k").isNotNull())
    twice = checkpointed(rows.filter(F.col("k").isNotNull()).groupBy("k").agg(rows_of.alias("n")).filter("n > 1").select("k"))
    shared_keys = not twice.isEmpty()
    if shared_keys:
        held = held.withColumn("seen", F.sum("seen").over(Window.partitionBy("k")))
    held = checkpointed(held.withColumn("core", F.col("seen") >= min_samples).drop("seen"))
    core = held.filter("core").groupBy(*site, "fx", "fy").agg(F.min("k").alias("least"))
    core = checkpointed(core.withColumn("h", F.xxhash64("x", "y")))
    named = checkpointed(core.groupBy(*at).agg(F.min("least").alias("node")))
    edges = _touching(core, named, eps)
    if shared_keys:
        several = held.filter("core").join(twice, "k").select("k", *at).distinct()
        edges = edges.union(several.join(named, at).select("k", "node"))
    few = edges.limit(FEW_LINKS + 1).toArrow()
    label = _joined(few, edges) if few.num_rows <= FEW_LINKS else components(checkpointed(edges))
    label = checkpointed(named.join(label, "node", "left").select(*at, F.coalesce("component", "node").alias("cluster")))

    rest = held.filter(~F.col("core")).select("k", *site)
    near = _within(rest.select(*site).distinct(), of_cell(core, label), eps).groupBy("qx", "qy").agg(F.min("cluster").alias("cluster"))
    border = rest.join(near, (F.col("x") == F.col("qx")) & (F.col("y") == F.col("qy"))).select("k", "cluster", F.lit(False).alias("core"))
    found = of_cell(held.filter("core"), label).select("k", "cluster", "core").union(border)
    if shared_keys:
        found = found.groupBy("k").agg(F.min("cluster").alias("cluster"), F.max("core").alias("core"))
    kind = F.when(F.col("core"), "core").when(F.col("cluster").isNotNull(), "border").otherwise("noise")
    return p.join(found, "k", "left").select(F.col("k").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"), kind.alias("kind"))


def _joined(links: pa.Table, edges: DataFrame) -> DataFrame:
    """(node, component) as `graph.components` gives it, on the driver from the links, all rows (a, b) of edges."""
    up = {}

    def root(k):
        while (at := up.setdefault(k, k)) != k:
            up[k] = up[at]
            k = at
        return k

    for a, b in zip(*(c.to_pylist() for c in links.columns)):
        a, b = sorted((root(a), root(b)))
        up[b] = a
    kind = edges.schema["a"].dataType
    return edges.sparkSession.createDataFrame([(k, root(k)) for k in list(up)], T.StructType([T.StructField(c, kind) for c in ("node", "component")]))


def _within(asked: DataFrame, sites: DataFrame, eps: float) -> DataFrame:
    """The sites within eps of each asked place, as the sites' columns with qx, qy; few places may be asked from a cell, any number of sites may lie in one."""
    around = F.explode(F.array(*(F.struct((F.col("gx") + a).alias("gx"), (F.col("gy") + b).alias("gy")) for a in range(-2, 3) for b in range(-2, 3))))
    asked = checkpointed(asked.select(F.struct("x", "y").alias("q"), around.alias("g")).groupBy("g.gx", "g.gy").agg(F.collect_list("q").alias("asked")))
    if (asked.agg(F.sum(F.size("asked"))).first()[0] or 0) <= FEW_ASKED:
        met = sites.join(F.broadcast(asked), ["gx", "gy"])
    else:
        met = salted_join(sites, asked, ["gx", "gy"], sites.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n")), "h")
    met = met.select(*sites.columns, F.explode("asked").alias("q")).filter(F.hypot(F.col("x") - F.col("q.x"), F.col("y") - F.col("q.y")) <= eps)
    return met.select(*sites.columns, F.col("q.x").alias("qx"), F.col("q.y").alias("qy"))


def _boxes(sites: DataFrame, level: int) -> DataFrame:
    """Of each box, a 4 ** level-th of a cell's side wide: its sites' number, bounds and the outermost in eight directions."""
    site = F.struct("x", "y")
    out = [f(site, c) for c in (F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")) for f in (F.min_by, F.max_by)]
    box = sites.groupBy("gx", "gy", F.floor(F.col("fx") * 4**level).alias("bx"), F.floor(F.col("fy") * 4**level).alias("by"))
    return box.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.array_distinct(F.array(*out)).alias("out"))


def _touching(sites: DataFrame, named: DataFrame, eps: float) -> DataFrame:
    """(a, b): the nodes of cells that have sites within eps of each other. Pairs of boxes are linked by outermost sites or parted
    by their bounds; the others are compared site by site once that is DIRECT pairs in all, else cut to sixteenths."""
    at = ["gx", "gy", "bx", "by"]
    side = lambda d, s: d.select(*(F.col(c).alias(f"{s}{c}") for c in d.columns))
    boxes = _boxes(sites, 0).join(named.select("gx", "gy", "node"), ["gx", "gy"])
    beyond = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(3) for b in range(-2, 3) if (a, b) > (0, 0)))
    u = side(boxes, "u").withColumn("to", F.explode(beyond)).withColumns({"vgx": F.col("ugx") + F.col("to.a"), "vgy": F.col("ugy") + F.col("to.b")}).drop("to")
    pairs = u.join(side(boxes, "v"), ["vgx", "vgy"])
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"v{c}0") - F.col(f"u{c}1"), F.col(f"u{c}0") - F.col(f"v{c}1"))
    meet = F.exists("uout", lambda a: F.exists("vout", lambda b: F.hypot(a.x - b.x, a.y - b.y) <= eps))
    nodes, found, level = ["unode", "vnode"], None, 0
    while True:
        ids = [f"{s}{c}" for s in "uv" for c in at]
        pairs = checkpointed(pairs.filter(F.hypot(gap("x"), gap("y")) <= eps).select(*nodes, *ids, "un", "vn", meet.alias("meet")))
        hits = pairs.filter("meet").select(*nodes)
        found = hits if found is None else found.union(hits)
        rest = pairs.filter("not meet and (un > 2 or vn > 2)").join(hits.distinct(), nodes, "left_anti")
        todo = rest.agg(F.sum(F.col("un").cast("double") * F.col("vn"))).first()[0] or 0
        if todo <= DIRECT or level == 26:
            break
        level += 1
        boxes = checkpointed(_boxes(sites, level))
        inner = boxes.withColumns({"px": F.shiftright("bx", 2), "py": F.shiftright("by", 2)})
        for s in "uv":
            rest = rest.drop(f"{s}n").withColumnsRenamed({f"{s}bx": f"{s}px", f"{s}by": f"{s}py"}).join(side(inner, s), [f"{s}{c}" for c in ("gx", "gy", "px", "py")])
        pairs = rest
    if todo:
        inner = sites.select("gx", "gy", F.floor(F.col("fx") * 4**level).alias("bx"), F.floor(F.col("fy") * 4**level).alias("by"), "x", "y")
        for s in "uv":
            rest = rest.join(side(inner, s), [f"{s}{c}" for c in at])
        found = found.union(rest.filter(F.hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy")) <= eps).select(*nodes))
    return found.distinct().toDF("a", "b")


# metrics ---------------------------------------------------------------------------------------------


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """mse, rmse, mae, r2; r2 of a constant truth is 0."""
    gap = double(y) - double(p)
    mse, spread = F.avg(gap * gap), F.var_pop(double(y))
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(gap)).alias("mae"), F.when(spread == 0, 0.0).otherwise(1 - F.try_divide(mse, spread)).alias("r2"))


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("truth"), F.col(p).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """label, precision, recall, f1, support of each label, and accuracy; 0 where nothing is there."""
    pairs = confusion_matrix(df, y, p)
    cell = pairs.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"), F.lit(0).alias("called"), F.col("n").alias("support")), F.struct(F.col("prediction").alias("label"), F.lit(0).alias("hit"), F.col("n").alias("called"), F.lit(0).alias("support")))).alias("c")).select("c.*")
    by = cell.groupBy("label").agg(F.sum("hit").alias("hit"), F.sum("called").alias("called"), F.sum("support").alias("support"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    by = by.withColumn("precision", ratio("hit", "called")).withColumn("recall", ratio("hit", "support"))
    by = by.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    return by.withColumn("accuracy", F.sum("hit").over(Window.partitionBy()) / F.sum("support").over(Window.partitionBy())).drop("hit", "called")  # one row per label


def roc_auc(df: DataFrame, y: str, score: str, positive=1) -> DataFrame:
    """By rank sums; 0.5 with a single class."""
    ranked = average_ranks(df.select(y, score), score, "r__")
    yes = F.col(y) == positive
    n1, n0 = F.sum(yes.cast("double")), F.sum((~yes).cast("double"))
    return ranked.agg(F.coalesce(F.try_divide(F.sum(F.when(yes, F.col("r__")).otherwise(0.0)) - n1 * (n1 + 1) / 2, n1 * n0), F.lit(0.5)).alias("auc"))


def roc_curve(df: DataFrame, y: str, score: str, positive=1) -> DataFrame:
    """threshold, tpr, fpr of each distinct score, from the greatest."""
    yes = F.col(y) == positive
    per = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(yes.cast("long")).alias("p"), F.sum((~yes).cast("long")).alias("n"))
    total = per.agg(F.sum("p").alias("tp__"), F.sum("n").alias("tn__"))
    cum = with_running(per, [F.desc("threshold")], {"cp": ("sum", "p"), "cn": ("sum", "n")}).crossJoin(F.broadcast(total))  # one row
    return cum.select("threshold", F.try_divide(F.col("cp"), F.col("tp__")).alias("tpr"), F.try_divide(F.col("cn"), F.col("tn__")).alias("fpr"))


def cross_entropy(df: DataFrame, y: str, probabilities: str) -> DataFrame:
    """Mean log loss; probabilities are an array by class number."""
    p = F.greatest(F.element_at(probabilities, F.col(y).cast("int") + 1), F.lit(1e-15))
    return df.agg((-F.avg(F.ln(p))).alias("cross_entropy"))


def silhouette(df: DataFrame, key: str, array: str, cluster: str, most: int | None = SAMPLE) -> DataFrame:
    """(key, silhouette), euclidean; 0 for a singleton. Quadratic, so more than `most` rows are an error; without a bound,
    each row meets the rows of all clusters in blocks of arrays, and only sums by row and cluster are kept. A null cluster or cell meets none."""
    rows = df.select(F.col(key).alias("k"), F.col(array).alias("x"), F.col(cluster).alias("c")).filter("k is not null")
    if most is not None and rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    codes = rows.select("c").filter("c is not null").distinct().orderBy("c").collect()  # one row a cluster
    kinds, (matrix, distances) = {r["c"]: i for i, r in enumerate(codes)}, kernels()
    blocks = packed(rows, "k", "x", "c", BLOCK_ROWS)
    schema = df.select(F.col(key).alias("k"), F.col(cluster).alias("c"), F.lit(0).alias("to"), F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("n")).schema

    def sums(batches):
        held = None

        def done(_, ks, cs, total, count):
            to = np.tile(np.arange(-1, len(kinds)), len(ks))
            some = count.ravel() > 0
            each = np.repeat(np.arange(len(ks)), len(kinds) + 1)[some]
            yield pa.RecordBatch.from_arrays([pa.array([ks[i] for i in each], like[0]), pa.array([cs[i] for i in each], like[1]), pa.array(to[some], pa.int32()), pa.array(total.ravel()[some]), pa.array(count.ravel()[some], pa.int64())], names=["k", "c", "to", "d", "n"])

        for batch in batches:
            for (one, a), (two, b) in zip(zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True), zip(*(batch.column(i).to_pylist() for i in (2, 3)), strict=True), strict=True):
                if held is None or held[0] != one:
                    if held:
                        yield from done(*held)
                    ka, xa, ca = pickle.loads(a)
                    fine_a, xa = matrix(xa)
                    held = (one, ka, ca, np.zeros((len(ka), len(kinds) + 1)), np.zeros((len(ka), len(kinds) + 1), np.int64))
                kb, xb, cb = pickle.loads(b)
                fine_b, xb = matrix(xb)
                if one == two:
                    place = {k: i for i, k in enumerate(set(kb))}
                    code = np.array([place[k] for k in kb])
                    other = code[:, None] != code[None, :]
                else:
                    other = None
                held[4][:, 0] += len(kb) if other is None else other.sum(axis=1)
                of = np.array([kinds.get(c, -1) for c in cb])
                for dim in set(fine_a) & set(fine_b) - {-1}:
                    i, j = np.flatnonzero(fine_a == dim), np.flatnonzero((fine_b == dim) & (of >= 0))
                    if not len(i) or not len(j):
                        continue
                    d = distances(np.stack([xa[r] for r in i]), np.stack([xb[r] for r in j]))
                    member = np.zeros((len(j), len(kinds)))
                    member[np.arange(len(j)), of[j]] = 1
                    met = np.ones_like(d) if other is None else other[np.ix_(i, j)].astype(float)
                    d = np.where(met > 0, d, 0.0)
                    held[3][i, 1:] += d @ member
                    held[4][i, 1:] += np.rint(met @ member).astype(np.int64)
        if held:
            yield from done(*held)

    like = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema]).types
    pairs = blocks.select(F.col("block").alias("one"), F.col("data").alias("a")).crossJoin(blocks.select(F.col("block").alias("two"), F.col("data").alias("b")).coalesce(1))
    names = df.sparkSession.createDataFrame([(i, r["c"]) for r, i in zip(codes, range(len(codes)))], T.StructType([T.StructField("to", T.IntegerType()), T.StructField("c2", schema["c"].dataType)]))
    mean = pairs.mapInArrow(sums, schema).groupBy("k", "c", "to").agg((F.sum("d") / F.sum("n")).alias("d")).join(F.broadcast(names), "to", "left")
    per = mean.groupBy("k").agg(F.max(F.when(F.col("c") == F.col("c2"), F.col("d"))).alias("a"), F.min(F.when(F.col("c") != F.col("c2"), F.col("d"))).alias("b"))
    return per.select(F.col("k").alias(key), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


#: Rows of a block of packed vectors.
BLOCK_ROWS = 2_000


def packed(df: DataFrame, key: str, array: str, label: str, rows: int) -> DataFrame:
    """(block, data): rows dealt by a hash of the key, so equal keys share a block, each block's keys, vectors and labels as bytes."""
    blocks = max(1, -(-df.count() // rows))
    dealt = df.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.col(key).alias("k"), F.col(array).cast("array<double>").alias("x"), F.col(label).alias("c"))

    def pack(at, t):
        data = pickle.dumps((t.column("k").to_pylist(), t.column("x").to_pylist(), t.column("c").to_pylist()))
        return pa.table({"block": pa.array([at[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    return checkpointed(dealt.repartition(blocks, "block").groupBy("block").applyInArrow(pack, "block int, data binary"))


def kernels() -> tuple[Callable, Callable]:
    """matrix and distances, as functions that go to the workers by value."""

    def matrix(vectors: list) -> tuple[np.ndarray, list]:
        """The length of each vector, -1 where it or a cell of it is null, and the vectors."""
        return np.array([-1 if v is None or None in v else len(v) for v in vectors]), vectors

    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Euclidean, by products; where these cancel, as between copies, by differences."""
        aa, bb = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None, :]
        d = aa + bb - 2 * (a @ b.T)
        i, j = np.nonzero(~(d > 1e-6 * (aa + bb)))
        d = np.sqrt(np.maximum(d, 0))
        for s in range(0, len(i), 100_000):
            p, q = i[s : s + 100_000], j[s : s + 100_000]
            d[p, q] = np.sqrt(((a[p] - b[q]) ** 2).sum(axis=1))
        return d

    return matrix, distances


# validation and synthetic data -----------------------------------------------------------------------


def cross_validate(df: DataFrame, fit: Callable[[DataFrame], object], predict_: Callable[[DataFrame, object], DataFrame], y: str, key: Sequence[str], seed: int, k: int = 5, metric: str = "mse") -> DataFrame:
    """(fold, score) of fit and predict on each fold."""
    folds, rows = kfold(df, key, seed, k).cache(), []
    for f in range(k):
        out = predict_(folds.filter(F.col("fold") == f), fit(folds.filter(F.col("fold") != f)))
        score = F.avg((F.col(y) == F.col("prediction")).cast("double")) if metric == "accuracy" else F.avg(F.pow(double(y) - double("prediction"), 2))
        rows.append((f, out.agg(score).first()[0]))
    folds.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold long, score double")


def learning_curve(df: DataFrame, fit, predict_, y: str, key: Sequence[str], seed: int, fractions: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 1.0), test_size: float = 0.25) -> DataFrame:
    split = train_test_split(df, key, seed, test_size).cache()
    train, test, rows = split.filter("not is_test"), split.filter("is_test"), []
    n = train.count()
    for f in fractions:
        part = shuffled(train, key, seed + 1).filter(F.col("n__") <= max(2, round(n * f))).drop("n__")
        rows.append((float(f), predict_(test, fit(part)).agg(F.avg(F.pow(double(y) - double("prediction"), 2))).first()[0]))
    split.unpersist()
    return df.sparkSession.createDataFrame(rows, "fraction double, mse double")


def synthetic_regression(spark, seed: int, n: int = 100, d: int = 3, noise: float = 0.1) -> DataFrame:
    """id, x0 .. , y: a seeded linear law with noise."""
    w = np.random.default_rng(seed).normal(size=d).tolist()
    base = spark.range(n).select("id", *(F.randn(seed + 1 + i).alias(f"x{i}") for i in range(d)))
    return base.withColumn("y", sum((F.col(f"x{i}") * b for i, b in enumerate(w)), F.lit(0.0)) + noise * F.randn(seed + 99))


def synthetic_blobs(spark, seed: int, n: int = 120, d: int = 2, k: int = 3, spread: float = 0.6, separation: float = 6.0) -> DataFrame:
    """id, label, x0 .. : k seeded gaussian clouds."""
    centres = np.random.default_rng(seed).uniform(-separation, separation, (k, d)).tolist()
    label = F.pmod(F.col("id"), F.lit(k)).cast("int")
    at = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in centres)), label + 1)
    return spark.range(n).select("id", label.alias("label"), *((at(i) + spread * F.randn(seed + 1 + i)).alias(f"x{i}") for i in range(d)))


def synthetic_counts(spark, seed: int, n: int = 120, vocabulary: int = 8, k: int = 2, length: int = 20) -> DataFrame:
    """id, label, w0 .. : word counts; each class has its own seeded word shares."""
    share = np.random.default_rng(seed).dirichlet(np.ones(vocabulary), k)
    label = F.pmod(F.col("id"), F.lit(k)).cast("int")
    cum = F.element_at(F.array(*(F.array(*map(F.lit, np.cumsum(s).tolist())) for s in share)), label + 1)
    u = lambda t: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), t), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    words = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda t: F.size(F.filter(cum, lambda c: c < u(t))))
    base = spark.range(n).select("id", label.alias("label"), words.alias("w"))
    return base.select("id", "label", *(F.size(F.filter("w", lambda x, i=i: x == i)).alias(f"w{i}") for i in range(vocabulary)))
