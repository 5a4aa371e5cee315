"""Linear algebra and machine learning on embeddings, labels and the star tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import linalg as la
from ..operators import ml
from .core import r
from .registry import query
from .statistics import one

_VEC = "(SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"


@query("pairwise", f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.e, b.e), 4) + 0.0 AS distance FROM {_VEC} a, {_VEC} b WHERE a.vec_id % 50 = 0")
def pairwise(t):
    q = t.embeddings.filter("vec_id % 50 = 0")
    return la.pairwise(q, t.embeddings, "vec_id", "embedding").withColumn("distance", r("distance"))


@query("pairwise_cityblock", f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum([abs(x - y) FOR x, y IN list_zip(a.e, b.e)]), 3) + 0.0 AS distance FROM {_VEC} a, {_VEC} b WHERE a.vec_id % 50 = 0".replace("[abs(x - y) FOR x, y IN list_zip(a.e, b.e)]", "list_transform(list_zip(a.e, b.e), lambda z: abs(z[1] - z[2]))"))
def pairwise_cityblock(t):
    return la.pairwise(t.embeddings.filter("vec_id % 50 = 0"), t.embeddings, "vec_id", "embedding", "cityblock").withColumn("distance", r("distance", 3))


@query("gram", f"WITH c AS (SELECT vec_id, unnest(range(0, len(e))) AS i, unnest(e) AS v FROM {_VEC}) SELECT a.i, b.i AS j, round(sum(a.v * b.v), 4) + 0.0 AS v FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2")
def gram(t):
    return la.gram_of_arrays(t.embeddings.select(F.col("embedding").alias("e")), "e").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r("v").alias("v"))


@query("matmul", "WITH a AS (SELECT s_suppkey % 10 AS i, s_nationkey AS j, sum(s_acctbal) AS v FROM supplier GROUP BY 1, 2), b AS (SELECT n_nationkey AS i, n_regionkey AS j, 1.0 * n_nationkey AS v FROM nation) SELECT a.i, b.j, round(sum(a.v * b.v), 2) + 0.0 AS v FROM a JOIN b ON a.j = b.i GROUP BY 1, 2")
def matmul(t):
    a = t.supplier.groupBy((F.col("s_suppkey") % 10).alias("i"), F.col("s_nationkey").alias("j")).agg(F.sum("s_acctbal").alias("v"))
    b = t.nation.select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("j"), F.col("n_nationkey").cast("double").alias("v"))
    return la.matmul(a, b).withColumn("v", r("v", 2))


@query("norms", "WITH a AS (SELECT n_regionkey AS i, n_nationkey AS j, n_nationkey - 7.0 AS v FROM nation) SELECT round(sqrt(sum(v * v)), 6)::DOUBLE + 0.0 AS fro, (SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM a GROUP BY j))::DOUBLE AS one, (SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM a GROUP BY i))::DOUBLE AS inf, coalesce((SELECT sum(v) FROM a WHERE i = j), 0)::DOUBLE AS trace FROM a")
def norms(t):
    m = t.nation.select(F.col("n_regionkey").alias("i"), F.col("n_nationkey").alias("j"), (F.col("n_nationkey") - 7.0).alias("v"))
    out = la.norm(m).select(r("norm", 6).alias("fro"))
    for name, kind in (("one", "1"), ("inf", "inf")):
        out = out.crossJoin(la.norm(m, kind).withColumnRenamed("norm", name))  # one row each
    return out.crossJoin(la.trace(m).select(F.coalesce("trace", F.lit(0.0)).alias("trace")))


@query("outer", "SELECT a.s_suppkey AS i, b.n_nationkey AS j, round(a.s_acctbal * b.n_nationkey, 2) + 0.0 AS v FROM supplier a, nation b")
def outer(t):
    a = t.supplier.select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    return la.outer(a, t.nation.select(F.col("n_nationkey").alias("i"), F.col("n_nationkey").cast("double").alias("v"))).withColumn("v", r("v", 2))


def _vector(t):
    return t.supplier.select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))


@query("vector_ops", "SELECT s_suppkey AS i, round(sum(s_acctbal) OVER (ORDER BY s_suppkey), 2) + 0.0 AS cumsum, round(CASE WHEN lag(s_acctbal) OVER w IS NULL THEN lead(s_acctbal) OVER w - s_acctbal WHEN lead(s_acctbal) OVER w IS NULL THEN s_acctbal - lag(s_acctbal) OVER w ELSE (lead(s_acctbal) OVER w - lag(s_acctbal) OVER w) / 2 END, 4) + 0.0 AS gradient FROM supplier WINDOW w AS (ORDER BY s_suppkey)")
def vector_ops(t):
    return la.gradient(la.cumsum(_vector(t))).select("i", r("cumsum", 2).alias("cumsum"), r("gradient").alias("gradient"))


@query("diff", "SELECT i, round(x, 2) + 0.0 AS diff FROM (SELECT s_suppkey AS i, s_acctbal - 2 * lag(s_acctbal) OVER w + lag(s_acctbal, 2) OVER w AS x FROM supplier WINDOW w AS (ORDER BY s_suppkey)) WHERE x IS NOT NULL")
def diff(t):
    return la.diff(_vector(t), times=2).select("i", r("diff", 2).alias("diff"))


@query("convolve", "WITH v AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_acctbal AS v FROM supplier), k AS (SELECT unnest(range(0, 3)) AS m, unnest([1.0, -2.0, 0.5]) AS w) SELECT i + m AS k, round(sum(v * w)::DOUBLE, 3) + 0.0 AS v FROM v, k GROUP BY 1")
def convolve(t):
    return la.convolve(_vector(t), [1.0, -2.0, 0.5]).select("k", r("v", 3).alias("v"))


@query("correlate", "WITH v AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_acctbal AS v FROM supplier) SELECT a.i AS k, round(a.v - 2 * b.v + 0.5 * c.v, 3) + 0.0 AS v FROM v a JOIN v b ON b.i = a.i + 1 JOIN v c ON c.i = a.i + 2")
def correlate(t):
    return la.correlate(_vector(t), [1.0, -2.0, 0.5]).select("k", r("v", 3).alias("v"))


@query("interp", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 0.0 WHEN p_size <= 20 THEN (p_size - 10) * 0.1 WHEN p_size <= 40 THEN 1 + (p_size - 20) * 0.2 ELSE 5.0 END::DOUBLE AS x FROM part".replace("(p_size - 10) * 0.1", "round((p_size - 10) * 0.1, 6)").replace("1 + (p_size - 20) * 0.2", "round(1 + (p_size - 20) * 0.2, 6)"))
def interp(t):
    return t.part.select("p_partkey", r(la.interp(F.col("p_size"), [10, 20, 40], [0.0, 1.0, 5.0]), 6).alias("x"))


@query("factorisations")
def factorisations(t):
    """Residuals of driver-side factorisations of the embeddings' gram: all near zero."""
    g = la.to_numpy(la.gram_of_arrays(t.embeddings.select(F.slice("embedding", 1, 8).alias("e")), "e"))
    w, v = la.eig(g)
    low, (q, rr) = la.cholesky(g), la.qr(g)
    re, im = la.fft(np.arange(8.0))
    return one(t, 6, eig=abs(v @ np.diag(w) @ v.T - g).max(), cholesky=abs(low @ low.T - g).max(), qr=abs(q @ rr - g).max(), inv=abs(la.inv(g) @ g - np.eye(8)).max(), pinv=abs(g @ la.pinv(g) @ g - g).max(), svd=abs(la.svd_values_of_gram(g) ** 2 - la.svd_values(g)).max(), rank=la.matrix_rank(g), solve=abs(g @ la.solve(g, np.ones(8)) - 1).max(), lstsq=abs(la.lstsq(g, np.ones(8)) - la.solve(g, np.ones(8))).max(), fft=re[0] + im[0] - 28)


@query("knn_predict", f"""
    WITH d AS (SELECT q.vec_id, b.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, b.e), b.vec_id) AS n FROM {_VEC} q, {_VEC} b WHERE q.vec_id % 25 = 0 AND b.vec_id % 25 <> 0),
    v AS (SELECT vec_id, label, count(*) AS c FROM d WHERE n <= 5 GROUP BY 1, 2) SELECT vec_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS k FROM v) WHERE k = 1""")
def knn_predict(t):
    e = t.embeddings
    return ml.knn_predict(e.filter("vec_id % 25 <> 0"), e.filter("vec_id % 25 = 0"), "vec_id", "embedding", "label")


@query("knn_regress", f"WITH d AS (SELECT q.vec_id, b.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, b.e), b.vec_id) AS n FROM {_VEC} q, {_VEC} b WHERE q.vec_id % 50 = 0 AND b.vec_id % 50 <> 0) SELECT vec_id, avg(label) AS prediction FROM d WHERE n <= 4 GROUP BY 1")
def knn_regress(t):
    e = t.embeddings
    return ml.knn_predict(e.filter("vec_id % 50 <> 0"), e.filter("vec_id % 50 = 0"), "vec_id", "embedding", "label", k=4, task="regress")


_NB = "SELECT l_returnflag AS c, count(*)::DOUBLE AS n, avg(l_quantity) AS m1, var_pop(l_quantity) AS v1, avg(l_tax) AS m2, var_pop(l_tax) AS v2 FROM lineitem GROUP BY 1"


@query("gaussian_nb", f"""
    WITH l AS (SELECT *, row_number() OVER () AS rid FROM lineitem), p AS ({_NB}), s AS (SELECT rid, c, ln(n / (SELECT count(*) FROM lineitem)) - 0.5 * (ln(2 * pi() * (v1 + x)) + ln(2 * pi() * (v2 + x))) - (l_quantity - m1) ^ 2 / (2 * (v1 + x)) - (l_tax - m2) ^ 2 / (2 * (v2 + x)) AS score FROM l, p, (SELECT 1e-9 * greatest(var_pop(l_quantity), var_pop(l_tax)) AS x FROM lineitem))
    SELECT c AS prediction, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, c) AS k FROM s) WHERE k = 1 GROUP BY 1""")
def gaussian_nb(t):
    model = ml.gaussian_nb_fit(t.lineitem, ["l_quantity", "l_tax"], "l_returnflag")
    return ml.gaussian_nb_predict(t.lineitem, model).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query("multinomial_nb", """
    WITH l AS (SELECT *, row_number() OVER () AS rid FROM lineitem), p AS (SELECT l_linestatus AS c, count(*)::DOUBLE AS n, sum(l_quantity) AS a, sum(l_linenumber) AS b FROM lineitem GROUP BY 1), s AS (SELECT rid, c, ln(n / (SELECT count(*) FROM lineitem)) + l_quantity * ln((a + 1) / (a + b + 2)) + l_linenumber * ln((b + 1) / (a + b + 2)) AS score FROM l, p)
    SELECT c AS prediction, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, c) AS k FROM s) WHERE k = 1 GROUP BY 1""")
def multinomial_nb(t):
    model = ml.multinomial_nb_fit(t.lineitem, ["l_quantity", "l_linenumber"], "l_linestatus")
    return ml.multinomial_nb_predict(t.lineitem, model).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


_M = "(SELECT quality AS y, toxic AS p FROM labels)"


@query("confusion_matrix", f"SELECT y AS truth, p AS prediction, count(*) AS n FROM {_M} GROUP BY 1, 2")
def confusion_matrix(t):
    return ml.confusion_matrix(t.labels, "quality", "toxic")


@query("classification_metrics", f"SELECT l AS label, count(*) FILTER (y = l) AS support, round(coalesce(count(*) FILTER (y = l AND p = l) / nullif(count(*) FILTER (p = l), 0), 0), 8) + 0.0 AS precision, round(coalesce(count(*) FILTER (y = l AND p = l) / nullif(count(*) FILTER (y = l), 0), 0), 8) + 0.0 AS recall, round(count(*) FILTER (y = p) / count(*), 8) + 0.0 AS accuracy FROM {_M}, (SELECT unnest([0, 1]) AS l) GROUP BY l")
def classification_metrics(t):
    return ml.classification_metrics(t.labels, "quality", "toxic").select("label", "support", *(r(c, 8).alias(c) for c in ("precision", "recall", "accuracy")))


_SCORE = "(SELECT quality AS y, n_chars % 97 AS s FROM labels JOIN documents USING (doc_id))"


def _scored(t):
    return t.labels.join(t.documents.select("doc_id", (F.col("n_chars") % 97).alias("s")), "doc_id")


@query("roc_auc", f"SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 8) + 0.0 AS auc FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM {_SCORE})")
def roc_auc(t):
    return ml.roc_auc(_scored(t), "quality", "s").select(r("auc", 8).alias("auc"))


@query("roc_curve", f"SELECT s AS threshold, round(sum(p) OVER w / sum(p) OVER (), 8) + 0.0 AS tpr, round(sum(n) OVER w / sum(n) OVER (), 8) + 0.0 AS fpr FROM (SELECT s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM {_SCORE} GROUP BY 1) WINDOW w AS (ORDER BY s DESC)")
def roc_curve(t):
    return ml.roc_curve(_scored(t), "quality", "s").select("threshold", r("tpr", 8).alias("tpr"), r("fpr", 8).alias("fpr"))


@query("regression_metrics", "SELECT round(avg((l_extendedprice - l_quantity * 1000) ^ 2), 2) + 0.0 AS mse, round(sqrt(avg((l_extendedprice - l_quantity * 1000) ^ 2)), 4) + 0.0 AS rmse, round(avg(abs(l_extendedprice - l_quantity * 1000)), 4) + 0.0 AS mae, round(1 - avg((l_extendedprice - l_quantity * 1000) ^ 2) / var_pop(l_extendedprice), 8) + 0.0 AS r2 FROM lineitem")
def regression_metrics(t):
    out = ml.regression_metrics(t.lineitem.withColumn("p", F.col("l_quantity") * 1000), "l_extendedprice", "p")
    return out.select(r("mse", 2).alias("mse"), r("rmse").alias("rmse"), r("mae").alias("mae"), r("r2", 8).alias("r2"))


@query("cross_entropy", "SELECT round(-avg(ln(CASE WHEN quality = 1 THEN 0.8 ELSE 0.2 END)), 8) + 0.0 AS cross_entropy FROM labels")
def cross_entropy(t):
    return ml.cross_entropy(t.labels.withColumn("p", F.array(F.lit(0.2), F.lit(0.8))), "quality", "p").select(r("cross_entropy", 8).alias("cross_entropy"))


@query("kmeans_assign", f"WITH c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, e FROM {_VEC} WHERE vec_id < 4) SELECT vec_id, k::INT AS cluster FROM (SELECT v.vec_id, c.k, row_number() OVER (PARTITION BY v.vec_id ORDER BY list_distance(v.e, c.e), c.k) AS n FROM {_VEC} v, c) WHERE n = 1")
def kmeans_assign(t):
    centres = [list(map(float, x[0])) for x in t.embeddings.filter("vec_id < 4").orderBy("vec_id").select("embedding").collect()]
    return ml.kmeans_predict(t.embeddings, {"centres": centres}, "embedding").select("vec_id", "cluster")


@query("kmeans")
def kmeans(t):
    model = ml.kmeans(t.embeddings, "embedding", 4, seed=3, key="vec_id", max_iter=10)
    return ml.kmeans_predict(t.embeddings, model, "embedding").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), r(F.avg("distance"), 6).alias("spread"))


@query("pca")
def pca(t):
    model = ml.pca(t.embeddings, "embedding", 2)
    return ml.pca_transform(t.embeddings, model, "embedding").select("vec_id", r(F.col("scores")[0], 6).alias("p1"), r(F.col("scores")[1], 6).alias("p2"))


@query("silhouette", f"""
    WITH s AS (SELECT * FROM {_VEC}), d AS (SELECT a.vec_id, a.label AS c, b.label AS c2, avg(list_distance(a.e, b.e)) AS d FROM s a JOIN s b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3), m AS (SELECT vec_id, max(d) FILTER (c = c2) AS a, min(d) FILTER (c <> c2) AS b FROM d GROUP BY 1)
    SELECT vec_id, round(coalesce((b - a) / greatest(a, b), 0), 5) + 0.0 AS silhouette FROM m""")
def silhouette(t):
    return ml.silhouette(t.embeddings, "vec_id", "embedding", "label", most=None).withColumn("silhouette", r("silhouette", 5))


@query("dbscan", """
    WITH RECURSIVE p AS (SELECT c_custkey AS k, c_acctbal / 100 AS x, (c_custkey % 100)::DOUBLE AS y FROM customer), near AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) <= 3),
    core AS (SELECT a FROM near GROUP BY 1 HAVING count(*) >= 6), walk AS (SELECT a AS k, a AS root FROM core UNION SELECT n.b, w.root FROM walk w JOIN near n ON n.a = w.k JOIN core c ON c.a = n.b),
    label AS (SELECT k, min(root) AS cluster FROM walk GROUP BY 1), edge AS (SELECT n.b AS k, min(l.cluster) AS cluster FROM near n JOIN label l ON l.k = n.a GROUP BY 1)
    SELECT p.k AS c_custkey, coalesce(e.cluster, -1) AS cluster, CASE WHEN c.a IS NOT NULL THEN 'core' WHEN e.cluster IS NOT NULL THEN 'border' ELSE 'noise' END AS kind FROM p LEFT JOIN edge e ON e.k = p.k LEFT JOIN core c ON c.a = p.k""")
def dbscan(t):
    p = t.customer.select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"))
    return ml.dbscan(p, "c_custkey", "x", "y", 3.0, 6)


@query("hierarchical")
def hierarchical(t):
    x, _ = ml.local_sample(t.supplier, ["s_acctbal", "s_nationkey"], None, ["s_suppkey"])
    return t.spark.createDataFrame([(i, c) for i, c in enumerate(ml.hierarchical(x, 3, "average"))], "row long, cluster long")


@query("split_counts", "SELECT round(count(*) * 0.25)::BIGINT AS n_test, count(*) - round(count(*) * 0.25)::BIGINT AS n_train FROM customer")
def split_counts(t):
    s = ml.train_test_split(t.customer, ["c_custkey"], 11)
    return s.agg(F.sum(F.col("is_test").cast("long")).alias("n_test"), F.sum((~F.col("is_test")).cast("long")).alias("n_train"))


@query("kfold_counts", "SELECT f AS fold, (SELECT count(*) FROM customer) // 5 + CASE WHEN f < (SELECT count(*) FROM customer) % 5 THEN 1 ELSE 0 END AS n FROM (SELECT unnest(range(0, 5)) AS f)")
def kfold_counts(t):
    return ml.kfold(t.customer, ["c_custkey"], 3).groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("subset", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT n_nationkey FROM nation)")
def subset(t):
    return ml.subset(t.customer.withColumn("at", F.col("c_custkey")), t.nation.select(F.col("n_nationkey").cast("long").alias("at")), "at").select("c_custkey", "c_name")


@query("lasso_zero", "SELECT 'intercept' AS name, round(avg(l_extendedprice), 4) + 0.0 AS coefficient FROM lineitem UNION ALL SELECT 'l_tax', 0.0")
def lasso_zero(t):
    f = ml.lasso_fit(t.lineitem, ["l_tax"], "l_extendedprice", alpha=1e9)
    return t.spark.createDataFrame(list(zip(f["names"], f["coefficients"], strict=True)), "name string, coefficient double").withColumn("coefficient", r("coefficient"))


@query("lasso_one", """
    WITH s AS (SELECT regr_sxy(l_extendedprice, l_quantity) AS xy, regr_sxx(l_extendedprice, l_quantity) AS xx, avg(l_extendedprice) AS y, avg(l_quantity) AS x, count(*) AS n FROM lineitem), a AS (SELECT unnest([1.0, 1000.0, 1e9])::DOUBLE AS alpha),
    b AS (SELECT alpha, sign(xy) * greatest(abs(xy) - alpha * n, 0) / xx AS b, x, y FROM s, a)
    SELECT alpha, 'intercept' AS name, round(y - b * x, 2) + 0.0 AS coefficient FROM b UNION ALL SELECT alpha, 'l_quantity', round(b, 2) + 0.0 FROM b""")
def lasso_one(t):
    return ml.lasso_path(t.lineitem, ["l_quantity"], "l_extendedprice", (1.0, 1000.0, 1e9)).withColumn("coefficient", r("coefficient", 2))


@query("lasso_path")
def lasso_path(t):
    return ml.lasso_path(t.lineitem, ["l_quantity", "l_tax"], "l_extendedprice", (1.0, 100.0, 10000.0)).withColumn("coefficient", r("coefficient"))


def _flags(t):
    return t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("double"))


@query("tree_ensembles")
def tree_ensembles(t):
    """Mean predictions of a tree, a forest and boosted trees, and the forest's out-of-bag accuracy."""
    df, x, key = _flags(t), ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber"]
    mean = lambda m: ml.model_predict(m, df, x).agg(F.avg("prediction")).first()[0]
    oob = ml.forest_oob(df, x, "y", key, 3, 4).first()
    return one(t, 6, tree=mean(ml.tree_fit(df, x, "y")), forest=mean(ml.forest_fit(df, x, "y", 5)), boosted=mean(ml.gbm_fit(df, x, "y", 5)), logistic_boosted=mean(ml.gbm_fit(df, x, "y", 3, task="classify")), oob=oob["accuracy"])


@query("linear_classifiers")
def linear_classifiers(t):
    df, x = _flags(t), ["l_quantity", "l_discount"]
    proba = ml.model_predict(ml.softmax_fit(df, x, "y"), df, x, proba="p").agg(F.avg(F.col("p")[1])).first()[0]
    hard = ml.model_predict(ml.logreg_fit(df, x, "y"), df, x).agg(F.avg("prediction")).first()[0]
    xs, ys = ml.local_sample(df, x, "y", ["l_orderkey", "l_linenumber"])
    perceptron = ml.perceptron_predict(df, ml.perceptron_fit(xs, ys, epochs=5), x).agg(F.avg("prediction")).first()[0]
    mlp = ml.mlp_predict(df, ml.mlp_fit(xs / [50, 0.1], ys, epochs=10), x).agg(F.avg("prediction")).first()[0]
    return one(t, 6, softmax=proba, logreg=hard, perceptron=perceptron, mlp=mlp)


@query("cross_validate")
def cross_validate(t):
    fit = lambda d: ml.linreg_fit(d, ["l_quantity"], "l_extendedprice")
    return ml.cross_validate(t.lineitem, fit, ml.linreg_predict, "l_extendedprice", ["l_orderkey", "l_linenumber"], 1, 3).withColumn("score", r("score", 2))


@query("learning_curve")
def learning_curve(t):
    fit = lambda d: ml.linreg_fit(d, ["l_quantity"], "l_extendedprice")
    return ml.learning_curve(t.lineitem, fit, ml.linreg_predict, "l_extendedprice", ["l_orderkey", "l_linenumber"], 1, (0.1, 1.0)).withColumn("mse", r("mse", 2))


@query("synthetic_tables")
def synthetic_tables(t):
    a = ml.synthetic_regression(t.spark, 1).agg(F.count("y").alias("n")).withColumn("kind", F.lit("regression"))
    b = ml.synthetic_blobs(t.spark, 1).agg(F.count("x0").alias("n")).withColumn("kind", F.lit("blobs"))
    return a.union(b).union(ml.synthetic_counts(t.spark, 1).agg(F.sum("w0").alias("n")).withColumn("kind", F.lit("counts")))
