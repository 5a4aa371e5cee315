"""Auto-analysis of one table: profile the columns, weigh the evidence, say what was found.

Three stages, as each depends on what the one before found: `plan` profiles the columns and decides by rules
what can be asked; `weigh` runs correlations, a test between groups and models; `summary` says it in sentences.
Every number comes from an aggregate in Spark; what reaches the driver is a few rows per column or group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..functions import statistics as st
from ..operators import aggregate as ag
from ..operators import ml, regression
from ..table import double, require

ALPHA, CORRELATION, MOST_LEVELS = 0.05, 0.3, 12


@dataclass
class Plan:
    numbers: list[str]
    texts: list[str]
    constants: list[str]
    group: str | None
    target: str | None
    task: str | None
    rows: int
    skipped: list[str] = field(default_factory=list)


def plan(df: DataFrame, target: str | None = None, task: str = "auto", most_levels: int = MOST_LEVELS) -> Plan:
    """Kinds, constants, the first column that can group, and the task that a target asks for."""
    if target:
        require(df, [target])
    rows = {r["column"]: r for r in ag.describe_table(df).collect()}
    n = max((r["n"] + r["missing"] for r in rows.values()), default=0)
    constants = [c for c, r in rows.items() if r["distinct"] <= 1]
    numbers = [c for c, r in rows.items() if r["kind"] == "number" and c not in constants]
    texts = [c for c, r in rows.items() if r["kind"] != "number" and c not in constants]
    levels = [c for c in texts if 2 <= rows[c]["distinct"] <= most_levels and c != target]
    skipped = [f"{c} has one value" for c in constants] + [f"{c} has too many values to group by" for c in texts if c not in levels and c != target]
    kind = None
    if target:
        few = rows[target]["distinct"] <= most_levels and (target in texts or rows[target]["distinct"] == 2)
        kind = ("classify" if few else "regress") if task == "auto" else task
        if kind == "regress" and target not in numbers:
            kind, _ = None, skipped.append(f"{target} isn't a number to predict")
    return Plan(numbers, texts, constants, levels[0] if levels else None, target, kind, n, skipped)


def values(df: DataFrame, column: str) -> DataFrame:
    return df.select(double(column).alias("value")).na.drop()


def group_levels(df: DataFrame, group: str) -> DataFrame:
    return df.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def group_values(df: DataFrame, group: str, level, column: str) -> DataFrame:
    return values(df.filter(F.col(group) == level), column)


def pairs(df: DataFrame, columns: Sequence[str], threshold: float = CORRELATION) -> DataFrame:
    """(a, b, r, p) of the pairs whose correlation reaches the threshold, strongest first."""
    m = st.correlation_matrix(df, columns).filter("a < b").withColumn("size", F.abs("r")).filter(F.col("size") >= threshold)
    n = df.na.drop(subset=list(columns)).count()
    t = F.abs("r") * F.sqrt(F.lit(max(n - 2, 0)) / F.greatest(F.lit(1e-300), 1 - F.col("r") * F.col("r")))
    return m.withColumn("p", F.least(F.lit(1.0), 2 * dist.column("sf", "t", t, {"df": float(max(n - 2, 1))}))).orderBy(F.desc("size"), "a", "b").drop("size")


def normality(df: DataFrame, group: str, column: str, alpha: float = ALPHA, sample: int = 500) -> dict:
    """Whether each level passes Shapiro's test on a bounded sample (levels of fewer than three values can't)."""
    ranked = ml.shuffled(df.filter(F.col(column).isNotNull() & F.col(group).isNotNull()).select(group, column), [column], 1, [group]).filter(F.col("n__") <= sample)
    found: dict = {}
    for r in ranked.select(group, double(column).alias("v")).collect():
        found.setdefault(r[0], []).append(r["v"])
    return {k: len(v) >= 3 and len(set(v)) > 1 and st.shapiro(v)["p"] > alpha for k, v in found.items()}


def choose_test(normal: dict, equal_variances: bool) -> str:
    """By the assumptions that hold: t, Welch, ANOVA, or by ranks."""
    two = len(normal) == 2
    if all(normal.values()):
        return ("t" if equal_variances else "welch") if two else ("anova" if equal_variances else "kruskal")
    return "mannwhitney" if two else "kruskal"


def compare_groups(df: DataFrame, group: str, column: str, alpha: float = ALPHA) -> dict:
    """The chosen test, its p-value and the size of the effect."""
    live = df.filter(F.col(group).isNotNull() & F.col(column).isNotNull())
    m = {k: v for k, v in st.moments(live, column, group).items() if v[0] >= 2}
    if len(m) < 2:
        return {"test": None, "why": "fewer than two levels have two values"}
    live = live.filter(F.col(group).isin(list(m)))
    equal = st.levene(live, column, group)["p"] > alpha
    name = choose_test(normality(live, group, column, alpha), equal)
    a, b = list(m.values())[:2]
    run = {
        "t": lambda: (st.ttest_ind(a, b)["p"], st.cohens_d(a, b)), "welch": lambda: (st.ttest_ind(a, b, False)["p"], st.hedges_g(a, b)), "anova": lambda: (st.f_oneway(m)["p"], st.eta_squared(m)),
        "mannwhitney": lambda: (st.mannwhitneyu(live, column, group)["p"], st.rank_biserial(live, column, group)), "kruskal": lambda: (st.kruskal(live, column, group)["p"], st.eta_squared(m)),
    }[name]
    p, effect = run()
    return {"test": name, "p": p, "effect": effect, "equal_variances": equal, "levels": {k: v[0] for k, v in m.items()}}


def model_table(df: DataFrame, features: Sequence[str], target: str, classes: Sequence | None = None) -> DataFrame:
    """Features and the target as y: a number, or the place of its class in `classes`."""
    y = double(target) if classes is None else F.coalesce(*(F.when(F.col(target) == c, F.lit(float(i))) for i, c in enumerate(classes)))
    return df.select(*(double(f).alias(f) for f in features), y.alias("y")).na.drop()


def models(df: DataFrame, p: Plan, key: Sequence[str], seed: int = 7) -> list[dict]:
    """Candidates by error cross-validated on all rows, best first: the mean alone, a linear model, a tree (regress); shares, logistic, a tree (classify)."""
    features = [c for c in p.numbers if c != p.target]
    if not p.task or not features:
        return []
    classes = sorted(r[0] for r in df.select(p.target).distinct().na.drop().collect()) if p.task == "classify" else None
    table = model_table(df, features, p.target, classes)
    metric = "accuracy" if classes else "mse"
    majority = lambda d: d.groupBy("y").count().orderBy(F.desc("count"), "y").first()[0]
    plain = (lambda d: majority(d)) if classes else (lambda d: d.agg(F.avg("y")).first()[0])
    candidates = {"baseline": (plain, lambda d, m: d.withColumn("prediction", F.lit(float(m))))}
    if classes:
        candidates["logistic"] = (lambda d: ml.logreg_fit(d, features, "y"), lambda d, m: ml.model_predict(m, d, features))
        candidates["tree"] = (lambda d: ml.forest_fit(d, features, "y", 1), lambda d, m: ml.model_predict(m, d, features))
    else:
        candidates["linear"] = (lambda d: regression.ridge(d, features, "y", 1e-6), regression.predict)
        candidates["tree"] = (lambda d: ml.tree_fit(d, features, "y"), lambda d, m: ml.model_predict(m, d, features))
    out = []
    for name, (fit, predict) in candidates.items():
        score = ml.cross_validate(table, fit, predict, "y", [*features, "y"], seed, 3, metric).agg(F.avg("score")).first()[0]
        out.append({"name": name, "score": score, "metric": metric})
    return sorted(out, key=lambda c: (-c["score"] if classes else c["score"], c["name"]))


def directions(df: DataFrame, columns: Sequence[str]) -> dict | None:
    """The first two components of the standardised columns over complete rows; None where fewer than two columns vary there."""
    live = df.select(*(double(c).alias(c) for c in columns)).na.drop()
    one = live.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    kept = [(c, one[f"m{i}"], one[f"s{i}"]) for i, c in enumerate(columns) if one[f"s{i}"]]
    if len(kept) < 2:
        return None
    model = ml.pca(live.select(F.array(*((F.col(c) - m) / s for c, m, s in kept)).alias("x")), "x", 2)
    return {"columns": [c for c, _, _ in kept], "ratio": model["ratio"], "components": model["components"]}


def clusters(df: DataFrame, columns: Sequence[str], most: int = 6, seed: int = 7) -> tuple[int, float] | None:
    """The number of clusters from 2 to `most` of the standardised columns whose silhouette is greatest, and that silhouette, over
    all complete rows; ties go to fewer clusters. Squared distances make it a sum over clusters, so no pairs are compared."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    live = df.select(*(double(c).alias(c) for c in columns)).na.drop()
    if not columns or live.distinct().limit(most).count() < most:
        return None
    wide = VectorAssembler(inputCols=list(columns), outputCol="raw__").transform(live)
    ready = StandardScaler(inputCol="raw__", outputCol="features").fit(wide).transform(wide).select("features").persist()
    try:
        found = [(ClusteringEvaluator().evaluate(KMeans(k=k, seed=seed).fit(ready).transform(ready)), k) for k in range(2, most + 1)]
    finally:
        ready.unpersist()
    score, k = max(found, key=lambda f: (round(f[0], 9), -f[1]))
    return k, score


def ran(report: DataFrame) -> DataFrame:
    """(kind, sentences, skipped) of what `study` returns: which parts of the analysis ran, in their order, and what each said."""
    return report.groupBy("kind").agg(F.min("position").alias("position"), F.count("*").alias("sentences")).select("position", "kind", "sentences", (F.col("kind") == "skipped").alias("skipped"))


def study(df: DataFrame, target: str | None = None, key: Sequence[str] = (), seed: int = 7) -> DataFrame:
    """(position, kind, sentence): the whole analysis in words."""
    p = plan(df, target)
    said = [("table", f"{p.rows} rows; {len(p.numbers)} numeric and {len(p.texts)} text columns vary.")]
    for r in ag.missing_report(df).filter("missing > 0").orderBy("column").collect():
        said.append(("missing", f"{r['column']} is missing in {r['missing']} rows."))
    if len(p.numbers) > 1:
        found = pairs(df, p.numbers).limit(10).collect()
        said += [("pair", f"{r['a']} and {r['b']} move {'together' if r['r'] > 0 else 'apart'} (r = {r['r']:.3f}, p = {r['p']:.3g}).") for r in found] or [("pair", "No two columns are strongly related.")]
    if p.group and p.numbers:
        column = next((c for c in p.numbers if c == target), p.numbers[0])
        t = compare_groups(df, p.group, column)
        if t["test"]:
            said.append(("groups", f"By {t['test']}, {column} {'differs' if t['p'] < ALPHA else 'does not clearly differ'} between the levels of {p.group} (p = {t['p']:.3g}, effect {t['effect']:.3f})."))
        else:
            said.append(("groups", f"{p.group} can't be compared: {t['why']}."))
    found = directions(df, p.numbers) if len(p.numbers) > 1 else None
    if found:
        said.append(("directions", f"The first {len(found['ratio'])} components hold {100 * sum(found['ratio']):.1f} % of the variance ({', '.join(f'{100 * x:.1f} %' for x in found['ratio'])})."))
        for k, part in enumerate(found["components"], 1):
            most = sorted(zip(found["columns"], part, strict=True), key=lambda c: -abs(c[1]))[:3]
            said.append(("directions", f"Component {k} is mostly {', '.join(f'{c} ({v:.2f})' for c, v in most)}."))
    best_k = clusters(df, p.numbers, seed=seed) if len(p.numbers) > 1 else None
    if best_k:
        said.append(("clusters", f"The numeric columns fall best into {best_k[0]} clusters (silhouette {best_k[1]:.3f})."))
    ranked = models(df, p, key, seed)
    if ranked:
        best = ranked[0]
        said.append(("model", f"Of {len(ranked)} models of {target}, {best['name']} is best ({best['metric']} {best['score']:.4g})."))
    said += [("skipped", s + ".") for s in p.skipped]
    return df.sparkSession.createDataFrame([(i, k, s) for i, (k, s) in enumerate(said)], "position long, kind string, sentence string")
