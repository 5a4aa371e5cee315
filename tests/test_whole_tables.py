"""Queries held against plain recomputation over whole tables."""

import math
import random
import threading
from collections import defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F

from sparkloom.queries import QUERIES

SF_100 = "/root/testdata/sf0.01"  # has 100 suppliers
SF_2000 = "/root/testdata/sf0.1"  # has 2,000 vectors


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def test_ewma_of_all_users(spark):
    by, want, plain = defaultdict(list), {}, {}
    for e in table(spark, "events"):
        by[e.user_id].append((e.ts, e.event_id, e.value))
    for events in by.values():
        num = den = 0.0
        mean = None
        for _, k, v in sorted(events):
            num, den = v + 0.7 * num, 1 + 0.7 * den
            mean = v if mean is None else 0.2 * v + 0.8 * mean
            want[k], plain[k] = num / den, mean
    assert {r.event_id: r.x for r in QUERIES["ewma"](spark, SF).collect()} == pytest.approx(want, abs=1e-4)
    assert {r.event_id: r.x for r in QUERIES["ewma_plain"](spark, SF).collect()} == pytest.approx(plain, abs=1e-4)


def test_standings_of_all_customers(spark):
    score = defaultdict(dict)
    for o in table(spark, "orders"):
        of = score[o.o_orderdate.year]
        of[o.o_custkey] = max(of.get(o.o_custkey, -1), math.floor(o.o_totalprice / 40000))
    got = {(r.state, r.entry): (r.place, r.tied) for r in QUERIES["standings"](spark, SF).collect()}
    assert got == {(y, c): (1 + sum(x > v for x in of.values()), list(of.values()).count(v) > 1) for y, of in score.items() for c, v in of.items()}
    assert {r.state: r.tied for r in QUERIES["ties"](spark, SF).collect()} == {y: len(of) - len(set(of.values())) for y, of in score.items()}
    assert {r.state: (r.entered, r.of) for r in QUERIES["entered"](spark, SF).collect()} == {y: (sum(v != 3 for v in of.values()), len(of)) for y, of in score.items()}


def test_shelf_of_all_lines(spark):
    part = {p.p_partkey: p.p_brand for p in table(spark, "part")}
    want = {f"{x.l_orderkey}-{x.l_linenumber}" for x in table(spark, "lineitem") if "brand" in part[x.l_partkey].lower()}
    assert {r.disc_id for r in QUERIES["shelf"](spark, SF).collect()} == want


def test_holes_of_all_suppliers(spark):
    k = [s.s_suppkey for s in table(spark, "supplier", SF_100)]
    tee, basket = {i: (i * 37 % 100, i * 53 % 80) for i in k}, {i: (i * 11 % 100, i * 29 % 80) for i in k}
    assert {r.number: r.length for r in QUERIES["hole_geometry"](spark, SF_100).collect()} == pytest.approx({i: math.dist(tee[i], basket[i]) for i in k}, abs=1e-3)
    legs = {(i, "play"): math.dist(tee[i], basket[i]) for i in k} | {(i, "walk"): math.dist(basket[i], tee[j]) for i, j in zip(sorted(k), sorted(k)[1:])}
    assert {(r.number, r.kind): r.length for r in QUERIES["route"](spark, SF_100).collect()} == pytest.approx(legs, abs=1e-3)
    free, bound = {f"a{i}": basket[i] for i in k}, {}
    for i in sorted(k):
        bound[i] = min((math.dist(p, tee[i]), a) for a, p in free.items())[1]
        del free[bound[i]]
    assert {r.number: r.anchor for r in QUERIES["bind_nearest"](spark, SF_100).collect()} == bound
    hits = {}
    for i in k:
        found = [(at, j) for at in range(61) for j in k if abs(tee[i][0] + at - basket[j][0]) <= 4 and abs(tee[i][1] + 0.5 * at - basket[j][1]) <= 4]
        if found:
            hits[i] = min(found)
    assert {r.ray: (r.at, r.box) for r in QUERIES["cast_rays"](spark, SF_100).collect()} == hits


def test_round_legs_of_all_nations(spark):
    out = {r.leg: r.cost for r in QUERIES["round_legs"](spark, SF).collect()}
    assert set(out) == {n.n_nationkey for n in table(spark, "nation")}
    assert {k for k, cost in out.items() if cost is None} == {10}  # starts in the wall


def test_vectors_of_the_whole_table(spark):
    import numpy as np

    rows = table(spark, "embeddings", SF_2000)
    at = {e.vec_id: np.array(e.embedding, float) for e in rows}
    some = [k for k in at if k % 50 == 0]
    assert max(some) >= 500  # beyond the prefix
    for name, norm, digits in (("pairwise", 2, 1e-4), ("pairwise_cityblock", 1, 1e-3)):
        got = {(r.a, r.b): r.distance for r in QUERIES[name](spark, SF_2000).collect()}
        assert set(got) == {(a, b) for a in some for b in at}
        assert all(abs(got[a, b] - np.linalg.norm(at[a] - at[b], norm)) <= digits for a in some[:3] + some[-3:] for b in at)


def test_silhouette_of_the_whole_table(spark):
    import numpy as np

    rows = table(spark, "embeddings")
    x, c = np.array([e.embedding for e in rows], float), np.array([e.label for e in rows])
    got = {r.vec_id: r.silhouette for r in QUERIES["silhouette"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i in range(0, len(rows), 25):
        d = np.linalg.norm(x - x[i], axis=1)
        mean = {k: d[(c == k) & (np.arange(len(c)) != i)].mean() for k in set(c) if ((c == k) & (np.arange(len(c)) != i)).any()}
        a, b = mean.pop(c[i], None), min(mean.values(), default=None)
        assert got[rows[i].vec_id] == pytest.approx(0 if a is None or b is None else (b - a) / max(a, b), abs=1e-5)


def test_silhouette_without_a_bound(spark):
    from sparkloom.operators import ml

    df = spark.range(2500).selectExpr("id", "array(double(id % 2 * 100), double(id % 7)) as x", "id % 2 as c")
    out = ml.silhouette(df, "id", "x", "c", most=None)
    assert out.count() == 2500 and out.filter("silhouette < 0.9").count() == 0


def test_joins_of_the_whole_table(spark):
    a = [(None if c.c_nationkey == 3 else c.c_nationkey, c.c_custkey) for c in table(spark, "customer")]
    b = [(None if s.s_nationkey == 4 else s.s_nationkey, s.s_suppkey) for s in table(spark, "supplier")] + [(None, -1)]
    both = [(k, v, w) for k, v in a for m, w in b if k == m]
    left, right = [(k, v, None) for k, v in a if k not in {m for m, _ in b}], [(m, None, w) for m, w in b if m not in {k for k, _ in a}]
    for how, want in (("inner", both), ("left", both + left), ("right", both + right), ("outer", both + left + right)):
        assert sorted(map(repr, (tuple(r) for r in QUERIES[f"join_{how}"](spark, SF).select("k", "v_left", "v_right").collect()))) == sorted(map(repr, want))


def test_samples_reach_their_operators_bounds(spark):
    assert QUERIES["hierarchical"](spark, SF_100).count() == 100


def test_ties_of_standings_cost_no_more_than_the_points(spark):
    from sparkloom.operators import applications as app

    scores = spark.range(200_000).selectExpr("1 as state", "id as entry", "if(id < 3, 9, 5) as score")  # 199,997 ties took 2e10 steps
    out = app.standings(scores, [10, 6, 3, 1], "high").groupBy("place", "tied", "points").count()
    assert sorted(map(tuple, out.collect())) == [(1, True, 6.33, 3), (4, True, 0.0, 199_997)]
    few = spark.createDataFrame([(1, k, v) for k, v in enumerate([9, 8, 8, 8, 7, 7])], "state int, entry int, score int")
    assert [r.points for r in app.standings(few, [10, 6, 3, 1], "high").orderBy("entry").collect()] == [10.0, 3.33, 3.33, 3.33, 0.0, 0.0]


def test_rays_and_boxes_by_equal_kinds(spark, monkeypatch):
    from sparkloom.operators import raster
    from sparkloom.operators import relational as rel

    rays = spark.range(6000).selectExpr("id as ray", "double(id % 7) as x", "double(id % 5) as y", "1.0d as dx", "0.5d as dy")
    boxes = spark.range(6000).selectExpr("id as box", "double(id % 11 * 9) as x0", "double(id % 3 * 20) as y0", "double(id % 11 * 9 + 4) as x1", "if(id = 5999, double('inf'), double(id % 3 * 20 + 4)) as y1")
    out = raster.cast_rays(rays, boxes, 1.0, 60)
    assert "CartesianProduct" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "BroadcastNestedLoop" not in plan
    kinds = {tuple(r)[1:]: r.box for r in boxes.orderBy("box", ascending=False).collect()}
    one = lambda x, y: min(((at, b) for at in range(61) for (x0, y0, x1, y1), b in kinds.items() if x0 <= x + at <= x1 and y0 <= y + at / 2 <= y1), default=None)
    want = {(x, y): one(x, y) for x in range(7) for y in range(5)}
    assert {r.ray: (r.at, r.box) for r in out.collect()} == {k: want[k % 7, k % 5] for k in range(6000) if want[k % 7, k % 5]}

    monkeypatch.setattr(rel, "LIST_ROWS", 3)
    box = lambda n, w: spark.range(n).selectExpr("if(id = 1, null, id) as id", "if(id = 4, null, 'm') as frame", "id % 6 as x0", "id % 4 as y0", f"id % 6 + {w} as x1", f"id % 4 + {w} as y1")
    a, c = box(90, 4), box(70, 1)
    want = [(p.id, q.id) for p in a.collect() for q in c.collect() if p.frame and q.frame and p.x0 <= q.x0 and p.y0 <= q.y0 and p.x1 >= q.x1 and p.y1 >= q.y1]
    met = rel.containment_join(a, c, 2)
    assert sorted(map(tuple, met.collect()), key=repr) == sorted(want, key=repr)
    assert "collect_list" in met._jdf.queryExecution().executedPlan().toString()  # pairs of kinds, not of rows, are tested


@pytest.mark.parametrize("how", ["right", "outer"])
def test_joins_that_keep_the_right_side_build_no_key_in_one_task(spark, how):
    out = QUERIES[f"join_{how}"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in out and "RightOuter" not in out and "BroadcastHashJoin" in out


def test_silhouette_in_blocks_is_the_plain_one(spark, monkeypatch):
    import numpy as np

    from sparkloom.operators import ml

    monkeypatch.setattr(ml, "BLOCK_ROWS", 20)
    data = [(i, [1e4 + i % 9, float(i % 4)] if i % 11 else None, None if i % 13 == 0 else i % 3) for i in range(70)] + [(70, [1e4, None], 1), (71, [1e4, 0.0], 7)]
    got = {r.k: r.silhouette for r in ml.silhouette(spark.createDataFrame(data, "k long, x array<double>, c int"), "k", "x", "c", most=None).collect()}
    want = {}
    for k, x, c in data:
        by = {}
        for k2, x2, c2 in data:
            if k2 != k and c2 is not None and x and x2 and None not in x and None not in x2:
                by.setdefault(c2, []).append(np.linalg.norm(np.subtract(x, x2)))
        a, b = (np.mean(by[c]) if c in by else None), min((np.mean(v) for c2, v in by.items() if c2 != c), default=None)
        want[k] = 0 if c is None or a is None or b is None else (b - a) / max(a, b)
    assert got == pytest.approx(want, abs=1e-9)
    same = spark.range(50).selectExpr("id", "array(0.1d, 0.7d, 123.4d) as x", "id % 2 as c")
    assert {r.silhouette for r in ml.silhouette(same, "id", "x", "c", most=None).collect()} == {0.0}
    plan = ml.silhouette(same, "id", "x", "c", most=None)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


@pytest.mark.parametrize("metric", ["euclidean", "cityblock"])
def test_neighbours_in_blocks_are_the_plain_ones(spark, monkeypatch, metric):
    import numpy as np

    from sparkloom.operators import ml

    monkeypatch.setattr(ml, "BLOCK_ROWS", 15)
    data = [(i, [1e3 + i % 7, float(i % 4), 0.1 * (i % 5)], i % 6) for i in range(100)]  # many equal distances
    df = spark.createDataFrame(data, "k long, x array<double>, y int")
    got = {r.k: r.prediction for r in ml.knn_predict(df.filter("k % 4 <> 0"), df.filter("k % 4 = 0"), "k", "x", "y", 3, metric, task="regress").collect()}
    want = {}
    for k, x, _ in data[::4]:
        far = lambda v: math.sqrt(sum((a - b) ** 2 for a, b in zip(x, v))) if metric == "euclidean" else sum(abs(a - b) for a, b in zip(x, v))  # noqa: B023, E731
        want[k] = np.mean([y for _, _, y in sorted((far(v), t, y) for t, v, y in data if t % 4)[:3]])
    assert got == pytest.approx(want)


def test_more_than_a_hundred_thousand_queries(spark):
    from sparkloom.operators import ml

    train = spark.range(5).selectExpr("id", "array(double(id)) as x", "id * 10 as y")
    asked = spark.range(100_500).selectExpr("id + 10 as id", "array(double(id % 5)) as x")
    out = ml.knn_predict(train, asked, "id", "x", "y", 1).groupBy("prediction").count()
    assert sorted(map(tuple, out.collect())) == [(10 * i, 20_100) for i in range(5)]


def plain_dbscan(rows, eps, least):
    near = [(a, b) for a, x, y in rows for b, u, v in rows if None not in (x, y, u, v) and math.hypot(x - u, y - v) <= eps]
    count, up = defaultdict(int), {}
    for a, _ in near:
        count[a] += 1
    core = {k for k, n in count.items() if k is not None and n >= least}
    label = {k: k for k in core}
    links = [(a, b) for a, b in near if a in core and b in core]
    while label != up:
        up = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    for a, b in near:
        if a in core and b is not None and b not in core:
            label[b] = min(label.get(b, label[a]), label[a])
    return sorted(((k, label.get(k, -1), "core" if k in core else "border" if k in label else "noise") for k, _, _ in rows), key=repr)


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("case", ["scattered", "lattice", "strips", "odd", "none"])
def test_dbscan_against_all_pairs(spark, monkeypatch, case, large):
    from sparkloom.operators import ml

    for bound in ("DIRECT", "FEW_LINKS", "FEW_CELLS", "FEW_ASKED") if large else ():
        monkeypatch.setattr(ml, bound, 0)
    rng, eps, least = random.Random(7), 3.0, 4
    if case == "scattered":  # from empty to crowded
        rows = [(k, rng.gauss(0, 1) * 2 ** rng.uniform(0, 6), rng.gauss(0, 1) * 2 ** rng.uniform(0, 6)) for k in range(350)]
    elif case == "lattice":  # neighbours at eps itself, some of them by a rounded difference
        rows = [(k, rng.randrange(-20, 20) * 1.5 + rng.choice([0, 0.1]), rng.randrange(-10, 10) * 1.5) for k in range(250)]
    elif case == "strips":  # crowded strips at eps, just within and just beyond it
        at = [0.0, 3.0, 6.0000001, 9.0, 12.0000000001, 14.9999999, 17.0]
        rows = [(k, x, rng.uniform(0, 6)) for k, x in enumerate(x for x in at for _ in range(45))]
        rng.shuffle(rows)
    elif case == "odd":  # shared and missing keys, missing and endless places, copies
        rows = [(rng.choice([None, *range(90)]), rng.choice([None, math.inf, -math.inf, math.nan, 0.0, -0.0, *(rng.uniform(-9, 30) for _ in range(30))]), rng.choice([None, math.nan, *(rng.uniform(-9, 30) for _ in range(20))])) for _ in range(150)]
        rows += rows[:20]
        least = 6
    else:
        rows = []
    finite = [(k, *((None, None) if None in (x, y) or not math.isfinite(x + y) else (x, y))) for k, x, y in rows]
    got = ml.dbscan(spark.createDataFrame(rows, "k long, x double, y double"), "k", "x", "y", eps, least).collect()
    assert sorted(map(tuple, got), key=repr) == plain_dbscan(finite, eps, least)


def test_dbscan_lists_no_pairs(spark):
    from sparkloom.operators import ml

    df = spark.range(120_000).select("id", (F.col("id") % 2 * 10 + F.rand(3)).alias("x"), F.rand(5).alias("y"))  # 7e9 pairs within eps
    late = threading.Timer(150, spark.sparkContext.cancelAllJobs)
    late.start()
    got = ml.dbscan(df, "id", "x", "y", 3.0, 6).groupBy("cluster", "kind").count().collect()
    late.cancel()
    assert sorted(map(tuple, got)) == [(0, "core", 60_000), (1, "core", 60_000)]
