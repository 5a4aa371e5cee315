"""Running values, neighbourhoods and salted joins against plain recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom import table
from sparkloom.functions import statistics as st
from sparkloom.operators import graph, linalg


def frame(spark, n=200, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, rng.randrange(30)]), rng.random()) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k long, v long, x double").repartition(7)


def test_running_sums_and_bounds(spark):
    rows, df = frame(spark)
    got = {r.k: r for r in table.with_running(df, ["k"], {"s": ("sum", "v"), "hi": ("max", "x"), "lo": ("min", F.col("x") * 2)}).collect()}
    total, seen = None, []
    for k, v, x in sorted(rows):
        total = total if v is None else v + (total or 0)
        seen.append(x)
        assert (got[k].s, got[k].hi, got[k].lo) == (total, max(seen), 2 * min(seen))
    assert table.with_running(df.limit(0), ["k"], {"s": ("sum", "v")}).count() == 0


def test_lags_over_blocks(spark):
    rows, df = frame(spark)
    values = {k: x for k, _, x in rows}
    near, w = table.neighbourhoods(df, ["k"], before=2, after=1, rows=9)
    out = near.withColumn("b", F.lag("x", 2).over(w)).withColumn("a", F.lead("x").over(w)).filter("not halo__")
    assert {r.k: (r.b, r.a) for r in out.collect()} == {k: (values.get(k - 2), values.get(k + 1)) for k in values}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_salted(spark, monkeypatch, how):
    monkeypatch.setattr(table, "KEY_ROWS", 5)
    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(120)]
    left = spark.createDataFrame(rows, "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k9", 3), ("unmet", 4)], "k string, v long")
    want = left.join(right, "k", how)
    got = table.salted_join(left, right, ["k"], left.groupBy("k").agg(F.count("*").alias("n")), "i", how)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(table, "KEY_ROWS", 5)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(60)} | {100 + i: 100 for i in range(41)}


def test_vectors_in_order(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(12)], "i long, v double").repartition(4)
    assert [r.cumsum for r in linalg.cumsum(df).orderBy("i").collect()] == [sum(j * j for j in range(i + 1)) for i in range(12)]
    assert [r["diff"] for r in linalg.diff(df, times=2).orderBy("i").collect()] == [2.0] * 10
    assert [r.gradient for r in linalg.gradient(df).orderBy("i").collect()] == [1.0, *(2.0 * i for i in range(1, 11)), 21.0]
    far = linalg.pairwise(df.selectExpr("i", "array(v) as e").filter("i < 6"), df.selectExpr("i", "array(v) as e"), "i", "e", block=2)
    assert {(r.a, r.b): r.distance for r in far.collect()} == {(a, b): float(abs(a * a - b * b)) for a in range(6) for b in range(12)}


def test_quadratic_operators_refuse_more_rows(spark, monkeypatch):
    monkeypatch.setattr(st, "PAIR_ROWS", 10)
    with pytest.raises(ValueError, match="all pairs"):
        st.kendall(spark.range(11).selectExpr("id", "double(id) as x", "double(-id) as y"), "x", "y", "id")


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_without_keys_is_the_keyed_one(spark, monkeypatch, direction):
    from sparkloom.operators import relational as rel

    monkeypatch.setattr(table, "KEY_ROWS", 3)
    rng = random.Random(direction)
    left = spark.createDataFrame([(i, rng.choice([None, rng.randrange(-5, 60)])) for i in range(60)], "i long, t long").repartition(4)
    right = spark.createDataFrame([(rng.choice([None, rng.randrange(10, 40)]), j) for j in range(25)], "t long, j long").repartition(3)
    one = lambda df: df.withColumn("k", F.lit(1))
    want = rel.asof_join(one(left), one(right), "t", ["k"], direction, tie=["j"]).select("i", "j")
    got = rel.asof_join(left, right, "t", (), direction, tie=["j"]).select("i", "j")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_all_pairs_by_sorting(spark, monkeypatch):
    from sparkloom.operators import regression as reg

    monkeypatch.setattr(st, "PAIR_ROWS", 1000)
    monkeypatch.setattr(reg, "PAIR_ROWS", 1000)
    rng = random.Random(5)
    assert st.inversions(st.np.array([3, 1, 2, 2, 0])) == 7 and st.inversions(st.np.array([])) == 0
    for spread, n in ((4, 61), (1000, 60), (3, 2), (1, 12)):
        data = [(i, float(rng.randrange(spread)) * 1e3, rng.choice([None, rng.gauss(0, 1), float(rng.randrange(spread))])) for i in range(n)]
        df = spark.createDataFrame(data, "k long, x double, y double")
        for fn, column in ((st.kendall, "tau"), (reg.theil_sen, "slope"), (reg.siegel_slopes, "slope")):
            want = fn(df, "x", "y", "k").first()[column]
            monkeypatch.setattr(st, "PAIR_ROWS", 1)
            monkeypatch.setattr(reg, "PAIR_ROWS", 1)
            got = fn(df, "x", "y", "k", bound=False).first()[column]
            monkeypatch.setattr(st, "PAIR_ROWS", 1000)
            monkeypatch.setattr(reg, "PAIR_ROWS", 1000)
            assert (got is None) == (want is None) and (want is None or got == pytest.approx(want, rel=1e-9, abs=1e-12))
