import pytest
from conftest import rows
from pyspark.sql import functions as F

from sparkloom.operators import aggregate as ag
from sparkloom.operators import relational as rel
from sparkloom.operators import transform as tr
from sparkloom.operators import window as win
from sparkloom.sources import readers
from sparkloom.table import with_position


@pytest.fixture()
def basket(spark):
    return readers.builtin(spark, "basket")


def test_a_null_cell_matches_nothing_but_is_null(basket):
    count = lambda *c, **k: rel.filter_rows(basket, list(c), **k).count()
    assert count(("price", "gt", 0)) == 4
    assert count(("price", "gt", 0), negate=True) == 1
    assert count(("shelf", "not_in", ["a"])) == 2
    assert count(("shelf", "is_null", None)) == 1
    assert count() == 5
    with pytest.raises(ValueError, match="'item'"):
        count(("nope", "eq", 1))


def test_null_keys_join(basket, spark):
    other = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "shelf string, price int")
    assert rel.join(basket, other, "shelf").count() == 3
    assert rel.join(basket, other, "shelf", "left").count() == 5
    out = rel.join(basket, other, "shelf", "outer")
    assert out.count() == 6 and {"price_left", "price_right"} <= set(out.columns)
    assert rel.semi_join(basket, other, ["shelf"], anti=True).count() == 2
    with pytest.raises(ValueError):
        rel.join(basket, other, "shelf", "sideways")


def test_asof(spark):
    trades, quotes = readers.builtin(spark, "trades"), readers.builtin(spark, "quotes")
    got = {(r.t, r.sym): r.bid for r in rel.asof_join(trades, quotes, "t", ["sym"]).collect()}
    assert got == {(1.0, "x"): 9.9, (2.0, "y"): None, (3.0, "x"): 9.9, (None, "x"): None}
    ahead = {(r.t, r.sym): r.bid for r in rel.asof_join(trades, quotes, "t", ["sym"], "forward").collect()}
    assert ahead == {(1.0, "x"): 9.9, (2.0, "y"): 19.0, (3.0, "x"): 10.5, (None, "x"): None}
    near = {(r.t, r.sym): r.bid for r in rel.asof_join(trades, quotes, "t", ["sym"], "nearest", tolerance=0.5).collect()}
    assert near == {(1.0, "x"): 9.9, (2.0, "y"): 19.0, (3.0, "x"): 10.5, (None, "x"): None}


def test_group_by_edges(basket):
    none = basket.limit(0)
    assert ag.group_by(none, [], [{"fn": "count"}]).count() == 0
    out = {r.shelf: r for r in ag.group_by(basket, ["shelf"], [{"column": "price", "fn": "std", "as": "s"}, {"column": "price", "fn": "median", "as": "m"}, {"fn": "count_missing", "as": "c"}]).collect()}
    assert out[None].s is None and out[None].m == 3.0 and out["a"].c == 0
    with pytest.raises(ValueError):
        ag.group_by(basket, ["shelf"], [{"column": "price", "fn": "sum", "as": "shelf"}])


def test_pivot_and_crosstab_name_null_heads_empty(basket):
    assert ag.pivot(basket, "item", "shelf", "units").columns == ["item", "", "a", "b"]
    filled = ag.pivot(basket, "item", "shelf", "price", fill=-1.0)
    assert {r["item"]: r["a"] for r in filled.collect()} == {"pear": 1.5, "plum": None, "leek": -1.0, "kale": -1.0, "fig": -1.0}
    assert ("total", 1, 2, 2, 5) in rows(ag.crosstab(basket, "item", "shelf", margins=True))


def test_constant_columns_are_errors(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    for f in (tr.standardize, tr.normalize):
        with pytest.raises(Exception, match="spread|constant"):
            f(df, "v").collect()


def test_bins_are_left_closed(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)], "v double")
    assert [r[1] for r in tr.bin_column(df, "v", "b", 2).orderBy("v").collect()] == ["[0, 2)", "[0, 2)", "[2, 4)", "[2, 4)", "[2, 4)"]


def test_fills_and_interpolation(spark):
    gaps = readers.builtin(spark, "gaps")
    assert [r.reading for r in ag.missing(gaps, "forward", ["reading"], order=["step"]).orderBy("step").collect()] == [None, 2.0, 2.0, 6.0, 6.0]
    assert [r.x for r in win.interpolate(gaps, "reading", "step", "x", ["step"], limit_direction="both").orderBy("step").collect()] == [2.0, 2.0, 4.0, 6.0, 6.0]


def test_positions_follow_the_order(spark):
    df = spark.createDataFrame([(i * 7 % 20,) for i in range(20)], "v long").repartition(4)
    assert [(r.v, r._pos) for r in with_position(df, ["v"]).orderBy("v").collect()] == [(i, i) for i in range(20)]


def test_sample_is_exact_and_repeatable(basket):
    a, b = rel.sample(basket, 3, 1), rel.sample(basket, 3, 1)
    assert a.count() == 3 and rows(a) == rows(b)
    assert rel.sample(basket, 9, 1, replace=True).count() == 9


def test_csv_types_and_missing_spellings(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a, b ,c,d\n1,x,true,1.5\n2,"y ""q"", z",false,NA\n,NA,true,3\n')
    df = readers.read_csv(spark, str(tmp_path / "t.csv"), missing=["NA"])
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "boolean", "d": "double"}
    assert rows(df.select("b"))[-1] == ('y "q", z',) or ('y "q", z',) in rows(df.select("b"))
    with pytest.raises(ValueError):
        readers.safe_path("/data", "../etc")


def test_rank_ties_share_the_mean(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (None,)], "v double")
    assert rows(tr.average_ranks(df, "v", "r")) == [(1.0, 1.0), (3.0, 2.5), (3.0, 2.5), (None, None)]


def test_multiple_runs_of_days(spark):
    df = spark.createDataFrame([("2024-01-01", True), ("2024-01-02", True), ("2024-01-04", True), ("2024-01-05", False)], "d string, m boolean")
    assert sorted((str(r.start), r.days, r.open) for r in win.membership_runs(df, "d", "m", end="2024-01-04").collect()) == [("2024-01-01", 2, False), ("2024-01-04", 1, True)]


def test_aggregates_by_order(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 6.0), (4, None)], "k int, v double")
    r = df.agg(ag.aggregate("first", "v", ["k"]).alias("f"), ag.aggregate("last", "v", ["k"]).alias("l"), F.lit(1)).first()
    assert (r.f, r.l) == (5.0, 6.0)


def test_sessions_round_to_seconds_as_their_sql(spark):
    at = ["2024-01-01 00:00:00.6", "2024-01-01 02:00:01.4", "2024-01-01 04:00:01.4", "2024-01-01 06:00:01.5", "2024-01-01 08:00:02.4"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(at)], "k long, t string").selectExpr("k", "to_timestamp(t) as t", "1 as u")
    assert rows(win.sessions(df, "t", ["u"], 7200).select("k", "session")) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]
    tied = df.unionByName(df.withColumn("k", df.k + 10)).unionByName(df.withColumn("k", df.k + 20))
    assert {(k % 10, s) for k, s in rows(win.sessions(tied, "t", ["u"], 7200).select("k", "session"))} == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)}
