"""Relational queries: projection, filters, joins, aggregation, reshaping, transforms, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate as ag
from ..operators import relational as rel
from ..operators import transform as tr
from .registry import Tables, query


def r(c, n: int = 4):
    """Rounded, and never a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


@query("flagship", """
    SELECT c.c_custkey, c.c_name, g.n, round(g.total, 2) + 0.0 AS total, round(g.mean, 2) + 0.0 AS mean, round(g.median, 2) + 0.0 AS median, round(g.std, 2) + 0.0 AS std
    FROM (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, median(o_totalprice) AS median, stddev_samp(o_totalprice) AS std FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1) g
    LEFT JOIN customer c ON g.o_custkey = c.c_custkey ORDER BY g.total DESC, c.c_custkey LIMIT 20""")
def flagship(t: Tables) -> DataFrame:
    kept = rel.filter_rows(t.orders, [("o_totalprice", "not_null", None)])
    spec = [{"fn": "count", "as": "n"}, *({"column": "o_totalprice", "fn": f, "as": a} for f, a in (("sum", "total"), ("mean", "mean"), ("median", "median"), ("std", "std")))]
    g = rel.top_k(ag.group_by(kept, ["o_custkey"], spec), "total", 20, tie=["o_custkey"])
    out = rel.join(g, t.customer.select("c_custkey", "c_name"), {"left": "o_custkey", "right": "c_custkey"}, "left")
    return out.select(F.col("o_custkey").alias("c_custkey"), "c_name", "n", *(r(c, 2).alias(c) for c in ("total", "mean", "median", "std")))


@query("select_rename", "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice FROM orders")
def select_rename(t):
    return rel.select(t.orders, ["o_orderkey", "o_orderstatus", "o_totalprice"], {"o_orderkey": "id", "o_orderstatus": "status"})


@query("filter_and", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_returnflag IN ('A','R') AND l_discount < 0.05")
def filter_and(t):
    return rel.filter_rows(t.lineitem, [("l_quantity", "gte", 30), ("l_returnflag", "in", ["A", "R"]), ("l_discount", "lt", 0.05)]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_or_negate", """
    SELECT o_orderkey, s FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s, o_totalprice FROM orders)
    WHERE NOT (coalesce(s = 'F', false) OR coalesce(o_totalprice > 200000, false))""")
def filter_or_negate(t):
    df = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"), "o_totalprice")
    return rel.filter_rows(df, [("s", "eq", "F"), ("o_totalprice", "gt", 200000)], "or", negate=True).select("o_orderkey", "s")


@query("filter_contains_not_in", "SELECT p_partkey, p_name FROM part WHERE contains(p_type, 'a') AND p_brand NOT IN ('Brand#11', 'Brand#12') AND p_size <> 10")
def filter_contains_not_in(t):
    return rel.filter_rows(t.part, [("p_type", "contains", "a"), ("p_brand", "not_in", ["Brand#11", "Brand#12"]), ("p_size", "ne", 10)]).select("p_partkey", "p_name")


@query("filter_null_tests", "SELECT count(*) FILTER (s IS NULL) AS missing, count(*) FILTER (s IS NOT NULL) AS present FROM (SELECT nullif(o_orderstatus, 'P') AS s FROM orders)")
def filter_null_tests(t):
    df = t.orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    a = rel.filter_rows(df, [("s", "is_null", None)]).agg(F.count(F.lit(1)).alias("missing"))
    return a.crossJoin(rel.filter_rows(df, [("s", "not_null", None)]).agg(F.count(F.lit(1)).alias("present")))  # one row each


@query("group_by_12", """
    SELECT l_returnflag, count(*) AS n, count(v) AS present, count(*) - count(v) AS missing, round(sum(v), 2) + 0.0 AS total, round(avg(v), 4) + 0.0 AS mean, round(median(v), 4) + 0.0 AS median,
           min(v) AS low, max(v) AS high, round(var_samp(v), 4) + 0.0 AS var, round(stddev_samp(v), 4) + 0.0 AS std, count(DISTINCT v) AS kinds,
           first(v ORDER BY l_orderkey, l_linenumber) FILTER (v IS NOT NULL) AS first, last(v ORDER BY l_orderkey, l_linenumber) FILTER (v IS NOT NULL) AS last
    FROM (SELECT l_returnflag, l_orderkey, l_linenumber, nullif(l_quantity, 7) AS v FROM lineitem) GROUP BY 1""")
def group_by_12(t):
    df = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(7.0)).alias("v"))
    kinds = {"count": "present", "count_missing": "missing", "sum": "total", "mean": "mean", "median": "median", "min": "low", "max": "high", "var": "var", "std": "std", "nunique": "kinds", "first": "first", "last": "last"}
    out = ag.group_by(df, ["l_returnflag"], [{"fn": "count", "as": "n"}, *({"column": "v", "fn": f, "as": a} for f, a in kinds.items())], order=["l_orderkey", "l_linenumber"])
    return out.withColumns({"total": r("total", 2), "mean": r("mean"), "median": r("median"), "var": r("var"), "std": r("std")})


@query("group_by_null_key", "SELECT k, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM (SELECT nullif(o_orderstatus, 'P') AS k, o_totalprice FROM orders) GROUP BY k")
def group_by_null_key(t):
    df = t.orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("k"), "o_totalprice")
    return ag.group_by(df, ["k"], [{"fn": "count", "as": "n"}, {"column": "o_totalprice", "fn": "sum", "as": "total"}]).withColumn("total", r("total", 2))


@query("group_by_no_rows", "SELECT count(*) AS n FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0")
def group_by_no_rows(t):
    return ag.group_by(rel.filter_rows(t.orders, [("o_totalprice", "lt", 0)]), [], [{"fn": "count", "as": "n"}])


@query("pricing_summary", """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) + 0.0 AS sum_qty, round(sum(l_extendedprice), 2) + 0.0 AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) + 0.0 AS sum_disc, round(avg(l_quantity), 4) + 0.0 AS avg_qty, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t):
    l = t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice")
    return l.groupBy("l_returnflag", "l_linestatus").agg(r(F.sum("l_quantity"), 2).alias("sum_qty"), r(F.sum(price), 2).alias("sum_base"), r(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"), r(F.avg("l_quantity")).alias("avg_qty"), F.count(F.lit(1)).alias("n"))


@query("salted_sum", "SELECT l_returnflag, round(sum(l_extendedprice), 2) + 0.0 AS total FROM lineitem GROUP BY 1")
def salted_sum(t):
    return ag.salted_sum(t.lineitem, ["l_returnflag"], "l_extendedprice", "total").withColumn("total", r("total", 2))


def _suppliers(t):
    return t.supplier.select(F.nullif("s_nationkey", F.lit(4)).alias("k"), F.col("s_suppkey").alias("v")).union(t.spark.sql("select cast(null as int), -1L"))


for how, kind in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    key = {"inner": "a.k", "left": "a.k", "right": "b.k", "outer": "coalesce(a.k, b.k)"}[how]

    @query(f"join_{how}", f"""
        SELECT {key} AS k, a.v AS v_left, b.v AS v_right FROM (SELECT nullif(c_nationkey, 3) AS k, c_custkey AS v FROM customer) a
        {kind} (SELECT nullif(s_nationkey, 4) AS k, s_suppkey AS v FROM supplier UNION ALL SELECT NULL, -1) b ON a.k IS NOT DISTINCT FROM b.k""")
    def joined(t, how=how):
        a = t.customer.select(F.nullif("c_nationkey", F.lit(3)).alias("k"), F.col("c_custkey").alias("v"))
        return rel.join(a, _suppliers(t), "k", how)


@query("join_three", """
    SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) + 0.0 AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def join_three(t):
    c = rel.join(t.customer, t.nation, {"left": "c_nationkey", "right": "n_nationkey"})
    return rel.join(c, t.region, {"left": "n_regionkey", "right": "r_regionkey"}).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), r(F.sum("c_acctbal"), 2).alias("balance"))


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(t):
    return rel.semi_join(t.customer.select("c_custkey"), t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(t):
    return rel.semi_join(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], anti=True).select("c_custkey", "c_name")


_ASOF = "(SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p {} (SELECT event_id AS click_id, user_id, ts AS click_ts FROM events WHERE event_type = 'click') c"


def _sides(t):
    p = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return p, t.events.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", "ts")


@query("asof_backward", "SELECT p.event_id, p.user_id, c.click_id FROM " + _ASOF.format("ASOF LEFT JOIN") + " ON p.user_id = c.user_id AND p.ts >= c.click_ts")
def asof_backward(t):
    return rel.asof_join(*_sides(t), "ts", ["user_id"], tie=["click_id"]).select("event_id", "user_id", "click_id")


@query("asof_forward", "SELECT p.event_id, p.user_id, c.click_id FROM " + _ASOF.format("ASOF LEFT JOIN") + " ON p.user_id = c.user_id AND p.ts <= c.click_ts")
def asof_forward(t):
    return rel.asof_join(*_sides(t), "ts", ["user_id"], "forward", tie=["click_id"]).select("event_id", "user_id", "click_id")


@query("asof_nearest", """
    SELECT event_id, user_id, click_id FROM (SELECT p.event_id, p.user_id, c.click_id, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(c.click_ts)), c.click_ts, c.click_id) AS n FROM """ + _ASOF.format("LEFT JOIN") + " ON p.user_id = c.user_id) WHERE n = 1")
def asof_nearest(t):
    p, c = _sides(t)
    seconds = lambda df: df.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    return rel.asof_join(seconds(p), seconds(c), "at", ["user_id"], "nearest", tie=["click_id"]).select("event_id", "user_id", "click_id")


@query("asof_tolerance", "SELECT p.event_id, CASE WHEN epoch_us(p.ts) - epoch_us(c.click_ts) <= 3600000000 THEN c.click_id END AS click_id FROM " + _ASOF.format("ASOF LEFT JOIN") + " ON p.user_id = c.user_id AND p.ts >= c.click_ts")
def asof_tolerance(t):
    p, c = _sides(t)
    micros = lambda df: df.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    return rel.asof_join(micros(p), micros(c), "at", ["user_id"], tolerance=3600e6, tie=["click_id"]).select("event_id", "click_id")


@query("range_join", "SELECT p_partkey, b.low FROM part JOIN (SELECT n_nationkey AS low, n_nationkey + 3 AS high FROM nation) b ON p_size BETWEEN b.low AND b.high")
def range_join(t):
    return rel.range_join(t.part, t.nation.select(F.col("n_nationkey").alias("low"), (F.col("n_nationkey") + 3).alias("high")), "p_size", "low", "high", 4).select("p_partkey", "low")


_BOX = "SELECT {k} AS id, 'm' AS frame, {k} % 40 AS x0, {k} % 23 AS y0, {k} % 40 + {w} AS x1, {k} % 23 + {w} AS y1 FROM {t}"


@query("containment_join", f"SELECT a.id AS a_id, c.id AS c_id FROM ({_BOX.format(k='s_suppkey', w=9, t='supplier')}) a JOIN ({_BOX.format(k='c_custkey', w=2, t='customer')}) c ON a.x0 <= c.x0 AND a.y0 <= c.y0 AND a.x1 >= c.x1 AND a.y1 >= c.y1")
def containment_join(t):
    box = lambda df, k, w: df.selectExpr(f"{k} as id", "'m' as frame", f"{k} % 40 as x0", f"{k} % 23 as y0", f"{k} % 40 + {w} as x1", f"{k} % 23 + {w} as y1")
    return rel.containment_join(box(t.supplier, "s_suppkey", 9), box(t.customer, "c_custkey", 2), 8)


@query("melt", "UNPIVOT (SELECT s_suppkey, s_nationkey::DOUBLE AS nation, s_acctbal AS balance FROM supplier) ON nation, balance INTO NAME variable VALUE value")
def melt(t):
    return ag.melt(t.supplier.select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance")), ["s_suppkey"])


@query("pivot_sum", "SELECT o_orderpriority, " + ", ".join(f"round(sum(o_totalprice) FILTER (o_orderstatus = '{s}'), 2) + 0.0 AS {s}" for s in "FOP") + " FROM orders GROUP BY 1")
def pivot_sum(t):
    out = ag.pivot(t.orders, "o_orderpriority", "o_orderstatus", "o_totalprice", "sum")
    return out.select("o_orderpriority", *(r(c, 2).alias(c) for c in out.columns[1:]))


@query("pivot_fill", "SELECT n_name, " + ", ".join(f"coalesce(count(c_custkey) FILTER (c_mktsegment = '{s}'), 0) AS \"{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def pivot_fill(t):
    c = rel.join(t.customer, t.nation, {"left": "c_nationkey", "right": "n_nationkey"})
    return ag.pivot(c, "n_name", "c_mktsegment", "c_custkey", "count", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], fill=0)


@query("crosstab", "SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (o_orderpriority[1] = '{k}') AS p{k}" for k in "12345") + ", count(*) AS total FROM orders GROUP BY 1 UNION ALL SELECT 'total', " + ", ".join(f"count(*) FILTER (o_orderpriority[1] = '{k}')" for k in "12345") + ", count(*) FROM orders")
def crosstab(t):
    return ag.crosstab(t.orders.select("o_orderstatus", F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("p")), "o_orderstatus", "p", margins=True)


@query("standardize", "SELECT l_orderkey, l_linenumber, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) + 0.0 AS z FROM lineitem")
def standardize(t):
    return tr.standardize(t.lineitem, "l_extendedprice", "z").select("l_orderkey", "l_linenumber", r("z", 6).alias("z"))


@query("normalize", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 8) + 0.0 AS x FROM customer")
def normalize(t):
    return tr.normalize(t.customer, "c_acctbal", "x").select("c_custkey", r("x", 8).alias("x"))


@query("rank_column", "SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rank FROM lineitem")
def rank_column(t):
    return tr.average_ranks(t.lineitem, "l_quantity", "rank").select("l_orderkey", "l_linenumber", "rank")


@query("rank_in_groups", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rank FROM lineitem")
def rank_in_groups(t):
    return tr.average_ranks(t.lineitem, "l_quantity", "rank", ["l_returnflag"], descending=True).select("l_orderkey", "l_linenumber", "rank")


@query("bin_width", "SELECT p_partkey, CASE WHEN least(floor((p_size - lo) / w), 3) = 0 THEN 'a' WHEN least(floor((p_size - lo) / w), 3) = 1 THEN 'b' WHEN least(floor((p_size - lo) / w), 3) = 2 THEN 'c' ELSE 'd' END AS bin FROM part, (SELECT min(p_size) AS lo, (max(p_size) - min(p_size)) / 4.0 AS w FROM part)")
def bin_width(t):
    return tr.bin_column(t.part, "p_size", "bin", labels=list("abcd")).select("p_partkey", "bin")


@query("bin_quantile", "SELECT p_partkey, CASE WHEN p_retailprice < q[1] THEN 'low' WHEN p_retailprice < q[2] THEN 'mid' ELSE 'high' END AS bin FROM part, (SELECT quantile_cont(p_retailprice, [1/3.0, 2/3.0]) AS q FROM part)")
def bin_quantile(t):
    return tr.bin_column(t.part, "p_retailprice", "bin", 3, "quantile", ["low", "mid", "high"]).select("p_partkey", "bin")


@query("outliers_iqr", "SELECT o_orderkey, o_totalprice < q[1] - 0.5 * (q[2] - q[1]) OR o_totalprice > q[2] + 0.5 * (q[2] - q[1]) AS odd FROM orders, (SELECT quantile_cont(o_totalprice, [0.25, 0.75]) AS q FROM orders)")
def outliers_iqr(t):
    return tr.outliers(t.orders, "o_totalprice", "odd", k=0.5).select("o_orderkey", "odd")


@query("outliers_zscore", "SELECT o_orderkey FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders) WHERE abs(o_totalprice - m) > 1.5 * s")
def outliers_zscore(t):
    return tr.outliers(t.orders, "o_totalprice", "odd", "zscore", threshold=1.5).filter("odd").select("o_orderkey")


@query("missing_drop", "SELECT o_orderkey, s, p FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s, nullif(o_orderpriority, '1-URGENT') AS p FROM orders) WHERE s IS NOT NULL OR p IS NOT NULL")
def missing_drop(t):
    df = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"))
    return ag.missing(df, "drop", ["s", "p"], how="all")


@query("missing_mean", "SELECT l_orderkey, l_linenumber, round(coalesce(v, avg(v) OVER ()), 6) + 0.0 AS v FROM (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 7) AS v FROM lineitem)")
def missing_mean(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(7.0)).alias("v"))
    return ag.missing(df, "mean", ["v"]).withColumn("v", r("v", 6))


@query("missing_constant", "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_quantity, 7), -1.0) AS v FROM lineitem")
def missing_constant(t):
    return ag.missing(t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(7.0)).alias("v")), "constant", ["v"], value=-1.0)


for strategy, sql in (("forward", "last_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"), ("backward", "first_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")):

    @query(f"missing_{strategy}", f"SELECT o_orderkey, {sql} AS v FROM (SELECT *, nullif(o_orderstatus, 'P') AS v FROM orders)")
    def filled(t, strategy=strategy):
        df = t.orders.withColumn("v", F.nullif("o_orderstatus", F.lit("P")))
        return ag.missing(df, strategy, ["v"], order=["o_orderdate", "o_orderkey"], partition=["o_custkey"]).select("o_orderkey", "v")


@query("missing_report", "SELECT 's' AS \"column\", count(*) - count(s) AS missing, count(s) AS present, round((count(*) - count(s)) / count(*), 8) AS fraction, count(*) FILTER (s IS NOT NULL AND o_orderkey IS NOT NULL) AS complete_rows FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders) UNION ALL SELECT 'o_orderkey', 0, count(*), 0.0, count(*) FILTER (o_orderstatus <> 'P') FROM orders")
def missing_report(t):
    return ag.missing_report(t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))).withColumn("fraction", r("fraction", 8))


@query("shape", "SELECT unnest(['c_custkey', 'c_name', 'c_acctbal']) AS \"column\", unnest(['number', 'text', 'number']) AS kind, (SELECT count(*) FROM customer) AS rows")
def shape(t):
    return ag.shape(t.customer.select("c_custkey", "c_name", "c_acctbal"))


@query("describe_table", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", 'number' AS kind, count({c}) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\", round(avg({c}), 4) + 0.0 AS mean, round(stddev_samp({c}), 4) + 0.0 AS stdev, min({c})::DOUBLE AS min, quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q75, max({c})::DOUBLE AS max FROM part" for c in ("p_size", "p_partkey")))
def describe_table(t):
    return ag.describe_table(t.part, ["p_size", "p_partkey"]).withColumns({"mean": r("mean"), "stdev": r("stdev")})


@query("sort_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 50")
def sort_top(t):
    return rel.sort(t.orders, [("o_orderpriority", True), "o_totalprice"], ["o_orderkey"]).select("o_orderkey", "o_totalprice").limit(50)


@query("select_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def select_k(t):
    return rel.top_k(t.lineitem, "l_extendedprice", 10, tie=["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2")
def top_per_group(t):
    return rel.top_k_per_group(t.orders, ["o_custkey"], "o_totalprice", 2, tie=["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("best_of", "SELECT a.n_name AS best, a.s AS score, b.n_name AS runner_up, round(a.s - b.s, 4) + 0.0 AS margin, a.s >= 10 AS passes FROM (SELECT n_name, round(avg(c_acctbal), 4) AS s, row_number() OVER (ORDER BY round(avg(c_acctbal), 4) DESC, n_name) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) a, (SELECT n_name, round(avg(c_acctbal), 4) AS s, row_number() OVER (ORDER BY round(avg(c_acctbal), 4) DESC, n_name) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) b WHERE a.k = 1 AND b.k = 2")
def best_of(t):
    g = rel.join(t.customer, t.nation, {"left": "c_nationkey", "right": "n_nationkey"}).groupBy("n_name").agg(F.round(F.avg("c_acctbal"), 4).alias("s"))
    return rel.best_of(g, "s", "n_name", floor=10).withColumn("margin", r("margin"))


@query("concat", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def concat(t):
    return rel.concat(rel.select(t.nation, rename={"n_nationkey": "k", "n_name": "name", "n_regionkey": "region"}), rel.select(t.region, rename={"r_regionkey": "k", "r_name": "name"}))


for keep, d in (("first", ""), ("last", "DESC")):

    @query(f"dedupe_{keep}", f"SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate {d}, o_orderkey {d}) AS n FROM orders) WHERE n = 1")
    def deduped(t, keep=keep):
        return rel.dedupe(t.orders, ["o_custkey"], keep, ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("set_difference", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_difference(t):
    return rel.difference(t.nation.select(F.col("n_nationkey").alias("k")), t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), on=["k"])


@query("set_intersection", "SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(t):
    return rel.semi_join(t.customer.filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).distinct(), t.supplier.select(F.col("s_nationkey").alias("k")), ["k"])


@query("sample_exact")
def sample_exact(t):
    return rel.sample(t.orders, 100, seed=7, key=["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("sample_replace")
def sample_replace(t):
    return rel.sample(t.nation, 40, seed=7, replace=True).select("n_nationkey", "n_name")
