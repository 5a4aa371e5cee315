"""Graphs, search, standings, constraints, programs and records, sources, rasters, streaming."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import applications as app
from ..operators import graph, raster
from ..operators import relational as rel
from ..plans import program as prog
from ..plans import records as rec
from ..plans import study as auto
from ..sources import readers
from .core import r
from .registry import query
from .statistics import one


@query("closure", """
    WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), w AS (SELECT 'r1' AS node, 0 AS depth UNION ALL SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node)
    SELECT node, min(depth) AS depth FROM w GROUP BY 1""")
def closure(t):
    e = t.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")).union(t.customer.select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey")))
    return graph.closure(t.spark.createDataFrame([("r1",)], "node string"), e)


_EDGE = "SELECT c_custkey AS a, c_custkey + 1 + c_custkey % 3 AS b FROM customer WHERE c_custkey % 4 <> 0"


@query("components", f"WITH RECURSIVE e AS (SELECT a, b FROM ({_EDGE}) UNION ALL SELECT b, a FROM ({_EDGE})), w AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.node) SELECT node, min(root) AS component FROM w GROUP BY 1")
def components(t):
    return graph.components(t.customer.filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1 + F.col("c_custkey") % 3).alias("b")))


def _graph(t):
    v = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))
    return v, t.orders.select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst"), F.substring("o_orderpriority", 1, 1).alias("kind"))


_TRANS = "SELECT a.o_orderstatus AS from_label, b.o_orderstatus AS to_label, a.o_orderpriority[1] AS kind, count(*) AS n FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 GROUP BY 1, 2, 3"


@query("transitions", _TRANS)
def transitions(t):
    return graph.transitions(*_graph(t))


@query("motif", "SELECT a.o_orderkey AS v0, a.o_orderkey + 1 AS v1, a.o_orderkey + 2 AS v2 FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 JOIN orders c ON c.o_orderkey = a.o_orderkey + 2 WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O' AND c.o_orderstatus = 'F' AND a.o_orderpriority[1] = '1' AND b.o_orderpriority[1] = '2'")
def motif(t):
    return graph.match_all(*_graph(t), ["F", "O", "F"], [(0, 1, "1"), (1, 2, "2")])


@query("substructures", f"SELECT *, (n - 1) * 3 - n AS saving FROM ({_TRANS}) WHERE n >= 2")
def substructures(t):
    return graph.best_substructure(*_graph(t))


@query("text_search", """
    WITH s AS (SELECT p_partkey, lower(trim(p_name)) AS n, lower(trim(p_type)) AS y, list_filter(regexp_split_to_array(lower(trim(p_name)), '[^a-z0-9+.''-]+'), lambda x: x <> '') AS nw, list_filter(regexp_split_to_array(lower(trim(p_type)), '[^a-z0-9+.''-]+'), lambda x: x <> '') AS yw FROM part)
    SELECT p_partkey, greatest(CASE WHEN list_contains(nw, 's') THEN 30.0 WHEN starts_with(n, 's') THEN 20.0 WHEN len(list_filter(nw, lambda x: starts_with(x, 's'))) > 0 THEN 15.0 WHEN contains(n, 's') THEN 10.0 END, CASE WHEN list_contains(yw, 's') THEN 21.0 WHEN starts_with(y, 's') THEN 14.0 WHEN len(list_filter(yw, lambda x: starts_with(x, 's'))) > 0 THEN 11.0 WHEN contains(y, 's') THEN 7.0 END)::DOUBLE AS score FROM s WHERE contains(n, 's') OR contains(y, 's')""")
def text_search(t):
    rows = t.part.select("p_partkey", F.col("p_name").alias("mold"), F.col("p_type").alias("category"))
    return app.search(rows, ["mold", "category"], "s").select("p_partkey", "score")


@query("shelf", """
    WITH w AS (SELECT l_orderkey || '-' || l_linenumber AS disc_id, l_shipdate, lower(trim(p_name)) AS n, lower(trim(p_brand)) AS b, lower(trim(l_returnflag)) AS c FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
    k AS (SELECT *, list_filter(regexp_split_to_array(n, '[^a-z0-9+.''-]+'), lambda x: x <> '') AS nw, list_filter(regexp_split_to_array(b, '[^a-z0-9+.''-]+'), lambda x: x <> '') AS bw FROM w),
    s AS (SELECT disc_id, l_shipdate, greatest(CASE WHEN list_contains(nw, 'brand') THEN 30.0 WHEN starts_with(n, 'brand') THEN 20.0 WHEN len(list_filter(nw, lambda x: starts_with(x, 'brand'))) > 0 THEN 15.0 WHEN contains(n, 'brand') THEN 10.0 END,
        CASE WHEN list_contains(bw, 'brand') THEN 21.0 WHEN starts_with(b, 'brand') THEN 14.0 WHEN len(list_filter(bw, lambda x: starts_with(x, 'brand'))) > 0 THEN 11.0 WHEN contains(b, 'brand') THEN 7.0 END, CASE WHEN c = 'brand' THEN 15.0 END)::DOUBLE AS score FROM k)
    SELECT disc_id, score, (SELECT count(DISTINCT l_shipdate::DATE) FROM w WHERE w.disc_id = s.disc_id) AS bags FROM s WHERE score IS NOT NULL""")
def shelf(t):
    discs = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("disc_id"), F.col("l_partkey").alias("mold_id"), F.col("l_returnflag").alias("color"))
    molds = t.part.select(F.col("p_partkey").alias("mold_id"), F.col("p_name").alias("mold"), F.col("p_brand").alias("maker_id"))
    makers = t.part.select(F.col("p_brand").alias("maker_id")).distinct().withColumn("maker", F.col("maker_id"))
    bags = t.lineitem.select(F.col("l_shipdate").cast("date").cast("string").alias("bag_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("disc_id"))
    return app.shelf(discs, molds, makers, bags, "brand").select("disc_id", "score", F.size("bag_ids").alias("bags"))


def _scores(t):
    """Yearly scores of customers."""
    return t.orders.select(F.year("o_orderdate").alias("state"), F.col("o_custkey").alias("entry"), F.floor(F.col("o_totalprice") / 40000).alias("score")).groupBy("state", "entry").agg(F.max("score").alias("score"))


_SCORES = "s AS (SELECT year(o_orderdate) AS state, o_custkey AS entry, max(floor(o_totalprice / 40000))::BIGINT AS score FROM orders GROUP BY 1, 2)"


@query("standings", f"""
    WITH {_SCORES}, p AS (SELECT *, rank() OVER (PARTITION BY state ORDER BY score DESC) AS place, count(*) OVER (PARTITION BY state, score) AS size, row_number() OVER (PARTITION BY state ORDER BY score DESC, entry) AS k FROM s),
    q AS (SELECT *, avg(CASE k WHEN 1 THEN 10.0 WHEN 2 THEN 6 WHEN 3 THEN 3 WHEN 4 THEN 1 ELSE 0 END) OVER (PARTITION BY state, score) AS raw FROM p)
    SELECT state, entry, place, size > 1 AS tied, floor(raw * 100 + 0.5) / 100 AS points, round(sum(floor(raw * 100 + 0.5) / 100) OVER (PARTITION BY entry ORDER BY state ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS total FROM q""")
def standings(t):
    out = app.standings(_scores(t), [10, 6, 3, 1], "high")
    return out.select(F.col("state").cast("long").alias("state"), "entry", "place", "tied", "points", r("total").alias("total"))


@query("standings_entry", f"WITH {_SCORES} SELECT entry, count(*) AS states, max(score) AS best FROM s GROUP BY 1")
def standings_entry(t):
    return app.standings(_scores(t), [10, 6, 3, 1], "high").groupBy("entry").agg(F.count(F.lit(1)).alias("states"), F.max("score").alias("best"))


@query("ties", f"WITH {_SCORES} SELECT state, count(score) - count(DISTINCT score) AS tied, CASE WHEN count(score) > count(DISTINCT score) THEN 'fail' ELSE 'pass' END AS status FROM s GROUP BY 1")
def ties(t):
    return app.ties(_scores(t), "none").withColumn("state", F.col("state").cast("long"))


@query("entered", f"WITH {_SCORES} SELECT state, count(nullif(score, 3)) AS entered, count(*) AS of, CASE WHEN count(nullif(score, 3)) = count(*) THEN 'pass' ELSE 'pending' END AS status FROM s GROUP BY 1")
def entered(t):
    return app.entered(_scores(t).withColumn("score", F.nullif("score", F.lit(3)))).withColumn("state", F.col("state").cast("long"))


def _bags(t):
    teams = t.nation.select(F.col("n_name").alias("team"), F.col("n_nationkey").alias("bag_id"))
    return teams, t.customer.select(F.col("c_nationkey").alias("bag_id"), F.col("c_custkey").alias("disc_id")), t.customer.filter("c_custkey % 97 <> 0").select(F.col("c_custkey").alias("disc_id"), F.col("c_mktsegment").alias("mold_id"))


@query("bag_limit", "SELECT n_name AS team, count(c_custkey) AS n, CASE WHEN count(*) FILTER (c_custkey % 97 = 0) > 0 OR count(c_custkey) > 60 THEN 'fail' ELSE 'pass' END AS status FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def bag_limit(t):
    return app.bag_limit(*_bags(t), 60)


@query("one_mold", "SELECT n_name AS team, count(DISTINCT c_mktsegment) AS molds, CASE count(DISTINCT c_mktsegment) WHEN 0 THEN 'pending' WHEN 1 THEN 'pass' ELSE 'fail' END AS status FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 97 <> 0) ON c_nationkey = n_nationkey GROUP BY 1")
def one_mold(t):
    return app.one_mold(*_bags(t))


@query("team_throws", "SELECT r_name AS round, n_name AS team, count(c_custkey) AS n, CASE WHEN count(c_custkey) > 60 OR (r_regionkey < 2 AND count(c_custkey) <> 60) THEN 'fail' WHEN count(c_custkey) = 60 THEN 'pass' ELSE 'pending' END AS status FROM region CROSS JOIN nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 5 = r_regionkey GROUP BY r_name, n_name, r_regionkey")
def team_throws(t):
    rounds = t.region.select(F.col("r_name").alias("round"), (F.col("r_regionkey") < 2).alias("complete"), "r_regionkey")
    throws = t.customer.join(rounds, F.col("c_custkey") % 5 == F.col("r_regionkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("round", F.col("n_name").alias("team"))
    return app.team_throws(rounds.drop("r_regionkey"), t.nation.select(F.col("n_name").alias("team")), throws, 60)


@query("combine_constraints", "SELECT 'fail' AS \"all\", 'pass' AS \"any\"")
def combine_constraints(t):
    rows = t.spark.createDataFrame([("a", "pass"), ("a", "pass"), ("b", "fail"), ("b", "pending")], "rule string, status string")
    return app.combine(rows).withColumnRenamed("status", "all").crossJoin(app.combine(rows, "any").withColumnRenamed("status", "any"))  # one row each


@query("stability_histogram", "SELECT count(*) FILTER (s_acctbal < 0) AS under, count(*) FILTER (s_acctbal = 0) AS neutral, count(*) FILTER (s_acctbal > 0) AS over FROM supplier")
def stability_histogram(t):
    return app.stability_histogram(t.supplier, "s_acctbal")


@query("letters", "SELECT CASE WHEN p_size >= 40 THEN 'A' WHEN p_size >= 20 THEN 'B' ELSE 'C' END AS letter, count(*) AS n, round(avg(p_size), 2) + 0.0 AS mean, median(p_size)::DOUBLE AS median FROM part GROUP BY 1")
def letters(t):
    out = app.letters(t.part, "p_size", [("A", 40), ("B", 20), ("C", 0)])
    return out.groupBy("letter").agg(F.count(F.lit(1)).alias("n"), r(F.avg("p_size"), 2).alias("mean"), F.median("p_size").cast("double").alias("median"))


@query("bar_chart", "SELECT n_regionkey, rpad(n_regionkey::VARCHAR, 2, ' ') || ' ' || repeat('#', count(*)::INT) AS line FROM nation GROUP BY 1")
def bar_chart(t):
    return app.bar_chart(t.nation, "n_regionkey")


@query("roster", "SELECT n_name AS name, n_nationkey::DOUBLE AS score FROM nation")
def roster(t):
    return app.parse_roster(t.nation.select(F.concat("n_name", F.lit(", "), F.col("n_nationkey").cast("string")).alias("value")))


@query("pick_to_carry", "SELECT s_name FROM supplier WHERE abs(s_acctbal) <= 1000")
def pick_to_carry(t):
    return app.pick_to_carry(t.supplier, "s_acctbal", "s_name", 1000)


@query("rate_difference", "SELECT p AS prior, c AS current, round((c - p) * 100, 6) + 0.0 AS points FROM (SELECT avg((l_returnflag = 'R')::INT) FILTER (l_orderkey % 2 = 0) AS p, avg((l_returnflag = 'R')::INT) FILTER (l_orderkey % 2 = 1) AS c FROM lineitem)")
def rate_difference(t):
    l = t.lineitem.withColumn("f", F.col("l_returnflag") == "R")
    return app.rate_difference(l.filter("l_orderkey % 2 = 0"), l.filter("l_orderkey % 2 = 1"), "f").withColumn("points", r("points", 6))


@query("description_frequency", "SELECT event_type, count(DISTINCT user_id) AS n_who, count(DISTINCT event_id % 10) AS n_what, (SELECT count(DISTINCT user_id) FROM events) AS all_who, (SELECT count(DISTINCT event_id % 10) FROM events) AS all_what FROM events GROUP BY 1")
def description_frequency(t):
    return app.description_frequency(t.events.withColumn("w", F.col("event_id") % 10), "event_type", "user_id", "w")


@query("layered_settings", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), CASE WHEN c_nationkey < 10 THEN 'preset' END, 'global') AS value, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'instance' WHEN c_nationkey < 10 THEN 'preset' ELSE 'global' END AS source FROM customer")
def layered_settings(t):
    value, source = app.layered(F.nullif("c_mktsegment", F.lit("BUILDING")), F.when(F.col("c_nationkey") < 10, F.lit("preset")), F.lit("global"))
    return t.customer.select("c_custkey", value.alias("value"), source.alias("source"))


_GOLDEN = """
    WITH f AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p, min(c_custkey) OVER (PARTITION BY c_nationkey) AS first FROM customer),
    d AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS d FROM f WHERE p < 3 OR first = c_custkey),
    s AS (SELECT c_custkey, CASE WHEN d < 5 THEN [3, 1, 4, 2, 0][d + 1] ELSE floor(((d - 5) * 6 + 11) * 1.618033988749895::DOUBLE % 1 * 5)::INT % 5 END AS slot FROM d),
    g AS (SELECT f.c_custkey, ['a', 'b', 'c', 'd', 'e'][coalesce(s.slot, l.slot) + 1] AS family, CASE WHEN p < 3 THEN 'spread' ELSE 'grouped' END AS phase FROM f LEFT JOIN s ON s.c_custkey = f.c_custkey JOIN s l ON l.c_custkey = f.first)"""


def _golden(t):
    return app.golden_assign(t.customer, "c_nationkey", "c_custkey", list("abcde"))


@query("golden_assign", f"{_GOLDEN} SELECT c_custkey, family, phase FROM g")
def golden_assign(t):
    return _golden(t).select("c_custkey", "family", "phase")


@query("golden_histogram", f"{_GOLDEN} SELECT family, count(*) AS n FROM g GROUP BY 1")
def golden_histogram(t):
    return app.golden_histogram(_golden(t), list("abcde"))


_STACKED = "SELECT o_custkey AS k, list_slice(list({'address': o_orderstatus, 'value': o_orderkey} ORDER BY o_orderdate, o_orderkey), -4, -1) AS s FROM orders GROUP BY 1"


def _stacked(t):
    g = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))).alias("a"))
    entry = lambda e: F.struct(e["o_orderstatus"].alias("address"), e["o_orderkey"].alias("value"))
    kind = f"array<struct<address:string,value:{t.orders.schema['o_orderkey'].dataType.simpleString()}>>"
    return g.select("k", F.aggregate("a", F.array().cast(kind), lambda s, e: app.undo_push(s, entry(e), 4)).alias("s"))


@query("undo_pop", f"SELECT k, CASE WHEN s[-1].address = 'F' THEN s[-1].value ELSE -1 END AS restored FROM ({_STACKED})")
def undo_pop(t):
    return _stacked(t).select("k", app.undo_pop(F.col("s"), F.lit(-1).cast("long"), F.lit("F")).alias("restored"))


@query("undo_settle", f"SELECT k, len(s) - (s[-1].address = 'F')::INT AS depth FROM ({_STACKED})")
def undo_settle(t):
    return _stacked(t).select("k", F.size(app.undo_settle(F.col("s"), F.lit("F"))).cast("long").alias("depth"))


@query("undo_stack", "SELECT o_custkey, len(list_slice(list(o_orderkey ORDER BY o_orderdate, o_orderkey), -4, -1)) AS depth, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS top FROM orders GROUP BY 1")
def undo_stack(t):
    g = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("a"))
    stack = F.aggregate("a", F.array().cast("array<bigint>"), lambda s, e: app.undo_push(s, e["o_orderkey"], 4))
    return g.select("o_custkey", stack.alias("s")).select("o_custkey", F.size("s").cast("long").alias("depth"), app.undo_pop(F.col("s"), F.lit(None).cast("bigint")).alias("top"))


@query("event_fold", "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS purchases, max_by(event_type, (ts, event_id)) AS last FROM events GROUP BY 1")
def event_fold(t):
    step = lambda s, e: {"purchases": s.get("purchases", 0) + (e["event_type"] == "purchase"), "last": e["event_type"]}
    return app.fold(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], step, "user_id long, purchases long, last string")


@query("flatten_fields", "SELECT n_nationkey AS \"a.id\", n_name AS \"a.b.name\", 2 AS \"tags.count\" FROM nation")
def flatten_fields(t):
    df = t.nation.select(F.struct(F.col("n_nationkey").alias("id"), F.struct(F.col("n_name").alias("name")).alias("b")).alias("a"), F.array(F.lit("x"), F.lit("y")).alias("tags"))
    return app.flatten_fields(df).drop("tags")


# programs and records --------------------------------------------------------------------------------


def _program(t):
    catalog = prog.Catalog()
    catalog.write("px.orders", t.orders)
    catalog.write("px.customer", t.customer)
    catalog.register("fn.kept", lambda df, least: rel.filter_rows(df, [("o_totalprice", "gte", least)]))
    catalog.register("fn.totals", lambda df: df.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")))
    catalog.register("fn.named", lambda df, names: rel.join(df, names.select("c_custkey", "c_name"), {"left": "o_custkey", "right": "c_custkey"}))
    p = prog.Program("totals").calc("read", "fn.kept", id="keep", into="px.kept", args={"least": 100000.0}, df="px.orders")
    p.calc("sum", "fn.totals", id="sum", into="px.totals", df="px.kept").calc("name", "fn.named", id="name", into="px.named", df="px.totals", names="px.customer")
    return catalog, p, p.run(catalog)


@query("program_run", "SELECT o_custkey, round(sum(o_totalprice), 2) + 0.0 AS total, any_value(c_name) AS c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 100000 GROUP BY 1")
def program_run(t):
    catalog, _, _ = _program(t)
    return prog.Query.part("px.named").one(catalog).withColumn("total", r("total", 2))


@query("record_ps", "SELECT * FROM (VALUES (0::BIGINT, 'read', 'keep', 'fn.kept'), (1, 'sum', 'sum', 'fn.totals'), (2, 'name', 'name', 'fn.named')) v(position, tick, id, calculation)")
def record_ps(t):
    return rec.ps(_program(t)[2].to_df(t.spark)).select("position", "tick", "id", "calculation")


@query("record_ls", "SELECT * FROM (VALUES ('px.customer', NULL, 1::BIGINT), ('px.kept', 'keep', 1), ('px.named', 'name', 0), ('px.orders', NULL, 1), ('px.totals', 'sum', 1)) v(address, producer, readers)")
def record_ls(t):
    return rec.ls(_program(t)[2].to_df(t.spark))


@query("record_lineage", "SELECT * FROM (VALUES ('px.named', 0), ('px.totals', 1), ('px.customer', 1), ('px.kept', 2), ('px.orders', 3)) v(node, depth)")
def record_lineage(t):
    return rec.lineage(_program(t)[2].to_df(t.spark), "px.named")


@query("record_laws", "SELECT true AS one_writer, true AS in_order")
def record_laws(t):
    return rec.laws(_program(t)[2].to_df(t.spark)).select("one_writer", "in_order")


@query("record_ticks", "SELECT * FROM (VALUES ('read', 1::BIGINT, 'px.orders', 'px.kept'), ('sum', 1, 'px.kept', 'px.totals'), ('name', 1, 'px.customer,px.totals', 'px.named')) v(tick, calls, reads, writes)")
def record_ticks(t):
    return rec.ticks(_program(t)[2].to_df(t.spark)).select("tick", "calls", F.array_join("reads", ",").alias("reads"), F.array_join("writes", ",").alias("writes"))


@query("record_diff", "SELECT coalesce('a' || a.n_nationkey, 'a' || b.k) AS address, CASE WHEN a.n_nationkey IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.n_regionkey = b.d THEN 'same' ELSE 'changed' END AS status FROM (SELECT * FROM nation WHERE n_nationkey < 20) a FULL JOIN (SELECT n_nationkey AS k, n_regionkey + (n_nationkey % 2) AS d FROM nation WHERE n_nationkey > 4) b ON a.n_nationkey = b.k")
def record_diff(t):
    a = t.nation.filter("n_nationkey < 20").selectExpr("concat('a', n_nationkey) as address", "n_regionkey as digest")
    b = t.nation.filter("n_nationkey > 4").selectExpr("concat('a', n_nationkey) as address", "n_regionkey + n_nationkey % 2 as digest")
    return rec.diff(a, b)


@query("record_hot", "SELECT event_type AS calculation, count(*) AS calls, round(sum(value), 2) + 0.0 AS total_ms, max(value) AS slowest_ms, round(sum(value) / (SELECT sum(value) FROM events), 6) + 0.0 AS share FROM events GROUP BY 1")
def record_hot(t):
    return rec.hot(t.events.select(F.col("event_type").alias("calculation"), F.col("value").alias("ms"))).withColumn("total_ms", r("total_ms", 2)).withColumn("share", r("share", 6))


@query("reuse_hits", "SELECT count(*) FILTER (event_id > f) AS hits, count(*) FILTER (event_id = f) AS misses FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS f FROM events)")
def reuse_hits(t):
    h = rec.hits(t.events.select(F.col("event_id").alias("position"), F.concat_ws("/", "user_id", "event_type").alias("key")))
    return h.agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.sum((~F.col("hit")).cast("long")).alias("misses"))


@query("receipts", "SELECT * FROM (VALUES ('keep', 'px.orders', 'px.kept'), ('sum', 'px.kept', 'px.totals'), ('name', 'px.customer,px.totals', 'px.named')) v(id, consumes, produces)")
def receipts(t):
    return rec.receipts(_program(t)[2].to_df(t.spark)).select("id", F.array_join("consumes", ",").alias("consumes"), F.array_join("produces", ",").alias("produces"))


@query("judge", "SELECT count(*) AS receipts, count(*) FILTER (event_type = 'click') AS matched, count(*) FILTER (event_type = 'purchase') AS mismatched, 0::BIGINT AS not_rebuilt, false AS trusted FROM events")
def judge(t):
    return rec.judge(t.events.select(F.when(F.col("event_type") == "click", "match").when(F.col("event_type") == "purchase", "mismatch").otherwise("other").alias("state")))


@query("move_targets", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 3.0 WHEN 1 THEN s_acctbal + 3.0 WHEN 2 THEN round(s_acctbal + 3 * cos(radians(7)), 4) ELSE round(s_acctbal + 75 * cos(radians(30)), 4) END::DOUBLE AS x FROM supplier")
def move_targets(t):
    kind = F.element_at(F.array(*map(F.lit, ("absolute", "xy", "polar", "hex"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    move = F.struct(kind.alias("kind"), F.lit(3.0).alias("a"), F.lit(7.0).alias("b"))
    s = t.supplier.select("s_suppkey", "s_acctbal", move.alias("m"))
    return s.select("s_suppkey", r(raster.move_target(F.col("s_acctbal"), F.lit(0.0), F.col("m"), 75)["x"]).alias("x"))


@query("decide", """
    WITH m AS (SELECT l_returnflag AS candidate, avg(l_quantity) AS a, avg(l_discount) AS b FROM lineitem GROUP BY 1)
    SELECT candidate, round(0.7 * (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + 0.3 * (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), 6) + 0.0 AS score FROM m""")
def decide(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("candidate"), F.inline(F.array(F.struct(F.lit("a").alias("criterion"), F.col("l_quantity").alias("value")), F.struct(F.lit("b").alias("criterion"), F.col("l_discount").alias("value")))))
    return rec.decide(rows, {"a": 0.7, "b": 0.3}).withColumn("score", r("score", 6))


@query("fastest_engine", "SELECT l_returnflag AS op, l_linenumber AS elements, min_by(l_shipmode, (ms, l_shipmode)) AS engine FROM (SELECT l_returnflag, l_linenumber, l_linestatus AS l_shipmode, avg(l_quantity) AS ms FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2")
def fastest_engine(t):
    g = t.lineitem.groupBy(F.col("l_returnflag").alias("op"), F.col("l_linenumber").alias("elements"), F.col("l_linestatus").alias("engine")).agg(F.avg("l_quantity").alias("ms"))
    return rec.fastest(g)


@query("table_digest")
def table_digest(t):
    return prog.digest(t.nation)


@query("mermaid_program", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def mermaid_program(t):
    catalog = prog.Catalog()
    catalog.register("fn.nation", lambda: t.nation)
    catalog.register("fn.region", lambda: t.region)
    catalog.register("fn.count", lambda a, b: rel.join(a, b, {"left": "n_regionkey", "right": "r_regionkey"}).groupBy("r_name").agg(F.count(F.lit(1)).alias("n")))
    p = prog.compile_mermaid("flowchart TD\n a[fn.nation] --> c[fn.count]\n b[fn.region] --> c", name="m")
    p.run(catalog, parallel=True)
    return catalog.read("px.m.c")


@query("study_plan", "SELECT 'p_size,p_retailprice' AS numbers, '' AS constants, (SELECT count(*) FROM part) AS rows")
def study_plan(t):
    p = auto.plan(t.part.select("p_size", "p_retailprice", "p_brand"))
    return t.spark.createDataFrame([(",".join(p.numbers), ",".join(p.constants), p.rows)], "numbers string, constants string, rows long")


_PAIRS = [("l_extendedprice", "l_quantity"), ("l_extendedprice", "l_tax"), ("l_quantity", "l_tax")]


@query("study_pairs", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem" for a, b in _PAIRS))
def study_pairs(t):
    return auto.pairs(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"], 0.0).select("a", "b", r("r", 6).alias("r"))


@query("study_groups")
def study_groups(t):
    g = auto.compare_groups(t.customer, "c_mktsegment", "c_acctbal")
    return t.spark.createDataFrame([(g["test"], float(g["p"]), float(g["effect"]))], "test string, p double, effect double")


@query("study")
def study(t):
    return auto.study(t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag"), "l_extendedprice")


# sources, rasters, streaming --------------------------------------------------------------------------


@query("pack_roundtrip", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) + 0.0 AS total FROM embeddings")
def pack_roundtrip(t):
    packed = t.embeddings.select("vec_id", readers.pack_column(F.col("embedding").cast("array<double>")).alias("b"))
    return packed.select("vec_id", r(F.aggregate(readers.unpack_column("b"), F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("builtin_tables", "SELECT * FROM (VALUES ('basket', 5::BIGINT), ('gaps', 5), ('trades', 4), ('quotes', 5)) v(name, rows)")
def builtin_tables(t):
    return t.spark.createDataFrame([(n, readers.builtin(t.spark, n).count()) for n in readers.FIXTURES], "name string, rows long")


@query("asof_fixture", "SELECT * FROM (VALUES (1.0, 'x', 9.9), (2.0, 'y', NULL), (3.0, 'x', 9.9), (NULL, 'x', NULL)) v(t, sym, bid)".replace("1.0,", "1.0::DOUBLE,").replace("9.9)", "9.9::DOUBLE)"))
def asof_fixture(t):
    return rel.asof_join(readers.builtin(t.spark, "trades"), readers.builtin(t.spark, "quotes"), "t", ["sym"]).select("t", "sym", "bid")


@query("significant_digits", "SELECT o_orderkey, round(o_totalprice / pow(10, floor(log10(o_totalprice)) - 2)) * pow(10, floor(log10(o_totalprice)) - 2) AS x FROM orders")
def significant_digits(t):
    return t.orders.select("o_orderkey", readers.significant(F.col("o_totalprice"), 3).alias("x"))


@query("synthetic_matrix")
def synthetic_matrix(t):
    return readers.synthetic(t.spark, 20, 3, 5).withColumn("v", r("v", 8))


def _pixels(t):
    return t.lineitem.select((F.col("l_partkey") % 60).cast("int").alias("x"), (F.col("l_suppkey") % 50).cast("int").alias("y"), (F.col("l_quantity") * 5).cast("int").alias("r"), (F.col("l_linenumber") * 30).cast("int").alias("g"), F.lit(60).alias("b")).groupBy("x", "y").agg(F.max("r").alias("r"), F.max("g").alias("g"), F.max("b").alias("b"))


_PIX = "SELECT (l_partkey % 60)::INT AS x, (l_suppkey % 50)::INT AS y, max((l_quantity * 5)::INT) AS r, max((l_linenumber * 30)::INT) AS g, 60 AS b FROM lineitem GROUP BY 1, 2"


@query("raster_gray", f"SELECT x, y, round(0.299 * r + 0.587 * g + 0.114 * b)::INT AS gray FROM ({_PIX})")
def raster_gray(t):
    return _pixels(t).select("x", "y", raster.gray().alias("gray"))


_MASK = f"SELECT x, y FROM ({_PIX}) WHERE greatest(r, g, b) <= 130"


@query("raster_mask", _MASK)
def raster_mask(t):
    return raster.hsv_mask(_pixels(t), "black", value_max=130)


@query("raster_saturation", f"SELECT x, y, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE round_even(255.0 * (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b), 0) END::INT AS s FROM ({_PIX})")
def raster_saturation(t):
    return _pixels(t).select("x", "y", raster.saturation().alias("s"))


@query("raster_crop", f"SELECT x - 10 AS x, y - 5 AS y, r, g, b FROM ({_PIX}) WHERE x BETWEEN 10 AND 40 AND y BETWEEN 5 AND 30")
def raster_crop(t):
    return raster.crop(_pixels(t), 10, 5, 40, 30)


@query("raster_crop_bounds", f"SELECT min(y) AS y0, max(y) AS y1 FROM (SELECT y, stddev_pop(round(0.299 * r + 0.587 * g + 0.114 * b)) AS s FROM ({_PIX}) GROUP BY 1) WHERE s >= 10")
def raster_crop_bounds(t):
    return raster.crop_bounds(_pixels(t), 10.0)


@query("modal", "WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1) SELECT CASE WHEN (SELECT count(*) FROM c WHERE n = (SELECT max(n) FROM c)) = 1 THEN (SELECT p_size FROM c ORDER BY n DESC LIMIT 1) END AS p_size")
def modal(t):
    return raster.modal(t.part, "p_size")


@query("select_components", "WITH b AS (SELECT s_suppkey AS label, 3 + s_suppkey % 9 AS w, 2 + s_suppkey % 6 AS h, s_suppkey % 10 / 10 AS f FROM supplier) SELECT label, concat_ws(';', CASE WHEN w NOT BETWEEN 4 AND 9 THEN 'width outside range' END, CASE WHEN h NOT BETWEEN 3 AND 6 THEN 'height outside range' END, CASE WHEN w / h NOT BETWEEN 0.8 AND 2.5 THEN 'aspect outside range' END, CASE WHEN f < 0.3 THEN 'fill below minimum' END) AS reasons FROM b")
def select_components(t):
    stats = t.supplier.selectExpr("s_suppkey as label", "3 + s_suppkey % 9 as w", "2 + s_suppkey % 6 as h", "s_suppkey % 10 / 10 as fill")
    return raster.select_components(stats, (4, 9), (3, 6), (0.8, 2.5), 0.3).select("label", F.array_join("reasons", ";").alias("reasons"))


@query("place_order", "WITH o AS (SELECT n_name AS entry, n_nationkey + 1 AS place FROM nation WHERE n_nationkey % 2 = 0), t AS (SELECT entry, place FROM o WHERE entry <> 'NATION_4' UNION ALL SELECT 'NATION_4', 1000 WHERE NOT EXISTS (SELECT 1 FROM o WHERE entry = 'NATION_4')) SELECT entry, row_number() OVER (ORDER BY place, entry) AS place FROM t")
def place_order(t):
    return app.place_order(t.nation.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("entry"), (F.col("n_nationkey") + 1).alias("place")), "NATION_4")


@query("cap_status", "SELECT s_nationkey, CASE WHEN count(*) > 4 THEN 'fail' WHEN count(*) = 4 THEN 'pass' ELSE 'pending' END AS status FROM supplier GROUP BY 1")
def cap_status(t):
    return t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("n")).select("s_nationkey", app.cap(F.col("n"), 4).alias("status"))


@query("raster_components", f"""
    WITH RECURSIVE m AS ({_MASK}), e AS (SELECT a.y * 60 + a.x AS a, b.y * 60 + b.x AS b FROM m a JOIN m b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1), w AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.node)
    SELECT root AS label, count(*) AS area FROM (SELECT node, min(root)::BIGINT AS root FROM w GROUP BY 1) GROUP BY 1""")
def raster_components(t):
    return raster.component_stats(raster.label_components(raster.hsv_mask(_pixels(t), "black", value_max=130), 60)).select("label", "area")


@query("raster_remaining", f"WITH m AS ({_MASK}) SELECT x, y FROM ({_PIX}) p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.x = p.x AND m.y = p.y)")
def raster_remaining(t):
    p = _pixels(t)
    return raster.remaining(p.select("x", "y"), raster.owned(raster.hsv_mask(p, "black", value_max=130)))


@query("raster_dilate", f"SELECT DISTINCT x + dx AS x, y + dy AS y FROM ({_MASK}), (SELECT unnest([-1, 0, 1]) AS dx) a, (SELECT unnest([-1, 0, 1]) AS dy) b")
def raster_dilate(t):
    return raster.dilate(raster.hsv_mask(_pixels(t), "black", value_max=130))


def _holes(t):
    """A hole for each supplier."""
    return t.supplier.select(F.col("s_suppkey").alias("number"), (F.col("s_suppkey") * 37 % 100).cast("double").alias("tx"), (F.col("s_suppkey") * 53 % 80).cast("double").alias("ty"), (F.col("s_suppkey") * 11 % 100).cast("double").alias("bx"), (F.col("s_suppkey") * 29 % 80).cast("double").alias("by"))


_HOLES = "SELECT s_suppkey AS number, (s_suppkey * 37 % 100)::DOUBLE AS tx, (s_suppkey * 53 % 80)::DOUBLE AS ty, (s_suppkey * 11 % 100)::DOUBLE AS bx, (s_suppkey * 29 % 80)::DOUBLE AS byy FROM supplier"


@query("hole_geometry", f"SELECT number, round(sqrt((bx - tx) ^ 2 + (byy - ty) ^ 2), 3) + 0.0 AS length, round((degrees(atan2(byy - ty, bx - tx)) + 360) % 360, 3) + 0.0 AS bearing FROM ({_HOLES})")
def hole_geometry(t):
    return raster.hole_geometry(_holes(t)).select("number", r("length", 3).alias("length"), r("bearing", 3).alias("bearing"))


@query("route", f"WITH h AS ({_HOLES}) SELECT number, 'play' AS kind, round(sqrt((bx - tx) ^ 2 + (byy - ty) ^ 2), 3) + 0.0 AS length FROM h UNION ALL SELECT number, 'walk', l FROM (SELECT number, round(sqrt((lead(tx) OVER w - bx) ^ 2 + (lead(ty) OVER w - byy) ^ 2), 3) + 0.0 AS l FROM h WINDOW w AS (ORDER BY number)) WHERE l IS NOT NULL")
def route(t):
    return raster.route(_holes(t)).withColumn("length", r("length", 3))


@query("bind_nearest")
def bind_nearest(t):
    h = _holes(t).select(F.lit("c").alias("course"), "number", F.col("tx").alias("x"), F.col("ty").alias("y"))
    a = _holes(t).select(F.lit("c").alias("course"), F.concat(F.lit("a"), "number").alias("id"), F.col("bx").alias("x"), F.col("by").alias("y"))
    return raster.bind_nearest(h, a)


@query("cast_rays", f"""
    WITH h AS ({_HOLES}), b AS (SELECT number AS box, bx - 4 AS x0, byy - 4 AS y0, bx + 4 AS x1, byy + 4 AS y1 FROM h), p AS (SELECT number AS ray, "at", tx + "at" AS px, ty + 0.5 * "at" AS py FROM h, (SELECT unnest(range(0, 61)) AS "at")),
    m AS (SELECT ray, box, "at"::INT AS "at", row_number() OVER (PARTITION BY ray ORDER BY "at", box) AS k FROM p JOIN b ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1) SELECT ray, box, "at" FROM m WHERE k = 1""")
def cast_rays(t):
    rays = _holes(t).select(F.col("number").alias("ray"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.lit(1.0).alias("dx"), F.lit(0.5).alias("dy"))
    boxes = _holes(t).select(F.col("number").alias("box"), (F.col("bx") - 4).alias("x0"), (F.col("by") - 4).alias("y0"), (F.col("bx") + 4).alias("x1"), (F.col("by") + 4).alias("y1"))
    return raster.cast_rays(rays, boxes, 1.0, 60)


@query("obstacle_cells", f"SELECT x // 8 AS gx, y // 8 AS gy, CASE min(CASE WHEN g > 150 THEN 0 WHEN r > 150 THEN 1 ELSE 2 END) WHEN 0 THEN 'tree' WHEN 1 THEN 'water' ELSE 'open' END AS kind FROM ({_PIX}) GROUP BY 1, 2")
def obstacle_cells(t):
    kind = F.when(F.col("g") > 150, "tree").when(F.col("r") > 150, "water").otherwise("open")
    out = raster.obstacle_cells(_pixels(t).withColumn("kind", kind), 8, ["tree", "water", "open"])
    return out.select(F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy"), "kind")


@query("round_legs")
def round_legs(t):
    cells = t.spark.range(400).select((F.col("id") % 20).alias("x"), (F.col("id") / 20).cast("long").alias("y")).filter("not (x = 10 and y < 15)")
    at = (F.col("n_nationkey") % 20).cast("long")
    legs = t.nation.select(F.col("n_nationkey").cast("long").alias("leg"), at.alias("sx"), F.lit(0).cast("long").alias("sy"), F.lit(19).cast("long").alias("gx"), at.alias("gy"))
    return raster.round_legs(legs, cells).select("leg", "cost", F.size("path").alias("cells"))


@query("conservation", "SELECT true AS balanced")
def conservation(t):
    ledger = raster.account(("kept", t.orders.filter("o_totalprice >= 100000")), ("dropped", t.orders.filter("o_totalprice < 100000")))
    return raster.balanced(ledger, t.orders.agg(F.count(F.lit(1)).alias("n")))


@query("stream_windows", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 2) + 0.0 AS total FROM events GROUP BY 1, 2")
def stream_windows(t):
    """The stream of the events file, run once to its end, gives what the batch gives."""
    import tempfile

    from ..streaming import events as st

    base = t.spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    name = f"windows_{np.random.default_rng().integers(1 << 60)}"
    stream = st.source(t.spark, f"{t.sf_dir}/events.parquet*", t.events.schema)
    out = st.run_once(st.windowed(stream, "1 day"), name, f"{base}/{name}", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", r("total", 2).alias("total"))


@query("row_positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS _pos FROM orders")
def row_positions(t):
    from ..table import with_position

    return with_position(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "_pos")


@query("number_summary", "SELECT round(avg(s_acctbal), 2) + 0.0 AS mean, round(median(s_acctbal), 2) + 0.0 AS median, count(*)::DOUBLE AS n FROM supplier")
def number_summary(t):
    m, d, n = t.supplier.agg(F.avg("s_acctbal"), F.median("s_acctbal"), F.count(F.lit(1))).first()
    return one(t, 2, mean=m, median=d, n=n)


@query("record_cat", "SELECT 'sum' AS id, count(*)::VARCHAR AS data, NULL::VARCHAR AS note FROM (SELECT o_custkey FROM orders WHERE o_totalprice >= 100000 GROUP BY 1) UNION ALL SELECT 'name', NULL, 'no value was kept'")
def record_cat(t):
    catalog, _, run = _program(t)
    record = run.to_df(t.spark)
    values = catalog.read("px.totals").agg(F.count("*").cast("string").alias("data")).select(F.lit("sum").alias("id"), F.lit("px.totals").alias("address"), F.lit("json").alias("kind"), "data", F.lit(None).cast("string").alias("note"))
    return rec.cat(record, values, "px.totals").union(rec.cat(record, values, "px.named"))


@query("record_effects", "SELECT (s_suppkey - 1)::BIGINT AS position, 't' || s_suppkey % 3 AS tick, 'c' || s_suppkey AS id, i AS index, CASE i WHEN 0 THEN 'draw' ELSE 'read' END AS kind, s_name AS what FROM supplier, (SELECT unnest(range(0, 2)) AS i) WHERE i < s_suppkey % 3")
def record_effects(t):
    record = t.supplier.selectExpr("s_suppkey - 1 as position", "concat('t', s_suppkey % 3) as tick", "concat('c', s_suppkey) as id")
    entry = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("s_name").alias("what"), F.sha2("s_name", 256).alias("digest"))
    ledgers = t.supplier.select(F.concat(F.lit("c"), "s_suppkey").alias("id"), F.slice(F.array(entry("draw"), entry("read")), F.lit(1), (F.col("s_suppkey") % 3).cast("int")).alias("entries"))
    return rec.effects(record, ledgers).drop("digest")


@query("delta", """
    WITH s AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'a' ELSE 'b' END AS state, l_linestatus, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
    v AS (SELECT sum(n) FILTER (state = 'a' AND l_linenumber = 1) AS av, sum(n) FILTER (state = 'a' AND l_linenumber = 2) AS ap, sum(n) FILTER (state = 'a' AND l_linenumber > 2) AS ac, sum(n) FILTER (state = 'b' AND l_linenumber = 1) AS bv, sum(n) FILTER (state = 'b' AND l_linenumber = 2) AS bp, sum(n) FILTER (state = 'b' AND l_linenumber > 2) AS bc FROM s)
    SELECT av::BIGINT AS a_verified, ap::BIGINT AS a_points, ac::BIGINT AS a_cost, bv::BIGINT AS b_verified, bp::BIGINT AS b_points, bc::BIGINT AS b_cost, round(av / ac, 4) AS a_ratio, round(bv / bc, 4) AS b_ratio,
        CASE WHEN bv > av OR bv = av AND (bp > ap OR bp = ap AND bc < ac) THEN 'b' WHEN av > bv OR av = bv AND (ap > bp OR ap = bp AND ac < bc) THEN 'a' ELSE 'tie' END AS verdict FROM v""")
def delta(t):
    rows = t.lineitem.filter("l_returnflag <> 'N'").groupBy(F.when(F.col("l_returnflag") == "A", "a").otherwise("b").alias("state"), "l_linenumber").agg(F.count("*").alias("value"))
    kind, name = F.when(F.col("l_linenumber") <= 2, "capability").otherwise("cost"), F.when(F.col("l_linenumber") == 1, "verified").otherwise(F.concat(F.lit("n"), "l_linenumber"))
    return rec.delta(rows.select("state", kind.alias("kind"), name.alias("name"), "value"))


@query("navigate", """
    WITH v AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'oracle' WHEN 1 THEN 'bracket' ELSE 'bench' END AS kind, o_orderstatus AS vertical, o_custkey % 4 <> 0 AS pass, nullif(o_custkey % 5, 0) AS winner FROM orders)
    SELECT kind, vertical, count(*) AS n, count(*) FILTER (kind = 'oracle' AND NOT pass) AS failed, count(*) FILTER (kind = 'bracket' AND winner IS NULL) AS unjudged FROM v GROUP BY 1, 2""")
def navigate(t):
    kind = F.element_at(F.array(*map(F.lit, ("oracle", "bracket", "bench"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return rec.navigate(t.orders.select(F.concat_ws(".", F.lit("px.exp.brain"), kind, "o_orderstatus", "o_orderkey").alias("address"), (F.col("o_custkey") % 4 != 0).alias("pass"), F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("winner")))


@query("mounts", "SELECT * FROM (VALUES ('north', 'Upper', 'px.orders'), ('north', 'Upper', 'px.customer'), ('north', 'Upper', 'px.kept'), ('north', 'Upper', 'px.totals'), ('north', 'Upper', 'px.named'), ('south', NULL, 'px.nation')) v(root, label, address)")
def mounts(t):
    other = prog.Catalog()
    other.write("px.nation", t.nation)
    world = prog.Mounts([("north", _program(t)[0], "Upper"), ("south", other, None)])
    return world.addresses(t.spark).filter("address not like 'px.receipt.%'")


@query("described", "SELECT 'array' AS kind, 5::BIGINT AS entries, true AS whole UNION ALL SELECT 'array', 20, false UNION ALL SELECT 'json', 20, false UNION ALL SELECT 'text', 8, true")
def described(t):
    made = [prog.describe(v, array_cap=20) for v in (t.region, t.nation, list(range(50)), "as it is")]
    return t.spark.createDataFrame([(d["kind"], len(d["data"]), d["note"] is None) for d in made], "kind string, entries long, whole boolean")


@query("study_ran")
def study_ran(t):
    return auto.ran(auto.study(t.supplier.select("s_suppkey", "s_acctbal", "s_nationkey"), "s_acctbal"))
