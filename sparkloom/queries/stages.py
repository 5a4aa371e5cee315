"""Object, recovery, course and card stages over boxes, pixels and legs that are made from the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster
from ..operators import stages as st
from .core import r
from .registry import query


def _boxes(df, key: str, sx: int, sy: int, w: str, h: str):
    return df.selectExpr(f"{key} as id", f"{key} * {sx} % 400 as x0", f"{key} * {sy} % 300 as y0", f"{w} as w", f"{h} as h")


def _small(t):
    return _boxes(t.supplier, "s_suppkey", 37, 53, "3 + s_suppkey % 5", "2 + s_suppkey % 4")


def _large(t):
    return _boxes(t.part, "p_partkey", 17, 29, "9 + p_partkey % 7", "8 + p_partkey % 5")


_S = "s AS (SELECT s_suppkey AS id, s_suppkey * 37 % 400 AS x0, s_suppkey * 53 % 300 AS y0, 3 + s_suppkey % 5 AS w, 2 + s_suppkey % 4 AS h FROM supplier)"
_L = "l AS (SELECT p_partkey AS id, p_partkey * 17 % 400 AS x0, p_partkey * 29 % 300 AS y0, 9 + p_partkey % 7 AS w, 8 + p_partkey % 5 AS h FROM part)"
_MEET = "s.x0 < l.x0 + l.w AND l.x0 < s.x0 + s.w AND s.y0 < l.y0 + l.h AND l.y0 < s.y0 + s.h"
_FRAMED = f"""{_S}, {_L}, f AS (SELECT s.id, l.id AS frame, s.x0 - l.x0 AS "left", s.y0 - l.y0 AS top, l.x0 + l.w - s.x0 - s.w AS "right", l.y0 + l.h - s.y0 - s.h AS bottom,
    row_number() OVER (PARTITION BY s.id ORDER BY l.w * l.h, l.id) AS k FROM s JOIN l ON l.x0 <= s.x0 AND l.y0 <= s.y0 AND l.x0 + l.w >= s.x0 + s.w AND l.y0 + l.h >= s.y0 + s.h)"""


@query("stage_overlaps", f"WITH {_S}, {_L} SELECT s.id AS a, l.id AS b FROM s JOIN l ON {_MEET}")
def overlaps(t):
    return st.overlapping(_small(t), _large(t)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


@query("stage_enclosing", f'WITH {_FRAMED} SELECT s.id, frame, "left", top, "right", bottom FROM s LEFT JOIN f ON f.id = s.id AND k = 1')
def enclosing(t):
    return st.enclosing(_small(t), _large(t))


@query("stage_margins", f"""
    WITH {_S}, l AS (SELECT id, x0 - 1 - (id % 7 = 0)::INT AS x0, y0 - 2 AS y0, w + 3 + (id % 7 = 0)::INT AS w, h + 3 AS h FROM s), f AS (SELECT s.id, s.x0 - l.x0 AS "left", s.y0 - l.y0 AS top, l.x0 + l.w - s.x0 - s.w AS "right", l.y0 + l.h - s.y0 - s.h AS bottom,
        row_number() OVER (PARTITION BY s.id ORDER BY l.w * l.h, l.id) AS k FROM s JOIN l ON l.x0 <= s.x0 AND l.y0 <= s.y0 AND l.x0 + l.w >= s.x0 + s.w AND l.y0 + l.h >= s.y0 + s.h),
    c AS (SELECT "left", top, "right", bottom, count(*) AS n FROM f WHERE k = 1 GROUP BY 1, 2, 3, 4) SELECT "left", top, "right", bottom FROM c WHERE n = (SELECT max(n) FROM c) AND (SELECT count(*) FROM c WHERE n = (SELECT max(n) FROM c)) = 1""")
def margins(t):
    s = _small(t)
    wide = F.when(F.col("id") % 7 == 0, 1).otherwise(0)
    frames = s.select("id", (F.col("x0") - 1 - wide).alias("x0"), (F.col("y0") - 2).alias("y0"), (F.col("w") + 3 + wide).alias("w"), (F.col("h") + 3).alias("h"))
    return st.learn_margins(st.enclosing(s, frames))


_DARK = "d AS (SELECT DISTINCT l_partkey % 80 AS x, l_suppkey % 70 AS y FROM lineitem WHERE (l_partkey % 80 + l_suppkey % 70) % 3 <> 0)"


@query("stage_shell_family", f"""
    WITH {_DARK}, b AS (SELECT s_suppkey AS id, 3 * (s_suppkey % 20) AS x0, 3 * (s_suppkey % 17) - 1 AS y0, 7 AS w, 7 AS h FROM supplier),
    p AS (SELECT b.id, d.x, d.y, d.x - x0 AS ox, d.y - y0 AS oy FROM b JOIN d ON d.x BETWEEN x0 AND x0 + w - 1 AND d.y BETWEEN y0 AND y0 + h - 1),
    c AS (SELECT ox, oy FROM p GROUP BY 1, 2 HAVING count(*) >= ceil(0.75 * (SELECT count(*) FROM b))) SELECT id, x, y FROM p JOIN c USING (ox, oy)""")
def shell(t):
    dark = t.lineitem.selectExpr("l_partkey % 80 as x", "l_suppkey % 70 as y").filter("(x + y) % 3 <> 0").distinct()
    bodies = t.supplier.selectExpr("s_suppkey as id", "3 * (s_suppkey % 20) + 1 as x0", "3 * (s_suppkey % 17) as y0", "5 as w", "5 as h")
    one = t.spark.sql('select 1 as left, 1 as top, 1 as right, 1 as bottom')
    return st.shell_family(bodies, dark, one)


@query("stage_family", """
    WITH m AS (SELECT s_suppkey AS id, 5 + s_suppkey % 9 AS major, 3 + s_suppkey % 4 AS minor, (5 + s_suppkey % 9) * (3 + s_suppkey % 4) AS area FROM supplier),
    g AS (SELECT s.id AS seed, c.*, abs(ln(c.major) - ln(s.major)) AS a, abs(ln(c.minor) - ln(s.minor)) AS b, abs(ln(c.area) - ln(s.area)) AS d FROM m s, m c),
    n AS (SELECT * FROM g WHERE a <= ln(1.3) AND b <= ln(1.5) AND d <= ln(1.7)), f AS (SELECT seed FROM n GROUP BY 1 ORDER BY count(*) DESC, round(sum(a + b + d), 9), seed LIMIT 1)
    SELECT id, major, minor, area FROM n WHERE seed = (SELECT seed FROM f)""")
def family(t):
    rows = t.supplier.selectExpr("s_suppkey as id", "5 + s_suppkey % 9 as major", "3 + s_suppkey % 4 as minor").withColumn("area", F.col("major") * F.col("minor"))
    return st.select_family(rows, {"major": 1.3, "minor": 1.5, "area": 1.7})


@query("stage_assemble", """
    WITH b AS (SELECT s_nationkey AS plate, s_suppkey AS border FROM supplier WHERE s_suppkey % 3 = 0), d AS (SELECT s_nationkey AS plate, s_suppkey AS digit FROM supplier WHERE s_suppkey % 2 = 0),
    o AS (SELECT s_nationkey AS plate, s_suppkey AS digit, s_suppkey * 10 AS loop FROM supplier WHERE s_suppkey % 4 = 0), x AS (SELECT n_nationkey AS plate, border FROM nation LEFT JOIN b ON b.plate = n_nationkey)
    SELECT plate, border, (SELECT coalesce(string_agg(digit, ',' ORDER BY digit), '') FROM d WHERE d.plate = x.plate AND d.digit IS DISTINCT FROM x.border) AS digits,
        (SELECT coalesce(string_agg(loop, ',' ORDER BY loop), '') FROM o WHERE o.plate = x.plate AND o.digit IS DISTINCT FROM x.border AND EXISTS (SELECT 1 FROM d WHERE d.plate = x.plate AND d.digit = o.digit)) AS loops,
        CASE WHEN border IS NULL THEN 'no enclosing white border' WHEN NOT EXISTS (SELECT 1 FROM d WHERE d.plate = x.plate) THEN 'no contained white digit material' WHEN NOT EXISTS (SELECT 1 FROM d WHERE d.plate = x.plate AND d.digit <> x.border) THEN 'border leaves no separate digit material' END AS reason FROM x""")
def assemble(t):
    s = t.supplier.select(F.col("s_nationkey").alias("plate"), F.col("s_suppkey").alias("k"))
    digits = s.filter("k % 2 = 0").withColumnRenamed("k", "digit")
    out = st.assemble(t.nation.select(F.col("n_nationkey").alias("plate")), s.filter("k % 3 = 0").withColumnRenamed("k", "border"), digits, s.filter("k % 4 = 0").select("plate", F.col("k").alias("digit"), (F.col("k") * 10).alias("loop")))
    return out.select("plate", "border", F.array_join("digits", ",").alias("digits"), F.array_join("loops", ",").alias("loops"), "reason")


_GRID = """g AS (SELECT n_nationkey AS id, i, least(5 + n_nationkey % 4 - 1, (i % 6) * (5 + n_nationkey % 4) // 6) AS x, least(6, (i // 6) * 7 // 8) AS y FROM nation, (SELECT unnest(range(0, 48)) AS i)),
    p AS (SELECT DISTINCT c_nationkey AS id, c_custkey % 9 AS x, c_custkey % 7 AS y FROM customer WHERE c_custkey % 5 < 3), c AS (SELECT g.id, g.i, (p.id IS NOT NULL)::INT AS v FROM g LEFT JOIN p ON p.id = g.id AND p.x = g.x AND p.y = g.y)"""


def _glyphs(t):
    objects = t.nation.selectExpr("n_nationkey as id", "0 as x0", "0 as y0", "5 + n_nationkey % 4 as w", "7 as h")
    lit = t.customer.filter("c_custkey % 5 < 3").selectExpr("c_nationkey as id", "c_custkey % 9 as x", "c_custkey % 7 as y")
    return st.glyph_grids(objects, lit, 6, 8)


@query("stage_glyph_grids", f"WITH {_GRID} SELECT id, i, v FROM c")
def glyph_grids(t):
    return _glyphs(t)


@query("stage_read_digits", f"""
    WITH {_GRID}, k AS (SELECT d, i, ((d * 7 + i * 3) % 5 < 2)::INT AS v FROM (SELECT unnest(range(0, 10)) AS d), (SELECT unnest(range(0, 48)) AS i)),
    a AS (SELECT c.id, d, avg((c.v = k.v)::INT) AS s FROM c JOIN k USING (i) GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, d) AS n FROM a)
    SELECT a.id AS glyph, a.d::INT AS best, round(a.s, 6) + 0.0 AS score, round(a.s - b.s, 6) + 0.0 AS margin FROM n a JOIN n b ON a.id = b.id AND a.n = 1 AND b.n = 2""")
def read_digits(t):
    templates = t.spark.range(480).selectExpr("int(id / 48) as digit", "int(id % 48) as i").withColumn("v", ((F.col("digit") * 7 + F.col("i") * 3) % 5 < 2).cast("int"))
    out = raster.match_templates(_glyphs(t).withColumnRenamed("id", "glyph"), templates)
    return out.select("glyph", "best", r("score", 6).alias("score"), r("margin", 6).alias("margin"))


def _candidates(t):
    return _small(t).withColumn("area", F.expr("w * h - id % 3")).withColumn("glyph", F.expr("id % 10 / 10"))


def _clean(t):
    return t.nation.selectExpr("n_nationkey as id", "n_nationkey * 31 % 400 as x0", "n_nationkey * 41 % 300 as y0", "20 as w", "20 as h")


def _recovered(t):
    return st.recover(_candidates(t), _clean(t), st.plate_rules((3, 6), (2, 4), (0.8, 2.5), 0.8, (0.1, 0.7)))


_WHY = f"""{_S}, c AS (SELECT n_nationkey * 31 % 400 AS x0, n_nationkey * 41 % 300 AS y0, 20 AS w, 20 AS h FROM nation),
    j AS (SELECT *, concat_ws(';', CASE WHEN w NOT BETWEEN 3 AND 6 THEN 'plate width' END, CASE WHEN h NOT BETWEEN 2 AND 4 THEN 'plate height' END, CASE WHEN w / h NOT BETWEEN 0.8 AND 2.5 THEN 'plate aspect' END,
        CASE WHEN (w * h - id % 3) / (w * h) < 0.8 THEN 'plate fill' END, CASE WHEN id % 10 / 10 NOT BETWEEN 0.1 AND 0.7 THEN 'glyph fraction' END,
        CASE WHEN EXISTS (SELECT 1 FROM c AS l WHERE {_MEET}) THEN 'a clean object is already here' END) AS why FROM s)"""


@query("stage_recover", f"WITH {_WHY} SELECT id, why FROM j")
def recover(t):
    return _recovered(t).select("id", F.array_join("why", ";").alias("why"))


@query("stage_recovery_ledger", f"WITH {_WHY} SELECT 'badge' AS kind, (SELECT count(*) FROM c) AS clean, count(*) FILTER (why = '') AS recovered, (SELECT count(*) FROM c) + count(*) FILTER (why = '') AS total, count(*) FILTER (why <> '') AS rejected FROM j")
def recovery_ledger(t):
    return st.recovery_ledger(_clean(t).withColumn("kind", F.lit("badge")), _recovered(t).withColumn("kind", F.lit("badge")))


@query("stage_check_recovery", "SELECT true AS clean_survives, true AS only_adds, count(*) = 0 AS ids_unique, count(*) = 0 AS balanced FROM (SELECT 1 FROM nation GROUP BY n_nationkey HAVING count(*) > 1)")
def check_recovery(t):
    kind = F.lit("badge").alias("kind")
    clean, judged = _clean(t).select("*", kind), _recovered(t).select((F.col("id") + 1_000_000).alias("id"), "x0", "y0", "w", "h", "why", kind)
    box = ["kind", "id", "x0", "y0", "w", "h"]
    return st.check_recovery(clean, judged, clean.select(*box).union(judged.filter("size(why) = 0").select(*box)))


@query("stage_pointing", f"""
    WITH {_DARK}, n AS (SELECT n_nationkey AS id, n_nationkey % 8 * 9 AS x0, n_nationkey % 6 * 8 AS y0, radians(n_nationkey * 15) AS a FROM nation),
    m AS (SELECT id, avg(x) AS mx, avg(y) AS my FROM n JOIN d ON x BETWEEN x0 AND x0 + 6 AND y BETWEEN y0 AND y0 + 4 GROUP BY 1),
    l AS (SELECT n.id, a, (mx - x0 - 3.1) * cos(a) + (my - y0 - 2.2) * sin(a) AS lean FROM n LEFT JOIN m USING (id))
    SELECT id, round(lean, 5) + 0.0 AS lean, CASE WHEN abs(lean) >= 0.05 THEN round(sign(lean) * cos(a), 5) + 0.0 END AS px, CASE WHEN abs(lean) >= 0.05 THEN round(sign(lean) * sin(a), 5) + 0.0 END AS py FROM l""")
def pointing(t):
    bright = t.lineitem.selectExpr("l_partkey % 80 as x", "l_suppkey % 70 as y").filter("(x + y) % 3 <> 0").distinct()
    tees = t.nation.selectExpr("n_nationkey as id", "n_nationkey % 8 * 9 as x0", "n_nationkey % 6 * 8 as y0", "7 as w", "5 as h").withColumns({"x": F.col("x0") + F.lit(3.1), "y": F.col("y0") + F.lit(2.2), "angle": F.radians(F.col("id") * 15)})
    return st.pointing(tees, bright, 0.05).select("id", r("lean", 5).alias("lean"), r("px", 5).alias("px"), r("py", 5).alias("py"))


@query("stage_check_rays", "WITH v AS (SELECT s_suppkey AS tee, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 90 END AS badge FROM supplier) SELECT true AS tees_once, count(badge) = count(DISTINCT badge) AS badges_once, (SELECT count(*) FROM supplier) = count(badge) + (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT badge FROM v WHERE badge IS NOT NULL)) AS badges_listed, true AS distances, true AS reasons, count(badge) = count(DISTINCT badge) AND (SELECT count(*) FROM supplier) = count(badge) + (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT badge FROM v WHERE badge IS NOT NULL)) AS balanced FROM v")
def check_rays(t):
    rays = t.supplier.selectExpr("s_suppkey as tee", "if(s_suppkey % 4 <> 0, s_suppkey % 90, null) as badge", "1.0D as distance", "if(s_suppkey % 4 = 0, 'no badge on the ray', null) as why")
    return st.check_rays(rays, t.supplier.select(F.col("s_suppkey").alias("tee")), t.supplier.select(F.col("s_suppkey").alias("badge")))


@query("stage_check_straight", "SELECT true AS badges_once, true AS tees_once, count(*) = count(DISTINCT s_nationkey) AS baskets_once, true AS on_a_line, true AS beyond, true AS explained, count(*) = count(DISTINCT s_nationkey) AS balanced FROM supplier WHERE s_suppkey % 3 <> 0")
def check_straight(t):
    holes = t.supplier.filter("s_suppkey % 3 <> 0").selectExpr("s_suppkey as badge", "s_suppkey as tee", "s_nationkey as basket", "s_suppkey % 4 as residual", "10 as to_badge", "11 + s_suppkey % 5 as to_basket")
    return st.check_straight(holes, t.supplier.filter("s_suppkey % 3 = 0").selectExpr("s_suppkey as badge", "'its ray found no basket' as why"), 4)


@query("stage_confidence", "SELECT s_suppkey AS number, 0.5 + CASE WHEN s_suppkey % 2 = 0 THEN 0.25 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 0.25::DOUBLE ELSE 0 END AS confidence FROM supplier")
def confidence(t):
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("number"), st.confidence(F.when(k % 2 == 0, k), F.when(k % 3 == 0, k)).alias("confidence"))


@query("stage_anchors", f"WITH {_S}, {_L} SELECT 'tee' AS kind, id::VARCHAR AS id, x0 + w / 2 AS x, y0 + h / 2 AS y FROM s UNION ALL SELECT 'basket', id::VARCHAR, x0 + w / 2, y0 + h / 2 FROM l")
def anchors(t):
    return st.anchors(tee=_small(t), basket=_large(t))


_LEGS = "e AS (SELECT s_suppkey AS leg, s_suppkey % 25 AS course, (s_suppkey * 37 % 400)::DOUBLE AS ax, (s_suppkey * 53 % 300)::DOUBLE AS ay, (s_suppkey * 11 % 400)::DOUBLE AS bx, (s_suppkey * 29 % 300)::DOUBLE AS byy FROM supplier)"
_CROSSED = f"""{_LEGS}, k AS (SELECT *, greatest(1, ceil(sqrt((bx - ax) ^ 2 + (byy - ay) ^ 2) / 4.0))::INT AS n FROM e), v AS (SELECT *, unnest(range(0, n + 1)) AS i FROM k),
    w AS (SELECT DISTINCT leg, floor(least(399.0, greatest(0.0, ax + (bx - ax) * i / n)) / 8)::BIGINT AS gx, floor(least(299.0, greatest(0.0, ay + (byy - ay) * i / n)) / 8)::BIGINT AS gy FROM v),
    x AS (SELECT leg, count(*) FILTER ((gx * 3 + gy * 5) % 23 = 0) AS crossed FROM w GROUP BY 1)"""
_ROUND = f"""{_CROSSED}, r AS (SELECT e.leg, course, round(sqrt((bx - ax) ^ 2 + (byy - ay) ^ 2), 3) + 0.0 AS straight, crossed, CASE WHEN e.leg % 9 <> 0 THEN round(sqrt((bx - ax) ^ 2 + (byy - ay) ^ 2) + 4 * crossed, 3) + 0.0 END AS length FROM e JOIN x USING (leg))"""


def _legs(t):
    k = "s_suppkey"
    return t.supplier.selectExpr(f"{k} as leg", f"{k} % 25 as course", f"double({k} * 37 % 400) as ax", f"double({k} * 53 % 300) as ay", f"double({k} * 11 % 400) as bx", f"double({k} * 29 % 300) as by")


def _walked(t):
    grid = t.spark.range(50 * 38).selectExpr("id % 50 as gx", "int(id / 50) as gy").withColumn("kind", F.when((F.col("gx") * 3 + F.col("gy") * 5) % 23 == 0, "tree").otherwise("open"))
    legs = st.crossed(_legs(t), st.walkable(grid, ["tree"]), 8, 400, 300)
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return legs.withColumn("straight", F.round(length, 3)).withColumn("length", F.when(F.col("leg") % 9 != 0, F.round(length + 4 * F.col("crossed"), 3)))


@query("stage_blocked_legs", f"WITH {_CROSSED} SELECT leg, crossed, crossed > 0 AS blocked FROM x")
def blocked_legs(t):
    return _walked(t).select("leg", "crossed", "blocked")


@query("stage_settle", f"WITH {_LEGS}, q AS (SELECT course, leg % 2 = 0 AS play, sqrt((bx - ax) ^ 2 + (byy - ay) ^ 2) AS l FROM e) SELECT course, round(coalesce(sum(l) FILTER (play), 0), 3) + 0.0 AS play, round(coalesce(sum(l) FILTER (NOT play), 0), 3) + 0.0 AS walk, round(sum(l), 3) + 0.0 AS total FROM q GROUP BY 1")
def settle(t):
    legs = _legs(t).select("course", F.when(F.col("leg") % 2 == 0, "play").otherwise("walk").alias("kind"), F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("length"))
    return st.settle(legs, "course")


@query("stage_course_summary", f"WITH {_ROUND} SELECT count(*) AS holes, round(sum(straight), 3) + 0.0 AS length, arg_max(leg, (straight, -leg)) AS longest, count(*) FILTER (crossed > 0) AS blocked FROM r")
def course_summary(t):
    w = _walked(t)
    return st.course_summary(w.select(F.col("leg").alias("number"), F.col("straight").alias("length")), w)


@query("stage_round_summary", f"WITH {_ROUND} SELECT count(*) AS legs, count(length) AS walked, round(sum(length), 3) + 0.0 AS length, round(sum(straight) FILTER (length IS NOT NULL), 3) + 0.0 AS straight, count(*) FILTER (length IS NOT NULL AND crossed > 0) AS bent, round(sum(length) - sum(straight) FILTER (length IS NOT NULL), 3) + 0.0 AS detour FROM r")
def round_summary(t):
    return st.round_summary(_walked(t))


@query("stage_compare_straight", f"WITH {_ROUND}, s AS (SELECT leg, CASE WHEN leg % 4 = 0 THEN straight + 1 ELSE straight END AS straight, length, crossed FROM r) SELECT leg, straight, length, round(length - straight, 3) + 0.0 AS delta, round(length / greatest(1e-9, straight), 3) + 0.0 AS ratio, crossed FROM s")
def compare_straight(t):
    w = _walked(t)
    return st.compare_with_straight(w, w.filter("leg % 4 = 0").select("leg", (F.col("straight") + 1).alias("length")))


_TOKENS = ["fill", "edge"]
_PRESETS = "p AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS fill, CASE WHEN n_nationkey % 4 = 0 THEN 'thin' END AS edge FROM nation)"


def _presets(t):
    return t.nation.selectExpr("n_nationkey as id", "if(n_nationkey % 3 = 0, n_name, null) as fill", "if(n_nationkey % 4 = 0, 'thin', null) as edge")


def _instances(t):
    layer = lambda n: F.expr(f"case s_suppkey % {n} when 0 then 'instance' when 1 then 'preset' else 'global' end")
    return t.supplier.select(F.lit("shelf").alias("projection"), F.col("s_suppkey").cast("string").alias("disc"), F.create_map(F.lit("fill"), layer(3), F.lit("edge"), layer(5)).alias("provenance"))


@query("cards_overrides", f"WITH {_PRESETS} SELECT 'preset' AS layer, id::VARCHAR AS owner, 'fill' AS token, fill AS value FROM p WHERE fill IS NOT NULL UNION ALL SELECT 'preset', id::VARCHAR, 'edge', edge FROM p WHERE edge IS NOT NULL UNION ALL SELECT 'instance', 'shelf.' || s_suppkey, 'fill', s_name FROM supplier WHERE s_suppkey % 3 = 0")
def cards_overrides(t):
    own = t.supplier.filter("s_suppkey % 3 = 0").selectExpr("'shelf' as projection", "string(s_suppkey) as disc", "'fill' as token", "s_name as value")
    return st.cards_overrides(_presets(t), own, _TOKENS)


@query("cards_inherits", f"WITH {_PRESETS} SELECT 'preset' AS kind, id::VARCHAR AS owner FROM p WHERE edge IS NULL UNION ALL SELECT 'instance', 'shelf.' || s_suppkey FROM supplier WHERE s_suppkey % 5 > 1")
def cards_inherits(t):
    return st.cards_inherits(_presets(t), _instances(t), "edge")


@query("cards_provenance", "SELECT 'fill' AS token, CASE (SELECT max(s_suppkey) FROM supplier) % 3 WHEN 0 THEN 'instance' WHEN 1 THEN 'preset' ELSE 'global' END AS layer UNION ALL SELECT 'edge', CASE (SELECT max(s_suppkey) FROM supplier) % 5 WHEN 0 THEN 'instance' WHEN 1 THEN 'preset' ELSE 'global' END")
def cards_provenance(t):
    last = t.supplier.agg(F.max("s_suppkey")).first()[0]
    return st.cards_provenance(_instances(t), "shelf", str(last))
