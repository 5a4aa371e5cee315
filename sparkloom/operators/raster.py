"""Rasters and courses as relations: pixels (x, y, r, g, b), masks (x, y), components (x, y, label), anchors (id, x, y)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components


def gray(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return F.round(0.299 * F.col(r) + 0.587 * F.col(g) + 0.114 * F.col(b)).cast("int")


def saturation() -> Column:
    """255 * (max - min) / max of the channels."""
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    return F.when(high == 0, 0).otherwise(F.bround(255.0 * (high - low) / high)).cast("int")


def hsv_mask(pixels: DataFrame, polarity: str, value_max: int = 0, value_min: int = 255, saturation_max: int = 255) -> DataFrame:
    """(x, y) of dark pixels (value at most value_max) or bright ones (value and saturation within their bounds)."""
    v = F.greatest("r", "g", "b")
    return pixels.filter(v <= value_max if polarity == "black" else (v >= value_min) & (saturation() <= saturation_max)).select("x", "y")


def crop_bounds(pixels: DataFrame, least: float) -> DataFrame:
    """(y0, y1) of the rows whose gray values spread at least that much."""
    return pixels.groupBy("y").agg(F.stddev_pop(gray()).alias("s")).filter(F.col("s") >= least).agg(F.min("y").alias("y0"), F.max("y").alias("y1"))


def crop(pixels: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    return pixels.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).select((F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"), *(c for c in pixels.columns if c not in "xy"))


def label_components(mask: DataFrame, width: int) -> DataFrame:
    """(x, y, label): 8-connected components; label is the least pixel number y * width + x of the component."""
    p = mask.select("x", "y", (F.col("y") * width + F.col("x")).cast("long").alias("id"))
    around = F.explode(F.array(*(F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in ((1, 0), (-1, 1), (0, 1), (1, 1)))))
    edges = p.select(F.col("id").alias("a"), around.alias("n")).select("a", "n.x", "n.y").join(p.select("x", "y", F.col("id").alias("b")), ["x", "y"]).select("a", "b")
    label = components(edges, p.select(F.col("id").alias("node")))
    return p.join(label, F.col("id") == F.col("node")).select("x", "y", F.col("component").alias("label"))


def component_stats(labelled: DataFrame) -> DataFrame:
    """label, area, box, fill, centre, main axis (length ratio and angle) of each component."""
    g = labelled.groupBy("label").agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        F.var_pop("x").alias("xx"), F.covar_pop(F.col("x").cast("double"), F.col("y").cast("double")).alias("xy"), F.var_pop("y").alias("yy"),
    )
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    mid, gap = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, 2) + F.pow("xy", 2))
    g = g.withColumn("w", w).withColumn("h", h).withColumn("fill", F.col("area") / (w * h))
    return g.withColumn("major", mid + gap).withColumn("minor", mid - gap).withColumn("angle", 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))).drop("xx", "xy", "yy")


def select_components(stats: DataFrame, width: tuple, height: tuple, aspect: tuple, fill: float) -> DataFrame:
    """Adds reasons: why a component isn't taken; empty for those that are."""
    a = F.col("w") / F.col("h")
    reasons = F.array_compact(F.array(
        F.when(~F.col("w").between(*width), "width outside range"), F.when(~F.col("h").between(*height), "height outside range"), F.when(~a.between(*aspect), "aspect outside range"), F.when(F.col("fill") < fill, "fill below minimum")))
    return stats.withColumn("reasons", reasons)


def owned(parts: DataFrame) -> DataFrame:
    """Pixels that any part owns, each once."""
    return parts.select("x", "y").distinct()


def remaining(universe: DataFrame, *taken: DataFrame) -> DataFrame:
    for t in taken:
        universe = universe.join(t.select("x", "y").distinct(), ["x", "y"], "left_anti")
    return universe


def dilate(mask: DataFrame) -> DataFrame:
    around = F.explode(F.array(*(F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    return mask.select(around.alias("n")).select("n.*").distinct()


def holes(mask: DataFrame, width: int, height: int) -> DataFrame:
    """(x, y, label) of background components that don't touch the border."""
    spark = mask.sparkSession
    grid = spark.range(width * height).select(F.pmod("id", F.lit(width)).cast("int").alias("x"), (F.col("id") / width).cast("int").alias("y"))
    back = label_components(remaining(grid, mask), width)
    edge = back.filter((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)).select("label").distinct()
    return back.join(edge, "label", "left_anti")


def match_templates(cells: DataFrame, templates: DataFrame) -> DataFrame:
    """(glyph, best, score, margin): cells (glyph, i, v) against templates (digit, i, v) by the share of equal cells; templates are ten grids."""
    agree = cells.join(F.broadcast(templates.withColumnRenamed("v", "tv")), "i").groupBy("glyph", "digit").agg(F.avg((F.col("v") == F.col("tv")).cast("double")).alias("s"))
    top = agree.withColumn("n", F.row_number().over(Window.partitionBy("glyph").orderBy(F.desc("s"), "digit"))).filter("n <= 2").groupBy("glyph")
    return top.agg(F.max_by("digit", -F.col("n")).alias("best"), F.max("s").alias("score"), (F.max("s") - F.coalesce(F.max(F.when(F.col("n") == 2, F.col("s"))), F.lit(0.0))).alias("margin"))


def modal(df: DataFrame, column: str) -> DataFrame:
    """The most common value; null where two share the lead."""
    g = df.groupBy(column).count().orderBy(F.desc("count"), column).limit(2).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), F.col(column).alias("v")))).alias("a"))
    return g.select(F.when((F.size("a") == 1) | (F.col("a")[0]["k"] < F.get("a", F.lit(1))["k"]), F.col("a")[0]["v"]).alias(column))


def bind_nearest(holes_: DataFrame, anchors: DataFrame, course: str = "course") -> DataFrame:
    """(course, number, anchor, gap): hole by hole in order, the nearest anchor that none took; ties by id. Sequential, so a task per course."""

    def run(key, h: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        free, out = {r.id: (r.x, r.y) for r in a.itertuples()}, []
        for r in h.sort_values(["number", "y", "x"]).itertuples():
            best = min(((math.hypot(x - r.x, y - r.y), i) for i, (x, y) in free.items()), default=None)
            if best:
                del free[best[1]]
            out.append((key[0], r.number, best[1] if best else None, round(best[0], 3) if best else None))
        return pd.DataFrame(out, columns=[course, "number", "anchor", "gap"])

    kind = holes_.schema[course].dataType.simpleString()
    return holes_.groupBy(course).cogroup(anchors.groupBy(course)).applyInPandas(run, f"{course} {kind}, number long, anchor string, gap double")


def cast_rays(rays: DataFrame, boxes: DataFrame, step: float, steps: int) -> DataFrame:
    """(ray, box, at): the first box that each ray (ray, x, y, dx, dy) enters within so many steps, the least of several; boxes are (box, x0, y0, x1, y1).

    Equal rays are cast once and of equal boxes the least counts. A grid turns the test into an equi-join: a box is listed in each
    cell that it covers, the point in its own. The cell's side follows from the boxes, so that they are listed seven times on average at most.
    """
    line, sides = ["x", "y", "dx", "dy"], ["x0", "y0", "x1", "y1"]
    p = rays.select(*line).distinct().select(*line, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("at"))
    p = p.select(*line, "at", (F.col("x") + F.col("dx") * F.col("at") * step).alias("px"), (F.col("y") + F.col("dy") * F.col("at") * step).alias("py")).filter("abs(px) < double('inf') and abs(py) < double('inf')")
    reach = p.agg(F.min("px").alias("l"), F.max("px").alias("r"), F.min("py").alias("b"), F.max("py").alias("t")).first()
    cut = {"x0": F.greatest("x0", F.lit(reach["l"])), "y0": F.greatest("y0", F.lit(reach["b"])), "x1": F.least("x1", F.lit(reach["r"])), "y1": F.least("y1", F.lit(reach["t"]))}
    b = boxes.na.drop(subset=sides).groupBy(*sides).agg(F.min(F.struct("box")).alias("box")).select(*sides, "box.box")
    b = b.withColumns({f"c{k}": v.cast("double") for k, v in cut.items()}).filter("cx0 <= cx1 and cy0 <= cy1")
    w, h = F.col("cx1") - F.col("cx0"), F.col("cy1") - F.col("cy0")
    area, girth = b.agg(F.avg(w * h), F.avg(w + h)).first()
    side = max(math.sqrt(area or 0), girth or 0) or 1.0
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / side), F.floor(F.col(hi) / side)))
    b = b.withColumn("gx", cells("cx0", "cx1")).withColumn("gy", cells("cy0", "cy1"))
    p = p.withColumn("gx", F.floor(F.col("px") / side)).withColumn("gy", F.floor(F.col("py") / side))
    hit = p.join(b, ["gx", "gy"]).filter(F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1")))
    first = hit.groupBy(*line).agg(F.min(F.struct("at", "box")).alias("h"))
    return rays.select("ray", *line).join(first, line).groupBy("ray").agg(F.min("h").alias("h")).select("ray", "h.box", "h.at")


def hole_geometry(df: DataFrame) -> DataFrame:
    """Adds dx, dy, length and bearing of (tx, ty) to (bx, by)."""
    out = df.withColumn("dx", F.col("bx") - F.col("tx")).withColumn("dy", F.col("by") - F.col("ty"))
    return out.withColumn("length", F.round(F.hypot("dx", "dy"), 3)).withColumn("bearing", F.round(F.pmod(F.degrees(F.atan2("dy", "dx")) + 360, F.lit(360.0)), 3))


def route(df: DataFrame, number: str = "number", course: Sequence[str] = ()) -> DataFrame:
    """(number, kind, length): the play of each hole and the walk to the next tee."""
    w = Window.partitionBy(*course).orderBy(number)
    walk = F.hypot(F.lead("tx").over(w) - F.col("bx"), F.lead("ty").over(w) - F.col("by"))
    legs = df.withColumn("legs", F.array(F.struct(F.lit("play").alias("kind"), F.hypot(F.col("bx") - F.col("tx"), F.col("by") - F.col("ty")).alias("length")), F.struct(F.lit("walk").alias("kind"), walk.alias("length"))))
    return legs.select(*course, number, F.inline("legs")).filter(F.col("length").isNotNull())


def obstacle_cells(pixels: DataFrame, cell: int, priority: Sequence[str]) -> DataFrame:
    """(gx, gy, kind): the class of first priority among a cell's pixels (x, y, kind)."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(priority)), F.lit(len(priority)))
    g = pixels.groupBy(F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy")).agg(F.min_by("kind", rank).alias("kind"))
    return g


def shortest_path(walkable: set[tuple[int, int]], start: tuple[int, int], goal: tuple[int, int]) -> tuple[list[tuple[int, int]], int] | None:
    """A* in eight directions: 10 straight, 14 across, no corner cut; ties by cost, way so far, then place."""
    if start not in walkable or goal not in walkable:
        return None
    ahead = lambda p: 10 * max(d := (abs(p[0] - goal[0]), abs(p[1] - goal[1]))) + 4 * min(d)
    queue, best, back, closed = [(ahead(start), 0, start[1], start[0])], {start: 0}, {}, set()
    while queue:
        _, g, y, x = heapq.heappop(queue)
        p = (x, y)
        if p in closed:
            continue
        if p == goal:
            path = [p]
            while path[-1] in back:
                path.append(back[path[-1]])
            return path[::-1], g
        closed.add(p)
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                q = (x + a, y + b)
                if (a or b) and q in walkable and not (a and b and ((x + a, y) not in walkable or (x, y + b) not in walkable)):
                    cost = g + (14 if a and b else 10)
                    if cost < best.get(q, 1 << 60):
                        best[q], back[q] = cost, p
                        heapq.heappush(queue, (cost + ahead(q), cost, q[1], q[0]))
    return None


def round_legs(legs: DataFrame, cells: DataFrame) -> DataFrame:
    """(leg, cost, path): one search per leg (leg, sx, sy, gx, gy) over walkable cells (x, y); the grid of a course is small and counted."""
    rows = cells.select("x", "y").limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("more than a million cells")
    held = legs.sparkSession.sparkContext.broadcast({(r["x"], r["y"]) for r in rows})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            found = shortest_path(held.value, (r.sx, r.sy), (r.gx, r.gy))
            out.append((r.leg, found[1] if found else None, [list(p) for p in found[0]] if found else None))
        return pd.DataFrame(out, columns=["leg", "cost", "path"])

    return legs.groupBy("leg").applyInPandas(run, "leg long, cost double, path array<array<long>>")


def account(*doors: tuple[str, DataFrame]) -> DataFrame:
    """(door, n): by which door things left."""
    out = None
    for name, df in doors:
        row = df.agg(F.lit(name).alias("door"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.union(row)
    return out


def balanced(ledger: DataFrame, total: DataFrame) -> DataFrame:
    """Whether the doors account for every thing of `total` (n)."""
    return ledger.agg(F.sum("n").alias("left")).crossJoin(total).select((F.col("left") == F.col("n")).alias("balanced"))  # one row each


#: Degrees of the six hex moves, numbered from 1 (fixed values).
HEX_DEGREES = [270, 330, 30, 90, 150, 210]
#: The same moves in lattice coordinates: the first axis at 30 degrees, the second at 90.
_HEX_STEPS = [(0, -1), (1, -1), (1, 0), (0, 1), (-1, 1), (-1, 0)]


def move_target(x: Column, y: Column, move: Column, radius: float) -> Column:
    """Where a move (kind, a, b) leads: absolute (a, b), xy by (a, b), polar (distance a, degrees b) or hex (number a)."""
    number = F.when(move["kind"] == "hex", move["a"].cast("int")).otherwise(1)
    degrees = F.when(move["kind"] == "polar", move["b"]).otherwise(F.element_at(F.array(*map(F.lit, map(float, HEX_DEGREES))), number))
    length = F.when(move["kind"] == "polar", move["a"]).otherwise(F.lit(float(radius)))
    turned = F.struct((x + length * F.cos(F.radians(degrees))).alias("x"), (y + length * F.sin(F.radians(degrees))).alias("y"))
    plain = F.struct((F.when(move["kind"] == "xy", x).otherwise(0.0) + move["a"]).alias("x"), (F.when(move["kind"] == "xy", y).otherwise(0.0) + move["b"]).alias("y"))
    return F.when(move["kind"].isin("absolute", "xy"), plain).otherwise(turned)


def hex_moves(start: tuple[float, float], goal: tuple[float, float], radius: float, tolerance: float | None = None, width: float = math.inf, height: float = math.inf, most: int = 20_000) -> list[int] | None:
    """The fewest hex moves from start to within tolerance of goal, on the lattice that the moves span; None beyond `most` expansions."""
    near = radius / 2 if tolerance is None else tolerance
    across, up = radius * math.cos(math.pi / 6), radius / 2
    at = lambda p: (start[0] + p[0] * across, start[1] + p[0] * up + p[1] * radius)
    gap = lambda p: math.hypot(at(p)[0] - goal[0], at(p)[1] - goal[1])
    queue, came = [(gap((0, 0)) / radius, 0, (0, 0))], {(0, 0): (0, None, 0)}
    for _ in range(most):
        if not queue:
            return None
        _, cost, p = heapq.heappop(queue)
        if gap(p) <= near:
            moves = []
            while came[p][1] is not None:
                moves.append(came[p][2])
                p = came[p][1]
            return moves[::-1]
        for number, (a, b) in enumerate(_HEX_STEPS, 1):
            q = (p[0] + a, p[1] + b)
            x, y = at(q)
            if 0 <= x < width and 0 <= y < height and cost + 1 < came.get(q, (math.inf,))[0]:
                came[q] = (cost + 1, p, number)
                heapq.heappush(queue, (cost + 1 + gap(q) / radius, cost + 1, q))
    return None
