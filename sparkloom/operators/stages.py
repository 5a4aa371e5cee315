"""Stages over detected objects: families, enclosing frames, recovery, pointing, courses and rounds, as joins and aggregates.

Objects are rows with a box (x0, y0, w, h); pixels are rows (x, y). Boxes meet by the grid cells that they
cover, so no stage compares all pairs. Invariants are one row of booleans each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the confidence in a bound hole (fixed values).
CONFIDENCE = {"badge": 0.5, "tee": 0.25, "basket": 0.25}


def _cells(df: DataFrame, size: int) -> DataFrame:
    """Each box once for each grid cell that it covers, as (gx, gy)."""
    span = lambda at, length: F.sequence(F.floor(F.col(at) / size), F.floor((F.col(at) + F.greatest(F.col(length), F.lit(1)) - 1) / size))
    return df.withColumn("gx", F.explode(span("x0", "w"))).withColumn("gy", F.explode(span("y0", "h")))


def _renamed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_{suffix}") for c in df.columns))


def overlapping(a: DataFrame, b: DataFrame, cell: int = 32) -> DataFrame:
    """Pairs of boxes that share a pixel: the columns of `a` and of `b`, ending in _a and _b; each pair once."""
    left = _renamed(_cells(a, cell), "a").withColumnsRenamed({"gx_a": "gx", "gy_a": "gy"})
    right = _renamed(_cells(b, cell), "b").withColumnsRenamed({"gx_b": "gx", "gy_b": "gy"})
    met = left.join(right, ["gx", "gy"]).filter("x0_a < x0_b + w_b and x0_b < x0_a + w_a and y0_a < y0_b + h_b and y0_b < y0_a + h_a")
    first = (F.col("gx") == F.floor(F.greatest("x0_a", "x0_b") / cell)) & (F.col("gy") == F.floor(F.greatest("y0_a", "y0_b") / cell))
    return met.filter(first).drop("gx", "gy")  # only in the cell of their common corner


def enclosing(inner: DataFrame, outer: DataFrame, cell: int = 32) -> DataFrame:
    """(id, frame, left, top, right, bottom) of each box of `inner`: the smallest box of `outer` that holds it, and the margins.

    Ties go to the least id; boxes that nothing holds have nulls.
    """
    met = overlapping(inner.select("id", "x0", "y0", "w", "h"), outer.select("id", "x0", "y0", "w", "h"), cell)
    held = met.filter("x0_b <= x0_a and y0_b <= y0_a and x0_b + w_b >= x0_a + w_a and y0_b + h_b >= y0_a + h_a")
    best = held.groupBy(F.col("id_a").alias("id")).agg(F.min_by(F.struct("id_b", "x0_a", "y0_a", "w_a", "h_a", "x0_b", "y0_b", "w_b", "h_b"), F.struct(F.col("w_b") * F.col("h_b"), F.col("id_b"))).alias("m"))
    margins = best.select(
        "id", F.col("m.id_b").alias("frame"), (F.col("m.x0_a") - F.col("m.x0_b")).alias("left"), (F.col("m.y0_a") - F.col("m.y0_b")).alias("top"),
        (F.expr("m.x0_b + m.w_b - m.x0_a - m.w_a")).alias("right"), (F.expr("m.y0_b + m.h_b - m.y0_a - m.h_a")).alias("bottom"))
    return inner.select("id").join(margins, "id", "left")


def learn_margins(framed: DataFrame) -> DataFrame:
    """One row (left, top, right, bottom): the most common margins of what `enclosing` returns; no row where two share the lead."""
    names = ["left", "top", "right", "bottom"]
    counted = framed.filter("frame is not null").groupBy(*names).count()
    lead = counted.agg(F.max("count").alias("count"))
    return counted.join(F.broadcast(lead), "count").withColumn("n", F.count("*").over(Window.partitionBy("count"))).filter("n = 1").select(*names)


def object_pixels(objects: DataFrame, pixels: DataFrame, cell: int = 32) -> DataFrame:
    """(id, x, y): the pixels (x, y) in the box of each object."""
    at = pixels.select("x", "y", F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    inside = F.col("x").between(F.col("x0"), F.col("x0") + F.col("w") - 1) & F.col("y").between(F.col("y0"), F.col("y0") + F.col("h") - 1)
    return _cells(objects.select("id", "x0", "y0", "w", "h"), cell).join(at, ["gx", "gy"]).filter(inside).select("id", "x", "y")


def shell_family(bodies: DataFrame, dark: DataFrame, margins: DataFrame, share: float = 0.75) -> DataFrame:
    """(id, x, y): the dark pixels of each body's shell at the offsets that are dark in a share of all shells."""
    grown = bodies.select("id", "x0", "y0", "w", "h").crossJoin(F.broadcast(margins)).select(  # one row
        "id", (F.col("x0") - F.col("left")).alias("x0"), (F.col("y0") - F.col("top")).alias("y0"), (F.col("w") + F.col("left") + F.col("right")).alias("w"), (F.col("h") + F.col("top") + F.col("bottom")).alias("h"))
    found = object_pixels(grown, dark).join(grown.select("id", "x0", "y0"), "id").select("id", "x", "y", (F.col("x") - F.col("x0")).alias("ox"), (F.col("y") - F.col("y0")).alias("oy"))
    total = bodies.agg(F.ceil(F.count("*") * share).alias("least"))
    common = found.groupBy("ox", "oy").count().join(F.broadcast(total), F.col("count") >= F.col("least")).select("ox", "oy")
    return found.join(common, ["ox", "oy"]).select("id", "x", "y")


def select_family(measured: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """The rows of `measured` (id, ...) in the largest family: all within the ratios of one seed, column by column.

    Families of equal size are told apart by the least sum of logarithmic differences, then by the least id. Rows
    meet by logarithmic bins of the first column as wide as its ratio, so only rows that may match are compared.
    """
    first = next(iter(ratios))
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(1)).cast("double"))
    place = F.floor(log(first) / math.log(ratios[first]))
    values = {c: f"log_{c}" for c in ratios}
    rows = measured.select("id", *(log(c).alias(v) for c, v in values.items()), place.alias("bin"))
    seeds = _renamed(rows, "s").withColumn("bin", F.explode(F.array(*(F.col("bin_s") + d for d in (-1, 0, 1)))))
    gap = {c: F.abs(F.col(v) - F.col(f"{v}_s")) for c, v in values.items()}
    near = seeds.join(rows, "bin").withColumns({f"gap_{c}": g for c, g in gap.items()})
    for c, ratio in ratios.items():
        near = near.filter(F.col(f"gap_{c}") <= math.log(ratio))
    family = near.groupBy("id_s").agg(F.count("*").alias("n"), F.round(F.sum(sum((F.col(f"gap_{c}") for c in ratios), F.lit(0.0))), 9).alias("spread"))
    best = family.orderBy(F.desc("n"), "spread", "id_s").limit(1).select("id_s")
    return measured.join(near.join(F.broadcast(best), "id_s").select("id"), "id", "left_semi")


def assemble(plates: DataFrame, borders: DataFrame, digits: DataFrame, loops: DataFrame) -> DataFrame:
    """(plate, border, digits, loops, reason): one row for each border of a plate, complete where reason is null.

    borders (plate, border) and digits (plate, digit) are what matched a plate, loops (plate, digit, loop) the holes of
    its digits. A part may match as both border and digit; then it isn't a digit of that border.
    """
    of = digits.groupBy("plate").agg(F.array_sort(F.collect_set("digit")).alias("all"))
    holes = loops.groupBy("plate").agg(F.collect_set(F.struct("digit", "loop")).alias("held"))
    rows = plates.select("plate").join(borders.select("plate", "border").distinct(), "plate", "left").join(of, "plate", "left").join(holes, "plate", "left")
    own = F.filter(F.coalesce("all", F.array().cast(of.schema["all"].dataType)), lambda d: F.col("border").isNull() | (d != F.col("border")))
    rows = rows.withColumn("digits", own)
    kept = F.array_sort(F.transform(F.filter("held", lambda x: F.array_contains("digits", x["digit"])), lambda x: x["loop"]))
    reason = F.when(F.col("border").isNull(), "no enclosing white border").when(F.col("all").isNull(), "no contained white digit material").when(F.size("digits") == 0, "border leaves no separate digit material")
    return rows.select("plate", "border", "digits", F.coalesce(kept, F.array().cast(loops.schema["loop"].dataType.simpleString().join(["array<", ">"]))).alias("loops"), reason.alias("reason"))


def glyph_grids(objects: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(id, i, v): each object's pixels (id, x, y) sampled at the nearest of width x height cells, v 1 or 0."""
    grid = objects.select("id", "x0", "y0", "w", "h", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("i"))
    sample = lambda at, size, k, n: F.col(at) + F.least(F.col(size) - 1, F.floor(k * F.col(size) / n))
    grid = grid.select("id", "i", sample("x0", "w", F.pmod("i", F.lit(width)), width).alias("x"), sample("y0", "h", F.floor(F.col("i") / width), height).alias("y"))
    lit = pixels.select("id", "x", "y").distinct().withColumn("v", F.lit(1))
    return grid.join(lit, ["id", "x", "y"], "left").select("id", "i", F.coalesce("v", F.lit(0)).alias("v"))


def recover(candidates: DataFrame, clean: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """`candidates` (id, box, ...) with why: the names of the rules that reject each, in order; those with none are recovered.

    A rule's column is true where it rejects. A candidate that overlaps a clean object is rejected last.
    """
    taken = overlapping(candidates.select("id", "x0", "y0", "w", "h"), clean.select("id", "x0", "y0", "w", "h")).select(F.col("id_a").alias("id")).distinct().withColumn("taken", F.lit(True))
    reasons = [F.when(F.coalesce(rejects, F.lit(False)), F.lit(name)) for name, rejects in rules]
    reasons.append(F.when(F.col("taken"), F.lit("a clean object is already here")))
    return candidates.join(taken, "id", "left").withColumn("why", F.array_compact(F.array(*reasons))).drop("taken")


def plate_rules(width: tuple, height: tuple, aspect: tuple, fill: float, glyph: tuple) -> list[tuple[str, Column]]:
    """Rules of dark plates over w, h, area and the fraction of bright pixels inside, `glyph`."""
    out = lambda c, span: ~c.between(*span)
    w, h = F.col("w"), F.col("h")
    return [("plate width", out(w, width)), ("plate height", out(h, height)), ("plate aspect", out(w / h, aspect)), ("plate fill", F.col("area") / (w * h) < fill), ("glyph fraction", out(F.col("glyph"), glyph))]


def shell_rules(size: tuple[int, int] | None) -> list[tuple[str, Column]]:
    """Rules of basket shells: the family's size, and bright material inside, `glyph`."""
    if size is None:
        return [("no shell family", F.lit(True))]
    return [("shell geometry", (F.col("w") != size[0]) | (F.col("h") != size[1])), ("no bright material inside the shell", F.col("glyph") <= 0)]


def tee_rules(size: tuple[int, int] | None, fill: float | None, most: float = 0.15) -> list[tuple[str, Column]]:
    """Rules of tee frames: the family's size, and how full they are."""
    if size is None:
        return [("no tee family", F.lit(True))]
    return [("tee frame", (F.col("w") != size[0]) | (F.col("h") != size[1])), ("tee fill", F.abs(F.col("area") / (F.col("w") * F.col("h")) - fill) > most)]


def recovery_ledger(clean: DataFrame, judged: DataFrame) -> DataFrame:
    """(kind, clean, recovered, total, rejected) from clean objects (kind, ...) and judged candidates (kind, why)."""
    rows = clean.select("kind", F.lit("clean").alias("door")).union(judged.select("kind", F.when(F.size("why") == 0, "recovered").otherwise("rejected")))
    of = lambda door: F.count_if(F.col("door") == door)
    return rows.groupBy("kind").agg(of("clean").alias("clean"), of("recovered").alias("recovered"), (of("clean") + of("recovered")).alias("total"), of("rejected").alias("rejected"))


def check_recovery(clean: DataFrame, judged: DataFrame, objects: DataFrame) -> DataFrame:
    """One row of invariants: recovery only adds, leaves clean boxes as they are, and ids (kind, id) are unique."""
    box = ["kind", "id", "x0", "y0", "w", "h"]
    found = judged.filter(F.size("why") == 0)
    counts = objects.agg(F.count("*").alias("all"), F.countDistinct("kind", "id").alias("ids"))
    added = clean.agg(F.count("*").alias("c")).crossJoin(found.agg(F.count("*").alias("r")))  # one row each
    lost = clean.select(*box).exceptAll(objects.select(*box)).agg(F.count("*").alias("lost"))
    out = counts.crossJoin(added).crossJoin(lost).select((F.col("lost") == 0).alias("clean_survives"), (F.col("all") == F.col("c") + F.col("r")).alias("only_adds"), (F.col("all") == F.col("ids")).alias("ids_unique"))
    return out.withColumn("balanced", F.col("clean_survives") & F.col("only_adds") & F.col("ids_unique"))


def pointing(tees: DataFrame, bright: DataFrame, least: float) -> DataFrame:
    """(id, lean, px, py): how far the bright pixels in a tee's box lie along its axis from its centre, and the unit
    direction they point to; null where the lean is under `least`, or nothing is bright. tees: (id, box, x, y, angle)."""
    middle = object_pixels(tees, bright).groupBy("id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    ax, ay = F.cos("angle"), F.sin("angle")
    rows = tees.join(middle, "id", "left").withColumn("lean", (F.col("mx") - F.col("x")) * ax + (F.col("my") - F.col("y")) * ay)
    turned = lambda a: F.when(F.abs("lean") >= least, F.signum("lean") * a)
    return rows.select("id", "lean", turned(ax).alias("px"), turned(ay).alias("py"))


def check_rays(rays: DataFrame, tees: DataFrame, badges: DataFrame) -> DataFrame:
    """One row of invariants over rays (tee, badge, distance, why): each tee once, each badge at most once, each miss explained."""
    n = rays.agg(F.count("*").alias("rays"), F.countDistinct("tee").alias("of"), F.count("badge").alias("paired"), F.countDistinct("badge").alias("badges"),
                 F.coalesce(F.bool_and(F.col("badge").isNull() | (F.col("distance") > 0)), F.lit(True)).alias("distances"), F.coalesce(F.bool_and(F.col("badge").isNull() == F.col("why").isNotNull()), F.lit(True)).alias("reasons"))
    free = badges.join(rays.filter("badge is not null").select("badge").distinct(), "badge", "left_anti").agg(F.count("*").alias("free"))
    both = n.crossJoin(tees.agg(F.count("*").alias("tees"))).crossJoin(badges.agg(F.count("*").alias("all"))).crossJoin(free)  # one row each
    checks = {"tees_once": (F.col("rays") == F.col("tees")) & (F.col("of") == F.col("rays")), "badges_once": F.col("paired") == F.col("badges"), "badges_listed": F.col("all") == F.col("paired") + F.col("free"), "distances": F.col("distances"), "reasons": F.col("reasons")}
    return both.select(*(c.alias(k) for k, c in checks.items())).withColumn("balanced", F.expr(" and ".join(checks)))


def check_straight(holes: DataFrame, doglegs: DataFrame, most: float) -> DataFrame:
    """One row of invariants over holes (badge, tee, basket, residual, to_badge, to_basket) and doglegs (badge, why)."""
    h = holes.agg(F.count("*").alias("n"), F.countDistinct("badge").alias("b"), F.countDistinct("tee").alias("t"), F.countDistinct("basket").alias("k"), F.coalesce(F.max("residual") <= most, F.lit(True)).alias("on_a_line"), F.coalesce(F.bool_and(F.col("to_basket") > F.col("to_badge")), F.lit(True)).alias("beyond"))
    shared = holes.select("badge").intersect(doglegs.select("badge")).agg(F.count("*").alias("shared"))
    d = doglegs.agg(F.coalesce(F.bool_and(F.col("why").isNotNull()), F.lit(True)).alias("explained"))
    checks = {"badges_once": (F.col("n") == F.col("b")) & (F.col("shared") == 0), "tees_once": F.col("n") == F.col("t"), "baskets_once": F.col("n") == F.col("k"), "on_a_line": F.col("on_a_line"), "beyond": F.col("beyond"), "explained": F.col("explained")}
    return h.crossJoin(shared).crossJoin(d).select(*(c.alias(k) for k, c in checks.items())).withColumn("balanced", F.expr(" and ".join(checks)))  # one row each


def confidence(tee: Column, basket: Column) -> Column:
    """A stated sum for a hole whose badge was read: what is bound of tee and basket adds its part."""
    return F.lit(CONFIDENCE["badge"]) + F.when(tee.isNotNull(), CONFIDENCE["tee"]).otherwise(0.0) + F.when(basket.isNotNull(), CONFIDENCE["basket"]).otherwise(0.0)


def anchors(**kinds: DataFrame) -> DataFrame:
    """(kind, id, x, y): the middles of the boxes of all kinds in one table."""
    out = None
    for kind, df in kinds.items():
        rows = df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), (F.col("x0") + F.col("w") / 2).alias("x"), (F.col("y0") + F.col("h") / 2).alias("y"))
        out = rows if out is None else out.union(rows)
    return out


def settle(legs: DataFrame, *by: str) -> DataFrame:
    """(..., play, walk, total): lengths of the legs (kind, length) of each course."""
    of = lambda kind: F.round(F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("length"))), F.lit(0.0)), 3)
    return legs.groupBy(*by).agg(of("play").alias("play"), of("walk").alias("walk"), F.round(F.coalesce(F.sum("length"), F.lit(0.0)), 3).alias("total"))


def walkable(cells: DataFrame, blocked: Sequence[str]) -> DataFrame:
    """Adds walkable: 0 in a cell (gx, gy, kind) of a blocked kind, else 1."""
    return cells.withColumn("walkable", F.when(F.col("kind").isin(*blocked), 0).otherwise(1))


def line_cells(legs: DataFrame, cell: int, width: int, height: int) -> DataFrame:
    """(leg, gx, gy): the distinct cells of each leg's straight line (leg, ax, ay, bx, by), sampled at half a cell."""
    steps = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / (cell / 2))).cast("int")
    on = legs.select("*", steps.alias("steps"), F.explode(F.sequence(F.lit(0), steps)).alias("k"))
    at = lambda a, b, most: F.floor(F.least(F.lit(most - 1.0), F.greatest(F.lit(0.0), F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("steps"))) / cell)
    return on.select("leg", at("ax", "bx", width).alias("gx"), at("ay", "by", height).alias("gy")).distinct()


def crossed(legs: DataFrame, cells: DataFrame, cell: int, width: int, height: int) -> DataFrame:
    """`legs` with crossed, how many cells that aren't walkable their straight line meets, and blocked. A cell that isn't listed isn't walkable."""
    way = line_cells(legs, cell, width, height).join(cells.select("gx", "gy", "walkable"), ["gx", "gy"], "left")
    n = way.groupBy("leg").agg(F.count_if(F.coalesce("walkable", F.lit(0)) == 0).alias("crossed"))
    return legs.join(n, "leg", "left").withColumn("blocked", F.col("crossed") > 0)


def course_summary(holes: DataFrame, legs: DataFrame) -> DataFrame:
    """(holes, length, longest, blocked): of holes (number, length) and of legs (blocked); of equally long holes the first is the longest."""
    h = holes.agg(F.count("*").alias("holes"), F.round(F.coalesce(F.sum("length"), F.lit(0.0)), 3).alias("length"), F.max_by("number", F.struct("length", -F.col("number"))).alias("longest"))
    return h.crossJoin(legs.agg(F.count_if("blocked").alias("blocked")))  # one row each


def round_summary(legs: DataFrame) -> DataFrame:
    """(legs, walked, length, straight, detour, bent) of legs (length, straight, blocked); an unreachable leg has a null length."""
    went = F.col("length").isNotNull()
    total = lambda c: F.round(F.coalesce(F.sum(F.when(went, F.col(c))), F.lit(0.0)), 3)
    out = legs.agg(F.count("*").alias("legs"), F.count("length").alias("walked"), total("length").alias("length"), total("straight").alias("straight"), F.count_if(went & F.col("blocked")).alias("bent"))
    return out.withColumn("detour", F.round(F.col("length") - F.col("straight"), 3))


def compare_with_straight(legs: DataFrame, fallback: DataFrame) -> DataFrame:
    """(leg, straight, length, delta, ratio, crossed): leg by leg against the fallback's (leg, length), or where it has no such leg
    against the leg's own straight length."""
    other = fallback.select("leg", F.col("length").alias("other"))
    rows = legs.join(other, "leg", "left").withColumn("straight", F.coalesce("other", "straight"))
    return rows.select("leg", "straight", "length", F.round(F.col("length") - F.col("straight"), 3).alias("delta"), F.round(F.col("length") / F.greatest(F.lit(1e-9), F.col("straight")), 3).alias("ratio"), "crossed")


def cards_overrides(presets: DataFrame, instances: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """(layer, owner, token, value): each token that a preset (id, tokens as columns) or an instance (projection, disc, token, value) sets."""
    long = presets.unpivot("id", list(tokens), "token", "value").filter("value is not null")
    own = instances.select(F.lit("instance").alias("layer"), F.concat_ws(".", "projection", "disc").alias("owner"), "token", "value")
    return long.select(F.lit("preset").alias("layer"), F.col("id").cast("string").alias("owner"), "token", "value").union(own)


def cards_inherits(presets: DataFrame, instances: DataFrame, token: str) -> DataFrame:
    """(kind, owner): the presets that leave `token` to the layer below, and the instances (projection, disc, provenance map) that have it from the global one."""
    unset = presets.filter(F.col(token).isNull()).select(F.lit("preset").alias("kind"), F.col("id").cast("string").alias("owner"))
    return unset.union(instances.filter(F.element_at("provenance", token) == "global").select(F.lit("instance").alias("kind"), F.concat_ws(".", "projection", "disc").alias("owner")))


def cards_provenance(instances: DataFrame, projection: str, disc: Column | str) -> DataFrame:
    """(token, layer): where each token of one instance comes from."""
    return instances.filter((F.col("projection") == projection) & (F.col("disc") == disc)).select(F.explode("provenance").alias("token", "layer"))
