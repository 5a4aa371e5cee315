"""Application queries as relations: search, standings, constraints, rosters, layered settings, stacks, ordered folds."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..table import double, with_position

#: What a fact is worth when a term hits it (fixed values).
WEIGHTS = {"mold": 10, "maker": 7, "category": 7, "plastic": 6, "color": 5, "nickname": 4, "notes": 2}
GOLDEN = (1 + math.sqrt(5)) / 2


def tokens(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and + . ' -"""
    return F.filter(F.split(F.trim(F.lower(text)), r"[^a-z0-9+.'-]+"), lambda w: w != "")


def term_score(term: str, facts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Best score of one term over the facts: whole word x3, beginning x2, beginning of a word x1.5 (rounded half up), inside x1; null where nothing matches."""
    hits = []
    for name, text in facts.items():
        t, w = F.trim(F.lower(F.coalesce(text, F.lit("")))), weights[name]
        words = tokens(t)
        hits.append(
            F.when(F.array_contains(words, term), w * 3.0).when(t.startswith(term), w * 2.0).when(F.exists(words, lambda x: x.startswith(term)), math.floor(w * 1.5 + 0.5) * 1.0).when(t.contains(term), w * 1.0)
        )
    return F.greatest(*hits) if len(hits) > 1 else hits[0]


def search(df: DataFrame, facts: Sequence[str], query: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Rows that every term matches, with their score. No terms: every row, score 0."""
    terms = query.lower().split()
    weights = weights or {f: WEIGHTS.get(f, 1) for f in facts}
    scores = [term_score(t, {f: F.col(f) for f in facts}, weights) for t in terms]
    out = df.withColumn("score", sum(scores[1:], scores[0]) if scores else F.lit(0.0))
    return out.filter(F.col("score").isNotNull())


def shelf(discs: DataFrame, molds: DataFrame, makers: DataFrame, bag_items: DataFrame, query: str = "", in_bag: str | None = None, unbagged: bool = False) -> DataFrame:
    """discs with mold, maker and the bags that hold them, searched, best first."""
    held = bag_items.groupBy("disc_id").agg(F.array_sort(F.collect_set("bag_id")).alias("bag_ids"))
    rows = discs.join(molds, "mold_id", "left").join(makers, "maker_id", "left").join(held, "disc_id", "left").withColumn("bag_ids", F.coalesce("bag_ids", F.array().cast("array<string>")))
    if in_bag is not None:
        rows = rows.filter(F.array_contains("bag_ids", in_bag))
    if unbagged:
        rows = rows.filter(F.size("bag_ids") == 0)
    return search(rows, [f for f in WEIGHTS if f in rows.columns], query).orderBy(F.desc("score"), "disc_id")


def standings(scores: DataFrame, points: Sequence[float], mode: str = "low", tie: str = "share") -> DataFrame:
    """(state, entry, place, tied, points, total, standing) of (state, entry, score): competition ranking per state, points by
    place (tied: shared and rounded to cents, the best, or none decided), running totals over the states in order."""
    if tie not in ("share", "best", "none"):
        raise ValueError(f"tie is {tie!r}; it can be share, best or none")
    by = F.col("score").desc() if mode == "high" else F.col("score").asc()
    live = scores.filter(F.col("score").isNotNull())
    place, size = F.rank().over(Window.partitionBy("state").orderBy(by)), F.count(F.lit(1)).over(Window.partitionBy("state", "score"))
    at = lambda k: F.coalesce(F.get(F.array(*(F.lit(float(p)) for p in points)), k), F.lit(0.0))
    ranked = live.withColumn("place", place.cast("long")).withColumn("size__", size)
    last = F.least(F.col("place") + F.col("size__") - 2, F.lit(len(points) - 1))  # places beyond the points add nothing, however many tie
    pooled = F.when(F.col("place") > len(points), 0.0).otherwise(F.aggregate(F.sequence(F.col("place") - 1, last), F.lit(0.0), lambda s, k: s + at(k.cast("int"))))
    award = at((F.col("place") - 1).cast("int"))
    ranked = ranked.withColumn("tied", F.col("size__") > 1).withColumn("points", F.when((F.col("size__") > 1) & F.lit(tie == "share"), F.floor(pooled / F.col("size__") * 100 + 0.5) / 100).otherwise(award))
    total = F.sum("points").over(Window.partitionBy("entry").orderBy("state").rowsBetween(Window.unboundedPreceding, 0))
    out = ranked.withColumn("total", total)
    return out.withColumn("standing", F.rank().over(Window.partitionBy("state").orderBy(F.desc("total"))).cast("long")).drop("size__")


def place_order(order: DataFrame, entry: str) -> DataFrame:
    """(entry, place): the tapped entry goes to the end, or out if it has a place; the gap closes."""
    spark = order.sparkSession
    live = order.filter(F.col("place").isNotNull())
    tapped = live.filter(F.col("entry") == entry)
    rest = live.filter(F.col("entry") != entry)
    last = spark.createDataFrame([(entry, 2**31 - 1)], "entry string, place int").join(tapped.select("entry"), "entry", "left_anti")
    return rest.select("entry", F.col("place").cast("int")).union(last.select("entry", "place")).select("entry", F.row_number().over(Window.partitionBy().orderBy("place", "entry")).cast("long").alias("place"))


# constraints -----------------------------------------------------------------------------------------

_SEVERITY = {"pass": 0, "pending": 1, "fail": 2}


def combine(results: DataFrame, how: str = "all") -> DataFrame:
    """(status) of (rule, status): each rule is its worst result; all takes the worst rule, any the best. No rule: unconstrained."""
    code = F.coalesce(*(F.when(F.col("status") == k, F.lit(v)) for k, v in _SEVERITY.items()))
    rules = results.groupBy("rule").agg(F.max(code).alias("code"))
    worst = rules.agg((F.max if how == "all" else F.min)("code").alias("c"))
    return worst.select(F.when(F.col("c").isNull(), "unconstrained").when(F.col("c") == 0, "pass").when(F.col("c") == 1, "pending").otherwise("fail").alias("status"))


def bag_limit(teams: DataFrame, bag_items: DataFrame, discs: DataFrame, limit: int) -> DataFrame:
    """(team, n, status): fails over the limit or with an item that doesn't exist."""
    items = bag_items.join(discs.select("disc_id", F.lit(1).alias("known")), "disc_id", "left")
    n = items.groupBy("bag_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("known").isNull().cast("int")).alias("lost"))
    out = teams.join(n, "bag_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("team", "n", F.when((F.coalesce("lost", F.lit(0)) > 0) | (F.col("n") > limit), "fail").otherwise("pass").alias("status"))


def one_mold(teams: DataFrame, bag_items: DataFrame, discs: DataFrame) -> DataFrame:
    """(team, molds, status): none is pending, one passes, more fail."""
    n = bag_items.join(discs, "disc_id").groupBy("bag_id").agg(F.countDistinct("mold_id").alias("molds"))
    m = F.coalesce("molds", F.lit(0))
    return teams.join(n, "bag_id", "left").select("team", m.alias("molds"), F.when(m == 0, "pending").when(m == 1, "pass").otherwise("fail").alias("status"))


def team_throws(rounds: DataFrame, teams: DataFrame, throws: DataFrame, value: int) -> DataFrame:
    """(round, team, n, status) of every round and team: that grid is the result's own size."""
    n = throws.groupBy("round", "team").agg(F.count(F.lit(1)).alias("n"))
    grid = rounds.crossJoin(teams.select("team")).join(n, ["round", "team"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = (F.col("n") > value) | (F.col("complete") & (F.col("n") != value))
    return grid.select("round", "team", "n", F.when(bad, "fail").when(F.col("n") == value, "pass").otherwise("pending").alias("status"))


def ties(scores: DataFrame, mode: str = "share") -> DataFrame:
    """(state, tied, status): results that share a score with another."""
    g = scores.groupBy("state").agg((F.count("score") - F.countDistinct("score")).alias("tied"))
    return g.withColumn("status", F.when((F.col("tied") > 0) & F.lit(mode == "none"), "fail").otherwise("pass"))


def entered(scores: DataFrame) -> DataFrame:
    """(state, entered, of, status)."""
    g = scores.groupBy("state").agg(F.count("score").alias("entered"), F.count(F.lit(1)).alias("of"))
    return g.withColumn("status", F.when(F.col("entered") == F.col("of"), "pass").otherwise("pending"))


def cap(n: Column, value: int) -> Column:
    return F.when(n > value, "fail").when(n == value, "pass").otherwise("pending")


# small reports ---------------------------------------------------------------------------------------


def stability_histogram(df: DataFrame, column: str) -> DataFrame:
    """under (< 0), neutral (0), over (> 0)."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return df.agg(n(F.col(column) < 0).alias("under"), n(F.col(column) == 0).alias("neutral"), n(F.col(column) > 0).alias("over"))


def pick_to_carry(df: DataFrame, column: str, name: str, threshold: float = 1.0) -> DataFrame:
    return df.filter(F.abs(F.col(column)) <= threshold).select(name).orderBy(name)


def letters(df: DataFrame, score: str, cutoffs: Sequence[tuple[str, float]]) -> DataFrame:
    """Adds letter: the first cutoff in the listed order that the score reaches; a score that none covers is an error."""
    found = F.coalesce(*(F.when(double(score) >= cut, F.lit(name)) for name, cut in cutoffs))
    return df.withColumn("letter", F.when(found.isNull(), F.raise_error(F.lit("a score is under every cutoff")).cast("string")).otherwise(found))


def bar_chart(df: DataFrame, column: str, bar: str = "#") -> DataFrame:
    g = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return g.select(column, F.concat_ws(" ", F.rpad(F.col(column).cast("string"), 2, " "), F.repeat(F.lit(bar), F.col("n").cast("int"))).alias("line"))


def parse_roster(lines: DataFrame, column: str = "value") -> DataFrame:
    """name, score of strict two-field lines; any other line is an error."""
    ok = F.col(column).rlike(r"^[^,]+,\s*-?\d+(\.\d+)?\s*$")
    p = F.split(F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("can't read line: "), F.col(column)))), ",")
    return lines.select(F.trim(p[0]).alias("name"), F.trim(p[1]).cast("double").alias("score"))


def rate_difference(prior: DataFrame, current: DataFrame, flag: str) -> DataFrame:
    """prior, current, points: two shares and their difference in points; null where there are no rows."""
    share = lambda df, n: df.agg(F.try_divide(F.sum(F.col(flag).cast("double")), F.count(flag)).alias(n))
    return share(prior, "prior").crossJoin(share(current, "current")).withColumn("points", (F.col("current") - F.col("prior")) * 100)  # one row each


def description_frequency(df: DataFrame, term: str, who: str, what: str) -> DataFrame:
    """term, distinct contributors and things, and their numbers in all rows."""
    total = df.agg(F.countDistinct(who).alias("all_who"), F.countDistinct(what).alias("all_what"))
    return df.groupBy(term).agg(F.countDistinct(who).alias("n_who"), F.countDistinct(what).alias("n_what")).crossJoin(F.broadcast(total))  # one row


def layered(instance: Column, preset: Column, fallback: Column) -> tuple[Column, Column]:
    """The first layer that has a value, and its name."""
    return F.coalesce(instance, preset, fallback), F.when(instance.isNotNull(), "instance").when(preset.isNotNull(), "preset").otherwise("global")


class GoldenWalk:
    """Slots in the order of the multiples of the golden ratio, those taken passed over, for as long as any is free.

    `draws` lists what is drawn until every slot is taken, which is settled by the taken slots alone. From there on each
    draw passes all slots over and takes the next, so the walk goes on in strides of a known length from `at`.
    """

    def __init__(self, slots: int, taken: set[int]):
        self.slots, self.at, self.draws = slots, 0, []
        left = set(range(slots)) - taken
        while left:
            ahead = [self.slot(self.at + k) for k in range(slots)]
            skipped = next((k for k, s in enumerate(ahead) if s in left), slots)
            self.draws.append(self.slot(self.at + skipped))
            left.discard(self.draws[-1])
            self.at += skipped + 1

    def slot(self, k: int) -> int:
        return math.floor((k + 1) * GOLDEN % 1 * self.slots) % self.slots

    def column(self, draw: Column) -> Column:
        """The slot of the draw with this number, from 0."""
        far = (draw - len(self.draws)) * (self.slots + 1) + self.slots + self.at + 1
        later = F.floor(far.cast("double") * GOLDEN % 1 * self.slots) % self.slots
        early = F.try_element_at(F.array(*map(F.lit, self.draws or [0])), (draw + 1).cast("int"))
        return F.when(draw < len(self.draws), early).otherwise(later.cast("int"))


def golden_assign(df: DataFrame, key: str, order: Sequence[str] | str, families: Sequence[str], spread: int | None = None, authored: str | None = None) -> DataFrame:
    """Adds family and phase. A row whose `authored` names a family has that one. Of the others the first rows, half as many
    as there are families or `spread`, draw from a golden-ratio walk over the families that gives free ones first; then
    only the first row of a key draws, and so does each row with a null key, while the others follow their key's first row.

    Which rows draw is known without walking: so draws are numbered by their position, and a number says the slot.
    `order` must be unique. No task sees the whole table, or all rows of a key.
    """
    order = [order] if isinstance(order, str) else list(order)
    if not families:
        raise ValueError("there are no families")
    names = F.array(*map(F.lit, families))
    own = F.col(authored) if authored else F.lit(None).cast("string")
    rows = df.withColumn("own__", F.when(own.isin(*families), own))
    taken = {families.index(r[0]) for r in rows.filter("own__ is not null").select("own__").distinct().collect()}  # at most as many as families
    walk = GoldenWalk(len(families), taken)
    budget = math.ceil(len(families) / 2) if spread is None else max(0, min(len(families), spread))
    place = F.struct(*order)
    free = rows.filter("own__ is null")
    early = free.orderBy(*order).limit(min(budget, len(walk.draws))).agg(F.max(place).alias("last")).first()["last"]
    spreading = F.lit(False) if early is None else place <= F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, early, strict=True)))
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(place).alias("first__"))
    rows = rows.join(first, key, "left").withColumn("phase", F.when(F.col("own__").isNotNull(), "authored").when(spreading, "spread").otherwise("grouped"))
    rows = rows.withColumn("draws__", F.col("own__").isNull() & ((F.col("phase") == "spread") | F.col("first__").isNull() | (F.col("first__") == place)))
    drawn = with_position(rows.filter("draws__"), order, "draw__").withColumn("family", F.element_at(names, walk.column(F.col("draw__")) + 1))
    fixed = rows.filter("own__ is not null").withColumn("draw__", F.lit(None).cast("long")).withColumn("family", F.col("own__"))
    placed = drawn.unionByName(fixed)
    leads = placed.filter(F.col("first__") == place).select(F.col(key), F.col("family").alias("lead__"))
    rest = rows.filter("own__ is null and not draws__").join(leads, key).withColumn("family", F.col("lead__"))
    columns = [*(f"`{c}`" for c in df.columns), "family", "phase"]
    return placed.select(*columns).union(rest.select(*columns))


def golden_histogram(assigned: DataFrame, families: Sequence[str]) -> DataFrame:
    """(family, n): how many rows each family has, none included."""
    every = assigned.sparkSession.createDataFrame([(f,) for f in families], "family string")
    return F.broadcast(every).join(assigned.groupBy("family").agg(F.count("*").alias("n")), "family", "left").fillna(0, ["n"])


def undo_push(stack: Column, value: Column, depth: int = 32) -> Column:
    """A bounded stack in an array; entries are values, or structs (address, value)."""
    grown = F.concat(stack, F.array(value))
    return F.slice(grown, F.greatest(F.lit(1), F.size(grown) - (depth - 1)), F.lit(depth))


def _on_top(stack: Column, address: Column | None) -> Column:
    """Whether the top entry is there and, where an address is asked for, is that address's."""
    there = F.size(stack) > 0
    return there if address is None else there & F.coalesce(F.try_element_at(stack, F.lit(-1))["address"] == address, F.lit(False))


def undo_pop(stack: Column, current: Column, address: Column | None = None) -> Column:
    """The value to write back at `address`: the top entry's if it is that address's, else what is there."""
    top = F.try_element_at(stack, F.lit(-1))
    return F.when(_on_top(stack, address), top if address is None else top["value"]).otherwise(current)


def undo_settle(stack: Column, address: Column | None = None) -> Column:
    """The stack without the entry that `undo_pop` took."""
    return F.when(_on_top(stack, address), F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack)


def fold(events: DataFrame, key: Sequence[str], order: Sequence[str], step: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """Event sourcing: the state of each key after its events in order, by a reducer (state, event) -> state."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        for event in pdf.sort_values(list(order)).to_dict("records"):
            state = step(state, event)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in key}, **state}])

    return events.groupBy(*key).applyInPandas(run, schema)


def flatten_fields(df: DataFrame, depth: int = 5) -> DataFrame:
    """Nested structs as dotted columns, and the length of each array as .count."""

    def walk(schema: T.StructType, path: str, level: int):
        for f in schema:
            at = f"{path}.{f.name}" if path else f.name
            ref = F.col(".".join(f"`{p}`" for p in at.split(".")))
            if isinstance(f.dataType, T.StructType) and level < depth:
                yield from walk(f.dataType, at, level + 1)
            else:
                yield ref.alias(at)
                if isinstance(f.dataType, T.ArrayType):
                    yield F.when(ref.isNotNull(), F.size(ref)).alias(f"{at}.count")

    return df.select(*walk(df.schema, "", 0))
