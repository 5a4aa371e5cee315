"""Projection, filter, sort, joins, set operations, top-k and exact sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..table import broadcastable, require, salted_join, unique, with_position, with_running

Clause = tuple  # (column, comparison, value)

#: Ids of equal boxes that are joined as one list.
LIST_ROWS = 4096


def select(df: DataFrame, columns: Sequence[str] | None = None, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Columns in the order named, renamed where `rename` says so."""
    columns, rename = list(columns or df.columns), dict(rename or {})
    require(df, [*columns, *rename])
    names = [rename.get(c, c) for c in columns]
    unique(names)
    return df.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)))


def matches(df: DataFrame, column: str, comparison: str, value=None) -> Column:
    """Two-valued: a null cell matches is_null alone."""
    require(df, [column])
    c = F.col(column)
    tests = {
        "eq": lambda: c == F.lit(value), "ne": lambda: c != F.lit(value), "lt": lambda: c < F.lit(value), "lte": lambda: c <= F.lit(value),
        "gt": lambda: c > F.lit(value), "gte": lambda: c >= F.lit(value), "in": lambda: c.isin(list(value)), "not_in": lambda: ~c.isin(list(value)),
        "contains": lambda: c.contains(value) if dict(df.dtypes)[column] == "string" else F.lit(False), "is_null": c.isNull, "not_null": c.isNotNull,
    }
    if comparison not in tests:
        raise ValueError(f"unknown comparison {comparison!r}; there are {', '.join(tests)}")
    return F.coalesce(tests[comparison](), F.lit(False))


def filter_rows(df: DataFrame, where: Sequence[Clause] = (), combine: str = "and", negate: bool = False) -> DataFrame:
    """Rows that match all ("and") or one ("or") of the clauses; `negate` takes the two-valued complement. No clause keeps everything."""
    if not where:
        return df
    if combine not in ("and", "or"):
        raise ValueError(f"combine is {combine!r}; it can be 'and' or 'or'")
    found = reduce((lambda a, b: a & b) if combine == "and" else (lambda a, b: a | b), [matches(df, *clause) for clause in where])
    return df.filter(~found if negate else found)


def sort(df: DataFrame, by: Sequence[str | tuple[str, bool]], tie: Sequence[str] = ()) -> DataFrame:
    """By several keys, (name, True) descending; nulls first ascending, last descending; `tie` makes the order total."""
    keys = [(k, False) if isinstance(k, str) else k for k in by]
    require(df, [*(k for k, _ in keys), *tie])
    return df.orderBy(*(F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_first() for k, down in keys), *tie)


def join(left: DataFrame, right: DataFrame, on: str | Sequence[str | Mapping[str, str]], how: str = "inner", suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """Equi-join in which null keys match null keys. Keys keep the left names; other clashes get the suffixes."""
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"how is {how!r}; it can be inner, left, right or outer")
    keys = [(k["left"], k["right"]) if isinstance(k, Mapping) else (k, k) for k in ([on] if isinstance(on, (str, Mapping)) else on)]
    require(left, [a for a, _ in keys])
    require(right, [b for _, b in keys])
    rest_l, rest_r = [c for c in left.columns if c not in {a for a, _ in keys}], [c for c in right.columns if c not in {b for _, b in keys}]
    clash = set(rest_l) & set(rest_r)
    l, r = left.select(*(F.col(c).alias(f"l__{c}") for c in left.columns)), right.select(*(F.col(c).alias(f"r__{c}") for c in right.columns))
    test = reduce(lambda a, b: a & b, [F.col(f"l__{a}").eqNullSafe(F.col(f"r__{b}")) for a, b in keys])
    joined = _joined(l, r, test, how, [f"l__{a}" for a, _ in keys])
    names = [*(a for a, _ in keys), *(c + suffixes[0] if c in clash else c for c in rest_l), *(c + suffixes[1] if c in clash else c for c in rest_r)]
    unique(names)
    key = {"inner": lambda a, b: F.col(f"l__{a}"), "left": lambda a, b: F.col(f"l__{a}"), "right": lambda a, b: F.col(f"r__{b}"), "outer": lambda a, b: F.coalesce(f"l__{a}", f"r__{b}")}[how]
    out = [key(a, b) for a, b in keys] + [F.col(f"l__{c}") for c in rest_l] + [F.col(f"r__{c}") for c in rest_r]
    return joined.select(*(c.alias(n) for c, n in zip(out, names, strict=True)))


def _joined(l: DataFrame, r: DataFrame, test: Column, how: str, keys: list[str]) -> DataFrame:
    """The join of disjoint columns. What has no partner on the right is added to an inner or left join, as a full or right one would keep
    all rows of a key in one task; the smaller side is copied to all tasks where it has few rows of fixed width."""
    fixed = lambda df: not any(isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)) for f in df.schema)
    small = broadcastable(r) if fixed(r) else r
    if how in ("inner", "right") and small is r and fixed(l):
        l = broadcastable(l)
    main = l.join(small, test, "left" if how in ("left", "outer") else "inner")
    if how in ("inner", "left"):
        return main
    alone = r.join(l.select(*keys).distinct(), test, "left_anti")
    return main.unionByName(alone, allowMissingColumns=True)


def semi_join(left: DataFrame, right: DataFrame, on: Sequence[str], anti: bool = False) -> DataFrame:
    """Rows of left that have (anti: don't have) a partner; null keys match null keys."""
    r = right.select(*(F.col(c).alias(f"r__{c}") for c in on)).distinct()
    return left.join(r, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"r__{c}")) for c in on]), "left_anti" if anti else "left_semi")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), direction: str = "backward", tolerance: float | None = None, suffixes: tuple[str, str] = ("_left", "_right"), tie: Sequence[str] = ()) -> DataFrame:
    """Each left row with the nearest right row on an ordered key, by equal `by` keys.

    backward takes the last right key at or before, forward the first at or after, nearest the closer (ties go
    backward). Equal right keys: the last in the order of `tie` going backward, the first going forward. A null
    left key gets nulls, null right keys are dropped. One shuffle on `by`: both sides are unioned and
    carried along a window, so no pair of rows is ever built. Without `by`, rows go by ranges of the key.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"direction is {direction!r}; it can be backward, forward or nearest")
    if tolerance is not None and tolerance < 0:
        raise ValueError("tolerance is negative")
    require(left, [on, *by])
    require(right, [on, *by, *tie])
    rest = [c for c in right.columns if c not in by and c != on]
    clash = {c for c in rest if c in left.columns}
    row_l, row_r = F.struct(*left.columns), F.struct(F.col(on).alias("key__"), *(F.col(c).alias(f"r__{c}") for c in rest))
    keys = [F.col(c).cast("string").alias(f"by__{k}") for k, c in enumerate(by)]
    none_l, none_r = F.lit(None).cast(left.select(row_l.alias("x")).schema["x"].dataType), F.lit(None).cast(right.select(row_r.alias("x")).schema["x"].dataType)
    order_r = F.struct(*tie) if tie else F.lit(0)
    order_type = right.select(order_r.alias("x")).schema["x"].dataType
    l = left.select(*keys, F.col(on).alias("on__"), F.lit(1).alias("side__"), F.lit(None).cast(order_type).alias("tie__"), row_l.alias("l__"), none_r.alias("r__"))
    r = right.filter(F.col(on).isNotNull()).select(*keys, F.col(on).alias("on__"), F.lit(0).alias("side__"), order_r.alias("tie__"), none_l.alias("l__"), row_r.alias("r__"))
    both, part = l.unionByName(r), [f"by__{k}" for k in range(len(by))]
    back, ahead = [F.col("on__"), F.col("side__"), F.col("tie__")], [F.col("on__").desc(), F.col("side__"), F.col("tie__").desc()]
    for name, order, skipped in (("b__", back, "forward"), ("f__", ahead, "backward")):
        if direction == skipped:
            both = both.withColumn(name, none_r)
        elif part:
            both = both.withColumn(name, F.last("r__", True).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        else:
            both = _last_right(both, order, name)
    gap_b, gap_f = F.col("on__") - F.col("b__.key__"), F.col("f__.key__") - F.col("on__")
    best = {"backward": F.col("b__"), "forward": F.col("f__"), "nearest": F.when(F.col("f__").isNull() | (gap_b <= gap_f), F.col("b__")).otherwise(F.col("f__"))}[direction]
    found = both.filter("side__ = 1").withColumn("m__", F.when(F.col("on__").isNotNull(), best))
    if tolerance is not None:
        found = found.withColumn("m__", F.when(F.abs((F.col("on__") - F.col("m__.key__")).cast("double")) <= tolerance, F.col("m__")))
    out = [F.col(f"l__.{c}").alias(c + suffixes[0] if c in clash else c) for c in left.columns]
    return found.select(*out, *(F.col(f"m__.r__{c}").alias(c + suffixes[1] if c in clash else c) for c in rest))


def _last_right(both: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`both` with the r__ of the last right row (side__ 0) up to each row in the order: rows are numbered by ranges of the order, a running
    maximum says the number of that right row, and the two meet in a salted join. No task sees the whole table."""
    numbered = with_position(both, order, "pos__")
    run = with_running(numbered, ["pos__"], {"at__": ("max", F.when(F.col("side__") == 0, F.col("pos__")))})
    rights = numbered.filter("side__ = 0").select(F.col("pos__").alias("at__"), F.col("r__").alias(name))
    met = run.filter("at__ is not null")
    out = salted_join(met, rights, ["at__"], met.groupBy("at__").agg(F.count("*").alias("n")), "pos__")
    early = run.filter("at__ is null").withColumn(name, F.lit(None).cast(both.schema["r__"].dataType))
    return out.unionByName(early).drop("at__", "pos__")


def containment_join(anchors: DataFrame, candidates: DataFrame, cell: float, frame: str = "frame") -> DataFrame:
    """Theta join of bounding boxes (id, frame, x0, y0, x1, y1): candidates inside an anchor of the same frame.

    Equal boxes are tested once, and their ids are put in for them afterwards. A grid of `cell` turns the test into an equi-join: the
    anchor is listed in each cell that it covers, the candidate in the one of its corner, which lies in the anchor too.
    """
    sides = ["x0", "y0", "x1", "y1"]
    box = lambda df, k: df.select(*(F.col(c).alias(f"{k}_{c}") for c in ["id", frame, *sides])).na.drop(subset=same(k))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    same = lambda k: [f"{k}_{c}" for c in [frame, *sides]]
    lists = lambda df, k: df.join(df.groupBy(*same(k)).agg(F.ceil(F.count("*") / LIST_ROWS).alias("salts")), same(k)).groupBy(*same(k), F.pmod(F.xxhash64(f"{k}_id"), "salts")).agg(F.collect_list(F.struct(f"{k}_id")).alias(f"{k}_ids"))
    a, c = box(anchors, "a"), box(candidates, "c")
    kinds_a = a.drop("a_id").distinct().withColumn("gx", cells("a_x0", "a_x1")).withColumn("gy", cells("a_y0", "a_y1"))
    kinds_c = c.drop("c_id").distinct().withColumn("gx", F.floor(F.col("c_x0") / cell)).withColumn("gy", F.floor(F.col("c_y0") / cell))
    inside = "a_x0 <= c_x0 and a_y0 <= c_y0 and a_x1 >= c_x1 and a_y1 >= c_y1"
    kinds = kinds_a.join(kinds_c, (kinds_a["gx"] == kinds_c["gx"]) & (kinds_a["gy"] == kinds_c["gy"]) & (F.col(f"a_{frame}") == F.col(f"c_{frame}"))).filter(inside).drop("gx", "gy")
    met = kinds.join(lists(a, "a"), same("a")).join(lists(c, "c"), same("c")).select("a_ids", "c_ids").repartition(F.xxhash64("a_ids", "c_ids"))
    return met.select(F.explode("a_ids").alias("a"), "c_ids").select("a.a_id", F.explode("c_ids").alias("c")).select("a_id", "c.c_id")


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of points with the ranges that hold their value (ends included), by an equi-join on buckets of `width`."""
    p = points.withColumn("bucket__", F.floor(F.col(value) / width))
    r = ranges.withColumn("bucket__", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "bucket__").filter(F.col(value).between(F.col(low), F.col(high))).drop("bucket__")


def concat(*tables: DataFrame, strict: bool = False) -> DataFrame:
    """UNION ALL by name; columns that a table lacks are null. strict: all headers must be equal."""
    if len(tables) < 2:
        raise ValueError("concat needs two tables at least")
    if strict and any(t.columns != tables[0].columns for t in tables):
        raise ValueError("the tables' headers differ")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def dedupe(df: DataFrame, subset: Sequence[str] | None = None, keep: str = "first", order: Sequence[str] = ()) -> DataFrame:
    """One row for each value of the subset: the first or last in the given order."""
    subset = list(subset or df.columns)
    require(df, [*subset, *order])
    if keep not in ("first", "last"):
        raise ValueError(f"keep is {keep!r}; it can be first or last")
    by = [F.col(c).asc_nulls_first() if keep == "first" else F.col(c).desc_nulls_last() for c in (order or df.columns)]
    w = Window.partitionBy(*subset).orderBy(*by)
    return df.withColumn("n__", F.row_number().over(w)).filter("n__ = 1").drop("n__")


def difference(df: DataFrame, *others: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in none of the other tables."""
    return reduce(lambda a, b: semi_join(a, b, on, anti=True), others, df)


def sample(df: DataFrame, n: int, seed: int, replace: bool = False, key: Sequence[str] = ()) -> DataFrame:
    """Exactly n rows (without replacement: at most all). The same seed and keys give the same rows.

    Without replacement: the n least of a seeded hash of the key, a top-k that ships n rows a task.
    With replacement: n drawn ranks, joined to the ranks of the rows.
    """
    spark, keys = df.sparkSession, [F.col(c) for c in (key or df.columns)]
    if not replace:
        return df.withColumn("h__", F.xxhash64(F.lit(seed), *keys)).orderBy("h__", *keys).limit(n).drop("h__")
    total = df.count()
    if not total:
        return df
    draws = spark.range(n).select(F.floor(F.rand(seed) * total).cast("long").alias("rank__"))
    ranked = df.rdd.zipWithIndex().map(lambda p: (*p[0], p[1]))
    schema = df.schema.add("rank__", "long") if "rank__" not in df.columns else df.schema
    return spark.createDataFrame(ranked, schema).join(draws, "rank__").drop("rank__")


def top_k(df: DataFrame, by: str, k: int, largest: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    require(df, [by, *tie])
    return df.orderBy(F.col(by).desc_nulls_last() if largest else F.col(by).asc_nulls_last(), *tie).limit(k)


def top_k_per_group(df: DataFrame, group: Sequence[str], by: str, k: int, largest: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.col(by).desc_nulls_last() if largest else F.col(by).asc_nulls_last(), *tie)
    return df.withColumn("n__", F.row_number().over(w)).filter(F.col("n__") <= k).drop("n__")


def best_of(df: DataFrame, score: str, name: str, direction: str = "higher", floor: float | None = None) -> DataFrame:
    """The best row with its runner-up, the margin between them and whether the best passes the floor."""
    sign = -1 if direction == "higher" else 1
    two = df.select(F.col(name).alias("name"), F.col(score).cast("double").alias("score")).orderBy((sign * F.col("score")).asc_nulls_last(), "name").limit(2)
    rows = F.array_sort(F.collect_list(F.struct((sign * F.col("score")).alias("k"), "name", "score")))
    best = two.agg(rows.alias("r")).filter(F.size("r") > 0)
    out = best.select(F.col("r")[0]["name"].alias("best"), F.col("r")[0]["score"].alias("score"), F.get("r", F.lit(1))["name"].alias("runner_up"), F.abs(F.col("r")[0]["score"] - F.get("r", F.lit(1))["score"]).alias("margin"))
    passed = F.lit(True) if floor is None else (F.col("score") >= floor if direction == "higher" else F.col("score") <= floor)
    return out.withColumn("passes", passed)
