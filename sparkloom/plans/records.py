"""Queries over run records: (program, position, tick, id, calculation, reads, writes, ms), one row per call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import closure


def ps(record: DataFrame) -> DataFrame:
    return record.select("position", "tick", "id", "calculation", F.size("reads").alias("n_reads"), F.size("writes").alias("n_writes"))


def ls(record: DataFrame) -> DataFrame:
    """address, producer (null: it was there before), readers."""
    w = record.select(F.explode("writes").alias("address"), F.col("id").alias("producer"))
    r = record.select(F.explode("reads").alias("address"), "id").groupBy("address").agg(F.countDistinct("id").alias("readers"))
    return w.join(r, "address", "full_outer").select("address", "producer", F.coalesce("readers", F.lit(0)).cast("long").alias("readers"))


def ticks(record: DataFrame) -> DataFrame:
    """tick, calls, its reads from outside and its writes, in order."""
    inside = record.groupBy("tick").agg(F.min("position").alias("position"), F.count(F.lit(1)).alias("calls"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reads")))).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("writes")))).alias("writes"))
    return inside.select("position", "tick", "calls", F.array_except("r", "writes").alias("reads"), "writes")


def dependencies(record: DataFrame) -> DataFrame:
    """(src, dst): dst reads what src writes."""
    w = record.select(F.explode("writes").alias("address"), F.col("id").alias("src"))
    return record.select(F.explode("reads").alias("address"), F.col("id").alias("dst")).join(w, "address").select("src", "dst").distinct()


def lineage(record: DataFrame, address: str) -> DataFrame:
    """(node, depth): addresses that an address rests on."""
    edges = record.select(F.explode("writes").alias("src"), "reads").select("src", F.explode("reads").alias("dst"))
    return closure(record.sparkSession.createDataFrame([(address,)], "node string"), edges)


def laws(record: DataFrame) -> DataFrame:
    """Work (sum of times), span (the slowest call of each tick, summed), and whether every address has one writer and no call reads a later write."""
    per = record.groupBy("tick").agg(F.max("ms").alias("slowest"), F.sum("ms").alias("ms"))
    cost = per.agg(F.sum("ms").alias("work"), F.sum("slowest").alias("span"))
    w = record.select(F.explode("writes").alias("address"), F.col("position").alias("written"))
    twice = w.groupBy("address").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("writers"))
    late = record.select(F.explode("reads").alias("address"), "position").join(w, "address").agg(F.coalesce(F.sum((F.col("written") >= F.col("position")).cast("long")), F.lit(0)).alias("late"))
    return cost.crossJoin(twice).crossJoin(late).select("work", "span", (F.col("writers") <= 1).alias("one_writer"), (F.col("late") == 0).alias("in_order"))  # one row each


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(address, status) of two tables (address, digest): added, removed, changed, same."""
    x, y = a.select("address", F.col("digest").alias("x"), F.lit(True).alias("in_a")), b.select("address", F.col("digest").alias("y"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.col("x").eqNullSafe(F.col("y")), "same").otherwise("changed")
    return x.join(y, "address", "full_outer").select("address", status.alias("status"))


def hot(record: DataFrame, top: int = 10) -> DataFrame:
    """calculation, calls, total and slowest time, share of all."""
    per = record.groupBy("calculation").agg(F.count(F.lit(1)).alias("calls"), F.sum("ms").alias("total_ms"), F.max("ms").alias("slowest_ms"))
    return per.withColumn("share", F.try_divide(F.col("total_ms"), F.sum("total_ms").over(Window.partitionBy()))).orderBy(F.desc("total_ms"), "calculation").limit(top)  # a row per calculation


def receipts(record: DataFrame) -> DataFrame:
    """name, what it consumes and produces (each once, in order), and a digest of its row."""
    each = lambda c: F.array_sort(F.array_distinct(c))
    return record.select("id", each("reads").alias("consumes"), each("writes").alias("produces"), F.sha2(F.to_json(F.struct("calculation", "reads", "writes")), 256).alias("digest"))


def judge(rows: DataFrame) -> DataFrame:
    """receipts, matched, mismatched, not_rebuilt and trusted of (state): whether a candidate reproduced every recorded result."""
    n = lambda *states: F.coalesce(F.sum(F.col("state").isin(*states).cast("long")), F.lit(0))
    out = rows.agg(F.count(F.lit(1)).alias("receipts"), n("match").alias("matched"), n("mismatch").alias("mismatched"), n("not-rebuildable", "not-comparable").alias("not_rebuilt"))
    return out.withColumn("trusted", (F.col("receipts") > 0) & (F.col("matched") == F.col("receipts")))


def hits(requests: DataFrame) -> DataFrame:
    """Reuse of (position, key): the first request of a key produces it, later ones hit."""
    first = F.min("position").over(Window.partitionBy("key"))
    return requests.withColumn("producer", first).withColumn("hit", F.col("position") > F.col("producer"))


def decide(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(candidate, score) of (candidate, criterion, value): averaged, min-max normalised by criterion, weighted; best first."""
    mean = scores.groupBy("candidate", "criterion").agg(F.avg("value").alias("v"))
    w = Window.partitionBy("criterion")
    norm = F.coalesce(F.try_divide(F.col("v") - F.min("v").over(w), F.max("v").over(w) - F.min("v").over(w)), F.lit(1.0))
    weight = F.coalesce(*(F.when(F.col("criterion") == k, F.lit(float(x))) for k, x in weights.items()), F.lit(0.0))
    return mean.withColumn("s", norm * weight).groupBy("candidate").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "candidate")


def fastest(timings: DataFrame) -> DataFrame:
    """(op, elements, engine): the fastest engine of (op, elements, engine, ms)."""
    return timings.groupBy("op", "elements").agg(F.min_by("engine", F.struct("ms", "engine")).alias("engine"))


def cat(record: DataFrame, values: DataFrame, address: str) -> DataFrame:
    """(id, data, note): what the last call that writes `address` left there. values: (id, address, kind, data, note); a value that wasn't
    kept has no data and says why. No row where nothing writes the address."""
    last = record.filter(F.array_contains("writes", address)).orderBy(F.desc("position")).limit(1).select("id")
    own = values.filter(F.col("address") == address).select("id", "kind", "data", "note")
    kept = F.col("data").isNotNull() & (F.col("kind") != "omitted")
    return last.join(own, "id", "left").select("id", F.when(kept, F.col("data")).alias("data"), F.when(~F.coalesce(kept, F.lit(False)), F.coalesce("note", F.lit("no value was kept"))).alias("note"))


def effects(record: DataFrame, ledgers: DataFrame, tick: str | None = None) -> DataFrame:
    """(position, tick, id, index, kind, what, digest): each effect of each call in the order in which they happened. ledgers: (id, entries)."""
    calls = record if tick is None else record.filter(F.col("tick") == tick)
    each = calls.join(ledgers, "id").select("position", "tick", "id", F.posexplode("entries").alias("index", "e"))
    return each.select("position", "tick", "id", F.col("index").cast("long").alias("index"), "e.kind", "e.what", "e.digest")


def delta(states: DataFrame) -> DataFrame:
    """Two end states compared. states: (state 'a' or 'b', kind 'capability' or 'cost', name, value). One row a_verified, a_points, a_cost, a_ratio,
    b_..., verdict: more verified behaviour wins, then more capability points, then less cost; else a tie."""
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("value"))), F.lit(0))
    capable, verified = F.col("kind") == "capability", F.col("name") == "verified"
    columns = []
    for s in "ab":
        own = F.col("state") == s
        columns += [of(own & capable & verified).alias(f"{s}_verified"), of(own & capable & ~verified).alias(f"{s}_points"), of(own & (F.col("kind") == "cost")).alias(f"{s}_cost")]
    one = states.agg(*columns)
    for s in "ab":
        one = one.withColumn(f"{s}_ratio", F.round(F.try_divide(F.col(f"{s}_verified"), F.nullif(f"{s}_cost", F.lit(0))), 4))
    worth = lambda s: F.struct(F.col(f"{s}_verified").alias("v"), F.col(f"{s}_points").alias("p"), (-F.col(f"{s}_cost")).alias("c"))
    return one.withColumn("verdict", F.when(worth("b") > worth("a"), "b").when(worth("a") > worth("b"), "a").otherwise("tie"))


def navigate(values: DataFrame) -> DataFrame:
    """(kind, vertical, n, failed, unjudged) of addresses px.<...>.<kind>.<vertical>...: how many there are, how many oracles failed and
    how many brackets have no winner. values: (address, pass, winner)."""
    part = F.split("address", r"\.")
    rows = values.select(F.get(part, F.lit(3)).alias("kind"), F.get(part, F.lit(4)).alias("vertical"), "pass", "winner")
    failed = F.count_if((F.col("kind") == "oracle") & ~F.coalesce("pass", F.lit(False)))
    return rows.groupBy("kind", "vertical").agg(F.count("*").alias("n"), failed.alias("failed"), F.count_if((F.col("kind") == "bracket") & F.col("winner").isNull()).alias("unjudged"))
