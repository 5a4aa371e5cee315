"""Graphs as vertices and edges tables: components, closure, transitions, motifs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..table import checkpointed, salted_join


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node that undirected edges (a, b) reach. Labels take the least label of their
    neighbours, then that label's own label, so their number of rounds grows with the logarithm of a path."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    label = both.select(F.col("a").alias("node")).union(nodes.select("node") if nodes is not None else both.select("b")).distinct().withColumn("component", F.col("node"))
    both, label = checkpointed(both), checkpointed(label)
    degree = both.groupBy("b").agg(F.count("*").alias("n"))
    total = None
    while True:
        of_b = label.withColumnRenamed("node", "b")
        near = salted_join(both, of_b, ["b"], degree, "a").groupBy("a").agg(F.min("component").alias("m"))
        step = label.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        step = checkpointed(step)
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
        size = step.groupBy("component").agg(F.count("*").alias("n"))
        new = checkpointed(salted_join(step, jump, ["component"], size, "node", "left").select("node", F.coalesce("next", "component").alias("component")))
        state = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "component"))).first()
        label = new
        if tuple(state) == total:
            return label
        total = tuple(state)


def closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): what directed edges (src, dst) reach from roots (node), safe on cycles."""
    seen = roots.select("node").distinct().withColumn("depth", F.lit(0))
    front, d = seen, 0
    while True:
        d += 1
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        step = checkpointed(step)
        if step.isEmpty():
            return seen
        seen, front = seen.union(step), step


def transitions(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_label, to_label, kind, n): how often edges join labels."""
    a, b = vertices.select(F.col("id").alias("src"), F.col("label").alias("from_label")), vertices.select(F.col("id").alias("dst"), F.col("label").alias("to_label"))
    return edges.join(a, "src").join(b, "dst").groupBy("from_label", "to_label", "kind").agg(F.count(F.lit(1)).alias("n"))


def match_all(vertices: DataFrame, edges: DataFrame, labels: list[str], pattern: list[tuple[int, int, str]]) -> DataFrame:
    """Instances of a labelled pattern (nodes 0 .., edges (i, j, kind)): columns v0 .., different vertices. A join per edge."""
    typed = edges.join(vertices.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").join(vertices.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst")
    out, known = None, set()
    for i, j, kind in pattern:
        e = typed.filter((F.col("kind") == kind) & (F.col("ls") == labels[i]) & (F.col("ld") == labels[j])).select(F.col("src").alias(f"v{i}"), F.col("dst").alias(f"v{j}"))
        on = [f"v{k}" for k in (i, j) if k in known]
        if out is not None and not on:
            raise ValueError("list the pattern's edges so that each touches an earlier one")
        out = e if out is None else out.join(e, on)
        known |= {i, j}
    names = [f"v{k}" for k in sorted(known)]
    return out.select(*names).filter(F.size(F.array_distinct(F.array(*names))) == len(names))


def best_substructure(vertices: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """Label pairs joined by an edge kind, by what naming them saves: (n - 1) * 3 symbols less n references."""
    t = transitions(vertices, edges).filter(F.col("n") >= least)
    return t.withColumn("saving", (F.col("n") - 1) * 3 - F.col("n")).orderBy(F.desc("saving"), "from_label", "to_label", "kind")
