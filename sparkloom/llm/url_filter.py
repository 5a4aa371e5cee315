"""URL filters by link-graph propagation, in DataFrame expressions only.

Rules judge the urls that they fit. Every host with ruled pages is a seed: of trust by the share of them that is
allowed, of distrust by the share that is blocked, so its weight doesn't depend on how many pages it has.
Personalised PageRank carries trust along the edges between hosts and distrust against them; a host is blocked
where its distrust passes the threshold and its trust. Edges are the links of the pages, relative ones read
against the page's base, and a host's tie to the domain right above it where that domain has pages of its own
(so a public suffix, which has none, ties nobody).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..table import salted_join
from .common import remove_shared, shared_table, write_shared

#: (host, path, verdict) of the registered query (fixed values).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-9, 0.25
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCHEME = r"[a-z][a-z0-9+.\-]*:"
_HREF = r"""\s[^<>]*?\bhref\s*=\s*["']?\s*"""
_HOST = rf"""(?:{_SCHEME})?//([^/?#"'\s<>]+)"""
_LINK, _BASE = rf"(?is)<a{_HREF}{_HOST}", rf"(?is)<base{_HREF}{_HOST}"
_RELATIVE = rf"""(?is)<a{_HREF}(?!{_SCHEME}|//|#|["'\s>])"""
#: Edges that one task of a round takes: small graphs are walked by few tasks.
EDGES_PER_TASK = 500_000
#: Hosts up to which the scores are broadcast.
BROADCAST_HOSTS = 200_000


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as host and path; null where none does."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    return F.coalesce(*(F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(h + p)) for h, p, _ in longest), F.lit(None).cast("string"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict or null)."""
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    blocks = [h + p for h, p, v in rules if v == "block"]
    return rows.withColumn("ruled", F.when(F.col("rule").isin(blocks), F.lit("block")).when(F.col("rule").isNotNull(), F.lit("allow")))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, n): links of pages to other hosts, counted, and both ways between a host and the domain above it.

    A relative link leads to the page's own host, unless a base element names another one. hosts: (host).
    """
    rows = pages.select(host(F.col("url")).alias("src"), "html")
    absolute = rows.select("src", F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("dst"), F.lit(1).cast("long").alias("n"))
    based = rows.select("src", F.regexp_extract("html", _BASE, 1).alias("dst"), F.regexp_count("html", F.lit(_RELATIVE)).cast("long").alias("n")).filter("dst <> '' and n > 0")
    links = absolute.union(based).select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"), "n").filter("src <> '' and src <> dst")
    above = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("dst"))
    above = above.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst", F.lit(1).cast("long").alias("n"))
    return links.union(above).union(above.select("dst", "src", "n")).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, every: int = 8) -> DataFrame:
    """(host, kind, r): personalised PageRank of kind 't' along the edges and of kind 'd' against them, from seeds (host, kind)
    or (host, kind, r).

    A seed gives itself r, 1 where there is none, so a rank is in units of one seed: it says how much of how many
    seeds reaches a host, doesn't shrink as the graph grows, and may pass 1. A host without edges of a kind passes
    nothing on. Lineage is cut every few rounds in the shared folder, and the table before is deleted; the rounds
    end when no rank changes by more than the tolerance, or after `rounds` where that is given: as a round
    multiplies all changes by the damping at most, they always end.
    """
    spark = edges.sparkSession
    steps = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.lit("t").alias("kind"), "n").union(edges.select("dst", "src", F.lit("d"), "n"))
    out = steps.groupBy("host", "kind").agg(F.sum("n").alias("all"))
    steps = shared_table(steps.join(out, ["host", "kind"]).select("host", "kind", "to", (damping * F.col("n") / F.col("all")).alias("p")), "url-steps")
    base = shared_table(seeds.select("host", "kind", (F.col("r") if "r" in seeds.columns else F.lit(1.0)).alias("r")), "url-seeds")
    tasks = math.ceil((steps.count() + base.count()) / EDGES_PER_TASK) or 1
    steps, base = steps.coalesce(tasks), base.coalesce(tasks)
    rank, path, done = base, None, 0
    while rounds is None or done < rounds:
        done += every
        fresh = rank
        for _ in range(every):
            moved = fresh.join(steps, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("r") * F.col("p")).alias("r"))
            fresh = base.union(moved).coalesce(tasks).groupBy("host", "kind").agg(F.sum("r").alias("r")).coalesce(tasks)
        written = write_shared(fresh, "url-rank")
        fresh = spark.read.schema(base.schema).parquet(written).coalesce(tasks)
        change = fresh.union(rank.select("host", "kind", -F.col("r"))).coalesce(tasks).groupBy("host", "kind").agg(F.abs(F.sum("r")).alias("x")).agg(F.max("x")).first()[0]
        if path:
            remove_shared(spark, path)
        rank, path = fresh, written
        if change is None or change <= TOLERANCE:
            break
    return rank


def url_filter(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each row of `pages`.

    A null url, or one without ://, has an empty host and path, fits no rule and is allowed. A null page has no
    links; one of any length is searched whole, in one pass. Of rules that fit the longest wins, of equally long ones
    the first by host and path; a distrust that only equals the trust doesn't block. Repeated rows are judged each
    and their links count each; other columns are ignored whatever their names; an empty table gives no rows. Rules
    become one expression, so they are meant to be some hundreds at most.
    """
    rows = judged(pages, rules)
    share = lambda v: F.avg((F.col("ruled") == v).cast("double"))  # of the ruled pages, null where there are none
    hosts = shared_table(rows.groupBy("host").agg(F.count("*").alias("n"), share("allow").alias("allow"), share("block").alias("block")), "url-hosts")
    known = hosts.filter("host <> ''")
    seeds = known.filter("allow > 0").select("host", F.lit("t").alias("kind"), F.col("allow").alias("r")).union(known.filter("block > 0").select("host", F.lit("d").alias("kind"), F.col("block").alias("r")))
    rank = propagate(host_edges(pages, known.select("host")), seeds)
    rank = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "t", F.round("r", 9))).alias("trust"), F.sum(F.when(F.col("kind") == "d", F.round("r", 9))).alias("distrust"))
    scores = hosts.select("host", "n").join(rank, "host", "left").select("host", "n", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    scores = shared_table(scores, "url-scores")
    if scores.count() <= BROADCAST_HOSTS:
        out = rows.join(F.broadcast(scores), "host")
    else:
        out = salted_join(rows, scores, ["host"], scores.select("host", "n"), "page_id")
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "trust", "distrust")
