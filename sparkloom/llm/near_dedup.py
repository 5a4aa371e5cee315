"""MinHash near-dedup with odd sketches.

1. Each document's set of word shingles is hashed; equal sets are one node, a number, from here on.
2. A node's MinHash samples give band keys, and are folded into an odd sketch: a bitmap in which each
   sample flips one bit, so that the population count of the exclusive or of two sketches estimates how
   many samples differ, which is precise for high similarities.
3. Candidates of a band bucket: in small buckets all pairs, in large ones each node with the bucket's hub.
   Candidates whose sketches can't reach the threshold are dropped (five standard errors of margin);
   the others are confirmed on full sets. Links are contracted to components.
4. In a large bucket that still holds several components, the members outside its largest one meet all in
   blocks of bounded size; within a block, intersections are counted on inverted lists and only the links that
   join components leave it. No link between different texts that share a bucket is lost, and no bucket is
   emitted as pairs.

Keys that hold many rows (a bucket, a hub, a component, a group of copies) are salted in every join.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..table import salted_join
from .common import MULT, WordHashes, bounded_batches, mix, shared_table, slices, texts_of, window_hashes

SHINGLE, BANDS, ROWS = 5, 25, 5
#: Bits of an odd sketch, kept as longs of 64.
BITS = 512
#: Nodes of a bucket whose pairs are all candidates.
SMALL = 16
#: Shingles of one block of a large bucket.
BLOCK_SHINGLES = 2_000_000
#: Rows of ids that are broadcast at most.
BROADCAST_ROWS = 500_000

_RNG = np.random.default_rng(20)
_A = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
SKETCH = [f"s{i}" for i in range(BITS // 64)]


def text_hashes() -> list[Column]:
    """128 bits of hash of the column text."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2")]


def shingles(text: bytes | None, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word k-shingles; A-Z count as lower case; with fewer words, the sequence is one."""
    return np.unique(window_hashes(hashes.array((text or b"").lower().split()), k))


def signature(grams: np.ndarray) -> np.ndarray:
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    low = (grams >> np.uint64(16)).astype(np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, (low[at : at + 512, None] * _A + _B).min(axis=0), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = key * MULT + mix(rows[:, j] + np.uint64(j + 1))
    return mix(key).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    bit = (mix(samples.astype(np.uint64) * MULT + np.arange(len(samples), dtype=np.uint64)) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def most_differing_bits(percent: int, errors: float = 5.0) -> int:
    """Population count up to which a pair at the threshold is kept, with `errors` standard errors of margin.

    The error has two independent parts: how many of the samples differ, and how many bits those flip.
    """
    k, t = BANDS * ROWS, percent / 100
    flipped = lambda apart: BITS / 2 * (1 - math.exp(-4 * apart / BITS))
    slope = 2 * math.exp(-4 * k * (1 - t) / BITS)
    middle = flipped(k * (1 - t))
    return math.ceil(middle + errors * math.sqrt(slope * slope * k * t * (1 - t) + middle / 2))


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, n_shingles, hi, lo, bands, s0 .. s7) of each row.

    t1 and t2 are 128 bits of hash of the text, hi and lo of its set, null where the set is empty.
    """
    bounded_batches(docs.sparkSession)
    longs = ["n_shingles", "hi", "lo"]
    own = docs.select("doc_id", *text_hashes(), "text")
    schema = T.StructType([*own.schema.fields[:3], *(T.StructField(c, T.LongType()) for c in longs), T.StructField("bands", T.ArrayType(T.LongType())), *(T.StructField(c, T.LongType()) for c in SKETCH)])
    none = np.zeros(len(SKETCH), np.int64)

    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            size, node, bands, sketch = [], [], [], []
            for text in texts_of(batch):
                grams = shingles(text, hashes)
                samples = signature(grams) if len(grams) else None
                size.append(len(grams))
                node.append(struct.unpack("<qq", xxhash.xxh3_128_digest(grams.tobytes())) if len(grams) else (None, None))
                bands.append(band_keys(samples) if len(grams) else None)
                sketch.append(odd_sketch(samples) if len(grams) else none)
            lanes = np.array(sketch, np.int64).reshape(-1, len(SKETCH))
            hi, lo = zip(*node, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(size, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(bands, pa.list_(pa.int64())), *(pa.array(lanes[:, i]) for i in range(len(SKETCH)))],
                names=schema.fieldNames(),
            )

    return own.mapInArrow(run, schema)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b), by alternating large and small stars until they stand still.

    root is the least node of the component. Each round is written to the shared folder, so a lost executor costs one round.
    """
    flat = lambda df: df.filter("u <> v").distinct()
    stars = shared_table(flat(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "stars")
    seen = None
    while True:
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = salted_join(both, least.drop("n"), ["u"], least.select("u", "n"), "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = shared_table(flat(large), "large-stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = salted_join(large, low.drop("n"), ["u"], low.select("u", "n"), "v")
        stars = shared_table(flat(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))), "stars")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v"), F.col("v")).distinct())


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["t1"] == b["t1"]) & (a["t2"] == b["t2"])


def texts_of_nodes(docs: DataFrame, wanted: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(node, text) of the distinct rows of `wanted` (node, doc_id, t1, t2). They are broadcast only up to a counted number of rows."""
    found = docs.select("doc_id", *text_hashes(), "text")
    few = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    return found.join(few, _same_row(found, wanted)).select("node", "text").groupBy("node").agg(F.min("text").alias("text"))


def for_both(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs (a, b) with the other columns of `values` (node, ...) of either side, as a_... and b_...; a hub's pairs are salted."""
    for side, by in (("a", "b"), ("b", "a")):
        own = values.select(*(F.col(c).alias(side if c == "node" else f"{side}_{c}") for c in values.columns))
        pairs = salted_join(pairs, own, [side], pairs.groupBy(side).agg(F.count("*").alias("n")), by)
    return pairs


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Shingles are compared by 64-bit hashes, so two sets of n shingles meet by chance with odds of n * n / 2^64 at most.
    """
    both = for_both(pairs, texts)

    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            keep, last, of_last = [], None, None
            for s, t in zip(texts_of(batch, "a_text"), texts_of(batch, "b_text"), strict=True):
                if t != last:
                    last, of_last = t, shingles(t, hashes)
                x = shingles(s, hashes)
                shared = len(np.intersect1d(x, of_last, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(of_last) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(mask)

    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def _links_of_block(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links that join different components between the probes and the others of one block, by counts on inverted lists."""
    hashes = WordHashes()
    node, root, probe = (table[c].to_pylist() for c in ("node", "root", "probe"))
    sets = [shingles(t, hashes) for t in table["text"].cast(pa.binary()).to_pylist()]
    parent = {r: r for r in root}

    def find(r):
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    others = [k for k, p in enumerate(probe) if not p]
    if not others:
        return []
    sizes = np.array([len(sets[k]) for k in others])
    flat = np.concatenate([sets[k] for k in others])
    order = np.argsort(flat, kind="stable")
    member = np.repeat(np.arange(len(others)), sizes)[order]
    grams, start = np.unique(flat[order], return_index=True)
    start = np.append(start, len(flat))
    links = []
    for x, is_probe in enumerate(probe):
        if not is_probe:
            continue
        at = np.searchsorted(grams, sets[x])
        known = at[grams[np.minimum(at, len(grams) - 1)] == sets[x]]
        if not len(known):
            continue
        shared = np.bincount(np.concatenate([member[a:b] for a, b in zip(start[known], start[known + 1], strict=True)]), minlength=len(others))
        for y in np.flatnonzero(100 * shared >= percent * (sizes + len(sets[x]) - shared)).tolist():
            p, q = find(root[x]), find(root[others[y]])
            if p != q:
                parent[p] = q
                links.append((node[x], node[others[y]]))
    return links


def links_between(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links across components within large buckets. rows: (key, node, root, n_shingles) of buckets of several components.

    Members of a bucket's largest component needn't meet each other: only the others, its outsiders, are probes, and
    meet all. Probes and members are dealt into blocks of about BLOCK_SHINGLES shingles by a hash of the node;
    each block of probes with each block of members is one group, so a group's size is bounded however large the
    bucket is, and a bucket with few outsiders is sent once.
    """
    parts = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("own"))
    blocks = lambda c: F.greatest(F.ceil(c / BLOCK_SHINGLES), F.lit(1)).cast("int")
    plan = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("giant"), F.sum("own").alias("all"), F.max_by("own", F.struct("n", "root")).alias("of_giant"))
    plan = shared_table(plan.select("key", "n", "giant", blocks(F.col("all")).alias("members"), blocks(F.col("all") - F.col("of_giant")).alias("probes")), "near-dedup-blocks")
    dealt = salted_join(rows.select("key", "node", "root"), plan.drop("n"), ["key"], plan.select("key", "n"), "node")
    place = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    members = dealt.select("key", place("members").alias("i"), every("probes").alias("j"), "node", "root", F.lit(False).alias("probe"))
    probes = dealt.filter("root <> giant").select("key", every("members").alias("i"), place("probes").alias("j"), "node", "root", F.lit(True).alias("probe"))

    def run(table: pa.Table) -> pa.Table:
        links = _links_of_block(table, percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return members.union(probes).join(texts, "node").select("key", "i", "j", "node", "root", "probe", "text").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def labelled(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, t1, t2, n_shingles, root, component_id) of each row of `docs`; root is null where the set is empty."""
    rows = shared_table(rows_of(docs), "near-dedup-rows")
    sets = rows.filter("hi is not null").groupBy("hi", "lo").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "t1", "t2")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), *(F.first(c).alias(c) for c in SKETCH))
    nodes = shared_table(sets.withColumn("node", F.monotonically_increasing_id()), "near-dedup-sets")  # numbers hold as the table is written once
    members = nodes.select("node", F.explode("bands").alias("key"))
    buckets = shared_table(members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).filter("n > 1"), "near-dedup-buckets")
    held = shared_table(salted_join(members, buckets, ["key"], buckets.select("key", "n"), "node"), "near-dedup-members")

    stars = held.filter((F.col("n") > SMALL) & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    listed = held.filter(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("all"))
    pairs = listed.select(F.posexplode("all").alias("i", "a"), "all").select("a", F.explode(F.slice("all", F.col("i") + 2, F.lit(SMALL))).alias("b"))
    pairs = shared_table(stars.union(pairs).distinct(), "near-dedup-pairs")

    apart = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SKETCH), F.lit(0))
    close = 100 * F.least("a_n_shingles", "b_n_shingles") >= percent * F.greatest("a_n_shingles", "b_n_shingles")
    likely = for_both(pairs, nodes.select("node", "n_shingles", *SKETCH)).filter(close & (apart <= most_differing_bits(percent)))
    likely = shared_table(likely.select("a", "b"), "near-dedup-candidates")

    large = held.filter(F.col("n") > SMALL).select("key", "node")
    of_large = buckets.filter(F.col("n") > SMALL).select("key", "n")
    wanted = likely.select(F.col("a").alias("node")).union(likely.select("b")).union(large.select("node")).distinct()
    texts = shared_table(texts_of_nodes(docs, shared_table(wanted.join(nodes.select("node", "row.*"), "node"), "near-dedup-wanted")), "near-dedup-texts")
    links = shared_table(confirmed(likely, texts, percent), "near-dedup-links")
    roots = connected(links)

    own = shared_table(large.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "near-dedup-large")
    mixed = own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    rest = salted_join(own, mixed, ["key"], of_large, "node").join(nodes.select("node", "n_shingles"), "node")
    rest = shared_table(rest, "near-dedup-mixed")
    if rest.limit(1).count():
        more = shared_table(links_between(rest, texts, percent), "near-dedup-more-links")
        if more.limit(1).count():
            roots = connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    label = nodes.select("node", "hi", "lo", "n", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    label = shared_table(label, "near-dedup-labels")
    least = label.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    label = shared_table(salted_join(label.drop("doc_id"), least.drop("n"), ["root"], least.select("root", "n"), "node"), "near-dedup-components")
    found = rows.select("doc_id", "t1", "t2", "n_shingles", "hi", "lo")
    out = salted_join(found.filter("hi is not null"), label.select("hi", "lo", "root", "component_id"), ["hi", "lo"], label.select("hi", "lo", "n"), "doc_id")
    none = found.filter("hi is null").withColumn("root", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    return out.unionByName(none).drop("hi", "lo").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of `docs`.

    component_id is the smallest doc_id that links reach, kept says whether it is the row's own. A null or
    empty text, or one without words, has no shingles and is linked with nothing. A text of any length is one set, in
    memory in proportion to it. Repeated rows have one set, hence one component, and those with its smallest doc_id
    are all kept. Null doc_ids never are the smallest of a component that has others. Other columns are ignored
    whatever their names; an empty table gives no rows.
    """
    return labelled(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, percent: int = 85, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row of each group of `docs`, all its columns: of those that `near_dedup` keeps the one whose text hashes
    least, once if it is repeated. Rows without words are in no group and all stay.

    Rows are told apart by doc_id (null is a value) and text, so other rows under a dropped row's doc_id stay. Those
    that go are broadcast only up to a counted number of rows; beyond it they meet the documents in a shuffled join.
    """
    rows = shared_table(labelled(docs, percent).filter("root is not null").select("doc_id", "t1", "t2", "root", "kept"), "near-dedup-verdicts")
    kept = rows.filter("kept")
    several = kept.groupBy("root").agg(F.count("*").alias("n"), F.min("t1").alias("least")).filter("n > 1")
    several = shared_table(salted_join(kept, several.drop("n"), ["root"], several.select("root", "n"), "t1"), "near-dedup-several")
    gone = rows.filter("not kept").select("doc_id", "t1", "t2").union(several.filter("t1 <> least").select("doc_id", "t1", "t2"))
    gone = shared_table(gone.distinct(), "near-dedup-gone")
    repeated = shared_table(several.filter("t1 = least").groupBy("doc_id", "t1", "t2").count().filter("count > 1").drop("count"), "near-dedup-repeated")

    few = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), "doc_id", *text_hashes())
    left = marked.join(few(gone), _same_row(marked, gone), "left_anti")
    if repeated.limit(1).count():
        once = left.join(few(repeated), _same_row(left, repeated), "left_semi").groupBy("doc_id", "t1", "t2").agg(F.first("whole").alias("whole"))
        left = left.join(few(repeated), _same_row(left, repeated), "left_anti").select("whole").union(once.select("whole"))
    return left.select("whole.*")
