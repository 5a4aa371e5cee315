import random
import re
from collections import Counter

import pytest

from sparkloom import table
from sparkloom.llm import fingerprints, near_dedup


def brute_components(rows, percent=85):
    sets = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and sets[j] and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if sets[i] and doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(s), (least.get(find(i)) if s else d)) for i, (s, (d, _)) in enumerate(zip(sets, rows, strict=True))), key=repr)


def corpus(seed, families=6, copies=14, length=60, edits=4):
    rng, rows = random.Random(seed), []
    for f in range(families):
        base = [f"w{f}x{rng.randrange(40)}" for _ in range(length)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(edits)):
                words[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, " \t", "Two words", "two WORDS", "two words"])]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, "other text under the same id"), (1000, rows[20][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small,block,key_rows", [(16, 2_000_000, 1000), (3, 600, 7)])
def test_components_match_brute_force(spark, monkeypatch, small, block, key_rows):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(table, "KEY_ROWS", key_rows)
    rows = corpus(small)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, node string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs).collect()), key=repr)
    assert got == brute_components(rows)


def test_near_dedup_edges(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g"), (4, "A B C d e f g")], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dedup.near_dedup(docs).collect()) == [(4, 3, 4, True), (5, 3, 4, False)]
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0
    assert [r.doc_id for r in near_dedup.drop_near_duplicates(docs).collect()] == [4]


def test_dropped_rows_are_those_that_are_not_kept(spark):
    rows = corpus(5, families=3, copies=6)
    t = rows[0][1] or "a b c d e f"
    rows += [(None, ""), (None, ""), (7000, "q w e r t y"), (7000, "Q W e r t y"), (7000, "q w e r t y"), (7001, "q w e r t y"), (7001, "else under this id"), (None, t)]
    docs = spark.createDataFrame([(d, x, i, "x") for i, (d, x) in enumerate(rows)], "doc_id long, text string, row int, root string").repartition(3)
    verdict = {(r.doc_id, r.n_shingles, r.component_id): r.kept for r in near_dedup.near_dedup(docs).collect()}
    stay = near_dedup.drop_near_duplicates(docs).collect()
    assert stay[0].__fields__ == docs.columns and len({r.row for r in stay}) == len(stay)
    parts = {}
    for i, (group, d, n, c) in enumerate(in_order(rows)):
        parts.setdefault(("row", i) if not n else ("group", group), []).append((i, d, n, c))
    left = {r.row for r in stay}
    for key, members in parts.items():
        kept = [i for i, *v in members if verdict[tuple(v)]]
        assert len(left & {i for i, *_ in members}) == 1 and left & {i for i, *_ in members} <= set(kept), key
    assert near_dedup.drop_near_duplicates(docs, broadcast_rows=0).count() == len(stay)


def in_order(rows):
    """(group, doc_id, n_shingles, component_id) of each row, in the order of `rows`."""
    groups = {}
    by_place = sorted(brute_components([(k, x) for k, (_, x) in enumerate(rows)]))
    for k, n, c in by_place:
        groups.setdefault(c, []).append(rows[k][0])
    least = {c: min((d for d in ids if d is not None), default=None) for c, ids in groups.items()}
    return [(c, rows[k][0], n, least[c] if n else rows[k][0]) for k, n, c in by_place]


def test_very_long_and_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(table, "KEY_ROWS", 10)
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, long + " tail"), (3, "x" * 3_000_000)] + [(10 + i, "same five words or more here") for i in range(200)]
    out = {r.doc_id: r for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[2].component_id, out[2].n_shingles, out[3].component_id) == (1, 299_997, 3)
    assert {out[10 + i].component_id for i in range(200)} == {10}


def test_odd_sketch_estimates_high_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near, far = a.copy(), a.copy()
    near[:10], far[:200] = rng.integers(0, 1 << 63, 10, dtype=np.uint64), rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    bits = lambda x: np.unpackbits(near_dedup.odd_sketch(near_dedup.signature(np.unique(x))).view(np.uint8))
    gap = lambda x: int((bits(a) ^ bits(x)).sum())
    assert gap(a) == 0 and gap(near) <= near_dedup.most_differing_bits(85) < gap(far)


def brute_winnow(spark, text, k=fingerprints.K, w=fingerprints.W):
    """The chosen (hash, position) pairs by the textbook: the rightmost least hash of each window."""
    from pyspark.sql import functions as F

    words = re.split("[ \t\n\x0b\f\r]+", text.strip(" \t\n\x0b\f\r")) if text.strip(" \t\n\x0b\f\r") else []
    if not words:
        return []
    spread = spark.createDataFrame([(i, words[i : i + k]) for i in range(max(1, len(words) - k + 1))], "i int, g array<string>")
    hashed = spread.select("i", (F.xxhash64(*(F.xxhash64(F.get("g", F.lit(j))) if False else F.when(F.size("g") > j, F.xxhash64(F.get("g", F.lit(j)))) for j in range(k))).bitwiseAND((1 << 31) - 1)).alias("h"))
    h = [r.h for r in hashed.orderBy("i").collect()]
    chosen = []
    for at in range(max(1, len(h) - w + 1)):
        window = list(enumerate(h[at : at + w], at))
        best = min(window, key=lambda p: (p[1], -p[0]))
        if (best[1], best[0]) not in chosen:
            chosen.append((best[1], best[0]))
    return chosen


@pytest.mark.parametrize("text", ["", "one", "a b c", " a b  c\nd e f g h i j k l m n o p ", "x " * 40, "the cat sat on the mat " * 6])
def test_winnowing_matches_the_textbook(spark, text):
    df = fingerprints.add_fingerprint(spark.createDataFrame([(text,)], "text string"), "text", "fp")
    got = df.select(fingerprints.positions(df.fp).alias("p"), *[df.fp]).first()
    assert [(x >> 32, p) for x, p in zip(got.fp, got.p, strict=True)] == brute_winnow(spark, text)


def test_shared_run_is_found(spark):
    rng = random.Random(3)
    run = [f"r{i}" for i in range(fingerprints.K + fingerprints.W - 1)]
    for _ in range(5):
        a = [f"a{rng.randrange(999)}" for _ in range(30)]
        b = [f"b{rng.randrange(999)}" for _ in range(25)]
        a[7:7], b[11:11] = run, run
        df = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string")
        df = fingerprints.add_fingerprint(fingerprints.add_fingerprint(df, "a", "fa"), "b", "fb")
        assert df.select(fingerprints.likeness(df.fa, df.fb)).first()[0] > 0


@pytest.mark.parametrize("spread", ["wide", "clumps", "even"])
def test_edited_texts_follow_doc_id(spark, monkeypatch, spread):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 1)
    place = {"even": lambda i: i, "clumps": lambda i: i if i < 200 else 10**17 + 10**9 * i, "wide": lambda i: -(2**63) if i == 0 else 2**63 - 1 - i if i % 2 else -(2**62) + i}[spread]
    texts = {place(i): f"text number {i} " + "word " * (i % 7) + "é" * (i % 5) for i in range(240)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(5)
    ids = sorted(texts)
    want = {}
    for k, i in enumerate(ids):
        t, n = texts[i], texts[ids[(k + 1) % len(ids)]]
        q = len(t) // 4
        want[i] = (len(t), t[: len(t) - q] + n[:q])
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert {i: (r.n_chars, r.edited) for i, r in got.items()} == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def test_fingerprint_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 0), (2, "a b c d e", 1), (2, "a b c d e", 1)], "doc_id long, text string, bucket int")
    rows = fingerprints.fingerprints(docs).collect()
    assert Counter(r.doc_id for r in rows) == {1: 1, 2: 3, None: 1}
    same = [tuple(r.fp) for r in rows if r.doc_id == 2 and r.n_chars == 9]
    assert len(same) == 2 and same[0] == same[1]
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    found = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame([(1, long), (2, "x" * 2_000_000)], "doc_id long, text string")).collect()}
    assert found[1].near_edited > 0.5 and len(found[1].fp) > 20_000 and len(found[2].fp) == 1
    one = fingerprints.fingerprints(spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0
