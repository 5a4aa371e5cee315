from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import common, quality_classifier, quality_rules, toxicity

DOCS = "doc_id long, text string, score string, kept int, source string"


def brute_statistics(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if __import__("re").search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(repeated)]


TEXTS = ["", None, " \n\t", "one two three", "a b c d e f a b c d e", "x x x x x x x", "é ü # | <b>\né ü # | <b>\n\n é", "a b c", "w " * 50, "l\nl\nl\r\nl\r", "a\x0bb\x0cc\x1cd"]


@pytest.mark.parametrize("text", TEXTS)
def test_statistics_match_brute_force(text):
    got = common.statistics(None if text is None else text.encode(), common.WordHashes())
    assert [int(x) for x in got[:5]] == brute_statistics(text)


def sample(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 1, (n, 3))
    return x, ((x[:, 0] < 0.6) & (x[:, 1] > 0.2)).astype(float)


def test_trees_fit_and_are_monotonic():
    x, y = sample()
    trees = quality_rules.fit(x, y, np.array([-1, 0, 0]), n_trees=20)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    grid = np.repeat(np.random.default_rng(2).uniform(0, 1, (50, 3)), 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(trees.raw(grid).reshape(50, 40), axis=1) <= 1e-12).all()


def test_flat_arrays_walk_like_a_recursive_tree():
    x, y = sample()
    trees = quality_rules.fit(x, y, np.zeros(3), n_trees=5)

    def walk(node, row):
        if trees.left[node] == node:
            return trees.value[node]
        return walk(trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node], row)

    assert np.allclose(trees.raw(x), [trees.base + sum(walk(r, row) for r in trees.roots) for row in x])


def test_factorisation_machine_identity():
    rng = np.random.default_rng(3)
    m = quality_classifier.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)), np.zeros(1), np.ones(1))
    idx, x = np.array([1, 4, 7, 2, 9]), rng.normal(size=5)
    pairs = sum(m.v[idx[i]] @ m.v[idx[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert np.isclose(m.raw(idx, x, np.array([0, 3]))[0], 0.3 + m.w[idx[:3]] @ x[:3] + pairs)


def naive_grams(text):
    """Hashed n-grams of code points of the distinct marked words, and in how many words each is, in plain integers."""
    full, out = (1 << 64) - 1, Counter()

    def mix(h):
        h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & full
        h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 & full
        return h ^ h >> 33

    for word in set((text or "").lower().split()):
        marked, own = "\n" + word + "\n", set()
        for n in toxicity.SIZES:
            for at in range(len(marked) - n + 1):
                h = 0
                for c in marked[at : at + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & full
                own.add(mix((h + n - 1) & full) >> (64 - toxicity.BITS))
        out.update(own)
    return out


@pytest.mark.parametrize("chunk", [65_536, 40])
def test_ngrams_and_scores_match_a_naive_scorer(monkeypatch, chunk):
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    letters = list("abÉß\u4e2d\U0001F600\x02'")
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(rng.integers(0, 60))) for _ in range(40)]
    texts += ["", None, " \n", "a", "banana banana", "\ud800x y", "".join(rng.choice(letters, 500)), "w" * 41 + " " + "ab" * 33]
    for t in texts:
        assert toxicity.doc_grams(t).tolist() == sorted(naive_grams(t))
    known = sorted(set().union(*map(naive_grams, texts)))
    chosen = np.array(known[::3])
    model = toxicity.Linear(chosen, rng.normal(size=len(chosen)), -0.3)
    score = toxicity.scorer(model)
    for _ in range(2):  # with and without remembered words
        got = score(texts)
        for t, p in zip(texts, got, strict=True):
            own = naive_grams(t)
            margin = -0.3 + sum(w * (1 + np.log(own[g])) for g, w in zip(chosen.tolist(), model.weight, strict=True) if g in own)
            assert abs(p - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))) < 1e-9


def test_ngrams_stay_in_their_words():
    ids, owner = toxicity.grams_of(["ab", "abc", "\u00e9"], sizes=(3, 4))
    assert np.bincount(owner, minlength=3).tolist() == [3, 5, 1]  # |ab| has 2 + 1, |abc| 3 + 2, one code point 1
    assert set(toxicity.grams_of(["ab"], sizes=(3,))[0]) & set(ids.tolist())


def test_toxic_words_are_found_in_very_long_texts(spark):
    docs, labels = corpus(spark)
    score = toxicity.scorer(toxicity.train(docs, labels))
    rng = np.random.default_rng(1)
    clean = " ".join(f"w{i}" for i in rng.integers(0, 60, 300_000))
    assert score([clean, clean + " grumsel", clean + "x" * 3_000_000])[0] < 0.5 < score([clean + " grumsel"])[0]


def test_fit_is_the_minimum_of_its_loss():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(200)]
    ratio = rng.normal(size=6)
    y = np.array([float(0 in r or rng.random() < 0.2) for r in rows])
    model = toxicity.fit(rows, [np.ones(len(r), int) for r in rows], y, np.arange(6), ratio, l2=0.05, steps=6000)
    scale = np.array([sum(ratio[j] ** 2 for r in rows if j in r) / len(y) for j in range(6)])

    def loss(w, b):
        margin = np.array([b + sum(ratio[j] * w[j] for j in r) for r in rows])
        return np.mean(np.logaddexp(0, margin) - y * margin) + 0.025 * np.sum(np.minimum(scale, 1) * w * w)

    w, best = model.weight / ratio, loss(model.weight / ratio, model.bias)
    for j in range(6):
        for step in (1e-2, -1e-2):
            assert loss(w + step * (np.arange(6) == j), model.bias) > best - 1e-6


def test_factorisation_machine_gradient():
    """One step from a start where the factors are known moves each parameter against the numeric gradient."""
    rng = np.random.default_rng(4)
    ids = [np.array([1, 5]), np.array([5, 9]), np.array([2]), np.array([1, 9])]
    values = [np.full(len(i), 1 / np.sqrt(len(i))) for i in ids]
    stats, y = rng.normal(size=(4, 2)), np.array([1.0, 0.0, 1.0, 0.0])
    start = quality_classifier.fit(ids, values, stats, y, epochs=0)
    moved = quality_classifier.fit(ids, values, stats, y, epochs=1, batch=4, l2=0.0, rate=1e-4)
    idx, x, at = start.features(ids, values, stats)

    def loss(m):
        margin = m.raw(idx, x, at)
        return np.mean(np.logaddexp(0, margin) - y * margin)

    base = loss(start)
    for place in sorted(set(idx.tolist())):
        for array, after in [(start.w, moved.w), *((start.v[:, f], moved.v[:, f]) for f in range(quality_classifier.RANK))]:
            was = array[place]
            array[place] = was + 1e-5
            slope = (loss(start) - base) / 1e-5
            array[place] = was
            if abs(slope) > 1e-4:
                assert np.sign(after[place] - was) == -np.sign(slope)
    assert loss(moved) < base


def test_repeated_labelled_rows_keep_the_sample_bounded(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    assert sorted(tuple(r) for r in common.labelled_sample(docs, labels, "quality", 10).collect()) == [(i, q, t) for i, q, t in [(1, 1, "a"), (2, 0, "c")] if __import__("zlib").crc32(str(i).encode()) % 5]


def corpus(spark):
    bad, rows, labels = ["grumsel", "grumseli", "grumselu"], [], []
    rng = np.random.default_rng(5)
    for i in range(240):
        words = [f"w{rng.integers(60)}" for _ in range(30)]
        toxic, low = i % 4 == 0, i % 3 == 0
        if toxic:
            words[7] = bad[i % 3]
        text = " ".join(w + ("%%%" if low else "") for w in words)
        rows.append((i, text, "x", 1, "s"))
        labels.append((i, int(not low), int(toxic)))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (None, "w1 w2", None, None, None), (1, rows[1][1], "x", 1, "s")]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_on_a_small_corpus(spark):
    docs, labels = corpus(spark)
    tox = {(r.doc_id, r.predicted) for r in toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert {i for i, p in tox if p == 1} == {i for i in range(240) if i % 4 == 0}
    fm = toxic_free = quality_classifier.quality_classifier(docs, quality_classifier.train(docs, labels)).collect()
    assert len(toxic_free) == docs.count()
    held = [(r.predicted, r.doc_id % 3 != 0) for r in fm if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert held and np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in fm)
    gbt = quality_rules.quality_rules(docs, quality_rules.train(docs, labels)).collect()
    assert {r.doc_id for r in gbt if r.base_failed} == {900, 901, None}
    assert np.mean([r.kept == (r.doc_id % 3 != 0) for r in gbt if r.doc_id is not None and r.doc_id < 240]) > 0.95


def test_empty_tables(spark):
    docs, labels = corpus(spark)
    none, unlabelled = docs.limit(0), labels.limit(0)
    assert toxicity.toxicity(none, toxicity.train(docs, unlabelled)).count() == 0
    assert quality_classifier.quality_classifier(none, quality_classifier.train(none, labels)).count() == 0
    assert quality_rules.quality_rules(none, quality_rules.train(none, unlabelled)).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, toxicity.train(docs, unlabelled)).collect()} <= {0, 1}


def test_row_filters_keep_all_columns(spark):
    docs, labels = corpus(spark)
    kept = toxicity.reject_toxic(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 240} == {i for i in range(240) if i % 4}
    good = quality_classifier.reject_low_quality(docs, quality_classifier.train(docs, labels))
    assert np.mean([r.doc_id % 3 != 0 for r in good.collect() if r.doc_id is not None and r.doc_id < 240]) > 0.95
