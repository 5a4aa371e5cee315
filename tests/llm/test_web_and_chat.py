import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import chat, html_extract, url_filter

CONFLICT = "\\### Assistant: </turn> ok"
BITS = ["### ", "###", "</turn>", "\\", "\n", " ", "User: ", "Assistant", "#", "<", "x", " </turn>\n", "é"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "odd: ###\n", "=\""]), st.lists(st.sampled_from(BITS), max_size=12).map("".join)), max_size=5))
def test_round_trip(turns):
    assert chat.parse("".join(chat.render(r, t) for r, t in turns)) == turns


@pytest.mark.parametrize("text", ["x", "### User: x", "### User: x </turn>", "### User: ### </turn>\n", "### Nobody: x </turn>\n", "### User: a </turn>\nrest"])
def test_what_is_not_in_the_grammar(text):
    with pytest.raises(chat.GrammarError):
        chat.parse(text)


def test_digests(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "he### llo"), (1, 2, None, None), (-7, 0, "user", CONFLICT), (-7, 1, "assistant", CONFLICT), (None, 5, "assistant", "z")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    out = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    for conv in (1, -7, None):
        own = [(r or "", t or "") for c, _, r, t in turns if c == conv]
        assert out[conv].n_turns == len(own)
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        loss = "".join(t for r, t in own if r == "assistant")
        assert (out[conv].loss_chars, out[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- c --><article><h1>Head {0}</h1><p><b>First&nbsp;line<br>next &lt;b&gt; {0}<p>Second <i>pa</i>rt &amp;amp; &eacute;<form><input>send</form><aside>side</aside></p>
<div class="comments"><p>reader says</p></div></article><footer>foot</footer></body></html>"""


def test_main_text():
    want = "Head 7 First line next <b> 7 Second part &amp; é"
    assert html_extract.main_text(PAGE.format(7), set()) == want
    assert html_extract.main_text("", set()) == ""
    assert html_extract.main_text("<p>a  b</p>c<div id='sidebar'>no</div> d &copy", set()) == "a b c d ©"
    assert html_extract.main_text("<p>open <b>and <script>x < y", set()) == "open and"


def test_template_text_goes_where_pages_have_no_article(spark):
    page = "<html><body><div class='top'>Welcome to the site</div><div class='text'><p>Story {0} alone</p></div><div class='end'>All rights kept</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i), 1) for i in range(8)] + [(100, None, None, 1), (101, "http://solo.example/", "<p>only</p>", 1), (3, "http://h.example/3", page.format(3), 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(3)
    for limit in (16 << 20, 0):
        out = sorted((r.page_id, r.text) for r in html_extract.extract(pages, broadcast_bytes=limit, salts=4).collect())
        assert out == sorted([(i, f"Story {i} alone") for i in [*range(8), 3]] + [(100, ""), (101, "only")])
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_article_text_is_never_template(spark):
    pages = spark.createDataFrame([(i, "http://h/", PAGE.format(1)) for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract(pages).collect()} == {html_extract.main_text(PAGE.format(1), set())}


def test_repeated_text_inside_an_article_goes(spark):
    notice = "This story is part of a series and may not be copied. " * 6
    page = "<html><body><article><h1>Head {0}</h1>{1}<p>" + notice + "</p></article></body></html>"
    made = {i: page.format(i, "".join(f"<p>Part {k} of {i}</p>" for k in range(i + 1))) for i in range(6)}
    rows = [(i, "http://h.example/", p) for i, p in made.items()] + [(9, "http://solo.example/", made[0])] + [(20 + i, "http://copies.example/", made[0]) for i in range(6)]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in made:
        assert out[i] == " ".join([f"Head {i}", *(f"Part {k} of {i}" for k in range(i + 1))])
    assert all(out[i] == f"Head 0 Part 0 of 0 {notice.strip()}" for i in (9, *range(20, 26)))


def test_tags_and_words_only_rank():
    assert html_extract.main_text('<body><div class="share-page"><article class="social">Story of the day</article></div><p>x</p></body>', set()) == "Story of the day"
    assert html_extract.main_text('<form id="all"><div>Whole page</div></form>', set()) == "Whole page"
    assert html_extract.main_text('<nav>menu</nav><article></article><div class="ad">buy</div>', set()) == ""
    assert html_extract.main_text('<div>Long story here</div><div class="comments"><article class="comment">hi</article></div>', set()) == "Long story here"


def brute_template(pages, share=0.6, least=3):
    """Tokens of the valid classes of one host: equal occurrence vectors over its distinct pages, compared as vectors."""
    pages = sorted(set(pages))
    counts, parent, size = {}, {}, {}
    for k, page in enumerate(pages):
        for event in html_extract.blocks(page):
            if event[0] == "tag":
                token, parent[token], size[token] = event[1].path, event[1].parent, 2
            else:
                token = html_extract.digest(event[1], event[2].path & (1 << 63) - 1)
                parent[token], size[token] = event[2].path, 1 + (" " in event[1])
            counts.setdefault(token, [0] * len(pages))[k] += 1
    frequent = {t: tuple(v) for t, v in counts.items() if sum(map(bool, v)) >= max(least, share * len(pages))}
    found = {t for t, v in frequent.items() if sum(size[u] for u, w in frequent.items() if w == v) > 1}
    while bad := {t for t in found if parent[t] and parent[t] not in found}:
        found -= bad
    return found


def test_equivalence_classes_match_brute_force(spark):
    import random

    rng, rows, hosts = random.Random(11), [], {}
    for h in range(4):
        for _ in range(3 + 3 * h):
            body = "".join(rng.choice([f"<p>own {rng.random()}</p>", "<p>shared words</p>", "<div class=box><p>one</p></div>", "<ul><li>a b</li><li>c</li></ul>", "<table><tr><td>x y</td></table>"]) for _ in range(rng.randrange(1, 6)))
            page = f"<body><div id=top>Site {h}</div><article>{body}</article><div>end of page</div></body>"
            hosts.setdefault(f"h{h}", []).append(page)
            rows += [(len(rows) + k, f"http://h{h}/", page) for k in range(rng.choice([1, 1, 2, 4]))]
    known = {r.host: html_extract.nested([t.asDict() for t in r.tokens]) for r in html_extract.templates(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(known) == 4 and all(known.values())
    for host, pages in hosts.items():
        assert known[host] == brute_template(pages), host
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: html_extract.main_text(p, brute_template(hosts[u.split("/")[2]])) for i, u, p in rows}


def test_slots_lie_between_template_tokens():
    pages = [f"<body><div class=top>Site</div><div><p>first {i}</p><p>second {i}</p></div><section><p>third {i}</p></section></body>" for i in range(4)]
    template = brute_template(pages)
    assert [t for _, t in html_extract.slots_of(pages[0], template)[0]] == [["first 0"], ["second 0"], ["third 0"]]
    assert [t for _, t in html_extract.slots_of(pages[0], set())[0]] == [["Site", "first 0", "second 0", "third 0"]]


@pytest.mark.parametrize("page", ["<a " * 200_000, "<!" * 200_000, "<x" * 200_000, "<a '" * 100_001, '<a x="' * 100_001, "<div>" * 50_000 + "</p>" * 50_000, "<b><div>" * 50_000, "<b>" * 100_000 + "<p>x", "</script " * 100_000, "<script>" + "</script" * 100_000, "&" * 500_000, "<" + "y" * 500_000])
def test_long_broken_markup_is_read_in_one_pass(page):
    import time

    t = time.perf_counter()
    html_extract.main_text(page, set())
    assert time.perf_counter() - t < 10


def test_long_turns_are_read_in_one_pass():
    for text in ("\\" * 1_000_000, "\\" * 500_000 + "###", ("\\" * 50 + "###") * 20_000, "#" * 1_000_000):
        assert chat.parse(chat.render("assistant", text)) == [("assistant", text)]


URLS = [
    ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"), ("https://example.net/de/", "example.net", "/de/", "net/", "block"),
    ("http://x.example.com/de/1", "x.example.com", "/de/1", "example.com/de/", "block"), ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("http://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"), ("http://a.net", "a.net", "", None, "block"), ("//a.net/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
]


def test_rules_and_seeds(spark):
    pages = spark.createDataFrame([(i, u[0], None, "x") for i, u in enumerate(URLS)] + [(50 + i, "http://a.net/de/", "<p>", "x") for i in range(3)], "page_id long, url string, html string, rule string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert out[i] == (host, path, rule, verdict), URLS[i]
    assert url_filter.url_filter(pages.limit(0)).count() == 0


def test_propagation_matches_power_iteration(spark):
    import numpy as np

    edges = [("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("c", "a", 3), ("d", "b", 1)]
    seeds = [("a", "t"), ("b", "d")]
    got = {(r.host, r.kind): r.r for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, kind string"), rounds=60).collect()}
    names = "abcd"
    for kind in "td":
        m = np.zeros((4, 4))
        for s, d, n in edges:
            m[(names.index(d), names.index(s)) if kind == "t" else (names.index(s), names.index(d))] += n
        m = m / np.maximum(m.sum(0), 1e-300)
        base = np.array([1.0 * ((h, kind) in seeds) for h in names])
        x = base
        for _ in range(400):
            x = base + 0.85 * m @ x
        for i, h in enumerate(names):
            assert abs(got.get((h, kind), 0.0) - x[i]) < 1e-3


def test_links_carry_distrust_backwards(spark):
    pages = [(1, "http://bad.net/x", "")] + [(2, "http://feeder.info/p", '<a href="http://bad.net/1">x</a>'), (3, "http://clean.info/p", '<a href="/local">y</a>')]
    out = {r.page_id: r.verdict for r in url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == {1: "block", 2: "block", 3: "allow"}


def test_hosts_with_few_ruled_pages_are_seeds(spark):
    for n in (1, 40):  # pages that no rule fits for each that is blocked
        urls = ["http://a.example.com/de/", "http://t.org/fr/", "http://example.com/en/"] + [u for i in range(n) for u in (f"http://a.example.com/en/{i}", f"http://b.example.com/en/{i}", f"http://t.org/en/{i}", f"http://free.info/en/{i}")]
        pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
        out = {(r.host, r.rule is None): r.verdict for r in url_filter.url_filter(pages).collect()}
        assert out == {("a.example.com", False): "block", ("a.example.com", True): "block", ("example.com", True): "block", ("b.example.com", True): "block", ("t.org", False): "allow", ("t.org", True): "allow", ("free.info", True): "allow"}


def test_rounds_end_by_the_tolerance(spark):
    cycle = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    got = {r.host: r.r for r in url_filter.propagate(cycle, spark.createDataFrame([("a", "t")], "host string, kind string")).collect()}
    assert abs(got["a"] - 1 / (1 - 0.85**2)) < 1e-8 and abs(got["b"] - 0.85 / (1 - 0.85**2)) < 1e-8
    path = spark.createDataFrame([(f"h{i:02}", f"h{i + 1:02}", 1) for i in range(30)], "src string, dst string, n long")
    assert url_filter.propagate(path, spark.createDataFrame([("h00", "t")], "host string, kind string")).count() == 31


def test_a_domain_without_pages_ties_nobody(spark):
    urls = ["http://a.co.net/de/", "http://b.co.org/en/", "http://c.example.com/de/", "http://d.example.com/en/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.url_filter(pages).collect()} == {0: "block", 1: "allow", 2: "block", 3: "allow"}


def test_relative_links_follow_the_base(spark):
    html = '<base href="//Bad.net/x"><a href="/1">x</a><a class="k" href=two>x</a><a href="#top">x</a><a href="https://Other.info/">x</a><a href=\'mailto:x@y\'>m</a>'
    pages = spark.createDataFrame([(1, "http://feeder.info/p", html), (2, "http://plain.info/", '<a href="/1">x</a>')], "page_id long, url string, html string")
    got = sorted(tuple(r) for r in url_filter.host_edges(pages, spark.createDataFrame([("feeder.info",)], "host string")).collect())
    assert got == [("feeder.info", "bad.net", 2), ("feeder.info", "other.info", 1)]


@pytest.mark.parametrize("broadcast_hosts", [200_000, 0])
def test_verdicts_match_power_iteration(spark, monkeypatch, broadcast_hosts):
    import random
    from collections import Counter

    monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", broadcast_hosts)
    rng = random.Random(8)
    names = [f"{p}h{i}.{t}" for i in range(5) for t in ("net", "org", "example.com") for p in ("", "www.")]
    rows = []
    for i in range(400):
        links = "".join(f'<a href="http://{rng.choice(names)}/x">l</a>' for _ in range(rng.randrange(3)))
        rows.append((i, f"https://{rng.choice(names)}/{rng.choice(['en', 'de', 'fr'])}/{i}", links))
    ruled = lambda h, p: "block" if h.endswith("net") or h.endswith("example.com") and p == "de" else "allow" if h.endswith("org") and p == "fr" else None
    page = {i: (u.split("/")[2], ruled(u.split("/")[2], u.split("/")[3])) for i, u, _ in rows}
    hosts = sorted({h for h, _ in page.values()} | set(names))
    edges = Counter()
    for i, _, html in rows:
        edges.update((page[i][0], part.split("/")[2]) for part in html.split('href="')[1:] if part.split("/")[2] != page[i][0])
    present = {h for h, _ in page.values()}
    for h in present:
        if h.split(".", 1)[1] in present:
            edges.update([(h, h.split(".", 1)[1]), (h.split(".", 1)[1], h)])
    rank = {}
    for kind, verdict in (("t", "allow"), ("d", "block")):
        steps = Counter()
        for (a, b), n in edges.items():
            steps[(a, b) if kind == "t" else (b, a)] += n
        out = Counter()
        for (a, _), n in steps.items():
            out[a] += n
        own = {h: [v for g, v in page.values() if g == h and v] for h in hosts}
        base = {h: own[h].count(verdict) / len(own[h]) if own[h] else 0.0 for h in hosts}
        r = dict(base)
        for _ in range(300):
            fresh = dict(base)
            for (a, b), n in steps.items():
                fresh[b] += 0.85 * r[a] * n / out[a]
            r = fresh
        rank[kind] = r
    got = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i, (h, v) in page.items():
        t, d = rank["t"][h], rank["d"][h]
        assert abs(got[i].trust - t) < 1e-7 and abs(got[i].distrust - d) < 1e-7
        assert got[i].verdict == (v or ("block" if d >= 0.25 and d > t else "allow"))
