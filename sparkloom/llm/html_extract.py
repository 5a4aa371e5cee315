"""HTML extraction by equivalence classes.

First pass: each page is a sequence of tokens, tags with the path of elements that they stand in, and text
blocks of any length with their path. Tokens with the same occurrence vector over the distinct pages of a host
(compared by an order-free hash of page and count) form an equivalence class; copies of a page are one page,
as they don't tell what varies. Classes that are frequent and nest (each token's parent is in the template too)
make up the host's template. Second pass: text that belongs to the template goes, on every page and inside the
article too; the text between template tokens lies in slots. Tags and words of class, id and role only rank
the slots, and the best rank that holds text is the page's text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, shared_table, slices

#: Elements and words of class, id or role whose slots rank last (fixed values).
BOILERPLATE_TAGS = {"head", "title", "nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "button", "select", "textarea", "menu", "dialog", "object", "canvas"}
BOILERPLATE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "signup", "comment", "comments", "reply",
    "replies", "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "share", "sharing", "social", "related", "recommended", "contentinfo", "complementary", "search",
}
#: Elements whose content is not markup, elements without content, and elements inside a line of text (fixed values).
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
MAIN = {"article", "main"}
#: An open element of the first kind ends when one of the second begins.
IMPLIED_END = {"p": {"p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "footer", "header", "nav", "aside", "form"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

#: For each element, the open ones that it ends.
ENDS = {tag: [t for t, ends in IMPLIED_END.items() if tag in ends] for tag in set().union(*IMPLIED_END.values())}

# possessive, and an unclosed tag ends where the next begins, so that a page is read in one pass
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Node:
    tag: str
    path: int  # hash of the element and those around it
    parent: int
    tagged: bool = False  # in a boilerplate element
    worded: bool = False  # in an element with a boilerplate word
    main: bool = False
    inner: bool = False  # such a word stands inside the main element, not only on or above it

    @property
    def rank(self) -> int:
        """0 main, 1 body, 2 main in boilerplate words, 3 boilerplate words, 4 boilerplate elements."""
        if self.tagged:
            return 4
        if not self.worded:
            return 0 if self.main else 1
        return 2 if self.main and not self.inner else 3


def digest(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text, seed) - (1 << 63)


def blocks(page: str):
    """Yields ("tag", node) as elements open and ("text", text, node) for each block of text, in page order."""
    root = Node("", 0, 0)
    stack, text, at, opened = [root], [], 0, Counter()

    def flush():
        joined = " ".join("".join(text).split())
        text.clear()
        return joined

    position = 0
    while True:
        m = _MARKUP.search(page, position)
        raw = page[at : m.start() if m else len(page)]
        if raw:
            text.append(html.unescape(raw))
        if not m:
            break
        at = position = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        block = tag not in INLINE
        if block and (joined := flush()):
            yield "text", joined, stack[-1]
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    gone = slice(k, None if block else k + 1)
                    opened.subtract(n.tag for n in stack[gone])
                    del stack[gone]
                    break
                if block is False and stack[k].tag not in INLINE:
                    break
        else:
            if tag in VOID:
                continue
            if block:
                while len(stack) > 1 and (stack[-1].tag in INLINE or tag in IMPLIED_END.get(stack[-1].tag, ())):
                    if stack[-1].tag in INLINE and not any(opened[t] for t in ENDS.get(tag, ())):
                        break
                    opened[stack.pop().tag] -= 1
            names = [w for _, v in _ATTRIBUTE.findall(m[3]) for w in _PIECES.findall(v)] if m[3] else []
            words = {w.lower() for w in names}
            top = stack[-1]
            word = bool(words & BOILERPLATE_WORDS and tag not in ("html", "body"))
            standing = (top.tagged or tag in BOILERPLATE_TAGS, top.worded or word, top.main or tag in MAIN, top.inner or top.main and word)
            label = tag + "." + ".".join(sorted(w for w in words if not w.isdigit()))
            if block:
                node = Node(tag, digest(label, top.path & (1 << 63) - 1), top.path, *standing)
                yield "tag", node
            else:
                node = Node(tag, top.path, top.parent, *standing[:2], top.main, standing[3])
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = position = end.end() if end else len(page)
                continue
            if not m[3].endswith("/"):
                stack.append(node)
                opened[tag] += 1
    if joined := flush():
        yield "text", joined, stack[-1]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, html): each page of a host once, a null page as an empty one. Only pages that have copies are shuffled."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.md5("html"))
    copied = shared_table(rows.groupBy("host", "key").agg(F.count("*").alias("n")).filter("n > 1").select("host", "key"), "html-copied")
    once = rows.join(copied, ["host", "key"], "left_semi").groupBy("host", "key").agg(F.first("html").alias("html"))
    return rows.join(copied, ["host", "key"], "left_anti").select("host", "html").union(once.select("host", "html"))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, parent, size, sig, support, total), summed within a slice of distinct pages: sig is the exclusive
    or over pages of hash(page, count), size what the token counts in a class: an element 2, as it opens and closes,
    a text 1 for one word and 2 for more. Token 0 is in every page."""
    bounded_batches(pages.sparkSession, 256)

    def run(batches):
        for batch in slices(batches):
            table: dict[tuple[str, int], list[int]] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = xxhash.xxh3_64_intdigest(page)
                counts: dict[int, list[int]] = {0: [0, 1, 1]}
                for event in blocks(page):
                    if event[0] == "tag":
                        token, parent, size = event[1].path, event[1].parent, 2
                    else:
                        token, parent, size = digest(event[1], event[2].path & (1 << 63) - 1), event[2].path, 1 + (" " in event[1])
                    counts.setdefault(token, [parent, size, 0])[2] += 1
                for token, (parent, size, n) in counts.items():
                    row = table.setdefault((host, token), [parent, size, 0, 0, 0])
                    row[2] ^= digest(f"{own} {n}")
                    row[3] += 1
                    row[4] += n
            columns = list(zip(*((h, t, *r) for (h, t), r in table.items()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["host", "token", "parent", "size", "sig", "support", "total"])

    schema = "host string, token long, parent long, size long, sig long, support long, total long"
    return distinct_pages(pages).mapInArrow(run, schema)


def templates(pages: DataFrame, share: float = 0.6, least: int = 3) -> DataFrame:
    """(host, tokens): the frequent tokens of each host with the class that they belong to.

    Tokens on at least `share` of a host's distinct pages are kept, so a host has at most 1/share times as many as an
    average page of it, and a list stays as small as a page.
    """
    token = occurrences(pages).groupBy("host", "token").agg(
        F.min("parent").alias("parent"), F.min("size").alias("size"), F.bit_xor("sig").alias("sig"), F.sum("support").alias("support"), F.sum("total").alias("total"))
    token = token.filter(F.col("support") >= least)
    size = token.filter("token = 0").select("host", F.col("support").alias("pages"))
    kept = token.filter("token <> 0").join(size, "host").filter(F.col("support") >= share * F.col("pages"))
    return kept.groupBy("host").agg(F.collect_list(F.struct("token", "parent", "size", "sig", "support", "total")).alias("tokens"))


def nested(tokens: list[dict]) -> set[int]:
    """The tokens of valid classes: of size two at least, each token of which stands in one of the template or at the top."""
    classes: dict[tuple, list[dict]] = {}
    for t in tokens:
        classes.setdefault((t["sig"], t["support"], t["total"]), []).append(t)
    found = {t["token"]: t["parent"] for members in classes.values() if sum(t["size"] for t in members) > 1 for t in members}
    while loose := [t for t, parent in found.items() if parent and parent not in found]:
        for t in loose:
            del found[t]
    return set(found)


def slots_of(page: str, template: set[int]) -> tuple[list[tuple[int, list[str]]], list[str], bool]:
    """The slots of a page, the text of its main element template and all, and whether it has a main element.

    A slot is what lies between two template tokens, tags or texts, in page order: (rank, blocks). Where the template
    leaves a stretch whole, as on a host with few pages, text of another rank begins another slot.
    """
    slots, whole, seen_main, cut = [], [], False, True
    for event in blocks(page):
        if event[0] == "tag":
            seen_main |= event[1].rank == 0
            cut |= event[1].path in template
            continue
        _, text, node = event
        if node.rank == 0:
            whole.append(text)
        if digest(text, node.path & (1 << 63) - 1) in template:
            cut = True
        elif cut or slots[-1][0] != node.rank:
            slots.append((node.rank, [text]))
            cut = False
        else:
            slots[-1][1].append(text)
    return slots, whole, seen_main


def main_text(page: str, template: set[int]) -> str:
    """The text of the best slots, blocks joined by one space.

    On a page with a main element these are its slots; where the template covers them all, its text is kept, and where
    it has none, the body's slots are taken. Else the larger of the body and of a main element in boilerplate words,
    then what stands in boilerplate words, then in boilerplate elements.
    """
    slots, whole, seen_main = slots_of(page, template)
    ranked = [[t for r, texts in slots if r == rank for t in texts] for rank in range(5)]
    if seen_main:
        return " ".join(ranked[0] or whole or ranked[1])
    return " ".join(max(ranked[1], ranked[2], key=lambda found: sum(map(len, found))) or ranked[3] or ranked[4])


def extract(pages: DataFrame, broadcast_bytes: int = 16 << 20, salts: int = 64) -> DataFrame:
    """(page_id, url, text) of each row of `pages`.

    A null page counts as empty and gives an empty text; a null url is of the empty host. A page of any length is
    read whole in one pass. Repeated rows are extracted each, but are one page to the template; between slots of
    equal size the body goes before a main element in boilerplate words. Other columns are ignored whatever their
    names; an empty table gives no rows. The hosts'
    templates are broadcast only while their measured size is below `broadcast_bytes`; beyond it, pages
    meet them in a join salted `salts` ways, so that no task gets a whole large host.
    """
    bounded_batches(pages.sparkSession, 256)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    known = shared_table(templates(pages), "html-templates")
    n, tokens = known.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    if 100 * n + 56 * tokens <= broadcast_bytes:
        joined = rows.join(F.broadcast(known), "host", "left")
    else:
        spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")
    schema = T.StructType([*pages.select("page_id", "url").schema, T.StructField("text", T.StringType())])

    def run(batches):
        memory: dict[str, set[int]] = {}
        for batch in slices(batches):
            out = []
            tokens = batch.column(4)
            for k, (page, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if host not in memory:
                    if len(memory) >= 1000:
                        memory.clear()
                    memory[host] = nested(tokens[k].as_py() or [])
                out.append(main_text(page or "", memory[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "host", "tokens").mapInArrow(run, schema)
