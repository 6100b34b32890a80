"""Main text of web pages by wrapper induction: DOM trees of same-host pages are aligned by simple tree matching.

1. Each page becomes a tree of block elements and text blocks; scripts, styles, comments and markup fall away.
2. For every host at most ``EXEMPLARS`` pages (of lowest hash) are kept as exemplars; their number doesn't grow.
3. Each page is aligned with every exemplar of its host. A text that stands at the matched place in the exemplar too is
   template; what varies is a slot. A block is template if it is constant in at least half of the aligned exemplars.
4. Slots in regions that the markup itself names as something else than the article (menus, headers and footers of the
   page, sidebars, notices, adverts, forms, reader comments) are not content. If the page has an article or main
   element, content is what lies within; else the element with most of the varying text.

5. Inside the article an element other than running text (``_PROSE``) whose texts are all constant is template, if two
   exemplars or more agree and some text of the article varies (else the page is a copy, and constancy proves nothing).
6. If that leaves nothing, class names count for nothing: the article is sought below regions that only a name sets
   apart, and else the slots are taken.

A constant paragraph of an article (a licence line, say) is content. White space in a block becomes one space; blocks are joined by an empty line. Null and empty pages have no
text. Pages without a host share one group, null addresses too. Rows may repeat; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from crossgrid.llm.common import small_batches
from crossgrid.session import attach_params, materialize

EXEMPLARS = 3
#: A host with more than 1 / PARTS of the pages is dealt to several tasks.
PARTS = 1000
#: Pairs of children beyond which a level is aligned by rows of arrays; the alignment is the same.
CELLS = 1024

#: Fixed values of HTML: elements that hold no text of the page, void elements, inline elements, and elements that end an open p.
_DROP = {"script", "style", "noscript", "template", "svg", "iframe", "object", "select", "button", "textarea", "title", "canvas", "math"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp",
           "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_ASIDE = {"nav", "footer", "aside", "form", "dialog", "menu"}
_NAMED = re.compile(
    r"(?<![a-z])(?:nav(?:bar|igation)?|menu|footer|sidebar|side|ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|comments?|reply|replies"
    r"|respond|disqus|breadcrumbs?|share|sharing|social|related|recommend\w*|newsletter|subscribe|masthead|widget|toolbar|pagination|pager|skip)(?![a-z])")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_SPACE = re.compile(r"\s+")
_ATTRS = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TITLED = {"article", "main"}
#: Elements of running text.
_PROSE = {"#", "p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "dt", "dd", "td", "th", "tr", "figcaption", "caption"}


class Node:
    __slots__ = ("tag", "label", "kids", "text", "aside", "fixed", "size")

    def __init__(self, tag: str, label: str, aside: bool, text: str = ""):
        self.tag, self.label, self.aside, self.text = tag, label, aside, text
        self.kids: list[Node] = []
        self.fixed = False  # in a region that its tag sets apart
        self.size = 0


def parse(page: str | None) -> Node:
    """Tree of block elements; leaves with tag "#" hold one text block each."""
    root = Node("html", "html", False)
    stack, words = [root], []

    def flush() -> None:
        if words:
            text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
            words.clear()
            if text:
                stack[-1].kids.append(Node("#", "#", False, text))

    skip, at, source = "", 0, page or ""
    while at < len(source):
        if skip:  # raw text lasts until its end tag
            end = re.compile(rf"</{re.escape(skip)}\s*[^>]*>", re.I).search(source, at)
            skip, at = "", end.end() if end else len(source)
            continue
        m = _TOKEN.match(source, at)
        if m is None:  # a tag that is never closed
            words.append(source[at])
            at += 1
            continue
        at = m.end()
        if m[4]:
            words.append(m[4])
        elif m[2]:
            tag, rest = m[2].lower(), m[3] or ""
            if tag in _INLINE:
                continue
            if tag == "br":
                words.append(" ")
                continue
            if tag in _DROP:
                if not m[1] and not rest.endswith("/"):
                    skip = tag
                continue
            flush()
            if m[1]:
                if any(n.tag == tag for n in stack[1:]):
                    while stack.pop().tag != tag:
                        pass
            elif tag not in _VOID:
                if tag in ("html", "body"):
                    continue
                if stack[-1].tag == "p" or tag == stack[-1].tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    stack.pop()
                named = " ".join(a.strip("\"'") for a in _ATTRS.findall(rest)).lower()
                fixed = stack[-1].fixed or tag in _ASIDE or tag == "header" and not any(n.tag in _TITLED for n in stack)
                node = Node(tag, f"{tag} {named}".strip(), stack[-1].aside or fixed or bool(named and _NAMED.search(named)))
                node.fixed = fixed
                stack[-1].kids.append(node)
                if not rest.endswith("/") or tag in ("p", "div"):
                    stack.append(node)
    flush()
    return root


def blocks(node: Node) -> Iterator[Node]:
    """Text blocks in page order; aside, inherited from the element above."""
    todo = [(node, node.aside)]
    while todo:
        n, aside = todo.pop()
        if n.tag == "#":
            n.aside = aside
            yield n
        todo.extend((k, aside or k.aside) for k in reversed(n.kids))


def _alike(a: Node, b: Node) -> int:
    """Cheap weight of two nodes as partners: equal labels, more for equal text."""
    return 0 if a.label != b.label else 3 if a.tag == "#" and a.text == b.text else 1


def _aligned(p: list[Node], q: list[Node]) -> list[tuple[int, int]]:
    """Partners of two lists, in order, with the largest total weight; the last ones first."""
    best = [[0] * (len(q) + 1)]
    for c in p:
        row, up = [0], best[-1]
        for j, d in enumerate(q):
            w = _alike(c, d)
            row.append(max(up[j + 1], row[j], up[j] + w if w else 0))
        best.append(row)
    out, i, j = [], len(p), len(q)
    while i and j:
        w = _alike(p[i - 1], q[j - 1])
        if w and best[i][j] == best[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out


def _aligned_wide(p: list[Node], q: list[Node]) -> list[tuple[int, int]]:
    """The same partners, for long lists: of the rows of the table about the root of their number are kept, and those between
    two kept ones are made again on the way back."""
    out, i, j = [], len(p), len(q)
    while i and j and p[i - 1].label == q[j - 1].label and (p[i - 1].tag != "#" or p[i - 1].text == q[j - 1].text):
        i, j = i - 1, j - 1  # no other partner weighs more
        out.append((i, j))
    labels: dict[str, int] = {}
    texts: dict[str, int] = {}
    label = [np.array([labels.setdefault(n.label, len(labels)) for n in x], dtype=np.int64) for x in (p[:i], q[:j])]
    text = [np.array([texts.setdefault(n.text, len(texts)) if n.tag == "#" else none for n in x], dtype=np.int64) for x, none in ((p[:i], -1), (q[:j], -2))]

    def below(up: np.ndarray, k: int) -> np.ndarray:
        width = len(up) - 1
        alike = label[1][:width] == label[0][k]
        new = np.where(alike, up[:-1] + 1 + 2 * (text[1][:width] == text[0][k]), 0)
        row = np.zeros_like(up)
        np.maximum.accumulate(np.maximum(up[1:], new), out=row[1:])
        return row

    step = max(1, math.isqrt(i))
    kept, row = [], np.zeros(j + 1, dtype=np.int32)
    for k in range(i):
        if k % step == 0:
            kept.append(row)
        row = below(row, k)
    while i and j:
        first = (i - 1) // step * step
        rows = [kept.pop()[: j + 1]]
        for k in range(first, i):
            rows.append(below(rows[-1], k))
        while i > first and j:
            here, up = rows[i - first], rows[i - first - 1]
            w = _alike(p[i - 1], q[j - 1])
            if w and here[j] == up[j - 1] + w:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif here[j] == up[j]:
                i -= 1
            else:
                j -= 1
    return out


def match_trees(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching, level by level: children are aligned in order so that the weight of partners is largest."""
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        p, q = x.kids, y.kids
        if not p or not q:
            continue
        todo += [(p[i], q[j]) for i, j in (_aligned if len(p) * len(q) <= CELLS else _aligned_wide)(p, q)]
    return pairs


def _by_tag(node: Node) -> None:
    """Forget what class names said: aside is what tags set apart."""
    todo = [node]
    while todo:
        n = todo.pop()
        n.aside = n.fixed
        todo.extend(n.kids)


def _constant_within(article: Node, template: set[int]) -> set[int]:
    """Text blocks of the article's elements other than running text that hold constant text only."""
    order, todo = [], [article]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(n.kids)
    whole: dict[int, bool] = {}
    for n in reversed(order):
        whole[id(n)] = id(n) in template if n.tag == "#" else all(whole[id(k)] for k in n.kids)
    gone, todo = set(), [(k, False) for k in article.kids]
    while todo:
        n, out = todo.pop()
        out = out or n.tag not in _PROSE and whole[id(n)]
        if out and n.tag == "#":
            gone.add(id(n))
        todo.extend((k, out) for k in n.kids)
    return gone


def _find(root: Node) -> Node | None:
    """The outermost article or main element outside the named regions; with several, the one with most text."""
    found, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag in _TITLED and not n.aside:
            found.append(n)
        else:
            todo.extend(n.kids)
    return max(found, key=lambda n: sum(len(b.text) for b in blocks(n) if not b.aside), default=None)


def _largest(root: Node, template: set[int]) -> Node:
    """Go down while one child holds nearly all of the varying text."""
    def weight(n: Node) -> int:
        return sum(len(b.text) for b in blocks(n) if not b.aside and id(b) not in template)

    at, size = root, weight(root)
    while size:
        kids = [(weight(k), k) for k in at.kids if k.kids]
        most, kid = max(kids, key=lambda x: x[0], default=(0, None))
        if most < 0.9 * size:
            break
        at, size = kid, most
    return at


def main_text(page: str | None, exemplars: list[Node]) -> str:
    """The page's article by the wrapper that its host's exemplars induce."""
    root = parse(page)
    constant: dict[int, int] = {}
    for other in exemplars:
        for x, y in match_trees(root, other):
            if x.tag == "#" and x.text == y.text:
                constant[id(x)] = constant.get(id(x), 0) + 1
    template = {k for k, n in constant.items() if 2 * n >= len(exemplars)}
    agreed = {k for k in template if constant[k] >= 2}

    def content() -> list[str]:
        article = _find(root)
        if article is None:
            return [b.text for b in blocks(_largest(root, template)) if not b.aside and id(b) not in template]
        own = [b for b in blocks(article) if not b.aside]
        gone = _constant_within(article, agreed) if any(id(b) not in template for b in own) else set()
        return [b.text for b in own if id(b) not in gone]

    kept = content()
    if not kept:
        _by_tag(root)
        kept = content()
    return "\n\n".join(kept)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", exemplars: int = EXEMPLARS) -> DataFrame:
    """Per page: id, url, text, n_chars. Pages meet their host's exemplars in parts of at most about a thousandth of all
    pages, so a host with a large share is dealt to many tasks; a task streams its pages and holds one host's exemplars."""
    rows = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), F.xxhash64(host_of(F.col(url_col))).alias("_host"),
        F.xxhash64(url_col, html_col).alias("_order"))
    kept = materialize(
        rows.filter("_html is not null").groupBy("_host", F.pmod("_order", F.lit(exemplars)).cast("int").alias("_slot"))
        .agg(F.min_by("_html", "_order").alias("_html")), "exemplars")
    counts = materialize(rows.groupBy("_host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    large = attach_params(counts, counts.agg(F.sum("n").alias("total"))).filter(F.col("n") * PARTS > F.col("total"))
    # fewer than PARTS hosts can have more than that share
    parts = F.broadcast(large.select("_host", F.ceil(F.col("n") * PARTS / F.col("total")).alias("_parts")))
    pages_ = rows.join(parts, "_host", "left").select(
        "_host", F.pmod("_order", F.coalesce("_parts", F.lit(1))).cast("long").alias("_part"), F.lit(exemplars).alias("_slot"), "_id", "_url", "_html")
    known = kept.join(parts, "_host", "left").select(
        "_host", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"), "_slot",
        F.lit(None).cast(rows.schema["_id"].dataType).alias("_id"), F.lit(None).cast("string").alias("_url"), "_html")
    dealt = pages_.union(known).repartition("_host", "_part").sortWithinPartitions("_host", "_part", "_slot")
    made = pa.schema([("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trees = None, []
        for batch in small_batches(batches, "_html"):
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            at, texts = [], []
            for i, (k, slot, page) in enumerate(zip(keys, batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                if k != key:
                    key, trees = k, []
                if slot < exemplars:
                    trees.append((page, parse(page)))
                else:
                    at.append(i)
                    texts.append(main_text(page, [t for other, t in trees if other != page]))
            own = batch.take(pa.array(at, pa.int64()))
            new = [pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], dtype=np.int64))]
            yield pa.RecordBatch.from_arrays([own.column(3), own.column(4), *new], schema=pa.schema([batch.schema.field(3), batch.schema.field(4), *made]))

    kind = dealt.schema["_id"].dataType.simpleString()
    out = dealt.select("_host", "_part", "_slot", "_id", "_url", "_html").mapInArrow(run, f"_id {kind}, _url string, text string, n_chars long")
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_url", url_col)
