"""Main text of web pages by wrapper induction.

Pages of one host come from few templates.  The block elements of every page
form a tree; simple tree matching aligns it with the tree of a reference page of the
host, keeping order and labels.  Over all pages of the host, a reference node whose
text is the same on nearly every page aligned with it is template; the others are
slots.  Slots whose text is mostly links are menus.  The text of the other slots is the host's content, and the wrapper's
root is the deepest node that nearly all of it lies under; text that a page has beyond the reference counts for the node it lies in.
A page's text is what the slots under that root hold, without the parts that the markup itself declares to
be menus, notices, forms and the like (``declared``, a prior that can be turned off).  Pages of hosts with few pages, and those
that have nothing under the root, are read by their declared structure alone.

Trees travel as labels, parents, text hashes and sizes; the pages' markup moves once at most, to meet what
the wrapper says of its nodes.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written

# A quoted value, which may hold ">", is recognised after "="; one that is not closed within 65,536 signs ends at the first ">".
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]{0,65536}"|'[^']{0,65536}')|=)*+)>""", re.S)
HINTS = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
WORD = re.compile(r"[a-z]+")

# Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "header footer nav aside form address fieldset details summary hr menu dialog center hgroup head".split()
)
CLOSES_P = BLOCK - frozenset(("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "html", "body", "head"))
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
DROPPED = frozenset("nav footer aside form button select option input textarea script style noscript template svg canvas iframe object video audio head title dialog menu label math".split())
DROPPED_OUTSIDE = frozenset(("header",))
# Words in class, id and role that name what is not the article.
CHROME = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended "
    "comment comments commentlist reply replies respond disqus discussion widget login search searchbox toolbar pagination pager skip complementary contentinfo".split()
)
CHROME_OUTSIDE = frozenset(("header", "masthead"))
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
# Words that may stand beside one of those in a compound name (ad-slot, share-buttons, site-footer); any other word makes it a name of its own.
BESIDE = frozenset(
    "site page main global top bottom left right primary secondary outer inner box bar bars list area wrap wrapper container block section group row col column slot unit "
    "zone link links button buttons btn form icon icons item items posts articles stories media div body thread panel count".split()
)
BESIDE_FIRST = frozenset("post article entry story blog".split())  # article-footer, but not share-post
OPENS_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd figure figcaption blockquote pre table".split())  # with inline elements: their ids are free text
ROOTS = frozenset(("html", "body", "article", "main"))

MIN_PAGES, CONSTANT = 8, 0.9  # pages of a host that make a template; share of them on which a text is the same
LINKED, CONTENT = 0.6, 0.9  # share of links that makes a slot a menu; share of the content that the wrapper's root holds
ARTICLE, GONE, TEXT, HEADING = 1, 2, 4, 8  # what a label says about its node beside the hash


def named(attributes: str) -> dict[str, str]:
    """A tag's attributes by name; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        if m[1]:
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def hidden(attributes: str) -> bool:
    """Whether attributes of these names, not words in their values, hide the element."""
    found = named(attributes)
    return (
        found.get("hidden", "false").strip().lower() != "false" or found.get("aria-hidden", "").strip().lower() == "true" or bool(NOT_SHOWN.search(found.get("style", "")))
    )


def _names(token: str, words: frozenset[str]) -> bool:
    """Whether a whole name is one of ``words`` or a compound of some and ``BESIDE`` only; numbers are passed over."""
    parts = WORD.findall(token)
    rest = parts[1:] if len(parts) > 1 and parts[0] in BESIDE_FIRST and words is not CHROME_OUTSIDE else parts
    return not words.isdisjoint(rest) and all(x in words or x in CHROME or x in BESIDE for x in rest)


def _advert(token: str) -> bool:
    """Compounds that no heading gives: ad-slot-1, cookie-notice, right-sidebar."""
    parts = WORD.findall(token)
    return len(parts) > 1 and (parts[0] in ("ad", "ads", "advert", "adverts", "cookie", "cookies") or parts[-1] == "sidebar") and _names(token, CHROME)


def chrome(tag: str, attributes: str, inside: bool) -> bool:
    """Whether class, role, id or label name what is not the article.

    Classes and roles count by whole names.  Ids and labels may be made from heading text: they never count on headings,
    paragraphs and inline elements, and inside an article only as comments or as compounds that no heading gives.
    """
    found = named(attributes)
    for token in f"{found.get('class', '')} {found.get('role', '')}".lower().split():
        if _names(token, CHROME) or (not inside and _names(token, CHROME_OUTSIDE)):
            return True
    if tag not in BLOCK or tag in OPENS_TEXT:
        return False
    for token in (found.get("id", "").lower(), found.get("aria-label", "").lower()):
        if token and (_names(token, COMMENTS) or _advert(token) if inside else _names(token, CHROME) or _names(token, CHROME_OUTSIDE)):
            return True
    return False


def comment(attributes: str) -> bool:
    """Whether an article's class or id names a comment."""
    found = named(attributes)
    return any(_names(x, COMMENTS) for x in [*found.get("class", "").lower().split(), found.get("id", "").lower()])


class Page:
    """Block elements of a page in order (tag, label, parent, dropped), its text blocks (node, chunks), and the text that was dropped.

    With ``declared`` off nothing is dropped but what is not shown: raw elements and hidden ones.
    """

    __slots__ = ("blocks", "declared", "dropped", "labels", "linked", "lost", "parents", "tags")

    def __init__(self, markup: str, declared: bool = True):
        self.tags, self.labels, self.parents, self.dropped = ["#root"], ["#root"], [-1], [False]
        self.blocks: list[tuple[int, list[str]]] = []
        self.lost: dict[int, list[str]] = {}
        self.linked: dict[int, int] = {}  # characters inside links, by node
        self.declared = declared
        self._parse(markup)

    def _parse(self, markup: str) -> None:
        tags, labels, parents, gone, blocks = self.tags, self.labels, self.parents, self.dropped, self.blocks
        # Open elements: tag, its block node, whether it is dropped, whether it is inside an article, whether it is in a link.
        stack = [("#root", 0, False, False, False)]
        opened: dict[str, list[int]] = {}  # where in the stack the elements of a tag are
        roots: list[int] = []  # ... those that no stray end tag passes
        block_at: list[int] = []  # ... and the block elements
        node, drop, link, chunks = 0, False, False, None
        low, at, end, skip = None, 0, len(markup), -1

        def close(k: int) -> None:
            for tag, *_ in stack[k:]:
                opened[tag].pop()
                if tag in BLOCK:
                    block_at.pop()
                if tag in ("article", "main", "body"):
                    roots.pop()
            del stack[k:]

        def add(text: str) -> None:
            nonlocal chunks
            if drop:
                if gone[node]:
                    self.lost.setdefault(node, []).append(text)
            else:
                if chunks is None:
                    blocks.append((node, chunks := []))
                chunks.append(text)
            if link:
                self.linked[node] = self.linked.get(node, 0) + len(text)

        # No tag can end after the last ">", so no search for its end runs beyond that.
        for m in TOKEN.finditer(markup, 0, markup.rfind(">") + 1):
            start = m.start()
            if start < skip:  # inside a raw element
                continue
            if start > at:
                add(markup[at:start])
            at = m.end()
            if m[2] is None:
                if markup.startswith("<!--", start) and not markup.endswith("-->", start, at):
                    at = end
                continue
            tag = m[2].lower()
            if m[1]:
                where = opened.get(tag)
                if not where:
                    if tag == "p":
                        chunks = None
                elif tag in ROOTS or not roots or roots[-1] <= where[-1]:
                    k = where[-1]
                    if any(x[1] != stack[k - 1][1] for x in stack[k:]):
                        chunks = None
                    close(k)
                _, node, drop, _, link = stack[-1]
                continue
            if tag == "br":
                if chunks is not None and not drop:
                    chunks.append(" ")
                continue
            if tag in CLOSES_P or tag in SIBLINGS:
                k = opened["option"][-1] if tag == "option" and opened.get("option") else block_at[-1] if block_at else 0
                if k and stack[k][0] in SIBLINGS.get(tag, ("p",)):
                    close(k)
                    chunks = None
                _, node, drop, _, link = stack[-1]
            inside = stack[-1][3]
            attributes, hint = m[3], ""
            lost = drop or tag in RAW or (self.declared and (tag in DROPPED or (tag in DROPPED_OUTSIDE and not inside)))
            if "=" in attributes:
                hint = " ".join(HINTS.findall(attributes)).lower()
                if not lost and hint and self.declared:
                    if tag not in ROOTS:
                        lost = chrome(tag, attributes, inside)
                    elif tag == "article":
                        lost = comment(attributes)
            if not lost and attributes and any(x in attributes.lower() for x in ("hidden", "none")):
                lost = hidden(attributes)
            if tag in BLOCK:
                chunks = None
                tags.append(tag)
                labels.append(f"{tag} {hint}" if hint else tag)
                parents.append(node)
                gone.append(lost)
                me = len(tags) - 1
            else:
                me = node
            if tag in RAW:
                if low is None:
                    low = markup.lower()
                skip = low.find(f"</{tag}", at)
                skip = end if skip < 0 else skip
                at = skip
                # its end tag, or the end of the page, follows
            if tag in VOID or attributes.endswith("/"):
                continue
            opened.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                block_at.append(len(stack))
            if tag in ("article", "main", "body"):
                roots.append(len(stack))
            stack.append((tag, me, lost, inside or tag in ("article", "main"), link or tag == "a"))
            _, node, drop, _, link = stack[-1]
        if at < end:
            add(markup[at:])

    def block_texts(self) -> list[tuple[int, str]]:
        """(node, text) of the blocks that hold any: references decoded, white space as one space, trimmed."""
        return [(n, t) for n, chunks in self.blocks if (t := " ".join(entities.unescape("".join(chunks)).split()))]

    def under(self, roots: set[int]) -> list[bool]:
        """Whether each node is one of ``roots`` or below one; parents come before their children."""
        inside = [k in roots for k in range(len(self.parents))]
        for k in range(1, len(inside)):
            inside[k] = inside[k] or inside[self.parents[k]]
        return inside


def extract(markup: str, template: set[int] = frozenset(), slots: set[int] = frozenset(), wrapped: int | None = None, declared: bool = True) -> str:
    """The main text of a page; blocks of the nodes in ``template`` are left out.

    It is what lies under ``wrapped``, the root that the host's wrapper gives the page, where that holds text.  Else the largest article is taken, with its sibling articles where the host's wrapper has them as ``slots``, if it holds most of the text left
    under its main element or the page.  Else the main element is taken, or the page where the largest article is outside and larger.
    """
    page = Page(markup, declared)
    texts = [(n, t) for n, t in page.block_texts() if n not in template]
    if wrapped is not None:
        inside = page.under({wrapped})
        if found := [t for n, t in texts if inside[n]]:
            return "\n".join(found)
    size = [0] * len(page.tags)
    for n, t in texts:
        size[n] += len(t)
    for k in range(len(size) - 1, 0, -1):
        size[page.parents[k]] += size[k]
    articles, mains = ([k for k, t in enumerate(page.tags) if t == wanted and not page.dropped[k] and size[k]] for wanted in ("article", "main"))
    largest = max(mains, key=lambda r: (size[r], -r), default=0)
    root = {largest}
    if articles:
        best = max(articles, key=lambda r: (size[r], -r))
        group = {best} | ({k for k in articles if k in slots and page.parents[k] == page.parents[best]} if best in slots else set())
        held, around = sum(size[k] for k in group), page.parents[best]
        while around > 0 and page.tags[around] != "main":
            around = page.parents[around]
        around = max(around, 0)
        if 2 * held > size[around]:
            root = group
        elif around or size[largest] < held:
            root = {around}
    inside = page.under(root)
    return "\n".join(t for n, t in texts if inside[n])


SKELETON = "labels array<int>, parents array<int>, texts array<long>, sizes array<int>, links array<int>"


def skeleton(markup: str, declared: bool = True) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """A page's tree in small, dropped parts included: hashed labels with the bits of what they say, parents, and of each node's own text a hash (0: none), its characters and those in links."""
    page = Page(markup, declared)
    own: dict[int, list[str]] = {}
    for n, t in page.block_texts():
        own.setdefault(n, []).append(t)
    for n, chunks in page.lost.items():
        if t := " ".join("".join(chunks).split()):
            own.setdefault(n, []).append(t)
    nodes = range(len(page.tags))
    texts = ["\n".join(own[k]) if k in own else "" for k in nodes]
    hashes = [xxhash.xxh3_64_intdigest(t) >> 1 or 1 if t else 0 for t in texts]
    labels = [
        xxhash.xxh32_intdigest(x) >> 5 << 4 | ARTICLE * (t == "article" and not d) | GONE * d | TEXT * (t in OPENS_TEXT) | HEADING * (t in ("h1", "h2"))
        for x, t, d in zip(page.labels, page.tags, page.dropped, strict=True)
    ]
    return labels, page.parents, hashes, [len(t) for t in texts], [min(page.linked.get(k, 0), len(texts[k])) for k in nodes]


class _Tree:
    __slots__ = ("children", "labels", "shapes", "sizes")

    def __init__(self, labels, parents, shapes: dict):
        n = len(labels)
        self.labels, self.children = labels, [[] for _ in range(n)]
        for k in range(1, n):
            self.children[parents[k]].append(k)
        self.shapes, self.sizes = [0] * n, [1] * n
        for k in range(n - 1, -1, -1):
            self.shapes[k] = shapes.setdefault((labels[k], *(self.shapes[c] for c in self.children[k])), len(shapes))
            self.sizes[k] += sum(self.sizes[c] for c in self.children[k])


def match(a: tuple, b: tuple) -> dict[int, int]:
    """Simple tree matching of two skeletons (labels, parents): the nodes of ``a`` aligned with those of ``b``, as many as order and labels allow."""
    shapes: dict = {}
    ta, tb = _Tree(*a, shapes), _Tree(*b, shapes)
    known: dict[tuple[int, int], int] = {}

    def middle(i: int, j: int) -> tuple[list[int], list[int], int]:
        """Children of i and j between those of equal shape at both ends, which match each other whole."""
        x, y, k, e = ta.children[i], tb.children[j], 0, 0
        most = min(len(x), len(y))
        while k < most and ta.shapes[x[k]] == tb.shapes[y[k]]:
            k += 1
        while e < most - k and ta.shapes[x[-1 - e]] == tb.shapes[y[-1 - e]]:
            e += 1
        return x[k : len(x) - e], y[k : len(y) - e], k

    def table(x: list[int], y: list[int]) -> np.ndarray:
        m = np.zeros((len(x) + 1, len(y) + 1), np.int32)
        for p in range(1, len(x) + 1):
            row, above = m[p], m[p - 1]
            best = 0
            for q in range(1, len(y) + 1):
                best = max(best, above[q], above[q - 1] + weight(x[p - 1], y[q - 1]))
                row[q] = best
        return m

    def weight(i: int, j: int) -> int:
        """Nodes that the subtrees share; pairs of unlike shape are known when they are asked for."""
        if ta.labels[i] != tb.labels[j]:
            return 0
        return ta.sizes[i] if ta.shapes[i] == tb.shapes[j] else known[ta.shapes[i], tb.shapes[j]]

    def solve(i: int, j: int) -> None:
        """Find the weight of a pair after those of its children, with a stack of its own, however deep the trees are."""
        todo = [(i, j)]
        while todo:
            i, j = todo[-1]
            key = ta.shapes[i], tb.shapes[j]
            if key in known:
                todo.pop()
                continue
            x, y, _ = middle(i, j)
            first = [(p, q) for p in x for q in y if ta.labels[p] == tb.labels[q] and ta.shapes[p] != tb.shapes[q] and (ta.shapes[p], tb.shapes[q]) not in known]
            if first:
                todo += first
                continue
            ends = sum(ta.sizes[c] for c in ta.children[i]) - sum(ta.sizes[c] for c in x)
            known[key] = 1 + ends + (int(table(x, y)[-1, -1]) if x and y else 0)
            todo.pop()

    if ta.labels[0] == tb.labels[0] and ta.shapes[0] != tb.shapes[0]:
        solve(0, 0)
    pairs: dict[int, int] = {}
    todo = [(0, 0)] if ta.labels[0] == tb.labels[0] else []
    while todo:
        i, j = todo.pop()
        pairs[i] = j
        x, y, k = middle(i, j)
        a_all, b_all = ta.children[i], tb.children[j]
        todo += zip(a_all[:k], b_all[:k], strict=True)
        e = len(a_all) - k - len(x)
        todo += zip(a_all[len(a_all) - e :], b_all[len(b_all) - e :], strict=True)
        if x and y:
            m, p, q = table(x, y), len(x), len(y)
            while p and q:
                if m[p, q] == m[p - 1, q]:
                    p -= 1
                elif m[p, q] == m[p, q - 1]:
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    todo.append((x[p], y[q]))
    return pairs


def _host(url):
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def wrapper(labels: list[int], parents: list[int], stats: dict[int, tuple[int, int, int, int, int]], least: int = MIN_PAGES) -> tuple[list[int], int | None]:
    """(template nodes, root) of a reference tree from its nodes' statistics over the host: pages aligned, pages with the same text, characters, those in links, and characters of text beyond the reference.

    The root is None where no content is left or it would be the whole page.
    """
    constant = [j for j, (aligned, same, *_) in stats.items() if aligned >= least and same >= CONSTANT * aligned]
    lost, children = [bool(x & GONE) for x in labels], [[] for _ in labels]
    for k in range(1, len(labels)):
        children[parents[k]].append(k)
    fixed, mass = set(constant), [0] * len(labels)
    for j, (_, _, chars, links, beyond) in stats.items():
        if not lost[j]:
            mass[j] = beyond + (chars if j not in fixed and links < LINKED * chars else 0)
    headed = [bool(x & HEADING) and m > 0 for x, m in zip(labels, mass, strict=True)]
    for k in range(len(mass) - 1, 0, -1):
        mass[parents[k]] += mass[k]
        headed[parents[k]] |= headed[k]
    at = 0
    # What is declared to be the article is whole, and a content's heading belongs to it.
    while mass[at] and not labels[at] & ARTICLE:
        below = max(children[at], key=lambda c: mass[c], default=None)
        if below is None or mass[below] < CONTENT * mass[at] or labels[below] & TEXT or any(headed[c] for c in children[at] if c != below):
            break
        at = below
    return sorted(constant), at or None


def templates(trees: DataFrame, least: int = MIN_PAGES) -> DataFrame:
    """host, reference tree, template nodes and root, for hosts of ``least`` pages or more; ``trees`` has one row (host, h1, h2, tree) a distinct page."""
    # The reference is one page of the host, picked by its hash; partial aggregates hold one tree a host.
    refs = trees.groupBy("host").agg(F.min_by("tree", F.struct("h1", "h2")).alias("ref"), F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)
    refs = written(refs, "references")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            for host, tree, ref in zip(batch["host"], batch["tree"], batch["ref"], strict=True):
                parents, texts, sizes, links = (tree[c].tolist() for c in ("parents", "texts", "sizes", "links"))
                labels = tree["labels"].tolist()
                pairs = match((labels, parents), (ref["labels"].tolist(), ref["parents"].tolist()))
                lost = [False] * len(labels)
                for i, text in enumerate(texts):
                    lost[i] = bool(labels[i] & GONE) or (i > 0 and lost[parents[i]])
                    if not text:
                        continue
                    at = i
                    while at not in pairs:  # text beyond the reference counts for the node that it lies in
                        at = parents[at]
                    c = seen.setdefault((host, pairs[at]), [0, 0, 0, 0, 0])
                    if at == i:
                        c[0] += 1
                        c[1] += bool(text == ref["texts"][pairs[i]])
                        c[2] += sizes[i]
                        c[3] += links[i]
                    elif not lost[i] and links[i] < LINKED * sizes[i]:
                        c[4] += sizes[i]
            yield pd.DataFrame([(h, j, *c) for (h, j), c in seen.items()], columns=["host", "node", "aligned", "same", "chars", "links", "beyond"])

    sums = ["aligned", "same", "chars", "links", "beyond"]
    counts = trees.join(refs.select("host", "ref"), "host").select("host", "tree", "ref").mapInPandas(count, "host string, node int, " + ", ".join(f"{c} long" for c in sums))
    nodes = counts.groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in sums])
    found = nodes.groupBy("host").agg(F.collect_list(F.struct("node", *sums)).alias("stats"))  # at most the nodes of one tree

    @F.pandas_udf("template array<int>, root int")
    def learned(ref: pd.DataFrame, stats: pd.Series) -> pd.DataFrame:
        rows = [wrapper(x.tolist(), p.tolist(), {r["node"]: tuple(r[c] for c in sums) for r in s}, least) for x, p, s in zip(ref["labels"], ref["parents"], stats, strict=True)]
        return pd.DataFrame(rows, columns=["template", "root"]).astype({"root": "Int32"})

    return written(refs.join(found, "host").select("host", "ref", learned("ref", "stats").alias("w")).select("host", "ref", "w.*"), "templates")


def page_text(pages: DataFrame, url: str = "url", markup: str = "html", out: str = "main_text", declared: bool = True, least: int = MIN_PAGES) -> DataFrame:
    """``pages`` with the main text of every page in ``out``; a page without one has an empty text.

    ``declared`` says whether tags and names that declare menus, notices and the like count; ``least`` is the number of pages that makes a wrapper.

    Null markup is empty, null or odd addresses share the host ''.  Copies of a page on one host count once
    for its template, and repeated rows get equal texts.  Other columns pass unread, and one named like ``out`` is replaced.
    """

    @F.pandas_udf(SKELETON)
    def small(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([skeleton(v, declared) for v in values], columns=["labels", "parents", "texts", "sizes", "links"])

    body = F.coalesce(F.col(markup), F.lit(""))
    keys = [_host(F.col(url)).alias("host"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2")]
    trees = written(pages.select(*keys, small(body).alias("tree")).dropDuplicates(["host", "h1", "h2"]), "trees")
    wrappers = templates(trees, least)

    @F.pandas_udf("nodes array<int>, slots array<int>, root int")
    def aligned(tree: pd.DataFrame, ref: pd.DataFrame, template: pd.Series, root: pd.Series) -> pd.DataFrame:
        """A page's template nodes, its articles that the wrapper has too where there are several side by side, and its root."""
        rows = []
        for labels, parents, texts, rl, rp, rt, nodes, top in zip(
            tree["labels"], tree["parents"], tree["texts"], ref["labels"], ref["parents"], ref["texts"], template, root, strict=True
        ):
            wanted = set(nodes.tolist())
            pairs = match((labels.tolist(), parents.tolist()), (rl.tolist(), rp.tolist()))
            articles = [i for i in pairs if labels[i] & ARTICLE]
            beside = Counter(parents[i] for i in articles)
            at = None if pd.isna(top) else next((i for i, j in pairs.items() if j == top), None)
            rows.append((sorted(i for i, j in pairs.items() if j in wanted and texts[i] == rt[j]), sorted(i for i in articles if beside[parents[i]] > 1), at))
        return pd.DataFrame(rows, columns=["nodes", "slots", "root"]).astype({"root": "Int32"})

    masks = trees.join(wrappers, "host").select("host", "h1", "h2", aligned("tree", "ref", "template", "root").alias("a")).select("host", "h1", "h2", "a.*")
    masks = masks.where((F.size("nodes") > 0) | (F.size("slots") > 0) | F.col("root").isNotNull())
    masks = written(masks.toDF("__host", "__h1", "__h2", "__nodes", "__slots", "__root"), "masks")

    @F.pandas_udf("string")
    def texts(values: pd.Series, nodes: pd.Series, slots: pd.Series, root: pd.Series) -> pd.Series:
        some = (frozenset() if n is None else set(n.tolist()) for n in nodes), (frozenset() if n is None else set(n.tolist()) for n in slots)
        return pd.Series([extract(v, n, a, None if pd.isna(r) else int(r), declared) for v, n, a, r in zip(values, *some, root, strict=True)], dtype=object)

    same = (keys[0] == F.col("__host")) & (keys[1] == F.col("__h1")) & (keys[2] == F.col("__h2"))
    rest = [c for c in pages.columns if c != out]
    return pages.join(masks, same, "left").select(*[F.col(c) for c in rest], texts(body, "__nodes", "__slots", "__root").alias(out))
