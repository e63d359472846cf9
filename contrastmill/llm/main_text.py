"""The main text of web pages by composite text density.

A page becomes a tree without what is never article text (menus, headers, footers, asides, forms,
scripts, styles, what is hidden: by element or role). Words of a class or id mark an element: the
words of ``MARKED`` (adverts, menus, notices, comments) close it to the article, unless it is the
wrapper of the article, that is, holds an unmarked ``article`` or ``main``, or no other text is
left; the words of ``DOUBTFUL`` are left to the density. Every node has its characters per tag,
adjusted for the share of them in links, and the sum of that density over its children. The node
with the largest sum is the core; where there are ``article`` or ``main`` elements with text, it is
looked for inside them. The smallest density between the core and the body is the threshold.

The article is the core, or all of an ``article`` around it, and of what stands beside the way from
the core up to its container (``main``, else the body) the nodes that reach the threshold and
headings; in ``main`` paragraphs, quotations and tables too. Where the body itself is the core, its
children that are no paragraphs or the like have to reach the threshold. Inside all this, lists of
links below the threshold go, and doubtful elements in which no node reaches it. Text is never cut.

Null and empty pages give empty text, broken and very deep pages take linear time, repeated rows
keep their own result rows, an empty table gives an empty one. Columns other than ``page_id``,
``url`` and ``html`` are not read and not returned.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements and words of HTML practice.
DROPPED = frozenset(
    "head title script style noscript template nav header footer aside form button select option input textarea "
    "label fieldset iframe embed svg dialog menu datalist applet frameset".split()
)
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo sponsor sponsored sponsors nav navbar "
    "navigation menu menus submenu breadcrumb breadcrumbs crumbs pagination header masthead topbar footer colophon "
    "sidebar sidebars aside notice notices cookie cookies consent gdpr popup modal overlay newsletter comment comments "
    "disqus".split()
)
DOUBTFUL = frozenset(
    "promotion promoted pager foot copyright rail widget widgets subscribe subscription signup login alert respond reply "
    "replies discussion share sharing social related recommended toolbar form search hidden skip".split()
)
COMMENTS = frozenset("comment comments reply".split())
LAYOUT = frozenset("has no with without not open closed enabled disabled".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
UNMARKED = frozenset("html body main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot".split()
)
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
ITEMS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
LISTS = frozenset("ul ol dl table menu body article section div".split())
HEADINGS = frozenset("h1 h2 h3".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split()) | INLINE
P_FENCES = LISTS - {"div", "section"} | {"td", "th", "button"}

TAG = re.compile(
    r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*?)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?(?=[\s/]|$)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def judged(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is never article text, and the mark that its class and id give it."""
    if tag in DROPPED:
        return True, ""
    mark = ""
    if tag in UNMARKED or not attributes:
        return False, mark
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            return True, ""
        if name == "aria-hidden" and value.lower() == "true":
            return True, ""
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, ""
        if name == "role" and value.lower() in DROPPED_ROLES:
            return True, ""
        if name in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in WORDS.findall(token)]
                if not words or not LAYOUT.isdisjoint(words):
                    continue
                if tag == "article":
                    mark = "closed" if words[0] in COMMENTS else mark
                elif not MARKED.isdisjoint(words):
                    mark = "closed"
                elif not DOUBTFUL.isdisjoint(words):
                    mark = mark or "doubtful"
    return False, mark


class Tree:
    """Nodes in page order: parent, element, and the blocks of text directly inside them."""

    def __init__(self, page: str):
        self.parent, self.tag, self.mark = [-1], ["#page"], [""]
        self.pieces: list[tuple[int, str | None]] = []  # node and text; None ends a block
        stack, at, skip = [0], 0, 0  # skip: depth from which elements are dropped
        opened: dict[str, list[int]] = {}  # where in the stack each element is open

        def close(depth: int) -> None:
            nonlocal skip
            while len(stack) > depth:
                tag = self.tag[stack.pop()]
                opened[tag].pop()
                if tag not in INLINE and not skip:
                    self.pieces.append((stack[-1], None))
                if skip and len(stack) < skip:
                    skip = 0

        def innermost(tags) -> int:
            return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

        def close_open(wanted, fence) -> None:
            depth = innermost(wanted)
            if depth > innermost(fence):
                close(depth)

        def text(value: str) -> None:
            if value and not skip:
                self.pieces.append((stack[-1], html.unescape(value)))

        while at < len(page):
            m = TAG.search(page, at)
            if m is None:
                text(page[at:])
                break
            text(page[at : m.start()])
            at = m.end()
            ending, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag or not m[0].endswith(">"):
                continue
            tag = tag.lower()
            if ending:
                depth = innermost([tag])
                if depth:
                    close(depth)
                elif tag == "p" and not skip:
                    self.pieces.append((stack[-1], None))
                continue
            if tag in CLOSES_PARAGRAPH:
                close_open(["p"], P_FENCES)
            if tag in ITEMS:
                close_open(ITEMS[tag], LISTS)
            if not skip and tag not in INLINE:
                self.pieces.append((stack[-1], None))
            if tag in VOID:
                continue
            dropped, mark = (False, "") if skip else judged(tag, attributes)
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.mark.append(mark)
            opened.setdefault(tag, []).append(len(stack))
            stack.append(len(self.tag) - 1)
            if dropped:
                skip = len(stack)
            if tag in RAW:
                end = re.compile(rf"</{tag}\b", re.I).search(page, at)
                raw_end = end.start() if end else len(page)
                if tag not in DROPPED:
                    text(page[at:raw_end])
                at = raw_end
                if not end:
                    break


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, less the more of them are in links; ``share`` is that of the body."""
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    ratio = chars / max(1, link_chars) * tags / max(1, link_tags)
    return chars / tags * math.log(max(math.e, ratio)) / math.log(max(base, math.e))


def closed_nodes(tree: Tree, chars: list[int]) -> list[bool]:
    """Nodes inside elements marked as closed, which wrappers of the article are not."""
    n = len(tree.tag)
    wrapper = [False] * n
    inside = [False] * n
    for i in range(1, n):
        inside[i] = inside[tree.parent[i]] or (tree.mark[i] == "closed" and tree.tag[i] == "article")
    for i in range(n - 1, 0, -1):
        holds = wrapper[i] or (tree.tag[i] in ("article", "main") and not inside[i])
        wrapper[tree.parent[i]] = wrapper[tree.parent[i]] or holds
    shut = [tree.mark[i] == "closed" and not wrapper[i] for i in range(n)]
    # the depth of marked elements around each node; without text outside, the outermost are wrappers
    levels = [0] * n
    for i in range(1, n):
        levels[i] = levels[tree.parent[i]] + shut[i]
    least = min((levels[i] for i in range(n) if chars[i]), default=0)
    return [level > least for level in levels]


def article_nodes(tree: Tree) -> list[bool]:
    """Whether the text directly in each node belongs to the article."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags = [0] * n, [1] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = tree.tag[i] == "a" or in_link[tree.parent[i]]
    for i, value in tree.pieces:
        if value:
            chars[i] += len(value.strip())
    closed = closed_nodes(tree, chars)
    for i in range(n):
        chars[i] *= not closed[i]
        link_chars[i] = chars[i] * in_link[i]
    body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        chars[p] += chars[i]
        if not closed[i]:
            tags[p] += tags[i]
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i] + (tree.tag[i] == "a")
    top = body if chars[body] else 0
    share = link_chars[top] / max(1, chars[top])
    dense = [density(chars[i], tags[i], link_chars[i], link_tags[i], share) for i in range(n)]
    sums, peak = [0.0] * n, dense[:]
    for i in range(n - 1, 0, -1):
        sums[tree.parent[i]] += dense[i]
        peak[tree.parent[i]] = max(peak[tree.parent[i]], peak[i])

    within = [False] * n
    for i in range(1, n):
        container = tree.tag[i] in ("article", "main") and not closed[i] and chars[i] > 0
        within[i] = container or within[tree.parent[i]]
    narrow = any(within)
    best = max((i for i in range(n) if not narrow or within[i]), key=lambda i: (sums[i], dense[i]))
    path = [best]
    while path[-1] != top and path[-1]:
        path.append(tree.parent[path[-1]])
    threshold = min(dense[i] for i in path)
    container = next((i for i in path if tree.tag[i] in ("article", "main")), None)
    way = set(path if container is None else path[: path.index(container) + 1])
    of_core = best if container is None or tree.tag[container] == "main" else container

    kept = [False] * n
    for i in range(n):
        p, tag = tree.parent[i], tree.tag[i]
        low = dense[i] < threshold
        links = 3 * link_chars[i] >= 2 * chars[i] and link_tags[i] > 1
        if closed[i]:
            continue
        if i in way:
            kept[i] = True
        elif p < 0 or not kept[p] or (tree.mark[i] == "doubtful" and peak[i] < threshold) or (low and links):
            continue
        elif p not in way or p == of_core and tag in FLOW or p == of_core and p != top:
            kept[i] = True
        elif tree.tag[of_core] == "article" or (container is not None and tag in FLOW):
            kept[i] = True
        else:
            kept[i] = not low or tag in HEADINGS
    return kept


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = Tree(page)
    inside = article_nodes(tree)
    blocks, block = [], []
    for node, value in tree.pieces:
        if value is None:
            blocks.append("".join(block))
            block = []
        elif inside[node]:
            block.append(value)
    blocks.append("".join(block))
    return " ".join(" ".join(blocks).split())


def _extract(batches):
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id``, ``url``, ``html``)."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(
        _extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
