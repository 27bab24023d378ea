"""Main-text extraction by wrapper induction.

Pages of one host are grouped, in chunks of bounded size, and their DOM trees are aligned by simple tree matching:
two nodes match when they have the same tag and class, siblings of one kind are one repeated slot, and the children of
matching nodes are aligned in order so that the most nodes match below; as kinds are distinct by then, that is a
heaviest increasing subsequence, and the work is linear in the pages but for a logarithm. The page whose tree has the
most usual shape is the one aligned with. A node whose text is the same on most of a chunk's distinct pages is
template; what varies is a slot. The text of a page is the blocks of its content slots: those of the article where the
page marks one, else every slot that is not a menu, header, footer, sidebar, notice, advert, form or comment. Inside a
marked article a constant node is template only if it can be no text: where its slot has no other text on any page, and
it is all links or a box with a class of its own, or where it closes the article on every one of many pages; headings,
captions and cells of tables always stay. Class words that article text may carry too
(``SOFT_WORDS``) set apart nothing inside an article. Pages with the same article, whatever stands around it, are one
page as evidence, so that an article copied all over a host is no template.

Defined results: null or empty html gives an empty text; a page alone on its host is read by its marks only; hosts
come from the URL (null: one host of its own); repeated rows and copies of a page count once as evidence and each get
their text; broken markup is closed where HTML closes it, and a tag that nothing closes is text; pages of any length and depth are
read whole, in linear time; an empty table gives an
empty result. Only page_id, url and html are read, so other columns may have any names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespring.llm.common import grouped
from lorespring.llm.url_filters import host_of

#: Pages that are aligned together, on average and at least; a host with twice as many pages has more chunks.
CHUNK_PAGES = 24
#: Host tables up to this many rows are broadcast; larger ones join by shuffle.
BROADCAST_HOSTS = 100_000
#: A node is template if its text is on this share of a chunk's distinct pages, and on so many at least.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.6, 3
#: Inside a marked article: the share of a constant node's letters that are in links, and the distinct pages that all close with it.
LINK_SHARE, CLOSING_PAGES = 0.8, 8
# Elements that are text wherever they are in an article, however often they return; and those that are only boxes.
KEPT = set("h1 h2 h3 h4 h5 h6 hgroup th td tr thead tbody table caption figcaption dt dd dl".split())
BOXES = set("div section ul ol dir center".split())

# HTML's void, raw-text and phrasing elements, and the elements that close an open paragraph.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe xmp noembed noframes".split())
PHRASING = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table tr td th ul".split()
)
CLOSES_OWN = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
P_SCOPE = set("article aside body button caption div main section table td th li blockquote form".split())
# Elements, class or id words and roles of what is not main text.
NOT_TEXT = RAW | set(
    "head nav footer aside form menu button select option input object embed svg canvas dialog map audio video "
    "datalist fieldset".split()
)
NOT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register "
    "sidebar widget widgets related recommended recommendations share sharing social comment comments disqus "
    "breadcrumb breadcrumbs menu menus nav navigation navbar topbar toolbar masthead footer pagination pager".split()
)
# Such words that tell nothing inside an article.
SOFT_WORDS = set("side foot header respond replies discussion skip search copyright legal".split())
NOT_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())

OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)", re.S)
TAG_END = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


class Node:
    """An element: its tag, its class, whether it is set apart from the main text, and what it holds in order."""

    __slots__ = ("tag", "sign", "apart", "inside", "items", "parent", "template", "print")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent, self.items, self.template, self.print = tag, parent, [], False, 0
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
        self.sign = (tag, found.get("class", "").strip())
        words = set(re.findall("[a-z]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
        hidden = "hidden" in found or found.get("aria-hidden") == "true"
        hidden |= "display:none" in found.get("style", "").replace(" ", "").lower()
        self.apart = tag in NOT_TEXT or hidden or found.get("role", "").lower() in NOT_ROLES
        if tag in ("html", "body", "main", "article"):
            self.apart |= tag == "article" and bool(words & {"comment", "comments", "reply", "related", "teaser", "promo"})
        else:
            self.apart |= bool(words & NOT_WORDS) or not self.inside and bool(words & SOFT_WORDS)

    def kids(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each tag, comment and declaration (both without a name), in linear time.

    Quotes count behind an equals sign. Where a quoted value is never closed, quotes count no more from there on.
    """
    at, quotes = 0, True
    while m := OPEN.search(page, at):
        if m[2] is None:
            yield m.start(), m.end(), "", "", ""
            at = m.end()
            continue
        end = m.end()
        while quotes and (e := TAG_END.search(page, end)):
            if e[1] is None:
                end = e.start()
                break
            shut = page.find(e[1], e.end())
            if shut < 0:
                quotes = False
            end = shut + 1
        else:
            quotes = False
            end = page.find(">", m.end())
            if end < 0:
                return
        yield m.start(), end + 1, m[1], m[2].lower(), page[m.end() : end]
        at = end + 1 if m[1] or m[2].lower() not in RAW else raw_end(page, end + 1, m[2].lower())


def raw_end(page: str, at: int, tag: str) -> int:
    """Where the raw text of an element and its end tag end."""
    shut = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
    end = page.find(">", shut.end()) if shut else -1
    return end + 1 if end >= 0 else len(page)


def parse(page: str) -> Node:
    """The DOM tree, with the end tags that HTML lets a page leave out."""
    root = here = Node("#root", "", None)
    at, depth = 0, 0
    #: The open elements of each tag, with how deep they lie.
    still_open: dict[str, list[tuple[int, Node]]] = defaultdict(list)

    def leave(node: Node) -> None:
        nonlocal here, depth
        while here is not node:
            still_open[here.tag].pop()
            here, depth = here.parent, depth - 1

    def close(shut: set, scope: set) -> None:
        innermost = [still_open[t][-1] for t in shut if still_open[t]]
        if innermost:
            level, node = max(innermost, key=lambda x: x[0])
            if all(level > still_open[t][-1][0] for t in scope if still_open[t]):
                leave(node.parent)

    for start, end, slash, tag, attributes in tags(page):
        if start > at:
            here.items.append(page[at:start])
        at = end
        if not tag:
            continue
        if slash:
            if still_open[tag]:
                leave(still_open[tag][-1][1].parent)
            continue
        if tag in CLOSES_P:
            close({"p"}, P_SCOPE)
        if tag in CLOSES_OWN:
            close(*CLOSES_OWN[tag])
        node = Node(tag, attributes, here)
        here.items.append(node)
        if tag in RAW:
            at = raw_end(page, end, tag)
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            here, depth = node, depth + 1
            still_open[tag].append((depth, node))
    if at < len(page):
        here.items.append(page[at:])
    return root


def blocks(node: Node, keep=lambda x: not x.apart and not x.template) -> list[str]:
    """The text of each block below a node, in page order, white space folded."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        if part:
            if text := " ".join(entities.unescape("".join(part)).split()):
                out.append(text)
            part.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            part.append(x)
        elif x is not node and not keep(x):
            if x.tag not in PHRASING:
                flush()
        elif x.tag in PHRASING:
            if x.tag == "br":
                part.append(" ")
            todo.extend(reversed(x.items))
        else:
            flush()
            todo.append(None)
            todo.extend(reversed(x.items))
    flush()
    return out


def outermost(node: Node, wanted) -> list[Node]:
    """The nodes that are wanted, none inside another or in what is set apart."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if wanted(x):
            out.append(x)
        else:
            todo.extend(k for k in reversed(x.kids()) if not k.apart)
    return out


def kinds(node: Node) -> dict[tuple, list[Node]]:
    """Children that can be aligned, those of one kind together, kinds in the order of their first."""
    out: dict[tuple, list[Node]] = {}
    for k in node.kids():
        if not k.apart and k.tag not in PHRASING:
            out.setdefault(k.sign, []).append(k)
    return out


def heaviest(places: list[int], weights: list[int]) -> list[int]:
    """Which entries make the heaviest sequence of increasing places; places are distinct."""
    order = {p: i for i, p in enumerate(sorted(places), 1)}
    best: list[tuple[int, int]] = [(0, -1)] * (len(places) + 1)
    before, last = [], (0, -1)
    for k, (place, weight) in enumerate(zip(places, weights, strict=True)):
        i, top = order[place] - 1, (0, -1)
        while i > 0:
            top = max(top, best[i])
            i -= i & -i
        before.append(top[1])
        mine, i = (top[0] + weight, k), order[place]
        last = max(last, mine)
        while i < len(best):
            best[i] = max(best[i], mine)
            i += i & -i
    out, k = [], last[1]
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def match(pattern: Node, tree: Node) -> list[tuple[Node, list[Node]]]:
    """Simple tree matching: which nodes of a tree match which of the pattern's, so that the most do.

    Nodes of one kind below one parent are a slot, named by the pattern's first of the kind.
    """
    pairs = [([pattern], [tree])]
    below: list[list[tuple[list[int], list[int]]]] = []
    for x, y in pairs:  # grows on the way
        mine = []
        for i, q in enumerate(y):
            left, right = kinds(x[i] if len(x) == len(y) else x[0]), kinds(q)
            place = {sign: k for k, sign in enumerate(left)}
            common = [sign for sign in right if sign in left]
            mine.append((list(range(len(pairs), len(pairs) + len(common))), [place[c] for c in common]))
            pairs.extend((left[c], right[c]) for c in common)
        below.append(mine)
    weight, kept = [0] * len(pairs), [[] for _ in pairs]
    for k in range(len(pairs) - 1, -1, -1):
        weight[k] = len(pairs[k][1])
        for ids, places in below[k]:
            chosen = heaviest(places, [weight[i] for i in ids])
            kept[k] += [ids[c] for c in chosen]
            weight[k] += sum(weight[ids[c]] for c in chosen)
    out, todo = [], [0]
    while todo:
        k = todo.pop()
        out.append((pairs[k][0][0], pairs[k][1]))
        todo.extend(kept[k])
    return out


def fingerprint(root: Node) -> None:
    """Give each node a number that equal texts below it share; 0 where there is none."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(k for k in x.kids() if not k.apart)
    for x in reversed(order):
        parts = []
        for i in x.items:
            if isinstance(i, Node):
                parts.append(i.print)
            elif words := i.split():
                parts.append(entities.unescape(" ".join(words)))
        x.print = hash(tuple(p for p in parts if p)) if any(parts) else 0


def article_roots(tree: Node) -> list[Node]:
    """The marked articles, or else the main elements."""
    return outermost(tree, lambda x: x.tag == "article" and not x.apart) or outermost(
        tree, lambda x: x.tag == "main" and not x.apart
    )


def shape(tree: Node) -> tuple:
    """The kinds of the nodes that can be aligned, two levels down from the body."""
    level = kinds(tree)
    while len(level) == 1 and len(only := next(iter(level.values()))) == 1 and only[0].tag in ("html", "body"):
        level = kinds(only[0])
    return tuple((sign, tuple(k for x in xs for k in kinds(x))) for sign, xs in level.items())


def induce(trees: list[Node]) -> None:
    """Mark the template nodes of a chunk's trees, each aligned with one of the most usual shape."""
    texts = [tuple(b for r in article_roots(t) or [t] for b in blocks(r)) for t in trees]
    distinct = {t: i for i, t in reversed(list(enumerate(texts)))}
    least = max(TEMPLATE_PAGES, TEMPLATE_SHARE * len(distinct))
    if len(distinct) < TEMPLATE_PAGES:
        return
    shapes = [shape(trees[i]) for i in sorted(distinct.values())]
    usual = Counter(shapes).most_common(1)[0][0]
    pattern = trees[sorted(distinct.values())[shapes.index(usual)]]
    seen: dict[tuple[int, int], int] = defaultdict(int)
    aligned = []
    for i, tree in enumerate(trees):
        fingerprint(tree)
        own = {}
        for mine, nodes in match(pattern, tree):
            for node in nodes:
                own.setdefault((id(mine), node.print), []).append(node)
        aligned.append(own)
        if distinct[texts[i]] == i:
            for key in own:
                seen[key] += 1
    wordings = Counter(slot for slot, text in seen if text)
    for tree, own in zip(trees, aligned, strict=True):
        articles = article_roots(tree)
        marked = {id(x) for root in articles for x in below(root)}
        closing = set()
        for key, nodes in own.items():
            constant = key[1] != 0 and seen[key] >= least
            for node in nodes:
                if id(node) not in marked:
                    node.template = constant
                elif key[1] != 0 and node.tag not in KEPT:
                    box = node.tag in BOXES and node.sign[1] != ""
                    node.template = constant and wordings[key[0]] == 1 and (box or all_links(node))
                    if seen[key] == len(distinct) >= CLOSING_PAGES:
                        closing.add(id(node))
        for root in articles:
            close_article(root, closing)


def below(node: Node) -> Iterator[Node]:
    """The node and all nodes below it."""
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(x.kids())


def all_links(node: Node) -> bool:
    """Whether nearly all of a node's text is that of links."""
    linked = total = 0
    todo: list[tuple] = [(node, False)]
    while todo:
        x, in_link = todo.pop()
        if isinstance(x, str):
            n = len("".join(x.split()))
            total, linked = total + n, linked + n * in_link
        else:
            todo.extend((i, in_link or x.tag == "a") for i in x.items)
    return total > 0 and linked >= LINK_SHARE * total


def close_article(root: Node, closing: set[int]) -> None:
    """Mark the nodes behind all that varies, at the end of an article, that every page closes with."""
    here: Node | None = root
    while here is not None:
        inside = None
        for item in reversed(here.items):
            if isinstance(item, str):
                if item.split():
                    return
            elif item.apart or item.template:
                continue
            elif id(item) in closing:
                item.template = True
            else:
                inside = item
                break
        here = inside if inside is not None and inside.tag not in KEPT else None


def main_text(tree: Node) -> str:
    """The blocks of the marked article's slots, or else of the page's."""
    return "\n".join(b for r in article_roots(tree) or [tree] for b in blocks(r))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages``."""
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    hosts = pages.groupBy("host").agg(F.greatest(F.lit(1), F.floor(F.count("*") / CHUNK_PAGES)).alias("n_chunks"))
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    chunk = F.pmod(F.xxhash64("page_id", "url"), F.col("n_chunks"))
    chunked = pages.join(hosts, "host").withColumn("chunk", chunk)

    def of_chunk(_key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("page_id", kind="stable")
        trees = [parse(x or "") for x in group["html"]]
        induce(trees)
        texts = [main_text(t) for t in trees]
        return pd.DataFrame(
            {"page_id": group["page_id"], "url": group["url"], "text": texts, "n_chars": [len(t) for t in texts]}
        )

    return grouped(chunked.groupBy("host", "chunk"), of_chunk, "page_id long, url string, text string, n_chars long")
