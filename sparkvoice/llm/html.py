"""Main text of web pages by tree scoring.

A page becomes a tree. Every paragraph has points for its length and commas; it passes them to its ancestors, less the
farther they are, and an ancestor's sum is discounted by the share of its text inside links; elements that mark an
article get a bonus. The best container, or the parent that holds it with its other parts, and those of its siblings
that score well are kept; boilerplate elements (by element, role or class) are left out first.

Defined cases: null or empty html gives an empty text; broken markup is closed as browsers would; a page without any
paragraph gives what text remains; repeated rows are treated one by one; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

#: Element names of HTML by their part in a page, and words that name boilerplate in class, id or role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "head script style noscript template svg math iframe noembed noframes object embed applet canvas audio video map nav footer aside form button input "
    "select option textarea label fieldset menu dialog title".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense sponsor sponsored sponsors promo promos promotion promoted banner banners "
    "comment comments commentlist commentary disqus respond replies reply sidebar side rail footer foot footnav header masthead topbar menu menus nav navbar navigation "
    "breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert popup overlay modal newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations recommendation outbrain taboola widget widgets pager pagination paging toolbar skip search disclaimer copyright "
    "legal teaser teasers tags tagcloud byline-links hidden".split()
)
CONTENT = frozenset("article content body main entry post story text".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: An opening element closes an open one of these names, but not beyond the second list.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
SCOPE = frozenset("table td th caption button object html body".split())

#: Elements nested deeper are taken as part of the one at this depth, as browsers do.
DEEPEST = 512

#: The rates of containers that say what they are count so much more; a parent that reaches this share of its best
#: child's rate, or adds at most that share of text, is the container in its place.
BONUS = {"article": 2.0, "main": 1.5}
CLIMB, ADDED = 0.75, 0.25

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: What stands in a tag up to its end, or to a quote that is never closed.
INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "items", "score", "bonus", "depth", "article")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.items = tag, parent, []
        self.score, self.bonus = 0.0, 1.0
        self.depth = parent.depth + 1 if parent else 0
        self.article = tag in ("article", "main") or parent is not None and parent.article


def boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is left out by its name, role or class."""
    if tag in DROPPED:
        return True
    if tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "main", "article") and "comment" not in attributes.lower():
        return False
    if not attributes.strip():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value.strip() in DROPPED_ROLES:
            return True
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id"):
            for name in value.split():
                parts = WORD.findall(name)
                # A name that starts with a word for content, such as content-with-sidebar, is content.
                if parts and parts[0] not in CONTENT and any(p in BOILERPLATE for p in parts):
                    return True
    return False


class Scanner:
    """The tags of a page, each found in time that does not depend on how the rest is broken."""

    def __init__(self, page: str):
        self.page, self.last, self.blind = page, page.rfind(">"), False

    def _end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` ends. After quotes have swallowed all of the page once, they count no more."""
        page = self.page
        while not self.blind:
            at = INSIDE.match(page, at).end()
            if at == len(page):
                self.blind = True
            elif page[at] == ">":
                return at
            else:
                at += 1
        return -1

    def next(self, at: int) -> tuple[int, int, str | None, bool, str]:
        """Start, end, name (None for comments and declarations), whether it ends an element, and attributes of the
        next tag; the page's length twice where there is none."""
        page = self.page
        lt = page.find("<", at)
        while lt >= 0:
            if page.startswith("<!--", lt):
                ends = [e for e in (page.find("-->", lt + 4), page.find("--!>", lt + 4)) if e >= 0]
                return lt, page.index(">", min(ends)) + 1 if ends else len(page), None, False, ""
            if page[lt + 1 : lt + 2] in ("!", "?"):
                e = page.find(">", lt)
                return lt, e + 1 if e >= 0 else len(page), None, False, ""
            m = NAME.match(page, lt + 1)
            if m and self.last >= m.end():
                e = self._end(m.end())
                e = e if e >= 0 else page.index(">", m.end())
                return lt, e + 1, m[2], bool(m[1]), page[m.end() : e]
            lt = page.find("<", lt + 1)
        return len(page), len(page), None, False, ""


def parse(page: str) -> Node:
    """The tree of a page without boilerplate elements. Items of a node are nodes and texts."""
    root = Node("#root", None)
    node, dropped, at = root, None, 0
    # dropped: the names of open elements inside one that is left out. deep: elements that are open beyond DEEPEST.
    deep: dict[str, int] = {}
    scanner, end = Scanner(page), len(page)
    while at < end:
        start, stop, name, closes, attributes = scanner.next(at)
        text = page[at:start]
        if text and not dropped:
            node.items.append(text)
        at = stop
        if name is None:
            continue
        tag = name.lower()
        if closes:
            if dropped:
                if tag in dropped:
                    while dropped.pop() != tag:
                        pass
                    continue
                # An end of something opened outside ends what is left out, but not inline.
                x = node
                while x is not None and x.tag != tag:
                    x = x.parent
                if x is None or tag not in BLOCK or tag == "p":
                    continue
                dropped = None
            if deep.get(tag):
                deep[tag] -= 1
                continue
            x = node
            while x is not None and x.tag != tag and not (tag not in BLOCK and x.tag in BLOCK):
                x = x.parent
            if x is not None and x.tag == tag:
                node = x.parent or root
            elif tag == "p":
                node.items.append(Node("p", node))
            elif tag == "br":
                node.items.append(" ")
            continue
        closed = tag in VOID
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if dropped:
            if not closed and not attributes.endswith("/"):
                if tag in ("li", "p", "option", "td", "tr", "dt", "dd") and dropped[-1] == tag and len(dropped) > 1:
                    dropped.pop()
                dropped.append(tag)
            continue
        if tag == "br":
            node.items.append(" ")
            continue
        if tag in CLOSES_P:
            x = node
            while x is not None and x.tag != "p" and x.tag not in SCOPE:
                x = x.parent
            if x is not None and x.tag == "p":
                node = x.parent
        if tag in IMPLIED:
            names, stop = IMPLIED[tag]
            x = node
            while x is not None and x.tag not in names and x.tag not in stop:
                x = x.parent
            if x is not None and x.tag in names:
                node = x.parent
        if closed:
            if tag in BLOCK:
                node.items.append(Node(tag, node))
            continue
        if boilerplate(tag, attributes, node.article):
            if not attributes.endswith("/"):
                dropped = [tag]
            continue
        if node.depth >= DEEPEST:
            deep[tag] = deep.get(tag, 0) + 1
            continue
        child = Node(tag, node)
        low = attributes.lower()
        child.bonus = BONUS["article"] if tag == "article" or "articlebody" in low else BONUS["main"] if tag == "main" or 'role="main"' in low else 1.0
        node.items.append(child)
        node = child
    return root


def blocks(node: Node, out: list[tuple[Node, str, int]] | None = None) -> list[tuple[Node, str, int]]:
    """(container, text, characters inside links) of every block in page order; text with single spaces."""
    out = [] if out is None else out
    text: list[str] = []
    linked = 0
    holder = node

    def flush():
        nonlocal linked
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined:
            out.append((holder, joined, min(linked, len(joined))))
        text.clear()
        linked = 0

    # An explicit stack: pages may nest deeper than Python's calls.
    stack: list[tuple[Node, int, bool, Node]] = [(node, 0, False, node)]
    while stack:
        x, i, in_link, outer = stack.pop()
        if i == 0 and x.tag in BLOCK:
            flush()
            holder = x
        moved = False
        while i < len(x.items):
            item = x.items[i]
            i += 1
            if isinstance(item, str):
                text.append(item)
                if in_link:
                    linked += len(" ".join(item.split()))
            else:
                stack.append((x, i, in_link, outer))
                stack.append((item, 0, in_link or item.tag == "a", holder))
                moved = True
                break
        if not moved and x.tag in BLOCK:
            flush()
            holder = outer
    flush()
    return out


def link_list(node: Node, linked: dict[int, list[int]]) -> bool:
    """Whether a list, table or division is a menu: most of its text stands in links."""
    own = linked.get(id(node))
    return bool(own) and own[2] >= 2 and own[1] > 0.66 * own[0]


def extract(page: str | None) -> str:
    """The main text of one page, a line for each block."""
    if not page:
        return ""
    root = parse(page)
    found = blocks(root)
    sums: dict[int, list[int]] = {}
    scored: dict[int, Node] = {}
    for holder, text, linked in found:
        points = 1 + text.count(",") + min(len(text) / 100, 3.0)
        paragraph = holder.tag in ("p", "pre", "td", "blockquote", "div", "section", "article", "main", "dd", "li") and len(text) >= 25
        share, x = 1.0, holder if holder.tag in ("div", "section", "article", "main", "body", "td", "blockquote") else holder.parent
        level = 0
        while paragraph and x is not None and x.tag != "#root":
            if x.tag in BLOCK:
                x.score += points * share
                scored[id(x)] = x
                level += 1
                share = 0.5 if level == 1 else 1 / (3 * level)
            x = x.parent
        x = holder
        while x is not None:
            s = sums.setdefault(id(x), [0, 0, 0])
            s[0] += len(text)
            s[1] += linked
            s[2] += 1
            x = x.parent
    if not scored:
        return "\n".join(t for _, t, linked in found if linked < 0.5 * len(t) or linked == 0)
    rate = lambda n: n.bonus * n.score * (1 - sums[id(n)][1] / max(1, sums[id(n)][0]))
    best = max(scored.values(), key=rate)
    # A parent that scores nearly as well holds the article in parts; one that adds little text holds its headings.
    parent = best.parent
    while parent is not None and parent.tag not in ("body", "html", "#root"):
        inside, whole = sums[id(best)][0], sums[id(parent)]
        if rate(parent) >= CLIMB * rate(best) or whole[0] - inside <= ADDED * whole[0] and whole[1] < 0.3 * whole[0]:
            best = parent
        parent = parent.parent if best is parent else None
    kept = {id(best)}
    if best.parent is not None:
        least = max(10.0, 0.2 * rate(best))
        for sibling in best.parent.items:
            if isinstance(sibling, Node) and sibling is not best and id(sibling) in sums:
                length, linked, _ = sums[id(sibling)]
                if id(sibling) in scored and rate(sibling) >= least:
                    kept.add(id(sibling))
                elif sibling.tag == "p" and best.bonus == 1 and linked < 0.25 * length and length > 80:
                    kept.add(id(sibling))
    out = []
    for holder, text, linked in found:
        x, inside, menu = holder, False, False
        while x is not None and not menu:
            menu = x.tag in ("ul", "ol", "table", "div", "section", "dl") and id(x) not in kept and not inside and link_list(x, sums)
            inside = inside or id(x) in kept
            x = x.parent
        if inside and not menu:
            out.append(text)
    return "\n".join(out)


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in ``keep``, text and n_chars of every page."""
    slim = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("__html"))

    def run(batches):
        for batch in batches:
            texts = [extract(p) for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(tidy(run), f"{kinds}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
