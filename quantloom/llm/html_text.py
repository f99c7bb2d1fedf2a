"""Main text of web pages by tree scoring.

Every paragraph has points for its length and its commas and passes them to its ancestors, less
with each level.  A container's points are discounted by its link density; the best container is
kept, with the siblings that read like its continuation.  Parts named as comments, adverts, notices and the
like go whatever they say; vaguer words in class, id and role discount a container's points, and take it out
only if its own text agrees.  One pass over the scan, no shuffle.

A header goes wherever it is, also that of an article with its title.  A form goes unless it holds the article.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea title xmp noembed noframes object canvas".split())
DROPPED = frozenset("nav header footer aside button select option optgroup datalist label legend dialog menu head".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html "
    "legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 figcaption".split())
#: A start tag ends an open element of these, unless one of the second set lies between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section div main body aside nav header footer form blockquote".split())
SEMANTIC = ("article", "main")
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|sidebar|footer|header|masthead|breadcrumbs?|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|share|sharing|social|comments?|commentlist|disqus|"
    r"respond|related|recommend\w*|login|signup|search|toolbar|paginat\w*|pager|widget|skip)(?:[\s_-]|\d|$)"
)
#: Classes that say what a container has or lacks beside its own text, and those of article text.
LAYOUT = re.compile(r"(?:no|non|has|with|without|hide|is)[_-]")
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:\s|$)")
#: Class, id or role, as a whole, of what readers wrote, and of other parts that are no article.
COMMENTS = re.compile(r"(?:reader|user|post|article)?[_-]?(?:comments?|commentlist|repl(?:y|ies)|responses?|respond|disqus)(?:[_-](?:list|area|section|thread|threads|block|box|wrapper|container|body|content|text|form|item))*")
APART = re.compile(
    r"(?:site|page|left|right|main|google|text)?[_-]?(?:sidebar|footer|navbar|nav|navigation|menu|breadcrumbs?|pagination|pager|ads?|adsense|advert|adverts|advertisements?|advertising|sponsor|sponsored|sponsors|"
    r"promo|promos|promotions?|promoted|notices?|cookies?|gdpr|consent|newsletter|login|signup|popup|modal|contentinfo|complementary)"
    r"(?:[_-](?:slot|box|unit|container|wrapper|block|area|banner|bar|panel|card|inner|body|content|text|link|links|list|item|notice|message|consent|form|post|label|top|bottom|\d+))*"
)
#: The same as ids of sections, where other words are often made from titles.
APART_SECTIONS = re.compile(r"(?:sidebar|navbar|breadcrumbs?|pagination|advert|adverts|advertisements?|newsletter|login|signup|popup|modal)(?:[_-](?:box|signup|form|banner|section))?")
DISCOUNT = 25.0
#: A marked container with fewer points for its length and commas than this is no article text.
PROSE = 4.0
#: So many points beside a part named as no article show that the article is elsewhere.
SOME_PROSE = 0.5
START_POINTS = {"article": 25.0, "main": 15.0, "section": 5.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "form": -3.0}
LEVELS = 6


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "points", "length", "linked", "holds_semantic", "marked")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.points, self.length, self.linked, self.holds_semantic, self.marked = 0.0, 0, 0, False, False


class OpenElements:
    """The elements open at a place, outermost first, with the depths of each tag and of what bounds the reach of a start tag."""

    def __init__(self, root: Node):
        self.path, self.depths, self.bounds = [root], defaultdict(list), [0]

    def push(self, node: Node) -> None:
        depth = len(self.path)
        self.path.append(node)
        self.depths[node.tag].append(depth)
        if node.tag in SCOPE:
            self.bounds.append(depth)

    def cut(self, depth: int) -> None:
        """Closes all elements from this depth on."""
        while len(self.path) > depth:
            node = self.path.pop()
            self.depths[node.tag].pop()
            if node.tag in SCOPE:
                self.bounds.pop()

    def end(self, tag: str) -> None:
        """An end tag closes the innermost element of its tag, if one is open, and all within."""
        if self.depths[tag]:
            self.cut(self.depths[tag][-1])

    def before(self, tag: str) -> None:
        """Closes what a start tag ends: the innermost such element, for a table row the outermost, within the nearest bound."""
        ended = ENDS.get(tag, ())
        if tag in BLOCKS and tag not in ENDS:
            ended = ("p", *HEADINGS) if tag in HEADINGS else ("p",)
        bound = self.bounds[-1]
        open_ones = [d for t in ended for d in (self.depths[t][bisect_right(self.depths[t], bound) :] if tag == "tr" else self.depths[t][-1:]) if d > bound]
        if open_ones:
            self.cut(min(open_ones) if tag == "tr" else max(open_ones))


def parse(source: str) -> Node:
    """A forgiving tree of a page: scripts and comments are gone, unclosed elements end where HTML ends them."""
    root = Node("html", "", None)
    at, n = 0, len(source)
    here = OpenElements(root)
    closed = source.rfind(">") + 1  # no tag ends later, so none is looked for there
    while at < n:
        m = TOKEN.search(source, at, closed)
        text = source[at : m.start()] if m else source[at:].partition("<!--")[0]
        if text:
            here.path[-1].children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            continue
        tag = m[2].lower()
        if m[1]:
            here.end(tag)
            continue
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
                at = end.end() if end else n
            continue
        here.before(tag)
        node = Node(tag, m[3], here.path[-1])
        node.parent.children.append(node)
        if tag not in VOID and not (m[3].endswith("/") and tag not in BLOCKS):
            here.push(node)
    return root


def in_order(root: Node) -> list[Node]:
    """All elements, each before its children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def measure(nodes: list[Node]) -> None:
    """Length of text and of linked text of each element, and whether it holds an article."""
    for node in nodes:
        node.length = node.linked = 0
        node.holds_semantic = False
    for node in reversed(nodes):
        node.length += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.linked = node.length
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
            node.parent.holds_semantic |= node.holds_semantic or node.tag in SEMANTIC


def hidden_or_unlikely(node: Node) -> tuple[bool, bool, bool, str]:
    """Whether an element is hidden, whether class, id or role say that it may be no article text, whether by more
    than an anchor, and "comments" or "apart" where one of them names such a part as a whole."""
    if not node.attrs.strip():
        return False, False, False, ""
    attrs = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(node.attrs)}
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")))
    said = {k: re.sub(r"(?<=[a-z])(?=[A-Z])", "-", attrs.get(k, "")).lower().strip() for k in ("class", "id", "role")}
    kinds = [c for c in f"{said['class']} {said['role']}".split() if not LAYOUT.match(c)]
    likely = LIKELY.search(" ".join(kinds))
    by_kind = bool(UNLIKELY.search(" ".join(kinds))) and not likely
    m = UNLIKELY.search(said["id"]) if not likely else None
    whole_id = m is not None and m[0] == said["id"] and node.tag != "section" and node.tag not in PARAGRAPHS  # ids there are often made from titles
    by_id = node.tag not in PARAGRAPHS and (APART_SECTIONS if node.tag == "section" else APART).fullmatch(said["id"])
    apart = by_id or any(map(APART.fullmatch, kinds))
    part = "comments" if any(map(COMMENTS.fullmatch, [*kinds, said["id"]])) else "apart" if apart and not any(LIKELY.search(c) for c in kinds if not APART.fullmatch(c)) else ""
    return hidden, by_kind or m is not None, by_kind or whole_id, part


def prune(root: Node) -> None:
    """Takes out what is never article text: by tag, by being hidden, and what class, id and role name as another part.

    Parts named as comments, or as adverts, notices, menus and the like, go whatever they say, unless the page has no
    article and no prose beside them.  So does a form unless it holds the article, or more prose than
    the rest of the page.  Words of class, id and role within longer names only mark a container.  A
    marked one goes if it is mostly links, or has little prose and less than half the text of its article.
    """
    nodes = in_order(root)
    measure(nodes)
    removed: set[Node] = set()
    suspects: dict[Node, bool] = {}
    named: set[Node] = set()
    comments: set[Node] = set()
    around: dict[Node, Node] = {root: root}  # the nearest article, or the page
    for node in nodes:
        if node.parent is None:
            continue
        around[node] = node.parent if node.parent.tag in SEMANTIC else around[node.parent]
        hidden, unlikely, sure, part = hidden_or_unlikely(node)
        if node.tag in DROPPED or hidden:
            removed.add(node)
        elif part == "comments" and node.tag == "article":
            comments.add(node)
            named.add(node)
        elif node.tag == "form":
            named.add(node)
        elif node.tag not in HEADINGS and node.tag not in SEMANTIC and (node.tag in BLOCKS or node.tag in ("span", "ins", "a")):
            if part and (node.tag in BLOCKS or part == "apart"):
                named.add(node)
                if part == "comments":
                    comments.add(node)
            if unlikely and node.tag in BLOCKS and (sure or node.tag not in PARAGRAPHS):
                node.marked = True
                suspects[node] = sure
    if suspects or named:
        length, linked, prose, articles = Counter(), Counter(), Counter(), Counter()  # without what is removed
        for node in reversed(nodes):
            length[node] += sum(len(c.strip()) for c in node.children if isinstance(c, str))
            articles[node] += node.tag in SEMANTIC and node not in comments
            if node.tag == "a":
                linked[node] = length[node]
                prose[node] = 0.0
            else:
                prose[node] += sum(paragraph_points(c.strip()) - 1 for c in node.children if isinstance(c, str))
            if node in suspects and node not in named and not node.holds_semantic and length[node]:
                little = suspects[node] and prose[node] < PROSE and node.length < 0.5 * around[node].length
                if little or linked[node] > 0.5 * length[node]:
                    removed.add(node)
            if node.parent is not None and node not in removed:
                length[node.parent] += length[node]
                linked[node.parent] += linked[node]
                prose[node.parent] += prose[node]
                articles[node.parent] += articles[node]
        left, under = prose[root], set()
        for node in nodes:
            if node.parent in removed or node.parent in under:
                under.add(node)
            elif node in named and node not in removed:
                elsewhere = articles[root] > articles[node]
                whole = articles[node] > 0 or node.tag == "form"  # what may hold the article goes if there is more prose beside it
                beside = left - prose[node] >= max(prose[node] if whole and node not in comments else 0.0, SOME_PROSE)
                if elsewhere or beside or (prose[node] == 0 and not articles[node]):
                    left -= prose[node]
                    removed.add(node)
    for parent in {node.parent for node in removed}:
        parent.children = [c for c in parent.children if c not in removed]


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def own_text(node: Node) -> str:
    """The text of an element, its white space as it is."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append(" ")
        else:
            todo.extend(reversed(x.children))
    return "".join(out)


def paragraph_points(text: str) -> float:
    return 1.0 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3.0)


def is_paragraph(node: Node) -> bool:
    """A paragraph, or a container whose text is its own."""
    if any(isinstance(c, Node) and c.tag in BLOCKS for c in node.children):
        return False
    return node.tag in PARAGRAPHS or (node.tag in BLOCKS and any(isinstance(c, str) and c.strip() for c in node.children))


def best_roots(root: Node) -> list[Node]:
    """The best container with the siblings to keep, in page order; empty if there is no text."""
    nodes = in_order(root)
    measure(nodes)
    scored: set[Node] = set()
    for node in nodes:
        if not node.length or not is_paragraph(node):
            continue
        points = paragraph_points(" ".join(own_text(node).split())) * (1 - density(node))
        if node.tag in HEADINGS:
            points /= 2
        above, level = (node.parent if node.tag in PARAGRAPHS and node.parent is not None else node), 0
        while above is not None and level < LEVELS:
            if above not in scored:
                scored.add(above)
                above.points = START_POINTS.get(above.tag, 0.0) - (DISCOUNT if above.marked else 0.0)
            above.points += points / (1, 2, 6, 9, 12, 15)[level]
            above, level = above.parent, level + 1
    if not scored:
        return [root] if root.length else []
    best = max((n for n in nodes if n in scored), key=lambda n: n.points * (1 - density(n)))
    top = best.points * (1 - density(best))
    above = best
    while above is not None and above.tag not in SEMANTIC:
        above = above.parent
    if above is not None:
        best, top = above, max(top, above.points * (1 - density(above)))
    if best.parent is None:
        return [best]
    return [s for s in best.parent.children if isinstance(s, Node) and (s is best or continues(s, s.points * (1 - density(s)) if s in scored else 0.0, top))]


def continues(sibling: Node, points: float, top: float) -> bool:
    """Whether a sibling of the best container belongs to the article."""
    if points >= max(10.0, 0.2 * top):
        return True
    if sibling.tag in HEADINGS:
        return density(sibling) < 0.25
    if sibling.tag in ("p", "pre", "blockquote"):
        return density(sibling) < 0.25 if sibling.length > 80 else sibling.linked == 0 and sibling.length > 0
    return False


def blocks_of(node: Node) -> Iterator[str]:
    """The texts of the blocks of an element in page order; lists of links that are menus are left out.

    A menu is marked as such, or its items are short and it does not follow prose and a heading of its own.
    """
    buffer: list[str] = []
    prose, last = False, ""

    def flush() -> Iterator[str]:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            yield text

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            for text in flush():
                prose |= len(text) > 80
                yield text
        elif isinstance(x, str):
            buffer.append(x)
        elif x.tag == "br":
            buffer.append(" ")
        else:
            if x.tag in ("ul", "ol") and x is not node and x.length and density(x) > 0.7:
                items = sum(isinstance(c, Node) for c in x.children)
                if items > 1 and (x.marked or (x.length < 30 * items and not (prose and last in HEADINGS))):
                    continue
            if x.tag in PARAGRAPHS:
                last = x.tag
            if x.tag in BLOCKS:
                for text in flush():
                    prose |= len(text) > 80
                    yield text
                todo.append(None)
            todo.extend(reversed(x.children))
    yield from flush()


def main_text(source: str) -> str:
    """Blocks of the article joined by an empty line; empty if there is none."""
    root = parse(source)
    prune(root)
    return "\n\n".join(b for r in best_roots(root) for b in blocks_of(r))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty page, and one without article text, has an empty text.  Null ids and urls stay
    null; repeated rows are pages of their own; other columns are ignored; an empty table gives an empty table.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source.decode("utf-8", "replace")) for source in byte_texts(batch.column(2))]
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
