"""The main text of web pages by scoring the element tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, and those that are never text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style noscript template head title nav header footer aside form button select option textarea iframe svg canvas object menu dialog input label fieldset noembed noframes xmp audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPHS = frozenset("p pre td blockquote".split())
#: A start tag that ends an open paragraph, and the tags that end an open element of their own kind.
ENDS_P = BLOCKS - {"html", "body"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("table", "tr"), "th": ("table", "tr"), "tr": ("table",), "option": ("select",)}
#: Words of a class, id or role that mark what is not the article, and those that mark the article.
ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment[\w-]*|cookies?|consent|disqus|footer|form|header|masthead|menu|modal|nav\w*|newsletter|notices?|outbrain|pager|pagination|popup|promo\w*|related|replies|respond|share|sharing|shoutbox|sidebar|social|sponsor\w*|subscribe|taboola|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
BODY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|page|post|story|text)(?:$|[\s_-])", re.I)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: What begins a tag, or is no element at all.  Each is found where it stands, without a second try.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: Marks that say what an element's page or neighbour has, not what it is; one of the words that name the article.
HAS = re.compile(r"(?:^|\s)(?:has|with|no|without|show|hide)[_-][\w-]*", re.I)
IS_BODY = re.compile(r"(?:^|\s)(?:article|content|main|main-content|entry|entry-content|post|post-content|story|hentry|body)(?:$|\s)", re.I)
#: Elements that an end tag of an inline element does not reach across, and those whose mark may be a mistake.
WALLS = ("article", "main", "section", "div", "td", "table")
DOUBTFUL = ("form", "fieldset")
#: An attribute: a value in quotes to the closing one, where there is none, as one without quotes to white space or the tag's end.
ATTRIBUTE = re.compile(r"[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+)?+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
SPACE, NUMBERS = re.compile(r"\s+"), re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "parent", "children", "marks", "role", "hidden", "score", "n", "linked", "commas", "dropped", "inside")

    def __init__(self, tag: str, parent: Node | None, marks: str = "", role: str = "", hidden: bool = False) -> None:
        self.tag, self.parent, self.marks, self.role, self.hidden = tag, parent, marks, role, hidden
        self.children: list[Node | str] = []
        self.score, self.n, self.linked, self.commas = 0.0, 0, 0, 0
        #: In an article with nothing but divisions between: a header there is the article's, with its title, not the page's.
        self.inside = parent is not None and (parent.tag == "article" or parent.tag in ("div", "section") and parent.inside)
        own = tag in DOUBTFUL or tag == "header" and self.inside
        self.dropped = tag in DROPPED and not own or hidden and tag not in ("html", "body")

    @property
    def aside(self) -> bool:
        """Whether its marks, role or tag say that it is not the article."""
        if self.tag in ("html", "body"):
            return False
        if self.tag in DOUBTFUL or self.role in ASIDE_ROLES:
            return True
        return bool(self.marks) and self.tag not in ("article", "main") and ASIDE.search(HAS.sub(" ", self.marks)) is not None


def attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes from a place inside a tag, the first of each name, and where the tag ends; each character is looked at once.

    Only a quote of each kind that none follows is looked for in vain.
    """
    found: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(page, at)
        if m[1] is None:
            return found, min(m.end() + 1, len(page))
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = m.end()


def parse(page: str) -> Node:
    """A forgiving tree: unclosed paragraphs and list items end where the next begins, stray end tags are nothing.

    Open elements are kept by depth, by name, and the blocks among them, so
    that each tag costs the same however deep it stands.
    """
    root = Node("#root", None)
    stack, named, blocks = [root], {"#root": [0]}, [0]
    end, n = 0, len(page)

    def close(depth: int) -> None:
        while len(stack) > depth:
            named[stack.pop().tag].pop()
            if blocks[-1] == len(stack):
                blocks.pop()

    def deepest(*tags: str) -> int:
        return max((named[t][-1] for t in tags if named.get(t)), default=0)

    while end < n:
        m = TOKEN.search(page, end)
        if m is None:
            stack[-1].children.append(page[end:])
            break
        if m.start() > end:
            stack[-1].children.append(page[end : m.start()])
        end = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        attrs, end = attributes(page, end)
        if m[1]:
            depth = deepest(tag)
            if depth and (tag in BLOCKS or deepest(*WALLS) <= depth):
                close(depth)
            continue
        if tag in ENDS_P and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        if tag in SIBLINGS:
            depth = deepest(*SIBLINGS[tag])
            if depth and depth >= deepest(*SCOPE[tag]):
                close(depth)
                while stack[-1].tag in SIBLINGS[tag]:
                    close(len(stack) - 1)
        style = attrs.get("style", "").replace(" ", "").lower()
        node = Node(tag, stack[-1], f"{attrs.get('class', '')} {attrs.get('id', '')}".strip(), attrs.get("role", "").lower(), "hidden" in attrs or "display:none" in style or attrs.get("aria-hidden") == "true")
        stack[-1].children.append(node)
        if tag in RAW:
            close_tag = re.compile(rf"</{tag}\s*>", re.I).search(page, end)
            end = close_tag.end() if close_tag else n
        elif tag not in VOID and page[end - 2 : end] != "/>":
            named.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            stack.append(node)
    return root


def settle(root: Node) -> None:
    """Drop what is marked as aside, unless most of the page's unlinked text is in it and it is a form, is named as the
    article too, or holds the article's element."""
    nodes = walk(root)
    measure(nodes)
    whole, holds = root.n - root.linked, set()
    for node in reversed(nodes):
        if node.parent is not None and (node in holds or node.tag == "main" or node.tag == "article" and not ASIDE.search(node.marks)):
            holds.add(node.parent)
    for node in nodes:
        if node.aside:
            kept = node.tag in DOUBTFUL or IS_BODY.search(node.marks) or node in holds
            node.dropped = not (kept and 2 * (node.n - node.linked) > whole)


def walk(root: Node) -> list[Node]:
    """The elements that are not dropped, parents first; without recursion, as a page may nest without end."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.dropped:
            out.append(node)
            todo += (c for c in reversed(node.children) if isinstance(c, Node))
    return out


def measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        node.n = node.linked = node.commas = 0
        for c in node.children:
            if isinstance(c, str):
                node.n += len(c.strip())
                node.commas += c.count(",")
            elif not c.dropped:
                node.n += c.n
                node.linked += c.n if c.tag == "a" else c.linked
                node.commas += c.commas


def score(nodes: list[Node]) -> list[Node]:
    """Paragraphs pass points to their ancestors: all to the first, half to the second, then a third of that by depth."""
    measure(nodes)
    seen = set()
    for node in nodes:
        loose = node.tag in ("div", "section", "article", "main", "body") and any(isinstance(c, str) and c.strip() for c in node.children)
        if (node.tag not in PARAGRAPHS and not loose) or not node.n:
            continue
        points = 1 + node.commas + min(node.n // 100, 3)
        up, depth = (node if loose else node.parent), 0
        while up is not None and depth < 5:
            if id(up) not in seen:
                seen.add(id(up))
                up.score += 10 * (up.tag in ("article", "main")) + 25 * bool(up.marks and BODY.search(up.marks)) - 3 * (up.tag in ("ol", "ul", "dl"))
            up.score += points / (1, 2, 6, 9, 12)[depth]
            up, depth = up.parent, depth + 1
    ranked = [x for x in nodes if id(x) in seen]
    for x in ranked:
        x.score *= 1 - (x.linked / x.n if x.n else 0)
    return ranked


def chosen(root: Node) -> list[Node]:
    """The best container and those of its siblings that read like more of the same, in page order."""
    settle(root)
    nodes = walk(root)
    ranked = score(nodes)
    if not ranked:
        return [root]
    best = max(ranked, key=lambda x: x.score)
    while best.parent is not None and best.tag not in ("article", "main", "body", "#root") and (up := best.parent) is not None and up.tag == "article":
        best = up
    if best.parent is None:
        return [best]
    bar, out = max(10.0, best.score * 0.2), []
    series, titles = NUMBERS.sub("", best.marks), titles_before(best)
    for c in best.parent.children:
        if not isinstance(c, Node) or c.dropped:
            continue
        density = c.linked / c.n if c.n else 0.0
        bonus = best.score * 0.2 if c.marks and c.marks == best.marks else 0.0
        part = c.tag == best.tag and series and NUMBERS.sub("", c.marks) == series and not c.linked
        if c is best or c in titles or part or c.score and c.score + bonus >= bar and density < 0.5:
            out.append(c)
        elif c.tag in PARAGRAPHS and (c.n > 80 and density < 0.25 or c.n and not density):
            out.append(c)
    return out


def titles_before(best: Node) -> set[Node]:
    """The headings that stand directly before the container, with nothing else between."""
    out: set[Node] = set()
    for c in best.parent.children:
        if c is best:
            return out
        if isinstance(c, Node) and c.tag in HEADINGS and not c.dropped and not c.linked:
            out.add(c)
        elif isinstance(c, Node) and not c.dropped and c.n or isinstance(c, str) and c.strip():
            out.clear()
    return set()


def blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append(text)

    for top in nodes:
        todo: list[Node | str | None] = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif x.tag == "br":
                line.append(" ")
            elif not x.dropped or x is top:
                if x.tag in BLOCKS or x is top:
                    flush()
                    todo.append(None)
                todo += reversed(x.children)
        flush()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks joined by one space; empty for a null or empty page or one without text."""
    return " ".join(blocks(chosen(parse(page)))) if page else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, whatever its length; each input row gives one row.

    Null html counts as empty and gives an empty text; null ids and urls stay
    null, repeated rows stay repeated, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
