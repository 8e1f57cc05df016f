"""Main text of web pages by tree scoring.

Paragraphs earn points for their length and their commas and pass them to their ancestors,
in full to the nearest one and less to those further up. A container's points are discounted
by the share of its text that stands in links, and by a name that hints at something else. The
best container is kept together with those of its siblings that read like part of the article.

Containers are left out before scoring only if a whole name says what they are; if nothing
is left then, the page is read once more without regard to names. Reading takes time in
proportion to the page, whatever its markup.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmesh.llm.arrow import map_batches, slices

# An ordinary tag behind its name; values reach no further than the next tag, so a try costs little.
SIMPLE = re.compile(
    r"""((?:\s+[^\s"'<>/=]+(?:\s*=\s*(?:"[^"<]*"|'[^'<]*'|[^\s"'=<>`]+))?)*+)\s*(/?)>""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
GAP = re.compile(r"[\s/]*")
ATTRIBUTE_NAME = re.compile(r"[^\s/>][^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Fixed element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split())
#: An opening tag on the left closes an open element on the right, up to a container that shields it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
}
CLOSES_PARAGRAPH = BLOCKS - {"caption", "legend", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}

# Fixed lists of what is never part of an article.
DROPPED = frozenset(
    "head script style noscript template iframe object embed applet canvas svg math audio video map nav aside footer "
    "form button select datalist textarea input dialog menu noembed noframes xmp title".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status "
    "tooltip".split())
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination paywall popup promo promoted promotion recommended related "
    "replies reply respond rss share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar widget widgets".split())
JOINED = re.compile(r"side-?bar|pop-?up|sign-?up|log-?in|ad-?(?:box|slot|unit|wrap(?:per)?|container)", re.I)
#: Words that change nothing about what a name says.
FILLERS = frozenset(
    "area bar block bottom box button buttons container inner item items left link links list outer panel right section "
    "site slot top unit wrap wrapper".split())
LIKELY = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination paywall popup promo promoted promotion recommended related "
    "replies reply respond rss share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar widget widgets".split())
JOINED = re.compile(r"(?:^|[-_ ])(?:side-?bar|pop-?up|sign-?up|log-?in|ad-?(?:box|slot|unit|wrap(?:per)?|container))"
                    r"(?:$|[-_ ])", re.I)
LIKELY = frozenset("article body content entry hentry main page post story text".split())
PARAGRAPHS = frozenset({"p", "pre", "blockquote", "td", "li", "dd"})
KEEPERS = frozenset({"article", "main", "body", "html"})
#: So many containers above a paragraph get points from it.
LEVELS = 32


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    names: frozenset = frozenset()
    dropped: bool = False
    doubtful: bool = False
    children: list = field(default_factory=list)  # nodes and texts
    points: float = 0.0
    text_length: int = 0
    link_length: int = 0

    @property
    def density(self) -> float:
        return self.link_length / self.text_length if self.text_length else 0.0


def says(label: str, words: frozenset) -> bool:
    """Whether one of the names in a label consists of such words and fillers alone."""
    for name in label.split():
        parts = {x.lower() for x in NAME_PARTS.findall(name)}
        if parts & words and parts <= words | FILLERS or words is UNLIKELY and JOINED.fullmatch(name):
            return True
    return False


def unwanted(tag: str, given: dict[str, str], names: frozenset, in_article: bool, by_name: bool) -> bool:
    if tag in DROPPED or "hidden" in given or given.get("aria-hidden") == "true" or given.get("role") in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.I):
        return True
    label = f"{given.get('class', '')} {given.get('id', '')}" if by_name else ""
    if tag in KEEPERS:  # an article of reader comments is one all the same
        return tag == "article" and says(label, frozenset({"comment", "comments", "ad", "ads", "promo", "sponsored"}))
    if tag == "header" or says(label, frozenset({"header"})):  # inside an article it holds the title
        return not in_article
    return says(label, UNLIKELY)


def read_tag(html: str, at: int) -> tuple[dict[str, str], int, bool]:
    """(attributes, end, closes itself) of the tag whose name ends at ``at``; the end is -1 if the page ends first.

    A quote matters only behind an equals sign.
    """
    simple = SIMPLE.match(html, at)
    if simple:
        given = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(simple[1])} if simple[1] else {}
        return given, simple.end(), bool(simple[2])
    given: dict[str, str] = {}
    while True:
        gap = GAP.match(html, at)
        at = gap.end()
        if at >= len(html):
            return given, -1, False
        if html[at] == ">":
            return given, at + 1, gap[0].endswith("/")
        name = ATTRIBUTE_NAME.match(html, at)
        value, at = "", name.end()
        equals = EQUALS.match(html, at)
        if equals:
            at = equals.end()
            quote = html[at:at + 1]
            if quote in ('"', "'") and quote:
                end = html.find(quote, at + 1)
                if end < 0:
                    return given, -1, False
                value, at = html[at + 1:end], end + 1
            else:
                bare = BARE.match(html, at)
                value, at = bare[0], bare.end()
        given.setdefault(name[0].lower(), unescape(value))


def parse(html: str, by_name: bool = True) -> Node:
    """A tree of the page; end tags that are missing are supplied, stray ones ignored."""
    root = Node("html", None)
    path = [root]  # the open elements, and where those of each name stand among them
    open_at: dict[str, list[int]] = {"html": [0]}
    text_from = at = 0
    size = len(html)

    def leave(depth: int) -> None:
        while len(path) > depth:
            open_at[path.pop().tag].pop()

    def nearest(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    while True:
        at = html.find("<", at)
        if at < 0 or at + 1 >= size:
            break
        sign = html[at + 1]
        if sign in "!?":
            if text_from < at:
                path[-1].children.append(html[text_from:at])
            if html.startswith("<!--", at):
                end, close = html.find("-->", at + 4), 3
            elif html.startswith("<![CDATA[", at):
                end, close = html.find("]]>", at + 9), 3
                path[-1].children.append(html[at + 9:end if end >= 0 else size])
            else:
                end, close = html.find(">", at), 1
            text_from = at = size if end < 0 else end + close
            continue
        m = TAG_NAME.match(html, at + (2 if sign == "/" else 1))
        if m is None:
            at += 1
            continue
        if text_from < at:
            path[-1].children.append(html[text_from:at])
        given, end, closes_itself = read_tag(html, m.end())
        text_from = at = size if end < 0 else end
        if end < 0:
            break
        tag = m[0].lower()
        if sign == "/":
            depth = nearest((tag,))
            if depth > 0:
                leave(depth)
            continue
        if tag in CLOSES_PARAGRAPH and open_at.get("p"):
            depth = nearest(BLOCKS)
            if path[depth].tag == "p":
                leave(depth)
        if tag in CLOSES:
            ended, shields = CLOSES[tag]
            shield = nearest(shields)
            outermost = [open_at[t][i] for t in ended if t in open_at
                         and (i := bisect_right(open_at[t], shield)) < len(open_at[t])]
            if outermost:
                leave(min(outermost))
        if tag == "html" or tag == "body" and open_at.get("body"):
            continue
        names = frozenset()
        if by_name and ("class" in given or "id" in given):
            names = frozenset(x.lower() for x in NAME_PARTS.findall(f"{given.get('class', '')} {given.get('id', '')}"))
        in_article = bool(open_at.get("article") or open_at.get("main"))
        node = Node(tag, path[-1], names, unwanted(tag, given, names, in_article, by_name))
        node.doubtful = bool(names & UNLIKELY) and not names & LIKELY
        path[-1].children.append(node)
        if tag in VOID or closes_itself and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            ends = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
            node.children.append(html[at:ends.start() if ends else size])
            close = html.find(">", ends.end()) if ends else -1
            text_from = at = close + 1 if close >= 0 else size
            continue
        open_at.setdefault(tag, []).append(len(path))
        path.append(node)
    if text_from < size:
        path[-1].children.append(html[text_from:])
    return root


def lineage(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def walk(root: Node) -> Iterator[tuple[Node | str, bool, bool]]:
    """Nodes on entry and exit and texts, in page order: (item, leaving, inside a link). No dropped ones."""
    stack: list[tuple[Node | str, bool, bool]] = [(root, False, False)]
    while stack:
        item, leaving, linked = stack.pop()
        if isinstance(item, str):
            yield item, False, linked
            continue
        if item.dropped:
            continue
        yield item, leaving, linked
        if not leaving:
            linked = linked or item.tag == "a"
            stack.append((item, True, linked))
            stack.extend((c, False, linked) for c in reversed(item.children))


def blocks_of(root: Node) -> list[str]:
    """The texts of the blocks under ``root``, white space reduced, empty ones left out."""
    blocks: list[str] = []
    run: list[str] = []

    def finish() -> None:
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append(text)

    for item, _, _ in walk(root):
        if isinstance(item, str):
            run.append(item)
        elif item.tag in BLOCKS:
            finish()
        elif item.tag == "br":
            run.append(" ")
    finish()
    return blocks


def score(root: Node) -> list[Node]:
    """Gives every container its points; returns those that have some."""
    scored: dict[int, Node] = {}
    commas: list[int] = [0]
    open_nodes: list[tuple[Node, int, int]] = []
    length = links = 0
    for item, leaving, linked in walk(root):
        if isinstance(item, str):
            n = len(" ".join(item.split()))
            length += n
            links += n * linked
            commas[0] += item.count(",") + item.count("、") + item.count("，") + item.count("،")
            continue
        if not leaving:
            if item.tag != "br":
                open_nodes.append((item, length, links, commas[0]))
            continue
        if item.tag == "br":
            continue
        node, before, before_links, before_commas = open_nodes.pop()
        node.text_length, node.link_length = length - before, links - before_links
        loose = node.tag in ("div", "section", "article", "main", "body") and any(
            isinstance(c, str) and c.strip() for c in node.children)
        if node.tag not in PARAGRAPHS and not loose or node.text_length < 25:
            continue
        own = node.text_length if not loose else sum(len(c.strip()) for c in node.children if isinstance(c, str))
        points = 1 + own / 100 + (commas[0] - before_commas) * (1 if not loose else own / node.text_length)
        start = node if loose else node.parent
        for level, ancestor in enumerate(islice(lineage(start), LEVELS)):
            if ancestor.tag == "html":
                break
            ancestor.points += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            scored[id(ancestor)] = ancestor
    return list(scored.values())


def final_points(node: Node) -> float:
    weight = 1.0 + 0.25 * bool(node.names & LIKELY or node.tag in ("article", "main"))
    return node.points * (1 - node.density) * weight * (0.3 if node.doubtful else 1.0)


def article_blocks(root: Node) -> list[str]:
    candidates = score(root)
    if not candidates:  # no paragraph at all: whatever text the page has
        return blocks_of(root)
    best = max(candidates, key=final_points)
    for above in lineage(best.parent):
        if above.tag in ("article", "main"):
            best = above
    parent = best.parent
    if parent is None or best.tag == "body":
        return blocks_of(best)
    limit = max(10.0, 0.2 * final_points(best))
    kept: list[str] = []
    for node in parent.children:
        if not isinstance(node, Node) or node.dropped:
            continue
        if node is best or final_points(node) >= limit and node.density < 0.5 or (
            node.tag in ("p", "pre", "blockquote") and node.density < 0.25 and node.text_length > 0
        ):
            kept += blocks_of(node)
    return kept


def main_text(html: str | None) -> str:
    """The article of a page, blocks separated by an empty line; empty for null or empty input."""
    if not html:
        return ""
    return "\n\n".join(article_blocks(parse(html)) or article_blocks(parse(html, by_name=False)))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars), one row per input row, without a shuffle.

    Null or empty html gives an empty text. Pages of any length are read whole. Repeated rows
    are extracted each, an empty table gives an empty one, other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"),
                        F.col(html_col).cast("string").alias("_html"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in slices(batches, "_html"):
            texts = [main_text(h) for h in part.column("_html").to_pylist()]
            yield {"_id": part.column("_id"), "_url": part.column("_url"), "text": texts,
                   "n_chars": [len(t) for t in texts]}

    found = map_batches(rows, work, f"_id {id_type}, _url string, text string, n_chars long")
    return found.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")
