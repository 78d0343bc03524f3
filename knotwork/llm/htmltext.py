"""Main text of web pages by consensus paths of their host.

Each page's containers are scored by the text in their blocks that is no link.
Every container votes with its score for its generalised path (tags and classes,
numbers left out), and Spark adds the votes of all pages of a host. Pages are
then extracted again from the container with the host's winning path; a page
that lacks it uses its own best container.

What goes inside the winner is decided by elements, not by names: elements that
never hold an article's text, the header of a page (one in an article stays),
hidden parts, standard roles of page furniture, and lists or boxes that are links for the most part. A
box whose class or id has a word of page furniture is only a suspect: it goes if
the same path stands on most pages of the host that have the winner, so that it is
part of the template. Where a host has one page, words that mean nothing but
furniture settle it. Headings, paragraphs, quotations and boxes with most of
the winner's text never go by their names.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize
from .urlfilter import split_url

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
#: Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed iframe noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINER = frozenset("article body div main section td blockquote".split())
DROPPED = frozenset("aside audio button canvas datalist dialog embed footer form head iframe input map menu meter nav noembed noframes noscript object optgroup option progress script select style svg template textarea title video".split())
#: Boxes that may be furniture; headings, paragraphs, quotations, code and the like are not.
BOX = frozenset("div section ul ol dl table header details figure".split())
CLOSES_P = BLOCK - {"html", "body"}
#: Roles of page furniture in the ARIA standard.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Words in class or id that make a box a suspect, which goes if it is template of its host, and those that settle it on any host.
SUSPECT = frozenset("header search related recommended social teaser copyright disclaimer widget rail".split())
CLEAR = frozenset("ad ads advert adverts advertisement advertising sponsored promo promotion nav navbar menu menus toolbar banner masthead breadcrumb breadcrumbs sidebar notice notices alert cookie cookies gdpr popup modal newsletter subscribe login signup share sharing comments comment replies disqus pagination pager footer".split())
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
_DIGITS = re.compile(r"\d+")
#: Share of link text from which a box counts as links, and share of a host's pages from which a suspect is template.
LINKS, TEMPLATE = 0.6, 0.5
#: Hosts up to which their winners (some hundred bytes each) are broadcast.
MANY = 200_000


class Node:
    __slots__ = ("tag", "mark", "path", "drop", "suspect", "links", "children", "parent", "stop", "text", "link")

    def __init__(self, tag: str, mark: str, parent: Node | None, drop: bool, suspect: int = 0):
        self.tag, self.parent, self.drop, self.suspect = tag, parent, drop, suspect
        # a digest of the path, so that depth costs nothing
        self.path = xxhash.xxh64_intdigest(mark, parent.path if parent else 0) >> 1
        #: A box of links, such as a menu or an article's sources.
        self.links = False
        self.children: list[Node | str] = []
        #: The nearest node, itself included, that ends the search for an open p.
        self.stop = self if parent is None or tag in CONTAINER or tag == "p" else parent.stop
        self.text = self.link = 0


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def _hidden(attrs: dict[str, str]) -> bool:
    if "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    style = attrs.get("style", "").replace(" ", "").lower()
    return "display:none" in style or "visibility:hidden" in style


def _suspicion(attrs: dict[str, str]) -> int:
    """0, or 1 for a suspect, 2 for a clear one, by the words of class and id."""
    words = {w.lower() for k in ("class", "id") for w in _WORD.findall(attrs.get(k, ""))}
    return 2 if words & CLEAR else 1 if words & SUSPECT else 0


#: What an item's start closes, and where the search for it ends.
_ITEMS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS = frozenset("ul ol dl table select #".split())


def parse(source: str) -> Node:
    """A tree of the page. Wrong nesting, missing ends and truncated tags are
    taken as browsers would roughly take them; nothing is dropped here."""
    root = here = Node("#", "", None, False)
    open_: dict[str, int] = {}
    articles = 0

    def leave(node: Node) -> Node:
        """Close everything up to node and node itself; its parent."""
        nonlocal here, articles
        while True:
            open_[here.tag] -= 1
            articles -= here.tag in ("article", "main")
            done, here = here is node, here.parent
            if done:
                return here

    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        if not m:
            here.children.append(source[at:])
            break
        if m.start() > at:
            here.children.append(source[at : m.start()])
        at = max(m.end(), m.start() + 1)
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                here.children.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:  # an end: close up to its start, if there is one
            if open_.get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                leave(node)
            continue
        attrs = _attributes(m[3]) if m[3] and not m[3].isspace() else {}
        if tag in CLOSES_P and here.stop.tag == "p":
            leave(here.stop)
        if tag in _ITEMS and any(open_.get(x) for x in _ITEMS[tag]):
            node, ends = here, _ENDS | {"tr"} if tag in ("td", "th") else _ENDS
            while node.tag not in _ITEMS[tag] and node.tag not in ends:
                node = node.parent
            if node.tag in _ITEMS[tag]:
                leave(node)
        names = sorted(_DIGITS.sub("", c) for c in attrs.get("class", "").split())
        mark = ".".join([tag, *(c for c in names if c)])
        whole = tag in ("html", "body", "article", "main")
        drop = tag in DROPPED or (tag == "header" and not articles) or bool(attrs) and (_hidden(attrs) or (not whole and attrs.get("role", "").lower() in ROLES and tag in BOX))
        new = Node(tag, mark, here, drop, _suspicion(attrs) if attrs and tag in BOX else 0)
        here.children.append(new)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:/[^>]*)?>", re.I).search(source, at)
            new.children.append(source[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/"):
            here = new
            open_[tag] = open_.get(tag, 0) + 1
            articles += tag in ("article", "main")
    return root


def blocks(top: Node) -> list[str]:
    """Text of the blocks under top in page order: references decoded, white
    space as one space, trimmed, empty ones left out."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list[tuple[Node, int]] = [(top, 0)]
    while stack:
        node, k = stack.pop()
        if k == 0 and node.tag in BLOCK:
            close()
        if k >= len(node.children):
            if node.tag in BLOCK:
                close()
            continue
        stack.append((node, k + 1))
        child = node.children[k]
        if isinstance(child, str):
            run.append(child)
        elif child.tag == "br" or child.tag == "wbr":
            run.append(" " if child.tag == "br" else "")
        elif not child.drop:
            stack.append((child, 0))
    close()
    return out


def ordered(root: Node) -> list[tuple[Node, bool]]:
    """Nodes that aren't dropped, each before its children, and whether in a link."""
    out: list[tuple[Node, bool]] = []
    stack = [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        out.append((node, linked))
        stack += [(c, linked) for c in reversed(node.children) if not isinstance(c, str) and not c.drop]
    return out


def containers(root: Node) -> list[tuple[Node, float]]:
    """Containers with their scores: the square root of each block's text that
    isn't links counts fully for its container, less for those farther out.

    Square roots favour many blocks over one; article and main elements weigh
    more than body and div. Added up from the leaves, and so are the lengths of
    text and link text by which boxes of links are found first, whose text counts
    for nothing.
    """
    nodes = ordered(root)
    for node, linked in reversed(nodes):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        inner = [c for c in node.children if not isinstance(c, str) and not c.drop]
        node.text = own + sum(c.text for c in inner)
        node.link = node.text if linked else sum(c.link for c in inner)
        if node.tag in BOX and node.text and node.link >= LINKS * node.text and sum(c.tag == "li" or c.tag == "a" for c in inner) > 1:
            node.links, node.suspect = True, max(1, node.suspect)
    score: dict[int, float] = {}
    found = []
    for node, linked in reversed(nodes):
        text = 0 if linked else sum(len(c.strip()) for c in node.children if isinstance(c, str))
        got = math.sqrt(text) + sum(score.pop(id(c)) for c in node.children if not isinstance(c, str) and not c.drop)
        got *= not node.links
        if node.tag in CONTAINER:
            if got:
                found.append((node, got * (1.5 if node.tag in ("article", "main") else 0.6 if node.tag == "body" else 1.0)))
            got *= 0.9
        score[id(node)] = got
    return found[::-1]


def suspects(own: list[Node]) -> Iterator[tuple[Node, bool]]:
    """Boxes within the containers that may be furniture, by their names, links and
    size, and whether they are part of an article or main element."""
    for top in own:
        inside: set[int] = set()
        for node, _ in ordered(top):
            if node.tag in ("article", "main") or id(node.parent) in inside:
                inside.add(id(node))
            if node.suspect and node is not top and (node.links or 2 * node.text <= top.text):
                yield node, id(node) in inside


def chosen(root: Node, winner: int | None) -> list[Node]:
    """The containers with the winning path, or else the best one (of equal ones
    the first of the page), in page order, none within another."""
    found = containers(root)
    own = {id(node) for node, _ in found if node.path == winner}
    if not own and found:
        own = {id(max(found, key=lambda x: x[1])[0])}
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if id(node) in own:
            order.append(node)
        else:
            stack += [c for c in reversed(node.children) if not isinstance(c, str) and not c.drop]
    return order


def extract(source: str, winner: int | None, template: frozenset[int] | None) -> str:
    """Text of the containers with the winning path, or else of the best one.

    Clear suspects go, on whatever host. The others go if their path is in the
    host's template; where nothing is known of other pages (None), boxes of links
    go that no article or main element holds.
    """
    root = parse(source)
    own = chosen(root, winner)
    if not own:
        return "\n".join(blocks(root))
    for node, inside in suspects(own):
        node.drop = node.suspect == 2 or (node.links and not inside if template is None else node.path in template)
    return "\n".join(b for node in own for b in blocks(node))


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, kind, path, n): the votes for each container's path, the number of pages
    that have a suspect of a path, and the number of all pages. Added up before
    they are shuffled."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1 << 20):
            found: dict[tuple[str, str, int | None], float] = {}
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                root, best = parse(source), {}
                for node, s in containers(root):
                    best[node.path] = max(best.get(node.path, 0.0), s)
                total = sum(best.values())
                marks = [(("vote", path), s / total * 1e6) for path, s in best.items()]
                marks += [(("suspect", path), 1) for path in {node.path for node, _ in ordered(root) if node.suspect}]
                for (kind, path), n in [*marks, (("pages", None), 1)]:
                    found[host, kind, path] = found.get((host, kind, path), 0) + n
            columns = [*zip(*found, strict=True), map(int, found.values())] if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "kind", "path", "n"])

    return pages.select("host", "html").mapInArrow(vote, "host string, kind string, path long, n long").groupBy("host", "kind", "path").agg(F.sum("n").alias("n"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, winner, pages, template): the path with the most votes of a host's
    pages, ties to the smaller digest; and the paths of suspects on more than half
    of its pages, no more than twice what a page has on average, null where it
    has a single page."""
    votes = materialize(host_votes(pages))
    # a vote that rounds to nothing still is one
    one = F.min_by("path", F.when(F.col("kind") == "vote", F.struct(-F.col("n"), "path")))
    hosts = votes.where("kind <> 'suspect'").groupBy("host").agg(one.alias("winner"), F.max(F.when(F.col("kind") == "pages", F.col("n"))).alias("pages"))
    often = votes.where("kind = 'suspect'").join(hosts.select("host", "pages"), "host").where(F.col("n") > TEMPLATE * F.col("pages"))
    often = often.groupBy("host").agg(F.collect_list("path").alias("template"))
    template = F.when(F.col("pages") > 1, F.coalesce("template", F.array().cast("array<long>")))
    return hosts.join(often, "host", "left").select("host", "winner", "pages", template.alias("template"))


def beside_host(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """pages with the columns of hosts(host, pages, ...). Many hosts come by a join
    on host, except those with many pages, which are few and broadcast."""
    if hosts.limit(MANY + 1).count() <= MANY:
        return pages.join(F.broadcast(hosts), "host", "left")
    large = hosts.agg(F.sum("pages")).first()[0] // MANY
    often = hosts.where(F.col("pages") > large)
    marked = pages.join(F.broadcast(often.select("host", F.lit(True).alias("often"))), "host", "left")
    rest = marked.where("often is null").drop("often").join(hosts, "host", "left")
    return marked.where("often").drop("often").join(F.broadcast(often), "host", "left").unionByName(rest)


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with text and n_chars, one row per row.

    Null html counts as empty and gives empty text. Pages without a host share
    the votes of the empty host.
    """
    host, _ = split_url(F.col("url").cast("string"))
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    hosts = materialize(host_paths(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1 << 20):
            rows = zip(*(b.column(k).to_pylist() for k in ("html", "winner", "template")), strict=True)
            text = [extract(s, w, None if t is None else frozenset(t)) for s, w, t in rows]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = beside_host(pages, hosts).select("page_id", "url", "html", "winner", "template")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10(pages: DataFrame) -> DataFrame:
    """Main text of every page.

    Null or empty html gives empty text. Pages are read whole, however long or
    deep. Ties: votes go to the smaller path digest, a page's own best container
    is the first of equal ones. Repeated rows vote and get a row each; rows
    without url share the empty host. An empty table gives no rows; other columns
    aren't looked at.
    """
    return main_text(pages)
