"""Main text of web pages, by removing what recurs across the pages of a host."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import written
from .scan import slices

#: Different main texts of a host that a subtree occurs with, from which on it is the site's template.
MIN_PAGES = 5

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "option", "optgroup"}
#: Elements that end an open element of the same family, and what that search stops at.
FAMILY = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
P_SCOPE = frozenset("article aside body blockquote div section main td th li table html form footer header nav dd figure details fieldset".split())
#: Elements that HTML itself says are not part of the text around them.
NOISE_TAGS = frozenset("head nav footer aside form script style noscript template textarea title iframe svg canvas object embed button select input dialog menu noembed noframes xmp audio video map".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tooltip".split())
#: Types of the schema.org vocabulary for parts of a page that are not its text.
NOISE_TYPES = frozenset("comment usercomments wpheader wpfooter wpsidebar wpadblock sitenavigationelement".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
#: What an article's own text is made of: it stays, however often it recurs on the host.
PROSE = HEADINGS | {"p", "blockquote", "pre", "br", "li", "td", "th", "tr", "tbody", "dt", "dd", "figcaption"}
CONTAINERS = frozenset("article main div section td body center #page".split())


class Node:
    """An element; parts are its texts (str) and child elements in page order."""

    __slots__ = ("tag", "attributes", "parts")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.parts = tag, attributes, []

    def named(self) -> dict[str, str]:
        if not self.attributes:
            return {}
        return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(self.attributes)}


def parse(page: str) -> Node:
    """A tree of the page, however broken; elements end where a browser would end them, nearly."""
    root = Node("#page")
    stack, at, end = [root], 0, len(page)

    def close_to(tags, stop) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if page[m.start()] != "<" or at - m.start() == 1:
                stack[-1].parts.append(entities.unescape(m[0]))
            continue
        tag, ends = name.lower(), m[1] or m[4]
        if ends:
            if tag in VOID and tag != "br":
                continue
            if tag not in BLOCK:
                close_to({tag}, BLOCK)
            elif tag == "p" or tag in FAMILY:
                close_to({tag}, P_SCOPE - {tag})
            else:
                close_to({tag}, ())
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in CLOSES_P:
            close_to({"p"}, P_SCOPE)
        if tag in FAMILY:
            close_to(*FAMILY[tag])
        node = Node(tag, m[3] or m[6] or "")
        stack[-1].parts.append(node)
        if tag not in VOID and not (node.attributes.endswith("/") and tag not in BLOCK):
            stack.append(node)
    return root


def _walk(root: Node) -> list[Node]:
    """All elements, parents before children, without recursion (a page may nest without end)."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(p for p in reversed(node.parts) if type(p) is Node)
    return out


def _is_noise(node: Node, in_article: bool) -> bool:
    if node.tag in NOISE_TAGS or (node.tag == "header" and not in_article):
        return True
    named = node.named()
    if not named:
        return False
    if named.get("role", "").lower() in NOISE_ROLES or "hidden" in named or named.get("aria-hidden", "").lower() == "true":
        return True
    return named.get("itemtype", "").lower().rstrip("/").rpartition("/")[2] in NOISE_TYPES or named.get("itemprop", "").lower() == "comment"


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or "main" in node.attributes and node.named().get("role", "").lower() == "main"


def text_of(node: Node, gone: set[int]) -> str:
    """Text of the subtree without the elements in `gone` (by id()), block by block, white space made single."""
    out, todo = [], [node]
    while todo:
        part = todo.pop()
        if type(part) is str:
            out.append(part)
        elif id(part) not in gone:
            if part.tag in BLOCK:
                out.append("\n")
                todo.append("\n")
            todo.extend(reversed(part.parts))
    return " ".join("".join(out).split())


def hashes(root: Node) -> dict[int, bytes]:
    """A hash of every subtree with a text in it, by id() of its element: tag and, in order, texts and subtrees."""
    out: dict[int, bytes] = {}
    for node in reversed(_walk(root)):
        digest, some = hashlib.blake2b(node.tag.encode(), digest_size=8), False
        for part in node.parts:
            if type(part) is Node:
                inner = out.get(id(part))
                if inner:
                    digest.update(b"\x01" + inner)
                    some = True
                continue
            words = " ".join(part.split())
            if words:
                digest.update(b"\x02" + words.encode("utf-8", "replace") + b"\x03")
                some = True
        if some:
            out[id(node)] = digest.digest()
    return out


class Page:
    """A parsed page: what HTML's own names say, hashes of its subtrees, and those that the site's template may own."""

    def __init__(self, page: str | None):
        self.root = parse(page or "")
        self.nodes = nodes = _walk(self.root)
        self.above = above = {id(p): n for n in nodes for p in n.parts if type(p) is Node}
        self.inside: set[int] = set()  # main or article elements and all in them
        self.gone: set[int] = set()
        for n in nodes:
            mine = id(above.get(id(n))) in self.inside
            if mine or _is_main(n):
                self.inside.add(id(n))
            if _is_noise(n, mine):
                self.gone.add(id(n))
        for n in nodes:
            if n.tag == "header" and id(n) in self.inside and id(n) not in self.gone:
                self.gone.update(id(p) for p in n.parts if type(p) is Node and p.tag not in HEADINGS and not any(x.tag in HEADINGS for x in _walk(p)))
        self.hash = hashes(self.root)
        self.candidates = [
            n for n in nodes
            if n.tag in BLOCK and id(n) in self.hash and n.tag not in ("html", "body") and not (id(n) in self.inside and n.tag in PROSE)
        ]

    def _within(self, node: Node, tags: set[str] | frozenset[str]) -> bool:
        while (node := self.above.get(id(node))) is not None:
            if node.tag in tags:
                return True
        return False

    def mains(self, gone: set[int]) -> list[Node]:
        """The elements with the main text, of what is not gone: the articles in page order, if they hold most of the text of the
        main element; else this element; else the element that holds most prose itself or through one element between."""
        left: list[Node] = []
        dropped: set[int] = set()
        for n in self.nodes:
            if id(n) in gone or id(self.above.get(id(n))) in dropped:
                dropped.add(id(n))
            else:
                left.append(n)
        articles = [n for n in left if n.tag == "article" and not self._within(n, {"article"})]
        # an article inside an article is a reader's comment on it, unless the outer one has no text of its own
        read = [(n, self._without_inner(n, gone)) for n in articles]
        articles = [n for n, text in read if text]
        others = [n for n in left if n.tag != "article" and _is_main(n) and not self._within(n, {"article"})]
        other = max(others, key=lambda n: len(text_of(n, gone)), default=None)
        if other is not None:
            held = sum(len(t) for _, t in read)
            outside = sum(len(t) for n, t in read if not self._is_in(n, other))
            if articles and 2 * held > len(text_of(other, gone)) + outside:
                return articles
            if text_of(other, gone):
                return [other]
        if articles:
            return articles
        scores: dict[int, int] = {}
        for n in left:
            if n.tag in PROSE and not self._within(n, PROSE):
                size, at = len(text_of(n, gone)), n
                for _ in range(2):
                    at = self.above.get(id(at), self.root)
                    while at.tag not in CONTAINERS and id(at) in self.above:
                        at = self.above[id(at)]
                    scores[id(at)] = scores.get(id(at), 0) + size
                    if at is self.root:
                        break
        return [max(enumerate(left), key=lambda x: (scores.get(id(x[1]), 0), x[0] if scores else -x[0]))[1]] if left else []

    def _is_in(self, node: Node, outer: Node) -> bool:
        while (node := self.above.get(id(node))) is not None:
            if node is outer:
                return True
        return False

    def _without_inner(self, article: Node, gone: set[int]) -> str:
        inner = {id(n) for n in _walk(article) if n.tag == "article" and n is not article}
        own = text_of(article, gone | inner) if inner else ""
        return own or text_of(article, gone)

    def text(self, template: set[bytes]) -> str:
        """The main text of what is left without the template's subtrees and what HTML's names rule out."""
        gone = self.gone | {id(n) for n in self.candidates if self.hash[id(n)] in template}
        texts = (self._without_inner(m, gone) if m.tag == "article" else text_of(m, gone) for m in self.mains(gone))
        return " ".join(t for t in texts if t)

    def story(self) -> bytes:
        """A hash of the main text by HTML's names alone: pages with equal ones are copies, and one witness of a template."""
        return hashlib.blake2b(self.text(set()).encode("utf-8", "replace"), digest_size=8).digest()


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    Element subtrees (menus, notices, adverts and footers included) are hashed: tag, texts, subtrees.  Those found with at least
    min_pages different main texts on a host are the site's template and are deleted, wherever they stand; copies of one
    article are one witness.  Only elements that HTML itself names as no part of the text (nav, footer, aside, form, script,
    header outside an article, their ARIA roles, schema.org types, hidden ones) are deleted without being counted; names of classes
    mean nothing.  Paragraphs, headings, items and cells inside an article or main element are its own and stay even if they recur.

    The text is that of the articles in page order, if they hold most of the text of the main element; else that of this
    element; else of the element that holds most prose.  Articles inside an article are comments on it.

    Null or empty html: empty text.  A null or relative url: one host, "".  Pages equal in url and html
    count once as evidence and each give a row.  No rows: no rows.  Other columns are left out, whatever their names.
    """
    rows = pages.select("page_id", "url", "html").withColumn("_page", F.xxhash64("url", "html"))
    rows = rows.withColumn("_host", F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")))
    number = lambda h: int.from_bytes(h, "little", signed=True)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                keys, hosts, found, stories = [], [], [], []
                for key, host, html in zip(*(part.column(k).to_pylist() for k in range(3))):
                    page = Page(html)
                    mine = {page.hash[id(n)] for n in page.candidates}
                    keys += [key] * len(mine)
                    hosts += [host] * len(mine)
                    found += [number(h) for h in mine]
                    stories += [number(page.story())] * len(mine)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(stories, pa.int64())], ["_page", "_host", "_tree", "_story"]
                )

    trees = written(rows.select("_page", "_host", "html").mapInArrow(find, "_page long, _host string, _tree long, _story long"))
    witnesses = trees.select("_host", "_tree", "_story").distinct()
    template = written(witnesses.groupBy("_host", "_tree").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pages))
    owned = trees.join(template, ["_host", "_tree"]).groupBy("_page").agg(F.collect_set("_tree").alias("_template"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                out = []
                for html, template in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    out.append(Page(html).text({t.to_bytes(8, "little", signed=True) for t in template or ()}))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = rows.join(written(owned), "_page", "left").select("page_id", "url", "html", "_template")
    return joined.mapInArrow(read, "page_id long, url string, text string, n_chars long")
