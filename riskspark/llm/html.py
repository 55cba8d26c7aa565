"""Main text of web pages by site template removal.

A page is read once into a light tree of elements. Every container element outside prose gets a
Merkle hash of its subtree (tag, attributes that name it, text, children). Spark counts, per host, on
how many pages of different content a subtree occurs; subtrees that recur across many pages of their
host are its template and are deleted. Elements whose tag is not main text (scripts, styles, navigation, ...) are
deleted even where they occur once. So are forms, and elements that name themselves header, sidebar,
advert, notice, comments and the like, unless they hold over half of the page's text: a name is believed only as a whole
(all parts of a class, id or role value are such words), never for a part of another word. What remains of
the page is read block by block; article and main elements only say which subtrees hold the page's
content and so are never template.
"""

from __future__ import annotations

import functools
import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import chunked, stage, with_python
from riskspark.llm.urlgraph import host_of

#: Pages of different content from which a subtree is template, however many pages its host has.
MIN_PAGES = 3

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never main text.
DROP = set("head script style noscript template title textarea iframe object svg canvas video audio button select nav footer aside menu dialog xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr tbody thead tfoot caption figcaption ul ol dl table figure article main body html".split())
#: Words that an element's class, id or role uses for what is not main text.
ROLE_WORDS = set("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo banner cookie cookies consent notice notices notification alert gdpr popup modal newsletter "
                 "subscribe nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside complementary widget widgets related share sharing social comment comments reply replies respond disqus "
                 "discussion opinions feedback masthead topbar footer contentinfo copyright login search skip pagination pager hidden".split())
#: Words that may stand beside them in such a name.
BESIDE = set("site page main top bottom left right global local primary secondary inner outer box list item items wrapper wrap container section area bar block group panel content thread form links link "
             "buttons button text header head title foot col column row the my and us with for of s".split())
#: The head holds these only; anything else ends it.
HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
#: A start tag of one of these ends an open paragraph.
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@functools.lru_cache(maxsize=50_000)
def _names(attrs: str) -> tuple[str, bool, bool]:
    """(the naming attributes, whether they say that this is not main text, whether they call it a header)."""
    found = [next(x for x in m.groups()[1:] if x is not None) for m in _ATTR.finditer(attrs)]
    values = [v for x in found for v in x.split()]
    parts = [_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower()) for v in values]
    says = any(any(w in ROLE_WORDS for w in p) and all(w in ROLE_WORDS or w in BESIDE for w in p) for p in parts)
    return " ".join(found).lower(), says, any("header" in p and all(w in BESIDE for w in p) for p in parts)


class Node:
    """``drop``: not main text by its tag; ``says``: by its own name, which hash_tree() weighs; ``shade``: below one that says so."""

    __slots__ = ("tag", "names", "drop", "says", "shade", "kids", "hash", "size", "core")

    def __init__(self, tag: str, names: str = "", drop: bool = False, says: bool = False, shade: bool = False):
        self.tag, self.names, self.drop, self.says, self.shade, self.kids, self.hash, self.size, self.core = tag, names, drop, says, shade, [], 0, 0, 0


def parse(text: str) -> Node:
    """Tolerant tree: unknown end tags are ignored, missing ones implied; kids are nodes and raw strings."""
    root = Node("#root")
    stack, at, n = [root], 0, len(text)
    while at < n:
        m = _TOKEN.search(text, at)
        if (m is None or m.start() > at) and stack[-1].tag == "head" and text[at:m.start() if m else n].strip():
            stack.pop()  # text ends the head
        if m is None:
            stack[-1].kids.append(text[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(text[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag closes up to its element, if that is open
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        attrs = m[3] or m[6] or ""
        if stack[-1].tag == "head" and tag not in HEAD:
            stack.pop()
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        elif tag in CLOSES_SELF:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES_SELF[tag]:
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE and stack[k].tag != "p":
                    break
        names, says, header = _names(attrs) if attrs else ("", False, False)
        drop, says = tag in DROP, tag == "form" or (says and tag not in ("html", "body", "main"))
        if not drop and (header or tag == "header") and not any(s.tag in ("article", "main") for s in stack):  # an article's own header holds its headline
            says = True
        node = Node(tag, names, drop, says, stack[-1].says or stack[-1].shade)
        stack[-1].kids.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in RAW and tag not in ("p", "div", "article", "section"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at) if tag not in _RAW_END else _RAW_END[tag].search(text, at)
            node.kids.append(text[at:end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def _walk(root: Node) -> list[Node]:
    """All nodes, children before parents, without recursion."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if isinstance(k, Node)]
    return order[::-1]


def _measure(order: list[Node], strict: bool) -> None:
    """Text length of every subtree outside what is dropped: in all, and within article and main elements (``core``);
    ``strict``: without those that name themselves no main text or lie below one that does (comments are articles too)."""
    for node in order:
        size = core = 0
        for k in node.kids:
            if isinstance(k, Node):
                size += k.size
                core += k.core
            else:
                size += len(k.strip())
        own = node.tag in ("article", "main") and not (strict and (node.says or node.shade))
        node.size, node.core = (0, 0) if node.drop else (size, size if own else core)


def hash_tree(root: Node) -> None:
    """Merkle hashes and lengths. An element that names itself no main text is dropped, unless it holds over half of the text of
    the page's article and main elements (of the page where it has none)."""
    order = _walk(root)
    for node in order:
        h = xxhash.xxh3_64(f"{node.tag}\x1f{node.names}\x1e".encode())
        for k in node.kids:
            if isinstance(k, Node):
                h.update(k.hash.to_bytes(8, "big"))
            elif s := k.strip():
                h.update(b"\x1d" + s.encode("utf-8", "surrogatepass"))
        node.hash = h.intdigest()
    _measure(order, True)
    if strict := not root.core:
        _measure(order, False)
    named = [node for node in order if node.says and not node.drop]
    small = [node for node in named if (2 * node.core <= root.core if root.core else 2 * node.size <= root.size)]
    for node in small:
        node.drop = True
    if small:  # the lengths again, without what was dropped
        _measure(order, not strict)


def content_key(root: Node) -> int:
    """Hash of all article and main elements that aren't dropped, in page order; without such, of the page."""
    if not root.core:
        return root.hash
    h, todo = xxhash.xxh3_64(), [root]
    while todo:
        node = todo.pop()
        if node.drop or not node.core:
            continue
        if node.tag in ("article", "main"):
            h.update(node.hash.to_bytes(8, "big"))
        else:
            todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return h.intdigest()


def may_be_template(node: Node, root: Node) -> bool:
    """Not prose, not inline, and without more than half of the text in the page's article and main elements, or of
    the page where it has none."""
    if node.tag in PROSE or node.tag in INLINE or node.tag in ("#root", "head"):
        return False
    return 2 * node.core <= root.core if root.core else 2 * node.size <= root.size


def subtrees(text: str) -> tuple[int, list[int]]:
    """(content key, hashes of the subtrees that may be template)."""
    root = parse(text)
    hash_tree(root)
    out, todo = set(), [root]
    while todo:
        node = todo.pop()
        if may_be_template(node, root):
            out.add(node.hash)
            if node.drop:
                continue
        todo += [k for k in node.kids if isinstance(k, Node)]
    return content_key(root), sorted(out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def extract(text: str, template=frozenset()) -> str:
    """The blocks of the main text, one line each."""
    root = parse(text)
    hash_tree(root)
    blocks: list[str] = []
    run: list[str] = []

    def flush():
        line = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
        run.clear()
        if line:
            blocks.append(line)

    todo: list = [root]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            run.append(k)
        elif k is None:
            flush()
        elif k.drop or (k.hash in template and may_be_template(k, root)):
            if k.tag not in INLINE:
                flush()
        elif k.tag in INLINE:
            if k.tag == "br":
                run.append(" ")
            todo += reversed(k.kids)
        else:
            flush()
            todo.append(None)
            todo += reversed(k.kids)
    flush()
    return "\n".join(blocks)


def page_subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, content, h) of every subtree that may be template. pages: (host, page, html)."""
    schema = pa.schema([("host", pa.string()), ("page", pa.string()), ("content", pa.int64()), ("h", pa.int64())])

    def rows(batches):
        for b in batches:
            for host, page, text in zip(*(c.to_pylist() for c in b.columns)):
                content, hashes = subtrees(text)
                for h in hashes:
                    yield host, page, _signed(content), _signed(h)

    seen = with_python(pages.select("host", "page", "html")).mapInArrow(lambda bs: chunked(rows(bs), schema, max_rows=1 << 15), "host string, page string, content long, h long")
    return seen.distinct()


def templates_of(seen: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, h): template subtrees of page_subtrees(). Pages of equal main content count once."""
    return seen.select("host", "content", "h").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "h")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text.

    NULL or empty html: empty text. A NULL url has the empty host, which is a host like any other.
    Prose (paragraphs, headings, list items, tables) is never template by itself, however often it
    recurs, and a subtree with over half of the text in the page's article and main elements (or of the page's
    text where it has none) never is. Text outside these elements stays unless it is template or of a dropped
    kind. Repeated rows stay, and count once for the template. An empty table gives no rows.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("page", F.md5(F.concat_ws("\n", "host", "html")))
    # both written first: the join's sides are then plain, and a subtree that very many pages hold can be split
    seen = stage(page_subtrees(base), "subtrees")
    found = stage(templates_of(seen, min_pages), "templates")
    hit = seen.join(found, ["host", "h"]).groupBy("page").agg(F.collect_set("h").alias("hs"))
    joined = base.join(hit, "page", "left").select("page_id", "url", "html", "hs")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches):
        def rows(b):
            for p, u, text, hs in zip(*(c.to_pylist() for c in b.columns)):
                yield p, u, extract(text, frozenset(x & ((1 << 64) - 1) for x in hs or ()))
        for b in batches:
            yield from chunked(rows(b), schema, weigh=lambda r: len(r[2]))

    return with_python(joined).mapInArrow(run, "page_id long, url string, text string")
