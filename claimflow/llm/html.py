"""Main text of web pages by site template removal.

A page is parsed into an element tree. Every container element outside ``article``, ``main`` and prose
(menus, boxes, lists, tables, headers, footers) gets a hash of its whole subtree; Spark counts, for each
host, on how many pages with different prose outside it a subtree occurs. Subtrees on at least
``MIN_PAGES`` of them, and on ``MIN_SHARE`` of the host's pages with different main text, are template
and are deleted. Counting different prose outside the subtree, not pages, keeps what recurs only because
a page has copies, under whatever title. Nothing in an ``article`` or ``main`` element is deleted by
count, nor any paragraph, quote or code, nor a container with half of the page's prose. Where a page has
no such element and its copies differ in a paragraph, the smaller parts of a divided body can still count
as template, if they stand on that share of the host. A host with few pages shows no template, so
elements that say what they are by tag, role or class (nav, aside, footer, form, "ad", "comments" ...)
go too; in an article only a whole class or id says so, not a part of it, and math and labels are text.

The main text is what remains of the ``article`` elements in the page's ``main`` elements, else of
``main``, else of the outermost articles, else of the body; an article or main element whose class or id
names it a comment, advert or the like counts as none. A block ends at every block-level tag and at ``br``.

Defined results: null and empty html, and pages without main text, give the empty string. Markup that
is cut off or badly nested is closed the way browsers do (a new paragraph or list item closes the open
one; what is open at the end is closed there). Repeated rows give equal results. A null or odd url is
a host of its own, the empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.llm.common import small_batches, stored

MIN_PAGES = 5
#: Template stands on this part of a host's distinct pages, too.
MIN_SHARE = 0.25

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body br canvas center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section select summary"
    " table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("br body html head option optgroup td th tr tbody thead tfoot title".split())
P_BORDERS = frozenset("table td th button object article section div li body".split())
#: A start tag closes these open elements, unless one of the second set stands between.
AUTO_CLOSE = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}

#: Elements that are never main text, by tag, role and word in class or id.
DROP_TAGS = frozenset(
    "head script style noscript template nav aside footer form button select textarea input iframe object embed svg"
    " canvas audio video dialog menu option label fieldset map math title datalist".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted breadcrumb"
    " breadcrumbs cookie cookies consent gdpr notice notices comment comments disqus sidebar sidebars side-bar menu menus"
    " nav navbar navigation footer footers header headers masthead share sharing social related recommended newsletter"
    " subscribe subscription signup login popup modal overlay widget widgets pagination pager skip-link toolbar topbar"
    " copyright legal disclaimer tags breadcrumb-nav reply replies".split())
#: Elements that are text in an article.
ARTICLE_TAGS = frozenset("math label".split())
#: Names that stand for themselves in an article, where a part of a name says nothing.
DROP_NAMES = DROP_WORDS | frozenset(
    "ad-box ad-container ad-slot ad-unit ad-wrapper google-ads sponsored-content cookie-banner cookie-notice comment-form"
    " comment-list comments-area comments-section share-bar share-buttons share-links sharing-buttons social-icons"
    " social-links social-media social-share related-articles related-links related-posts related-stories newsletter-box"
    " newsletter-form newsletter-signup sidebar-left sidebar-right nav-bar nav-links nav-menu page-footer site-footer"
    " site-header site-nav post-tags entry-tags tag-links post-navigation".split())
#: Prose: never template. ``header`` inside an article holds its title, so it stays there.
PROSE = frozenset("html body article main p h1 h2 h3 h4 h5 h6 hgroup pre blockquote figure figcaption dt dd br td th tr".split())
#: Elements whose subtrees are counted.
CONTAINER = frozenset(
    "nav aside footer header div section ul ol dl table form menu details fieldset address center".split())

#: Elements whose texts tell pages apart.
PARAGRAPH = frozenset("p pre blockquote figcaption".split())

_TAG = re.compile(
    # A quote opens a value only after "="; anywhere else it is a character like others.
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")


class Node:
    __slots__ = ("tag", "attributes", "children", "parent", "in_p")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.children, self.parent = tag, attributes, [], parent
        #: Whether a new block closes a paragraph here; deep pages are not climbed to find out.
        self.in_p = tag == "p" or (parent is not None and parent.in_p and tag not in P_BORDERS)


def parse(page: str) -> Node:
    """Element tree of a page; children are nodes and strings of raw text."""
    root = at = Node("#root", "", None)
    end, pos = len(page), 0
    while pos < end:
        found = _TAG.search(page, pos)
        if found is None:
            at.children.append(page[pos:])
            break
        if found.start() > pos:
            at.children.append(page[pos : found.start()])
        pos = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue  # comment, doctype, stray end
        if found[1]:
            node = at
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                at = node.parent
            elif tag in ("p", "br"):
                at.children.append(Node(tag, "", at))
            continue
        if tag in CLOSES_P and at.in_p:
            at = _closed(at, {"p"}, P_BORDERS)
        if tag in AUTO_CLOSE:
            at = _closed(at, *AUTO_CLOSE[tag])
        if tag in ("body", "html") and any(x.tag == tag for x in _upwards(at)):
            continue
        if tag == "body":
            at = _closed(at, {"head"}, set())
        node = Node(tag, found[3], at)
        at.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            node.children.append(page[pos : close.start() if close else end])
            pos = close.end() if close else end
        elif tag not in VOID and not found[3].rstrip().endswith("/"):
            at = node
        elif tag not in VOID:
            at = node if tag in BLOCK else at  # a slash closes nothing but void and foreign elements
    return root


def _upwards(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _closed(at: Node, tags: set, borders: set) -> Node:
    """The parent of the outermost open element among ``tags`` below a border, else ``at``."""
    out = at
    for node in _upwards(at):
        if node.tag in tags:
            out = node.parent
        elif node.tag in borders:
            break
    return out


def _attributes(node: Node) -> dict[str, str]:
    if not node.attributes:
        return {}
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(node.attributes)}


def dropped(node: Node, in_article: bool) -> bool:
    """Whether an element says that it is no main text."""
    if (node.tag in DROP_TAGS and not (in_article and node.tag in ARTICLE_TAGS)) or (node.tag == "header" and not in_article):
        return True
    if not node.attributes or node.tag in ("html", "body"):
        return False
    in_article = in_article or node.tag in ("article", "main")  # judged by whole names wherever they stand
    a = _attributes(node)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in DROP_ROLES:
        return True
    if re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return True
    names = f"{a.get('class', '')} {a.get('id', '')}".lower()
    names = names.replace("_", "-")
    words = set(names.split() if in_article else _WORD.findall(names))
    if node.tag == "header" or re.fullmatch(r"h[1-6]", node.tag):
        words -= {"header", "headers"}
    if in_article:
        return bool(words & DROP_NAMES)
    parts = words | {p for w in words for p in w.split("-")} if node.tag not in PROSE else words
    return bool(parts & DROP_WORDS)


def _find(root: Node, tag: str) -> list[Node]:
    """Outermost elements with a tag that are not dropped and stand in nothing dropped."""
    out, rest = [], root.children[::-1]
    while rest:
        child = rest.pop()
        if isinstance(child, Node) and not dropped(child, False):
            if child.tag == tag:
                out.append(child)
            else:
                rest += child.children[::-1]
    return out


def main_elements(root: Node) -> tuple[list[Node], bool]:
    """The articles in the main elements, else the main elements, else the articles, else the page."""
    if mains := _find(root, "main"):
        return [a for m in mains for a in _find(m, "article")] or mains, True
    found = _find(root, "article")
    return (found, True) if found else ([root], False)


def main_text(roots: list[Node], in_article: bool, template: frozenset | set = frozenset(),
              hashes: dict | None = None) -> str:
    """Blocks of the given elements without what is dropped or template."""
    blocks: list[list[str]] = [[]]

    for root in roots:
        blocks.append([])
        stack = [(root, iter(root.children))]
        while stack:
            node, children = stack[-1]
            for child in children:
                if isinstance(child, str):
                    blocks[-1].append(child)
                    continue
                if child.tag in BLOCK:
                    blocks.append([])
                if not (dropped(child, in_article) or (template and hashes.get(id(child), ("",))[0] in template)):
                    stack.append((child, iter(child.children)))
                    break
            else:
                stack.pop()
                if node.tag in BLOCK:
                    blocks.append([])
    texts = (_SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in blocks)
    return "\n".join(t for t in texts if t)


def subtree_hashes(root: Node) -> dict[int, tuple[str, str]]:
    """Hash of each container subtree that can be template, by node, and a digest of the prose outside it.

    Containers in, or around, a main element or in prose cannot, nor those that hold half of the page's
    prose. The digest is a sum over paragraphs, so that a subtree's own share can be taken off it; it is
    empty on a page without prose.
    """
    found: list[tuple[int, str, int, int]] = []
    words: list[str] = []

    def enter(node: Node, kept: bool, quiet: bool, prose: bool) -> list:
        start = hashlib.sha1(f"<{node.tag} {_SPACE.sub(' ', node.attributes).strip()}>".encode("utf-8", "surrogatepass"))
        # node, digest, children, holds a main element, sum and length of prose, in a main element, dropped, in prose
        return [node, start, iter(node.children), False, 0, 0, kept, quiet, prose]

    stack = [enter(root, False, False, False)]
    while True:
        at = stack[-1]
        node, digest, children, _, _, _, kept, quiet, prose = at
        for child in children:
            if isinstance(child, str):
                digest.update(_SPACE.sub(" ", child).encode("utf-8", "surrogatepass"))
                if prose and not quiet:
                    words.append(child)
                continue
            inside = kept or child.tag in ("article", "main")
            stack.append(enter(child, inside, quiet or dropped(child, inside), prose or child.tag in PARAGRAPH))
            break
        else:
            stack.pop()
            if prose and not (stack and stack[-1][8]):
                text = _SPACE.sub(" ", entities.unescape("".join(words))).strip()
                words.clear()
                if text:
                    own = hashlib.sha1(text.encode("utf-8", "surrogatepass")).digest()
                    at[4], at[5] = int.from_bytes(own, "big"), len(text)
            at[3] |= node.tag in ("article", "main", "body")
            done = digest.digest()
            if node.tag in CONTAINER and not (at[3] or kept or prose):
                found.append((id(node), done.hex(), at[4], at[5]))
            if not stack:
                break
            up = stack[-1]
            up[1].update(done)
            up[3] |= at[3]
            up[4] += at[4]
            up[5] += at[5]
    total, length = at[4], at[5]
    return {i: (h, f"{total - own:x}" if length else "") for i, h, own, n in found if not n or 2 * n < length}


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def _key(url: str | None, page: str | None) -> str:
    return hashlib.sha1(f"{url}\0{page}".encode("utf-8", "surrogatepass")).hexdigest()


def _evidence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "host", "subtree", "main"]
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not page:
                continue
            root = parse(page)
            hashes = subtree_hashes(root)
            main = hashlib.sha1(main_text(*main_elements(root)).encode("utf-8", "surrogatepass")).hexdigest()
            key, host = _key(url, page), host_of(url)
            for h, rest in {("", main), *hashes.values()}:  # the empty subtree counts the host's pages
                for col, v in zip(out, (key, host, h, rest or main), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=names)


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html",
                   min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``key, templates``: for each distinct page, the hashes of its subtrees that are site template.

    Only hashes are shuffled. A subtree on every page of a large host is counted after each task has
    folded its own rows, and the join back is one Spark can split.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(url_col, html_col).mapInArrow(_evidence, "key string, host string, subtree string, main string")
    seen = stored(rows, "subtrees")
    counts = stored(seen.select("host", "subtree", "main").distinct().groupBy("host", "subtree").count().where(
        (F.col("count") >= min_pages) | (F.col("subtree") == "")), "subtree-counts")
    hosts = counts.where(F.col("subtree") == "").select(F.col("host").alias("_host"), F.col("count").alias("_pages"))
    template = stored(counts.where(F.col("subtree") != "").join(hosts, F.col("host") == F.col("_host")).where(
        F.col("count") >= min_share * F.col("_pages")).select(
        "_host", F.col("subtree").alias("_subtree")), "templates")
    on = (seen["host"] == template["_host"]) & (seen["subtree"] == template["_subtree"])
    found = seen.select("key", "host", "subtree").distinct().join(template, on)
    return found.groupBy("key").agg(F.collect_set("subtree").alias("templates"))  # of one page


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``id, url, text, n_chars`` of every page."""
    small_batches(pages.sparkSession)
    templates = stored(site_templates(pages, url_col, html_col, min_pages, min_share).withColumnsRenamed({"key": "_key"}),
                       "page-templates")
    key = F.sha1(F.concat(F.coalesce(F.col(url_col), F.lit("None")), F.lit("\0"),
                          F.coalesce(F.col(html_col), F.lit("None"))).cast("binary"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"),
                        key.alias("_k"))
    joined = rows.join(templates, F.col("_k") == F.col("_key"), "left")

    def text_of(page: pa.Array, template: pa.Array) -> pa.Array:
        out = []
        for p, t in zip(page.to_pylist(), template.to_pylist(), strict=True):
            if not p:
                out.append("")
                continue
            root = parse(p)
            roots, in_article = main_elements(root)
            out.append(main_text(roots, in_article, set(t or ()), subtree_hashes(root) if t else None))
        return pa.array(out, pa.string())

    text_of.__annotations__ = {"page": pa.Array, "template": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(text_of, "string")
    out = joined.select(F.col("_id").alias(id_col), F.col("_url").alias("url"),
                        udf(F.col("_html"), F.col("templates")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
