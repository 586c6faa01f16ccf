"""Main text of web pages with site template removal.

Pass 1 parses every page and hashes its element subtrees (tag, class, and the
content of all children). Spark counts, per host, on how many distinct pages each
subtree occurs (copies of a page count once); one that recurs on at least ``min_pages`` pages and a share
``min_share`` of the host's pages belongs to the site's template. Pass 2 parses
again and drops, besides elements that name themselves boilerplate (nav, header,
footer, aside, form, script, ...), every template subtree. A name is a whole class or role token,
or the id of an element that is no text element (headings and paragraphs have ids made of their words): a
word such as ``ad`` or ``comments``, or a compound of such words and words for places and
parts only (``site-header``, ``share-buttons``, but not ``form-of-government``). An article is never
judged by its names. If a page marks its article (``article``, ``main``), only that is read; in it an
element named by an id like ``related`` or a compound like ``post-header`` stays if it holds prose outside links.

Paragraphs, headings and quotations inside a marked article are never counted as
template, however often they recur: a quotation or a copied article is content. Nor
is an element that holds such text outside links. Without a marked article they are counted like everything else.

A host that holds nothing but copies of one page with a marked article counts them as
pages; text that stands there in no text element is taken for template.

A host keeps at most (subtrees per page) / ``min_share`` template hashes, so the
list per host is bounded by page size. Hosts with hot counts are aggregated
partially; the hashes join the pages by broadcast only if their measured size is
small, by shuffle otherwise.

Blocks: an element that is not inline text ends the block before and after it;
white space in a block (a line break too) becomes one space; blocks are joined
by two line feeds in page order. Character references are decoded.

Defined cases: a null or empty html has an empty text; a null url counts under the
empty host; an unclosed or malformed element ends with its parent or the page;
repeated rows each have their text; an empty table gives an empty table; nesting
beyond ``MAX_DEPTH`` is read flat; what follows the last ``>`` is text; a page of any length takes time in
proportion to it; only the named columns are read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import map_arrow, small_side, staged

MIN_PAGES = 5
MIN_SHARE = 0.3
MAX_DEPTH = 400

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template nav header footer aside form iframe object embed svg canvas button "
                    "select option textarea input label dialog menu head title".split())
#: Of these, the ones that stand in running text: dropping them does not end a block.
IN_TEXT = INLINE | frozenset("script style noscript template iframe object embed svg canvas button select option textarea "
                             "input label".split())
ARTICLE = frozenset(("article", "main"))
#: Text elements: content, not template, inside a marked article.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
PROSE = TEXT | INLINE
#: Tokens of class, id and role that name boilerplate.
NAMED = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu "
                  "breadcrumb breadcrumbs header masthead footer sidebar aside widget notice cookie cookies consent "
                  "gdpr popup modal newsletter subscribe share sharing social related recommended comment comments "
                  "commentlist disqus form login signup search pagination pager contentinfo complementary "
                  "alert toolbar".split())
#: Words for places and parts that make a compound with one of these.
AROUND = frozenset("site page main top bottom left right global primary secondary bar box button buttons link links list slot "
                   "container wrapper area section block unit inner outer mobile desktop sticky item items post posts article "
                   "articles content".split())
#: Of ``NAMED``, words that also name parts of an article.
ALSO_CONTENT = frozenset("header masthead banner form related social alert notice widget toolbar".split())
#: Start of one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An element ended by the start of its like.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",)}
_PARTS = re.compile("[-_]+")


@lru_cache(10_000)
def _named(token: str) -> int:
    """2 if a class token names boilerplate, 1 if it may also name a part of an article, 0 if neither."""
    token = token.lower()
    if token in NAMED:
        return 2
    parts = [p for p in _PARTS.split(token) if p]
    names = [p for p in parts if p in NAMED]
    if not names or not all(p in NAMED or p in AROUND for p in parts):
        return 0
    return 1 if ALSO_CONTENT.issuperset(names) else 2


class Node:
    """An element; ``drop`` is 2 for boilerplate, 1 for boilerplate unless it holds prose of an article."""

    __slots__ = ("tag", "names", "children", "key", "drop", "text", "prose", "words")

    def __init__(self, tag: str, attrs=()):
        got = {k: v for k, v in attrs if k in ("class", "id", "role") and v}
        self.tag, self.names, self.children, self.key = tag, " ".join(got.values()), [], 0
        #: Whether it holds text; prose outside links; text outside links, were it part of prose.
        self.text = self.prose = self.words = False
        self.drop = 2 if tag in DROPPED else 0
        if got and not self.drop and tag not in ("html", "body") and tag not in ARTICLE:
            tokens = f"{got.get('class', '')} {got.get('role', '')}".split()
            self.drop = max(map(_named, tokens), default=0)
            if not self.drop and tag not in TEXT:
                self.drop = max((1 if t.lower() in ALSO_CONTENT else _named(t) for t in got.get("id", "").split()), default=0)


class _Tree(HTMLParser):
    """Forgiving tree: text nodes are strings, comments and declarations are dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#")
        self.open = [self.root]
        self.flat: dict[str, int] = {}      # elements beyond MAX_DEPTH that wait for their end tags

    def _end_to(self, tags, stop) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                self.flat.clear()
                return
            if self.open[i].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._end_to(("p",), ("table", "button", "td", "li"))
        if tag in SIBLINGS:
            self._end_to(SIBLINGS[tag], ("ul", "ol", "dl", "table", "select"))
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            if len(self.open) < MAX_DEPTH:
                self.open.append(node)
            else:
                self.flat[tag] = self.flat.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.flat.get(tag):
            self.flat[tag] -= 1
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                self.flat.clear()
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    # a tag that is never closed would be tried again at each place after it
    end = html.rfind(">") + 1
    tree.feed(html[:end])
    tree.close()
    if html[end:]:
        tree.handle_data(unescape(html[end:]))
    _hash(tree.root)
    return tree.root


def _hash(node: Node) -> int:
    """Hash of the subtree; what its elements hold is noted on the way up."""
    h = xxhash.xxh3_64(f"{node.tag}\0{node.names}")
    for child in node.children:
        if isinstance(child, str):
            text = " ".join(child.split())
            if text:
                h.update("\1" + text)
                node.text = node.words = True
        else:
            h.update(_hash(child).to_bytes(8, "little"))
            node.text = node.text or child.text
            if child.tag != "a" and child.drop < 2:
                node.words = node.words or child.words
                node.prose = node.prose or child.prose
    if node.tag in TEXT:
        node.prose = node.words
    node.key = h.intdigest()
    return node.key


def boilerplate(node: Node, marked: bool) -> bool:
    return node.drop == 2 or node.drop == 1 and not (marked and node.prose)


def _articles(node: Node, out: list[Node]) -> list[Node]:
    for child in node.children:
        if isinstance(child, str) or boilerplate(child, False):
            continue
        if child.tag in ARTICLE:
            out.append(child)
        else:
            _articles(child, out)
    return out


def _content(root: Node) -> tuple[list[Node], bool]:
    found = _articles(root, [])
    return (found, True) if found else ([root], False)


def subtrees(html: str) -> tuple[set[int], bool]:
    """Hashes of the subtrees of a page that could belong to a template; whether an article is marked."""
    out: set[int] = set()

    def walk(node: Node, marked: bool) -> None:
        for child in node.children:
            if isinstance(child, str) or boilerplate(child, marked):
                continue
            if child.tag not in ("html", "body") and child.tag not in INLINE and not (marked and child.tag in PROSE) \
                    and child.text and not (marked and child.prose):
                out.add(child.key)
            walk(child, marked)

    tops, marked = _content(parse(html))
    for top in tops:
        walk(top, marked)
    return out, marked


def extract(html: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """Main text of a page without the given template subtrees."""
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            blocks.append(text)

    def walk(node: Node, marked: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                run.append(child)
            elif child.tag == "br":
                run.append(" ")
            elif boilerplate(child, marked):
                if child.tag not in IN_TEXT:
                    end()
            elif child.key in template and not (marked and (child.tag in PROSE or child.prose)):
                end()
            elif child.tag in INLINE:
                walk(child, marked)
            else:
                end()
                walk(child, marked)
                end()

    tops, marked = _content(parse(html))
    for top in tops:
        walk(top, marked)
        end()
    return "\n\n".join(blocks)


def _host(df: DataFrame, url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), "://([^/?#]*)", 1), F.lit("")))


def templates(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES,
              min_share: float = MIN_SHARE) -> DataFrame:
    """(host, template array<long>): the subtrees that recur over a host's pages."""
    read = pages.select(_host(pages, url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("h"))
    read = read.withColumn("page", F.sha1("h"))
    again = read.groupBy("host", "page").agg(F.count("*").alias("rows")).where("rows > 1")
    known = read.join(small_side(again, 128), ["host", "page"], "left")
    copied = known.where("rows is not null").groupBy("host", "page").agg(F.min("h").alias("h"), F.min("rows").alias("rows"))
    distinct = known.where("rows is null").select("host", "h", F.lit(1).cast("long").alias("rows")).unionByName(
        copied.select("host", "h", "rows"))

    def run(batch):
        host, key, rows = [], [], []
        for name, html, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found, marked = subtrees(html)
            keys = [0, *(k - (1 << 64) if k >> 63 else k for k in found)]   # 0 counts the page
            host += [name] * len(keys)
            key += keys
            rows += [n if marked else 1] * len(keys)
        if host:
            yield pa.RecordBatch.from_arrays([pa.array(host), pa.array(key, pa.int64()), pa.array(rows, pa.int64())],
                                             names=["host", "key", "rows"])

    seen = staged(map_arrow(distinct, run, "host string, key long, rows long").groupBy("host", "key").agg(
        F.count("*").alias("n"), F.sum("rows").alias("rows")), "subtrees").where(F.col("rows") >= min_pages)
    size = seen.where("key = 0").select("host", F.col("n").alias("pages"), F.col("rows").alias("all_rows"))
    one = F.col("pages") == 1
    times = F.when(one, F.col("rows")).otherwise(F.col("n"))
    often = seen.where("key != 0").join(size, "host").where(
        (times >= min_pages) & (times >= min_share * F.when(one, F.col("all_rows")).otherwise(F.col("pages"))))
    return often.groupBy("host").agg(F.collect_list("key").alias("template"))


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars, n_template) for every row of ``pages``."""
    known = staged(templates(pages, url_col=url_col, html_col=html_col, min_pages=min_pages, min_share=min_share),
                   "templates")
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("h"),
                        _host(pages, url_col).alias("host"))
    joined = read.join(small_side(known, 4096), "host", "left").select("page_id", "url", "h", "template")

    def run(batch):
        html, known_ = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        sets = [frozenset(k + (1 << 64) if k < 0 else k for k in t or ()) for t in known_]
        texts = [extract(x or "", t) for x, t in zip(html, sets, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
             pa.array(map(len, sets), pa.int64())], names=["page_id", "url", "text", "n_chars", "n_template"])

    id_type = pages.schema[id_col].dataType.simpleString()
    return map_arrow(joined, run, f"page_id {id_type}, url string, text string, n_chars long, n_template long")
