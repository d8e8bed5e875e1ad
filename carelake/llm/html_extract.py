"""Main text of web pages by site template removal.

1. Every page is parsed into a tree; the subtrees of its block elements are hashed (tag, text,
   children) and go out with the page's host and a fingerprint of its article.
2. Spark counts, per host and subtree hash, the different articles it stands beside. Copies of one
   article (campaign links, reposts) count once, so an article never becomes its own template. A
   subtree with MANY_PAGES different articles is part of the site template, however large the host; on
   small hosts MIN_PAGES are enough if they are MIN_SHARE of the host's articles.
   Counts are combined before the shuffle; a host with a third of all pages is no hot spot.
3. Each page is parsed again and its template subtrees are deleted, together with what the markup
   itself names as no part of an article (navigation, asides, forms, scripts, adverts, comments, ...).
   Names count as whole ("ad-box", not "has-sidebar"); what holds an article element or most of the page's
   text is never deleted for its name or as a form.
   Inside an article element, paragraphs, headings and the like are its text however often they
   recur; only other containers are deleted as template there.

The text: what is left of the article elements (else of main, else of the body); blocks in page
order, joined by a line feed; white space inside a block, line breaks included, becomes one space.

Malformed declarations are comments up to the next ">" and references to no character are U+FFFD; the
text behind them counts. Null and empty pages give an empty text. Null or malformed urls are one host. Rows
repeated whole give the same text and count once. An empty table gives an empty result. Pages are
read whole; batches hold few rows.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm.common import arrow_batches, fresh, save, table

MIN_PAGES = 3
MIN_SHARE = 0.3
MANY_PAGES = 20

# Fixed values of HTML: elements without content, elements whose text is never shown as an article's,
# elements that start a block of their own, and elements that an opening tag closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = set("script style noscript template head title nav footer aside form button select option textarea input label "
              "fieldset iframe object embed svg canvas audio video map dialog menu".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
             "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table "
             "tbody tfoot thead tr ul".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd table tbody thead tfoot tr figcaption figure article main".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPES = set("article section div main body html td th li nav header footer aside form table ul ol dl blockquote".split())
# words of class, id and role that name no part of an article
NOISE = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead ad ads advert advertisement adverts "
            "sponsor sponsored promo banner cookie cookies consent notice alert popup modal overlay newsletter subscribe "
            "signup login share sharing social comment comments disqus reply replies respond related recommended widget "
            "pagination pager toolbar skip hidden".split())
# words that may stand beside them in one name ("ad-box"); any other ("has-sidebar", "comments-open") speaks of something else
BESIDE = set("area bar block body bottom box button buttons col column container entry first footer form global group head "
             "header holder icon icons inner item items last left link links list main media message page panel post posts "
             "primary right row secondary section site slot thread title top unit widgets wrap wrapper zone".split())
COMMENT = frozenset({"comment", "comments", "reply"})  # an article of this name is a reader's
HEADERS = frozenset({"header", "topbar"})  # of the page; inside an article they hold its title
CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
ZEROS = re.compile(r"&#0+(?=[0-9])")
FAR_REFERENCE = re.compile(r"&#[0-9]{1000,};?")  # no code point; int() refuses very long ones


class Node:
    __slots__ = ("tag", "noise", "named", "header", "children")

    def __init__(self, tag: str, noise: bool = False, named: bool = False, header: bool = False):
        self.tag, self.noise, self.named, self.header, self.children = tag, noise, named, header, []


class Tree(HTMLParser):
    """A lenient tree: implied end tags are added, stray ones ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # places of the open elements of each tag, innermost last

    def _innermost(self, tags: set) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def _close(self, tags: set, until: set) -> None:
        """Closes the innermost open element of ``tags``, unless one of ``until`` lies further in."""
        i = self._innermost(tags)
        if i and (i == len(self.open) - 1 or i >= self._innermost(until)):
            for n in self.open[i:]:
                self.places[n.tag].pop()
            del self.open[i:]

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag == "body":
            self._close({"head"}, set())
        if tag in BLOCKS and self.places.get("p"):
            self._close({"p"}, SCOPES)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        node = Node(tag, _is_noise(tag, attrs), tag == "form" or _named(tag, attrs, NOISE),
                    tag == "header" or _named(tag, attrs, HEADERS))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # "/" has no meaning in HTML: only void elements have no end

    def handle_endtag(self, tag):
        if tag in VOID or tag == "html":
            return
        if self.open[-1].tag == tag:
            self.places[tag].pop()
            self.open.pop()
        elif self.places.get(tag):
            self._close({tag}, set() if tag in SCOPES else SCOPES)

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except (AssertionError, ValueError):  # "<![foo]>": a bogus comment up to ">", as in HTML
            return self.parse_bogus_comment(i)


@lru_cache(10_000)
def _names(token: str, words: frozenset) -> bool:
    """Is a class, id or role made of the words, but for numbers and words of BESIDE?"""
    held = [w.lower() for w in CLASS_WORD.findall(token)]
    return not words.isdisjoint(held) and all(w in words or w in BESIDE or w.isdigit() for w in held)


def _named(tag: str, attrs, words: frozenset) -> bool:
    """Does a class, id or role of the element name one of the words?"""
    return tag not in ("html", "body", "article", "main") and any(
        value and name in ("class", "id", "role") and any(_names(t, words) for t in value.split()) for name, value in attrs)


def _is_noise(tag: str, attrs) -> bool:
    """Noise by its tag or as hidden, whatever it holds."""
    if tag in NO_TEXT and tag != "form":
        return True
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id") and value and tag == "article" and any(_names(c, COMMENT) for c in value.split()):
            return True
    return False


def parse(html: str | None) -> Node:
    t = Tree()
    t.feed(FAR_REFERENCE.sub("\ufffd", ZEROS.sub("&#", html or "")))
    t.close()
    _settle(t.root)
    return t.root


def _settle(root: Node) -> None:
    """Makes noise of the forms and of what is named so, but for what holds an article or main that is not
    itself in an article, or most of the page's text."""
    sums: list[list] = [[0, False]]  # of each open element: length of its shown text, does it hold an article
    held: list[tuple[Node, int, bool]] = []
    noise = articles = 0
    for n, leaving in walk(root):
        if not isinstance(n, Node):
            if not noise and not n.isspace():
                sums[-1][0] += len(n)
        elif not leaving:
            noise += n.noise
            articles += n.tag == "article"
            sums.append([0, False])
        else:
            noise -= n.noise
            articles -= n.tag == "article"
            chars, holds = sums.pop()
            if n.named or n.header:
                held.append((n, chars, holds and not articles))
            sums[-1][0] += chars
            sums[-1][1] |= holds or n.tag in ("article", "main") and not n.noise and not noise
    for n, chars, holds in held:
        if holds or 2 * chars > sums[0][0]:
            n.header = False
        else:
            n.noise |= n.named


def walk(node: Node):
    """(node, is it leaving) in page order, without recursion: trees may be deep."""
    stack = [(node, False)]
    while stack:
        n, leaving = stack.pop()
        yield n, leaving
        if isinstance(n, Node) and not leaving:
            stack.append((n, True))
            stack += [(c, False) for c in reversed(n.children)]


def subtree_hashes(root: Node) -> dict[int, int]:
    """id of each block element with text -> hash of its subtree."""
    out: dict[int, int] = {}
    kids: list[list] = [[]]
    for n, leaving in walk(root):
        if not isinstance(n, Node):
            if s := " ".join(n.split()):
                kids[-1].append(s)
        elif not leaving:
            kids.append([])
        else:
            mine = kids.pop()
            if mine:
                h = xxhash.xxh3_64_intdigest("\x00".join((n.tag, *mine)).encode("utf-8", "surrogatepass")) >> 1
                kids[-1].append(str(h))
                if n.tag in BLOCKS and n.tag not in ("html", "body"):
                    out[id(n)] = h
    return out


def contents(root: Node) -> list[Node]:
    """The elements that hold the article: articles, else main, else all. Where main holds more text outside its
    articles, it is the article itself and they are cards of others: they become noise."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    depth = noise = 0
    for n, leaving in walk(root):
        if not isinstance(n, Node):
            continue
        if n.noise:
            noise += -1 if leaving else 1
        elif n.tag in found and not noise:
            if n.tag == "article":
                depth += -1 if leaving else 1
                if not leaving and depth == 1:
                    found["article"].append(n)
            elif not leaving:
                found["main"].append(n)
    for m in found["main"][:1] if found["article"] else ():
        own, theirs, cards = 0, 0, []  # text outside and inside of articles
        depth = noise = 0
        for n, leaving in walk(m):
            if not isinstance(n, Node):
                if not noise and not n.isspace():
                    own, theirs = (own, theirs + len(n)) if depth else (own + len(n), theirs)
            elif n.noise:
                noise += -1 if leaving else 1
            elif n.tag == "article":
                depth += -1 if leaving else 1
                if not leaving and depth == 1 and not noise:
                    cards.append(n)
        if cards and own > theirs and len(cards) == len(found["article"]):
            for n in cards:
                n.noise = True
            return [m]
    return found["article"] or found["main"][:1] or [root]


def blocks(node: Node, templates: frozenset = frozenset(), hashes: dict | None = None) -> list[str]:
    """Texts of the blocks of a content element, template subtrees and noise left out."""
    out: list[str] = []
    parts: list[str] = []
    skip = 0
    inside = node.tag in ("article", "main")

    def flush():
        if s := " ".join("".join(parts).split()):
            out.append(s)
        parts.clear()

    for n, leaving in walk(node):
        if not isinstance(n, Node):
            if not skip:
                parts.append(n)
            continue
        gone = n is not node and (n.noise or n.header and not inside
                                  or hashes is not None and hashes.get(id(n)) in templates and not (inside and n.tag in PROSE))
        if n.tag in BLOCKS:
            flush() if not skip else None
        elif n.tag in ("br", "td", "th") and not skip:
            parts.append(" ")
        if gone:
            skip += -1 if leaving else 1
    flush()
    return out


def main_text(html: str | None, templates=()) -> str:
    root = parse(html)
    hashes = subtree_hashes(root) if len(templates) else None
    return "\n".join(b for c in contents(root) for b in blocks(c, frozenset(templates), hashes))


def deletable(root: Node, hashes: dict[int, int]) -> set[int]:
    """Hashes of the subtrees that ``blocks`` would delete as template; the markup settles the others."""
    out = set()
    for content in contents(root):
        inside, skip = content.tag in ("article", "main"), 0
        for n, leaving in walk(content):
            if not isinstance(n, Node) or n is content:
                continue
            if n.noise or n.header and not inside:
                skip += -1 if leaving else 1
            elif not skip and not leaving and id(n) in hashes and not (inside and n.tag in PROSE):
                out.add(hashes[id(n)])
    return out


PAGE = T.StructType([T.StructField("article", T.LongType()), T.StructField("subtrees", T.ArrayType(T.LongType())),
                     T.StructField("own", T.ArrayType(T.LongType()))])


@F.arrow_udf(PAGE)
def page_subtrees(pages: pa.Array) -> pa.Array:
    articles, subtrees, own = [], [], []
    for html in pages.to_pylist():
        root = parse(html)
        text = "\n".join(b for c in contents(root) for b in blocks(c))
        articles.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1)
        hashes = subtree_hashes(root)
        subtrees.append(sorted(set(hashes.values())))
        own.append(sorted(deletable(root, hashes)))
    lists = [pa.array(x, pa.list_(pa.int64())) for x in (subtrees, own)]
    return pa.StructArray.from_arrays([pa.array(articles, pa.int64()), *lists], PAGE.names)


@F.arrow_udf(T.StringType())
def extracted(pages: pa.Array, templates: pa.Array) -> pa.Array:
    return pa.array([main_text(h, t or ()) for h, t in zip(pages.to_pylist(), templates.to_pylist())], pa.string())


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def site_templates(known: DataFrame) -> DataFrame:
    """(host, subtree) of template subtrees, from saved rows host, article, subtrees."""
    seen = known.select("host", "article", F.explode("subtrees").alias("subtree")).distinct()
    counts = seen.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAGES)
    hosts = known.select("host", "article").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("articles"))
    hosts = hosts.withColumnRenamed("host", "h")
    many = (F.col("n") >= MANY_PAGES) | (F.col("n") >= MIN_SHARE * F.col("articles"))
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(many).select("host", "subtree")


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with one more column, the main text (``main_text``, named clear of the others)."""
    arrow_batches(pages.sparkSession, 64)
    out, digest = fresh("main_text", pages.columns), F.unhex(F.md5(F.coalesce(pages[html], F.lit(""))))
    known = save(pages.select(host(F.col(url)).alias("host"), digest.alias("digest"), page_subtrees(F.col(html)).alias("x"))
                 .select("host", "digest", "x.*").dropDuplicates(["host", "digest"]), "subtrees")
    templates = save(site_templates(known), "templates").select(F.col("host").alias("h"), F.col("subtree").alias("s"))
    mine = known.select("host", "digest", F.explode("own").alias("subtree")) \
        .join(templates, F.col("host").eqNullSafe(F.col("h")) & (F.col("subtree") == F.col("s")))
    lists = save(mine.groupBy("host", "digest").agg(F.collect_list("subtree").alias(f"{out}_templates")), "page-templates") \
        .withColumnsRenamed({"host": f"{out}_host", "digest": f"{out}_digest"})
    same = host(F.col(url)).eqNullSafe(F.col(f"{out}_host")) & (digest == F.col(f"{out}_digest"))
    joined = pages.join(lists, same, "left")
    return joined.withColumn(out, extracted(F.col(html), F.col(f"{out}_templates"))).select(*pages.columns, out)


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"),
                                 F.length("main_text").cast("long").alias("n_chars"))
