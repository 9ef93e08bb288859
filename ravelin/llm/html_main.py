"""Main text of web pages: site templates are found by counting element subtrees per host, and deleted.

First pass: each page is parsed, and containers' subtrees are hashed in two ways. The content hash covers tag, class, id, text
and children. The form hash leaves the text out and takes a run of like children for one, so a menu or an advert whose words
change from page to page has one form. Forms count only where a paragraph can't be meant: outside of the main element, for
classes that may name furniture (`DOUBTFUL_WORDS` and the like), and, on pages without a main element, for containers whose text
is mostly links. A page sends its distinct hashes with its host and a hash of its main element's text. Spark counts, for
each host, under how many different main elements a hash occurs; copies of a page therefore count once. A subtree that at
least `min_pages` different pages of a host hold, and at least `share` of them, is template; `many` different pages suffice
by themselves, so that a large host's rotating variants and the menus of its sections are found.

Second pass: template subtrees go, and what is boilerplate by its nature on any page (nav, footer, aside, form, script and the
like); the text of the main element that is left is returned in blocks. Inside the main element a class only nominates:
recurrence on the host decides, or what the element holds (an advert's class and no heading, another furniture's class and
no prose at all), or its place (comments behind all prose). Ids say nothing there, as they are slugs of headings, but for
comments. Headings and paragraphs stay whatever their class is, and so do buttons, labels, dialogs and the like.

Each page gets the hashes of its own templates only, by a join on host and hash and one on host and page, so no list grows
with a host. A page is told by the hash of its html.

Defined cases: null html is an empty page with an empty text; a null url is the host ''; a page without an article or
main element yields its body; cut-off markup is read as far as it goes; a very long page is read whole by one task; of two
main elements of equal text the first is taken; repeated rows give repeated results; an empty table gives an empty table;
other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map, free, materialise, release

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)", re.S)
#: One attribute, or the end of the tag. A value without quotes ends at white space or `>`, whatever quotes it holds.
ATTRIBUTE = re.compile(r"[\s/]*(?:(>|\Z)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?)", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An element of the first set ends an open element of the second, up to the nearest of the third.
CLOSES = (
    (BLOCKS - {"option"}, frozenset({"p"}), frozenset("td th table button caption article section div".split())),
    (frozenset({"li"}), frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    (frozenset({"dt", "dd"}), frozenset({"dt", "dd"}), frozenset({"dl"})),
    (frozenset({"tr"}), frozenset({"tr", "td", "th"}), frozenset({"table"})),
    (frozenset({"td", "th"}), frozenset({"td", "th"}), frozenset({"tr", "table"})),
    (frozenset({"option"}), frozenset({"option"}), frozenset({"select"})),
)
STARTS = frozenset().union(*(starts for starts, _, _ in CLOSES))
#: Containers, which a template can be made of. Paragraphs, headings, items and cells recur in articles too.
TEMPLATE_TAGS = frozenset("address aside center details dialog div dl fieldset figure footer form header hgroup menu nav ol section table ul".split())
#: What is never main text, and what is none outside of the main element.
DROP_TAGS = frozenset("head nav footer aside form script style noscript template iframe embed applet canvas svg audio video select input textarea menu title link meta xmp noembed noframes".split())
OUTER_TAGS = frozenset("object picture map button label dialog".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar tablist".split())
OUTER_ROLES = frozenset("dialog alert alertdialog status".split())
#: Words of classes that name advertisements, and nothing else.
AD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle adslot adbox sponsored disqus gdpr".split())
COMMENT_WORDS = frozenset("comment comments disqus replies".split())
DROP_WORDS = AD_WORDS | COMMENT_WORDS | frozenset(
    "banner promo promos promotion sponsor sponsors cookie cookies consent notice notices alert alerts popup modal overlay newsletter subscribe subscription signup "
    "sidebar side sidenav aside rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar toolbar footer share sharing social related recommended recommendations reply respond pagination pager paywall login search skip tags hidden".split()
)
#: Words that may name a part of an article as well: alone they say nothing inside it.
DOUBTFUL_WORDS = frozenset("related search notice notices alert alerts tags side skip menu menus login reply respond consent banner recommended recommendations subscription promotion overlay rail social hidden widget widgets".split())
#: Words that say nothing in a class of several words.
PLAIN_WORDS = frozenset("area bar block box button buttons container icons inner item items link links list section slot unit wrap wrapper".split())
#: Elements that hold an article's own text.
PROSE = HEADINGS | frozenset("p blockquote pre table figure dl".split())
MAIN_WORDS = frozenset({"articlebody", "article-body", "post-content", "entry-content", "main-content"})


#: The rules in which an element counts, as one that may be ended or as a wall.
_RULES = {tag: [i for i, (_, ends, walls) in enumerate(CLOSES) if tag in ends or tag in walls] for tag in frozenset().union(*(e | w for _, e, w in CLOSES))}


class Element:
    """An element, and whether a heading or prose stands somewhere below it."""

    __slots__ = ("attrs", "children", "heading", "parent", "prose", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.heading = self.prose = False


def parse(html: str) -> Element:
    """A tree of elements and strings; character references are decoded. Open elements are counted by tag, and each rule knows the
    nearest ones that it ends at, so that nesting costs no walks: the time follows the page's length."""
    root = Element("#page", {}, None)
    open_, counts = [root], {}
    near: list[list[int]] = [[] for _ in CLOSES]
    at, n = 0, len(html)

    def text(piece: str) -> None:
        if piece:
            open_[-1].children.append(unescape(piece) if "&" in piece else piece)

    def shut(depth: int) -> None:
        """Closes all elements from a depth on."""
        while len(open_) > depth:
            tag = open_.pop().tag
            counts[tag] -= 1
            for r in _RULES.get(tag, ()):
                near[r].pop()

    while at < n:
        found = TOKEN.search(html, at)
        if not found:
            rest = html[at:]
            text(rest)
            break
        text(html[at : found.start()])
        at, name = found.end(), found.group(1)
        if name is None:
            continue
        name = name.lower()
        attrs: dict[str, str] = {}
        while True:
            got = ATTRIBUTE.match(html, at)
            at = got.end()
            if got.group(1) is not None:
                break
            value = got.group(3) or got.group(4) or got.group(5) or ""
            attrs.setdefault(got.group(2).lower(), unescape(value) if "&" in value else value)
        closed = html[got.end() - 2 : got.end()] == "/>"
        if html.startswith("/", found.start() + 1):
            if counts.get(name):
                depth = len(open_) - 1
                while open_[depth].tag != name:
                    depth -= 1
                shut(depth)
            continue
        if name in STARTS:
            for r, (starts, ends, _) in enumerate(CLOSES):
                if name in starts:
                    while near[r] and open_[near[r][-1]].tag in ends:  # else a wall, or nothing
                        shut(near[r][-1])
                        if name != "tr":
                            break
        top = open_[-1]
        node = Element(name, attrs, top)
        top.children.append(node)
        for mark, tags in (("heading", HEADINGS), ("prose", PROSE)):
            if name in tags:
                above = node
                while above is not None and not getattr(above, mark):
                    setattr(above, mark, True)
                    above = above.parent
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            inside = html[at : close.start()] if close else html[at:]
            node.children.append(inside)
            at = close.end() if close else n
        elif name not in VOID and not (closed and name in ("path", "rect", "circle", "g")):
            counts[name] = counts.get(name, 0) + 1
            for r in _RULES.get(name, ()):
                near[r].append(len(open_))
            open_.append(node)
    return root


def _words(node: Element) -> set[str]:
    return set(re.split(r"[^a-z0-9]+", f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()))


def _dropped_class(node: Element) -> bool:
    """Whether a class inside the main element names what is no part of an article, and the element looks like it. Advertisements and
    classes of two such words (cookie-notice) go if they hold no heading; other words drop only what holds no prose at all.
    What else a class may name is left to recurrence on the host."""
    for token in node.attrs.get("class", "").lower().split():
        words = set(re.split(r"[^a-z0-9]+", token)) - {""}
        if words & (DROP_WORDS - DOUBTFUL_WORDS) and words <= DROP_WORDS | PLAIN_WORDS:
            if not node.prose or not node.heading and (words & AD_WORDS or len(words & DROP_WORDS) > 1):
                return True
    return False


def _reader_comments(node: Element, main: Element) -> bool:
    """Whether an element inside the main one holds readers' comments: its class or id says so, and no prose of the main element
    stands behind it."""
    own = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower().split()
    if not any((words := set(re.split(r"[^a-z0-9]+", t)) - {""}) & COMMENT_WORDS and words <= COMMENT_WORDS | PLAIN_WORDS | {"reader", "user", "respond", "thread", "form"} for t in own):
        return False
    while node is not main and node.parent is not None:
        after = False
        for c in node.parent.children:
            if after and (bool(c.strip()) if isinstance(c, str) else c.prose or c.tag in PROSE) and not (isinstance(c, Element) and boilerplate(c, True)):
                return False
            after = after or c is node
        node = node.parent
    return True


def boilerplate(node: Element, inside: bool) -> bool:
    """Whether an element is none of the main text by its nature; inside: it lies in the main element."""
    if node.tag in DROP_TAGS or not inside and node.tag in OUTER_TAGS:
        return True
    a = node.attrs
    if not a and node.tag != "header":
        return False
    if node.tag == "header" and not (inside and node.heading):
        return True
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    role = a.get("role", "").lower()
    if role in DROP_ROLES or not inside and role in OUTER_ROLES:
        return True
    if node.tag in ("html", "body", "main") or inside and (node.tag in HEADINGS or node.tag == "p"):
        return False
    if inside or node.tag == "article":
        return _dropped_class(node) or "header" in a.get("class", "").lower().split() and not (inside and node.prose)
    if "class" in a or "id" in a:
        words = _words(node)
        if words & DROP_WORDS:
            return True
        if "header" in words and not (inside and node.heading):
            return True
    return False


def blocks_of(node: Element, gone: set[int] | frozenset[int], hashes: dict[int, tuple[int, ...]] | None) -> list[str]:
    """Texts of the blocks below an element, without boilerplate and without subtrees of which a hash is in gone."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        joined = " ".join("".join(now).split())
        if joined:
            out.append(joined)
        now.clear()

    stack: list = [(node, False)]
    while stack:
        item, done = stack.pop()
        if done:
            flush()
            continue
        if isinstance(item, str):
            now.append(item)
            continue
        if item is not node and (boilerplate(item, True) or item.attrs and _reader_comments(item, node) or (hashes is not None and not gone.isdisjoint(hashes.get(id(item), ())))):
            now.append(" ")
            continue
        block = item.tag in BLOCKS
        if block:
            flush()
            stack.append((item, True))
        elif item.tag in ("br", "wbr", "img"):
            now.append("" if item.tag == "wbr" else " ")
        stack.extend((c, False) for c in reversed(item.children))
    flush()
    return out


def text_size(node: Element) -> int:
    return sum(map(len, blocks_of(node, frozenset(), None)))


def main_element(root: Element) -> Element:
    """The article with most text outside of boilerplate, else the main element, else the body, else the page. Of elements in each
    other the outer one counts."""
    articles, mains, named, body = [], [], [], None
    stack = [(root, False, False)]
    while stack:
        x, in_main, in_named = stack.pop()
        if x.tag == "body":
            body = body or x
        elif x.tag == "article" and not boilerplate(x, False):
            articles.append(x)
            continue  # one in another is its part
        elif (x.tag == "main" or x.attrs.get("role", "").lower() == "main") and x.tag != "#page":
            if not in_main:
                mains.append(x)
            in_main = True
        elif x.attrs and (x.attrs.get("itemprop", "").lower() == "articlebody" or MAIN_WORDS & set(x.attrs.get("class", "").lower().split()) or MAIN_WORDS & {x.attrs.get("id", "").lower()}):
            if not in_named:
                named.append(x)
            in_named = True
        if x is not root and x.tag not in ("html", "body") and boilerplate(x, False):
            continue
        stack.extend((c, in_main, in_named) for c in reversed(x.children) if isinstance(c, Element))
    for found in (articles, named, mains):
        if found:
            return found[0] if len(found) == 1 else max(found, key=text_size)
    return body or root


def nominated(node: Element, link_share: float, marked: bool) -> bool:
    """Whether an element inside the main one may be furniture, if its form recurs: by a word of its class, or, where no element
    is marked as the main one, as mostly links."""
    words = set(re.split(r"[^a-z0-9]+", node.attrs.get("class", "").lower())) if "class" in node.attrs else ()
    return bool(words) and not words.isdisjoint(DROP_WORDS) or not marked and link_share >= 0.6


def subtree_hashes(root: Element, main: Element) -> dict[int, tuple[int, ...]]:
    """Signed 64-bit hashes of containers with text, by id of the element: of their content, and of their form where that counts.
    What holds the main element has none."""
    out: dict[int, tuple[int, ...]] = {}
    above, up = set(), main
    while up is not None:
        above.add(id(up))
        up = up.parent
    marked = main.tag not in ("body", "#page")
    done: dict[int, tuple[str, str, int, int]] = {}
    stack: list[tuple[Element, bool, bool]] = [(root, False, False)]
    digest = xxhash.xxh3_64_hexdigest
    while stack:
        x, ready, inside = stack.pop()
        if not ready:
            inside = inside or x is main
            stack.append((x, True, inside))
            stack.extend((c, False, inside) for c in x.children if isinstance(c, Element))
            continue
        name = f"{x.tag}\1{x.attrs.get('class', '')}\1{x.attrs.get('id', '')}"
        parts, shape, size, linked = [name], [name], 0, 0
        for c in x.children:
            if isinstance(c, str):
                words = " ".join(c.split())
                size += len(words)
                parts.append("\2" + words)
            else:
                content, form, n, in_links = done.pop(id(c))
                size += n
                linked += in_links
                parts.append("\3" + content)
                if shape[-1] != form:
                    shape.append(form)
        content, form = digest("".join(parts)), digest("\4".join(shape), 1)
        done[id(x)] = content, form, size, size if x.tag == "a" else linked
        if size and x.tag in TEMPLATE_TAGS and id(x) not in above:
            counts = [content]
            if not inside or nominated(x, linked / size, marked):
                counts.append(form)
            out[id(x)] = tuple((v := int(h, 16)) - ((v >> 63) << 64) for h in counts)
    return out


def _strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = 5, share: float = 0.5, many: int = 50, out: str = "text") -> DataFrame:
    """pages with their main text under the name in out."""
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c != out])
    name, key, lost = free(pages.columns, "__rv_host", "__rv_page", "__rv_gone")
    host = F.lower(F.coalesce(F.regexp_extract(url_col, HOST, 1), F.lit("")))
    page = F.xxhash64(F.coalesce(F.col(html_col), F.lit("")))
    hosted = pages.select(F.col(html_col).alias("html"), host.alias("host"), page.alias("page"))

    def survey(batch: pa.RecordBatch) -> dict:
        mains, found = [], []
        for html in _strings(batch, "html"):
            root = parse(html)
            main = main_element(root)
            found.append(list({h for own in subtree_hashes(root, main).values() for h in own}))
            mains.append(xxhash.xxh3_64_intdigest("\n".join(blocks_of(main, frozenset(), None))) - (1 << 63))
        return {"main": mains, "found": found}

    kinds = T.StructType([T.StructField("main", T.LongType()), T.StructField("found", T.ArrayType(T.LongType()))])
    # Written once; copies of a page on a host are one.
    found = materialise(arrow_map(hosted, survey, kinds, ["host", "page"]).dropDuplicates(["host", "page"]), "surveyed")
    seen = found.select("host", "main", F.explode(F.concat("found", F.array(F.lit(None).cast("long")))).alias("h"))
    counts = seen.distinct().groupBy("host", "h").count()
    total = counts.filter("h is null").select("host", F.col("count").alias("pages"))
    often = (F.col("count") >= min_pages) & ((F.col("count") >= share * F.col("pages")) | (F.col("count") >= many))
    template = materialise(counts.filter("h is not null").join(total, "host").filter(often).select("host", "h"), "templates")
    held = found.select("host", "page", F.explode("found").alias("h")).join(template, ["host", "h"])
    lists = held.groupBy(F.col("host").alias(name), F.col("page").alias(key)).agg(F.collect_set("h").alias(lost))
    lists = materialise(lists, "lists")
    release(found)
    release(template)

    def extract(batch: pa.RecordBatch) -> dict:
        got = []
        for html, gone in zip(_strings(batch, html_col), batch.column(lost).to_pylist(), strict=True):
            root = parse(html)
            main = main_element(root)
            hashes = subtree_hashes(root, main) if gone else None
            got.append("\n".join(blocks_of(main, frozenset(gone or ()), hashes)))
        return {out: got}

    joined = pages.withColumns({name: host, key: page}).join(lists, [name, key], "left")
    return arrow_map(joined, extract, T.StructType([T.StructField(out, T.StringType())]), pages.columns)
