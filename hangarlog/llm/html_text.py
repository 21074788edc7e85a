"""Main text of web pages by removal of site templates.

Each page is parsed once: every element subtree outside the article, and
every container inside it, is hashed from its tags and words. Spark counts,
for each host, how many different articles a subtree stands beside. Subtrees
that stand beside many are the site's template and are deleted with all they
hold. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments that say what they are go as well, whether or not
they recur. Prose inside a marked article is never taken for a template,
however often a passage occurs.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from hangarlog.llm.frames import join_groups, record, stash
from hangarlog.llm.textbytes import slices
from hangarlog.llm.url_filter import url_host

#: A subtree is a template where it stands beside so many different articles of the host, and beside this share of them.
LEAST_PAGES, OUTER_SHARE, INNER_SHARE = 3, 0.01, 0.5
#: A container inside the article with more than this share of its words is no template.
INNER_WORDS = 0.1
#: Hashes of templates that may be broadcast; beyond, pages are joined by host.
BROADCAST_HASHES = 1 << 19

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
                   "tbody tfoot thead tr ul".split())
SPACED = frozenset("br td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section ul ol dl table figure details".split())
#: A start tag in the key ends an open element of the value.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
#: Ends of elements do not reach beyond these.
SCOPES = frozenset("table td th caption template".split())
LISTS = frozenset("table ul ol dl select".split())
IN_HEAD = frozenset("head title meta link style script base noscript template".split())
DROPPED = frozenset("nav aside footer form script style noscript template head title iframe object svg canvas math button select textarea datalist "
                    "dialog menu search audio video noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification "
                  "popup modal overlay newsletter subscribe subscription paywall sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs "
                  "masthead header footer comment comments disqus replies respond share sharing social related recommended widget widgets pagination pager "
                  "login signup search toolbar".split())
CONTENT = frozenset("content maincontent articlebody articlecontent articletext postcontent postbody entrycontent storybody pagecontent bodytext".split())
_NOT = frozenset("has with no without is".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:\s++|/(?!>)|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?|=)*+)/?>""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+))""")
_MARKUP = re.compile(r"<[!?/a-zA-Z]")
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
_WORD = re.compile(r"[a-z0-9]+")
_HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _kind(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element says that it is none of the main text, and that it is the main text."""
    drop, content = tag in DROPPED, tag == "main"
    if "=" in attributes and tag not in ("html", "body"):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "role":
                drop, content = drop or value.lower() in ROLES, content or value.lower() == "main"
            elif name == "itemprop":
                content = content or value.lower() == "articlebody"
            elif name in ("class", "id"):
                for word in _HUMPS.sub("-", html.unescape(value)).lower().split():
                    parts = _WORD.findall(word)
                    content = content or "".join(parts) in CONTENT
                    drop = drop or bool(parts) and parts[0] not in _NOT and tag not in HEADINGS and not NAMES.isdisjoint(parts)
    return drop, content


class Node:
    """An element: where it hangs, what it says it is, the blocks begun in it, and what its hash is made of."""

    __slots__ = ("tag", "up", "drop", "content", "first", "last", "parts", "hash", "words", "place", "inside", "holds_root")

    def __init__(self, tag: str, up: "Node | None", drop: bool, content: bool, first: int):
        self.tag, self.up, self.drop, self.content, self.first, self.last = tag, up, drop, content, first, first
        self.parts, self.hash, self.words, self.place, self.inside, self.holds_root = [], 0, 0, 0, False, False

    def seal(self) -> None:
        self.hash = xxhash.xxh3_64_intdigest("\x01".join([self.tag, *self.parts])) - (1 << 63)
        self.parts = None


class Page:
    """Elements of a page in the order they open, and blocks of text; a block is a list of texts and the elements they stand in."""

    def __init__(self, source: str):
        self.nodes = [Node("", None, False, False, 0)]
        self.blocks: list[list[tuple[str, Node]]] = []
        self._open, self._pending, self._counts = [self.nodes[0]], [], {}
        self._read(source)
        self._flush()
        while len(self._open) > 1:
            self._close()
        self.nodes[0].last = len(self.blocks)
        self.nodes[0].seal()

    def _flush(self) -> None:
        if any(raw.strip() for raw, _ in self._pending):
            self.blocks.append(self._pending)
            self._pending = []
        else:
            self._pending.clear()

    def _text(self, raw: str) -> None:
        raw, node = html.unescape(raw) if "&" in raw else raw, self._open[-1]
        self._pending.append((raw, node))
        words = raw.split()
        if words:
            node.parts.append(" ".join(words))
            node.words += len(words)

    def _close(self) -> None:
        node = self._open.pop()
        self._counts[node.tag] -= 1
        node.last = len(self.blocks)
        node.seal()
        self._open[-1].parts.append(f"\x02{node.hash}")
        self._open[-1].words += node.words

    def _close_to(self, tags: set[str], stops: frozenset[str]) -> bool:
        """Close the innermost open element of these tags and all inside it, unless a stop lies between."""
        if not any(self._counts.get(t) for t in tags):
            return False
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k].tag in tags:
                if any(node.tag in BLOCKS for node in self._open[k:]):
                    self._flush()
                while len(self._open) > k:
                    self._close()
                return True
            if self._open[k].tag in stops:
                return False
        return False

    def _start(self, tag: str, attributes: str) -> None:
        if self._counts.get("head") and tag not in IN_HEAD:
            self._close_to({"head"}, frozenset())
        if tag in BLOCKS:
            self._flush()
            self._close_to({"p"}, SCOPES)
        if tag in SPACED:
            self._pending.append((" ", self._open[-1]))
        while tag in ENDS and self._close_to(ENDS[tag], LISTS):
            pass
        if tag not in VOID:
            node = Node(tag, self._open[-1], *_kind(tag, attributes), len(self.blocks))
            self.nodes.append(node)
            self._open.append(node)
            self._counts[tag] = self._counts.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag in SPACED:
            self._pending.append((" ", self._open[-1]))
        if not self._close_to({tag}, frozenset() if tag in SCOPES else SCOPES) and tag in BLOCKS:
            self._flush()

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            begin = source.find("<", at)
            if begin != at:
                self._text(source[at:begin if begin >= 0 else size])
            if begin < 0:
                return
            found = _TAG.match(source, begin)
            if found:
                at, tag = found.end(), found[2].lower()
                if found[1]:
                    self._end(tag)
                    continue
                self._start(tag, found[3])
                if tag in RAW:
                    end = _RAW_ENDS[tag].search(source, at)
                    stop = end.start() if end else size
                    self._open[-1].parts.append(source[at:stop])
                    self._close()
                    at = stop
                continue
            if source.startswith("<!--", begin):
                end = source.find("-->", begin + 2)  # <!--> is a whole comment too
                at = size if end < 0 else end + 3
            elif _MARKUP.match(source, begin):  # a declaration, an ill-formed tag, or one that the page breaks off in
                end = source.find(">", begin)
                at = size if end < 0 else end + 1
            else:
                self._text("<")
                at = begin + 1


def _roots(nodes: list[Node], lenient: bool) -> list[Node]:
    """The outermost elements that mark the main text and lie in nothing that goes: articles, else what is named as content."""
    for alike in (lambda n: n.tag == "article", lambda n: n.content):
        found, shut = [], {0}
        for node in nodes[1:]:
            gone = node.tag != "form" and (node.tag in DROPPED if lenient else node.drop)
            free = id(node.up) not in shut
            if free and not gone and alike(node):
                found.append(node)
            if not free or gone or alike(node):
                shut.add(id(node))
        if found:
            return found
    return []


#: What an element lies in: the page, the main text, a header of the main text, what goes.
PAGE, MAIN, HEADER, GONE = range(4)


def _settle(nodes: list[Node], roots: list[Node]) -> None:
    """Say of every element what it lies in; parents come before children."""
    marked = set(map(id, roots))
    for node in nodes:
        node.holds_root = False
    for node in roots:
        while node is not None and not node.holds_root:
            node.holds_root, node = True, node.up
    for node in nodes:
        around, node.inside = (node.up.place, node.up.inside or id(node) in marked) if node.up else (PAGE, False)
        if around == GONE or id(node) not in marked and (node.drop and not node.holds_root):
            node.place = GONE
        elif id(node) in marked or around == MAIN:
            node.place = HEADER if node.tag == "header" and id(node) not in marked else MAIN
        elif around == HEADER:
            node.place = MAIN if node.tag in HEADINGS else HEADER
        else:
            node.place = GONE if node.tag == "header" and not node.holds_root else PAGE


Found = tuple[int, list[str], list[tuple[int, int, int]], list[tuple[int, int, int]]]


def dissect(source: str) -> Found:
    """Hash of the main part, its blocks of text, and the subtrees outside and inside of it that may be a template.

    A subtree is given by its hash, its first block and the block after its last.
    """
    page = Page(source)
    nodes, kept, roots = page.nodes, [], []
    for lenient in (False, True):  # leniently only where nothing else is left: all articles lie in elements with odd names
        roots = _roots(nodes, lenient)
        _settle(nodes, roots)
        wanted = MAIN if roots else PAGE
        kept = [" ".join("".join(raw for raw, node in block if node.place == wanted).split()) for block in page.blocks]
        if any(kept):
            break
    number = [0]
    for words in kept:
        number.append(number[-1] + bool(words))
    size, marked = sum(n.words for n in roots), set(map(id, roots))
    outer, inner = [], []
    for node in nodes[1:]:
        if node.words and node.tag in BLOCKS and not node.holds_root and node.tag not in ("html", "body", "head"):
            span = (node.hash, number[node.first], number[node.last])
            if not node.inside:
                outer.append(span)
            elif id(node) not in marked and node.tag in CONTAINERS and node.words <= INNER_WORDS * size:
                inner.append(span)
    main = roots[0].hash if len(roots) == 1 else xxhash.xxh3_64_intdigest(" ".join(str(n.hash) for n in roots or nodes[:1])) - (1 << 63)
    return main, [words for words in kept if words], outer, inner


#: Columns that parsing adds.
_FOUND = [("main", pa.int64()), ("texts", pa.list_(pa.string())),
          *[(f"{side}_{part}", pa.list_(kind)) for side in ("outer", "inner") for part, kind in (("hash", pa.int64()), ("from", pa.int32()), ("to", pa.int32()))]]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            found = [dissect(source or "") for source in batch.column("html").to_pylist()]
            spans = [[[span[part] for span in row[side]] for row in found] for side in (2, 3) for part in range(3)]
            schema = pa.schema([batch.schema.field(c) for c in ("id", "url", "host")] + [pa.field(*f) for f in _FOUND])
            yield record(schema, [batch.column("id"), batch.column("url"), batch.column("host"), [r[0] for r in found], [r[1] for r in found], *spans])


def _templates(parsed: DataFrame, sites: DataFrame, side: str, share: float, pages: int) -> DataFrame:
    """host and the hashes of subtrees that stand beside enough different main parts.

    A host has at most 1 / share times as many as a page of it has on average.
    """
    seen = (parsed.filter("host <> ''").select("host", "main", F.explode(f"{side}_hash").alias("h")).distinct()
            .groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES))
    often = join_groups(seen, sites, ["host"], "mains", pages).filter(F.col("n") >= F.col("mains") * share)
    return often.groupBy("host").agg(F.collect_list("h").alias(f"{side}_templates"))


def _left(texts: Column, side: str) -> Column:
    """Texts, each with its place, that no span of a template covers."""
    spans = F.filter(F.arrays_zip(f"{side}_hash", f"{side}_from", f"{side}_to"),
                     lambda s: F.array_contains(f"{side}_templates", s[f"{side}_hash"]) & (s[f"{side}_from"] < s[f"{side}_to"]))
    return F.filter(texts, lambda t: ~F.exists(spans, lambda s: (s[f"{side}_from"] <= t["i"]) & (t["i"] < s[f"{side}_to"])))


def main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """page_id, url, text, n_chars (code points) and n_templates of every row of pages.

    text holds the blocks of the main text in page order, one a line, with
    character references decoded and white space within a block turned into one
    space. n_templates is the number of different subtrees of the page that
    are templates of its host.

    A null page counts as empty; an empty page, or one without main text, gives
    an empty text. Repeated rows stay, each as a row; whole texts count, however
    long. A url that is null or has no "://" names no host: nothing is
    a template there. An empty table gives no rows. Other columns are not
    looked at. Identifiers may be null.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    kind = dict(source.dtypes)["id"]
    columns = f"id {kind}, url string, host string, main long, texts array<string>, " + ", ".join(
        f"{side}_hash array<long>, {side}_from array<int>, {side}_to array<int>" for side in ("outer", "inner"))
    parsed = stash(source.mapInArrow(_parse, columns))
    # Pages that share their main part count once, so that copies of an article make no template.
    sites = stash(parsed.groupBy("host").agg(F.count_distinct("main").alias("mains"), F.count("*").alias("pages")))
    pages_, hosts = sites.agg(F.coalesce(F.sum("pages"), F.lit(0)), F.count("*")).first()
    known = sites
    for side, share in (("outer", OUTER_SHARE), ("inner", INNER_SHARE)):
        known = known.join(_templates(parsed, sites, side, share, pages_), "host", "left")
    none = F.array().cast("array<long>")
    known = stash(known.select("host", "pages", *[F.coalesce(f"{side}_templates", none).alias(f"{side}_templates") for side in ("outer", "inner")]))
    held = known.agg(F.sum(F.size("outer_templates") + F.size("inner_templates") + 4)).first()[0] or 0
    found = parsed.join(F.broadcast(known), "host") if held <= BROADCAST_HASHES else join_groups(parsed, known, ["host"], "pages", pages_)
    texts = F.transform("texts", lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    text = F.array_join(F.transform(_left(_left(texts, "outer"), "inner"), lambda t: t["t"]), "\n")
    return found.select(F.col("id").alias("page_id"), "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"),
                        (F.size(F.array_intersect("outer_hash", "outer_templates")) + F.size(F.array_intersect("inner_hash", "inner_templates"))).alias("n_templates"))
