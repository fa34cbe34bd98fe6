"""Main text of web pages: site style trees and what the markup itself says."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.keys import in_small_batches
from evidentia.sources.session import checkpointed

#: Importance under which a branch is left out, the same for branches that a part of a class name hints at, and what
#: the text around must reach.
LOW, LOW_HINTED, AROUND = 0.2, 0.6, 0.5
#: Pages of full importance that are added to those of a branch, so that few pages never decide.
PRIOR_PAGES = 1.0
#: Weight of what stands below a branch in its importance; the rest is that of its own presentation.
BELOW = 0.9
#: Rows (site and branch) of the list of low branches that may be sent to every task; more take a salted join.
BROADCAST_BRANCHES = 500_000
SALTS = 64
#: Levels of the style tree; an element that stands deeper counts as the one above it at that level. Texts don't depend on it.
LEVELS = 64

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
FOREIGN = frozenset("svg math".split())
RAW = frozenset("script style noscript iframe noembed noframes textarea title xmp template".split())
NOISE = frozenset("nav footer aside script style noscript iframe template svg math button select textarea dialog menu object canvas audio video map head title".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
_NOISY_WORDS = (
    r"(?:ad|ads|advert\w*|sponsor\w*|promo\w*|side-?bar|cookies?|consent|gdpr|notice|notices|alert|banner|comments?|discuss\w*|disqus|respond|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*|bread-?crumbs?|menu|nav|navbar|navigation|footer|masthead|popup|modal|login|search|pagination|pager|widget)"
)
#: A whole class or id, and a part of one.
_NOISY_NAME = re.compile(_NOISY_WORDS, re.IGNORECASE)
_NOISY_PART = re.compile(rf"(?:^|[\s_-]){_NOISY_WORDS}(?:$|[\s_-])", re.IGNORECASE)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DIGITS = re.compile(r"[0-9]+")


#: Whole names of readers' comments; an article with one, in another article or a main element, is a comment.
_COMMENT_NAME = re.compile(r"(?:comments?|comment-\S+|discuss\w*|respond|reply|replies)", re.IGNORECASE)


@dataclass
class Element:
    """An element of a page: its parent's number, its place in the style tree, and what its own markup says of it."""

    tag: str
    parent: int
    level: int
    path: int
    article: bool = False
    top: bool = False
    hinted: bool = False
    strong: bool = False
    weak: bool = False


@dataclass
class Page:
    """A page's elements, each after its parent, and its text blocks in order with the numbers of their elements."""

    elements: list[Element] = field(default_factory=lambda: [Element("", -1, 0, _hash(""))])
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def noise(self) -> list[bool]:
        """Whether each element is no main text.

        What names or a form only suggest (``weak``) doesn't hold for a wrapper: an element that holds the page's
        article, or more than half of the text where there is none. The page's articles are those that nothing above
        them speaks against, or else the longest one that only names or forms above it speak against.
        """
        n = len(self.elements)
        size, strong, doubted = [0] * n, [False] * n, [False] * n
        for k, e in enumerate(self.elements):
            if k:
                strong[k], doubted[k] = strong[e.parent] or e.strong, doubted[e.parent] or e.weak
        for k, text in self.blocks:
            size[k] += 0 if strong[k] else len(text)
        for k in range(n - 1, 0, -1):
            size[self.elements[k].parent] += size[k]
        articles = [k for k, e in enumerate(self.elements) if e.top and size[k] and not strong[k]]
        wrappers: set[int] = set()
        if articles and not any(not doubted[k] for k in articles):
            k = max(articles, key=lambda k: size[k])
            while k:
                wrappers.add(k)
                k = self.elements[k].parent
        elif not articles:
            wrappers = {k for k in range(n) if 2 * size[k] > size[0]}
        out = [False] * n
        for k, e in enumerate(self.elements):
            if k:
                out[k] = out[e.parent] or e.strong or (e.weak and k not in wrappers)
        return out


def _noisy(tag: str, attributes: dict[str, str], inside: str) -> tuple[bool, bool, bool]:
    """Whether an element's own markup tells it to be no main text, suggests it, and whether it hints at it to the tree.

    ``inside`` is the tag of the article or main element around. A name counts as a whole; inside an article a part of
    a name, as in ``related-work``, is a hint for the tree alone.
    """
    role = attributes.get("role", "").strip().lower()
    if tag in NOISE or "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or role in ROLES:
        return True, False, False
    if (tag == "header" and not inside) or tag == "form" or role == "form":
        return False, True, False
    if tag in ("html", "body", "main"):
        return False, False, False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if tag == "article":
        rule = _NOISY_NAME if inside == "article" else _COMMENT_NAME
        return bool(inside) and any(rule.fullmatch(name) or _COMMENT_NAME.fullmatch(name) for name in names.split()), False, False
    part = bool(_NOISY_PART.search(names))
    whole = any(_NOISY_NAME.fullmatch(name) for name in names.split())
    return False, whole or (part and not inside), part


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def parsed(source: str) -> Page:
    """A page's elements and text blocks; the work follows the page's length, however deep its elements stand."""
    page = Page()
    elements = page.elements
    stack = [0]
    around = [""]
    open_tags: Counter[str] = Counter()
    said: list[str] = []
    at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(said)).split())
        said.clear()
        if text:
            page.blocks.append((stack[-1], text))

    def pop() -> None:
        open_tags[elements[stack.pop()].tag] -= 1
        around.pop()

    def push(tag: str, name: str, attributes: dict[str, str]) -> None:
        up, inside = elements[stack[-1]], around[-1]
        strong, weak, hinted = _noisy(tag, attributes, inside if tag not in INLINE else "article")
        own = tag in ("article", "main")
        path = _hash(f"{up.path}/{name}") if up.level < LEVELS else up.path
        elements.append(Element(tag, stack[-1], min(LEVELS, up.level + 1), path, up.article or own, own and not inside, up.hinted or hinted, strong, weak))
        stack.append(len(elements) - 1)
        around.append(tag if own else inside)
        open_tags[tag] += 1

    while at < len(source):
        m = _TOKEN.search(source, at)
        if m is None:
            said.append(source[at:])
            break
        said.append(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or (m[4] == "" and m.end() == len(source)):
            continue
        if m[1]:
            if tag not in INLINE or open_tags[tag]:
                flush()
            if open_tags[tag]:
                while elements[stack[-1]].tag != tag:
                    pop()
                pop()
            continue
        attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(m[3])} if m[3] else {}
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
            at = end.end() if end else len(source)
            continue
        if m[3].endswith("/") and (tag in FOREIGN or any(open_tags[x] for x in FOREIGN)):
            continue
        if tag in INLINE:
            if tag == "br":
                said.append(" ")
            if tag not in VOID and any(_noisy(tag, attributes, "article")[:2]):
                flush()
                push(tag, tag, attributes)
            continue
        flush()
        shut = set(CLOSES.get(tag, ())) | ({"p"} if tag in ENDS_P else set())
        while len(stack) > 1 and elements[stack[-1]].tag in shut:
            pop()
        if tag in VOID:
            continue
        push(tag, tag + "." + _DIGITS.sub("0", ".".join(sorted(attributes.get("class", "").lower().split()))) if attributes.get("class") else tag, attributes)
    flush()
    return page


def main_text(source: str, low: frozenset[int] | set[int] = frozenset()) -> tuple[str, int]:
    """The main text of a page, given the branches that its site's style tree finds unimportant, and how many blocks these take."""
    page = parsed(source)
    noise = page.noise()
    clear = [(k, text) for k, text in page.blocks if not noise[k]]
    inside = [(k, text) for k, text in clear if page.elements[k].article]
    kept = [text for k, text in inside or clear if page.elements[k].path not in low]
    return "\n".join(kept), sum(page.elements[k].path in low for k, _ in page.blocks)


#: Sorts of a node's values: texts of its blocks, and presentations (the names of its children in order).
CONTENT, PRESENTATION = 0, 1
_NODES = "host string, node long, above array<long>, article boolean, hinted boolean, kind int, value long"


def page_nodes(source: str) -> set[tuple[int, tuple[int, ...], bool, bool, int, int]]:
    """A page's share of its site's tree: ``node, above, article, hinted, kind, value``, each once."""
    page = parsed(source)
    below: dict[int, dict[int, None]] = {}
    marks: dict[int, tuple[bool, bool]] = {}
    above: dict[int, tuple[int, ...]] = {}
    met: set[int] = set()
    own = set()
    for k, text in page.blocks:
        own.add((page.elements[k].path, CONTENT, _hash(text)))
        fresh = []
        while k >= 0 and k not in met:
            met.add(k)
            fresh.append(k)
            k = page.elements[k].parent
        for k in reversed(fresh):
            e = page.elements[k]
            inside, hinted = marks.get(e.path, (False, True))
            marks[e.path] = inside or e.article, hinted and e.hinted
            below.setdefault(e.path, {})
            up = page.elements[e.parent].path if e.parent >= 0 else e.path
            if up == e.path:
                above.setdefault(e.path, ())
            else:
                below[up][e.path] = None
                above.setdefault(e.path, (*above[up], up))
    own |= {(path, PRESENTATION, _hash(" ".join(map(str, children)))) for path, children in below.items()}
    return {(path, above[path], *marks[path], kind, value) for path, kind, value in own}


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int32(), pa.int64())
    for batch in batches:
        rows = [(host.as_py(), *node) for host, source in zip(batch.column(0), batch.column(1), strict=True) for node in page_nodes(source.as_py() or "")]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "node", "above", "article", "hinted", "kind", "value"])


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, node, article, hinted, pages, content, importance``: the merged trees of the sites in ``pages`` (``host, html``).

    A node is the chain of element names and classes down to it. Its presentations, the names of its children in
    order, have the entropy sum(-p log p) / log m over the m pages that have the node: 0 if all look alike. A content
    on n of them has the entropy log n / log m, and ``content`` is 1 less the mean over the node's contents, each
    counted once a page. With one page both are 1. ``importance`` of a node combines, as ``1 - BELOW`` to ``BELOW``,
    its own presentation with the contents of all nodes below it and its own; a node without children has that of its
    contents. To both sides ``PRIOR_PAGES`` pages of importance 1 are added. Pages of a site with the same html are
    one. Values are counted by aggregations that combine before they shuffle, so a site with very many pages is
    spread; the tree that is left has a row for each node of a site.
    """
    once = pages.select("host", "html", F.xxhash64("html").alias("copy")).dropDuplicates(["host", "copy"])
    counts = once.select("host", "html").mapInArrow(_nodes, _NODES).groupBy("host", "node", "kind", "value").agg(F.count("*").alias("n"), F.first("above").alias("above"), F.max("article").alias("article"), F.min("hinted").alias("hinted"))
    told = F.col("kind") == PRESENTATION
    nodes = counts.groupBy("host", "node").agg(
        F.first("above").alias("above"),
        F.max("article").alias("article"),
        F.min("hinted").alias("hinted"),
        F.sum(F.when(told, F.col("n"))).alias("pages"),
        F.sum(F.when(told, F.col("n") * F.log("n"))).alias("styles"),
        F.coalesce(F.sum(F.when(~told, F.col("n"))), F.lit(0)).alias("uses"),
        F.coalesce(F.sum(F.when(~told, F.col("n") * F.log("n"))), F.lit(0.0)).alias("spread"),
    )
    log = F.log(F.greatest("pages", F.lit(2)))
    several = F.col("pages") > 1
    nodes = checkpointed(
        nodes.select(
            "host",
            "node",
            "above",
            "article",
            "hinted",
            "pages",
            "uses",
            F.when(several, 1 - F.col("styles") / (F.col("pages") * log)).otherwise(1.0).alias("presentation"),
            F.when(several & (F.col("uses") > 0), 1 - F.col("spread") / (F.col("uses") * log)).otherwise(1.0).alias("content"),
        )
    )
    texts = nodes.filter("uses > 0").select("host", F.explode(F.concat("above", F.array("node"))).alias("node"), "uses", "content")
    below = texts.groupBy("host", "node").agg((F.sum(F.col("uses") * F.col("content")) / F.sum("uses")).alias("below"), F.count("*").alias("under"))
    joined = nodes.join(below, ["host", "node"])
    alone = (F.col("under") == 1) & (F.col("uses") > 0)
    raw = F.when(alone, F.col("content")).otherwise((1 - BELOW) * F.col("presentation") + BELOW * F.col("below"))
    weighted = lambda x: (F.col("pages") * x + PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)
    return joined.select("host", "node", "above", "article", "hinted", "pages", "uses", weighted(F.col("content")).alias("content"), weighted(raw).alias("importance"))


def low_branches(pages: DataFrame) -> DataFrame:
    """``host, branch`` of the text nodes to leave out.

    A node with text goes if its own contents and its combined importance, or that of a node above it with all
    contents below, are low. Inside articles this is only believed where the articles of the site vary as a whole.
    """
    tree = checkpointed(style_tree(pages))
    texts = tree.filter("uses > 0")
    around = texts.filter("article").groupBy("host").agg((F.sum(F.col("content") * F.col("uses")) / F.sum("uses")).alias("around"))
    least = F.when(F.col("hinted"), LOW_HINTED).otherwise(LOW)
    low = texts.join(around, "host", "left").filter((F.col("content") < least) & (F.col("importance") < least) & (~F.col("article") | (F.col("around") >= AROUND)))
    return low.select("host", F.col("node").alias("branch")).distinct()


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_low`` of each row of ``pages`` (``page_id, url, html``).

    The site's style tree takes the branches that are of low importance (``n_low`` blocks of the page). Of what is
    left, the blocks of the page's ``article`` or ``main`` elements (of the whole page, if it has none) are the text,
    less those that the markup marks as menu, header, footer, sidebar, notice, advert, form or comments. Character
    references are decoded, white space in a block becomes one space, blocks are joined by one line break.

    Null pages are empty and give the empty text; a null url is a site of its own; cut-off markup ends where it is
    cut; repeated rows give the same text and count once in the tree; an empty table gives no rows.
    """
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    pages = in_small_batches(pages).select(F.col("page_id"), F.col("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    low = checkpointed(low_branches(pages))
    lists = low.groupBy("host").agg(F.collect_set("branch").alias("low"))
    if low.limit(BROADCAST_BRANCHES + 1).count() <= BROADCAST_BRANCHES:
        joined = pages.join(F.broadcast(lists), "host", "left")
    else:
        lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(lists, ["host", "salt"], "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [main_text(source.as_py() or "", set(low.as_py() or ())) for source, low in zip(batch.column(2), batch.column(3), strict=True)]
            texts = [text for text, _ in told]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([n for _, n in told], pa.int64())], ["page_id", "url", "text", "n_chars", "n_low"])

    return joined.select("page_id", "url", "html", "low").mapInArrow(scan, f"page_id {kind}, url string, text string, n_chars long, n_low long")
