"""Main text of web pages by a site style tree.

The pages of a host are merged into one style tree: a node stands for all elements that are reached by the
same path of tags and classes. Two entropies say how important a node is. Presentation: an element whose
children are laid out in many ways matters, one that always looks the same does not. Content: blocks that
differ from page to page matter, blocks that return on many pages do not. Branches of low importance are
removed from each page. Tags and class words are evidence for the tree: a branch that they declare to be a menu, a
footer or an advert needs far more importance to stay, and within an article element a branch has to be of less
importance still to be removed. Only what no measure of repetition can tell is left out while parsing: scripts,
styles, forms, hidden elements, and reader comments, which differ from page to page as stories do.

Only hashes of nodes and blocks are aggregated, with partial sums, so one host with a third of all pages is
no larger a group than any other. The weak nodes of a host are parts of its templates, a short list, and
are joined to its pages by a plain join: Spark broadcasts the table if it is small and splits hot hosts if not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feltgrid.llm.frames import column, slices, texts
from feltgrid.operators.stage import stage

WEAK = 0.5  # nodes of less importance are removed
WEAK_IN_ARTICLE = 0.1
WEAK_DECLARED = 0.95  # nodes that their tag or class declares to be no content
PRESENTATION_SHARE = 0.1  # of the presentation in a node's importance, the rest is content
COMMON_WEIGHT = 4.0  # pages that the tree of all hosts counts for beside a host's own

#: HTML elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp template svg math".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s
samp small span strike strong sub sup time tt u var br wbr img""".split())
NO_TEXT = frozenset("""head form button select option noscript iframe object embed canvas audio video map applet frame
frameset""".split())
DECLARED = frozenset("nav header footer aside menu dialog".split())
ARTICLE = frozenset("article main".split())

CONTENT = frozenset("html body main article".split())  # no class declares these to be no content
WHOLE = frozenset(["", "html", "body"])  # hold all blocks of a page, so their importance tells none apart

#: Classes, ids and roles that declare a branch to be no content, if they begin with one of these words
#: and go on with such words, words of structure and numbers alone.
_COMMENTS = r"(?:comments?|commentlist|disqus|replies|respond)"
_WORD = (
    r"(?:ads?|advert\w*|adslot|banner|breadcrumbs?|comments?|consent|cookies?|copyright|disqus|footer|gdpr|masthead|menu|"
    r"modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo\w*|related|replies|respond|share|sharing|"
    r"sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget|skip-link|search|complementary|contentinfo|alert)"
)
_PART = r"(?:list|section|area|container|wrapper|wrap|box|bar|buttons?|item|thread|block|group|inner|links?|panel|slot|unit)"
NO_CONTENT_TOKEN = re.compile(rf"{_WORD}(?:[-_](?:{_WORD}|{_PART})|[-_]?\d+)*", re.I)
COMMENT_TOKEN = re.compile(rf"{_COMMENTS}(?:[-_](?:{_WORD}|{_PART})|[-_]?\d+)*", re.I)

_TOKEN = re.compile(rf"{_WORD}(?:[-_]{_WORD}|[-_]?\d+)*", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NUMBERS = re.compile(r"\b[0-9a-fA-F]*\d[0-9a-fA-F]*")  # ids written into pages would give each its own nodes

CONTENT_OF, LAYOUT_OF, ON_PAGE, UNDER, IS_DECLARED = range(5)  # kinds of features of a node


@dataclass
class Element:
    tag: str
    node: int  # hash of the path of tags and classes down to here
    dropped: bool
    in_article: bool
    declared: bool
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    text: str
    path: tuple[int, ...]  # nodes from the root down
    in_article: bool
    declared: bool
    whole: int  # leading nodes of the path that hold the whole page


@dataclass
class Page:
    blocks: list[Block]
    layouts: list[tuple[int, int]]  # node, hash of the order of its children
    declared: set[int]  # nodes that tag or class declares to be no content


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "replace")) - (1 << 63)


def parse(source: str, evidence: bool = True) -> Page:
    """The text blocks of a page in order, each with its path, and the layout of each element.

    Missing end tags are put in where a block begins or ends; a stray end tag is skipped. Content of
    scripts, styles and the like, forms, hidden elements and comments give no blocks. Without ``evidence`` no
    class word says anything.
    """
    stack = [Element("", _hash("root"), False, False, False)]
    declared_nodes: set[int] = set()
    blocks: list[Block] = []
    layouts: list[tuple[int, int]] = []
    words: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text and not stack[-1].dropped:
            blocks.append(Block(text, tuple(e.node for e in stack if e.tag not in INLINE), stack[-1].in_article, stack[-1].declared, sum(e.tag in WHOLE for e in stack)))

    def pop() -> None:
        element = stack.pop()
        if element.children:
            layouts.append((element.node, _hash(*element.children)))

    def close(tags: frozenset[str] | set[str], limit: frozenset[str] | set[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                while len(stack) > i:
                    pop()
                return
            if stack[i].tag in limit:
                return

    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.match(source, at)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if source[m.start()] != "<" or m[0] == "<":
                if not stack[-1].dropped:
                    words.append(m[0])
            continue
        tag, ends, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ends:
            if tag in INLINE:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i]
                        break
            else:
                flush()
                close({tag})
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            at = size if end is None else end.start()
            # The end tag itself is read as a stray one.
            continue
        inline = tag in INLINE
        if not inline:
            flush()
            close({"p"} | {e for e in INLINE}, limit={e.tag for e in stack if e.tag not in INLINE and e.tag != "p"})
            if tag == "li":
                close({"li"}, {"ul", "ol"})
            elif tag in ("dt", "dd"):
                close({"dt", "dd"}, {"dl"})
            elif tag in ("tr", "td", "th"):
                close({"tr"} if tag == "tr" else {"td", "th"}, {"table", "tr"} if tag != "tr" else {"table"})
            if tag == "hr":
                continue
        named = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
        style = " ".join(filter(None, (named.get("class"), named.get("id"), named.get("role"))))
        parent = stack[-1]
        in_article = parent.in_article or tag in ARTICLE or named.get("role") in ("main", "article")
        hidden = "hidden" in attributes.lower().split() or "display:none" in named.get("style", "").replace(" ", "").lower()
        words_of = style.split() if evidence and tag not in CONTENT else []
        by_class = any(map(NO_CONTENT_TOKEN.fullmatch, words_of))
        comment = any(map(COMMENT_TOKEN.fullmatch, words_of))
        # Inline elements have no nodes of their own to be judged by.
        dropped = parent.dropped or tag in NO_TEXT or hidden or comment or (inline and by_class)
        own = not inline and (by_class or (tag in DECLARED and not (tag == "header" and parent.in_article)))
        if not inline:
            parent.children.append(tag)
        node = parent.node if inline and not style else _hash(parent.node, tag, _NUMBERS.sub("#", style))
        if inline and dropped and not parent.dropped:
            flush()  # what stands before an inline branch that is left out
        if own and not dropped:
            declared_nodes.add(node)
        stack.append(Element(tag, node, dropped, in_article, own or parent.declared))
    flush()
    while len(stack) > 1:
        pop()
    return Page(blocks, layouts, declared_nodes)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, "" if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)", 1), F.lit("")))


# --- The tree -------------------------------------------------------------------------------


def style_nodes(pages: DataFrame, evidence: bool = True) -> DataFrame:
    """(host, node, kind, feature, share, common), each once for a page: blocks, layouts, the page itself, branches that hold the node, and whether it is declared.

    Pages with the same blocks in the same places are one page of their host's tree and of the tree of all hosts:
    their shares add up to one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            digests, found = [], []
            for source in texts(batch, "html"):
                page = parse(source, evidence)
                digests.append(_hash(*((b.text, b.path) for b in page.blocks)))
                rows = {(n, LAYOUT_OF, f) for n, f in page.layouts} | {(n, ON_PAGE, 0) for n, _ in page.layouts} | {(n, IS_DECLARED, 0) for n in page.declared}
                for b in page.blocks:
                    rows.add((b.path[-1], CONTENT_OF, _hash(b.text)))
                    for n in b.path:
                        rows |= {(b.path[-1], UNDER, n), (n, ON_PAGE, 0)}
                found.append([*zip(*rows)] or [(), (), ()])
            host = batch.column(batch.schema.get_field_index("host"))
            lists = [pa.array([f[i] for f in found], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([host, pa.array(digests, pa.int64()), *lists], ["host", "digest", "nodes", "kinds", "features"])

    parsed = stage(pages.select("host", "html").mapInArrow(run, "host string, digest long, nodes array<long>, kinds array<int>, features array<long>"))
    # Only pages with copies, so that nothing is shuffled unless very many have them.
    copied = stage(parsed.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("copies")))
    every = stage(copied.groupBy("digest").agg(F.sum("copies").alias("everywhere")).filter(F.col("everywhere") > 1))
    own = copied.filter(F.col("copies") > 1)
    shared = parsed.join(own, ["host", "digest"], "left").join(every, "digest", "left").select(
        "host", (1 / F.coalesce("copies", F.lit(1))).alias("share"), (1 / F.coalesce("everywhere", F.lit(1))).alias("common"),
        F.explode(F.arrays_zip("nodes", "kinds", "features")).alias("x"),
    )
    return shared.select("host", F.col("x.nodes").alias("node"), F.col("x.kinds").alias("kind"), F.col("x.features").alias("feature"), "share", "common")


def node_importance(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m, importance) of each node, from the number of pages of each of its features.

    With m pages, a block on n of them has the entropy log n / log m: 1 if it is on all. The content
    importance of a branch is 1 less the mean over the blocks met in it, page by page. Its layout
    importance is the entropy of the orders of its children.
    """
    content, layout = F.col("kind") == CONTENT_OF, F.col("kind") == LAYOUT_OF
    sums = counts.filter(F.col("kind") != UNDER).groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == ON_PAGE, F.col("n"))).alias("m"),
        F.sum(F.when(content, F.col("n") * F.log("n"))).alias("repeated"), F.sum(F.when(content, F.col("n"))).alias("blocks"),
        F.sum(F.when(layout, F.col("n") * F.log("n"))).alias("alike"), F.sum(F.when(layout, F.col("n"))).alias("layouts"),
    )
    # In blocks, so that branches can add them up.
    unlike = F.col("blocks") - F.coalesce(F.col("repeated") / F.when(F.col("m") > 1, F.log("m")), F.lit(0.0))
    spread = F.when(F.col("layouts") > 1, F.least(F.lit(1.0), (F.log("layouts") - F.col("alike") / F.col("layouts")) / F.log("layouts")))
    nodes = sums.select(*keys, "m", F.greatest(F.lit(0.0), unlike).alias("unlike"), "blocks", F.coalesce(spread, F.lit(0.0)).alias("layout"))
    outer = keys[:-1]
    under = counts.filter(F.col("kind") == UNDER).select(*outer, F.col("node").alias("leaf"), F.col("feature").alias("node")).distinct()
    leaves = nodes.select(*outer, F.col("node").alias("leaf"), "unlike", "blocks").filter(F.col("blocks") > 0)
    branches = under.join(leaves, [*outer, "leaf"]).groupBy(*keys).agg((F.sum("unlike") / F.sum("blocks")).alias("content"))
    return nodes.join(branches, keys).select(*keys, "m", (PRESENTATION_SHARE * F.col("layout") + (1 - PRESENTATION_SHARE) * F.col("content")).alias("importance"))


def importance(pages: DataFrame, evidence: bool = True) -> DataFrame:
    """(host, node, importance, declared): from the host's own tree, steadied by the tree of all hosts where pages are few, or from that of all hosts if it says less."""
    counts = stage(style_nodes(pages, evidence).groupBy("host", "node", "kind", "feature").agg(F.round(F.sum("share")).cast("long").alias("n"), F.sum("common").alias("common")))
    own = node_importance(counts, ["host", "node"])
    alike = F.greatest(F.lit(1), F.round(F.sum("common")).cast("long"))
    every = node_importance(counts.groupBy("node", "kind", "feature").agg(alike.alias("n")), ["node"])
    every = every.select("node", F.col("m").alias("m_all"), F.col("importance").alias("common"))
    # A tree of one host's pages alone adds nothing to that host's own tree.
    weight = F.when(F.col("m_all") > F.col("m"), F.lit(COMMON_WEIGHT)).otherwise(0.0)
    steadied = (F.col("m") * F.col("importance") + weight * F.col("common")) / (F.col("m") + weight)
    declared = counts.filter(F.col("kind") == IS_DECLARED).select("host", "node", F.lit(True).alias("declared"))
    # What many hosts print, such as adverts, may be new to each of them.
    least = F.when(F.col("m_all") > F.col("m"), F.least(steadied, F.col("common"))).otherwise(steadied)
    judged = own.join(every, "node").select("host", "node", least.alias("importance"))
    return judged.join(declared, ["host", "node"], "left").withColumn("declared", F.coalesce("declared", F.lit(False)))


# --- The operator ---------------------------------------------------------------------------


def main_text(source: str, weak: set[int], very_weak: set[int], evidence: bool = True) -> str:
    """Blocks outside weak branches, joined by blanks; if none is left, those not declared non-content."""
    blocks = parse(source, evidence).blocks
    kept = [b for b in blocks if not any(n in (very_weak if b.in_article else weak) for n in b.path[min(b.whole, len(b.path) - 1) :])]
    return " ".join(b.text for b in kept or [b for b in blocks if not b.declared])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", evidence: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null page is empty and gives an empty text; a null url or one without a host belongs to the host
    "". Copies on a host get equal texts and are one page of its tree. Text is never cut or sampled. Without
    ``evidence`` class words are not heeded.
    """
    pages = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("html"), host_of(F.col(url)).alias("host")
    )
    id_type = pages.schema["page_id"].dataType.simpleString()
    limit = F.when(F.col("declared"), WEAK_DECLARED)
    marked = importance(pages, evidence).filter(F.col("importance") < limit.otherwise(WEAK))
    weak = stage(marked.groupBy("host").agg(
        F.collect_list("node").alias("weak"), F.collect_list(F.when(F.col("importance") < limit.otherwise(WEAK_IN_ARTICLE), F.col("node"))).alias("very")
    ))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            out = [
                main_text(source, set(w or ()), set(v or ()), evidence)
                for source, w, v in zip(texts(batch, "html"), column(batch, "weak"), column(batch, "very"))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("page_id")), batch.column(batch.schema.get_field_index("url")), pa.array(out, pa.string()),
                 pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"],
            )

    joined = pages.join(weak, "host", "left")
    return joined.select("page_id", "url", "html", "weak", "very").mapInArrow(finish, f"page_id {id_type}, url string, text string, n_chars long")
