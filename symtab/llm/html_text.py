"""HTML extraction with a site style tree (operator 3).

Pages of a host are made from few templates. Their DOMs are merged into one tree whose nodes are element paths (tag, class
and id from the body down); for each node the tree counts, over the m pages that have it, the child sequences it shows
(presentation) and the blocks of text below it (content). With entropies to the base m:

* presentation importance: entropy of the child sequences; a node that always looks the same scores 0;
* content importance: 1 minus the mean entropy of its text features; a text found on k of m pages has entropy log_m(k), so
  a notice that all pages carry scores 0 and a text of one page 1;
* a node with l child sequences has the importance (1 - GAMMA ** l) * presentation + GAMMA ** l * content.

Nodes that at least MIN_PAGES pages of a host have are judged: branches of importance below LEAST are removed from every page of
the host, inside <article> and <main> too (there as containers, such as a box that all articles bear; running text by its
element alone, as a paragraph, is not, nor are these two themselves). What a page declares about itself is the prior: branches that are
menus, headers, footers, sidebars, notices, adverts, forms or reader comments by element, role, class or id weigh 0. For <html> and <body>
class and id do not count, nor do they, a role or <form> around <main>: there the tree judges. Around <article> only whole class
names count, as in "comments" but not in "with-comments", and they do not either where that leaves the page without text, so that no
name empties a page. Of a page with <article> or <main> what lies outside is kept where the tree calls it important and it is a
heading or paragraph before the main branch, as a headline or lead, or where there is more of it, before and after, than in the
main branches, which then are but a part. The prior also serves hosts with few pages.

Counts are aggregated by (host, node, feature) before each shuffle, so a host with a third of all pages is no one task's work.
The verdicts come back to the pages by a join on the host, broadcast only below a size.

Text: character references decoded, white space of a block turned into one space, ends trimmed, blocks joined by two
newlines in page order, nothing capped. Defined results: null or empty html gives an empty text; a null or odd url counts
as one host without a name; repeated rows are pages of their own; other columns pass through, except that outputs replace
input columns of their name; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from symtab.llm.common import fresh, materialize, without

GAMMA, LEAST, MIN_PAGES = 0.9, 0.2, 8
#: Nodes with verdicts (8 bytes each) that may be broadcast.
BROADCAST_NODES = 2_000_000

# Element names of HTML by their role here, and class or id words of page furniture.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template iframe svg textarea object canvas noembed noframes xmp annotation annotation-xml".split())
FURNITURE = frozenset("head title nav menu footer aside form fieldset legend button select option dialog search".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
FLOW = MAIN | HEADINGS | frozenset("li dt dd blockquote pre tr td th tbody thead tfoot figcaption caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup overlay modal newsletter subscribe subscription paywall"
    " sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus replies share sharing social related recommended widget toolbar pagination pager login signup searchbox form".split()
)
#: Of these, a new one ends an open one of the same kind (up to the container named).
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("ul ol menu dir dl table tbody thead tfoot select body".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_SVG_TEXT = re.compile(r"<text\b[^>]*>(.*?)</text\b[^>]*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")


class Node:
    """One element. ``path`` is the hash of the path from the root; ``main``: inside article or main; ``article``: inside article.

    ``drop``: furniture. ``own``: 3 if the element itself is, 2 if its role, a whole class name or its id says so (or it is a
    form), 1 if a word within such a name does; ``holds``: 2 for an element around <main>, 1 around <article>.
    """

    __slots__ = ("article", "children", "drop", "holds", "main", "own", "parent", "path", "tag")

    def __init__(self, tag: str, path: int, parent: Node | None = None, own: int = 0, main: bool = False, article: bool = False):
        self.tag, self.path, self.parent, self.own, self.main, self.article = tag, path, parent, own, main, article
        self.children, self.holds, self.drop = [], 0, False


def blocks_of(html: str | None, spared: int = 1) -> list:
    """(text, open elements from the root) of each block of text in page order, and (None, element) for each element as it ends.

    ``spared``: up to which ``own`` an element around an article is no furniture.
    """
    found, nodes = [], []
    for said, where in _parse(html, nodes):
        found.append((said, where if said is None else list(where)))
    for n in nodes:  # parents come before their children
        n.drop = n.parent.drop or n.own == 3 or (n.own > 0 and n.holds < 2 and not (n.holds and n.own <= spared))
    return found


def _parse(html: str | None, nodes: list[Node]):
    """What blocks_of gives, with ``stack`` still in use; elements are added to ``nodes``, and ``drop`` is not known yet."""
    if not html:
        return
    stack, text, at = [Node("", 0)], [], 0
    pos, end = 0, len(html)

    def block():
        words = "".join(text).split()
        text.clear()
        return " ".join(words)

    while pos < end:
        m = _TOKEN.search(html, pos)
        at = m.start() if m else end
        if at > pos:
            text.append(unescape(html[pos:at]))
        if m is None:
            break
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(m[1])
        if tag in RAW and not closing:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, pos)
                inside, pos = html[pos : close.start() if close else end], close.end() if close else end
                if tag == "svg":
                    text.extend(f" {unescape(_TAG.sub(' ', t))} " for t in _SVG_TEXT.findall(inside))
                elif tag == "xmp":  # shown as it stands
                    if said := block():
                        yield said, stack
                    text.append(inside)
                    if said := block():
                        yield said, stack
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCKS and tag != "button":
            continue
        if said := block():
            yield said, stack
        if closing:
            if any(n.tag == tag for n in stack):
                while True:
                    n = stack.pop()
                    yield None, n
                    if n.tag == tag:
                        break
            continue
        if tag not in ("button", "option") and any(n.tag == "p" for n in stack[-3:]):
            while (n := stack.pop()).tag != "p":
                yield None, n
            yield None, n
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SIBLINGS[tag]:
                    while len(stack) > i:
                        yield None, stack.pop()
                elif stack[i].tag in CONTAINERS:
                    break
        if tag == "hr":
            continue
        top = stack[-1]
        names = {k.lower(): a or b or c for k, a, b, c in _NAMES.findall(m[3])} if m[3] else {}
        words = {w for k in ("class", "id") if k in names for w in _SPLIT.split(names[k].lower())}
        main = top.main or tag in MAIN
        whole = {w for k in ("class", "id") if k in names and tag not in ("html", "body") for w in names[k].lower().split()}
        if (tag in FURNITURE and tag != "form") or (tag == "header" and not main):
            own = 3
        elif tag == "form" or names.get("role", "").lower() in ROLES or whole & WORDS:
            own = 2
        else:
            own = 1 if words & WORDS and tag not in ("html", "body") else 0
        label = f"{tag}.{' '.join(sorted(words))}"
        top.children.append(label)
        node = Node(tag, xxhash.xxh3_64_intdigest(label.encode(), top.path), top, own, main, top.article or tag == "article")
        # articles in an article are its comments or teasers
        if tag in MAIN and not top.article:
            for n in (*stack, node):
                n.holds = max(n.holds, 2 if tag == "main" else 1)
        stack.append(node)
        nodes.append(node)
    if said := block():
        yield said, stack
    while len(stack) > 1:
        yield None, stack.pop()


def page_text(html: str | None, low: frozenset[int] = frozenset(), high: frozenset[int] = frozenset()) -> str:
    """Main text of a page; ``low``: paths of unimportant nodes of its host, ``high``: of important ones outside main branches."""
    text = _selected(blocks_of(html), low, high)
    # where all pages are alike, statistics find nothing important: then only the page's own marks count
    return text or (low and _selected(blocks_of(html), frozenset(), high)) or _selected(blocks_of(html, 2), frozenset(), high)


def _selected(blocks: list, low: frozenset[int], high: frozenset[int]) -> str:
    kept, has_main, above = [], False, True
    for said, where in blocks:
        if said is None:
            has_main = has_main or where.tag in MAIN and not where.drop
            continue
        top = where[-1]
        if top.drop or (low and any(n.path in low and not (n.main and n.tag in FLOW) for n in where)):
            continue
        above = above and not top.main
        kept.append((said, top.main, above and top.tag in HEADINGS, top.path in high))
    inside = sum(len(said) for said, main, _, _ in kept if main)
    outside = sum(len(said) for said, main, _, important in kept if important and not main)
    # a main branch with less text than what is important beside it is a part of the page's text, such as a teaser
    return "\n\n".join(said for said, main, lead, important in kept if main or not has_main or (important and (lead or outside > inside)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, kind, feature): of each page once, kind 0 the node itself (1 in a main branch), 1 its child sequence, 2 a text below it."""
    for batch in it:
        hosts, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[list] = [[], [], [], []]
        for host, html in zip(hosts, pages, strict=True):
            seen = set()
            for said, where in blocks_of(html):
                if said is None:
                    if not where.drop:
                        seen.add((where.path, 0, int(where.main)))
                        seen.add((where.path, 1, xxhash.xxh3_64_intdigest("|".join(where.children))))
                elif not where[-1].drop:
                    h = xxhash.xxh3_64_intdigest(said)
                    seen.update((n.path, 2, h) for n in where[1:])
            for path, kind, feature in seen:
                for column, value in zip(out, (host, _signed(path), kind, _signed(feature)), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["host", "path", "kind", "feature"])


def host_of(url: str):
    """Lower-cased host of a url column; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, main, pages, styles, importance) of each node of each host's merged tree."""
    features = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(_features, "host string, path long, kind int, feature long")
    k = features.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("k"))
    one = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(0))
    node = k.groupBy("host", "path").agg(
        one(0, F.col("k")).alias("pages"), F.max(F.when(F.col("kind") == 0, F.col("feature"))).alias("main"), one(1, F.lit(1)).alias("styles"), one(1, F.col("k") * F.log("k")).alias("style_sum"),
        one(2, F.lit(1)).alias("texts"), one(2, F.log("k")).alias("text_sum"),
    )
    # entropy of the styles: -sum(k/m log(k/m)) = log m - sum(k log k) / m
    m = F.log("pages")
    presentation = (m - F.col("style_sum") / F.col("pages")) / m
    content = F.when(F.col("texts") > 0, 1 - F.col("text_sum") / (F.col("texts") * m)).otherwise(0.0)
    share = F.pow(F.lit(GAMMA), F.col("styles"))
    return node.select("host", "path", (F.col("main") == 1).alias("main"), "pages", "styles", F.when(F.col("pages") < 2, 1.0).otherwise((1 - share) * presentation + share * content).alias("importance"))


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` plus ``text`` and ``n_chars``."""
    tree = style_tree(pages, url_col, html_col).filter(f"pages >= {MIN_PAGES} and (importance < {LEAST} or not main)").withColumn("is_low", F.col("importance") < LEAST)
    of = lambda wanted: F.collect_list(F.when(wanted, F.col("path")))
    judged = materialize(tree.groupBy("host").agg(of(F.col("is_low")).alias("low"), of(~F.col("is_low")).alias("high")), "style-tree")
    pages = without(pages, "text", "n_chars")
    columns = pages.columns
    host, host2, *paths = fresh(pages, "sst_host", "sst_host2", "sst_low", "sst_high")
    verdicts = judged.select(F.col("host").alias(host2), F.col("low").alias(paths[0]), F.col("high").alias(paths[1]))
    nodes = judged.agg(F.sum(F.size("low") + F.size("high") + 8)).first()[0] or 0
    verdicts = F.broadcast(verdicts) if nodes <= BROADCAST_NODES else verdicts
    joined = pages.withColumn(host, host_of(url_col)).join(verdicts, F.col(host) == F.col(host2), "left").select(*columns, *paths)
    at = columns.index(html_col)
    keep = [c for c in columns if c != html_col]

    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            html, *verdicts = (batch.column(i).to_pylist() for i in (at, len(columns), len(columns) + 1))
            texts = [page_text(h, *(frozenset(p % (1 << 64) for p in x or ()) for x in judged)) for h, *judged in zip(html, *verdicts, strict=True)]
            kept = [batch.column(i) for i in range(len(columns)) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = StructType([*(f for f in pages.schema.fields if f.name != html_col), StructField("text", StringType()), StructField("n_chars", LongType())])
    return joined.mapInArrow(extract, schema)
