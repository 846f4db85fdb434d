"""Main text of web pages by composite text density.

A page becomes a DOM; nodes that cannot be content (scripts, menus, forms, and
what class or id calls an advert, a notice, comments and the like) are pruned. A
name counts if it says that and nothing else: ``site-footer`` does,
``side-by-side`` does not. Names prune no heading; of paragraphs and inline
elements only adverts and share links, by class; in an article or main element
only adverts, comments, share links, related lists, newsletter and cookie boxes.
A form, or what is named for a place on the page, stays if it holds an article or
most of the page's text (frameworks wrap whole pages so); comments, adverts and
hidden parts never stay for their length. A header stays in an article or main
element and beside paragraphs, where it holds the title.
Every other node gets the composite text density: characters per tag, weighed
down by link characters and link tags. The node with the greatest sum of its
children's densities is the heart of the text; the least density on its way up
to the body is the threshold; from the body down, in each subtree of at least
that density the node of the greatest sum is content. Where articles (or else a
main element) hold most of the heart's text, the content is taken in whole articles:
all that hold such a node, with the headings before them. In any content, lists and
boxes that are mostly links and of less than the threshold's density are left out.

Defined results: null or empty html, or a page without text, gives the empty
text; a page cut off anywhere is read as far as it goes (an unfinished tag is no
text); unknown or unterminated character references stay as they are written;
repeated rows each give a row; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import wordhash as wh
from .common import arrow_map

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # only a quote right behind "=" opens a value; any other is a character like others, as the rules of HTML have it
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:(?P<shut>>)|\Z)", re.S)
_ATTR = re.compile(r"(=?[^\s/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|(\S*)))?")
# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
PRUNED = RAW - {"xmp"} | frozenset(
    "applet aside audio button canvas datalist footer head input legend map menu nav optgroup option select svg template video".split())
# pruned too, but where they hold the content
WRAPPERS = frozenset("dialog fieldset form label object".split())
LISTS = frozenset("center details div dl ol section table ul".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre "
    "section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCKS - {"caption", "tbody", "tfoot", "thead", "tr", "html", "body"} | frozenset("aside fieldset footer form header menu nav".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = frozenset("ul ol dl table td th select body html article section div main".split())
# Parts of class and id names. A name is a hint if it has a part of the
# hints that apply and all its other parts are numbers or say only what box it is.
BOX = frozenset(
    "area article articles bar block box bottom button buttons container content entry form global icon icons inline inner item items left link links "
    "list main outer page panel post posts primary right secondary section site slot stories story thread tool tools top unit user wrap wrapper".split())
ADS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsbygoogle adsense sponsored".split())
SHARE = frozenset("addthis share sharedaddy sharing".split())
# kinds that are no content in an article either; of ids only those that no heading is called
INNER = ADS | SHARE | frozenset("comment commentlist comments disqus recommended related relatedposts".split())
# in an article by class alone: an anchor may be called so
BOXES = frozenset("consent cookie cookies gdpr newsletter popup signup subscribe".split())
STRUCTURE = frozenset(
    "adsbygoogle adsense advertisement breadcrumb breadcrumbs commentlist comments cookie cookies disqus footer gdpr masthead nav navbar navi navigation "
    "pager pagination popup sidebar toolbar topbar".split())
HINTS = INNER | STRUCTURE | frozenset(
    "alert banner consent copyright disclaimer discussion foot hidden legal login menu modal newsletter notice notification overlay promo promotion "
    "recommendations replies reply respond search side signup skip social sponsor subscribe widget".split())
ASIDE_ARTICLE = ADS | frozenset("comment comments promo related reply teaser".split())
HEADERS = frozenset("header site-header global-header top-header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# paragraphs and inline elements: never judged by id, by class only as an advert or share link
PHRASES = frozenset(
    "a abbr b bdi bdo big blockquote cite code data dd del dfn dt em figcaption figure font i ins kbd mark p pre q rp rt ruby s samp small span strike "
    "strong sub sup td th time tt u var wbr".split())
_PARTS = re.compile(r"[a-z]+|[^\W\da-z_]+")
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())


PLACE, NEVER, TITLE = 1, 2, 3


class Dom:
    """Nodes in page order by number, and the page's text pieces and block ends.
    ``hinted``: tag, class, id or role say that the node is no content (``PLACE``: but if it
    holds most of the page; ``NEVER``: whatever it holds but articles; ``TITLE``: but beside paragraphs)."""

    def __init__(self):
        self.parent, self.tag, self.pruned, self.hinted = [-1], ["#root"], [False], [0]
        self.inside = [False]  # an article or main element, or within one
        self.pieces: list[tuple[int, str | None]] = []  # (node, text), None at a block's edge

    def add(self, parent: int, tag: str, pruned: bool, hinted: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.pruned.append(pruned or self.pruned[parent])
        self.hinted.append(hinted)
        self.inside.append(self.inside[parent] or tag in ("article", "main"))
        return len(self.tag) - 1


def attributes(attrs: str) -> dict[str, str]:
    """Values by lower-case name; of attributes with one name the first."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(attrs):
        out.setdefault(name.lower(), "".join(values))
    return out


def _named(name: str, hints: frozenset[str], also: frozenset[str] = frozenset()) -> bool:
    """Whether a class or id name says one of the hints and nothing else (but for ``also``)."""
    parts = set(_PARTS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()))
    return not parts.isdisjoint(hints) and parts <= hints | BOX | also


def _hinted(tag: str, attrs: str, inside: bool) -> int:
    """How tag and attributes speak against a node; ``inside``: it is within an article or main element."""
    soft = PLACE if tag in WRAPPERS else TITLE if tag == "header" and not inside else 0
    if not attrs or tag in ("body", "html"):
        return soft
    has = attributes(attrs)
    if ("hidden" in has or has.get("aria-hidden", "").lower() == "true" or "display:none" in has.get("style", "").replace(" ", "").lower()
            or has.get("itemprop") == "comment"):
        return NEVER
    if tag in HEADINGS:
        return PLACE if has.get("role", "").lower() in ROLES else 0
    classes, name = has.get("class", "").split(), has.get("id", "").strip()
    if tag in PHRASES:
        return NEVER if any(_named(c, ADS | SHARE) for c in classes) else PLACE if has.get("role", "").lower() in ROLES else 0
    if tag in ("article", "main"):
        return NEVER if any(_named(c, ASIDE_ARTICLE) for c in [*classes, name]) else soft
    if any(_named(c, INNER) for c in classes) or inside and any(_named(c, INNER | BOXES, HINTS) for c in classes):
        return NEVER
    marked = bool(re.search(r"[\W_\d]", name))  # a bare id may be the anchor of a section
    if _named(name, INNER & STRUCTURE) or marked and _named(name, INNER):
        return NEVER
    if has.get("role", "").lower() in ROLES:
        return PLACE
    if not inside and (any(_named(c, HINTS) or c.lower() in HEADERS for c in classes) or _named(name, STRUCTURE) or marked and _named(name, HINTS)):
        return PLACE
    return soft


def parse(page: str) -> Dom:
    """The DOM of a page, with the usual optional end tags supplied."""
    dom, stack = Dom(), [0]
    depths: dict[str, list[int]] = {}  # of each open tag its places on the stack

    def top(tags) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    def close(tags, scopes=frozenset()) -> None:
        """Close the innermost open element of the tags, unless one of the scopes lies within it."""
        depth = top(tags)
        if depth and depth >= top(scopes):
            for node in stack[depth:]:
                depths[dom.tag[node]].pop()
            del stack[depth:]

    def text(raw: str) -> None:
        if raw:
            dom.pieces.append((stack[-1], html.unescape(raw) if "&" in raw else raw))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag or not m["shut"]:
            continue
        if tag in BLOCKS or tag in CLOSES_P:
            dom.pieces.append((stack[-1], None))
        if tag in ("br", "td", "th"):
            dom.pieces.append((stack[-1], " "))
        if m["end"]:
            if tag not in VOID:
                close({tag}, SCOPES - {tag} if tag in ("p", "li", "td", "th", "tr", "dt", "dd") else frozenset())
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPES)
        if tag in ENDED_BY:
            close(ENDED_BY[tag], SCOPES - ENDED_BY[tag])
        if tag in ("html", "body") and depths.get(tag):
            continue
        if tag == "body":
            close({"head"})
        node = dom.add(stack[-1], tag, tag in PRUNED, _hinted(tag, m["attrs"], dom.inside[stack[-1]]))
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not (m["attrs"].endswith("/") and tag not in BLOCKS):
            depths.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return dom


def _densities(dom: Dom, size: list[int]) -> tuple[list[float], list[float]]:
    """Composite text density of every node and the sum over its children."""
    n = len(dom.tag)
    chars, tags, link_chars, link_tags = size[:], [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = in_link[dom.parent[k]] or dom.tag[k] == "a"
        if in_link[k]:
            link_chars[k] = size[k]
    for k in range(n - 1, 0, -1):
        if dom.pruned[k]:
            continue
        p = dom.parent[k]
        chars[p] += chars[k]
        link_chars[p] += link_chars[k]
        tags[p] += tags[k] + 1
        link_tags[p] += link_tags[k] + (dom.tag[k] == "a")
    body = next((k for k in range(n) if dom.tag[k] == "body"), 0)
    share = link_chars[body] / max(chars[body], 1)
    density, sums = [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        if dom.pruned[k] or not chars[k]:
            continue
        c, t, lc, lt = chars[k], max(tags[k], 1), max(link_chars[k], 1), max(link_tags[k], 1)
        base = math.log(c / max(c - link_chars[k], 1) * link_chars[k] + share * c + math.e)
        density[k] = c / t * max(math.log(max(c / lc * t / lt, 1.0)) / math.log(base), 0.0) if base > 1 else c / t * math.log(max(c / lc * t / lt, 1.0)) / 1e-3
        if k:
            sums[dom.parent[k]] += density[k]
    return density, sums


def _subtree_sums(dom: Dom, size: list[int]) -> list[int]:
    total = size[:]
    for k in range(len(total) - 1, 0, -1):
        total[dom.parent[k]] += total[k]
    return total


def prune(dom: Dom, size: list[int]) -> None:
    """Prune what is hinted at, but for a node that holds an article or a main element; for a wrapper or a
    name of a place that holds more than three fifths of the text; and for a header beside paragraphs."""
    n = len(dom.tag)
    for k in range(n):
        if dom.pruned[k]:
            size[k] = 0
    total = _subtree_sums(dom, size)
    holds = [False] * n
    for k in range(n - 1, 0, -1):
        here = dom.tag[k] in ("article", "main") and not dom.pruned[k] and not dom.hinted[k] and total[k] > 0
        holds[dom.parent[k]] |= holds[k] or here
    prose = [False] * n  # has a paragraph among its children
    for k in range(1, n):
        if dom.tag[k] in ("p", "blockquote", "pre") and total[k] and not dom.pruned[k] and dom.tag[dom.parent[k]] not in ("body", "#root"):
            prose[dom.parent[k]] = True
    for k in range(1, n):
        how = dom.hinted[k]
        stays = not how or holds[k] or how == PLACE and 5 * total[k] > 3 * total[0] or how == TITLE and prose[dom.parent[k]]
        if dom.pruned[dom.parent[k]] or not stays:
            dom.pruned[k] = True
            size[k] = 0


def content_nodes(dom: Dom, size: list[int]) -> list[bool]:
    """Which nodes' text is main text."""
    n = len(dom.tag)
    density, sums = _densities(dom, size)
    total = _subtree_sums(dom, size)
    body = next((k for k in range(n) if dom.tag[k] == "body"), 0)
    # the node of the greatest sum in each subtree; of equals the first in page order
    best = list(range(n))
    for k in range(n - 1, 0, -1):
        p = dom.parent[k]
        if not dom.pruned[k] and (sums[best[k]], -best[k]) > (sums[best[p]], -best[p]):
            best[p] = best[k]
    heart = best[body]
    threshold, up = density[heart], heart
    while up > 0:
        threshold = min(threshold, density[up])
        if up == body:
            break
        up = dom.parent[up]
    dense = [False] * n
    for k in range(body, n):
        if not dom.pruned[k] and total[k] and density[k] >= threshold:
            dense[best[k]] = True
    content = dense[:]
    for kind in ("article", "main"):
        regions = _outermost(dom, kind, total)
        if regions and 2 * sum(total[k] for k in regions) >= total[heart] > 0:
            content = _whole(dom, regions, dense, heart)
            break
    links = _link_lists(dom, size, total, density, threshold)
    for k in range(1, n):
        content[k] = (content[k] or content[dom.parent[k]]) and not dom.pruned[k] and k not in links
    return content


def _outermost(dom: Dom, tag: str, total: list[int]) -> list[int]:
    """Elements of a tag that lie in no other of it and hold text."""
    within = [False] * len(dom.tag)
    out = []
    for k in range(1, len(dom.tag)):
        p = dom.parent[k]
        within[k] = within[p] or dom.tag[p] == tag
        if dom.tag[k] == tag and not within[k] and not dom.pruned[k] and total[k]:
            out.append(k)
    return out


def _whole(dom: Dom, regions: list[int], dense: list[bool], heart: int) -> list[bool]:
    """Regions that hold a dense node (or the heart's), and the headings that stand before them."""
    n = len(dom.tag)
    has = dense[:]
    has[heart] = True
    for k in range(n - 1, 0, -1):
        has[dom.parent[k]] |= has[k]
    chosen = [k for k in regions if has[k]] or regions
    content = [False] * n
    first: dict[int, int] = {}
    for k in chosen:
        content[k] = True
        first.setdefault(dom.parent[k], k)
    for k in range(1, n):
        if dom.tag[k] in ("h1", "hgroup", "header") and dom.inside[k] and k < first.get(dom.parent[k], 0):
            content[k] = True
    return content


def _link_lists(dom: Dom, size: list[int], total: list[int], density: list[float], threshold: float) -> set[int]:
    """Lists and boxes of two links or more that are mostly links, below the threshold's density."""
    n = len(dom.tag)
    in_link, linked, count = [False] * n, [0] * n, [0] * n
    for k in range(1, n):
        in_link[k] = in_link[dom.parent[k]] or dom.tag[k] == "a"
        if in_link[k]:
            linked[k] = size[k]
    for k in range(n - 1, 0, -1):
        if not dom.pruned[k]:
            linked[dom.parent[k]] += linked[k]
            count[dom.parent[k]] += count[k] + (dom.tag[k] == "a")
    return {k for k in range(1, n) if dom.tag[k] in LISTS and count[k] >= 2 and 5 * linked[k] >= 3 * total[k] > 0 and density[k] < threshold}


def main_text(page: str | None) -> str:
    """The main text: blocks in page order, one to a line."""
    if not page:
        return ""
    dom = parse(page)
    size = [0] * len(dom.tag)
    for k, t in dom.pieces:
        if t is not None:
            size[k] += len(" ".join(t.split()))
    prune(dom, size)
    content = content_nodes(dom, size)
    blocks, open_block = [], []
    for k, t in dom.pieces:
        if t is None:
            blocks.append(" ".join("".join(open_block).split()))
            open_block = []
        elif content[k]:
            open_block.append(t)
    blocks.append(" ".join("".join(open_block).split()))
    return "\n".join(b for b in blocks if b)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in wh.slices(whole, "html"):
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "html"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             names=[*(c for c in batch.schema.names if c != "html"), "text", "n_chars"])


def extracted(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` (its code points) of every page."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return arrow_map(df.selectExpr(*(f"`{c}`" for c in keep), f"`{html_col}` AS html"), _extracted, f"{kinds}, text string, n_chars long")
