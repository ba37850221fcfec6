"""Main text of web pages, by container paths on which the pages of a host agree.

First pass: every page scores its containers by the text they hold and names the best
one's path of generalised tags and classes (digits in class names become ``#``). Spark
counts these votes per host; every path with a real share of them wins. Second pass: a
page is extracted from the containers on the winning path that scores best on it. A page
without such a path, or whose own best container holds far more, uses that container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .url_filters import url_host

#: A comment, declaration or tag; quoted attribute values may hold ``>``.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[a-z]+")

CONTAINERS = frozenset("body div article section main td".split())
#: Elements whose content is text of its own kind and never markup.
RAW = frozenset("script style textarea noscript template iframe title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article.
DROPPED = frozenset("head nav footer aside form menu dialog button select svg canvas object audio video".split())
#: Elements inside a line; every other tag separates words.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
#: Words in class, id or role that mark what is not the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar widget widgets footer cookie cookies consent gdpr notice popup modal overlay newsletter"
    " subscribe subscription signup login share sharing social comment comments reply replies disqus respond related recommended"
    " recommendations pagination pager form paywall masthead toolbar contentinfo complementary dialog hidden".split()
)
#: The same, unless another word of the name speaks for an article.
WEAK_NOISE = frozenset("header head side search alert top bottom aside foot".split())
ARTICLE = frozenset("article post entry content main story text body page".split())
#: Words that make a name a layout flag ("has-sidebar", "comments-open"): it says what stands beside, not what this is.
FLAGS_FIRST = frozenset("has no with without is show hide hidden".split())
FLAGS_LAST = frozenset("open closed enabled disabled on off left right".split())
#: Where no more than this share of the best dropped element's text is left, that element was the article.
LEFT = 0.1
#: A path wins with this share of its host's votes or more, so a host has ten of them at most.
SHARE = 0.1
#: A winning path is refused on a page where it scores less than this part of the page's best container.
REFUSED = 0.4
#: Names of what readers wrote: never the article, as long as anything else is left.
REPLIES = frozenset("comment comments reply replies disqus respond".split())
#: An article element with less than this share of the longest one's score is a teaser.
TEASER = 0.3
_HIDDEN = re.compile(r"""display\s*:\s*none|(?:^|\s)hidden(?:\s|=|$|/)|aria-hidden\s*=\s*["']?true""", re.I)


class Element:
    """An open element: its path, and the text found directly in it."""

    __slots__ = ("tag", "path", "dropped", "container", "score", "parent", "linked", "article", "lost")

    def __init__(self, tag: str, path: str, dropped: bool, container: bool, parent: Element | None, article: bool) -> None:
        self.tag, self.path, self.dropped, self.container = tag, path, dropped, container
        self.parent, self.score, self.linked, self.article = parent, 0.0, 0.0, article
        self.lost: list | None = None


def _names(attributes: str) -> tuple[list[str], set[str], bool]:
    """Generalised classes, the words of class, id and role without layout flags, and whether a whole name says article."""
    classes: list[str] = []
    words: set[str] = set()
    article = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            value = value.strip("\"'").lower()
            for token in value.split():
                parts = _WORDS.findall(token)
                if len(parts) > 1 and (parts[0] in FLAGS_FIRST or parts[-1] in FLAGS_LAST):
                    continue
                words.update(parts)
                article = article or bool(parts) and ARTICLE.issuperset(parts)
            if name == "class":
                classes = sorted({_DIGITS.sub("#", c) for c in value.split()})
    return classes, words, article


def walk(page: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """The containers of a page and its pieces of text (with their container), in page order.

    If names of elements dropped nearly all text, the one with most of it is read after all.
    """
    containers, pieces, lost = _walk(page, -1)
    most = max(lost, key=lambda n: n[1], default=None)
    if most is not None and most[1] > 0:
        left = sum(len(p.strip()) for e, p in pieces) - 1.5 * sum(e.linked for e in containers)
        if left <= 0 or left < LEFT * most[1] and not most[2]:
            containers, pieces, _ = _walk(page, most[0])
    return containers, pieces


def _walk(page: str, pardoned: int) -> tuple[list[Element], list[tuple[Element, str]], list[list]]:
    """The same, with the element whose tag ends at ``pardoned`` kept, and what names dropped: (end of tag, text, replies)."""
    lost: list[list] = []
    root = Element("", "", False, True, None, False)
    stack, containers, pieces = [root], [root], []
    at, link = 0, 0

    def text(raw: str) -> None:
        top = stack[-1]
        if raw and not top.dropped:
            pieces.append((top, raw))
            n = len(raw.strip())
            top.score += n
            if link:
                top.linked += n
        elif raw and top.lost is not None:
            top.lost[1] += (-0.5 if link else 1.0) * len(raw.strip())

    length = len(page)
    while at < length:
        found = _MARKUP.search(page, at)
        if not found:
            text(page[at:])
            break
        if found.start() > at:
            text(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag, closing = found[2].lower(), found[1]
        if tag not in INLINE and not stack[-1].dropped:
            pieces.append((stack[-1], " "))
        if closing:
            if tag == "a":
                link = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if not end:
                break
            close = page.find(">", end.start())
            at = close + 1 if close >= 0 else length
            continue
        if tag in VOID or found[3].endswith("/"):
            continue
        if tag == "a":
            link = 1
            continue
        attributes = found[3]
        if tag not in CONTAINERS and tag not in DROPPED and tag != "header" and not attributes:
            continue
        parent = stack[-1]
        classes, words, named = _names(attributes) if attributes else ([], set(), False)
        article = parent.article or tag in ("article", "main")
        other = (
            parent.dropped or tag in DROPPED or (tag == "header" and not parent.article)
            or bool(attributes and _HIDDEN.search(attributes))
        )
        noise = tag not in ("body", "article", "main") and at != pardoned and not named and (
            bool(words & NOISE) or bool(words & WEAK_NOISE) and not words & ARTICLE
        )
        dropped, record = other or noise, None
        if noise and not other:
            record = [at, 0.0, bool(words & REPLIES)]
            lost.append(record)
        elif parent.lost is not None and tag not in DROPPED and not noise and not (attributes and _HIDDEN.search(attributes)):
            record = parent.lost
        if tag in CONTAINERS:
            element = Element(tag, ">".join([parent.path, ".".join([tag, *classes])]), dropped, True, parent, article)
            element.lost = record
            stack.append(element)
            if not dropped:
                containers.append(element)
        elif dropped:
            stack.append(Element(tag, parent.path, True, False, parent, article))
            stack[-1].lost = record
    return containers, pieces, lost


def _weight(element: Element) -> float:
    return element.score * (2.0 if element.tag in ("article", "main") else 1.0)


def best_container(containers: list[Element]) -> Element:
    """The container with most text: links count little, half of a child's score counts for its parent, articles twice."""
    for element in reversed(containers):  # children come after their parents
        element.score = max(0.0, element.score - 1.5 * element.linked)
    for element in reversed(containers):
        if element.parent is not None:
            element.parent.score += 0.5 * element.score
    return max(containers, key=_weight)


def extract(page: str, paths: Iterable[str] = ()) -> tuple[str, str]:
    """The text below the one of ``paths`` that scores best (or else below the page's best container), and the path that was used.

    All containers on the path count: an article may be cut into sections. Of several
    ``article`` elements, each of which is a whole, short ones beside a long one are
    teasers and do not count. Of equal scores the first path counts. A path that scores
    far less than the page's best container is not used.
    """
    containers, pieces = walk(page)
    best = best_container(containers)  # this also completes the scores
    chosen, most = [], REFUSED * _weight(best)
    for path in paths:
        found = [e for e in containers if e.path == path]
        least = TEASER * max((e.score for e in found), default=0.0)
        found = [e for e in found if e.tag != "article" or e.score >= least]
        score = sum(map(_weight, found))
        if found and (score > most or not chosen and score == most):
            chosen, most = found, score
    text = _joined(pieces, {id(e) for e in chosen})
    return (text, chosen[0].path) if text else (_joined(pieces, {id(best)}), best.path)


def _joined(pieces: list[tuple[Element, str]], chosen: set[int]) -> str:
    inside: dict[int, bool] = {}

    def within(element: Element | None) -> bool:
        if element is None:
            return False
        key = id(element)
        if key not in inside:
            inside[key] = key in chosen or within(element.parent)
        return inside[key]

    raw = "".join(p for e, p in pieces if within(e))
    return " ".join((html.unescape(raw) if "&" in raw else raw).split())


def extract_pages(pages: DataFrame) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars, path.

    A null or empty html gives an empty text. Pages whose url is null or has no host
    neither vote nor follow a vote. Votes count pages; paths are tried by votes, then
    alphabetically. Whole pages are read. Repeated rows stay repeated and vote each; no
    pages give no rows.
    """
    source = F.coalesce(F.col("html"), F.lit(""))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [best_container(walk(p)[0]).path for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["_host", "path"])

    host = F.nullif(url_host(F.col("url")), F.lit(""))
    voters = pages.select(host.alias("_host"), source).where("_host IS NOT NULL")
    counts = cut_lineage(
        voters.mapInArrow(vote, "_host string, path string").groupBy("_host", "path").agg(F.count(F.lit(1)).alias("n"))
    )
    # Only the ten paths or fewer that win are gathered per host.
    winners = cut_lineage(
        counts.join(counts.groupBy("_host").agg(F.sum("n").alias("total")), "_host").where(F.col("n") >= SHARE * F.col("total"))
        .groupBy("_host").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))["path"].alias("_paths"))
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(p, w or ()) for p, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            texts = [t for t, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([p for _, p in found], pa.string())],
                names=["page_id", "url", "text", "n_chars", "path"],
            )

    joined = (
        pages.select("page_id", "url", source.alias("_html"), host.alias("_host"))
        .join(winners, "_host", "left").select("page_id", "url", "_html", "_paths")
    )
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long, path string")
