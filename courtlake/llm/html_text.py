"""Main text of web pages by container paths on which the pages of a host agree."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.llm.common import stored
from courtlake.llm.url_filter import host_and_path

# Elements of HTML by their role, and words that name parts beside the article.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("audio button canvas head iframe input math noscript object option script select style svg template textarea title video".split())
BESIDE_TAGS = frozenset("aside dialog footer form menu nav".split())
BESIDE = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form login "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies reply share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
TALK = frozenset("comment comments disqus replies reply".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: An open element of the first kind ends where one of the second begins.
ENDED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"}),
    "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}),
}

OUTER = 0.6
MOST, MOST_SURE = 0.5, 0.9  # an element with more of the page's prose than this is not beside the article, whatever its name or tag
NEARLY = 0.95  # of a page's prose is held by its own container
SHARE = 0.05  # of a host's votes makes a path one of the host's
HALF, LITTLE = 0.5, 0.2  # of a page's prose: a path of its host with the first is taken, none is with less than the second

_TOKENS = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")


class Page(HTMLParser):
    """The text blocks of a page, each with the elements around it.

    An element is a number; ``parent`` and ``path`` give its parent and the digest of its generalised
    path: tags with their classes from the root, digits replaced, so that its size does not grow with
    the depth. ``blocks`` has (element, text, characters inside links) of blocks not beside the article.

    What lies beside the article is decided when the whole page is known, for a name or tag is a guess:
    see ``_kept``.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.path, self.blocks = [-1], [""], []
        self.tag = [""]
        self.article = [-1]  # the nearest article or main element around or at an element
        self.beside = [-1]  # the nearest element around or at an element that seems to lie beside the article
        self.sure = set()  # those of them that do so by their tag, or seem to hold comments
        self.stack = [("", 0, False, False)]  # tag, element, skipped, inline
        self.open = Counter()
        self.pieces, self.buffer = [], []  # blocks as (element, pieces); a piece is (element, text, whether in a link)
        self.feed(html)
        self.close()
        self._flush()
        kept = self._kept()
        for element, pieces in self.pieces:
            pieces = [x for x in pieces if self.beside[x[0]] in kept]
            if text := " ".join("".join(x[1] for x in pieces).split()):
                self.blocks.append((element, text, sum(len(x[1]) for x in pieces if x[2])))

    def _flush(self) -> None:
        if self.buffer:
            element = next(e for _, e, _, inline in reversed(self.stack) if not inline)
            self.pieces.append((element, self.buffer))
            self.buffer = []

    def _kept(self) -> set[int]:
        """Elements that seemed to lie beside the article and do not; -1 stands for no such element around.

        There are none if text of an article or main element lies outside all elements that seemed so.
        Prose counts for the nearest such element. One with most of the page's prose is no side matter;
        without one that with most prose in article or main elements, of those that the fewest others
        surround. What surrounds a kept one is kept.
        """
        prose, article = Counter(), Counter()
        for _, pieces in self.pieces:
            for e, text, linked in pieces:
                worth = 0 if linked else len(" ".join(text.split()))
                prose[self.beside[e]] += worth
                if self.article[e] >= 0:
                    article[self.beside[e]] += worth
        total, kept = prose.total(), {-1}
        if article[-1]:
            return kept
        above, depth = {}, {-1: 0}
        for e in sorted(set(self.beside) - {-1}):  # parents come first
            above[e] = self.beside[self.parent[e]]
            depth[e] = depth[above[e]] + 1
        inside = [e for e in above if prose[e] > total * (MOST_SURE if e in self.sure else MOST)]
        if not inside and +article:
            inside.append(min((e for e in above if article[e]), key=lambda e: (depth[e], -article[e], e)))
        for e in inside:
            while e not in kept:
                kept.add(e)
                e = above[e]
        return kept

    def _pop(self) -> None:
        tag, _, _, inline = self.stack[-1]
        if not inline:
            self._flush()
        self.stack.pop()
        self.open[tag] -= 1

    def _seems_beside(self, tag: str, attrs: dict) -> tuple[bool, bool]:
        """Whether an element seems to lie beside the article, and whether its tag says so or it seems to hold comments."""
        named = False, False
        if tag not in ("html", "body", "article", "main", "header"):
            names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()
            parts = [[x for x in _TOKENS.split(name) if x] for name in names]
            words = {x for p in parts if p for x in (p[0], p[-1])}  # words in the middle tell of other things, such as a wrapper
            named = not BESIDE.isdisjoint(words), not TALK.isdisjoint(words)
        if tag in BESIDE_TAGS or attrs.get("role") in ROLES or "hidden" in attrs:
            return True, named[1] or tag in BESIDE_TAGS and tag != "form"
        if tag == "header":  # a page's header; an article's own header holds its title
            return not (self.open["article"] or self.open["main"]), False
        return named

    def parse_html_declaration(self, i: int) -> int:
        """The end of a declaration; one that begins with ``<![`` ends at the next ``>``, whatever it says."""
        if self.rawdata.startswith("<![", i):
            return self.rawdata.find(">", i) + 1 or -1
        return super().parse_html_declaration(i)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """The end of a comment; ``<!-->`` and ``<!--->`` are whole ones."""
        for whole in ("<!-->", "<!--->"):
            if self.rawdata.startswith(whole, i):
                return i + len(whole)
        return super().parse_comment(i, report)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "br":
                self.buffer.append((self.stack[-1][1], " ", False))
            elif tag == "hr":
                self._flush()
            return
        inline = tag in INLINE
        if not inline:
            self._flush()
            while (top := self.stack[-1])[3] or tag in ENDED_BY.get(top[0], ()):
                if top[3] and not any(tag in ENDED_BY.get(t, ()) for t in ENDED_BY if self.open[t]):
                    break
                self._pop()
        attrs = dict(attrs)
        _, above, skipped, _ = self.stack[-1]
        classes = _DIGITS.sub("N", " ".join(sorted((attrs.get("class") or "").lower().split())))
        self.parent.append(above)
        self.tag.append(tag)
        self.article.append(len(self.parent) - 1 if tag in ("article", "main") else self.article[above])
        self.path.append(self.path[above] if inline else xxhash.xxh3_128_hexdigest(f"{self.path[above]}/{tag}.{classes}"))
        seems, sure = self._seems_beside(tag, attrs)
        self.beside.append(len(self.parent) - 1 if seems else self.beside[above])
        if sure:
            self.sure.add(len(self.parent) - 1)
        self.stack.append((tag, len(self.parent) - 1, skipped or tag in SKIPPED, inline))
        self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.open["p"]:
            self._flush()
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.buffer.append((self.stack[-1][1], data, self.open["a"] > 0))

    def scores(self) -> dict[int, float]:
        """Containers by the prose in them, where text in links counts against it.

        A block counts in full for the container around it, for each one further out by ``OUTER`` of the
        one before, and somewhat more than in full for the nearest article or main element.
        """
        out: Counter = Counter()
        for element, text, linked in self.blocks:
            worth, share, article = len(text) - 2 * linked, 1.0, self.article[element]
            if article >= 0:
                out[article] += 1.2 * worth
            at = self.parent[element] if self.parent[element] >= 0 else element
            while at >= 0 and share > 0.05:
                if at != article:
                    out[at] += share * worth
                at, share = self.parent[at], share * OUTER
        return out

    def own(self) -> int:
        """The page's own container; -1 on a page without text.

        That with the best score, or the smallest around it that holds nearly all of the page's prose,
        and its headings as far as something smaller than the body does. An article or main element is
        not widened, and what lies in one is widened to it at most.
        """
        scores = self.scores()
        if not scores:
            return -1
        at = max(scores, key=lambda e: (scores[e], -e))
        if self.article[at] >= 0:
            return self.article[at]
        within, headings, total = Counter(), Counter(), 0
        for element, text, linked in self.blocks:
            worth, heading = max(0, len(text) - 2 * linked), self.tag[element] in ("h1", "h2")
            total += worth
            while element >= 0:
                within[element] += worth
                headings[element] += heading
                element = self.parent[element]
        around = [at]
        while self.parent[around[-1]] >= 0:
            around.append(self.parent[around[-1]])
        first = next(i for i, e in enumerate(around) if within[e] >= NEARLY * total)
        smaller = [e for e in around[first:] if self.tag[e] not in ("", "html", "body")]
        return max(smaller, key=lambda e: (headings[e], e)) if smaller else around[first]

    def inside(self, container: Callable[[int], bool]) -> list[bool]:
        """For each element whether it lies inside one that ``container`` accepts."""
        inside = [False] * len(self.parent)
        for e in range(len(self.parent)):  # parents come first
            inside[e] = container(e) or (self.parent[e] >= 0 and inside[self.parent[e]])
        return inside

    def text(self, inside: list[bool]) -> str:
        return " ".join(text for element, text, _ in self.blocks if inside[element])

    def share(self, inside: list[bool]) -> float:
        """The part of the page's text that lies inside."""
        return sum(len(text) for element, text, _ in self.blocks if inside[element]) / max(1, sum(len(text) for _, text, _ in self.blocks))


def page_votes(html: str) -> list[tuple[str, float]]:
    """The page's vote: the path of its own container with share 1; none without text."""
    page = Page(html)
    own = page.own()
    return [(page.path[own], 1.0)] if own >= 0 else []


def page_text(html: str, paths: list[str] | None) -> str:
    """The text in the containers of one of ``paths``, or in the page's own.

    The first path with half of the page's text counts, otherwise that with most of it. If this is but
    little, the page is of another kind, and its own container counts.
    """
    page, best, most = Page(html), None, LITTLE
    have = set(page.path) if paths else ()
    for path in paths or []:
        if path in have:
            inside = page.inside(lambda e, path=path: page.path[e] == path)
            share = page.share(inside)
            if share >= most:
                best, most = inside, share
            if share >= HALF:
                break
    if best is not None:
        return page.text(best)
    own = page.own()
    return page.text(page.inside(lambda e: e == own)) if own >= 0 else ""


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes = [next((path for path, _ in page_votes(html)), None) for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(votes, pa.string())], ["host", "path"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [page_text(html, paths) for html, paths in zip(batch.column("html").to_pylist(), batch.column("winners").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("url"), pa.array(texts, pa.string())], ["k", "url", "text"])


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row (host, winners) per host: the paths of its pages' own containers, the commonest first.

    Every page with text has one vote. A path needs ``SHARE`` of the host's votes, so there are few; the
    commonest path always counts. Ties go to the greater digest.
    """
    host = host_and_path(F.col(url))[0]
    votes = pages.where(F.col(html).isNotNull()).select(host.alias("host"), F.col(html).alias("html"))
    votes = votes.mapInArrow(_votes, "host string, path string").where(F.col("path").isNotNull())
    paths = stored(votes.groupBy("host", "path").agg(F.count("*").alias("votes")), "path-votes")
    hosts = paths.groupBy("host").agg(F.sum("votes").alias("all"), F.max(F.struct("votes", "path"))["path"].alias("top"))
    paths = paths.join(hosts, "host").where((F.col("votes") >= F.col("all") * SHARE) | (F.col("path") == F.col("top")))
    return paths.groupBy("host").agg(F.reverse(F.array_sort(F.collect_list(F.struct("votes", "path"))))["path"].alias("winners"))


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``key``, ``url``, text, n_chars (code points).

    Each page's containers are scored by the prose in them, without blocks in menus, page headers,
    footers, sidebars, notices, adverts, forms, scripts, styles and comments, which are told by element,
    role, or the first or last part of a class or id. An element told so that holds the article or most
    of the page's prose, such as a form or layout around the whole page, is not left out. Pages vote for the
    generalised tag-class path of their own container (``Page.own``); all paths with a share of a host's
    votes are the host's, one for each of its templates, and the text of every page is taken again from
    its containers on one of them (``page_text``). A page that these paths hold little of uses its own.
    Character references are decoded, white space in a block becomes one space, and blocks are joined by
    one space in page order.

    Null or empty HTML gives an empty text. Pages with a null URL, or without ``://``, vote as one host.
    Repeated rows give repeated results, an empty table gives no rows. A page of any length is parsed
    whole, in one task. Only the three columns named are read; others, of whatever name, do not matter.
    Votes are combined before the shuffle, one row per host and path, so a crowded host is no crowded task.
    """
    # stored, so that Spark knows their size: few hosts are broadcast, and the pages stay where they are
    winners = stored(host_paths(pages, url, html).withColumnRenamed("host", "w_host"), "host-paths")
    host = host_and_path(F.col("url"))[0]
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.join(winners, host == F.col("w_host"), "left").select("k", "url", "html", "winners")
    k_type = rows.schema["k"].dataType.simpleString()
    texts = rows.mapInArrow(_texts, f"k {k_type}, url string, text string")
    return texts.select(F.col("k").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
