"""Main text of web pages by consensus paths of their hosts.

Every page is parsed into containers (article, main, section, div, table cell, body) and text blocks.
A container's score is the text of its own blocks, less what stands in links, plus nine tenths of its
children's, weighted by what its tag and class say. Each page votes for the generalised tag-class path
of its best container; Spark counts the votes per host, and the path with most votes (then the higher
score, then the smaller path) is the host's. Pages are then extracted again: all containers on the
host's path, or the page's own best container where the path isn't there.

Left out wherever they stand: menus, page headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments of readers and hidden elements, known by tag, role, class and id. Classes and ids are judged
by whole names and the parts between their hyphens: one says what an element is by its last part, or by its first if
the rest names a mere frame (ad-box); has-sidebar and the like describe a layout and say nothing. A main element
is read whatever the names around it; so is an article where a page would have no text otherwise.

Defined results: null and empty html give an empty text; unclosed and misnested tags are closed as
browsers do; what the page's end leaves open (a tag, a comment, a script) reaches to the end and is left out, but a quoted
value without an end is read as one without quotes; broken declarations are comments up to the next ">"; every sign of a page is looked at a fixed number of times, so the
work is linear whatever it holds; a null url is a host of its own; repeated rows are extracted alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import collections
import functools
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockbook.llm.common import settle, table

# Names in HTML and in common page designs.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("nav footer aside form script style noscript template iframe svg canvas object button select textarea dialog menu head title".split())
CONTAINERS = frozenset("body article main section div td".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table thead tbody tr th caption figure figcaption address details summary header hr html center fieldset hgroup nav aside footer form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
BAD_PARTS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar side aside rail cookie cookies consent gdpr notice banner alert popup modal overlay "
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion comment comments commentlist disqus replies respond share sharing social related recommended "
    "newsletter subscribe signup login search pagination pager widget widgets".split()
)
READERS = frozenset("comment comments commentlist disqus replies respond".split())
LAYOUT = frozenset("has have no not with without is hide show".split())
OWN = frozenset("article entry post story content".split())
FRAME = frozenset(
    "area bar bars block blocks bottom box boxes btn btns button buttons col column container content feed fixed form global group holder icon icons inner item items left links list lists main mobile "
    "outer page panel posts primary right row secondary section site slot sticky strip top unit wrap wrapper".split()
)
GOOD_NAMES = re.compile(r"(?<![a-z])(?:article|content|post|entry|story|main|body|text)(?![a-z])")
WEIGHTS = {"article": 1.5, "main": 1.3, "body": 0.8}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
DEPTH = 8


# Marks of a page. Each alternative reads on to the page's end if its own end is missing, and nothing is read twice; only the
# last quote of a page can be one without an end.
_VALUE = r"""\s*=\s*(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_NAME = r"""[^\s/>][^\s/=>]*+"""
MARK = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?:(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+|[^a-zA-Z>][^>]*+)?(?:>|\Z)"""
    rf"""|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[\s/]++|{_NAME}(?:{_VALUE})?+)*+)(?P<close>>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(rf"""[\s/]++|(?P<name>{_NAME})(?P<value>{_VALUE})?+""")
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in ("script", "style")}


@functools.lru_cache(1 << 16)
def bad_name(name: str, bad: frozenset = BAD_PARTS) -> bool:
    """Whether a class or id names something that isn't part of an article."""
    parts = [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if x]
    if not parts or not LAYOUT.isdisjoint(parts) or (parts[-1] == "header" and parts[0] in OWN):
        return False
    return parts[-1] in bad or (parts[0] in bad and all(x in FRAME or x in bad for x in parts[1:]))


class Page:
    """Blocks (container number, text, characters in links) and containers (parent, path, weight).

    lenient: an article is read whatever the names of the elements around it.
    """

    def __init__(self, lenient: bool = False) -> None:
        self.lenient = lenient
        self.open: list[tuple[str, int, int]] = []  # tag, left out (1: by names, 2: for good), container
        self.at: dict[str, list[int]] = collections.defaultdict(list)  # places of open elements by tag
        self.solid: list[int] = []  # places of open blocks and of elements left out
        self.containers: list[tuple[int, str, float]] = [(-1, "", 0.7)]
        self.blocks: list[tuple[int, str, int]] = []
        self.text: list[str] = []
        self.links = 0

    def feed(self, html: str) -> None:
        """Read a whole page."""
        at = 0
        while mark := MARK.search(html, at):
            if mark.start() > at:
                self.handle_data(unescape(html[at : mark.start()]))
            at = mark.end()
            if mark["end"]:
                if mark[0].endswith(">"):
                    self.handle_endtag(mark["end"].lower())
            elif mark["start"] and mark["close"]:
                tag, values, last = mark["start"].lower(), {}, ""
                for a in ATTRIBUTE.finditer(mark["attributes"]):
                    last = a[0]
                    if a["name"]:
                        last, value = "", (a["value"] or "").lstrip().removeprefix("=").lstrip()
                        quoted = len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]
                        values[a["name"].lower()] = unescape(value[1:-1] if quoted else value)
                if last.endswith("/"):
                    self.handle_startendtag(tag, values)
                else:
                    self.handle_starttag(tag, values)
                    if tag in RAW:
                        end = RAW[tag].search(html, at)
                        at = end.start() if end else len(html)
        if at < len(html):
            self.handle_data(unescape(html[at:]))

    def state(self) -> tuple[int, int]:
        return self.open[-1][1:] if self.open else (0, 0)

    def end_block(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((self.state()[1], text, self.links))
            self.text, self.links = [], 0

    def left_out(self, tag: str, values: dict, names: list[str], out: int) -> int:
        """2 where tag, role or style say so, 1 where only names do."""
        if out == 2 or tag in ("html", "body"):
            return out
        inner = tag == "header" and (self.at["article"] or self.at["main"])
        hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
        if tag in LEFT_OUT or (tag == "header" and not inner) or hidden or values.get("role", "").lower() in ROLES:
            return 2
        if tag == "main" or (self.lenient and tag == "article"):
            return 0
        return 1 if out or any(bad_name(x, READERS if tag == "article" else BAD_PARTS) for x in names) else 0

    def handle_starttag(self, tag: str, values: dict[str, str]) -> None:
        if tag in BLOCKS:
            self.end_block()
            self.pop_to(("p",), None)
            if tag in CLOSES:
                self.pop_to(CLOSES[tag], STOPS[tag])
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        out, at = self.state()
        names = f"{values.get('class', '')} {values.get('id', '')}".split()
        out = self.left_out(tag, values, names, out)
        if tag in CONTAINERS and not out:
            first = re.sub(r"\d+", "#", names[0].lower()) if names else ""
            label = f"{tag}.{first}" if first else tag
            path = ">".join([*self.containers[at][1].split(">"), label][-DEPTH:])
            weight = WEIGHTS.get(tag, 1.0) * (1.25 if GOOD_NAMES.search(" ".join(names).lower()) else 1.0)
            self.containers.append((at, path, weight))
            at = len(self.containers) - 1
        self.at[tag].append(len(self.open))
        if tag in BLOCKS or tag in LEFT_OUT:
            self.solid.append(len(self.open))
        self.open.append((tag, out, at))

    def handle_startendtag(self, tag: str, values: dict[str, str]) -> None:
        self.handle_starttag(tag, values)
        if tag not in VOID and tag not in ("p", "div"):
            self.handle_endtag(tag)

    def pop_to(self, tags, stops) -> None:
        """Close the innermost element of these tags, unless one of stops (None: any block) lies between."""
        place = max((self.at[t][-1] for t in tags if self.at[t]), default=-1)
        stop = max((self.at[t][-1] for t in stops if self.at[t]), default=-1) if stops is not None else self.solid[-1] if self.solid else -1
        if stop > place:
            return
        while 0 <= place < len(self.open):
            self.at[self.open.pop()[0]].pop()
            if self.solid and self.solid[-1] == len(self.open):
                self.solid.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_block()
        self.pop_to((tag,), () if tag in BLOCKS or tag in LEFT_OUT else None)

    def handle_data(self, data: str) -> None:
        if not self.state()[0]:
            self.text.append(data)
            if self.at["a"]:
                self.links += len(data)

    def scores(self) -> list[float]:
        own = [0.0] * len(self.containers)
        for at, text, links in self.blocks:
            own[at] += len(text) - 2 * min(links, len(text))
        for i in range(len(own) - 1, 0, -1):  # children come after their parents
            own[self.containers[i][0]] += 0.9 * own[i]
        return [x * c[2] for x, c in zip(own, self.containers, strict=True)]

    def best(self) -> tuple[int, float]:
        scores = self.scores()
        i = max(range(len(scores)), key=lambda k: (scores[k], -k))
        return i, scores[i]

    def under(self, chosen: set[int]) -> str:
        inside = [False] * len(self.containers)
        for i, (parent, _, _) in enumerate(self.containers):
            inside[i] = i in chosen or (parent >= 0 and inside[parent])
        return " ".join(text for at, text, _ in self.blocks if inside[at])


def parsed(html: str | None) -> Page:
    for lenient in (False, True):
        page = Page(lenient)
        page.feed(html or "")
        page.end_block()
        if page.blocks:
            break
    return page


def extract(html: str | None, path: str | None) -> str:
    page = parsed(html)
    chosen = {i for i, c in enumerate(page.containers) if i and c[1] == path}
    return page.under(chosen) if chosen else page.under({page.best()[0]})


def votes(batches):
    for batch in batches:
        paths, scores = [], []
        for html in batch.column("html"):
            page = parsed(html.as_py())
            i, score = page.best()
            paths.append(page.containers[i][1] if score > 0 else None)
            scores.append(round(score))
        yield pa.record_batch([batch.column("host"), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], names=["host", "path", "score"])


def texts(batches):
    for batch in batches:
        found = [extract(h.as_py(), p.as_py()) for h, p in zip(batch.column("html"), batch.column("path"), strict=True)]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), batch.column("path"), pa.array(found, pa.string())], names=["page_id", "url", "path", "text"])


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """host and the path that most of its pages vote for."""
    cast = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(votes, "host string, path string, score long")
    counted = cast.where("path is not null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.desc("total"), "path")
    return counted.withColumn("place", F.row_number().over(order)).where("place = 1").select("host", "path")


def main_text(pages: DataFrame, broadcast_hosts: int = 20_000) -> DataFrame:
    """page_id, url, path, text for every row of pages (page_id, url, html).

    The hosts' paths are broadcast only when counted to be few; else it is a join on the host.
    """
    won = settle(host_paths(pages))
    won = F.broadcast(won) if won.count() <= broadcast_hosts else won
    own = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    return own.join(won, "host", "left").select("page_id", "url", "html", "path").mapInArrow(texts, "page_id long, url string, path string, text string")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
