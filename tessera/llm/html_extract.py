"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clusters."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches

# Names of HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "tfoot thead tr ul caption title".split()
)
SKIPPED = frozenset(
    "head nav footer aside form script style noscript template menu dialog select button textarea iframe object svg canvas "
    "audio video math datalist".split()
)
CONTENT = frozenset({"article", "main"})
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
SKIPPED_NAMES = frozenset(
    "ad ads adbox advert advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice alert popup "
    "modal overlay newsletter subscribe subscription sidebar widget related recommended share sharing social breadcrumb "
    "breadcrumbs teaser teasers menu nav navbar navigation topbar footer comment comments reply replies disqus login signup search pagination "
    "pager toolbar skip".split()
)
#: Parts of names that say it wherever they stand.
SKIPPED_STEMS = re.compile("advert|adsense|adsbygoogle|cookie|sidebar|newsletter|breadcrumb|sponsor|navbar|footer|commentlist|comment-|notification|disclaimer")
HEADER_NAMES = frozenset("header masthead".split())
#: First words of names that tell a layout, not a role (has-sidebar); last words of those that enclose, and words that say content is enclosed.
MODIFIERS = frozenset("has no not with without".split())
WRAPS, WRAPPED = frozenset("wrap wrapper container inner outer".split()), frozenset("content main article post page site body".split())
#: Names that are still skipped where all others would leave too little: comments alone may be much longer than the text.
COMMENT_NAMES = frozenset("comment comments commentlist reply replies disqus".split())
#: The share of a page's text that skipping by names must leave.
NAMES_SHARE = 0.1
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())

#: Half width and spread of the Gaussian kernel, in lines.
RADIUS, SIGMA = 2, 1.0
#: The share of clustered text that a container must hold to be the content region, and that article and main elements must hold together.
REGION_SHARE, HINT_SHARE = 0.8, 0.5
#: An article with less than this share of the clustered text of the page's largest is a teaser.
TEASER_SHARE = 0.25

_KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
_NAME = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: What an element that is skipped by its names counts; far more than elements can be open.
NAMED = 1 << 40


class _Line:
    __slots__ = ("parts", "tags", "link", "box", "text")

    def __init__(self, box: int):
        self.parts: list[str] = []
        self.tags, self.link, self.box, self.text = 1, 0, box, ""


def _named(tag: str, value: str, names: int, inside: bool) -> bool:
    """Whether a class or id says furniture. ``names`` is 2 for all names, 1 for those of comments, 0 for none."""
    for token in value.split():
        parts = _NAME.findall(_CAMEL.sub(" ", token).lower())
        if len(parts) > 1 and (parts[0] in MODIFIERS or parts[-1] in WRAPS and not WRAPPED.isdisjoint(parts)):
            continue
        if names < 2:
            if names and not COMMENT_NAMES.isdisjoint(parts):
                return True
        elif tag == "article" and not inside:  # tags of a post (tag-social) are names too; only its very role counts
            if token.lower() in SKIPPED_NAMES or token.lower().startswith("comment-"):
                return True
        elif not SKIPPED_NAMES.isdisjoint(parts) or SKIPPED_STEMS.search(token.lower()) or not inside and not HEADER_NAMES.isdisjoint(parts):
            return True
    return False


class _Events(HTMLParser):
    """Turns parser events into lines, one for each block of the page, and notes which container holds each.

    Containers are numbered from 1 in the order of their start tags; ``parent`` has the number of the one around each. The places of open
    elements are kept by name, so that no event costs more the deeper it lies.
    """

    def __init__(self, names: int = 2) -> None:
        super().__init__(convert_charrefs=True)
        self.names = names
        self.open: list[tuple[str, int, int]] = []  # name, container's number, skipped: 1 by its element, NAMED by its names
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.skipping: list[int] = []
        self.parent, self.kinds = [0], [""]
        self.skips = self.links = self.articles = self.box = self.lost = 0
        self.lines: list[_Line] = []
        self.line: _Line | None = None

    def _push(self, name: str, skipped: int) -> None:
        number, at = 0, len(self.open)
        if name in BLOCK and name != "p":
            number = len(self.parent)
            self.parent.append(self.box)
            self.kinds.append(name)
            self.box = number
        self.places.setdefault(name, []).append(at)
        if name in BLOCK:
            self.blocks.append(at)
        if skipped:
            self.skipping.append(at)
        self.skips += skipped
        self.links += name == "a"
        self.articles += name in CONTENT
        self.open.append((name, number, skipped))

    def _pop_to(self, index: int) -> None:
        while len(self.open) > index:
            name, number, skipped = self.open.pop()
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()
            if skipped:
                self.skipping.pop()
            self.skips -= skipped
            if number:
                self.box = self.parent[number]
            self.links -= name == "a"
            self.articles -= name in CONTENT

    def _last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def _find(self, name: str, until: frozenset[str] | set[str] = frozenset()) -> int:
        at = self._last(name)
        return -1 if any(self._last(x) > at for x in until) else at

    def _skips(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in SKIPPED or tag == "header" and not self.articles:
            return 1
        named = 0
        for key, value in attrs:
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return 1
            if key == "style" and value and re.search(r"display\s*:\s*none", value):
                return 1
            if key == "role" and value in SKIPPED_ROLES:
                return 1
            if key in ("class", "id") and value and tag not in ("html", "body", "main") and _named(tag, value, self.names, self.articles > 0):
                named = NAMED
        return named

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.line = None
            if (i := self._find("p", {"article", "section", "div", "td", "body"})) >= 0:
                self._pop_to(i)  # a block ends an open paragraph
            if tag in CLOSED_BY_SAME and (i := self._find(tag, CLOSED_BY_SAME[tag])) >= 0:
                self._pop_to(i)
            if tag == "body" and (i := self._find("head")) >= 0:
                self._pop_to(i)
            if tag in CONTENT and self.skips and not self.articles:  # a container that was never closed
                self._pop_to(self.skipping[0])
        elif self.line is not None:
            self.line.tags += 1
            if tag in ("br", "td", "th"):
                self.line.parts.append(" ")
        if tag in VOID:
            return
        skipped = self._skips(tag, attrs) if attrs or tag in SKIPPED or tag == "header" else 0
        self._push(tag, skipped)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.line = None
        if (i := self._find(tag)) >= 0:
            if tag not in BLOCK and tag not in SKIPPED and self.blocks and self.blocks[-1] > i:
                return  # an inline end tag closes no block
            self._pop_to(i)

    def handle_data(self, data: str) -> None:
        if self.skips:
            if not self.skips % NAMED:
                self.lost += len(data.strip())
            return
        if self.line is None:
            if not data.strip():
                return
            self.line = _Line(self.box)
            self.lines.append(self.line)
        self.line.parts.append(data)
        if self.links:
            self.line.link += len(data.strip())


def _smoothed(ratios: list[float]) -> list[float]:
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for d in range(-RADIUS, RADIUS + 1):
            if 0 <= i + d < len(ratios):
                total += _KERNEL[d + RADIUS] * ratios[i + d]
                weight += _KERNEL[d + RADIUS]
        out.append(total / weight)
    return out


def _lines(html: str) -> tuple[_Events, list[_Line]]:
    """The page's lines outside furniture. Where skipping by names leaves under NAMES_SHARE of the text that other rules leave, only
    names of comments are skipped, and where that leaves nothing, no names."""
    for names in (2, 1, 0):
        events = _Events(names)
        events.feed(html)
        events.close()
        for x in events.lines:
            x.text = " ".join("".join(x.parts).split())
        lines = [x for x in events.lines if x.text]
        left = sum(len(x.text) for x in lines)
        if not events.lost or left >= NAMES_SHARE * (left + events.lost) or names < 2 and lines:
            break
    return events, lines


def _clusters(lines: list[_Line]) -> list[bool]:
    """Which lines are in content clusters: those whose smoothed text-to-tag ratio reaches the standard deviation of the ratios, or their mean
    where that is lower. Text in links is no text; lines of links alone are never content."""
    ratios = [max(0, len(x.text) - x.link) / x.tags for x in lines]
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    cutoff = min(spread, mean)
    found = [r >= cutoff and own > 0 for r, own in zip(_smoothed(ratios), ratios, strict=True)]
    return found if any(found) else [True] * len(lines)


def _held(events: _Events, lines: list[_Line], clustered: list[bool]) -> list[int]:
    """The characters of clustered lines within each container."""
    held = [0] * len(events.parent)
    for x, is_in in zip(lines, clustered, strict=True):
        held[x.box] += len(x.text) * is_in
    for n in range(len(held) - 1, 0, -1):  # a container's number is above its parent's
        held[events.parent[n]] += held[n]
    return held


def _within(events: _Events, region: set[int]) -> list[bool]:
    inside = [False] * len(events.parent)
    for n in range(1, len(inside)):
        inside[n] = n in region or inside[events.parent[n]]
    return inside


def main_text(html: str | None) -> str:
    """The main text of one page; an empty or null page, or one without content, gives an empty text.

    Lines are the page's blocks outside menus, forms, notices and the like. Those with a high smoothed text-to-tag ratio form the content
    clusters, and the clusters decide on the region. Articles with little of the clustered text beside a much larger one are
    teasers and go. The region is then the outermost article and main elements, if they hold half of the clustered text; else the innermost
    container that holds nearly all of it; else the span from the first clustered line to the last. Every block of the
    region is returned, short ones too, but where the region is no article or main element, lines out of the clusters that are mostly
    links are menus.
    """
    if not html:
        return ""
    events, lines = _lines(html)
    if not lines:
        return ""
    clustered = _clusters(lines)
    held = _held(events, lines, clustered)
    articles = [n for n, kind in enumerate(events.kinds) if kind == "article"]
    inner = _within(events, set(articles))
    mains = _within(events, {n for n, kind in enumerate(events.kinds) if kind == "main"})
    beside = sum(len(x.text) for x, c in zip(lines, clustered, strict=True) if c and mains[x.box] and not inner[x.box])
    largest = max([beside, *(held[n] for n in articles)])
    major = _within(events, {n for n in articles if held[n] >= TEASER_SHARE * largest})
    teasers = {n for n in articles if held[n] < TEASER_SHARE * largest and not major[n]}
    if teasers:
        outside = _within(events, teasers)
        clustered = [c for x, c in zip(lines, clustered, strict=True) if not outside[x.box]]
        lines = [x for x in lines if not outside[x.box]]
        held = _held(events, lines, clustered)
    total = held[0]
    content = [n for n, kind in enumerate(events.kinds) if kind in CONTENT and n not in teasers]
    content = _within(events, set(content))
    if sum(len(x.text) for x, c in zip(lines, clustered, strict=True) if c and content[x.box]) >= HINT_SHARE * total:
        return "\n".join(x.text for x in lines if content[x.box])
    able = [n for n, chars in enumerate(held) if n and chars >= REGION_SHARE * total and events.kinds[n] not in ("html", "body")]
    inside = _within(events, {max(able)}) if able else None
    first, last = clustered.index(True), len(clustered) - 1 - clustered[::-1].index(True)
    kept = (inside[x.box] if inside else first <= i <= last for i, x in enumerate(lines))
    return "\n".join(x.text for x, c, k in zip(lines, clustered, kept, strict=True) if k and (c or 2 * x.link <= len(x.text)))


def extract_main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep`` with ``text`` and ``n_chars`` (its code points) for every row of ``pages``.

    Rows are independent: repeated rows give repeated results, null ids stay null, other columns are not read, and an
    empty table gives an empty result. A column of ``keep`` may not be named text or n_chars.
    """
    if {"text", "n_chars"} & set(keep):
        raise ValueError("keep may not hold text or n_chars")
    small_batches(pages.sparkSession)
    rows = pages.select(*keep, F.col(html).cast("string").alias("_html"))
    kept = rows.drop("_html").schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string", "n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "text", "n_chars"])

    return rows.mapInArrow(run, schema)
