"""Main text of web pages by text-to-tag ratios.

The page goes through the standard library's parser piece by piece. Its events build
lines: the text between two tags that break a block, with its characters in and outside
links, its tags and the element it stands in. Nothing else of the page is kept.

A line's ratio is its characters outside links per tag. The ratios are smoothed with a
Gaussian over the lines before and after. Lines that pass a threshold (a share of the
spread) smoothed, that by themselves are no far shorter than most of these, and that are not mostly links, are the cores of
the content. Cores with no lists of links between them form a region, as do all cores of
an article (or main element). A region stays where it is not small beside the largest,
has the title, or goes on in the same element as the largest.

Cores decide where a region begins and ends. Inside, all lines stay, but for links outside
paragraphs. Beyond its first and last core, low lines stay where they are paragraphs, items or headings
of the element around the region and its title; in an article, where they are not mostly
links. Everything between regions goes.

Menus, footers, forms' fields and the like go by their tag or role before that. Names
(class and id), forms and headers decide only about elements that hold neither the page's
only title nor most of its text, and a name only if it says nothing else.

Each element is numbered at its start and end, so what is inside what takes one comparison;
work is in proportion to the page, however deep its elements are nested.

Defined results: a null or empty page has no text, and so has one without lines outside
such elements. A page without cores gives all lines that are not mostly links, or else all. Unclosed and
misplaced tags are closed as browsers do. Repeated rows get a row each. Other columns are
not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows

FEED_CHARS = 65_536
SIGMA, REACH = 1.0, 3
#: A core's smoothed ratio, in standard deviations of all, and its own ratio, as a share of the median of lines so high.
SPREAD_SHARE, CORE_SHARE = 0.25, 1 / 3
#: A region of less than this share of the largest one's characters is another story's.
MINOR = 0.1
#: So many links in lines of links part two regions.
PARTING_LINKS = 2

#: Elements by their place in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td template
tfoot th thead title tr ul""".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCKS - frozenset("body caption dd dt head html legend li optgroup option tbody td template tfoot th thead title tr".split()) | {"li", "dd", "dt"}
#: What a start tag ends of its own kind, up to the element that may hold it.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
ASIDE_TAGS = frozenset("""script style noscript template iframe object svg canvas audio video head title nav footer aside button select textarea
input fieldset dialog menu datalist search""".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist".split())
ASIDE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense banner billboard breadcrumb breadcrumbs comment comments commentlist
consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices overlay
pagination pager paywall popup promo promos promotion promoted recommended recommendations related respond share sharing sidebar sidebars signin
signup skip social sponsor sponsored sponsors subscribe subscription tagcloud teaser teasers toast toolbar topbar tracking widget widgets discussion replies reply""".split())
#: Words that may stand beside those without saying more.
PLAIN_WORDS = frozenset("""area articles bar block bottom box button buttons cell col column container content form group header inner item items left links list main outer
page panel popular post posts right row section site slot small top unit up wrap wrapper""".split())
#: Comments may well be longer than what they are about.
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
#: What names, forms and headers set aside is no furniture where it is more than such a share of the page's text.
MOST, MOST_COMMENTS = 0.5, 0.9
#: First words of names that say what a page has or lacks.
ABOUT = frozenset("has no with without non is".split())
#: A header holds the title when it stands in an article; elsewhere it is the site's.
HEADERS = frozenset("header".split())
WHOLE = frozenset("html body main".split())
#: Blocks that are one piece of a text.
PIECES = frozenset("p li td th tr dd dt blockquote pre figcaption caption h1 h2 h3 h4 h5 h6".split())
#: Of these, the ones that menus are not made of.
PROSE = PIECES - {"li", "dd", "dt"}

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"(display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


def _set_aside(tag: str, attrs: dict[str, str | None]) -> bool:
    if tag in ASIDE_TAGS:
        return True
    if tag in WHOLE:
        return False
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or _HIDDEN.search(attrs.get("style") or ""):
        return True
    if (attrs.get("role") or "").strip().lower() in ASIDE_ROLES:
        return True
    return False


def _doubtful(tag: str, attrs: dict[str, str | None], in_article: bool) -> str:
    """Why an element may be page furniture, to be held against the whole page: "tag", "name", "comments" or "".

    ``has-sidebar``, ``no-comments`` and the like name the rest of the page. Names say nothing of an article, and
    ``related-work`` or ``social-impact`` nothing of furniture: all words of a name must.
    """
    if tag in WHOLE:
        return ""
    if tag == "form" or (attrs.get("role") or "").strip().lower() == "form" or (tag in HEADERS and not in_article):
        return "tag"
    if tag == "article":
        return ""
    found, plain = "", frozenset() if tag in PIECES else PLAIN_WORDS
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = [w for w in (w.lower() for w in _NAME.findall(name)) if not w.isdigit()]
        if not words or words[0] in ABOUT or any(w not in ASIDE_WORDS and w not in plain for w in words):
            continue
        if not COMMENT_WORDS.isdisjoint(words):
            return "comments"
        if not ASIDE_WORDS.isdisjoint(words) or ("header" in words and not in_article):
            found = "name"
    return found


class _Element:
    """An open or closed element; ``first`` and ``last`` number the elements inside it, itself included."""

    __slots__ = ("tag", "above", "first", "last", "aside", "doubt", "doubtful", "block", "article", "main", "linked", "title", "mass", "kept", "gone", "anchored")

    def __init__(self, tag: str, above: _Element | None, number: int, aside: bool, doubt: str = ""):
        self.tag, self.above, self.first, self.doubt = tag, above, number, doubt
        self.last: float = float("inf")
        self.aside = aside or (above is not None and above.aside)
        #: The nearest doubtful element and the nearest block from here upwards.
        self.doubtful: _Element | None = self if doubt else above.doubtful if above is not None else None
        self.block: _Element = self if above is None or tag in BLOCKS else above.block
        #: The outermost article and main element.
        self.article: _Element | None = (above and above.article) or (self if tag == "article" else None)
        self.main: _Element | None = (above and above.main) or (self if tag == "main" else None)
        self.linked: bool = tag == "a" or (above is not None and above.linked)
        self.title: bool = tag == "h1" or (above is not None and above.title)
        self.mass, self.kept, self.gone, self.anchored = 0, False, False, False

    @property
    def holder(self) -> _Element | None:
        return self.article or self.main

    def holds(self, other: _Element) -> bool:
        return self.first <= other.first <= self.last


class _Line(NamedTuple):
    parts: list[tuple[str, _Element]]
    tags: int
    at: _Element


class Lines(HTMLParser):
    """Collects the lines of a page and the elements in doubt."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.titles: list[_Element] = []
        self.articles: list[_Element] = []
        self.doubted: list[_Element] = []
        self.elements = 0
        self.top = self.open = _Element("", None, 0, False)
        #: Open elements by tag, innermost last.
        self.by_tag: dict[str, list[_Element]] = defaultdict(list)
        self.lines: list[_Line] = []
        self.parts: list[tuple[str, _Element]] = []
        self.seen = self.tags = 0
        self.at = self.top

    def flush(self) -> None:
        if self.parts or self.seen or self.tags:
            self.lines.append(_Line(self.parts, self.tags, self.at))
        self.parts, self.seen, self.tags, self.at = [], 0, 0, self.open.block

    def innermost(self, tags: Iterable[str]) -> _Element:
        return max((self.by_tag[t][-1] for t in tags if self.by_tag.get(t)), key=lambda e: e.first, default=self.top)

    def close(self, *elements: _Element) -> None:
        """Close open elements and all that is open inside them; without any, end the page."""
        if not elements:
            super().close()
        for element in elements:
            while self.open.first >= element.first:
                self.open.last = self.elements
                self.by_tag[self.open.tag].pop()
                self.open = self.open.above

    def close_to(self, tags: set[str] | frozenset[str], holders: set[str] | frozenset[str] = frozenset()) -> None:
        """Close the nearest open element among ``tags``, unless one of ``holders`` is nearer."""
        found = self.innermost(tags)
        if found.above is not None and found.first > self.innermost(holders).first:
            self.close(found)

    def handle_starttag(self, tag, attrs):
        breaks = tag in BLOCKS
        if breaks:
            self.flush()
            if tag in ENDS_P:
                self.close_to({"p"}, {"button", "table", "td", "th", "article", "section", "div", "li", "blockquote", "body", "main", "aside", "form"})
            if tag in SIBLINGS:
                own, holders = SIBLINGS[tag]
                for _ in own:
                    self.close_to(own, holders)
        self.tags += 1
        if tag == "br":
            self.parts.append((" ", self.open))
        if tag not in VOID:
            self.elements += 1
            given = dict(attrs)
            in_article = self.open.holder is not None
            self.open = _Element(tag, self.open, self.elements, _set_aside(tag, given), _doubtful(tag, given, in_article))
            self.by_tag[tag].append(self.open)
            if not self.open.aside:
                if tag in ("h1", "article", "main"):
                    (self.titles if tag == "h1" else self.articles).append(self.open)
                if self.open.doubt:
                    self.doubted.append(self.open)
        if breaks:
            self.at = self.open.block

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        at = self.by_tag[tag][-1] if self.by_tag.get(tag) else None
        # An inline end tag closes nothing beyond its block.
        if at is not None and (tag in BLOCKS or self.open.block.first < at.first):
            self.close(at)
        if tag in BLOCKS:
            self.at = self.open.block

    def handle_data(self, data):
        if self.open.tag in ("script", "style"):
            return
        self.seen += len(data)
        if not self.open.aside:
            self.parts.append((data, self.open))

    def judge(self) -> None:
        """Mark the doubtful elements that are furniture as gone: not those around the only title, an article's form, or most of the page's text.

        Beside an article with the title, an element is furniture whatever its size. Outer elements stand before inner ones in ``doubted``.
        """
        own: dict[int, int] = defaultdict(int)
        total = 0
        for line in self.lines:
            for text, at in line.parts:
                size = len("".join(text.split()))
                total += size
                if at.doubtful is not None:
                    own[at.doubtful.first] += size
        for element in reversed(self.doubted):
            element.mass += own[element.first]
            outer = element.above.doubtful
            if outer is not None:
                outer.mass += element.mass
        _mark(self.articles, lambda e: e.tag == "form")
        if all(title.doubtful is not None for title in self.titles):
            _mark(self.titles, lambda e: True)
        for title in self.titles:
            if title.doubtful is None and title.holder is not None:
                title.holder.anchored = True
        anchored = any(a.anchored for a in self.articles)
        judged = [e for e in self.doubted if e.mass and (not anchored or any(h is not None and h.anchored for h in (e.above.article, e.above.main)))]
        for element in judged:
            element.kept |= element.mass > (MOST_COMMENTS if element.doubt == "comments" else MOST) * total
        # Many small elements of such names may be most of the text together.
        for doubts, most in ((("tag", "name"), MOST), (("tag", "name", "comments"), MOST_COMMENTS)):
            hidden: set[int] = set()
            among = {e.first for e in judged if e.doubt in doubts and not e.kept}
            for element in self.doubted:
                outer = element.above.doubtful
                if element.first in among or (outer is not None and outer.first in hidden):
                    hidden.add(element.first)
            if sum(own[n] for n in hidden) > most * total:
                for element in judged:
                    element.kept |= element.doubt in doubts and element.doubt != "tag"
        for element in self.doubted:
            outer = element.above.doubtful
            element.gone = not element.kept or (outer is not None and outer.gone)


def _mark(inner: list[_Element], which: Callable[[_Element], bool]) -> None:
    """Keep the doubtful elements around ``inner`` that ``which`` accepts; each element is visited once."""
    seen: set[int] = set()
    for element in inner:
        at = element.doubtful
        while at is not None and at.first not in seen:
            seen.add(at.first)
            at.kept |= which(at)
            at = at.above.doubtful if at.above is not None else None


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, reach: int = REACH) -> np.ndarray:
    steps = np.arange(-reach, reach + 1)
    kernel = np.exp(-steps ** 2 / (2 * sigma ** 2))
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


class _Read(NamedTuple):
    text: str
    plain: int
    linked: int
    links: int
    tags: int
    at: _Element

    @property
    def linky(self) -> bool:
        return self.linked > self.plain


def _read(line: _Line) -> _Read:
    """A line without what is gone."""
    shown = [(text, at) for text, at in line.parts if at.doubtful is None or not at.doubtful.gone]
    linked = [(len("".join(text.split())), at) for text, at in shown if at.linked]
    text = " ".join("".join(text for text, _ in shown).split())
    inside = sum(n for n, _ in linked)
    return _Read(text, len(text) - text.count(" ") - inside, inside, len({at.first for n, at in linked if n}), line.tags, line.at)


def main_text(html: str | None) -> str:
    """Blocks of the main text, one a line."""
    if not html:
        return ""
    parser = Lines()
    for start in range(0, len(html), FEED_CHARS):
        parser.feed(html[start:start + FEED_CHARS])
    parser.close()
    parser.flush()
    parser.judge()
    read = [_read(line) for line in parser.lines]
    own = np.array([line.plain / max(line.tags, 1) for line in read], np.float64)
    if not len(own):
        return ""
    ratios = smoothed(own)
    high = (ratios >= SPREAD_SHARE * ratios.std()) & (own > 0)
    high &= own >= CORE_SHARE * (np.median(own[high]) if high.any() else 0)
    pairs = [(line, bool(up)) for line, up in zip(read, high) if line.text]
    lines, cores = [line for line, _ in pairs], [i for i, (line, up) in enumerate(pairs) if up and not line.linky]
    if not cores:
        return "\n".join([line.text for line in lines if not line.linky] or [line.text for line in lines])
    kept: set[int] = set()
    for region in _chosen(_regions(lines, cores), lines):
        kept |= _grown(region, lines)
    return "\n".join(lines[i].text for i in sorted(kept))


def _regions(lines: list[_Read], cores: list[int]) -> list[list[int]]:
    """Cores by article or main element; elsewhere, runs of them that no list of links parts."""
    held: dict[int, list[int]] = {}
    runs: list[list[int]] = []
    links = np.concatenate(([0], np.cumsum([line.links if line.linky else 0 for line in lines])))
    for i in cores:
        holder = lines[i].at.holder
        if holder is not None:
            held.setdefault(holder.first, []).append(i)
        elif runs and links[i] - links[runs[-1][-1]] < PARTING_LINKS:
            runs[-1].append(i)
        else:
            runs.append([i])
    return sorted([*held.values(), *runs])


def _chosen(regions: list[list[int]], lines: list[_Read]) -> list[list[int]]:
    mass = [sum(lines[i].plain for i in region) for region in regions]
    largest = regions[mass.index(max(mass))]
    places = {lines[i].at.above.first for i in largest if lines[i].at.above is not None}
    return [region for region, size in zip(regions, mass) if size >= MINOR * max(mass)
            or any(lines[i].at.title or (lines[i].at.above is not None and lines[i].at.above.first in places) for i in region)]


def _grown(region: list[int], lines: list[_Read]) -> set[int]:
    """The region's lines: from its first core to its last, and what belongs to it before and after."""
    first, last = region[0], region[-1]
    holder = lines[first].at.holder
    # The title stands before the region, with no other text of length between.
    title = first
    while title > 0 and not lines[title].at.title and not lines[title - 1].linky and lines[title - 1].at.holder in (holder, None):
        title -= 1
    if not lines[title].at.title:
        title = first
    kept = {title}
    if holder is not None:
        kept |= set(range(first, last + 1))
        for steps in (range(first - 1, -1, -1), range(last + 1, len(lines))):
            for i in steps:
                if not holder.holds(lines[i].at):
                    break
                if not lines[i].linky:
                    kept.add(i)
        return kept
    kept |= {i for i in range(title, last + 1) if lines[i].at.holder is None and (not lines[i].linky or lines[i].at.tag in PROSE)}
    places = [lines[i].at for i in (title, *region)]
    around, low, top = places[0], min(e.first for e in places), max(e.first for e in places)
    while around.above is not None and (around.tag in PIECES or not around.first <= low <= top <= around.last):
        around = around.above
    for steps in (range(title - 1, -1, -1), range(last + 1, len(lines))):
        for i in steps:
            line = lines[i]
            if line.linky or line.at.tag not in PIECES or line.at.holder is not None or not around.holds(line.at):
                break
            kept.add(i)
    return kept


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """Per row of ``pages``: the keys, text and n_chars."""
    named = [f"k{i}" for i in range(len(keys))]
    fields = "".join(f"{n} {pages.schema[k].dataType.simpleString()}, " for k, n in zip(keys, named))

    def run(part: Iterator[tuple]) -> Iterator[tuple]:
        for *key, page in part:
            text = main_text(page)
            yield *key, text, len(text)

    done = map_rows(pages.select(*(F.col(k).alias(n) for k, n in zip(keys, named)), F.col(html).alias("html")), run, fields + "text string, n_chars bigint")
    return done.select(*(F.col(n).alias(k) for k, n in zip(keys, named)), "text", "n_chars")
