"""Main-text extraction from web pages: parser events, text-to-tag ratios, smoothing, threshold clustering.

The standard library's parser streams events over the page; block-level tags end a line, a line being a block of text
with the tags it has. Each line's ratio of text to tags (link text aside) is smoothed with a Gaussian over its
neighbours, lines of boilerplate counting nothing; lines above the threshold (a share of the ratios' deviation) are content,
and they form clusters. A page without any such line has no text. A line belongs to the main text if it

- is content, by the smoothed ratio and by its own;
- stands between two content lines of one cluster: lines of the same innermost container, or with no boilerplate between;
- is anywhere in an ``article`` or ``main`` with content, or directly in a container of whose own lines content has ``hold`` of the text;
- is a heading right before such a line, or the first-level heading of a text that has none.

Boilerplate is what stands in elements with telling names (menus, headers and footers of the page, asides, forms, scripts,
hidden parts, and elements whose role, class or id says advert, notice, comments, sharing or the like). A form that holds an
article, or all of the page's text, is none.

White space inside a line becomes one space; lines are joined by two line feeds in page order. Null, empty and text-free
pages give an empty text. Malformed markup (bogus declarations, unclosed or stray tags) is read as browsers do, roughly, in time
linear in the page. Repeated rows give repeated results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINER = frozenset("article main section div body td html center table".split())
#: Elements whose text is never main text.
DROP = frozenset("script style noscript template nav aside form head title button select option textarea input iframe object svg canvas audio video dialog menu label".split())
RAW = frozenset("script style".split())
#: Header and footer belong to the page unless they stand inside an article.
OUTER = frozenset("header footer".split())
#: Tags that a new tag of the same kind closes, up to the given container.
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "p": ()}
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "option", "optgroup", "legend", "summary", "figcaption", "title"}
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|sidebar|side|widget|menu|nav\w*|breadcrumbs?|pagination|pager|toolbar|topbar|footer|masthead|site-?header|page-?header|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommend\w*|more-stories|outbrain|taboola|skip-?link|toc|hidden|visually-hidden|sr-only)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Noise that an article inside does not clear, and names that only say what a page also has.
FIRM = re.compile(r"comment|repl(?:y|ies)|respond|related|recommend|sidebar(?!.*(?:layout|page|wrap))", re.I)
ALSO = re.compile(r"(?<![\w-])(?:has|with|without|no|is)[-_][\w-]+", re.I)
SPACE = re.compile(r"\s+")
COMMENT_END = re.compile(r"--\s*>")


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters of link text
    container: int  # number of the innermost one, or -1
    noise: int  # number of the boilerplate element it stands in, or 0
    heading: int  # level, or 0


class Noise(NamedTuple):
    """A boilerplate element."""

    up: int  # the one it stands in
    soft: bool  # an article inside clears it
    form: bool


class Lines(HTMLParser):
    """Lines of a page, its containers and its boilerplate elements. Each event takes constant time, but for what it closes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # tag, innermost container's number, number of the noise it stands in
        self.places: dict[str, list[int]] = {}  # of each tag in the stack
        self.containers: list[int] = []  # places of containers in the stack, and of blocks
        self.blocks: list[int] = []
        self.noise = [Noise(0, True, False)]
        self.cleared = [True]
        self.out: list[Line] = []
        self.kinds: list[tuple[str, int]] = []  # of the containers: tag, number of the one it stands in
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.looked, self.last_end = "", -1

    def last(self, tag: str) -> int:
        held = self.places.get(tag)
        return held[-1] if held else -1

    def close_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            _, container, noise = self.stack[-1] if self.stack else ("", -1, 0)
            heading = max((int(h[1]) for h in HEADINGS if self.places.get(h)), default=0)
            self.out.append(Line(text, self.tags, self.linked, container, noise, heading))
        self.parts, self.tags, self.linked = [], 0, 0

    def pop_to(self, k: int) -> None:
        for tag, _, _ in self.stack[k:]:
            self.places[tag].pop()
        del self.stack[k:]
        for held in (self.containers, self.blocks):
            while held and held[-1] >= k:
                held.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.close_line()
            if tag in CLOSES_P:
                self.end("p", ("table", "td", "th", "button", "article", "section", "div", "li"))
            if tag in SAME and tag != "p":
                self.end(tag, SAME[tag])
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        _, container, up = self.stack[-1] if self.stack else ("", -1, 0)
        firm = tag in DROP or (tag in OUTER and self.last("article") < 0 and self.last("main") < 0)
        soft = False
        form = tag == "form" and firm
        if attrs and not firm and tag not in ("html", "body"):
            a = {k: v or "" for k, v in attrs}
            said = ALSO.sub(" ", f"{a.get('class', '')} {a.get('id', '')}")
            firm = "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in ROLES or "display:none" in a.get("style", "").replace(" ", "").lower()
            if tag not in ("article", "main", "p", "h1", "h2", "h3") or "comment" in said.lower():
                named = bool(NOISE.search(said))
                firm, soft = firm or (named and bool(FIRM.search(said))), named
        if tag in ("article", "main") and not firm and not soft:
            k = up
            while self.noise[k].soft and not self.cleared[k]:
                self.cleared[k] = True  # what was named like boilerplate holds the article
                k = self.noise[k].up
        if firm or soft:
            self.noise.append(Noise(up, not firm or form, form))
            self.cleared.append(False)
            up = len(self.noise) - 1
        place = len(self.stack)
        if tag in CONTAINER:
            self.kinds.append((tag, container))
            container = len(self.kinds) - 1
            self.containers.append(place)
        if tag in BLOCK:
            self.blocks.append(place)
        self.places.setdefault(tag, []).append(place)
        self.stack.append((tag, container, up))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def end(self, tag: str, stop: tuple[str, ...]) -> None:
        k = self.last(tag)
        if k >= 0 and k > max(map(self.last, stop), default=-1):
            self.close_line()
            self.pop_to(k)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.close_line()
        k = self.last(tag)
        if k < 0 or (tag not in CONTAINER and self.containers and self.containers[-1] > k):
            return
        if tag in BLOCK or not self.blocks or self.blocks[-1] < k:
            self.pop_to(k)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] in RAW:
            return
        self.parts.append(data)
        if self.places.get("a"):
            self.linked += len(data)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment that nothing ends goes up to the next tag's end."""
        if self.looked is not self.rawdata:
            self.looked, self.last_end = self.rawdata, max((m.start() for m in COMMENT_END.finditer(self.rawdata)), default=-1)
        return super().parse_comment(i, report) if i + 4 <= self.last_end else self.parse_bogus_comment(i, report)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections are comments in HTML, whatever they hold."""
        return self.parse_bogus_comment(i, report)

    def lines(self) -> list[tuple[Line, bool]]:
        """The page's lines, and whether each is boilerplate."""
        for whole_form in (False, True):
            clear = [True]
            for n, own in zip(self.noise[1:], self.cleared[1:], strict=True):
                clear.append(clear[n.up] and (own or (whole_form and n.form)))
            if any(clear[x.noise] for x in self.out):
                break
        return [(x, not clear[x.noise]) for x in self.out]


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return np.convolve(np.pad(x, reach, mode="edge"), kernel, "valid") if len(x) else x


def extract(html: str | None, sigma: float = 1.0, threshold: float = 0.5, hold: float = 0.5) -> str:
    """The page's main text."""
    if not html:
        return ""
    p = Lines()
    end = html.rfind(">") + 1  # what comes after it is no markup
    p.feed(html[:end])
    p.close()
    p.handle_data(unescape(html[end:]))
    p.close_line()
    found = p.lines()
    lines = [x for x, noise in found if not noise]
    if not lines:
        return ""
    # ratios over the lines that are no boilerplate; in the smoothing boilerplate counts as a line of nothing
    plain = np.array([not noise for _, noise in found])
    every = np.array([0.0 if noise else max(0, len(x.text) - x.linked) / max(1, x.tags) for x, noise in found])
    ratio, level = every[plain], smooth(every, sigma)[plain]
    cut = threshold * min(ratio.std(), ratio.mean())
    content = (level >= cut) & (ratio >= cut) if cut > 0 else np.ones(len(lines), bool)
    if not content.any():
        return ""
    # text that stands directly in each container, and of its content; the last place is for none
    weight = np.array([len(x.text) - min(x.linked, len(x.text) - 1) for x in lines])
    of = np.array([x.container for x in lines])
    mass, inside = (np.bincount(of + 1, w, len(p.kinds) + 1) for w in (weight, weight * content))
    full = np.roll((inside > 0) & (inside >= hold * mass), -1)
    some = np.roll(inside > 0, -1)
    for n in range(len(p.kinds) - 1, -1, -1):  # containers are numbered in page order: inner ones come later
        some[p.kinds[n][1]] |= some[n]
    marked = [False] * (len(p.kinds) + 1)  # in an article or main with content
    for n, (tag, up) in enumerate(p.kinds):
        marked[n] = bool(some[n] and tag in ("article", "main")) or marked[up]
    kept = [bool(c or full[x.container] or marked[x.container]) for x, c in zip(lines, content, strict=True)]
    # between two content lines of a cluster
    group = np.cumsum(~plain)[plain]  # lines with boilerplate between them have other numbers
    seen: dict[int, int] = {}
    last = -1
    for k, (x, c) in enumerate(zip(lines, content, strict=True)):
        if c:
            start = max(seen.get(x.container, -1), last if last >= 0 and group[last] == group[k] else -1)
            if start >= 0:
                kept[start:k] = [True] * (k - start)
            seen[x.container] = last = k
    for k in range(len(lines) - 2, -1, -1):  # headings right before
        kept[k] = kept[k] or (lines[k].heading > 0 and kept[k + 1])
    if not any(i and x.heading == 1 for i, x in zip(kept, lines, strict=True)):
        top = next((k for k, x in enumerate(lines) if x.heading == 1), None)
        if top is not None:
            kept[top] = True
    return "\n\n".join(x.text for x, i in zip(lines, kept, strict=True) if i)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0, threshold: float = 0.5, hold: float = 0.5) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars."""

    def make():
        def fn(htmls):
            texts = [extract(h, sigma, threshold, hold) for h in htmls]
            return [texts, [len(t) for t in texts]]

        return fn

    return map_rows(pages, [F.col(id_col), F.col(url_col), F.col(html_col)], make, "text string, n_chars long", 2)


def op5_main_text(spark, sf_dir: str) -> DataFrame:
    return extract_pages(texts(spark, sf_dir, "pages"))
