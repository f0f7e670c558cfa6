"""Main text of web pages from streaming parser events and smoothed text-to-tag ratios."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "page_id long, url string, text string, n_chars long, n_regions int"

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Their text is never shown as text of the page.
SILENT = frozenset("head title script style noscript template iframe object embed svg math canvas audio video textarea select option datalist button map applet noframes".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class or id that name what surrounds an article.
HINT = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|sidebar\w*|side-?bar|footer|header|masthead|banner|ads?|advert\w*|adsense|promo\w*|sponsor\w*|cookie\w*|consent|gdpr|notice\w*|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|comment\w*|respond|replies|reply|disqus|related|recommend\w*|breadcrumb\w*|pagination|pager|widget\w*|login|signup|toolbar|skip)(?=$|[\s_-])",
    re.I,
)
COMMENT = re.compile(r"(?:^|[\s_-])comment", re.I)
#: In these a hint counts only as a whole name: a paragraph's class may well speak of its subject.
PARAGRAPHS = frozenset("p li dt dd td th blockquote pre figcaption caption h1 h2 h3 h4 h5 h6".split())
#: What may follow a hinting word in a name that still means a part of the page, as in comment-list; last words count by themselves.
PARTS = frozenset(
    "area article articles author bar block body bottom box button buttons column container content count date entries form group holder icon icons inner item items left link links list main meta module outer panel popular post posts recent region right row section side slot stories thread title top unit wrap wrapper".split()
)
#: Elements of a head; any other one begins the body.
IN_HEAD = frozenset("html head title base link meta style script noscript template".split())
KEEP_ANYWAY = frozenset("html body article main".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: An end tag of these closes open paragraphs and list items only up to the container that holds them.
CLOSES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

#: Elements that may be the article; others, as lists, tables and quotations, are parts of one. The last hold every page whole.
CONTAINERS = frozenset("#page html body article main div section center".split())
WHOLE = frozenset("#page html body".split())
#: Width of the Gaussian, in lines, and the threshold as a share of the mean smoothed ratio.
SIGMA, SHARE = 1.0, 2 / 3


def _plain_hint(name: str) -> bool:
    """Whether a class or id names a part of the page, as ``site-header`` or ``ad-slot-2``, and not a subject, as ``ad-hoc``."""
    words = re.split(r"[_-]+", name.strip("_-"))
    hints = [i for i, w in enumerate(words) if HINT.fullmatch(w)]
    return bool(hints) and all(w.lower() in PARTS or w.isdigit() or HINT.fullmatch(w) for w in words[hints[-1] + 1 :])


class _Lines(HTMLParser):
    """Collects lines of text from parser events: a line ends where a block starts or ends.

    ``lines`` has (text, ratio, container, hard, hint): characters outside links for each tag met since the line
    before, the number of the element that holds it, whether that is boilerplate by its element or role, and the
    number of the nearest element around it whose class or id hints at boilerplate (0: none). ``hints`` has, for
    each such element, the next one around it, and whether its name is plain. ``parents`` and ``names`` describe elements
    by number; 0 is the page. Time is linear in the page: a tag that isn't open isn't looked for.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, float, int, bool, int]] = []
        self.hints: dict[int, tuple[int, bool]] = {}
        self.open: Counter = Counter()
        self.names, self.parents = ["#page"], [0]
        self.stack: list[tuple[str, int, bool, int, bool]] = [("#page", 0, False, 0, False)]
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.in_link = False
        self.silent: list[str] = []

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                _, number, hard, hint, _ = self.stack[-1]
                self.lines.append((text, max(0, len(text) - self.linked) / max(1, self.tags), number, hard, hint))
                self.tags = 0
            self.parts.clear()
            self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if self.silent and self.silent[0] == "head" and (tag == "body" or len(self.silent) == 1 and tag not in IN_HEAD):
            self.silent.clear()
        if self.silent:
            if tag in SILENT and tag not in VOID:
                self.silent.append(tag)
            return
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in SILENT:
            if tag not in VOID:
                self.silent.append(tag)
            return
        if tag == "a":
            self.in_link = True
        if tag not in BLOCKS:
            return
        self.flush()
        if tag in VOID:
            return
        self._close_implied(tag)
        _, parent, hard, hint, in_header = self.stack[-1]
        number = len(self.names)
        self.names.append(tag)
        self.parents.append(parent)
        if tag == "header":
            # The header of an article may hold its headline; a page's own header is boilerplate.
            in_header, hard = True, True
        elif in_header and tag in HEADINGS and (self.open["article"] or self.open["main"]):
            hard = any(self.open[x] for x in BOILERPLATE)
        hard = hard or tag in BOILERPLATE
        if attrs:
            a = dict(attrs)
            if (a.get("role") or "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style") or ""):
                hard = True
            marks = f"{a.get('class') or ''} {a.get('id') or ''}"
            if tag in PARAGRAPHS:
                named = any(HINT.fullmatch(x) for x in marks.split())
            else:
                named = HINT.search(marks) if tag not in KEEP_ANYWAY else tag == "article" and COMMENT.search(marks)
            if named:
                plain = tag in PARAGRAPHS or tag == "article" or any(_plain_hint(x) for x in marks.split())
                self.hints[number], hint = (hint, plain), number
        self.stack.append((tag, number, hard, hint, in_header))
        self.open[tag] += 1

    def _cut(self, at: int) -> None:
        self.open.subtract(s[0] for s in self.stack[at:])
        del self.stack[at:]

    def _close_implied(self, tag: str) -> None:
        if self.stack[-1][0] == "p" or self.stack[-1][0] in HEADINGS and tag in HEADINGS:
            self._cut(len(self.stack) - 1)
        if tag in CLOSES:
            group = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            for i in range(len(self.stack) - 1, 0, -1) if any(self.open[x] for x in group) else ():
                if self.stack[i][0] in CLOSES[tag]:
                    break
                if self.stack[i][0] in group:
                    self._cut(i)
                    break

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in SILENT:
            self.handle_starttag(tag, attrs)
        else:
            self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
            elif tag in ("body", "html"):
                self.silent.clear()
            return
        if tag == "a":
            self.in_link = False
        if tag not in BLOCKS or tag in VOID:
            return
        self.flush()
        if tag in ("body", "html") or not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self._cut(i)
                break
            if tag == "p" and self.stack[i][0] not in HEADINGS:
                break

    def handle_data(self, data: str) -> None:
        if len(self.silent) == 1 and self.silent[0] == "head" and data.strip():
            self.silent.clear()
        if not self.silent:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data.strip())


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; weights that reach past an end are left out and the rest scaled up."""
    radius = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel, "full")[radius : radius + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def _parse(html: str) -> _Lines:
    for text in (html, html.replace("<![", "&lt;![")):
        parser = _Lines()
        try:
            parser.feed(text)
            parser.close()
            parser.flush()
            return parser
        except AssertionError:  # what the parser raises for marked sections it doesn't know
            continue
    parser = _Lines()
    parser.handle_data(re.sub(r"<[^>]*>", " ", html))
    parser.flush()
    return parser


def extract(html: str | None) -> tuple[str, int]:
    """The main text of a page, and the number of content regions that its text-to-tag ratios show.

    Every line has a ratio: the root of its characters outside links for each tag, and 0 in boilerplate, by
    element, role or hint. Ratios are smoothed over neighbouring lines; runs of lines over the threshold (two thirds of the
    mean) are the content regions, in which short lines among long ones stay and stray ones far from them don't.
    The only article or main element is the article if it holds most of the regions' text, of that beside it without
    hinted elements. Else the regions' lines name the smallest generic container that holds them, or the article or
    main element around it. If paragraphs of regions stand in that container itself, and it isn't the whole page, all
    its lines outside boilerplate are the text. Else the text is what lies between the first and the last line of
    regions, and the rest of their own containers. An element whose class or id names a part around an article (as
    comment-list or ad) goes unless it holds most of the text; in one whose name only holds such a word (as ad-hoc
    or comment-on-method) ratios are halved, and its lines stay if they belong to regions nevertheless.
    """
    if not html:
        return "", 0
    page = _parse(html)
    total = sum(len(x[0]) for x in page.lines if not x[3])
    hinted = dict.fromkeys(page.hints, 0)
    for text, _, _, hard, hint in page.lines:
        if hint and not hard:
            hinted[hint] += len(text)
    for hint in reversed(page.hints):  # they are numbered where they start, so those within one come after it
        if page.hints[hint][0]:
            hinted[page.hints[hint][0]] += hinted[hint]
    out, doubted = {0: False}, {0: False}
    for hint, (around, plain) in page.hints.items():
        little = 2 * hinted[hint] <= total
        out[hint], doubted[hint] = out[around] or plain and little, doubted[around] or not plain and little
    open_lines = [not x[3] and not out[x[4]] for x in page.lines]
    if not any(open_lines):
        return "", 0
    # Boilerplate takes part with a ratio of 0, so it parts regions, and never belongs to one.
    # A name that only holds a hint halves the ratio.
    raw = np.array([(0.5 if doubted[x[4]] else 1.0) * x[1] ** 0.5 if ok else 0.0 for x, ok in zip(page.lines, open_lines, strict=True)])
    ratios = smooth(raw)
    threshold = ratios.mean() * SHARE
    inside = (ratios >= threshold) & open_lines
    regions = int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))
    # Elements are numbered where they start, so those within one follow it, up to its last.
    last = list(range(len(page.names)))
    for n in range(len(last) - 1, 0, -1):
        last[page.parents[n]] = max(last[page.parents[n]], last[n])
    in_article, in_heading, own = [False] * len(last), [False] * len(last), [0] * len(last)
    for n in range(1, len(last)):
        parent = page.parents[n]
        in_article[n] = in_article[parent] or page.names[parent] in ("article", "main")
        in_heading[n] = in_heading[parent] or page.names[n] in HEADINGS
        own[n] = n if page.names[n] in CONTAINERS else own[parent]
    rows = [(i, x[2], len(x[0]) if inside[i] else 0, x[4]) for i, x in enumerate(page.lines) if open_lines[i]]
    # What names the container: a region's lines, but for those that only their neighbours lift.
    core = {i for i, at, size, _ in rows if size and (1.5 * raw[i] >= threshold or in_heading[at])}
    articles = [n for n, name in enumerate(page.names) if name in ("article", "main") and not in_article[n]]
    articles = [n for n in articles if any(n <= at <= last[n] for _, at, _, _ in rows)] if articles else []
    one = articles[0] if len(articles) == 1 else -1
    within = sum(size for _, at, size, _ in rows if one >= 0 and one <= at <= last[one])
    beside = sum(size for _, at, size, hints in rows if not hints and not (one >= 0 and one <= at <= last[one]))
    if one >= 0 and within > beside:
        chosen = one
    elif core:
        needed = [at for i, at, _, _ in rows if i in core]
        chosen, furthest = own[min(needed)], max(needed)
        while last[chosen] < furthest:
            chosen = own[page.parents[chosen]]
        chosen = next((p for p in (chosen, *_above(page, chosen)) if page.names[p] in ("article", "main")), chosen)
    else:
        chosen = 0
    rows = [r for r in rows if chosen <= r[1] <= last[chosen]]
    direct = any(i in core and own[at] == chosen for i, at, _, _ in rows)
    if core and page.names[chosen] not in ("article", "main") and (page.names[chosen] in WHOLE or not direct):
        # The lines decide: the container holds other things than the article too.
        next_below = {chosen: chosen}
        for n in range(chosen + 1, last[chosen] + 1):
            if own[n] == n:
                around = own[page.parents[n]]
                next_below[n] = n if around == chosen else next_below[around]
        below = {at: next_below[own[at]] for _, at, _, _ in rows}
        held = {below[at] for i, at, _, _ in rows if i in core} - {chosen}
        edges = [i for i, at, size, _ in rows if size and (below[at] in held or own[at] == chosen)]
        rows = [r for r in rows if edges[0] <= r[0] <= edges[-1] or below[r[1]] in held]
    # Regions decide about lines whose element's name holds a hint.
    return "\n".join(page.lines[r[0]][0] for r in rows if inside[r[0]] or not doubted[r[3]]), regions


def _above(page: _Lines, number: int) -> list[int]:
    out = []
    while number:
        number = page.parents[number]
        out.append(number)
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [extract(x.as_py()) for x in batch.column(2)]
        texts = pa.array([t for t, _ in made], pa.string())
        sizes, regions = pa.array([len(t) for t, _ in made], pa.int64()), pa.array([r for _, r in made], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, sizes, regions], ["page_id", "url", "text", "n_chars", "n_regions"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_regions for each row of ``pages`` (page_id, url, html).

    Null or empty html, and pages without text outside boilerplate, give an empty text. Rows are independent, so
    nothing is shuffled; repeated rows and ids give a row each, other columns are not read, and broken markup is
    read as far as the parser follows it.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_run, SCHEMA)
