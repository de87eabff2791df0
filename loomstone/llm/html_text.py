"""Main text of web pages by line-block distribution.

Markup is stripped, block elements and line breaks ending a line; menus, headers, footers, asides, forms, scripts,
styles and hidden elements count as markup, and so do elements whose class, id or role names notices, adverts, comments
and the like as a whole (``site-footer``, but not ``no-sidebar``). A named element or form that holds nearly all text of a
page, with a heading, article or paragraphs in it, is taken for a wrapper and stays; reader comments never do. An element left open by mistake ends
where an article begins.

The lengths of the remaining lines are summed over windows of ``WINDOW`` lines, characters in links counting against them. Text is a run
of lines whose sums stay above a dive point and somewhere surge above a higher one; both are relative to
the sums of the page itself. Lines within a window of the text may join it, but not short ones of bare containers at its edges
(menu entries); paragraphs, headings and list entries without links between two runs belong to both. Where a page marks its article, lines inside weigh ``RAISE`` times as much,
links included, and an article that surges is kept with all its lines; the sums decide on every page.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks

WINDOW = 3
# Part of the geometric mean of a page's highest and median block that text must reach somewhere, part of the
# median block it may fall to, and how much more a line inside an article weighs.
SURGE = 2
DIVE = 64
RAISE = 8
# Part of a page's text that a named element must exceed to be taken for a wrapper, and paragraphs it must hold.
MOST = 0.75
PARAGRAPHS = 3

# Elements that are never article text, elements whose content is not markup,
# elements without content, elements that end a line.
DROPPED = frozenset(
    "aside button canvas datalist dialog embed footer form frameset header iframe map menu nav noscript object select svg template head".split()
)
RAW = frozenset("script style textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
ARTICLE = frozenset(("article", "main"))
# Elements allowed in a head, headings, elements that hold prose, elements whose end tag may be left out
# with the starts that end them and the elements these do not reach out of.
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p li dd dt pre blockquote td th caption figcaption".split())
ENDS_P = BLOCKS - frozenset("br caption legend optgroup option tbody td tfoot th thead title tr".split())
IMPLIED = {
    **dict.fromkeys(ENDS_P, (frozenset(("p",)), frozenset("button td th caption table".split()))),
    "li": (frozenset(("p", "li")), frozenset("ol ul menu table".split())),
    "dd": (frozenset("p dd dt".split()), frozenset(("dl", "table"))),
    "dt": (frozenset("p dd dt".split()), frozenset(("dl", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "td": (frozenset("p td th".split()), frozenset(("tr", "table"))),
    "th": (frozenset("p td th".split()), frozenset(("tr", "table"))),
    "tr": (frozenset("p td th tr".split()), frozenset(("table",))),
}
# Words in class, id and role that mark what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies respond share sharing "
    "social related recommended newsletter subscribe subscription signup login search widget pagination pager toolbar copyright disclaimer skip contentinfo complementary dialog".split()
)

# Words that may stand beside these in a name, and those of reader comments.
NEUTRAL_WORDS = frozenset(
    "area bar bottom box block container content global inner left list main module nested outer page panel primary right secondary section site small the top web widgets wrap wrapper".split()
)
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())

# Quotes matter after an equals sign only; all quantifiers are possessive, so a tag is read once.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_ANCHOR = re.compile(r"\s+(?:name|id)\s*=(?!.*\bhref\b)", re.I | re.S)
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"']++)))?+")

PLAIN, NAMED, COMMENTS, FIXED = range(4)


def _kind(attributes: str) -> int:
    """What the attributes say: nothing, named like something beside the article, like reader comments, or hidden."""
    kind = PLAIN
    if not _TELLING.search(attributes):
        return kind
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return FIXED
        if name in ("class", "id", "role"):
            for token in value.split():
                words = set(re.split(r"[_\-]+", token)) - {""}
                found = words & ASIDE_WORDS
                if found and words <= ASIDE_WORDS | NEUTRAL_WORDS:
                    kind = max(kind, COMMENTS if found & COMMENT_WORDS else NAMED)
    return kind


class _Part:
    """An element that decides what its text is: an article, or something beside it."""

    __slots__ = ("parent", "kind", "article", "may_stay", "unclosed", "late", "chars", "in_article", "paragraphs", "heading", "dropped", "holds", "number")

    def __init__(self, parent, kind, article=False, may_stay=False, late=False):
        self.parent, self.kind, self.article, self.may_stay, self.late = parent, kind, article, may_stay, late
        self.unclosed, self.heading, self.chars, self.in_article, self.paragraphs = True, False, 0, 0, 0
        self.dropped = self.holds = False
        self.number = 0


class Line(NamedTuple):
    text: str
    linked: int  # characters inside links
    article: int  # number of the article it lies in, 0 outside
    prose: bool  # in a paragraph, heading, list entry or cell, not a bare container


def _decide(parts: list[_Part]) -> None:
    """Set ``dropped`` and ``number`` of every part; ``parts`` holds parents before children, the page first."""
    for part in reversed(parts[1:]):
        if part.article:  # text beside the article is counted where it stands
            up = part.parent
            up.chars += part.chars
            up.in_article += part.chars
            up.paragraphs += part.paragraphs
            up.heading |= part.heading
    page = parts[0]
    for number, part in enumerate(parts[1:], 1):
        up = part.parent
        if part.article:
            part.dropped = part.holds = up.holds
            part.number = 0 if part.dropped else up.number or number
            continue
        wraps = part.may_stay and part.chars > MOST * (part.chars + page.chars) and (
            part.in_article > 0 or part.heading or part.paragraphs >= PARAGRAPHS
        )
        # An article ends what was left open before it, but comments after the article stay comments.
        opened = part.unclosed and not (part.kind == COMMENTS and part.late)
        part.dropped = up.dropped or not wraps or 2 * part.in_article > part.chars
        part.holds = up.holds or not (wraps or opened)
        part.number = 0 if part.dropped else up.number


def lines(page: str) -> list[Line]:
    """Text lines of a page without what its markup sets apart from the article. The page is read once, forwards."""
    root = _Part(None, PLAIN)
    parts, here = [root], root
    open_elements: list[tuple[str, _Part]] = []  # block elements and telling ones: name, part around
    count: dict[str, int] = {}
    rows: list[tuple[list, bool]] = []
    pieces: list[tuple[str, bool, _Part]] = []
    link = 0  # depth at which a link was opened, plus one
    seen_article = False

    def end_line() -> None:
        if pieces:
            rows.append((pieces.copy(), bool(open_elements) and open_elements[-1][0] in PROSE))
            pieces.clear()

    def add(text: str) -> None:
        if text:
            text = html.unescape(text)
            pieces.append((text, link > 0, here))
            here.chars += len(text) - text.count(" ") if not text.isspace() else 0

    def leave(explicit: bool = False) -> None:
        nonlocal here, link
        name, around = open_elements.pop()
        count[name] -= 1
        if explicit:
            while here is not around:
                here.unclosed = False
                here = here.parent
        here = around
        if link > len(open_elements):
            link = 0

    size, at = len(page), 0
    last_end, tag_pattern = page.rfind(">"), _TAG
    while at < size:
        start = _START.search(page, at)
        if start is None or start.start() > last_end:
            # What follows the last ">" is text, unless a comment is left open.
            cut = page.find("<!--", at)
            add(page[at : cut if cut >= 0 else size])
            break
        begin = start.start()
        add(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        if page[begin + 1] in "!?":
            at = page.find(">", begin) + 1
            continue
        m = tag_pattern.match(page, begin)
        if m is None:  # a quote hides every ">" that follows: from here on quotes are not trusted
            tag_pattern = _PLAIN_TAG
            m = tag_pattern.match(page, begin)
        at = m.end()
        tag, attributes = m[2].lower(), m[3]
        if tag in BLOCKS:
            end_line()
        if m[1]:
            if tag == "a":
                link = 0
            elif count.get(tag):
                while open_elements[-1][0] != tag:
                    leave()
                leave(explicit=True)
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?![a-z0-9])", re.I).search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else size
            continue
        if tag in VOID:
            continue
        if count.get("head") and tag not in IN_HEAD and tag != "head" and open_elements[-1][0] == "head":
            leave()
        ended, stops = IMPLIED.get(tag, ((), ()))
        if ended and any(count.get(name) for name in ended):
            depth = len(open_elements) - 1
            reach = -1
            while depth >= 0 and open_elements[depth][0] not in stops:
                name = open_elements[depth][0]
                if name in ended:
                    reach = depth
                elif name in BLOCKS:
                    break
                depth -= 1
            while reach >= 0 and len(open_elements) > reach:
                leave(explicit=True)
        if tag == "a":
            link = 0 if _ANCHOR.match(attributes) else len(open_elements) + 1
            continue
        if tag in ("html", "body") or attributes.endswith("/"):
            continue
        kind = FIXED if tag in DROPPED else _kind(attributes) if attributes and tag != "main" else PLAIN
        if kind == PLAIN and tag not in BLOCKS and not count.get(tag):
            continue
        open_elements.append((tag, here))
        count[tag] = count.get(tag, 0) + 1
        if tag == "p":
            here.paragraphs += 1
        elif tag == "h1":
            here.heading = True
        if kind != PLAIN:
            may_stay = kind == NAMED or tag == "form" or tag in ARTICLE and kind == FIXED
            here = _Part(here, kind, may_stay=may_stay, late=seen_article)
            parts.append(here)
        if tag in ARTICLE:
            seen_article |= here.kind == PLAIN
            here = _Part(here, PLAIN, article=True)
            parts.append(here)
    end_line()
    _decide(parts)
    out: list[Line] = []
    for row, prose in rows:
        kept = [(text, linked, part) for text, linked, part in row if not part.dropped]
        text = " ".join("".join(t for t, *_ in kept).split())
        if text:
            out.append(Line(text, sum(len(t) for t, linked, _ in kept if linked), kept[0][2].number, prose))
    return out


def _median(values: list[int]) -> float:
    values, n = sorted(values), len(values)
    return (values[(n - 1) // 2] + values[n // 2]) / 2


def weights(found: list[Line]) -> list[int]:
    """Characters of each line: ``RAISE`` times inside an article, elsewhere less twice those in links (may be negative)."""
    return [RAISE * len(line.text) if line.article else len(line.text) - 2 * line.linked for line in found]


def main_text(page: str | None, window: int = WINDOW) -> str:
    """Lines between surge and dive of the line-block distribution, one per block, joined by newlines."""
    found = lines(page or "")
    weight, n = weights(found), len(found)
    sums = [max(0, sum(weight[max(0, i) : i + window])) for i in range(1 - window, n)]
    # A line counts as the highest window it is in, so that the last lines of a text count as much as the first.
    block = [max(sums[i : i + window]) for i in range(n)]
    block = [max(b, w) if line.article else b for b, w, line in zip(block, weight, found)]
    level = [b for b in block if b > 0]
    if not level:
        return ""
    middle = _median(level)
    surge = max(1, (max(level) * middle) ** 0.5 / SURGE)  # a single character is no text
    dive = middle / DIVE
    runs: list[tuple[int, int, bool]] = []  # first line, line after the last, whether an article is in it
    i = 0
    while i < n:
        end = i
        while end < n and block[end] > dive:
            end += 1
        if end > i and max(block[i:end]) > surge:
            # Windows reach over the edges of a text: lines beside an article, and short lines of bare containers,
            # must surge by themselves.
            marked = any(line.article for line in found[i:end])

            def beside(k: int) -> bool:
                return not found[k].article and (marked or not found[k].prose) and weight[k] * window <= surge

            first, last = i, end
            while first < last and beside(first):
                first += 1
            while last > first and beside(last - 1):
                last -= 1
            # Prose between two runs belongs to them, however short its lines.
            if runs and not marked and not runs[-1][2] and all(found[k].prose and weight[k] > 0 for k in range(runs[-1][1], first)):
                first = runs.pop()[0]
            runs.append((first, last, marked))
        i = end + 1
    chosen = {k for first, last, _ in runs for k in range(first, last) if weight[k] > 0}
    articles = {found[k].article for k in chosen} - {0}
    return "\n".join(line.text for k, line in enumerate(found) if k in chosen or line.article in articles)


def _texts(batches):
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    for batch in chunks(batches, "html"):
        text = [main_text(page.as_py()) for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], schema=schema
        )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text``, ``n_chars``.

    A null or empty page, and one without text, gives an empty text of 0 characters; broken markup is read as far as it
    goes, and what an unclosed menu or notice would swallow begins again at the next article. Repeated
    rows give a row each; null ids and urls stay null; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = rows.mapInArrow(_texts, "id bigint, url string, text string, n_chars bigint")
    return found.withColumnsRenamed({"id": id_col, "url": url_col})
