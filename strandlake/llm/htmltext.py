r"""Main text of HTML pages by the distribution of line blocks.

Markup is stripped to lines by a linear tokenizer that follows the HTML rules for tags, attributes, comments and raw text. A
line is the text of one block element, with character references decoded and white space turned to single spaces. Elements
that by their tag or role never hold article text (scripts, styles, menus, headers, footers, sidebars, dialogs, form fields)
give no lines; of a header within an article the headings stay. Every other line has a trust between 0 and 1:

* words of class and id that name adverts, notices or comments leave 0.05 (adverts and comments within an article, too), as
  do those that say who comments and what they give (reader-opinions, user_reactions); vaguer ones leave 0.3, unless an article or
  main element stands in between;
* outside article and main elements, the share of a line that isn't link text; headings keep a half;
* outside article and main elements, the share of the page's text that is outside of them, so an article that holds nearly
  all text leaves little trust to what stands around it, and one that is a teaser leaves nearly all.

The weight of a line is its length, at most three times the page's usual length, times its trust. Sums of weights over
sliding windows of three lines form the distribution; times the trust of the line in the middle they are its density (of
untrusted lines, under a half, the lesser neighbour counts twice). The text surges at the first line whose density exceeds a
share of the usual sum, and dives after the last. The range between is extended on both sides over trusted lines of the same
container or of an article, past untrusted ones; in it lines are kept that are trusted, or whose own density exceeds the threshold. So no tag
decides alone: an untrusted block with dense text on both sides stays.

A form that holds over half of a page's text is a frame round the page and no form. Null and empty pages give an empty
text, as do pages whose lines have no weight. What is cut off or unclosed ends at the end of the page; an end tag closes
what is open inside its element. Pages may be of any length. Repeated rows give the same text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import rows_of

# Elements by their part in a page.
RAW = frozenset("script style noscript textarea title iframe noembed noframes xmp".split())
NEVER = frozenset("head nav footer aside button menu dialog select datalist template object svg math canvas audio video label legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "option p pre search section select summary svg math object canvas audio video datalist template button label table caption tbody thead tfoot tr td th ul".split()
)
CONTAINER = frozenset("article aside body center div fieldset form header main section td th".split())
ARTICLE = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
# An end tag doesn't reach out of these.
BOUNDARY = frozenset("table td th caption html template object".split())
# A start tag closes an open element of these kinds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
IN_P = frozenset("td th tr li dd dt caption tbody thead tfoot option summary legend label button select".split())  # these don't close a paragraph
# Nouns of class and id that name what isn't the article, surely or perhaps; and nouns that say nothing by themselves.
SURELY = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent newsletter popup comment comments commentlist disqus sidebar navbar breadcrumb breadcrumbs".split())
PERHAPS = frozenset(
    "banner notice notices alert modal overlay subscribe subscription signup nav navigation menu menus toolbar topbar header masthead footer foot side aside related recommended widget widgets share sharing social "
    "respond reply replies discussion form search login copyright disclaimer pagination pager tags skip".split()
)
EMPTY_NOUNS = frozenset("list section area box block wrapper wrap container bar links link item items content body buttons button group panel unit slot text".split())
MODIFIERS = ("has", "no", "with", "without", "is")
# Who comments, what they give, and nouns that are comments by themselves.
AUDIENCE = frozenset("reader readers user users visitor visitors viewer viewers community audience your".split())
SAID = frozenset("opinion opinions voice voices reaction reactions response responses reply replies discussion discussions remark remarks thought thoughts letter letters talk".split())
COMMENTS = frozenset("feedback guestbook usercomments shoutbox talkback talkbacks livefyre".split())

WINDOW, SHARE, TRUSTED = 3, 0.2, 0.5
USUAL = 200  # length at which a line counts half in the usual length

NAME = re.compile(r"[A-Za-z][^\s/>]*+")
SKIP = re.compile(r"[\s/]*+")
KEY = re.compile(r"=?[^\s/>=]*+")
EQUALS = re.compile(r"\s*+=\s*+")
BARE = re.compile(r"[^\s>]++")
COMMENT_END = re.compile("--!?>")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def tag_end(page: str, at: int) -> tuple[int, dict[str, str]] | None:
    """The place after a tag whose name ends at ``at``, and its attributes; None if the page ends within it."""
    found: dict[str, str] = {}
    n = len(page)
    while True:
        at = SKIP.match(page, at).end()
        if at >= n:
            return None
        if page[at] == ">":
            return at + 1, found
        key = KEY.match(page, at)
        at, value = key.end(), ""
        if m := EQUALS.match(page, at):
            at = m.end()
            if at >= n:
                return None
            if page[at] in "\"'":
                end = page.find(page[at], at + 1)
                if end < 0:
                    return None
                value, at = page[at + 1 : end], end + 1
            elif m := BARE.match(page, at):
                value, at = m.group(), m.end()
        found.setdefault(key.group().lower(), value)


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", text, {}), ("start", name, attributes) and ("end", name, {}) in page order. Raw text is left out."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        mark = page[lt + 1 : lt + 2]
        if lt < n and not (mark in ("!", "?", "/") or mark.isascii() and mark.isalpha()):
            yield "text", page[at : lt + 1], {}
            at = lt + 1
            continue
        if lt > at:
            yield "text", page[at:lt], {}
        if lt == n:
            return
        if page.startswith("<!--", lt):
            if page.startswith((">", "->"), lt + 4):
                at = page.index(">", lt) + 1
                continue
            end = COMMENT_END.search(page, lt + 4)
            at = end.end() if end else n
            continue
        closing = mark == "/"
        m = NAME.match(page, lt + 1 + closing)
        if m is None:  # a declaration or another bogus comment
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        name = m.group().lower()
        got = (m.end() + 1, {}) if page.startswith(">", m.end()) else tag_end(page, m.end())
        if got is None:
            return
        at, attributes = got
        if closing:
            yield "end", name, {}
            continue
        yield "start", name, attributes
        if name in RAW:
            end = RAW_END[name].search(page, at)
            if end is None:
                return
            got = tag_end(page, end.end())
            if got is None:
                return
            at = got[0]
            yield "end", name, {}


def trust_of(attributes: dict[str, str], inside: bool) -> float:
    """By the nouns of class and id: the last part of each word, or the one before if that says nothing."""
    trust = 1.0
    for word in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().replace("_", "-").split():
        parts = [p for p in word.split("-") if p]
        if not parts or parts[0] in MODIFIERS:
            continue
        while len(parts) > 1 and (parts[-1] in EMPTY_NOUNS or parts[-1].isdigit()):
            parts.pop()
        if parts[-1] in SURELY or parts[-1] in COMMENTS or parts[-1] in SAID and AUDIENCE.intersection(parts[:-1]):
            return 0.05
        if parts[-1] in PERHAPS and not inside:
            trust = 0.3
    return trust


@dataclass
class Line:
    text: str
    trust: float  # by class words
    inside: bool  # within an article or main element
    linked: float  # share of link text
    heading: bool
    container: int
    form: int  # 0: none


@dataclass(frozen=True, slots=True)
class Scope:
    """What an open element hands down to its content."""

    name: str = ""
    never: bool = False
    in_header: bool = False  # of an article: only headings count
    trust: float = 1.0
    inside: bool = False
    heading: bool = False
    container: int = 0
    form: int = 0


class Reader:
    """Open elements, with places by name, so that every tag takes the same time however deep the page is nested."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.open: list[Scope] = []
        self.places: dict[str, list[int]] = {}
        self.boundaries: list[int] = []
        self.here = Scope()
        self.words: list[str] = []
        self.link_chars = self.chars = self.made = 0
        self.link_at: int | None = None  # how many elements were open at the open link

    def text(self, raw: str) -> None:
        got = html.unescape(raw) if "&" in raw else raw
        self.words.append(got)
        size = len(got.strip())
        self.chars += size
        self.link_chars += size if self.link_at is not None and len(self.open) >= self.link_at else 0

    def close_block(self) -> None:
        text, s = " ".join("".join(self.words).split()), self.here
        if text:
            never = s.never or s.in_header and not s.heading
            self.lines.append(Line(text, 0.0 if never else s.trust, s.inside, self.link_chars / max(1, self.chars), s.heading, s.container, s.form))
        self.words.clear()
        self.link_chars = self.chars = 0

    def leave(self, keep: int) -> None:
        """Closes elements until ``keep`` are open."""
        while len(self.open) > keep:
            name = self.open.pop().name
            self.places[name].pop()
            if name in BOUNDARY:
                self.boundaries.pop()
        self.here = self.open[-1] if self.open else Scope()

    def place(self, name: str) -> int | None:
        """Where the innermost open element of that name is, unless a boundary stands in between."""
        at = self.places.get(name)
        return at[-1] if at and at[-1] >= (self.boundaries[-1] if self.boundaries else 0) else None

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name == "a":
            self.link_at = len(self.open)
        if name in ("br", "hr"):
            self.words.append(" ")
        if name == "hr":
            self.close_block()
        if name not in BLOCK or name in VOID:
            return
        self.close_block()
        if name not in IN_P and (at := self.place("p")) is not None:
            self.leave(at)
        for other in CLOSES.get(name, ()):
            at = self.place(other)
            if at is not None and (name not in ("td", "th", "tr") or at >= (self.places.get("table") or [0])[-1]):
                self.leave(at)
        s = self.here
        role = attributes.get("role", "").lower()
        inside = s.inside or name in ARTICLE or role in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"
        begins = inside and not s.inside
        self.made += 1
        header = name == "header"
        scope = Scope(
            name,
            s.never or name in NEVER or role in ROLES or header and not s.inside,
            s.in_header or header and s.inside,
            (1.0 if begins else s.trust) * trust_of(attributes, inside),
            inside,
            s.heading or name in HEADING,
            self.made if name in CONTAINER else s.container,
            0 if begins else self.made if name in ("form", "fieldset") and not s.form else s.form,
        )
        self.places.setdefault(name, []).append(len(self.open))
        if name in BOUNDARY:
            self.boundaries.append(len(self.open))
        self.open.append(scope)
        self.here = scope

    def end(self, name: str) -> None:
        if name == "a":
            self.link_at = None
        if name not in BLOCK or name in VOID:
            return
        self.close_block()
        at = (self.places.get(name) or [None])[-1] if name in BOUNDARY else self.place(name)
        if at is not None:
            self.leave(at)


def lines_of(page: str) -> list[Line]:
    reader = Reader()
    for kind, value, attributes in tokens(page):
        if kind == "text":
            reader.text(value)
        elif kind == "start":
            reader.start(value, attributes)
        else:
            reader.end(value)
    reader.close_block()
    return reader.lines


def usual(values: list[float], weights: list[float]) -> float:
    """The weighted median."""
    order = sorted(range(len(values)), key=values.__getitem__)
    sums = list(accumulate(weights[i] for i in order))
    return values[order[bisect_left(sums, sums[-1] / 2)]]


def trusts(lines: list[Line]) -> list[float]:
    forms: dict[int, float] = {}
    for x in lines:
        forms[x.form] = forms.get(x.form, 0) + len(x.text) * x.trust
    largest = max(forms, key=forms.__getitem__, default=0)
    frame = largest if 2 * forms.get(largest, 0) > sum(forms.values()) else 0
    inside = sum(len(x.text) * x.trust for x in lines if x.inside and x.form in (0, frame))
    around = sum(len(x.text) * x.trust for x in lines if not x.inside and x.form in (0, frame))
    outside = around / max(1, inside + around)
    out = []
    for x in lines:
        if x.form not in (0, frame):
            out.append(0.0)
        elif x.inside:
            out.append(x.trust)
        else:
            out.append(x.trust * outside * max(1 - x.linked, 0.5 if x.heading else 0.0))
    return out


def window_sums(weights: list[float]) -> list[float]:
    half = WINDOW // 2
    total = [0.0, *accumulate(weights)]
    return [total[min(len(weights), i + half + 1)] - total[max(0, i - half)] for i in range(len(weights))]


def main_lines(lines: list[Line]) -> list[int]:
    """The lines that are kept, in order."""
    trust = trusts(lines)
    told = [i for i, t in enumerate(trust) if t > 0]
    if not told:
        return []
    sizes = [float(len(x.text)) for x in lines]
    counts = [trust[i] * sizes[i] / (sizes[i] + USUAL) for i in told]
    most = 3 * usual([sizes[i] for i in told], counts)
    weights = [min(s, most) * t for s, t in zip(sizes, trust, strict=True)]
    sums = window_sums(weights)
    threshold = SHARE * usual([sums[i] for i in told], counts)
    amid = [w + 2 * min(a, b) for a, w, b in zip([0.0, *weights], weights, [*weights[1:], 0.0], strict=False)]
    dense = [t > 0 and t * (s if t >= TRUSTED else m) > threshold for t, s, m in zip(trust, sums, amid, strict=True)]
    surge, dive = dense.index(True) if True in dense else 0, len(dense) - dense[::-1].index(True) if True in dense else 0
    if surge == dive:
        return []
    trusted = [t >= TRUSTED for t in trust]
    core = [lines[i] for i in range(surge, dive) if dense[i] and trusted[i]]
    near, of_article = {x.container for x in core}, any(x.inside for x in core)
    joins = lambda i: not trusted[i] or lines[i].inside and of_article or lines[i].container in near
    while surge and joins(surge - 1):
        surge -= 1
    while dive < len(lines) and joins(dive):
        dive += 1
    return [i for i in range(surge, dive) if trusted[i] or dense[i]]


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    return "\n\n".join(lines[i].text for i in main_lines(lines))


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars. An empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, htmls in rows_of(batches):
            if ids:
                texts = [main_text(h) for h in htmls]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=TEXTS)

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
