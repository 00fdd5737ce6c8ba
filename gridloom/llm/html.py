"""HTML extraction: the maximum-scoring run of a page's tokens.

A page is a row of words and tags. Elements that are never content by their kind (scripts, navigation, page heads and
feet, asides) are taken out with all they hold. Of the tokens left, each word scores positive, one in a link less than
another, and each tag negative, with weights learned from labelled pages: the log odds of standing inside the marked
region. One linear scan finds the run with the largest sum; it is the text, less the elements in it that say by their class,
id or role that they are something else (adverts, notices, comments, menus). Such a name counts only if the element
isn't a wrapper: one that holds the page's `article` or `main`, or, on a page without them, over half of its words. Forms
that wrap the page stay for the same reason. `labelled` makes the pages; `learn` takes any others.

The text: character references decoded, white space inside a block one space, blocks (parted by block-level tags) in
page order joined by one space.

Defined cases: null or empty html, and pages without words, give an empty text; an element that is never closed
is not taken out with what follows, save scripts and styles; of runs with equal sums the first, and of
those the longest, is taken; repeated rows give repeated rows, null ids and urls stay; other columns aren't looked at, a
column named as the result is replaced; an empty table gives an empty one. Long and malformed pages take time and memory
in proportion to their length: no part of a page is scanned more than a few times.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pages import PAGES

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
RAW = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp")}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
OUT = {"head", "nav", "header", "footer", "aside", "button", "select", "option", "svg", "canvas", "dialog", "menu", "label", "audio", "video", *RAW}
#: Out, too, unless they wrap the page.
WRAPPING = {"form", "fieldset", "object"}
#: What a part of a class, an id or a role says of an element that isn't content.
HINTS = set(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promos banner banners cookie cookies consent gdpr notice notices alert alerts popup popups modal "
    "overlay newsletter newsletters subscribe signup sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer footers header headers "
    "masthead topbar toolbar share sharing social related recommended outbrain taboola tags meta login search skip toc complementary contentinfo dialog".split()
)
COMMENTS = {"comment", "comments", "replies", "disqus", "responses", "respond", "discussion"}
#: Before a name: it tells what the page is like and not what the element is.
_LIKE = {"has", "no", "not", "with", "without", "is", "hide", "show"}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "ruby", "rt", "rp", "rb"}
#: Tags that a start tag of the key ends when they are open.
ENDS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
NEVER = {"body", "html", "main"}


def tokens(page: str) -> list[list]:
    """[kind, name or text, attributes, number of the token that closes it]: kind is "open", "close" or "text"."""
    out: list[list] = []
    n, at, start = len(page), 0, 0  # start: of the text that isn't a token yet
    quoted, gone = True, set()  # whether quotes still hold `>`; raw elements of which no end is left

    def text(end: int) -> None:
        if end > start:
            out.append(["text", page[start:end], "", -1])

    while (at := page.find("<", at)) >= 0:
        lead = page[at + 1 : at + 2]
        if lead in ("!", "?"):
            text(at)
            opening, closing = ("<!--", "-->") if page.startswith("<!--", at) else ("<![CDATA[", "]]>") if page.startswith("<![CDATA[", at) else ("<!", ">")
            end = page.find(closing, at + len(opening))
            at = start = n if end < 0 else end + len(closing)
            continue
        close = lead == "/"
        name = _NAME.match(page, at + 1 + close)
        if not name:
            at += 1
            continue
        end = name.end()
        while quoted:
            end = _PLAIN.match(page, end).end()
            if end >= n:
                quoted = False
            elif page[end] == ">":
                break
            else:
                end = page.find(page[end], end + 1) + 1
                quoted = end > 0
        if not quoted:  # an open quote would hold the rest of the page: from here on quotes hold nothing
            end = page.find(">", name.end())
        if end < 0:
            break
        text(at)
        kind, rest = name[0].lower(), page[name.end() : end]
        at = start = end + 1
        if close:
            out.append(["close", kind, "", -1])
            continue
        out.append(["open", kind, rest, -1])
        if kind in RAW and kind not in gone:
            ending = RAW[kind].search(page, at)
            if not ending:
                gone.add(kind)
            if ending or kind in ("script", "style", "xmp"):
                out[-1][3] = len(out)
                out.append(["close", kind, "", -1])
                at = start = ending.end() if ending else n
        elif kind in ("script", "style", "xmp"):
            out[-1][3] = len(out)
            out.append(["close", kind, "", -1])
            at = start = n
    text(n)
    return out


def matched(row: list[list]) -> None:
    """Writes into each start tag where its element ends. A start tag that nothing ends has none."""
    stack: list[int] = []
    opened: Counter = Counter()
    for i, (kind, name, rest, end) in enumerate(row):
        if kind == "open" and end < 0 and name not in VOID and not rest.endswith("/"):
            ended = ENDS.get(name, ())
            while stack and row[stack[-1]][1] in ended:
                opened[row[stack[-1]][1]] -= 1
                row[stack.pop()][3] = i - 1
            stack.append(i)
            opened[name] += 1
        elif kind == "close" and opened[name]:
            while row[stack[-1]][1] != name:
                opened[row[stack.pop()][1]] -= 1
            opened[name] -= 1
            row[stack.pop()][3] = i


def said(rest: str) -> int:
    """What class, id and role say: 2 reader comments, 1 something else that isn't content, 0 nothing."""
    if not rest:
        return 0
    worst = int(HIDDEN.search(rest) is not None)
    for value in NAMED.findall(rest):
        for name in "".join(value).split():
            parts = [p.lower() for p in _PARTS.findall(name)]
            if parts and parts[0] not in _LIKE:
                worst = max(worst, 2 if not COMMENTS.isdisjoint(parts) else int(not HINTS.isdisjoint(parts)))
    return worst


def _taken(row: list[list], pick: list[bool]) -> list[bool]:
    """For each token whether it lies in a picked element that ends somewhere."""
    out, i = [False] * len(row), 0
    while i < len(row):
        end = row[i][3]
        if pick[i] and end >= i:
            out[i : end + 1] = [True] * (end + 1 - i)
            i = end
        i += 1
    return out


def excluded(row: list[list]) -> tuple[list[bool], list[bool]]:
    """For each token whether it lies in an element that is never content, and whether in one that says so itself."""
    kinds = _taken(row, [kind == "open" and name in OUT for kind, name, *_ in row])
    says = [0 if kind != "open" or kinds[i] or name in NEVER else said(rest) for i, (kind, name, rest, _) in enumerate(row)]
    words, mains = [0], [0]
    for i, (kind, name, *_) in enumerate(row):
        words.append(words[-1] + (len(name.split()) if kind == "text" and not kinds[i] else 0))
        mains.append(mains[-1] + (kind == "open" and not kinds[i] and (name == "main" or name == "article" and says[i] < 2)))
    pick = []
    for i, (kind, name, _, end) in enumerate(row):
        if kind != "open" or end < i or not (says[i] or name in WRAPPING) or name == "article" and says[i] < 2:
            pick.append(False)
            continue
        holds, mass = mains[end + 1] - mains[i + 1], words[end + 1] - words[i]
        wraps = holds > 0 or says[i] < 2 and not mains[-1] and 2 * mass > words[-1]
        pick.append(not wraps)
    return kinds, _taken(row, pick)


def linked(row: list[list]) -> list[bool]:
    """For each token whether it stands in a link that ends."""
    return _taken(row, [kind == "open" and name == "a" for kind, name, *_ in row])


@dataclass(frozen=True)
class Weights:
    """Of tags, all negative, and of a word outside links and in one, positive."""

    tags: dict[str, float]
    word: float
    link: float
    other: float = -1.5

    def of(self, row: list[list]) -> list[float]:
        inside = linked(row)
        return [(self.link if a else self.word) * len(name.split()) if kind == "text" else self.tags.get(name, self.other) for (kind, name, *_), a in zip(row, inside, strict=True)]


def learn(pages: list[tuple[str, str, str]] = PAGES) -> Weights:
    """From pages given as what stands before, in and after the region: log odds of standing in it, kept from changing sign."""
    tags, words = (Counter(), Counter()), (Counter(), Counter())
    for before, part, after in pages:
        row = tokens(before) + [None] + tokens(part) + [None] + tokens(after)
        held, flat = 0, [t for t in row if t]
        matched(flat)
        links = iter(linked(flat))
        for t in row:
            if t is None:
                held = 1 - held
                continue
            link = next(links)
            if t[0] == "text":
                words[held][link] += len(t[1].split())
            else:
                tags[held][t[1]] += 1
    n, m = sum(tags[1].values()), sum(tags[0].values())
    odds = lambda a, b: math.log((a + 1) / (b + 1))
    base = odds(n, m)
    return Weights(
        {k: min(-0.05, odds(tags[1][k], tags[0][k]) - base - 1.5) for k in {*tags[0], *tags[1]}},
        max(0.05, odds(words[1][False], words[0][False])),
        max(0.02, odds(words[1][True], words[0][True])),
    )


_WEIGHTS = learn()


def region(row: list[list], gone: list[bool], weights: Weights = _WEIGHTS) -> tuple[int, int]:
    """The run [from, to) of tokens with the largest sum."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, value in enumerate(weights.of(row)):
        if gone[i]:
            continue
        total += value
        if total <= 0:
            total, start = 0.0, i + 1
        elif total >= best:
            best, span = total, (start, i + 1) if total > best or start == span[0] else span
    return span


def extract(page: str | None) -> str:
    if not page:
        return ""
    row = tokens(page)
    matched(row)
    gone = [x or y for x, y in zip(*excluded(row), strict=True)]
    a, b = region(row, gone)
    out = []
    for i in range(a, b):
        kind, name, *_ = row[i]
        if kind == "text" and not gone[i]:
            out.append(html.unescape(name))
        elif name not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


def extracted(df: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """Adds the text."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(extract)

    return df.withColumn(into, run(F.coalesce(F.col(html_col).cast("string"), F.lit(""))))


def digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extracted(pages.select("page_id", "url", F.col("html").alias("__html")), "__html").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
